"""Streams give what the same rows give in a batch."""

from pyspark.sql import functions as F

from inkfold.plans import analysis, planted
from inkfold.streaming import events as ev


def test_stream_of_documents(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(planted.ALL)), "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ev.analyze_stream(ev.read_documents(spark, str(tmp_path / "in"), "doc_id long, text string"))
    q = ev.write_events(ev.sentence_events(stream), str(tmp_path / "log"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == analysis.graded(docs).count()
    states = ev.run_states(log)
    assert states.where("status = 'running'").count() == docs.count() and states.agg(F.sum("n_sentences")).first()[0] == log.count()


def test_dead_sinks_are_left_out(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([(k, "a. b.")], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
    got = []

    def dead(batch, epoch):
        raise OSError("gone")

    stream = ev.read_documents(spark, str(tmp_path / "in"), "doc_id long, text string", maxFilesPerTrigger=1)
    q = ev.fan_out(ev.analyze_stream(stream), [dead, lambda b, e: got.append(b.count())], str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sum(got) == 4


def test_run_states(spark):
    rows = [("a", 1, "stage_start", "{}"), ("a", 3, "run_done_v2", '{"x":1}'), ("a", 2, "stage4_sentence", '{"action":"unfixed_risky"}'), ("b", 1, "sentence_tagged", "{}"), ("c", 1, "error", "{}"), ("c", 2, "run_done_v2", "{}")]
    got = {r["run_id"]: r for r in ev.run_states(spark.createDataFrame(rows, "run_id string, seq long, type string, data string")).collect()}
    assert (got["a"]["status"], got["a"]["unfixed"], got["a"]["result"]) == ("done", 1, '{"x":1}') and got["b"]["status"] == "running" and got["c"]["status"] == "error"


def test_events_of_the_pipeline(spark):
    """All twelve types, in the order of the stages, and the states that follow from them."""
    docs = spark.createDataFrame([(1, "It rained; nobody knew. Furthermore, it was a pivotal moment — really."), (2, " ".join(f"They walked to house {i} and spoke about the weather there." for i in range(120)))], "doc_id long, text string")
    stages = analysis.run_stages(docs)
    log = [(r["run_id"], r["type"]) for r in ev.pipeline_events(stages).orderBy("run_id", "seq").collect()]
    own = [t for i, t in log if i == "1"]
    assert own[:3] == ["stage_start", "stage1_done", "stage_start"] and own[-1] == "run_done_v2" and own.count("stage_start") == 6
    assert [t for t in own if t.endswith("_done")] == [f"stage{k}_done" for k in range(1, 7)]
    assert sum(t == "stage3_progress" for i, t in log if i == "2") >= 2  # a long text goes by segments
    kinds = {t for _, t in log} | {r["type"] for r in ev.pipeline_events(stages, "casual").collect()}
    assert kinds - {"stage4_sentence"} == set(ev.STAGES) - {"error", "stage4_sentence"}
    assert {r["status"] for r in ev.run_states(ev.pipeline_events(stages)).collect()} == {"done"}


def test_a_sink_gets_another_chance(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, "a. b.")], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
    seen = []

    def shaky(batch, epoch):
        seen.append(epoch)
        if len(seen) == 1:
            raise OSError("busy")

    stream = ev.read_documents(spark, str(tmp_path / "in"), "doc_id long, text string", maxFilesPerTrigger=1)
    ev.fan_out(ev.analyze_stream(stream), [shaky], str(tmp_path / "cp")).awaitTermination(120)
    assert len(seen) >= 3
