"""Structured Streaming: documents as they come, and the log of what happens to them."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.analysis import graded
from ..sources.tables import problem

_log = logging.getLogger(__name__)
STAGES = ("stage1_done", "sentence_tagged", "stage2_done", "stage3_progress", "stage3_done", "stage4_sentence", "stage4_done", "stage5_done", "stage6_skipped", "stage6_done", "run_done_v2", "stage_start", "error")
EVENT = "run_id string, seq long, ts timestamp, type string, data string"


def read_documents(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def analyze_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Graded sentences of accepted documents.  Stateless: the rules need no more than a row, so it appends at once."""
    return graded(docs.where(problem(F.col(text_col)).isNull()), id_col=id_col, text_col=text_col)


def once(docs: DataFrame, id_col: str = "run_id", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Each run once, however often it is sent within the watermark."""
    return docs.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])


def event(run_id, seq, type_: str, data) -> list:
    """Columns of an event with its data as JSON."""
    return [run_id.alias("run_id"), seq.cast("long").alias("seq"), F.current_timestamp().alias("ts"), F.lit(type_).alias("type"), F.to_json(data).alias("data")]


def sentence_events(sentences: DataFrame, run_id: str = "doc_id") -> DataFrame:
    """A ``sentence_tagged`` event for each graded sentence."""
    return sentences.select(*event(F.col(run_id).cast("string"), F.col("idx") + 2, "sentence_tagged", F.struct("idx", "rule_severity", F.size("violations").alias("violations"))))


STAGE_NAMES = ("Global scoring", "Per-sentence tagging", "Standardized rewrite", "Stubborn sentence attack", "Human touch polish", "Formality calibration")


def pipeline_events(stages: DataFrame, genre: str = "professional") -> DataFrame:
    """(run_id, seq, ts, type, data) of all events of the runs that analysis.run_stages gives, in the order in which they happen.

    Each run's events are an array of its row, so nothing is shuffled.
    """

    def one(type_: str, **data) -> Column:
        return F.array(F.struct(F.lit(type_).alias("type"), F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in data.items()])).alias("data")))

    def each(type_: str, items: Column, *names: str) -> Column:
        return F.transform(items, lambda x: F.struct(F.lit(type_).alias("type"), F.to_json(F.struct(*[x[n].alias(n) for n in names])).alias("data")))

    start = lambda n: one("stage_start", stage=n, name=STAGE_NAMES[n - 1])
    c = F.col
    progress = F.when(c("route") == "long", F.transform(F.sequence(F.lit(0), c("n_segments") - 1), lambda i: F.struct(F.lit("stage3_progress").alias("type"), F.to_json(F.struct(i.alias("segment_idx"), c("n_segments").alias("total_segments"), F.lit("done").alias("status"))).alias("data"))))
    none = F.array().cast("array<struct<type:string,data:string>>")
    formal = genre in ("academic", "professional")
    last = F.concat(start(6), one("stage6_done", ai_score=c("final_score"), accepted=c("formality") == "accepted", genre=genre)) if formal else one("stage6_skipped", genre=genre)
    events = F.concat(
        start(1), one("stage1_done", ai_score=c("orig_score"), already_human=c("already_human")), start(2), each("sentence_tagged", c("tags"), "idx", "severity", "violations"), one("stage2_done", sentences=F.size("tags")),
        start(3), F.coalesce(progress, none), F.when(c("retry"), one("stage3_progress", segment_idx=0, total_segments=1, status="retry")).otherwise(none), one("stage3_done", ai_score=c("stage3_score")),
        start(4), each("stage4_sentence", c("actions"), "idx", "action", "action_sem"), one("stage4_done", rewritten=c("n_rewritten"), deleted=c("n_deleted"), unfixed=c("n_unfixed_risky"), ai_score=c("stage4_score")),
        start(5), one("stage5_done", ai_score=c("stage5_score")), last, one("run_done_v2", final_ai_score=c("final_score"), final_sem_score=c("final_sem"), unfixed=c("n_unfixed_risky")),
    )
    return stages.select(c("doc_id").cast("string").alias("run_id"), F.posexplode(events).alias("seq", "e")).select("run_id", c("seq").cast("long").alias("seq"), F.current_timestamp().alias("ts"), "e.type", "e.data")


def run_states(events: DataFrame) -> DataFrame:
    """(run_id, status, last_type, n_events, n_sentences, unfixed, result): the state of a run from its events, in any order.

    A fold by aggregates that merge, so it also runs incrementally on a stream in complete or update mode.
    """
    last = lambda c: F.max_by(c, "seq")
    return events.groupBy("run_id").agg(
        F.when(F.count_if(F.col("type") == "error") > 0, "error").when(F.count_if(F.col("type") == "run_done_v2") > 0, "done").otherwise("running").alias("status"),
        last("type").alias("last_type"),
        F.count("*").alias("n_events"),
        F.count_if(F.col("type") == "sentence_tagged").alias("n_sentences"),
        F.count_if((F.col("type") == "stage4_sentence") & (F.get_json_object("data", "$.action") == "unfixed_risky")).alias("unfixed"),
        F.max_by(F.when(F.col("type") == "run_done_v2", F.col("data")), F.when(F.col("type") == "run_done_v2", F.col("seq"))).alias("result"),
    )


def write_events(events: DataFrame, path: str, checkpoint: str, **trigger):
    """The log as an append-only Parquet table."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def fan_out(events: DataFrame, sinks: list, checkpoint: str, patience: int = 3, **trigger):
    """Each batch to every sink.  A sink that fails doesn't hold up the others; it is tried again with the next batch, and given up
    with its last error in the log after ``patience`` failures in a row."""
    failures = [0] * len(sinks)

    def send(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for i, sink in enumerate(sinks):
                if failures[i] >= patience:
                    continue
                try:
                    sink(batch, epoch)
                    failures[i] = 0
                except Exception:  # any client's error
                    failures[i] += 1
                    _log.exception("sink %d failed on batch %d, %d time(s) in a row", i, epoch, failures[i])
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def tumbling(events: DataFrame, width: str = "1 hour", key: str = "event_type", value: str = "value", delay: str | None = None) -> DataFrame:
    """(window_start, key, n, total): fixed windows; with ``delay`` late events beyond the watermark are dropped."""
    own = events.withWatermark("ts", delay) if delay else events
    return own.groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", delay: str | None = None) -> DataFrame:
    """(key, session_start, session_end, n): activity without a gap."""
    own = events.withWatermark("ts", delay) if delay else events
    return own.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
