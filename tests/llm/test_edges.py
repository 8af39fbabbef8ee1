"""Every operator and stage on awkward rows and on an empty table."""

import pytest

import corpus_pipeline
from inkfold.llm import bpe, credentials, fingerprints, lines, packing, quality, separators, simhash, suffixes, toxicity

from .common import PROSE, edge_docs, empty_docs

OPS = {
    "pack": packing.pack,
    "secrets": credentials.secrets,
    "bpe": bpe.encode_documents,
    "quality": quality.quality,
    "fingerprints": fingerprints.fingerprints,
    "simhash": simhash.near_duplicates,
    "toxicity": toxicity.toxicity,
    "separators": separators.token_counts,
    "suffixes": suffixes.repeated_passages,
    "lines": lines.duplicate_lines,
}


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, name):
    assert OPS[name](empty_docs(spark)).collect() == []


@pytest.mark.parametrize("name", ["bpe", "quality", "fingerprints", "toxicity", "separators"])
def test_one_row_for_each_row(spark, name):
    docs = edge_docs(spark)
    got = sorted(str(r["doc_id"]) for r in OPS[name](docs).collect())
    assert got == sorted(str(r["doc_id"]) for r in docs.collect())


def test_null_and_empty_values(spark):
    docs = edge_docs(spark)
    by = {r["doc_id"]: r for r in bpe.encode_documents(docs).collect() if r["doc_id"] is not None}
    assert by[1]["tokens"] is None and by[1]["round_trip"] is None and by[2]["tokens"] == [] and by[2]["round_trip"]
    assert all(r["round_trip"] in (None, True) for r in by.values())
    by = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect() if r["doc_id"] is not None}
    assert by[1]["vector"] is None and set(by[2]["vector"]) == {0} and set(by[10]["vector"]) == {0}
    by = {r["doc_id"]: r["verdict"] for r in quality.quality(docs).collect() if r["doc_id"] is not None}
    assert by[1] == "null" and by[2] == "empty" and by[11] == "repetitive" and by[4] == "keep"
    counts = {r["doc_id"]: r["n_tokens"] for r in separators.token_counts(docs).collect() if r["doc_id"] is not None}
    assert counts[1] == 0 and counts[2] == 0 and counts[8] == 1


def test_stages_keep_columns(spark):
    docs = edge_docs(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for d in (docs, empty_docs(spark)):
            out = stage(spark, d, "")
            rows = out.collect()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.dtypes == docs.dtypes
            if d is not docs:
                assert rows == []


def test_repeated_rows(spark):
    docs = edge_docs(spark)
    kept = simhash.near_dedup(docs).collect()
    assert sum(r["doc_id"] == 4 for r in kept) == 1 and not any(r["doc_id"] == 5 for r in kept)
    assert sum(r["doc_id"] is None and r["text"] is not None for r in kept) == 1
    assert {1, 2, 3, 10} <= {r["doc_id"] for r in kept}  # without words: no group
    kept = lines.line_dedup(docs).collect()
    assert sum(r["text"] == kept[0]["text"] and r["doc_id"] == 4 for r in kept) <= 1
    assert sum(r["doc_id"] == 4 for r in kept) == 1 and not any(r["doc_id"] == 5 for r in kept)
    assert {1, 2, 3, 10} <= {r["doc_id"] for r in kept}
    packed = packing.pack(docs).collect()
    assert len({r["bin_id"] for r in packed if r["doc_id"] == 4}) == 2
    assert {r["doc_id"] for r in packed if r["bin_id"] is None} == {1, 2, None}
    assert {r["doc_id"] for r in packed if r["n_tokens"] == packing.CAPACITY} == {6, 7, 13}


def test_survivors_do_not_depend_on_layout(spark):
    rows = [(1, PROSE, x) for x in "cabd"] + [(2, f"{PROSE}\nanother line of its own", "z"), (3, "quite other words here for once", None), (3, "quite other words here for once", "y")]
    schema = "doc_id long, text string, x string"
    for fn in (simhash.near_dedup, lines.line_dedup):
        got = {tuple(sorted(map(str, fn(spark.createDataFrame(own, schema).repartition(n)).collect()))) for own in (rows, rows[::-1]) for n in (1, 3)}
        assert len(got) == 1
        assert "x='a'" in str(got) and "x='b'" not in str(got)


def test_repeated_column_names(spark):
    docs = spark.createDataFrame([(1, PROSE, 1, 2), (2, PROSE, 3, 4), (3, "AKIA" + "IOSFODNN7EXAMPLE and more ordinary words", 5, 6)], "doc_id long, text string, a long, b long").toDF("doc_id", "text", "k", "k")
    assert [tuple(r) for r in simhash.near_dedup(docs).orderBy("doc_id").collect()][0] == (1, PROSE, 1, 2)
    for fn in (lines.line_dedup, credentials.redact, quality.quality_filter):
        assert fn(docs).columns == ["doc_id", "text", "k", "k"] and fn(docs).count() >= 2
    packing.pack(docs, source_col="k").collect()
    for name in OPS.keys() - {"pack"}:
        OPS[name](docs).collect()


def test_labels_of_any_kind(spark):
    """Null ids and marks, labels for a document that isn't there, contradictory ones."""
    docs = spark.createDataFrame([(i, f"you are a blorf number {i} of the {w} folk") for i, w in enumerate("red blue green grey black white pink brown".split())] + [(50, "fine words about the sea")], "doc_id long, text string")
    marks = [(i, t) for i in range(8) for t in (0, 1)] + [(None, 1), (50, None), (50, 0), (999, 1)]
    got = toxicity.toxicity(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert {r["doc_id"]: r["toxic"] for r in got.collect()}[50] is False
    few = toxicity.MAX_LABELLED
    try:
        toxicity.MAX_LABELLED = 1
        assert got.count() == 9
    finally:
        toxicity.MAX_LABELLED = few


def test_no_shared_folder_on_a_cluster():
    from inkfold.llm.common import shared_dir

    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError):
        shared_dir(Session)
