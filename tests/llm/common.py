"""Documents for the tests: the smallest given table, and rows that are awkward in every way."""

import os

DIR = "/root/testdata/sf0.001"
HAVE = os.path.isdir(DIR)

PROSE = "the quick brown fox jumps over the lazy dog while seven small birds look on from an old stone wall near the river"


def edge_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and columns whose names are used inside."""
    long = " ".join(f"{PROSE} number {i} of many." for i in range(1500))
    lines = "\n".join(f"line {i} of the long list with its own words {i * 7919}" for i in range(3000))
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n \t", None, None), (None, "a text without an id but with words", "en", "b"),
        (None, "a text without an id but with words", "en", "b"), (None, None, None, None), (4, PROSE, "en", "a"), (4, PROSE, "en", "a"),
        (5, PROSE, "en", None), (6, long, "en", "a"), (7, lines, "en", "a"), (8, "x", "en", "a"), (9, "éàü 漢字 😀 ñandú", "fr", "c"),
        (10, "\n\n", "en", "a"), (11, "word " * 400, "en", "a"), (12, "1 2 3", "en", "a"), (13, long + " and one more", "en", "b"),
    ]
    extra = ["_doc", "_key", "hash", "line", "gone", "row", "node", "anchor", "bands", "size", "g", "copy", "verdict", "toxic", "tokens", "z"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    data = [(*r, None if r[1] is None else len(r[1]), *([f"{r[0]}"] * len(extra))) for r in rows]
    return spark.createDataFrame(data, schema)


def empty_docs(spark):
    return edge_docs(spark).where("doc_id = -1")


def given(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def union_find(n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(a, b):
        parent[find(a)] = find(b)

    return find, link
