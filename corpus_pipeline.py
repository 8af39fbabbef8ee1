"""The corpus pipeline: quality rules, line dedup, near-duplicates, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``, whatever else
they are named.  Nulls, empty and very long texts, ties, repeated rows and empty tables have defined results at each stage: they are
in the stages' docstrings and those of the operators they call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkfold.llm.common import documents, table
from inkfold.llm.credentials import redact
from inkfold.llm.lines import line_dedup
from inkfold.llm.packing import pack
from inkfold.llm.quality import quality_filter
from inkfold.llm.simhash import near_dedup
from inkfold.sources.session import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression is in band.

    Null and empty texts are out of band and go; repeated rows all stay or all go.
    """
    return quality_filter(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that another line of the corpus is kept for.

    Documents that never had a line stay as they are; those left without one go; of repeated rows the first keeps its lines.
    """
    return line_dedup(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of least id.

    Null texts and those without words are in no group and stay; of repeated rows one stays.
    """
    return near_dedup(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by their kind.

    Null and empty texts stay as they are; every row stays.
    """
    return redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of each piece of each document.

    Duplicate clusters are near copies that are left (by SimHash, more narrowly than in the stage before), and equal texts.  Null and
    empty texts have a null bin.
    """
    return pack(docs)


def _shipped(stage):
    return lambda spark, docs, sf_dir: stage(ship(spark), docs, sf_dir)


STAGES = [
    ("quality rules", _shipped(quality_stage)),
    ("line dedup", _shipped(line_stage)),
    ("SimHash near-dedup", _shipped(near_duplicate_stage)),
    ("secret scans", _shipped(secret_stage)),
    ("best-fit packing", _shipped(packing_stage)),
]
#: zstandard, MinHash, SimHash and automata can't be expressed in SQL; tests/llm holds run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = table(docs, name.replace(" ", "-"))
    return docs
