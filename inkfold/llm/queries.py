"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracles
from .bpe import encode_documents
from .common import documents
from .credentials import secrets
from .fingerprints import fingerprints
from .lines import duplicate_lines
from .packing import pack
from .quality import quality
from .separators import token_counts
from .simhash import near_duplicates
from .suffixes import repeated_passages
from .toxicity import toxicity

QUERIES = {
    "op1_best_fit_packing": lambda spark, d: pack(documents(spark, d)),
    "op2_secret_scan": lambda spark, d: secrets(documents(spark, d)),
    "op3_byte_bpe": lambda spark, d: encode_documents(documents(spark, d)),
    "op4_quality_bands": lambda spark, d: quality(documents(spark, d)),
    "op5_multiset_fingerprints": lambda spark, d: fingerprints(documents(spark, d)).withColumn("vector", F.lower(F.hex("vector"))),
    "op6_simhash_near_duplicates": lambda spark, d: near_duplicates(documents(spark, d)),
    "op7_toxicity": lambda spark, d: toxicity(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "op8_token_counts": lambda spark, d: token_counts(documents(spark, d)),
    "op9_repeated_passages": lambda spark, d: repeated_passages(documents(spark, d)),
    "op10_line_dedup": lambda spark, d: duplicate_lines(documents(spark, d)),
}
#: the others (automata, zstandard) can't be expressed in SQL; tests/llm has their brute-force versions
ORACLE_SQL = {
    "op1_best_fit_packing": oracles.best_fit(),
    "op3_byte_bpe": oracles.encoded(),
    "op5_multiset_fingerprints": oracles.multiset_fingerprints(),
    "op6_simhash_near_duplicates": oracles.near_duplicates(),
    "op7_toxicity": oracles.toxicity(),
    "op8_token_counts": oracles.token_counts(),
    "op9_repeated_passages": oracles.repeated_passages(),
    "op10_line_dedup": oracles.duplicate_lines(),
}
