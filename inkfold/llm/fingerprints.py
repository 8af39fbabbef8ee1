"""Document fingerprints by a homomorphic multiset hash.

Each paragraph (a line, stripped of white space, not empty) is expanded by SHA-256 to a wide vector of LANES unsigned words of 32
bits: the SHA-256 of the paragraph, in hexadecimal, is hashed again behind each of the numbers 0 to BLOCKS - 1 and a colon.  A
document's fingerprint is the sum of its paragraphs' vectors, lane by lane modulo 2**32.  Sums commute, so documents with the same
paragraphs in any order are equal, and a paragraph is inserted or deleted by adding or subtracting its vector.

Defined results: null text has a null vector, a null digest and no paragraphs; empty or blank text the zero vector; repeated rows get
equal fingerprints each; a paragraph that occurs twice counts twice; a text of any length is summed whole, 4,096 paragraphs at a time;
null ids and other columns, whatever their names, are of no account; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ID, TEXT, keyed, map_arrow

BLOCKS = 8
LANES = 8 * BLOCKS
SCHEMA = "doc_id long, n_paragraphs int, vector binary, digest string"
BLANK = b" \t\r\x0b\x0c"
_PREFIXES = [f"{k}:".encode() for k in range(BLOCKS)]


def paragraphs(data: bytes) -> list[bytes]:
    return [p for x in data.split(b"\n") if (p := x.strip(BLANK))]


def expand(paragraph: bytes) -> bytes:
    own = hashlib.sha256(paragraph).hexdigest().encode()
    return b"".join([hashlib.sha256(x + own).digest() for x in _PREFIXES])


def fingerprint(data: bytes) -> bytes:
    total = np.zeros(LANES, ">u4")
    for p in paragraphs(data):
        total += np.frombuffer(expand(p), ">u4")
    return total.tobytes()


def combine(a: bytes, b: bytes) -> bytes:
    """The fingerprint of both multisets together."""
    return (np.frombuffer(a, ">u4") + np.frombuffer(b, ">u4")).astype(">u4").tobytes()


def insert(vector: bytes, paragraph: bytes) -> bytes:
    return combine(vector, expand(paragraph.strip(BLANK)))


def delete(vector: bytes, paragraph: bytes) -> bytes:
    return (np.frombuffer(vector, ">u4") - np.frombuffer(expand(paragraph.strip(BLANK)), ">u4")).astype(">u4").tobytes()


def digest(vector: bytes) -> str:
    return hashlib.sha256(vector).hexdigest()[:32]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: paragraphs, summed vector, and a short digest of it; one pass without a shuffle."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts, vectors, digests = [], [], []
        col = b.column(TEXT)
        for data in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()):
            data = data.as_py()
            if data is None:
                counts.append(0), vectors.append(None), digests.append(None)
                continue
            parts = paragraphs(data)
            total = np.zeros(LANES, ">u4")
            for i in range(0, len(parts), 4096):
                total += np.frombuffer(b"".join(map(expand, parts[i : i + 4096])), ">u4").reshape(-1, LANES).sum(axis=0, dtype=np.uint32).astype(">u4")
            counts.append(len(parts)), vectors.append(v := total.tobytes()), digests.append(digest(v))
        return pa.RecordBatch.from_arrays([b.column(ID), pa.array(counts, pa.int32()), pa.array(vectors, pa.binary()), pa.array(digests, pa.string())], ["doc_id", "n_paragraphs", "vector", "digest"])

    return map_arrow(keyed(docs, id_col, text_col).drop("_key"), run, SCHEMA)


def merge(fps: DataFrame, *by: str) -> DataFrame:
    """Fingerprints of unions: ``(by..., n_paragraphs, vector, digest)``, such as of a whole source.

    Vectors add up, so partial sums are made before the shuffle; null vectors count as nothing.
    """
    from pyspark.sql import functions as F

    part = fps.where("vector is not null").select(*by, "n_paragraphs", "vector")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema if f.name in by)
    schema = f"{fields}, n_paragraphs long, vector binary"

    def add(pdf):
        total = np.zeros(LANES, ">u4")
        for v in pdf["vector"]:
            total += np.frombuffer(v, ">u4")
        return pdf[list(by)].iloc[:1].assign(n_paragraphs=int(pdf["n_paragraphs"].sum()), vector=[total.tobytes()])

    def partial(frames):
        for pdf in frames:
            for _, g in pdf.groupby(list(by), dropna=False, sort=False):
                yield add(g)

    sums = part.mapInPandas(partial, schema).groupBy(*by).applyInPandas(add, schema)
    return sums.withColumn("digest", F.substring(F.sha2("vector", 256), 1, 32))
