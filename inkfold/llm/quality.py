"""Quality rules by compression bands.

The zstandard ratio (compressed by raw bytes) of a whole document, and of each of its fixed chunks, has to lie in a band for its
length: below it text is repetitive, above it incompressible.  Short text compresses less, so limits depend on the length.

Defined results: null text is ``null`` and empty text ``empty``, both rejected; texts of any length are judged whole; a ratio that is
equal to a limit is in band; repeated rows get the same verdict each; null ids, other columns and their names, repeated ones too, are
of no account; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import ID, TEXT, keyed, map_arrow, map_rows

LEVEL = 3
CHUNK_BYTES = 1024
#: (bytes from, least ratio, greatest ratio) of whole documents
BANDS = (
    (1, 0.0, 9.0), (64, 0.45, 1.6), (128, 0.38, 1.05), (256, 0.34, 1.0), (512, 0.33, 0.92), (1024, 0.30, 0.86),
    (2048, 0.28, 0.82), (4096, 0.25, 0.8), (16384, 0.22, 0.8), (65536, 0.18, 0.8),
)
#: the same for chunks of CHUNK_BYTES; the last, shorter chunk is judged by its own length in BANDS
CHUNK_BAND = (0.28, 0.86)
#: greatest share of chunks out of band
CHUNK_SHARE = 0.25
SCHEMA = "doc_id long, n_bytes long, ratio double, n_chunks int, bad_chunks int, verdict string"


def band(n: int) -> tuple[float, float]:
    low, high = 0.0, 9.0
    for least, a, b in BANDS:
        if n >= least:
            low, high = a, b
    return low, high


def judge(data: bytes | None, squeeze: zstandard.ZstdCompressor) -> tuple[int, float | None, int, int, str]:
    """(bytes, ratio, chunks, chunks out of band, verdict)."""
    if data is None:
        return 0, None, 0, 0, "null"
    n = len(data)
    if n == 0:
        return 0, None, 0, 0, "empty"
    ratio = len(squeeze.compress(data)) / n
    chunks = bad = 0
    if n > CHUNK_BYTES:
        for i in range(0, n, CHUNK_BYTES):
            part = data[i : i + CHUNK_BYTES]
            low, high = CHUNK_BAND if len(part) == CHUNK_BYTES else band(len(part))
            chunks += 1
            bad += not low <= len(squeeze.compress(part)) / len(part) <= high
    low, high = band(n)
    if ratio < low:
        verdict = "repetitive"
    elif ratio > high:
        verdict = "incompressible"
    else:
        verdict = "chunks" if chunks and bad > CHUNK_SHARE * chunks else "keep"
    return n, ratio, chunks, bad, verdict


def compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)


def _verdicts(texts: pa.Array) -> list[tuple]:
    squeeze = compressor()
    return [judge(x, squeeze) for x in texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of figures and the verdict for each document, in one pass without a shuffle."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        v = list(zip(*_verdicts(b.column(TEXT)), strict=True))
        kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([b.column(ID).cast(pa.int64()), *(pa.array(x, k) for x, k in zip(v, kinds, strict=True))], ["doc_id", "n_bytes", "ratio", "n_chunks", "bad_chunks", "verdict"])

    return map_arrow(keyed(docs, id_col, text_col).drop("_key"), run, SCHEMA)


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose verdict is ``keep``."""
    at = docs.columns.index(text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array([v[-1] == "keep" for v in _verdicts(b.column(at))]))

    return map_rows(docs, run, docs.columns)
