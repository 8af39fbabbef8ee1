"""Helpers shared by the training-data operators.

Row identity
    A document row is identified by ``(doc_id, xxhash64(text))``.  Null ids are an ordinary value; rows that repeat both
    are copies of each other.  All internal frames carry only private column names, so that columns of the caller's
    table can have any name.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.session import settle as table  # noqa: F401
from ..sources.session import shared_dir  # noqa: F401

ID, KEY, TEXT = "_doc", "_key", "_text"
SLICE_BYTES = 1 << 18


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, text: bool = True) -> DataFrame:
    """(ID, KEY[, TEXT]) of each row; nothing else of the input can clash."""
    placed = by_place(docs)
    body = placed[place_of(docs, text_col)]
    cols = [placed[place_of(docs, id_col)].cast("long").alias(ID), F.xxhash64(body).alias(KEY)]
    return placed.select(*cols, body.alias(TEXT)) if text else placed.select(*cols)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes, offsets (one more than rows) and validity of an Arrow string column, without copying the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    if n == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), np.zeros(n, bool)
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    valid = np.ones(n, bool) if column.null_count == 0 else np.asarray(column.is_valid())
    return data, offs, valid


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer row is a range of its own."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, j
        i = j


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], names: list[str], drop_last: int = 0) -> DataFrame:
    """``fn`` over each Arrow batch of a table of any column names, repeated or quoted ones too; columns are known by place.

    ``fn`` returns all columns but the last ``drop_last``.
    """
    kinds = [f.dataType for f in df.schema.fields]
    schema = StructType([StructField(f"_c{i}", t) for i, t in enumerate(kinds[: len(kinds) - drop_last])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield fn(b)

    return df.toDF(*[f"_c{i}" for i in range(len(kinds))]).mapInArrow(run, schema).toDF(*names)


def by_place(docs: DataFrame) -> DataFrame:
    """The table with columns named by place, whatever their names, repeated ones too."""
    return docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])


def place_of(docs: DataFrame, name: str) -> str:
    """The name by_place gives a column; of repeated names the first column is meant."""
    return f"_c{docs.columns.index(name)}"


def row_struct(placed: DataFrame):
    """All columns of a table of by_place() as one, so that none can clash."""
    return F.struct(*placed.columns).alias("row")


def row_order(placed: DataFrame):
    """An order of rows by all their columns: rows that are equal in it are equal throughout."""
    return F.to_json(F.struct(*placed.columns), {"ignoreNullFields": "false"})


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All batches of one shuffle partition, whose size the shuffle bounds."""
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept) if kept else None


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (in a new array)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_ODD, _INV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 8), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 1 << 23:
            _powers[str(base)] = have
    return have[:n]


#: code points from here on are no letters that text is written in
LAST = 0x32400
SEPARATOR, WORD, SINGLE = 0, 1, 2
#: scripts written without spaces (kana, Han, Thai, Lao, Khmer, Myanmar): each of their characters is a word
_UNSPACED_RANGES = (
    (0x0E01, 0x0E5B), (0x0E81, 0x0EDF), (0x1000, 0x109F), (0x1780, 0x17F9), (0x19E0, 0x19FF), (0x2E80, 0x2FD5), (0x3005, 0x3007), (0x3021, 0x3029), (0x3038, 0x303B),
    (0x3041, 0x3096), (0x309D, 0x309F), (0x30A1, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FE), (0xAA60, 0xAA7F), (0xF900, 0xFAD9), (0xFF66, 0xFF9D),
    (0x1B000, 0x1B167), (0x20000, 0x323AF),
)
_tables: list[np.ndarray] = []


def _unicode() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower case) of each code point; lower case only where it takes as many bytes."""
    if not _tables:
        kind, low = np.zeros(LAST, np.uint8), np.arange(LAST, dtype=np.int32)
        for cp in range(LAST):
            ch = chr(cp)
            if unicodedata.category(ch)[0] in "LNM":
                kind[cp] = WORD
            to = ch.lower()
            if to != ch and len(to) == 1 and not 0xD800 <= cp < 0xE000 and len(to.encode()) == len(ch.encode()):
                low[cp] = ord(to)
        for a, b in _UNSPACED_RANGES:
            kind[a : b + 1] *= SINGLE  # what is a letter, number or mark there
        _tables.extend((kind, low))
    return _tables[0], _tables[1]


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, code point, bytes) of the characters beyond ASCII."""
    at = np.flatnonzero(buf >= 0xC2)
    if not len(at):
        return at, at, at
    pad = np.concatenate([buf, np.zeros(3, np.uint8)])
    first = pad[at].astype(np.int32)
    one, two, three = (pad[at + k].astype(np.int32) & 63 for k in (1, 2, 3))
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    cp = np.where(size == 2, (first & 31) << 6 | one, np.where(size == 3, (first & 15) << 12 | one << 6 | two, (first & 7) << 18 | one << 12 | two << 6 | three))
    return at, np.minimum(cp, LAST - 1), size


def _put(out: np.ndarray, at: np.ndarray, size: np.ndarray, values: np.ndarray) -> None:
    """The same value for all bytes of characters."""
    for k in range(4):
        m = (size > k) & (at + k < len(out))
        out[at[m] + k] = values[m]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII_WORD = np.zeros(256, np.uint8)
_ASCII_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = WORD


def fold_case(buf: np.ndarray) -> np.ndarray:
    """A lower-case copy of the same length, in all scripts."""
    low = _LOWER[buf]
    at, cp, size = code_points(buf)
    if len(at):
        to = _unicode()[1][cp]
        m = to != cp
        at, to, size = at[m], to[m], size[m]
        for n, lead in ((2, 0xC0), (3, 0xE0), (4, 0xF0)):
            p, c = at[size == n], to[size == n]
            low[p] = lead | c >> (6 * (n - 1))
            for k in range(1, n):
                low[p + k] = 0x80 | (c >> (6 * (n - 1 - k)) & 63)
    return low


def words(buf: np.ndarray, offs: np.ndarray, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of consecutive texts: start and end byte, 64-bit hash, and the number of the first word of each text.

    A word is a run of letters, numbers and marks of any script, case folded; a character of a script written without spaces is a
    word of its own.  ``offs`` starts at 0; ``low`` is fold_case(buf), if there is one already.
    """
    low = fold_case(buf) if low is None else low
    kind = _ASCII_WORD[low]
    at, cp, size = code_points(low)
    own = _unicode()[0][cp] if len(at) else at
    if len(at):
        _put(kind, at, size, own)
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = kind > 0
    step = np.diff(inside)
    cut = offs[1:-1]
    border = [cut[(cut > 0) & (cut < len(buf))]]  # a text ends and the next begins inside a run
    if len(at) and (own == SINGLE).any():
        m = own == SINGLE
        border += [at[m], (at + size)[m]]
    border = np.unique(np.concatenate(border))
    border = border[(border > 0) & (border < len(buf))]
    border = border[(inside[border] == 1) & (inside[border + 1] == 1)]
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(border):
        start, end = np.sort(np.concatenate([start, border])), np.sort(np.concatenate([end, border]))
    return start, end, span_hash(low, start, end), np.searchsorted(start, offs)


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from prefix sums of a polynomial modulo 2**64."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power(_ODD, len(buf)), out=total[1:])
    return mix((total[end] - total[start]) * _power(_INV, len(buf) + 1)[start] + (end - start).astype(np.uint64))


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, concatenated."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64, copy=False))


def data_dir_vocab() -> str:
    """Where the public vocabularies lie: ``INKFOLD_TOKENIZERS`` or /opt/tokenizers."""
    return os.environ.get("INKFOLD_TOKENIZERS", "/opt/tokenizers")
