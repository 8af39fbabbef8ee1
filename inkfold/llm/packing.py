"""Conflict-constrained best-fit packing of documents into sequences of fixed capacity, in tokens.

A document's size is its number of byte-BPE tokens (or a column of one's own).  Documents are cut into pieces of at most CAPACITY.
Pieces go, in decreasing size, to the open bin of least sufficient residual that is compatible: no two pieces of a bin share a source
or a duplicate cluster.  Open bins are ordered by residual; each carries a bitmap of its sources and one of its duplicate clusters.
The search steps from the least sufficient residual to its successors until a compatible bin is found, so the result is the tightest
compatible bin, not the tightest that happens to fit.  Per residual the sources that all its bins hold are kept, and bins of equal
bitmaps lie together, so that a hot source or cluster skips residuals and bins without room for it; the skips leave out no
compatible bin.

Duplicate clusters are groups of near copies by SimHash (simhash.near_groups) within CLUSTER_K bits, unless a column is given.

Scale: only (id, hash, size, source, cluster) is shuffled.  Best fit is sequential by nature, so documents are dealt by hash to groups
of about ``group_items``, each packed by itself; a group's bins depend on its rows alone, not on the layout of the input.  Rows are
packed together with about that many others at every size of the table; the README has what that costs in bins.

Defined results: null and empty texts take no room and come with a null bin; a null source conflicts with nothing, nor does a null in a
column of clusters; documents without words are a cluster by their text, so that repeated rows and copies are always in different
bins; pieces of equal size go by id, text hash and offset; of compatible bins of equal residual the one opened first is taken.  A text
above the capacity, however long, fills whole bins and its rest is packed; its pieces share a cluster, so no bin has two of them.  An
empty table gives no rows.  Other columns are of no account; of repeated names the first column is meant.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec
from .common import ID, KEY, TEXT, by_place, place_of, table
from .simhash import near_groups

CAPACITY = 4096
GROUP_ITEMS = 100_000
CLUSTER_K = 17
SCHEMA = "bin_id long, slot int, doc_id long, piece int, start long, n_tokens int"


class Bins:
    """Open bins by residual; ``place`` is one best-fit step."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.residual: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.levels: dict[int, dict[tuple[int, int], list[int]]] = {}  # residual -> (source bitmap, cluster bitmap) -> heap of bins
        self.common: dict[int, int] = {}  # residual -> sources that each of its bins holds
        self.occupied = 0  # bitmap of residuals
        self.blocked: dict[int, int] = {}  # source -> bitmap of residuals with no bin for it

    def _block(self, level: int, old: int, new: int) -> None:
        changed, bit = old ^ new, 1 << level
        while changed:
            s = changed & -changed
            self.blocked[s] = self.blocked.get(s, 0) ^ bit
            changed ^= s

    def _add(self, b: int) -> None:
        level, mask = self.residual[b], self.sources[b]
        if level == 0:
            return
        key = (mask, self.clusters[b])
        at = self.levels.get(level)
        if at is None:
            self.levels[level] = {key: [b]}
            self.occupied |= 1 << level
            self.common[level] = mask
            self._block(level, 0, mask)
        elif key in at:
            heapq.heappush(at[key], b)
        else:
            at[key] = [b]
            old = self.common[level]
            self.common[level] = old & mask
            self._block(level, old, old & mask)

    def _remove(self, b: int) -> None:
        """Takes out a bin that is the first of its heap."""
        level, key = self.residual[b], (self.sources[b], self.clusters[b])
        at = self.levels[level]
        heapq.heappop(at[key])
        if at[key]:
            return
        del at[key]
        old, new = self.common[level], 0
        if at:
            new = -1
            for m, _ in at:
                new &= m
                if new == old:
                    break  # the others hold what all held, so no less is left
            self.common[level] = new
        else:
            del self.levels[level], self.common[level]
            self.occupied ^= 1 << level
        self._block(level, old, new)

    def place(self, size: int, source: int, cluster: int) -> int:
        """The bin for a piece; ``source`` and ``cluster`` are single bits, or 0."""
        free = (self.occupied & ~self.blocked.get(source, 0)) >> size
        while free:
            level = size + (free & -free).bit_length() - 1
            best = min((bins[0] for (mask, held), bins in self.levels[level].items() if not mask & source and not held & cluster), default=-1)
            if best >= 0:
                self._remove(best)
                self.residual[best] -= size
                self.sources[best] |= source
                self.clusters[best] |= cluster
                self._add(best)
                return best
            free &= free - 1
        self.residual.append(self.capacity - size)
        self.sources.append(source)
        self.clusters.append(cluster)
        self._add(len(self.residual) - 1)
        return len(self.residual) - 1


def bits(values: np.ndarray, null: np.ndarray) -> list[int]:
    """A bit for each value that occurs more than once, 0 for others and nulls, which can't conflict."""
    _, at, counts = np.unique(values, return_inverse=True, return_counts=True)
    ok = (counts[at] > 1) & ~null
    _, local = np.unique(at[ok], return_inverse=True)
    out, bit = [0] * len(values), [1 << k for k in range(int(local.max()) + 1)] if len(local) else []
    for i, k in zip(np.flatnonzero(ok).tolist(), local.tolist(), strict=True):
        out[i] = bit[k]
    return out


def _sized(own: DataFrame, vocab: str | None) -> DataFrame:
    """TEXT, the first column, replaced by its number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab)
        for b in batches:
            sizes = pa.array([None if x is None else c.count(x) for x in b.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([sizes, *b.columns[1:]], ["size", *b.schema.names[1:]])

    rest = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[1:])
    return own.mapInArrow(run, f"size long, {rest}")


def pack(docs: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", cluster_col: str | None = None, size_col: str | None = None, cluster_k: int = CLUSTER_K, vocab: str | None = None) -> DataFrame:
    """A row for each piece: its bin, its slot there, and the tokens ``start .. start + n_tokens`` of the document."""
    placed = by_place(docs)
    col = lambda name: placed[place_of(docs, name)]
    source = col(source_col).cast("string") if source_col else F.lit(None).cast("string")
    cluster = col(cluster_col).cast("string") if cluster_col else F.lit(None).cast("string")
    rest = [
        col(id_col).cast("long").alias(ID),
        F.xxhash64(col(text_col)).alias(KEY),
        source.isNull().alias("no_source"),
        F.xxhash64(source).alias("source"),
        cluster.isNull().alias("no_cluster"),
        F.xxhash64(cluster).alias("cluster"),
    ]
    if size_col:
        own = placed.select(col(size_col).cast("long").alias("size"), *rest)
    else:
        own = _sized(placed.select(col(text_col).alias(TEXT), *rest), vocab)
    items = table(own, "items")
    todo = items.where("size > 0")
    if not cluster_col:
        near = near_groups(docs, cluster_k, id_col=id_col, text_col=text_col).where("group_rows > 1").select(F.col(ID).alias("n_id"), F.col(KEY).alias("n_key"), F.xxhash64("rep_id", "rep_key").alias("near"))
        joined = todo.join(near, todo[ID].eqNullSafe(near["n_id"]) & (todo[KEY] == near["n_key"]), "left")
        todo = joined.select("size", ID, KEY, "no_source", "source", F.lit(False).alias("no_cluster"), F.coalesce("near", KEY).alias("cluster"))
    groups = max(1, -(-items.where("size > 0").count() // group_items))
    dealt = todo.withColumn("g", F.pmod(F.xxhash64(ID, KEY), F.lit(groups)).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        c = {n: t.column(n).to_numpy(zero_copy_only=False) for n in (KEY, "size", "source", "no_source", "cluster", "no_cluster", "g")}
        ids, size = t.column(ID), c["size"].astype(np.int64)
        null_id = np.asarray(ids.is_null())
        id_value = np.asarray(ids.fill_null(0))
        n = -(-size // capacity)
        row = np.repeat(np.arange(len(size)), n)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        length = np.minimum(capacity, size[row] - piece * capacity)
        order = np.lexsort((piece, c[KEY][row], id_value[row], null_id[row], -length))
        row, piece, length = row[order], piece[order], length[order]
        s, d = bits(c["source"][row], c["no_source"][row]), bits(c["cluster"][row], c["no_cluster"][row])
        bins = Bins(capacity)
        at = np.fromiter(map(bins.place, length.tolist(), s, d), np.int64, len(row))
        by_bin = np.argsort(at, kind="stable")
        slot = np.empty(len(row), np.int64)
        filled = np.bincount(at, minlength=len(bins.residual)) if len(row) else np.zeros(0, np.int64)
        slot[by_bin] = np.arange(len(row)) - np.repeat(np.cumsum(filled) - filled, filled)
        return pa.table({"bin_id": (c["g"][0].astype(np.int64) << 32) + at, "slot": slot.astype(np.int32), "doc_id": ids.take(pa.array(row)), "piece": piece.astype(np.int32), "start": piece * capacity, "n_tokens": length.astype(np.int32)})

    packed = dealt.groupBy("g").applyInArrow(run, SCHEMA)
    none = items.where("size is null or size <= 0").select(F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("slot"), F.col(ID).alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).alias("n_tokens"))
    return packed.unionByName(none)
