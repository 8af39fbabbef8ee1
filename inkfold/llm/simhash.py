"""SimHash near-duplicates by anchor-point covering.

Fingerprint: BLOCKS blocks of 23 bits of a SimHash over the distinct words of a text.  Two texts are near-duplicates if their
fingerprints differ in at most K bits; a group is a connected component of that relation.

Anchors: the words of the perfect binary Golay code, of length 23, dimension 12 and covering radius R = 3: every 23-bit word is
within 3 of exactly one anchor.  Block b has an even threshold t_b, and the sum of all t_b + 1 is above K: fingerprints that differ
in more than t_b bits in every block differ in more than K.  So two that differ in at most K bits have a block with at most t_b.
Halfway between the two block words lies a word within t_b / 2 of both, and its anchor is within R + t_b / 2 of both.  A fingerprint
is replicated, for each block, to every anchor within that radius, and all that meet at an anchor are compared, first in the block:
pairs that differ there in at most t_b bits are compared over all bits.  No pair is missed.

K is chosen by recall of near copies (Jaccard of word sets from 0.8), not by cost; the README has the figures.

Cost: 5.3 anchors on average lie within 4 of a word and 21.8 within 5; for K = 23 three blocks need either, so a fingerprint has 81
replicas whatever the table; equal fingerprints are folded to one before.  Where a group of n copies meets, each pivot is compared
with those not reached yet.  Comparisons of unrelated fingerprints at an anchor grow with the square of the table, over
4096 * BLOCKS anchors: the price of finding all pairs at 17 % of the bits.  At anchors of more than MANY rows only those are compared
that have a word halfway between them (link_by_halves), a twelfth of all pairs at thresholds of 4 and a hundredth at 2.  A smaller K needs fewer replicas: below BLOCKS the
radius is R and a word has one anchor.

Defined results: null and empty texts and texts without a word belong to no group and stay; equal texts and repeated rows are one
group, of which the row with the least (doc_id, text hash), null ids last, stays, once; of rows that repeat both the first by all
columns, as JSON.  A text of any length is one fingerprint, of all its words.  An empty table has no groups.  Other columns can have
any names, repeated ones too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, KEY, TEXT, as_long, by_place, keyed, map_arrow, mix, place_of, ranges, row_order, row_struct, slices, strings, table, whole, words
from .components import components

BLOCKS = 6
K = 23
BITS = 23
RADIUS = 3
#: rows at an anchor beyond which they are compared by words halfway; rows of such words compared at once
MANY, BATCH = 2000, 1 << 16
_MASK = np.uint64(0x0001000100010001)
_PER_WORD = 48  # bits used of each 64-bit hash: lanes s, s+16, s+32, s+48 for 12 shifts


# anchors
def golay() -> np.ndarray:
    """The 4096 words of the binary Golay code [23, 12], as multiples of its generator polynomial."""
    g = 0b101011100011
    base = np.array([g << i for i in range(12)], np.int64)
    msgs = np.arange(4096)
    out = np.zeros(4096, np.int64)
    for i in range(12):
        out ^= np.where(msgs >> i & 1, base[i], 0)
    return out


def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """The coset leader of each syndrome (2048), and the bits' syndromes."""
    g = 0b101011100011

    def rem(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= g << (i - 11)
        return x

    unit = np.array([rem(1 << i) for i in range(BITS)], np.int64)
    leader = np.zeros(2048, np.int64)
    for a in range(BITS):
        leader[unit[a]] = 1 << a
        for b in range(a):
            leader[unit[a] ^ unit[b]] = 1 << a | 1 << b
            for c in range(b):
                leader[unit[a] ^ unit[b] ^ unit[c]] = 1 << a | 1 << b | 1 << c
    return leader, unit


class Cover:
    """Anchors within a radius of any 23-bit word: its coset's light vectors, added to the word."""

    def __init__(self, radius: int) -> None:
        self.leader, self.unit = _syndromes()
        code = golay()
        weight_of = np.array([bin(x).count("1") for x in range(1 << 12)])
        weigh = lambda v: weight_of[v & 4095] + weight_of[v >> 12]
        near, counts = [], []
        for s in range(2048):
            v = code ^ self.leader[s]
            v = v[weigh(v) <= radius]
            near.append(v), counts.append(len(v))
        self.counts = np.array(counts)
        self.begin = np.concatenate([[0], np.cumsum(self.counts)])[:-1]
        self.near = np.concatenate(near)
        self.index = np.full(1 << BITS, -1, np.int16)
        self.index[code] = np.arange(4096)
        # syndromes of bytes, to look words up
        self.low = np.array([self._syn(x) for x in range(1 << 12)])
        self.high = np.array([self._syn(x << 12) for x in range(1 << 11)])

    def _syn(self, x: int) -> int:
        s = 0
        for i in range(BITS):
            if x >> i & 1:
                s ^= int(self.unit[i])
        return s

    def anchors(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor number) for all anchors within the radius of each word."""
        s = self.low[w & 4095] ^ self.high[w >> 12]
        n = self.counts[s]
        row = np.repeat(np.arange(len(w)), n)
        v = self.near[np.repeat(self.begin[s], n) + ranges(n)]
        return row, self.index[v ^ w[row]].astype(np.int64)


_covers: dict[int, Cover] = {}


def cover(radius: int) -> Cover:
    if radius not in _covers:
        _covers[radius] = Cover(radius)
    return _covers[radius]


def radii(k: int, blocks: int) -> list[int]:
    """The radius of each block; the thresholds t = 2 * (radius - RADIUS) are as even as sum(t + 1) > k allows."""
    halves = -(-max(0, k + 1 - blocks) // 2)
    return [RADIUS + halves // blocks + (b < halves % blocks) for b in range(blocks)]


# fingerprints
def fingerprint(data: np.ndarray, offs: np.ndarray, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """(rows x blocks matrix of 23-bit words, whether the row has words) of consecutive texts; each distinct word has one vote."""
    n, need = len(offs) - 1, blocks * BITS
    n_words = -(-need // _PER_WORD)
    out, has = np.zeros((n, blocks), np.int64), np.zeros(n, bool)
    for i, j in slices(offs):
        buf, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        if not len(buf):
            continue
        _, _, h, first = words(buf, o)
        row = np.repeat(np.arange(j - i), np.diff(first))
        if not len(row):
            continue
        # distinct words of each row: sorting by a hash that leads with the row
        order = np.argsort(((row.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))))
        row, h = row[order], h[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        row, h = row[new], h[new]
        at = np.flatnonzero(np.diff(row, prepend=-1))
        own, total = row[at], np.diff(np.append(at, len(row)))
        votes = np.empty((len(own), n_words * _PER_WORD), np.int64)
        for w in range(n_words):
            x = h if w == 0 else mix(h + np.uint64(0x9E3779B97F4A7C15 * w % (1 << 64)))
            for s in range(12):
                # four counters of 16 bits in a word; longer runs than that are added up in parts
                lanes = (x >> np.uint64(s)) & _MASK
                sums = np.add.reduceat(lanes, at) if total.max() < 65536 else None
                for k in range(4):
                    c = w * _PER_WORD + s * 4 + k
                    part = (sums >> np.uint64(16 * k)) & np.uint64(0xFFFF) if sums is not None else np.add.reduceat((lanes >> np.uint64(16 * k)) & np.uint64(1), at)
                    votes[:, c] = part
        one = votes[:, :need] * 2 > total[:, None]
        for b in range(blocks):
            out[i + own, b] = one[:, b * BITS : (b + 1) * BITS] @ (1 << np.arange(BITS))
        has[i + own] = True
    return out, has


def to_longs(fp: np.ndarray) -> list[np.ndarray]:
    """Two blocks in each 64-bit integer."""
    return [fp[:, b] | (fp[:, b + 1] << BITS if b + 1 < fp.shape[1] else 0) for b in range(0, fp.shape[1], 2)]


# comparison
def link(fps: np.ndarray, k: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of rows of ``fps`` (longs) that differ in at most k bits.

    Rows are taken off a list of the unvisited: each pivot is compared with all that no pivot has reached yet; what it reaches is
    a pivot in turn.  Each row is reached once, so this is a breadth-first search of the graph whose edges it never stores.
    """
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            p = queue.pop()
            d = np.bitwise_count(fps[left] ^ fps[p]).sum(axis=1)
            hit = d <= k
            if hit.any():
                got = left[hit]
                out.extend((p, int(x)) for x in got)
                queue.extend(got.tolist())
                left = left[~hit]
    return out


def halfway(words_: np.ndarray, code: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, word) of all words within ``reach`` of each row's and nearest to the anchor ``code``, relative to it."""
    bits = [0, *(1 << a for a in range(BITS))]
    near = np.zeros(1, np.uint32)
    for _ in range(reach):
        near = np.unique(near[:, None] ^ np.array(bits, np.uint32))
    rows, mids = [], []
    for i in range(0, len(words_), 4096):
        m = (words_[i : i + 4096] ^ np.uint32(code))[:, None] ^ near
        row, at = np.nonzero(np.bitwise_count(m) <= RADIUS)
        rows.append(row + i), mids.append(m[row, at])
    return np.concatenate(rows), np.concatenate(mids)


def link_by_halves(fps: np.ndarray, k: int, words_: np.ndarray, t: int, code: int, column: int) -> list[tuple[int, int]]:
    """Links of the rows at the anchor within k bits that have a word halfway between them, of those nearest to this anchor.

    Such a word is within t / 2 of both block words, and each word is nearest to one anchor: what isn't found here, as the word
    halfway belongs to another anchor, is found there.  ``column`` of ``fps`` has the anchor's block and is looked at last.
    """
    touched, pairs, room = np.zeros(len(fps), bool), [], 32 * len(fps)
    row, mid = halfway(words_, code, t // 2)
    order = np.argsort(mid, kind="stable")
    row, mid = row[order], mid[order]
    group = np.cumsum(np.diff(mid.astype(np.int64), prepend=-1) != 0) - 1
    size = np.bincount(group)
    keep = size[group] > 1
    row, group = row[keep], group[keep]
    order = np.lexsort((group, -size[group]))
    row, group = row[order], group[order]
    size = size[group]
    cut = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
    others = [c for c in range(fps.shape[1]) if c != column] or [column]
    i = 0
    while i < len(row):  # whole groups of falling size, about BATCH rows at once
        j = int(cut[max(np.searchsorted(cut, i, side="right"), np.searchsorted(cut, i + BATCH, side="right") - 1)])
        r, g, n = row[i:j], group[i:j], size[i:j]
        own = [np.ascontiguousarray(fps[r, c]) for c in others]
        falling = -n
        for s in range(1, int(n[0])):  # each row with the s-th after it, of groups larger than s
            p = int(np.searchsorted(falling, -s, side="left"))
            d = np.bitwise_count(own[0][: p - s] ^ own[0][s:p])
            for x in own[1:]:
                d += np.bitwise_count(x[: p - s] ^ x[s:p])
            a = np.flatnonzero(d <= k)
            a = a[g[a] == g[a + s]]
            if len(a):
                a = a[np.bitwise_count(fps[r[a]] ^ fps[r[a + s]]).sum(axis=1) <= k]
                touched[r[a]] = True
                touched[r[a + s]] = True
                if room >= 0:
                    room -= len(a)
                    pairs.append(np.minimum(r[a], r[a + s]) * len(fps) + np.maximum(r[a], r[a + s]))
        i = j
    if room >= 0:
        own = np.sort(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        own = own[np.diff(own, prepend=-1) != 0]
        if len(own) <= 2 * np.count_nonzero(touched):
            return [divmod(x, len(fps)) for x in own.tolist()]
    rows = np.flatnonzero(touched)  # groups of many, of whose pairs a forest is enough
    return [(int(rows[a]), int(rows[b])) for a, b in link(fps[rows], k)]


def link_anchor(fps: np.ndarray, k: int, words_: np.ndarray, t: int, code: int, column: int) -> list[tuple[int, int]]:
    """The same for the rows at one anchor: most rows have no partner at all.

    ``words_`` are the rows' words of the anchor's block, and only pairs that differ there in at most ``t`` bits, the block's
    threshold, are judged by all bits: any other pair within k bits meets at an anchor of a block where it does.  Up to MANY rows
    by blocks of a matrix of differences, more by the words halfway between them.
    """
    n = len(fps)
    if n < 2:
        return []
    if n > MANY:
        return link_by_halves(fps, k, words_, t, code, column)
    step = max(1, (1 << 18) // n)
    touched = np.zeros(n, bool)
    for i in range(0, n, step):
        d = np.bitwise_count(words_[i : i + step, None] ^ words_[None, i:])
        a, b = np.divmod(np.flatnonzero(d <= t), n - i)
        ok = b > a
        a, b = a[ok] + i, b[ok] + i
        total = np.zeros(len(a), np.int64)
        for c in range(fps.shape[1]):
            total += np.bitwise_count(fps[a, c] ^ fps[b, c])
        hit = total <= k
        touched[a[hit]] = True
        touched[b[hit]] = True
    rows = np.flatnonzero(touched)
    return [(int(rows[a]), int(rows[b])) for a, b in link(fps[rows], k)]


def near_groups(docs: DataFrame, k: int = K, blocks: int = BLOCKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ID, KEY, fp, rep_id, rep_key, n_rows): the group of each distinct (id, text) that has words, by its representative."""
    longs = -(-blocks // 2)
    cols = [f"f{i}" for i in range(longs)]
    radius = radii(k, blocks)

    def prints(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offs, _ = strings(b.column(TEXT))
        fp, has = fingerprint(data, offs, blocks)
        return pa.RecordBatch.from_arrays([b.column(ID), b.column(KEY), *map(as_long, to_longs(fp))], [ID, KEY, *cols]).filter(pa.array(has))

    fields = ", ".join(f"{c} long" for c in cols)
    own = table(map_arrow(keyed(docs, id_col, text_col), prints, f"{ID} long, {KEY} long, {fields}"), "simhash")
    # equal fingerprints are one node, named by a hash; a clash of hashes would need two of 2**64
    node = F.xxhash64(*cols).alias("node")
    distinct = own.groupBy(*cols).agg(F.count("*").alias("n")).select(*cols, node)

    def replicate(b: pa.RecordBatch) -> pa.RecordBatch:
        f = [b.column(x).to_numpy() for x in cols]
        n = np.asarray(b.column("node"))
        rows, keys = [], []
        for j in range(blocks):
            w = (f[j // 2] >> (BITS * (j % 2))) & ((1 << BITS) - 1)
            row, anchor = cover(radius[j]).anchors(w)
            rows.append(row), keys.append(anchor * blocks + j)
        at = np.concatenate(rows)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int32)), pa.array(n[at]), *(pa.array(x[at]) for x in f)], ["anchor", "node", *cols])

    def meet(batches):
        t = whole(batches)
        if t is None:
            return
        anchor = t.column("anchor").to_numpy()
        order = np.argsort(anchor, kind="stable")
        anchor, n = anchor[order], t.column("node").to_numpy()[order]
        f = np.stack([t.column(x).to_numpy()[order] for x in cols], axis=1)
        cut = np.append(np.flatnonzero(np.diff(anchor, prepend=-1)), len(anchor))
        u, v, codes = [], [], golay()
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            j = int(anchor[a]) % blocks
            own_words = ((f[a:b, j // 2] >> (BITS * (j % 2))) & ((1 << BITS) - 1)).astype(np.uint32)
            for x, y in link_anchor(f[a:b], k, own_words, 2 * (radius[j] - RADIUS), int(codes[anchor[a] // blocks]), j // 2):
                u.append(n[a + x]), v.append(n[a + y])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    copies = map_arrow(distinct, replicate, f"anchor int, node long, {fields}")
    edges = copies.repartition("anchor").mapInArrow(meet, "u long, v long")
    root = components(edges, "simhash-edges")
    grouped = own.select(ID, KEY, node).join(root, "node", "left").select(ID, KEY, F.coalesce("root", "node").alias("group"))
    order = F.struct(F.col(ID).isNull().alias("z"), F.col(ID).alias("i"), F.col(KEY).alias("k"))
    each = grouped.groupBy(ID, KEY, "group").agg(F.count("*").alias("n_rows"))
    first = each.groupBy("group").agg(F.min(order).alias("first"), F.sum("n_rows").alias("group_rows"))
    return each.join(first, "group").select(ID, KEY, F.col("first.i").alias("rep_id"), F.col("first.k").alias("rep_key"), "n_rows", "group_rows")


def near_duplicates(docs: DataFrame, k: int = K, blocks: int = BLOCKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document in a group of two rows or more: ``(doc_id, group_id, group_rows, keep)``.

    ``group_id`` is the id of the document that stays.  Rows that repeat id and text are one row here, with their number in
    ``n_rows``; one of them stays if ``keep``.
    """
    g = near_groups(docs, k, blocks, id_col, text_col).where("group_rows > 1")
    return g.select(F.col(ID).alias("doc_id"), F.col("rep_id").alias("group_id"), "n_rows", "group_rows", (F.col(ID).eqNullSafe(F.col("rep_id")) & (F.col(KEY) == F.col("rep_key"))).alias("keep"))


def near_dedup(docs: DataFrame, k: int = K, blocks: int = BLOCKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of which one of each group stays."""
    groups = table(near_groups(docs, k, blocks, id_col, text_col), "simhash-groups")
    first = F.col(ID).eqNullSafe(F.col("rep_id")) & (F.col(KEY) == F.col("rep_key"))
    placed = by_place(docs)
    own = placed.select(row_struct(placed), row_order(placed).alias("order"), placed[place_of(docs, id_col)].cast("long").alias(ID), F.xxhash64(placed[place_of(docs, text_col)]).alias(KEY))
    gone = groups.where(~first).select(F.col(ID).alias("gone_id"), F.col(KEY).alias("gone_key"))
    kept = own.join(gone, own[ID].eqNullSafe(gone["gone_id"]) & (own[KEY] == gone["gone_key"]), "left_anti")
    again = groups.where(first & (F.col("n_rows") > 1)).select(F.col(ID).alias("again_id"), F.col(KEY).alias("again_key"))
    if again.limit(1).count():  # rows that repeat id and text: the first by all columns stays
        same = own[ID].eqNullSafe(again["again_id"]) & (own[KEY] == again["again_key"])
        once = kept.join(again, same, "left_semi").groupBy(ID, KEY).agg(F.min_by("row", "order").alias("row")).select("row")
        kept = kept.join(again, same, "left_anti").select("row").unionByName(once)
    return kept.select("row.*").toDF(*docs.columns)
