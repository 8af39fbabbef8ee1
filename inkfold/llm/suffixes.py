"""Suffix-array dedup: passages of at least MIN_WORDS words that occur more than once.

A passage is repeated if its MIN_WORDS words occur at another place, in the same or another document; overlapping repeated passages
of a document are one span.  Words are runs of letters, numbers and marks, case folded; characters of scripts without spaces are words.

Distribution.  A window is a place with MIN_WORDS words from it on.  Equal windows contain the same least k-gram (by hash, leftmost),
so windows are dealt by that k-gram: consecutive windows of a document with one least k-gram form a stretch, sent as a whole.
Equal stretches are folded to one by a pre-aggregated count; those that occur more than once are repeated all over.  Stretches
that share their k-gram with a different one are compared by suffix sorting.

Suffix sorting by threshold-bounded interval expansion.  The stretches of many k-grams are one text with a separator of its own after
each.  Its suffixes are sorted by prefix doubling up to the threshold, which gives the Burrows-Wheeler transform.  Starting with the
interval of the empty string, intervals are extended backward by one symbol, breadth first, all intervals of a level at once.  An
extension of length l + 1 whose right border has no value yet sets the common prefix there to l and is kept for the next level.  Values
come in increasing order, and expansion stops at the threshold: borders without a value have common prefixes of at least MIN_WORDS.

Defined results: null texts and texts shorter than MIN_WORDS words have no spans; repeated rows, which are copies of each other, give
the spans of one row; null ids are a value like any other; texts of any length are compared whole; an empty table has no spans.  Words
are compared by 64-bit hashes.  Other columns, whatever their names, are of no account.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _INV, _ODD, ID, KEY, TEXT, _power, as_long, keyed, mix, ranges, slices, strings, table, whole, words

MIN_WORDS = 50
K_GRAM = 8
BROADCAST_STRETCHES = 2_000_000
CHUNK_WORDS = 400_000
POS_BITS = np.uint64(24)


def stretches(buf: np.ndarray, offs: np.ndarray, min_words: int = MIN_WORDS, k: int = K_GRAM):
    """(row, first window, windows, k-gram hash, content hash, first word in h, h) of the stretches of consecutive texts."""
    _, _, h, first = words(buf, offs)
    n = len(h)
    counts = np.diff(first)
    k = min(k, min_words)
    none = np.zeros(0, np.int64)
    if n < min_words:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none, h
    grams = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        grams = mix(grams + h[j : n - k + 1 + j])
    low = np.uint64((1 << int(POS_BITS)) - 1)
    least = (grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
    width, have = min_words - k + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    at = np.arange(len(least))
    pos = at + (((least & low).astype(np.int64) - at) & int(low))
    row = np.repeat(np.arange(len(counts)), counts)[: len(least)]
    valid = at + min_words <= first[row + 1]
    at, pos, row = at[valid], pos[valid], row[valid]
    if not len(at):
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none, h
    head = np.ones(len(at), bool)
    head[1:] = (pos[1:] != pos[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(head)
    n_win = np.diff(np.append(begin, len(at)))
    start = at[begin]
    stop = start + n_win + min_words - 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * _power(_ODD, n), out=total[1:])
    content = mix((total[stop] - total[start]) * _power(_INV, n + 1)[start] + n_win.astype(np.uint64))
    return row[begin], start - first[row[begin]], n_win, grams[pos[begin]], content, start, h


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by at least their first ``depth`` symbols (prefix doubling)."""
    n = len(text)
    rank = text.astype(np.int64) + 1
    have = 1
    while True:
        key = np.zeros(n, np.int64)
        key[: n - have] = rank[have:]
        key += rank * (n + 2)
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = np.diff(key[order]) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        have *= 2
        if have >= depth or rank[order[-1]] == n:
            return order


def bounded_lcp(text: np.ndarray, order: np.ndarray, bound: int) -> np.ndarray:
    """Common prefix of each sorted suffix with the one before it; ``bound`` where it is that long or longer.

    ``text`` ends with a symbol that occurs nowhere else.
    """
    n = len(text)
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    back = where[order - 1]  # LF: from a suffix to the one that begins one symbol earlier (cyclically)
    symbol = text[order - 1]
    lcp = np.full(n + 1, bound, np.int32)
    is_set = np.zeros(n + 1, bool)
    lb, rb = np.zeros(1, np.int64), np.array([n - 1], np.int64)
    for level in range(bound):
        if not len(lb):
            break
        size = rb - lb + 1
        i = np.repeat(lb, size) + ranges(size)
        own = np.repeat(np.arange(len(lb)), size)
        to, sym = back[i], symbol[i]
        sort = np.argsort(own * n + to)
        own, to, sym = own[sort], to[sort], sym[sort]
        last = np.ones(len(to), bool)
        last[:-1] = (own[1:] != own[:-1]) | (sym[1:] != sym[:-1])
        right = to[last]
        left = to[np.append(0, np.flatnonzero(last)[:-1] + 1)]
        fresh = ~is_set[right + 1]
        lb, rb = left[fresh], right[fresh]
        is_set[rb + 1] = True
        lcp[rb + 1] = level
    lcp[0] = 0
    return lcp[:n]


def repeated(parts: list[np.ndarray], min_words: int = MIN_WORDS) -> list[np.ndarray]:
    """For each part, which of its places begin a window that occurs elsewhere among the parts."""
    n = len(parts)
    if not n:
        return []
    lens = np.array([len(p) for p in parts])
    begin = np.cumsum(lens + 1) - lens - 1
    _, rank = np.unique(np.concatenate(parts), return_inverse=True)
    text = np.empty(int(lens.sum()) + n, np.int64)
    sep = begin + lens
    inner = np.ones(len(text), bool)
    inner[sep] = False
    text[inner] = rank + n
    text[sep] = np.arange(n)
    order = suffix_order(text, min_words)
    at = np.flatnonzero(bounded_lcp(text, order, min_words) >= min_words)
    flag = np.zeros(len(text), bool)
    flag[order[at]] = True
    flag[order[at - 1]] = True
    return [flag[b : b + m] for b, m in zip(begin.tolist(), lens.tolist(), strict=True)]


def stretch_table(docs: DataFrame, min_words: int) -> DataFrame:
    def run(batches):
        for b in batches:
            data, offs, _ = strings(b.column(TEXT))
            for i, j in slices(offs):
                row, first, n, gram, content, _, _ = stretches(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], min_words)
                at = pa.array(i + row)
                yield pa.RecordBatch.from_arrays([as_long(gram), as_long(content), b.column(ID).take(at), b.column(KEY).take(at), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], ["gram", "content", ID, KEY, "first", "n"])

    return table(docs.mapInArrow(run, f"gram long, content long, {ID} long, {KEY} long, first int, n int"), "stretches")


def _payloads(docs: DataFrame, all_: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """(content, words) of the wanted stretches, perhaps more than once."""
    small = wanted.count() <= BROADCAST_STRETCHES
    known = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.select("content").toArrow().column("content").to_numpy())) if small else None

    def run(batches):
        all_wanted, seen = known.value if known is not None else None, np.zeros(0, np.int64)
        for b in batches:
            data, offs, _ = strings(b.column(TEXT))
            for i, j in slices(offs):
                _, _, n, _, content, start, h = stretches(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], min_words)
                content = content.view(np.int64)
                _, at = np.unique(content, return_index=True)
                if all_wanted is not None:
                    if not len(all_wanted):
                        continue
                    place = np.minimum(np.searchsorted(all_wanted, content[at]), len(all_wanted) - 1)
                    at = at[all_wanted[place] == content[at]]
                at = at[~np.isin(content[at], seen)]
                seen = np.union1d(seen, content[at])
                lens = n[at] + min_words - 1
                flat = h[np.repeat(start[at], lens) + ranges(lens)]
                offs_b = pa.array(np.concatenate([[0], np.cumsum(lens * 8)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(content[at]), pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, offs_b.buffers()[1], pa.py_buffer(flat.tobytes())])], ["content", "words"])

    if small:
        return docs.mapInArrow(run, "content long, words binary")
    of = all_.join(wanted.select("content"), "content", "left_semi").select(F.col(ID).alias("w_id"), F.col(KEY).alias("w_key")).distinct()
    some = docs.join(of, docs[ID].eqNullSafe(of["w_id"]) & (docs[KEY] == of["w_key"]), "left_semi")
    return some.mapInArrow(run, "content long, words binary")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the spans of each document that repeated passages cover."""
    own = keyed(docs, id_col, text_col)
    all_ = stretch_table(own, min_words)
    counted = all_.groupBy("gram", "content").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    several = table(counted.withColumn("k", F.count("*").over(Window.partitionBy("gram"))).where("c > 1 or k > 1"), "stretch-counts")
    mixed = several.where("k > 1")

    def compare(batches):
        t = whole(batches)
        if t is None:
            return
        gram, content = t.column("gram").to_numpy(), t.column("content").to_numpy()
        order = np.lexsort((content, gram))
        new = np.ones(len(order), bool)
        new[1:] = np.diff(content[order]) != 0
        order = order[new]
        gram, content = gram[order], content[order]
        raw = t.column("words").cast(pa.large_binary()).combine_chunks().take(pa.array(order))
        size = np.array([len(x.as_buffer()) // 8 for x in raw])
        ends = np.append(np.flatnonzero(np.diff(gram)) + 1, len(gram))
        total = np.cumsum(size)
        a = 0
        while a < len(gram):
            want = (total[a - 1] if a else 0) + CHUNK_WORDS
            b = int(ends[min(len(ends) - 1, np.searchsorted(ends, max(a + 1, np.searchsorted(total, want))))])
            parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in raw[a:b]]
            out_c, out_s, out_e = [], [], []
            for c, flag in zip(content[a:b].tolist(), repeated(parts, min_words), strict=True):
                if flag.any():
                    d = np.diff(flag.astype(np.int8), prepend=0, append=0)
                    for s, e in zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist(), strict=True):
                        out_c.append(c), out_s.append(s), out_e.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(out_c, pa.int64()), pa.array(out_s, pa.int32()), pa.array(out_e, pa.int32())], ["content", "s", "e"])
            a = b

    payload = _payloads(own, all_, mixed, min_words).join(mixed.select("content", "gram"), "content")
    found = payload.select("gram", "content", "words").repartition("gram").mapInArrow(compare, "content long, s int, e int")
    part = found.join(several.where("c > 1").select("content"), "content", "left_anti")
    runs = several.where("c > 1").select("content", F.lit(0).alias("s"), F.col("n").alias("e")).unionByName(part)
    placed = all_.select("content", ID, KEY, "first").join(runs, "content").select(ID, KEY, (F.col("first") + F.col("s")).alias("s"), (F.col("first") + F.col("e") + (min_words - 1)).alias("e"))

    def merge(batches):
        t = whole(batches)
        if t is None:
            return
        ids, key, s, e = t.column(ID), t.column(KEY).to_numpy(), t.column("s").to_numpy().astype(np.int64), t.column("e").to_numpy().astype(np.int64)
        null, value = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
        order = np.lexsort((s, value, null, key))
        key, null, value, s, e = key[order], null[order], value[order], s[order], e[order]
        doc = np.cumsum(np.append(True, (np.diff(key) != 0) | (np.diff(value) != 0) | (null[1:] != null[:-1]))) - 1
        big = int(e.max()) + 2
        reach = np.maximum.accumulate(doc * big + e)
        head = np.append(True, (doc * big + s)[1:] > reach[:-1])
        at = np.flatnonzero(head)
        end = reach[np.append(at[1:], len(s)) - 1] - doc[at] * big
        yield pa.RecordBatch.from_arrays([pa.array(value[at], pa.int64(), mask=null[at]), pa.array(s[at].astype(np.int32)), pa.array(end.astype(np.int32)), pa.array((end - s[at]).astype(np.int32))], ["doc_id", "start_word", "end_word", "n_words"])

    return placed.repartition(ID, KEY).mapInArrow(merge, "doc_id long, start_word int, end_word int, n_words int")
