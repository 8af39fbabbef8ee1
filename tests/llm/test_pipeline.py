"""corpus_pipeline.run() against a brute-force version of each stage, one document and one pair at a time."""

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard

import corpus_pipeline
from inkfold.llm import bpe, credentials, packing, simhash
from inkfold.llm.common import strings

from .common import DIR, HAVE, given, union_find
from .test_methods import brute_lines


def in_band(data, size):
    """The limits, written out again, on a ratio computed by itself."""
    limits = {1: (0.0, 9.0), 64: (0.45, 1.6), 128: (0.38, 1.05), 256: (0.34, 1.0), 512: (0.33, 0.92), 1024: (0.30, 0.86), 2048: (0.28, 0.82), 4096: (0.25, 0.8), 16384: (0.22, 0.8), 65536: (0.18, 0.8)}
    low, high = (0.28, 0.86) if size == "chunk" else limits[max(k for k in limits if k <= size)]
    z = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, write_checksum=False))
    return low <= len(z.compress(data)) / len(data) <= high


def brute_quality(docs):
    out = []
    for i, t, s in docs:
        raw = t.encode()
        parts = [raw[k : k + 1024] for k in range(0, len(raw), 1024)] if len(raw) > 1024 else []
        bad = sum(not in_band(p, "chunk" if len(p) == 1024 else len(p)) for p in parts)
        if raw and in_band(raw, len(raw)) and bad * 4 <= len(parts):
            out.append((i, t, s))
    return out


def brute_line_dedup(docs):
    gone = {x for g in brute_lines([(i, t) for i, t, _ in docs]) for x in g if x != min(g)}
    out = []
    for i, t, s in docs:
        own = t.split("\n")
        left = [x for n, x in enumerate(own) if (i, n) not in gone]
        if len(left) == len(own) or any(x.strip() for x in left):
            out.append((i, "\n".join(left), s))
    return out


def brute_near(docs):
    fp, has = simhash.fingerprint(*strings(pa.array([t for _, t, _ in docs]))[:2])
    find, link = union_find(len(docs))
    for a in range(len(docs)):
        for b in range(a):
            if has[a] and has[b] and sum(int(x ^ y).bit_count() for x, y in zip(fp[a], fp[b], strict=True)) <= simhash.K:
                link(a, b)
    best = {}
    for k, (i, _, _) in enumerate(docs):
        best[find(k)] = min(best.get(find(k), (i, k)), (i, k))
    kept = {k for _, k in best.values()}
    return [d for k, d in enumerate(docs) if k in kept]


def brute_redact(docs):
    formats = credentials.infer(credentials.labelled_examples())
    run = re.compile(r"[A-Za-z0-9_\-+/=.]+")

    def candidates(t):
        for m in run.finditer(t):
            x = m.group().rstrip(".")
            start = m.start() + len(x) - len(x.lstrip("."))
            if len(x.lstrip(".")) >= credentials.MIN_LENGTH:
                yield start, x.lstrip(".")

    counts = collections.Counter()
    sym = lambda b: b - 32 if 32 <= b < 127 else 95
    # characters as bytes: those of other scripts count one by one; texts of a table are read as one after another
    skip_pairs = collections.Counter()
    for _, t, _ in docs:
        raw, before = t.encode(), 95
        for b in raw:
            counts[before, sym(b)] += 1
            before = sym(b)
        for at, x in candidates(t):
            if re.search("[0-9]", x) and re.search("[A-Za-z]", x):
                prev = sym(t[at - 1].encode()[-1]) if at else 95
                for ch in x:
                    skip_pairs[prev, sym(ord(ch))] += 1
                    prev = sym(ord(ch))
    m = np.full((96, 96), 0.05)
    for (a, b), n in counts.items():
        m[a, b] += n - skip_pairs[a, b]
    ground = -np.log2(m / m.sum(axis=1, keepdims=True))
    out = []
    for i, t, s in docs:
        done, last = [], 0
        for at, x in candidates(t):
            plain, before = 0.0, 95
            for ch in x:
                plain += ground[before, sym(ord(ch))]
                before = sym(ord(ch))
            score, kind = max((plain - f.bits(x), k) for k, f in formats.items())
            assert abs(score - credentials.THRESHOLD_BITS) > 3  # nothing hangs on rounding
            if score >= credentials.THRESHOLD_BITS:
                done += [t[last:at], f"[SECRET:{kind}]"]
                last = at + len(x)
        out.append((i, "".join([*done, t[last:]]), s))
    return out


@pytest.mark.skipif(not HAVE, reason="no test tables")
def test_run(spark):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in given(spark).collect()]
    for step in (brute_quality, brute_line_dedup, brute_near, brute_redact):
        docs = step(docs)
    want = {i: (t, s) for i, t, s in docs}
    rows = corpus_pipeline.run(spark, DIR).collect()
    pieces = collections.defaultdict(dict)
    for r in rows:
        pieces[r["doc_id"]][r["piece"]] = r
    assert set(pieces) == set(want)
    cap = packing.CAPACITY
    for i, (t, _) in want.items():
        n = len(bpe.codec().bpe.encode_ordinary(t))
        assert sorted(pieces[i]) == list(range(max(1, math.ceil(n / cap))))
        assert all(p["start"] == k * cap and p["n_tokens"] == min(cap, n - k * cap) for k, p in pieces[i].items())
    # best fit, replayed: each piece went to the tightest compatible bin there was; after near-dedup no two documents are near copies
    bins = {}
    for r in sorted(rows, key=lambda r: (-r["n_tokens"], r["doc_id"], r["piece"])):
        text, source = want[r["doc_id"]]
        fits = [b["room"] for b in bins.values() if b["room"] >= r["n_tokens"] and source not in b["sources"] and text not in b["texts"]]
        b = bins.setdefault(r["bin_id"], {"room": cap, "sources": set(), "texts": set(), "new": True})
        if b.pop("new", False):
            assert not fits
        else:
            assert b["room"] == min(fits) and source not in b["sources"]
        b["room"] -= r["n_tokens"]
        b["sources"].add(source), b["texts"].add(text)


@pytest.mark.skipif(not HAVE, reason="no test tables")
def test_redaction_against_brute_force(spark):
    table = spark.read.parquet(f"{DIR.replace('sf0.001', 'sf0.01')}/documents.parquet")
    docs = [(r["doc_id"], r["text"], r["source"]) for r in table.collect()]
    want = {i: t for i, t, _ in brute_redact(docs)}
    got = {r["doc_id"]: r["text"] for r in credentials.redact(table.repartition(5)).collect()}
    assert got == want and any("[SECRET:" in t for t in got.values())
