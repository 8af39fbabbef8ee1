"""Anchors with many rows: comparison by the words halfway between two block words."""

from __future__ import annotations

import numpy as np
import pytest

from inkfold.llm import simhash


def roots(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("k", [5, 17, simhash.K])
def test_halves_find_all_pairs(monkeypatch, k):
    """With no matrix at any anchor the components are those of all pairs; the matrix of a large anchor isn't made."""
    monkeypatch.setattr(simhash, "MANY", 1)
    monkeypatch.setattr(simhash, "BATCH", 64)
    rng = np.random.default_rng(k)
    base = rng.integers(0, 1 << simhash.BITS, (60, simhash.BLOCKS))
    fp = np.repeat(base, 10, axis=0)
    for row in fp:
        for bit in rng.choice(simhash.BLOCKS * simhash.BITS, rng.integers(0, k), replace=False):
            row[bit // simhash.BITS] ^= 1 << (bit % simhash.BITS)
    fp = np.unique(fp, axis=0)
    f, code, pairs = np.stack(simhash.to_longs(fp), axis=1), simhash.golay(), []
    for j, radius in enumerate(simhash.radii(k, simhash.BLOCKS)):
        row, anchor = simhash.cover(radius).anchors(fp[:, j])
        for a in np.unique(anchor):
            m = row[anchor == a]
            found = simhash.link_anchor(f[m], k, fp[m, j].astype(np.uint32), 2 * (radius - simhash.RADIUS), int(code[a]), j // 2)
            pairs += [(int(m[x]), int(m[y])) for x, y in found]
    d = np.bitwise_count(f[:, None] ^ f[None]).sum(axis=2)
    assert all(d[a, b] <= k for a, b in pairs)
    assert roots(len(fp), pairs) == roots(len(fp), np.argwhere(np.triu(d <= k, 1)).tolist())


def test_few_pairs_are_judged_at_a_large_anchor(monkeypatch):
    """Of unrelated words at an anchor fewer than a fifth of the pairs share a word halfway."""
    rng = np.random.default_rng(1)
    n = 6000
    words = np.zeros(n, np.uint32)
    for i in range(n):
        words[i] = sum(1 << int(b) for b in rng.choice(simhash.BITS, 5, replace=False))
    _, mid = simhash.halfway(words, 0, 2)
    per = np.bincount(mid).astype(np.int64)
    assert (per * (per - 1) // 2).sum() < n * (n - 1) // 2 / 5
