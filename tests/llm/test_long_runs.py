"""Credentials in runs of any length: the exact way for long runs gives what all pairs of ends give."""

from __future__ import annotations

import random
import string

import numpy as np
import pyarrow as pa

from inkfold.llm import credentials
from inkfold.llm.automata import N_CHARS

ALNUM = string.ascii_letters + string.digits


def scorer() -> credentials.Scorer:
    rng = np.random.default_rng(1)
    m = rng.integers(1, 50, (N_CHARS, N_CHARS)).astype(float)
    return credentials.Scorer(credentials.published(), -np.log2(m / m.sum(axis=1, keepdims=True)).astype(np.float32), credentials.THRESHOLD_BITS)


def test_long_runs_equal_all_pairs(monkeypatch):
    rng, judge = random.Random(5), scorer()
    values = [v for v, _ in credentials.labelled_examples(12, seed=99)]
    texts = []
    for _ in range(40):
        parts = [rng.choice((rng.choice(values), "".join(rng.choices(ALNUM, k=rng.randint(1, 30))), "word", "123")) for _ in range(rng.randint(2, 9))]
        texts.append("so " + "".join(p + rng.choice("=/.-+") for p in parts) + " it " + rng.choice(values))
    want = credentials.findings(pa.array(texts), judge)
    monkeypatch.setattr(credentials, "LONG_RUN", 20)
    got = credentials.findings(pa.array(texts), judge)
    assert len(want) > 40
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert np.allclose([x[4] for x in got], [x[4] for x in want], atol=1e-3)


def test_a_part_of_more_than_2048_characters():
    rng = random.Random(2)
    token = "eyJ" + "".join(rng.choices(ALNUM, k=33)) + ".eyJ" + "".join(rng.choices(ALNUM, k=3000)) + "." + "".join(rng.choices(ALNUM, k=43))
    text = f"see page=one/access={token}"
    at = text.index("eyJ")
    found = credentials.findings(pa.array([text]), scorer())
    assert any(a <= at and z == len(text) for _, a, z, _, _ in found), [x[:4] for x in found]
