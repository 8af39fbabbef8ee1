"""What the operators are for, against texts: recall of real cases, and ordinary ones left alone."""

import itertools

import numpy as np
import pytest

from inkfold.llm import credentials, simhash
from inkfold.llm.common import strings

from .common import DIR, HAVE, union_find

needs_data = pytest.mark.skipif(not HAVE, reason="no test tables")


# 6 SimHash
def test_thresholds_cover_k():
    for blocks in (2, 6, 7):
        for k in range(40):
            t = [2 * (r - simhash.RADIUS) for r in simhash.radii(k, blocks)]
            assert sum(t) + blocks > k and min(t) >= 0


@needs_data
def test_near_copies_by_text(spark):
    table = spark.read.parquet(f"{DIR.replace('sf0.001', 'sf0.01')}/documents.parquet").select("text").toArrow()
    sets = [frozenset("".join(c if c.isalnum() else " " for c in (t or "").lower()).split()) for t in table.column("text").to_pylist()]
    fp, has = simhash.fingerprint(*strings(table.column("text"))[:2])
    f = np.stack(simhash.to_longs(fp), axis=1)
    d = sum(np.bitwise_count(f[:, None, c] ^ f[None, :, c]).astype(int) for c in range(f.shape[1]))
    find, link = union_find(len(f))
    real, unlike, linked = [], 0, 0
    for a, b in itertools.combinations(np.flatnonzero(has).tolist(), 2):
        both = len(sets[a] & sets[b])
        j = both / (len(sets[a]) + len(sets[b]) - both or 1)
        if d[a, b] <= simhash.K:
            link(a, b)
            linked += 1
            unlike += j < 0.5
        if 0.8 <= j < 1:
            real.append((a, b))
    assert len(real) > 20 and sum(find(a) == find(b) for a, b in real) >= 0.97 * len(real)
    assert unlike <= 0.001 * linked


# 2 secrets
def test_secrets_joined_to_other_text(spark):
    kinds = ("aws_access_key", "github_token", "slack_token", "stripe_key", "google_api_key", "json_web_token")
    values = [(v, k) for v, k in credentials.labelled_examples(20, seed=99) if k in kinds]
    frames = ("GITHUB_TOKEN={}", "export AWS_ACCESS_KEY_ID={} now", "https://{}@host.example", "see hook/{}", "name.{}/path/to/a/page", "x-{}", "a={}.")
    text = "reading the report again we found that nothing unusual had happened during the extraordinary summer holidays of 2019"
    rows = [(i, f"{text} {frames[i % len(frames)].format(v)} {text}") for i, (v, _) in enumerate(values)]
    plain = "see https://www.example.com/2019/05/some-long-title-of-a-page.html and LONG_NAME=/usr/local/lib/python3.11/site-packages"
    docs = spark.createDataFrame([*rows, (1000, f"{text} {plain}")], "doc_id long, text string")
    found = {(r["doc_id"], rows[r["doc_id"]][1][r["start"] : r["end"]]) for r in credentials.secrets(docs).collect() if r["doc_id"] < 1000}
    clean = {r["doc_id"]: r["text"] for r in credentials.redact(docs).collect()}
    gone = [v not in clean[i] for i, (v, _) in enumerate(values)]
    assert sum(gone) >= 0.95 * len(gone) and sum((i, v.rstrip(".")) in found for i, (v, _) in enumerate(values)) >= 0.9 * len(gone)
    assert clean[1000] == f"{text} {plain}"


def test_best_parts_do_not_overlap():
    assert credentials.apart([(0, 20, 1, 30.0), (5, 20, 2, 40.0), (21, 40, 1, 25.0), (20, 21, 0, 1.0)]) == [(5, 20, 2, 40.0), (20, 21, 0, 1.0), (21, 40, 1, 25.0)]
