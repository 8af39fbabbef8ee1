"""The operators against brute force, round trips and held-out examples."""

import collections
import functools
import random
import re

import numpy as np
import pytest
from hypothesis import given as over
from hypothesis import settings
from hypothesis import strategies as st

from inkfold.llm import automata, bpe, credentials, fingerprints, lines, packing, quality, separators, simhash, suffixes, toxicity
from inkfold.llm.common import strings, words
from inkfold.llm.components import components

from .common import DIR, HAVE, edge_docs, given, union_find

needs_data = pytest.mark.skipif(not HAVE, reason="no test tables")


# words
def test_words_by_unicode_class():
    texts = ["“you” «idiot»", "l’été—Noël…", "naïve\u00a0ÉTÉ x", "日本語 かな", "a_b c-d", "Ñandú ДА", "e\u0301a", ""]
    raw = [t.encode() for t in texts]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    start, end, h, first = words(buf, offs)
    low = "".join(texts).lower().encode()
    got = [[low[start[k] : end[k]].decode() for k in range(first[i], first[i + 1])] for i in range(len(texts))]
    assert got == [["you", "idiot"], ["l", "été", "noël"], ["naïve", "été", "x"], ["日", "本", "語", "か", "な"], ["a", "b", "c", "d"], ["ñandú", "да"], ["e\u0301a"], []]
    assert len({h[0], *words(np.frombuffer("YOU".encode(), np.uint8), np.array([0, 3]))[2]}) == 1


# components
def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(7000, 7000)]
    find, link = union_find(8000)
    for a, b in edges:
        link(a, b)
    want = collections.defaultdict(set)
    for x in {x for e in edges for x in e}:
        want[find(x)].add(x)
    got = collections.defaultdict(set)
    rows = components(spark.createDataFrame(edges, "u long, v long"), "test").collect()
    for r in rows:
        got[r["root"]].add(r["node"])
    assert len(rows) == len({r["node"] for r in rows})
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values()}
    assert all(k == min(v) for k, v in got.items())


# 1 packing
def test_place_is_best_fit():
    rng = random.Random(5)
    bins, cap = packing.Bins(100), 100
    model = []  # [residual, sources, clusters]
    for _ in range(3000):
        size = rng.randint(1, 60)
        s, c = 1 << min(int(rng.expovariate(0.5)), 8), rng.choice([0, 0, 1 << rng.randint(0, 40)])
        at = bins.place(size, s, c)
        fits = [m[0] for m in model if m[0] >= size and not m[1] & s and not m[2] & c]
        if at == len(model):
            assert not fits
            model.append([cap, 0, 0])
        else:
            assert model[at][0] == min(fits) and not model[at][1] & s and not model[at][2] & c
        model[at] = [model[at][0] - size, model[at][1] | s, model[at][2] | c]


@needs_data
def test_pack_is_complete_and_compatible(spark):
    docs = {r["doc_id"]: r for r in given(spark).collect()}
    size = {i: len(bpe.codec().bpe.encode_ordinary(r["text"])) for i, r in docs.items()}
    near = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(given(spark), packing.CLUSTER_K).collect()}
    cap = 600
    rows = packing.pack(given(spark), capacity=cap).collect()
    pieces, used = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["n_tokens"]))
        used[r["bin_id"]].append(r)
    assert len(pieces) == len(docs)
    for i, own in pieces.items():
        assert sorted(own) == [(k, min(cap, size[i] - k)) for k in range(0, size[i], cap)]
    copies = 0
    for own in used.values():
        assert sum(r["n_tokens"] for r in own) <= cap and sorted(r["slot"] for r in own) == list(range(len(own)))
        assert len({docs[r["doc_id"]]["source"] for r in own}) == len(own)
        groups = [near[r["doc_id"]] for r in own if r["doc_id"] in near]
        assert len(groups) == len(set(groups))  # near copies are never together
        copies += len(groups)
    assert copies > 10
    # replayed by brute force: each piece went to the tightest compatible bin there was
    bins = {}
    order = sorted(rows, key=lambda r: (-r["n_tokens"], r["doc_id"], r["piece"]))
    for r in order:
        source, cluster = docs[r["doc_id"]]["source"], near.get(r["doc_id"], docs[r["doc_id"]]["text"])
        fits = [b["room"] for b in bins.values() if b["room"] >= r["n_tokens"] and source not in b["sources"] and cluster not in b["clusters"]]
        if r["bin_id"] not in bins:
            assert not fits
            bins[r["bin_id"]] = {"room": cap, "sources": set(), "clusters": set()}
        else:
            assert bins[r["bin_id"]]["room"] == min(fits)
        b = bins[r["bin_id"]]
        b["room"] -= r["n_tokens"]
        b["sources"].add(source), b["clusters"].add(cluster)


def test_packing_by_columns(spark):
    rows = [(1, "a", "s", "x", 5), (2, "b", None, "x", 5), (3, "c", None, None, 5), (4, "d", None, None, 0), (5, "e", None, None, None), (1, "a", "s", "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, c string, n long")
    got = packing.pack(docs, capacity=10, cluster_col="c", size_col="n").collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r["bin_id"])
    assert by[4] == by[5] == [None] and len({*by[1], *by[2]}) == 3 and by[3][0] in {*by[1], *by[2]}


def test_hot_cluster_takes_linear_time():
    import time

    def took(n):
        bins, began = packing.Bins(100), time.process_time()
        for i in range(n):
            bins.place(60, 1 << 3 + i % 7, 1)
        return time.process_time() - began, bins

    took(500)
    small, large = took(2000)[0], took(16000)[0]
    assert len(took(500)[1].residual) == 500 and large < 30 * max(small, 0.004)


# 2 secrets
def test_automata_tell_formats_apart():
    formats = credentials.infer(credentials.labelled_examples())
    held_out = credentials.labelled_examples(40, seed=1234)
    right = sum(min(formats, key=lambda k: formats[k].bits(v)) == kind for v, kind in held_out)
    assert right / len(held_out) > 0.95
    assert len(formats["aws_access_key"].end) < 30  # random parts became loops
    a = automata.learn(["ab"] * 50 + ["abab"] * 25 + ["ababab"] * 12)
    assert a.bits("ababababab") < a.bits("aabb")


def test_states_differ_however_late():
    for n in (10, 40, 100):
        a = automata.learn([f"A{'c-' * n}X"] * 100 + [f"B{'c-' * n}Y"] * 100)
        own, other = a.bits(f"A{'c-' * n}X"), a.bits(f"A{'c-' * n}Y")
        assert own < 3 < 15 < other


def test_documented_credentials_are_found(spark):
    """Examples of vendors' manuals, none of which the generator made."""
    known = ["AKIA" + "IOSFODNN7EXAMPLE", "wJalrXUtnFEMI/K7MDENG/" + "bPxRfiCYEXAMPLEKEY", "sk_test_" + "4eC39HqLyjWDarjtT1zdp7dc", "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9." + "eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkpvaG4gRG9lIiwiaWF0IjoxNTE2MjM5MDIyfQ." + "SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c", "AIza" + "SyDaGmWKa4JsXZ-HjGw7ISLn_3namBGewQe", "d41d8cd98f00b204" + "e9800998ecf8427e"]
    text = "reading the report again we found that nothing unusual had happened during the extraordinary summer holidays of 2019"
    rows = [(i, f"{text} {v} {text}") for i, v in enumerate(known)] + [(100 + i, text) for i in range(200)] + [(300, None), (301, ""), (0, f"{text} {known[0]} {known[0]}"), (0, f"{text} {known[0]} {known[0]}")]
    found = collections.Counter(r["doc_id"] for r in credentials.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == {0: 5, **{i: 1 for i in range(1, len(known))}}  # a run that occurs twice and repeated rows count each


def test_secrets_in_prose(spark):
    rng = random.Random(8)
    kinds = credentials.labelled_examples(20, seed=77)
    text = "reading the report again we found that nothing unusual had happened during the extraordinary summer holidays of 2019"
    rows = [(i, f"{text} {v} {text}.") for i, (v, _) in enumerate(kinds)] + [(1000 + i, " ".join(rng.sample(text.split(), 15))) for i in range(400)]
    rows += [(2000, "call 4111111111111111 or 0123456789012 from 192.168.100.200 see https example.com/some/long/path-to-a-page.html")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in credentials.secrets(docs).collect()}
    caught = [i for i in range(len(kinds)) if i in found]
    assert len(caught) / len(kinds) > 0.95 and not [i for i in found if i >= 1000]
    for i in caught:
        v = kinds[i][0].rstrip(".")
        assert rows[i][1][found[i]["start"] : found[i]["end"]] == v
    clean = {r["doc_id"]: r["text"] for r in credentials.redact(docs).collect()}
    assert all(kinds[i][0] not in clean[i] and clean[i].startswith(text) for i in caught)


# 3 BPE
@settings(max_examples=150, deadline=None)
@over(st.text(alphabet=st.sampled_from(list(" \n\t'adlstrevm12.,!?éñß漢😀  x")), max_size=120), st.integers(1, 9))
def test_tree_gives_the_whole_texts_tokens(text, leaf):
    c = bpe.codec()
    tokens = c.encode(text, leaf)
    assert tokens.tolist() == c.bpe.encode_ordinary(text)
    assert c.decode(tokens, 3) == text.encode()


# 4 quality
def test_quality_bands():
    z = quality.compressor()
    prose = " ".join(f"{w}{i % 37} went to see {w[::-1]} at {i * 31 % 101}" for i, w in enumerate(["house", "river", "garden", "winter"] * 60))
    assert quality.judge(b"spam and eggs " * 200, z)[-1] == "repetitive"
    assert quality.judge(np.random.default_rng(1).bytes(5000), z)[-1] == "incompressible"
    assert quality.judge(None, z)[-1] == "null" and quality.judge(b"", z)[-1] == "empty"
    assert quality.judge(b"Hello there.", z)[-1] == "keep"
    noise = np.random.default_rng(2)
    mixed = prose.encode()[:4096] + b"".join(bytes(noise.integers(33, 127, 1024).tolist()) for _ in range(2))
    assert quality.judge(mixed, z)[-1] == "chunks"
    n, ratio, chunks, bad, _ = quality.judge(prose.encode(), z)
    assert chunks == -(-n // quality.CHUNK_BYTES) and ratio == len(z.compress(prose.encode())) / n and 0 <= bad <= chunks


@needs_data
def test_clean_documents_stay(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    verdicts = {r["doc_id"]: r["verdict"] for r in quality.quality(given(spark)).collect()}
    good = [verdicts[i] == "keep" for i, q in labels.items() if q == 1 and i in verdicts]
    assert sum(good) / len(good) > 0.99


# 5 fingerprints
@settings(max_examples=60, deadline=None)
@over(st.lists(st.text(alphabet="abc ", max_size=6), max_size=8), st.randoms())
def test_fingerprint_is_a_multiset_hash(parts, rng):
    shuffled = list(parts)
    rng.shuffle(shuffled)
    whole = fingerprints.fingerprint("\n".join(parts).encode())
    assert whole == fingerprints.fingerprint("\n".join(shuffled).encode())
    more = fingerprints.insert(whole, b"another")
    assert more == fingerprints.fingerprint("\n".join([*parts, "another"]).encode()) != whole
    assert fingerprints.delete(more, b"another") == whole
    assert fingerprints.combine(whole, more) == fingerprints.fingerprint("\n".join([*parts, *parts, "another"]).encode())


def test_fingerprints_of_sources(spark):
    docs = edge_docs(spark)
    fps = fingerprints.fingerprints(docs).join(docs.select("doc_id", "source").distinct(), "doc_id")
    rows = fingerprints.merge(fps, "source").collect()
    got = {r["source"]: r["vector"] for r in rows}
    assert all(r["digest"] == fingerprints.digest(bytes(r["vector"])) for r in rows)
    for source in ("a", "c"):
        texts = [r["text"] for r in docs.where(f"source = '{source}' and text is not null").collect()]
        assert bytes(got[source]) == fingerprints.fingerprint("\n".join(texts).encode())


# 6 SimHash
def test_golay_code_covers():
    code = simhash.golay()
    d = np.bitwise_count(code[:, None] ^ code[None, :40])
    assert np.sort(d[:, 0])[1] == 7
    w = np.random.default_rng(0).integers(0, 1 << 23, 500)
    near = np.bitwise_count(w[:, None] ^ code[None]).min(axis=1)
    assert near.max() <= 3
    for radius in (3, 4, 5):
        row, at = simhash.cover(radius).anchors(w)
        for i in range(0, 500, 50):
            want = {int(simhash.cover(radius).index[c]) for c in code[np.bitwise_count(code ^ w[i]) <= radius]}
            assert set(at[row == i].tolist()) == want


@needs_data
@pytest.mark.parametrize("k", [5, 17, simhash.K])
def test_near_duplicates_against_all_pairs(spark, k):
    rows = [(r["doc_id"], r["text"]) for r in given(spark).collect()]
    rng = random.Random(2)
    for i, text in rows[:60]:  # more near copies
        ws = text.split()
        for j in range(rng.randint(1, 4)):
            out = [w if rng.random() > 0.04 else rng.choice(ws) + "x" for w in ws]
            rows.append((10_000 + i * 10 + j, " ".join(out)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    t = docs.toArrow()
    fp, has = simhash.fingerprint(*strings(t.column("text"))[:2])
    f = np.stack(simhash.to_longs(fp), axis=1)
    d = sum(np.bitwise_count(f[:, None, c] ^ f[None, :, c]).astype(int) for c in range(f.shape[1]))
    find, link = union_find(len(f))
    for a, b in zip(*np.nonzero(np.triu(d <= k, 1)), strict=True):
        link(int(a), int(b))
    groups, ids = collections.defaultdict(set), t.column("doc_id").to_pylist()
    for i in range(len(f)):
        groups[find(i)].add(ids[i])
    got = collections.defaultdict(set)
    for r in simhash.near_duplicates(docs, k).collect():
        got[r["group_id"]].add(r["doc_id"])
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in groups.values() if len(x) > 1}
    kept = [r["doc_id"] for r in simhash.near_dedup(docs, k).collect()]
    assert sorted(kept) == sorted(min(x) for x in groups.values())


def test_fingerprint_counts_each_word_once():
    texts = ["a b c d e f g h", "a a a a b c d e f g h", "A, b. c d e f g H!"]
    import pyarrow as pa

    fp, has = simhash.fingerprint(*strings(pa.array([*texts, "", "..."]))[:2])
    assert (fp[0] == fp[1]).all() and (fp[0] == fp[2]).all() and has.tolist() == [True, True, True, False, False]


# 7 toxicity
def edits(a, b):
    """Insertions, deletions, substitutions and swaps of neighbours, none edited again."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] != a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def misspelled(word, term):
    if len(term) >= toxicity.MIN_FUZZY:
        return 0 < edits(word, term) <= (2 if len(term) >= toxicity.MIN_FUZZY2 else 1)
    if len(term) < toxicity.MIN_VARIED:
        return False
    swap = len(word) == len(term) and sorted(word) == sorted(term) and edits(word, term) == 1
    digit = len(word) == len(term) and [(x, y) for x, y in zip(word, term, strict=True) if x != y] and all(x in "0123456789" for x, y in zip(word, term, strict=True) if x != y) and sum(x != y for x, y in zip(word, term, strict=True)) == 1
    twice = len(word) == len(term) + 1 and any(word[i] == word[i + 1] and word[:i] + word[i + 1 :] == term for i in range(len(term)))
    return bool(swap or digit or twice)


TERMS = ["idiot", "moron", "dab", "rétard", "abcdefghij", "shit", "дурак"]
_automaton = []


@settings(max_examples=400, deadline=None)
@over(st.one_of(st.text(alphabet="abcdiotmré1", min_size=1, max_size=9), st.tuples(st.sampled_from(TERMS), st.integers(0, 10), st.sampled_from(["swap", "drop", "é", "1", "twice"]), st.integers(0, 8), st.sampled_from(["", "drop", "a", "swap"])))) 
def test_automaton_is_levenshtein(word):
    if isinstance(word, tuple):
        term, i, how, k, again = word
        word = list(term)
        for at, op in ((i, how), (k, again)):
            at %= max(1, len(word) - 1)
            if op == "swap" and len(word) > 1:
                word[at], word[at + 1] = word[at + 1], word[at]
            elif op == "drop":
                del word[at]
            elif op == "twice":
                word.insert(at, word[at])
            elif op:
                word[at] = op
        word = "".join(word) or "x"
    if not _automaton:
        _automaton.append(toxicity.Automaton(TERMS))
    auto = _automaton[0]
    raw = np.frombuffer(word.encode(), np.uint8)
    which, state = auto.run(auto.symbols(raw), np.array([0]), np.array([len(raw)]))
    want = word in TERMS or any(misspelled(word, t) for t in TERMS)
    assert bool(len(which)) == want
    if want:
        assert bool(auto.exact[state[0]]) == (word in TERMS)


def test_quotation_and_abuse(spark):
    texts = [
        "you are an idiot", 'the word "idiot" has Greek roots', "you mor0n and idiott", "the idyllic village", "they wrote loser on it", "what an idoit", '"you are an idiot"', "you “idiot” there", "«idiot», dit-elle",
        "idiot’s end", "well idiot—really", "ДУРАК!", "the “old” idiot “again”", "that mothrfuckr", "an idiot…", "a closer look while discussing the garage and a lower reward", 'he cried "no!" and was an idiot',
        "un\u00a0imbécile", None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    r = {x["doc_id"]: x for x in toxicity.toxicity(docs).collect()}
    assert r[1]["toxic"] and r[1]["score"] == 1.5 and not r[2]["toxic"] and r[2]["n_quoted"] == 1
    assert r[3]["toxic"] and r[3]["n_fuzzy"] == 2 and not r[4]["toxic"] and not r[5]["toxic"]
    assert r[6]["toxic"] and r[6]["terms"] == ["idoit"]
    assert all(r[i]["n_quoted"] == 1 and not r[i]["toxic"] for i in (7, 8, 9))
    assert all(r[i]["toxic"] and r[i]["n_quoted"] == 0 for i in (10, 11, 13, 14, 15, 17, 18))
    assert r[12]["n_hits"] == 0 and not any(r[i]["n_hits"] for i in (16, 19, 20))


def test_terms_of_any_script():
    auto = toxicity.Automaton(["笨蛋", "дурак", "idiot"])
    texts = ["他是笨蛋吗", "笨", "Ты ДУРАК", "蛋笨 дурок", "笨 蛋"]
    import pyarrow as pa

    data, offs, _ = strings(pa.array(texts))
    assert [(r, w, e) for r, w, e, _, _ in toxicity.judge(data, offs, auto)] == [(0, "笨蛋", True), (2, "дурак", True), (3, "дурок", False)]


@needs_data
def test_toxicity_by_brute_force(spark):
    """Each word of each text against each term, by the definition alone."""
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    rows = {r["doc_id"]: r["text"] for r in given(spark).collect()}
    some = [t for t in rows.values() if t][:6]
    rows |= {100_000 + i: f"{t[:200]} {x} {t[200:400]}" for i, (t, x) in enumerate(zip(some, ["you idiot", "said idoit", "the 'moron' there", "a wrothless thing", "sh1t", "closer"], strict=True))}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    auto = toxicity.taught(docs, labels)
    terms = set(auto.terms)

    @functools.cache
    def like(w):
        return any(abs(len(w) - len(t)) <= 2 and misspelled(w, t) for t in toxicity.BASE)

    for r in toxicity.toxicity(docs, labels).collect():
        ws = re.findall(r"[^\W_]+", (rows[r["doc_id"]] or "").lower())
        hits = fuzzy = 0
        for w in ws:
            if w in terms:
                hits += 1
            elif w not in auto.ordinary and like(w):
                hits, fuzzy = hits + 1, fuzzy + 1
        assert (r["n_hits"], r["n_fuzzy"]) == (hits, fuzzy), r


@needs_data
def test_toxic_labels(spark):
    folder = DIR.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    english = spark.read.parquet(f"{folder}/documents.parquet").where("lang = 'en'").select("doc_id")  # the others have too few labels here
    want = {r["doc_id"]: r["toxic"] for r in labels.join(english, "doc_id").collect()}
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(spark.read.parquet(f"{folder}/documents.parquet"), labels).collect()}
    clean, bad = ([got[i] for i, t in want.items() if bool(t) == k and i in got] for k in (False, True))
    assert sum(clean) / len(clean) < 0.02 and sum(bad) >= 0.9 * len(bad) > 0


# 8 separators
def test_separator_scan_stitches_blocks(spark, tmp_path):
    rng = np.random.default_rng(4)
    want = {}
    for name, n in (("a.bin", 5000), ("b.bin", 1), ("c.bin", 0), ("d.bin", 777)):
        ids = rng.integers(0, 40, n).astype("<u2")
        if name == "d.bin":
            ids[:] = 3  # no end at all
        (tmp_path / name).write_bytes(ids.tobytes())
        out, begin = [], 0
        for i, x in enumerate(ids):
            if x == 7:
                out.append((begin, i - begin, True))
                begin = i + 1
        if begin < n:
            out.append((begin, n - begin, False))
        want[name] = out
    for block in (2, 64, 1000, 1 << 20):
        got = collections.defaultdict(list)
        for r in separators.scan(spark, f"file://{tmp_path}", None, 7, block).orderBy("file", "ordinal").collect():
            got[r["file"]].append((r["begin"], r["n_tokens"], r["closed"]))
        assert dict(got) == {k: v for k, v in want.items() if v}


@needs_data
def test_token_counts(spark):
    c = bpe.codec()
    want = {r["doc_id"]: len(c.bpe.encode_ordinary(r["text"])) for r in given(spark).collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in separators.token_counts(given(spark)).collect()} == want


# 9 suffixes
@settings(max_examples=80, deadline=None)
@over(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.integers(1, 9))
def test_bounded_lcp(text, bound):
    t = np.array([*text, 0])
    order = suffixes.suffix_order(t, bound)
    got = suffixes.bounded_lcp(t, order, bound)
    for i in range(1, len(t)):
        a, b = t[order[i - 1] :].tolist(), t[order[i] :].tolist()
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert got[i] == min(n, bound)


def brute_spans(docs, n):
    of = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in docs}
    seen = collections.Counter(tuple(w[i : i + n]) for w in of.values() for i in range(len(w) - n + 1))
    out = set()
    for k, w in of.items():
        cur = None
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                if cur and i <= cur[1]:
                    cur[1] = i + n
                else:
                    out |= {(k, *cur)} if cur else set()
                    cur = [i, i + n]
        out |= {(k, *cur)} if cur else set()
    return out


@needs_data
@pytest.mark.parametrize("n", [4, 12, 50])
def test_repeated_passages(spark, n):
    docs = [(r["doc_id"], r["text"]) for r in given(spark).collect()]
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in suffixes.repeated_passages(given(spark), n).collect()}
    assert got == brute_spans(docs, n)


def test_without_broadcast(spark, monkeypatch):
    docs = edge_docs(spark)
    a = suffixes.repeated_passages(docs, 20).collect()
    b = lines.duplicate_lines(docs).collect()
    monkeypatch.setattr(suffixes, "BROADCAST_STRETCHES", 0)
    monkeypatch.setattr(lines, "BROADCAST_NODES", 0)
    assert sorted(map(str, suffixes.repeated_passages(docs, 20).collect())) == sorted(map(str, a)) and a
    assert sorted(map(str, lines.duplicate_lines(docs).collect())) == sorted(map(str, b)) and b


# 10 lines
def brute_lines(docs):
    occ = collections.defaultdict(list)
    for i, t in docs:
        for n, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\r"):
                occ[x.strip(" \t\r").encode()].append((i, n))
    keys = list(occ)
    sets = [{k[i : i + 8] for i in range(len(k) - 7)} for k in keys]
    where = collections.defaultdict(list)
    find, link = union_find(len(keys))
    for k, s in enumerate(sets):
        shared = collections.Counter(m for sh in s for m in where[sh])
        for m, n in shared.items():
            if n >= lines.THRESHOLD * (len(s) + len(sets[m]) - n):
                link(k, m)
        for sh in s:
            where[sh].append(k)
    groups = collections.defaultdict(set)
    for k, key in enumerate(keys):
        groups[find(k)].update(occ[key])
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@needs_data
def test_fuzzy_lines(spark):
    docs = [(r["doc_id"], r["text"]) for r in given(spark).collect()]
    rng = random.Random(1)
    for i, t in docs[:40]:
        docs.append((10_000 + i, "\n".join(x.replace(rng.choice(x.split() or ["?"]), "other", 1) for x in t.split("\n"))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = collections.defaultdict(set)
    for r in lines.duplicate_lines(df).collect():
        got[(r["first_doc_id"], r["first_line_no"])].add((r["doc_id"], r["line_no"]))
        assert r["keep"] == ((r["doc_id"], r["line_no"]) == (r["first_doc_id"], r["first_line_no"]))
    want, mine = brute_lines(docs), {frozenset(g) for g in got.values()}
    pairs = lambda gs: {(min(g), x) for g in gs for x in g if x != min(g)}
    assert mine <= want or len(pairs(mine) - pairs(want)) <= 0.1 * len(pairs(want))
    assert len(pairs(mine) & pairs(want)) >= 0.9 * len(pairs(want))
    # what is left
    gone = {x for g in mine for x in g if x != min(g)}
    left = {r["doc_id"]: r["text"] for r in lines.line_dedup(df).collect()}
    for i, t in docs:
        keep = [x for n, x in enumerate(t.split("\n")) if (i, n) not in gone]
        if any(x.strip() for x in keep):
            assert left[i] == "\n".join(keep)
        else:
            assert i not in left
