"""Secret scans by grammar inference.

For each kind of credential a probabilistic automaton is inferred from labelled examples (automata.learn).  Candidates are all runs
of credential characters of at least MIN_LENGTH, and their parts: from after a joint (one of JOINTS) or the run's beginning to
before a joint or its end, however long; in runs of more than LONG_RUN characters Scorer.long_run finds the same without trying all
pairs of ends.  A part has letters and digits, no symbol its automaton has never seen, and
is no shorter than the shortest example.  The best spans that don't overlap are taken.

A candidate's score is its log-likelihood ratio in bits: the best format's
likelihood against that of a character-bigram model of the whole table's text.  Scores from THRESHOLD_BITS are secrets.

The labelled examples are, by default, made by ``labelled_examples`` from published credential formats, PER_KIND of each; a table
(value, kind) of one's own can be given instead, from which at most MAX_LABELLED rows a kind are used.

Defined results: null and empty texts have no findings; each of repeated rows has its own; a run that occurs twice in a text is
two findings; of overlapping spans the better one counts, of equally good ones the first; texts are scanned whole, however long; in a
table of labels rows with a null are none; an empty table has no findings.  Offsets count characters.  Findings never hold a
secret's characters.  Other columns can have any names, repeated ones too; ``redact`` keeps them.
"""

from __future__ import annotations

import bisect
import functools
import random
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import N_CHARS, Pdfa, learn
from .common import ID, TEXT, by_place, keyed, map_arrow, map_rows, place_of, ranges, slices, strings

MIN_LENGTH = 12
THRESHOLD_BITS = 24.0
PER_KIND = 240
MAX_LABELLED = 2000
LONG_RUN = 2048
JOINTS = "=/.-+"
ALPHABET = string.ascii_letters + string.digits + "_-+/=."
SCHEMA = "doc_id long, start long, end long, kind string, score double"
_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in ALPHABET]] = True
_JOINT = np.zeros(256, bool)
_JOINT[[ord(c) for c in JOINTS]] = True
_SYMBOL = np.full(256, 95, np.uint8)
_SYMBOL[32:127] = np.arange(95)
KEYS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "client_secret")


def labelled_examples(per_kind: int = PER_KIND, seed: int = 7) -> list[tuple[str, str]]:
    """(value, kind) pairs of published formats, from a seeded generator."""
    rng = random.Random(seed)
    alnum, b64, hexa = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef"
    url64 = alnum + "-_"

    def some(chars: str, n: int) -> str:
        return "".join(rng.choices(chars, k=n))

    makers = {
        "aws_access_key": lambda: rng.choice(("AKIA", "AKIA", "ASIA")) + some(string.ascii_uppercase + string.digits, 16),
        "aws_secret_key": lambda: some(b64, 40),
        "github_token": lambda: rng.choice(("ghp_", "gho_", "ghs_")) + some(alnum, 36),
        "slack_token": lambda: rng.choice(("xoxb-", "xoxp-")) + some(string.digits, 12) + "-" + some(string.digits, 12) + "-" + some(alnum, 24),
        "stripe_key": lambda: rng.choice(("sk_live_", "rk_live_", "sk_test_")) + some(alnum, 24),
        "google_api_key": lambda: "AIza" + some(url64, 35),
        "json_web_token": lambda: "eyJ" + some(url64, rng.choice((17, 33))) + ".eyJ" + some(url64, rng.randint(30, 60)) + "." + some(url64, 43),
        "hex_token": lambda: some(hexa, rng.choice((32, 40, 40, 48, 64))),
        "hex_assignment": lambda: rng.choice(KEYS) + "=" + some(hexa, rng.randint(16, 40)),
        "assignment": lambda: rng.choice(KEYS) + "=" + some(alnum, rng.randint(12, 32)),
    }
    return [(make(), kind) for kind, make in makers.items() for _ in range(per_kind)]


def infer(labelled: list[tuple[str, str]]) -> dict[str, Pdfa]:
    by: dict[str, list[str]] = {}
    for value, kind in labelled:
        if value and kind and len(by.setdefault(kind, [])) < MAX_LABELLED:
            by[kind].append(value)
    return {kind: learn(values) for kind, values in sorted(by.items())}


@functools.cache
def published() -> dict[str, Pdfa]:
    """The automata of labelled_examples(), which are the same each time."""
    return infer(labelled_examples())


def background(docs: DataFrame) -> np.ndarray:
    """Bits of each character after each other one in all ordinary text of the table, as a matrix; runs are entered from symbol 95.

    Candidate runs with both letters and digits are no ordinary text, however many there are.  Counts are summed by task before
    the shuffle; the matrix has the same size for any input.
    """

    def count(batches):
        total = np.zeros(N_CHARS * N_CHARS, np.int64)
        for b in batches:
            data, offs, _ = strings(b.column(TEXT))
            for i, j in slices(offs):
                buf = data[offs[i] : offs[j]]
                if not len(buf):
                    continue
                sym = _SYMBOL[buf].astype(np.int32)
                pair = np.empty(len(sym), np.int32)
                np.add(sym[:-1] * N_CHARS, sym[1:], out=pair[1:])
                heads = offs[i:j] - offs[i]
                heads = heads[heads < len(sym)]
                pair[heads] = 95 * N_CHARS + sym[heads]  # a text doesn't follow on the one before
                total += np.bincount(pair, minlength=N_CHARS * N_CHARS)
                start, end = spans(buf, offs[i : j + 1] - offs[i])
                odd = mixed(buf, start, end)
                size = (end - start)[odd]
                total -= np.bincount(pair[np.repeat(start[odd], size) + ranges(size)], minlength=N_CHARS * N_CHARS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    rows = docs.select(F.col(TEXT)).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(N_CHARS * N_CHARS)
    for r in rows:
        counts[r["pair"]] = r["n"]
    m = counts.reshape(N_CHARS, N_CHARS) + 0.05
    return -np.log2(m / m.sum(axis=1, keepdims=True)).astype(np.float32)


class Scorer:
    """All automata against the background, over many candidates at once."""

    def __init__(self, formats: dict[str, Pdfa], ground: np.ndarray, threshold: float) -> None:
        self.kinds, self.formats = list(formats), list(formats.values())
        self.ground, self.threshold = ground, threshold

    def best(self, sym: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(kind or -1, score) of the spans of ``sym``."""
        n = len(start)
        kind, score = np.full(n, -1, np.int32), np.full(n, -np.inf, np.float32)
        if not n:
            return kind, score
        before = np.full(len(sym), 95, np.int64)
        before[1:] = sym[:-1]
        step = self.ground[before, sym].astype(np.float64)
        total = np.concatenate([[0.0], np.cumsum(step)])
        plain = (total[end] - total[start] - step[start] + self.ground[95, sym[start]]).astype(np.float32)
        for k, f in enumerate(self.formats):
            alive, at = np.arange(n), start.copy()
            state, spent, room = np.zeros(n, np.int32), np.zeros(n, np.float32), plain - self.threshold
            stop = end
            while len(alive):
                c = sym[at]
                spent = spent + f.cost[state, c]
                state, at = f.step[state, c], at + 1
                done = at == stop
                if done.any():
                    found = alive[done]
                    llr = plain[found] - spent[done] - f.end[state[done]]
                    better = llr > score[found]
                    score[found[better]], kind[found[better]] = llr[better], k
                go = ~done & (spent <= room)  # beyond, the score can't reach the threshold any more
                alive, at, state, spent, room, stop = alive[go], at[go], state[go], spent[go], room[go], stop[go]
        kind[score < self.threshold] = -1
        return kind, score

    def parts(self, sym: np.ndarray, start: np.ndarray, limit: np.ndarray, joint: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(first, end, kind, score) of secrets that begin at ``start`` and end before a joint or at ``limit``: for each beginning, kind and end."""
        out = []
        if not len(start):
            return out
        before = np.full(len(sym), 95, np.int64)
        before[1:] = sym[:-1]
        total = np.concatenate([[0.0], np.cumsum(self.ground[before, sym].astype(np.float64))])
        base = total[start + 1] - self.ground[95, sym[start]]  # a part is entered afresh, as a run is
        most = limit
        odd, even = (np.concatenate([[0], np.cumsum(is_in[sym + 32])]) for is_in in (_DIGIT, _LETTER))
        for k, f in enumerate(self.formats):
            dead = len(f.end) - 1
            alive, at = np.arange(len(start)), start.copy()
            state, spent = np.zeros(len(start), np.int32), np.zeros(len(start))
            room = total[most] - base - self.threshold
            while len(alive):
                c = sym[at]
                spent, state, at = spent + f.cost[state, c], f.step[state, c], at + 1
                stop = at == limit[alive]
                ends = (stop | joint[np.minimum(at, len(joint) - 1)]) & (at - start[alive] >= max(MIN_LENGTH, f.shortest)) & (state != dead)
                for x in np.flatnonzero(ends & (odd[at] > odd[start[alive]]) & (even[at] > even[start[alive]])).tolist():
                    a = int(alive[x])
                    score = total[at[x]] - base[a] - spent[x] - f.end[state[x]]
                    if score >= self.threshold:
                        out.append((int(start[a]), int(at[x]), k, float(score)))
                go = (at < most[alive]) & (state != dead) & (spent <= room[alive])
                alive, at, state, spent = alive[go], at[go], state[go], spent[go]
        return out


    def long_run(self, sym: np.ndarray, lo: int, hi: int, joint: np.ndarray, whole: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """What apart() leaves of the parts of the run from ``lo`` to ``hi``, and of ``whole``, in time that grows with the run.

        The best part is taken, then the best on either side of it, as the others overlap it.
        """
        own = sym[lo:hi]
        before = np.concatenate([[95], own[:-1]])
        before[0] = sym[lo - 1] if lo else 95
        total = np.concatenate([[0.0], np.cumsum(self.ground[before, own].astype(np.float64))])
        mixed_ = [np.concatenate([[0], np.cumsum(is_in[own + 32])]) for is_in in (_DIGIT, _LETTER)]
        out, todo = [], [(0, hi - lo)]
        while todo:
            a, z = todo.pop()
            if z - a < MIN_LENGTH:
                continue
            found = [(x - lo, y - lo, k, s) for x, y, k, s in whole] if (a, z) == (0, hi - lo) else []
            found += self._best_part(own, a, z, joint[lo:hi], total, mixed_)
            if found:
                x, y, k, s = min(found, key=lambda x: (-x[3], x[0], x[1], x[2]))
                out.append((x + lo, y + lo, k, s))
                todo += [(a, x), (y, z)]
        return sorted(out)

    def _best_part(self, sym: np.ndarray, a: int, z: int, joint: np.ndarray, total: np.ndarray, mixed_: list[np.ndarray]) -> list[tuple[int, int, int, float]]:
        """The best part within ``a`` and ``z`` of each kind.

        Of beginnings that meet in a state only those are followed that can be better at some end: an earlier one is good wherever a
        later one is, so a later one has to score more; once it is long and mixed enough itself, the earlier ones are behind for good.
        """
        chars, is_joint, odd, even, sums, out = sym[a:z].tolist(), joint.tolist(), *(x.tolist() for x in mixed_), total.tolist(), []
        enter = self.ground[95].tolist()
        for k, f in enumerate(self.formats):
            dead, need, best = len(f.end) - 1, max(MIN_LENGTH, f.shortest), None
            cost, step, end = f.cost.tolist(), f.step.tolist(), f.end.tolist()
            alive: dict[int, list[tuple[float, float, int]]] = {}  # (base, spent, beginning), by beginning, each better than the one before
            for at, c in enumerate(chars, a):
                if at == 0 or is_joint[at - 1]:
                    alive.setdefault(0, []).append((sums[at + 1] - enter[c], 0.0, at))
                nxt: dict[int, list[tuple[float, float, int]]] = {}
                for state, own in alive.items():
                    to = step[state][c]
                    if to != dead:
                        more = cost[state][c]
                        nxt.setdefault(to, []).extend((b, s + more, x) for b, s, x in own if sums[z] - b - s - more >= self.threshold)
                e = at + 1
                alive = {}
                for state, own in nxt.items():
                    kept: list[tuple[float, float, int]] = []
                    for w in sorted(own, key=lambda w: w[2]):
                        if not kept or w[0] + w[1] < kept[-1][0] + kept[-1][1]:
                            if e - w[2] >= need and odd[e] > odd[w[2]] and even[e] > even[w[2]]:
                                kept.clear()
                            kept.append(w)
                    if kept:
                        alive[state] = kept
                        if e == len(sym) or is_joint[e]:
                            for b, s, x in kept:
                                score = sums[e] - b - s - end[state]
                                if score >= self.threshold and e - x >= need and odd[e] > odd[x] and even[e] > even[x] and (best is None or (-score, x, e) < best):
                                    best = (-score, x, e)
            if best:
                out.append((best[1], best[2], k, -best[0]))
        return out


def spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate runs of consecutive texts, without dots at their ends; joints() has what lies within other ends."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = _RUN[buf]
    d = np.diff(inside)
    start, end = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    cut = offs[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(buf))])
    cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    keep = end - start >= MIN_LENGTH
    start, end = start[keep], end[keep]
    while len(start) and (m := (end > start) & (buf[end - 1] == ord("."))).any():
        end = end - m
    while len(start) and (m := (end > start) & (buf[np.minimum(start, len(buf) - 1)] == ord("."))).any():
        start = start + m
    keep = end - start >= MIN_LENGTH
    return start[keep], end[keep]


def joints(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(beginning, end of its run) of the parts of those runs that have a joint."""
    if not len(start):
        return start, end
    at = np.flatnonzero(_JOINT[buf])
    run = np.searchsorted(start, at, side="right") - 1
    ok = (run >= 0) & (at < end[run])
    at, run = at[ok] + 1, run[ok]
    first = np.unique(run)
    begin, limit = np.concatenate([start[first], at]), np.concatenate([end[first], end[run]])
    long = limit - begin >= MIN_LENGTH
    return begin[long], limit[long]


def apart(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """The best spans that don't overlap, in order."""
    taken: list[tuple[int, int, int, float]] = []
    for x in sorted(found, key=lambda x: (-x[3], x[0], x[1], x[2])):
        i = bisect.bisect(taken, x)
        if not (i and taken[i - 1][1] > x[0]) and not (i < len(taken) and taken[i][0] < x[1]):
            taken.insert(i, x)
    return taken


_DIGIT, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def mixed(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which spans have letters and digits."""
    if not len(start):
        return np.zeros(0, bool)
    d, a = np.concatenate([[0], np.cumsum(_DIGIT[buf])]), np.concatenate([[0], np.cumsum(_LETTER[buf])])
    return (d[end] > d[start]) & (a[end] > a[start])


def findings(batch: pa.Array, scorer: Scorer) -> list[tuple[int, int, int, int, float]]:
    """(row, first byte, end byte, kind, score) of a column of texts, in order."""
    data, offs, _ = strings(batch)
    out = []
    for i, j in slices(offs):
        buf, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        start, end = spans(buf, o)
        sym = _SYMBOL[buf].astype(np.int64)
        kind, score = scorer.best(sym, start, end)
        hit = np.flatnonzero(kind >= 0)
        own = [(int(start[h]), int(end[h]), int(kind[h]), float(score[h])) for h in hit.tolist()]
        joint, long = _JOINT[buf], end - start > LONG_RUN
        if long.any():
            far = [scorer.long_run(sym, int(a), int(z), joint, [x for x in own if x[0] == a]) for a, z in zip(start[long], end[long], strict=True)]
            heads = set(start[long].tolist())
            own = apart([x for x in own if x[0] not in heads] + scorer.parts(sym, *joints(buf, start[~long], end[~long]), joint))
            own = sorted(own + [x for xs in far for x in xs])
        else:
            own = apart(own + scorer.parts(sym, *joints(buf, start, end), joint))
        row = np.searchsorted(o, [x[0] for x in own], side="right") - 1
        for r, (a, z, k, s) in zip(row.tolist(), own, strict=True):
            out.append((i + r, int(a - o[r]), int(z - o[r]), k, s))
    return out


def _scorer(docs: DataFrame, labelled: DataFrame | None, threshold: float) -> Scorer:
    if labelled is None:
        formats = published()
    else:
        from pyspark.sql import Window

        first = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
        own = labelled.select("value", "kind").where("value is not null and kind is not null").withColumn("n", F.row_number().over(first)).where(F.col("n") <= MAX_LABELLED)
        formats = infer([(r["value"], r["kind"]) for r in own.collect()])
    return Scorer(formats, background(docs), threshold)


def secrets(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each secret: document, characters from ``start`` to ``end``, kind and score."""
    own = keyed(docs, id_col, text_col).drop("_key")
    scorer = _scorer(own, labelled, threshold)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, col = b.column(ID), b.column(TEXT)
        rows = {"doc_id": [], "start": [], "end": [], "kind": [], "score": []}
        for row, i, j, kind, score in findings(col, scorer):
            raw = col[row].as_py().encode()
            at = len(raw[:i].decode())
            for k, v in zip(rows, (ids[row].as_py(), at, at + j - i, scorer.kinds[kind], round(score, 3)), strict=True):
                rows[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], list(rows))

    return map_arrow(own, run, SCHEMA)


def redact(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD_BITS, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, and each secret in the text replaced by ``[SECRET:kind]``."""
    scorer = _scorer(by_place(docs).select(F.col(place_of(docs, text_col)).alias(TEXT)), labelled, threshold)
    at = docs.columns.index(text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        col = b.column(at)
        by: dict[int, list] = {}
        for row, i, j, kind, _ in findings(col, scorer):
            by.setdefault(row, []).append((i, j, kind))
        if not by:
            return b
        texts = col.to_pylist()
        for row, hits in by.items():
            raw, out, last = texts[row].encode(), [], 0
            for i, j, kind in hits:
                out += [raw[last:i], f"[SECRET:{scorer.kinds[kind]}]".encode()]
                last = j
            texts[row] = b"".join([*out, raw[last:]]).decode()
        return b.set_column(at, b.schema.field(at), pa.array(texts, col.type))

    return map_rows(docs, run, docs.columns)
