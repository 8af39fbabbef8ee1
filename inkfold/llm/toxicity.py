"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon's trie and the Levenshtein automaton of each term are intersected to one deterministic automaton over case-folded
characters, which all words of a text run through at once.  An edit is an insertion, a deletion, a substitution or a swap of two
neighbours; terms from MIN_FUZZY characters on allow one, from MIN_FUZZY2 on two.  Shorter terms from MIN_VARIED on allow a swap of
neighbours, a digit for a letter or a doubled letter, as terms of their own in the trie.  Accepting states tell exact terms from
misspelled ones.  Words of ordinary use (ORDINARY, and those of labelled clean documents) are never taken as misspellings.

Each hit counts 1, or FUZZY if misspelled; in quotation marks or after a word of reporting it counts QUOTED of that; with a
second-person word within WINDOW words DIRECT times as much.  A document is toxic from THRESHOLD on, so one misspelled term that
nobody is quoted with is enough.  Quotation marks count if the last one before on the line and the first one after are a pair, no
more than QUOTE_BYTES away, or if the line has an odd number of straight ones before; apostrophes only beside the word.

The lexicon is the given terms (BASE) and those that labelled documents teach: words that a MIN_RATIO times greater share of toxic
documents has than of clean ones, in at least MIN_CONTEXTS different contexts, so that copies of one document teach nothing.  At most MAX_LABELLED labelled
documents, by hash, are read for that.  Learned terms are found as they are: the labels teach their variants, and what else resembles
them has no evidence against it.  A term of a script written without spaces is found as that run of characters.

Defined results: null and empty texts have score 0 and aren't toxic; a text of any length is judged whole; repeated rows are judged
each; a document labelled more than once or contradictorily counts as toxic if any label says so; labels with a null id or a null
mark count as none; no labels leave BASE; an empty table gives no rows.  Other columns, whatever their names, are of no account.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, LAST, TEXT, code_points, fold_case, keyed, map_arrow, mix, slices, strings, table, words

BASE = (
    "idiot", "moron", "stupid", "loser", "pathetic", "worthless", "scum", "trash", "clown", "disgusting", "imbecile", "dumbass",
    "asshole", "bastard", "bitch", "bullshit", "cretin", "dimwit", "douchebag", "dumb", "fool", "freak", "fuck", "fucker", "fucking",
    "garbage", "halfwit", "jackass", "jerk", "lowlife", "maggot", "motherfucker", "nitwit", "parasite", "piss", "prick", "retard",
    "retarded", "scumbag", "shit", "shithead", "slut", "subhuman", "vermin", "whore", "arschloch", "abschaum", "blödmann", "dummkopf",
    "hurensohn", "trottel", "vollidiot", "wichser", "connard", "connasse", "salope", "ordure", "crétin", "abruti", "enculé",
    "imbécile", "débile", "gilipollas", "cabrón", "imbécil", "idiota", "estúpido", "estúpida", "basura", "pendejo", "puta", "escoria",
)
#: ordinary words that are within an edit or two of a term
ORDINARY = (
    "apathetic athletic batch birch boron botch brash break brick bustard butch chore closer closet crash creak crown discussing ditch "
    "ducking empathetic flown frank freaky fresh garage hitch idiom idioms loose loosen loser's losers loses losing lover lower maroon mirthless "
    "parasites pitch price pricked regard regarded retained retarding reward rewarded salon shore slope sucking thrash trick tucking where "
    "witch worthiness wildlife blown foot food feel full pool tool wool cool fuel jerky fort form shot shut ship skit dump dumb's thumb"
).split()
MIN_VARIED, MIN_FUZZY, MIN_FUZZY2 = 4, 5, 10
FUZZY, QUOTED, DIRECT, WINDOW, THRESHOLD = 0.7, 0.3, 1.5, 5, 0.7
QUOTE_BYTES = 400
MAX_LABELLED = 20_000
MIN_CONTEXTS, MIN_RATIO = 6, 50.0
YOU = frozenset("you your yours yourself youre u ur du dich dir dein deine euch ihr tu toi te ton ta vous votre tú ti tu usted vosotros".split())
SAYING = frozenset("said says say called calls call wrote writes word words term terms quote quoted quotes phrase insult slur sagte nannte wort dit appelé mot dijo llamó palabra".split())
#: what may close a quotation that a mark opens
PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "›": "‹", "‘": "’", "‚": "‘’"}
MARKS = frozenset("".join([*PAIRS, *PAIRS.values()]))
SCHEMA = "doc_id long, n_hits int, n_fuzzy int, n_quoted int, score double, toxic boolean, terms array<string>"
SKIP = 1  # symbol of UTF-8 continuation bytes


def edits(length: int) -> int:
    """How many edits a term of so many characters allows."""
    return (length >= MIN_FUZZY) + (length >= MIN_FUZZY2)


def varied(term: str) -> set[str]:
    """The misspellings of a short term."""
    swaps = {term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(len(term) - 1)}
    digits = {term[:i] + d + term[i + 1 :] for i in range(len(term)) for d in "0123456789"}
    doubled = {term[:i] + term[i] + term[i:] for i in range(len(term))}
    return (swaps | digits | doubled) - {term}


def minimal(step: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The automaton with states of equal behaviour merged, by refinement; states 0 and 1 keep their numbers."""
    weights = np.random.default_rng(1).integers(1, 1 << 62, step.shape[1] + 1, np.int64) | 1
    own = np.unique(kind, return_inverse=True)[1]
    while True:
        with np.errstate(over="ignore"):
            key = own * weights[0] + (mix(own.astype(np.uint64) + np.uint64(1)).view(np.int64)[step] * weights[1:]).sum(axis=1)
        new = np.unique(key, return_inverse=True)[1]
        if new.max() == own.max():
            break
        own = new
    _, first = np.unique(own, return_index=True)
    order = [own[0], own[1], *(c for c in own[np.sort(first)].tolist() if c not in (own[0], own[1]))] if own[0] != own[1] else None
    if order is None:  # nothing is accepted
        return np.array([[0] * step.shape[1], [0] * step.shape[1]], np.int32), np.zeros(2, np.int64)
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order))
    keep = first[np.array(order)]
    return number[own[step[keep]]], kind[keep]


class Automaton:
    """Trie and Levenshtein automata intersected: ``step[state, symbol]``, ``accepts[state]`` and ``exact[state]``; state 0 is dead, 1 the first."""

    def __init__(self, terms: list[str], learned: list[str] = (), ordinary: set[str] = frozenset()) -> None:
        fuzzy = {t.lower() for t in terms if t}
        self.terms = sorted(fuzzy | {t.lower() for t in learned})
        self.ordinary = frozenset(ordinary) | frozenset(ORDINARY)
        self.runs = sorted({len(t) for t in self.terms if len(t) > 1 and _unspaced(t)})
        children: list[dict[str, int]] = [{}]
        ends: dict[int, tuple[int, int]] = {}  # node -> (0 or 1 for a variant, term)
        reach: list[int] = [0]  # edits that a term at or below the node allows
        known = set(self.terms)
        most = [edits(len(t)) if t in fuzzy else 0 for t in self.terms]
        entries = [(t, most[k], (0, k)) for k, t in enumerate(self.terms)]
        entries += [(v, 0, (1, k)) for k, t in enumerate(self.terms) if t in fuzzy and MIN_VARIED <= len(t) < MIN_FUZZY for v in sorted(varied(t) - known)]
        for word, allowed, mark in entries:
            at = 0
            for ch in word:
                reach[at] = max(reach[at], allowed)
                nxt = children[at].get(ch)
                if nxt is None:
                    nxt = children[at][ch] = len(children)
                    children.append({})
                    reach.append(0)
                at = nxt
            reach[at] = max(reach[at], allowed)
            ends.setdefault(at, mark)
        chars = sorted({c for w, _, _ in entries for c in w})
        self.symbol = {c: i + 2 for i, c in enumerate(chars)}
        n_symbols = len(chars) + 2

        # an item is (node, character that a swap still owes or "", edits); of equal first parts the least edits count
        def close(raw: dict[tuple[int, str], int]) -> tuple:
            """After deletions of term characters."""
            todo = [(n, e) for (n, owed), e in raw.items() if not owed]
            while todo:
                node, e = todo.pop()
                if raw[node, ""] < e or reach[node] <= e:
                    continue
                for child in children[node].values():
                    if reach[child] > e and raw.get((child, ""), 9) > e + 1:
                        raw[child, ""] = e + 1
                        todo.append((child, e + 1))
            return tuple(sorted(raw.items()))

        def move(items: tuple, ch: str | None) -> tuple:
            nxt: dict[tuple[int, str], int] = {}

            def reached(node: int, owed: str, e: int) -> None:
                if nxt.get((node, owed), 9) > e:
                    nxt[node, owed] = e

            for (node, owed), e in items:
                if owed:
                    if owed == ch:
                        reached(node, "", e)
                    continue
                below = children[node]
                if ch in below:
                    reached(below[ch], "", e)
                if reach[node] > e:
                    for c, other in below.items():
                        if reach[other] > e and c != ch:
                            reached(other, "", e + 1)  # substitution
                            far = children[other].get(ch)
                            if far is not None and reach[far] > e:
                                reached(far, c, e + 1)  # the first half of a swap
                    reached(node, "", e + 1)  # insertion
            return close(nxt)

        first = close({(0, ""): 0})
        index, order, rows = {(): 0, first: 1}, [(), first], [[0] * n_symbols]
        at = 1
        while at < len(order):
            items = order[at]
            live = {o for (_, o), _ in items if o}
            for (node, owed), e in items:
                if not owed:
                    live.update(children[node])
                    if reach[node] > e:
                        for other in children[node].values():
                            live.update(children[other])
            other = move(items, None)
            row = [index.setdefault(other, len(index))] * n_symbols
            if len(index) > len(order):
                order.append(other)
            row[SKIP] = at
            for c in live:
                to = move(items, c)
                row[self.symbol[c]] = index.setdefault(to, len(index))
                if len(index) > len(order):
                    order.append(to)
            rows.append(row)
            at += 1
        accepts = np.zeros(len(order), np.int64)  # 1: misspelled, 2: exact
        for i, items in enumerate(order):
            hits = [(ends[n][0], e) for (n, owed), e in items if not owed and n in ends and (e == 0 or not ends[n][0] and e <= most[ends[n][1]])]
            if hits:
                accepts[i] = 2 if min(hits) == (0, 0) else 1
        self.step, accepts = minimal(np.array(rows, np.int32), accepts)
        self.accepts, self.exact = accepts > 0, accepts == 2
        self.ascii = np.zeros(256, np.int16)
        self.beyond = np.zeros(LAST, np.int16)
        for c, s in self.symbol.items():
            if ord(c) < 128:
                self.ascii[ord(c)] = s
            elif ord(c) < LAST:
                self.beyond[ord(c)] = s
        self.ascii[128:192] = SKIP

    def symbols(self, low: np.ndarray) -> np.ndarray:
        sym = self.ascii[low]
        at, cp, _ = code_points(low)
        sym[at] = self.beyond[cp]
        return sym

    def run(self, sym: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of a word, its last state) of those words that are accepted."""
        live = np.arange(len(start))
        at, stop, state = start.astype(np.int64), end, np.ones(len(start), np.int32)
        found, last = [], []
        while len(live):
            state = self.step[state, sym[at]]
            at = at + 1
            ok = state > 0
            live, at, stop, state = live[ok], at[ok], stop[ok], state[ok]
            done = at == stop
            if done.any():
                hit = done & self.accepts[state]
                found.append(live[hit]), last.append(state[hit])
                ok = ~done
                live, at, stop, state = live[ok], at[ok], stop[ok], state[ok]
        f, s = (np.concatenate(found), np.concatenate(last)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        order = np.argsort(f)
        return f[order], s[order]


def _unspaced(term: str) -> bool:
    raw = np.frombuffer(term.encode(), np.uint8)
    return len(words(raw, np.array([0, len(raw)]))[0]) == len(term)


class Quotes:
    """The quotation marks of consecutive texts."""

    def __init__(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        at, cp, size = code_points(low)
        m = np.isin(cp, [ord(c) for c in MARKS])
        inner = np.isin(at[m], end) & np.isin((at + size)[m], start) & (cp[m] == ord("’"))  # an apostrophe within a word
        self.at, self.mark = at[m][~inner], [chr(c) for c in cp[m][~inner]]
        self.straight = np.concatenate([[0], np.cumsum(low == 34)])
        self.feeds = np.flatnonzero(low == 10)
        self.low = low

    def around(self, start: int, end: int, text_start: int, text_end: int) -> bool:
        """Whether a word stands within a quotation."""
        low, k = self.low, int(np.searchsorted(self.feeds, start))
        begin = max(text_start, int(self.feeds[k - 1]) + 1 if k else 0)
        stop = min(text_end, int(self.feeds[k]) if k < len(self.feeds) else len(low))
        beside = (low[start - 1] if start > begin else 0, low[end] if end < stop else 0)
        if beside[0] == beside[1] and beside[0] in b"'`" and beside[0]:
            return True
        n = self.straight
        if (n[start] - n[begin]) % 2 and n[stop] > n[end]:
            return True
        i = int(np.searchsorted(self.at, start))
        if i == 0 or i == len(self.at):
            return False
        a, z = int(self.at[i - 1]), int(self.at[i])
        return a >= max(begin, start - QUOTE_BYTES) and z < min(stop, end + QUOTE_BYTES) and self.mark[i] in PAIRS.get(self.mark[i - 1], "")


def judge(data: np.ndarray, offs: np.ndarray, auto: Automaton):
    """Hits of consecutive texts: (row, word, exact, quoted, direct) in order."""
    out = []
    for i, j in slices(offs):
        buf, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        if not len(buf):
            continue
        low = fold_case(buf)
        start, end, _, first = words(buf, o, low)
        sym = auto.symbols(low)
        which, state = auto.run(sym, start, end)
        last = which
        for n in auto.runs:  # terms of scripts whose words are single characters
            if len(start) >= n:
                k = np.flatnonzero(start[n - 1 :] - end[: len(end) - n + 1] == 0) if n == 2 else np.flatnonzero(np.convolve(start[1:] == end[:-1], np.ones(n - 1), "valid") == n - 1)
                w, s = auto.run(sym, start[k], end[k + n - 1])
                exact = auto.exact[s]
                which, last, state = np.concatenate([which, k[w[exact]]]), np.concatenate([last, k[w[exact]] + n - 1]), np.concatenate([state, s[exact]])
        if not len(which):
            continue
        if auto.runs:
            sort = np.lexsort((last, which))
            which, last, state = which[sort], last[sort], state[sort]
        raw, quotes = low.tobytes(), Quotes(low, start, end)
        rows = np.searchsorted(first, which, side="right") - 1
        for k, z, s, r in zip(which.tolist(), last.tolist(), state.tolist(), rows.tolist(), strict=True):
            word = raw[start[k] : end[z]].decode(errors="replace")
            if not auto.exact[s] and word in auto.ordinary:
                continue
            lo, hi = max(int(first[r]), k - WINDOW), min(int(first[r + 1]), z + WINDOW + 1)
            near = [raw[start[x] : end[x]].decode(errors="replace") for x in range(lo, hi)]
            said = any(w in SAYING for w in near[: k - lo][-3:])
            out.append((i + r, word, bool(auto.exact[s]), said or quotes.around(int(start[k]), int(end[z]), int(o[r]), int(o[r + 1])), any(w in YOU for w in near)))
    return out


def taught(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Automaton:
    """The automaton of BASE and the terms that labelled documents teach, with their ordinary words within reach of a misspelling."""
    own = keyed(docs, id_col, text_col)
    marks = labels.select(F.col("doc_id").cast("long").alias(ID), (F.col("toxic") > 0).alias("toxic")).where(F.col(ID).isNotNull() & F.col("toxic").isNotNull()).groupBy(ID).agg(F.max("toxic").alias("toxic"))
    # a bounded sample by hash: the least hashes, whatever the layout
    chosen = marks.withColumn("h", F.xxhash64(ID)).orderBy("h", ID).limit(MAX_LABELLED).select(ID, "toxic")
    split = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    texts = own.join(F.broadcast(chosen), ID).groupBy("_key").agg(F.max("toxic").alias("toxic"), F.first(TEXT).alias("text")).select(F.col("_key").alias("id"), "toxic", split.alias("w"))
    texts = table(texts, "labelled-words")
    n = texts.groupBy().agg(F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0)).alias("a"), F.coalesce(F.sum((~F.col("toxic")).cast("int")), F.lit(0)).alias("b")).first()
    pairs = texts.where("toxic").select("id", F.explode(F.expr("zip_with(w, concat(array(''), w), (x, y) -> struct(x as word, xxhash64(y) as before))")).alias("p")).select("id", "p.word", "p.before").where("word is not null and length(word) >= 4")
    # a word counts once a document, however often it stands there
    bad = pairs.groupBy("word").agg(F.count_distinct("before").alias("contexts"), F.count_distinct("id").alias("a"))
    good = texts.where("not toxic").select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count("*").alias("b"))
    both = table(good.join(bad, "word", "full"), "labelled-counts").fillna(0)
    ratio = ((F.col("a") + 0.1) / (n["a"] + 1)) / ((F.col("b") + 0.1) / (n["b"] + 1))
    rows = both.where((F.col("contexts") >= MIN_CONTEXTS) & (ratio >= MIN_RATIO)).select("word").collect()
    terms = sorted(r["word"] for r in rows)
    common = both.where((F.col("b") > 0) & (ratio < MIN_RATIO)).select("word")
    auto = Automaton(list(BASE), terms)
    auto.ordinary |= _reached(common, auto)
    return auto


def _reached(common: DataFrame, probe: Automaton) -> set[str]:
    """Ordinary words that the automaton would take: only these have to be known, and they are few whatever the text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offs, _ = strings(b.column(0))
        buf, o = data[offs[0] : offs[-1]], offs - offs[0]
        which, state = probe.run(probe.symbols(fold_case(buf)), o[:-1], o[1:])
        return b.take(pa.array(which[~probe.exact[state]]))

    return {r["word"] for r in map_arrow(common.where("length(word) > 0"), run, "word string").collect()}


def toxicity(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: hits, score, verdict and the distinct words that were hit, sorted."""
    auto = taught(docs, labels, id_col, text_col) if labels is not None else Automaton(list(BASE))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.num_rows
        data, offs, _ = strings(b.column(TEXT))
        hits, fuzzy, quot, score = (np.zeros(n, t) for t in (np.int32, np.int32, np.int32, np.float64))
        found: list[set] = [set() for _ in range(n)]
        for row, word, exact, in_quotes, direct in judge(data, offs, auto):
            hits[row] += 1
            fuzzy[row] += not exact
            quot[row] += in_quotes
            score[row] += (1.0 if exact else FUZZY) * (QUOTED if in_quotes else DIRECT if direct else 1.0)
            found[row].add(word)
        score = score.round(6)
        return pa.RecordBatch.from_arrays([b.column(ID), pa.array(hits), pa.array(fuzzy), pa.array(quot), pa.array(score), pa.array(score >= THRESHOLD), pa.array([sorted(x) for x in found], pa.list_(pa.string()))], ["doc_id", "n_hits", "n_fuzzy", "n_quoted", "score", "toxic", "terms"])

    return map_arrow(keyed(docs, id_col, text_col).drop("_key"), run, SCHEMA)
