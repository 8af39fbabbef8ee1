"""Probabilistic automata inferred from labelled strings by state merging (ALERGIA).

A prefix tree counts the examples; its states are merged, breadth first, where their frequencies of ending and of each next symbol
agree within Hoeffding bounds, all the way down.  Random parts of a format become loops, fixed parts stay chains.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np

#: symbols: printable ASCII one by one, 95 for all else
N_CHARS = 96
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
CLASS_OF = {c: k for k, s in enumerate(CLASSES) for c in s}
#: a character that makes up this share of a prefix's continuations is a symbol of its own there, others go by class
LITERAL_SHARE = 0.3
FLOOR_BITS = 16.0


class Pdfa:
    """Tables: ``step[state, char]`` and ``cost[state, char]`` in bits, ``end[state]`` in bits; ``shortest`` is the least length of an example."""

    def __init__(self, step: np.ndarray, cost: np.ndarray, end: np.ndarray, shortest: int = 0) -> None:
        self.step, self.cost, self.end, self.shortest = step, cost, end, shortest

    def bits(self, text: str) -> float:
        s, total = 0, 0.0
        for ch in text:
            c = ord(ch) - 32 if 32 <= ord(ch) < 127 else 95
            total += self.cost[s, c]
            s = self.step[s, c]
        return total + self.end[s]


def _tree(examples: list[str]) -> list[dict]:
    """Prefix tree: states with n (passes), f (ends), next {symbol: state}, chars {symbol: {char: count}}."""
    states = [{"n": 0, "f": 0, "next": {}, "chars": {}}]
    todo = deque([(0, examples, 0)])
    while todo:
        at, own, depth = todo.popleft()
        st = states[at]
        st["n"] = len(own)
        by: dict[str, list[str]] = {}
        for x in own:
            if len(x) == depth:
                st["f"] += 1
            else:
                by.setdefault(x[depth], []).append(x)
        groups: dict[object, list[str]] = {}
        for ch, xs in by.items():
            literal = len(xs) >= LITERAL_SHARE * len(own) or ch not in CLASS_OF
            groups.setdefault(ch if literal else CLASS_OF[ch], []).extend(xs)
        for sym, xs in groups.items():
            states.append({"n": 0, "f": 0, "next": {}, "chars": {}})
            counts: dict[str, int] = {}
            for x in xs:
                counts[x[depth]] = counts.get(x[depth], 0) + 1
            st["next"][sym], st["chars"][sym] = len(states) - 1, counts
            todo.append((len(states) - 1, xs, depth + 1))
    return states


def _differ(a: int, na: int, b: int, nb: int, bound: float) -> bool:
    return na > 0 and nb > 0 and abs(a / na - b / nb) > bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))


def learn(examples: list[str], alpha: float = 0.05) -> Pdfa:
    """The automaton of the given examples; ``alpha`` is the chance of not merging two equal states."""
    states, bound = _tree(sorted(examples)), math.sqrt(0.5 * math.log(2 / alpha))

    def compatible(a: int, b: int) -> bool:
        todo, seen = [(a, b)], {(a, b)}
        while todo:
            p, q = todo.pop()
            x, y = states[p], states[q]
            if _differ(x["f"], x["n"], y["f"], y["n"], bound):
                return False
            for sym in x["next"].keys() | y["next"].keys():
                i, j = x["next"].get(sym), y["next"].get(sym)
                ni = sum(x["chars"][sym].values()) if i is not None else 0
                nj = sum(y["chars"][sym].values()) if j is not None else 0
                if _differ(ni, x["n"], nj, y["n"], bound):
                    return False
                if i is not None and j is not None and i != j and (i, j) not in seen:
                    seen.add((i, j))  # red states have loops
                    todo.append((i, j))
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            x, y = states[p], states[q]
            x["n"] += y["n"]
            x["f"] += y["f"]
            for sym, j in list(y["next"].items()):
                mine = x["chars"].setdefault(sym, {})
                for ch, k in y["chars"][sym].items():
                    mine[ch] = mine.get(ch, 0) + k
                if sym in x["next"]:
                    if x["next"][sym] != j:
                        todo.append((x["next"][sym], j))
                else:
                    x["next"][sym] = j
                    if p in is_red:
                        blue.append((p, sym))

    red, is_red, blue = [0], {0}, deque((0, s) for s in states[0]["next"])
    while blue:
        parent, sym = blue.popleft()
        b = states[parent]["next"].get(sym)
        if b is None or b in is_red:
            continue
        for r in reversed(red):  # the nearest in depth first, so that sparse states merge within their own part of the format
            if compatible(r, b):
                states[parent]["next"][sym] = r
                fold(r, b)
                break
        else:
            red.append(b)
            is_red.add(b)
            blue.extend((b, s) for s in states[b]["next"])
    found = _tables(states, red)
    found.shortest = min(map(len, examples), default=0)
    return found


def _tables(states: list[dict], red: list[int]) -> Pdfa:
    index = {r: k for k, r in enumerate(red)}
    n = len(red)
    step = np.full((n + 1, N_CHARS), n, np.int32)  # the last state takes what was never seen
    cost = np.full((n + 1, N_CHARS), FLOOR_BITS, np.float32)
    end = np.full(n + 1, FLOOR_BITS, np.float32)
    for r, k in index.items():
        st = states[r]
        total = st["f"] + sum(sum(c.values()) for c in st["chars"].values()) or 1
        if st["f"]:
            end[k] = -math.log2(st["f"] / total)
        for sym, counts in st["chars"].items():
            to = index[st["next"][sym]]
            own = sum(counts.values())
            members = CLASSES[sym] if isinstance(sym, int) else sym
            # within a class, characters seen are smoothed; case and range (hexadecimal, base 32) show by what was never seen
            for ch in members:
                c = counts.get(ch, 0)
                p = own / total * ((c + 0.02) / (own + 0.02 * len(members))) if isinstance(sym, int) else own / total
                i = ord(ch) - 32
                bits = min(FLOOR_BITS, -math.log2(p))
                if bits < cost[k, i]:
                    step[k, i], cost[k, i] = to, bits
    return Pdfa(step, cost, end)
