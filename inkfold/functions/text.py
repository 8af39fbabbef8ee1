"""Text expressions whose semantics don't depend on the engine's idea of a word or of white space.

A word character is a letter, a number or an underscore of any script; white space is every Unicode space.  Edges of words in the
rules' patterns are those of SQL's engine, which sees them at ASCII letters only ("Übeen" has one before its b).  All are plain Column
expressions with literal patterns, so that they are compiled once and stay in the JVM.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
#: a letter of ASCII is told by one comparison to be a word character, and any visible ASCII character to be no space
W, S = f"[a-zA-Z[{WORD}]]", f"[[^!-~]&&[{SPACE}]]"
#: edges of words as RE2 has them, and so SQL: between what is an ASCII letter, a digit or an underscore and what isn't, in any case mode
_EDGED = "(?-iu:[0-9A-Za-z_])"
NOT_BEFORE, NOT_AFTER = f"(?<!{_EDGED})", f"(?!{_EDGED})"
EDGE = f"(?:(?<={_EDGED})(?!{_EDGED})|(?<!{_EDGED})(?={_EDGED}))"


def quote(literal: str) -> str:
    """A literal for Java's and RE2's regular expressions."""
    return re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", literal)


def bounded(phrase: str) -> str:
    """The phrase between word edges, any case."""
    left = NOT_BEFORE if re.match(r"\w", phrase) else f"(?<={_EDGED})"
    right = NOT_AFTER if re.search(r"\w$", phrase) else f"(?={_EDGED})"
    return f"(?iu){left}{quote(phrase)}{right}"


_SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: no white space; the printable ASCII characters are told by one comparison
SOLID = f"[!-~[^{SPACE}]]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def rstrip_lines(c: Column) -> Column:
    return F.regexp_replace(c, f"(?d)[{SPACE}&&[^\\n]]+(?=\\n|\\z)", "")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, f"{S}+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    """Number of runs without white space; 0 for empty text.

    Where single blanks or line feeds part the words, as nearly always, these are counted; a match of a pattern costs far more.
    """
    odd = f"[[^ -~]&&[{SPACE}]]"

    def count(t: Column) -> Column:
        plain = ~(t.contains("  ") | t.startswith(" ") | t.endswith(" ") | t.rlike(odd))
        return F.when(t == "", 0).when(plain, F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).otherwise(F.regexp_count(t, F.lit(f"{SOLID}+")))

    return let(F.replace(c, F.lit("\n"), F.lit(" ")), count)


def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@functools.cache
def _composable() -> str:
    """A class of the characters that composition can change: marks, vowels and finals of Hangul, and those that aren't composed alone."""
    ranges: list[list[int]] = []
    for cp in range(0x300, 0x30000):
        if not 0xD800 <= cp < 0xE000 and unicodedata.normalize("NFC", chr(cp)) != chr(cp):
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1][1] = cp
            else:
                ranges.append([cp, cp])
    return "[\\p{M}\\x{1161}-\\x{1175}\\x{11A8}-\\x{11C2}" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def nfc(c: Column) -> Column:
    """Composed characters.  Python gets the texts in which there is something to compose, and nulls for the others."""
    todo = c.rlike(r"[^\x00-\u02ff]") & c.rlike(_composable())  # nothing below U+0300 is changed alone
    return F.coalesce(F.pandas_udf(_nfc, "string")(F.when(todo, c)), c)


INVISIBLE = "﻿​‌‍­  �" + "".join(map(chr, [*range(0, 9), 11, 12, *range(14, 32), 127]))
BREAK = "\n" * 2


def clean_text(c: Column, *, compose: bool = True) -> Column:
    """Sanitised text: composed, without invisible and control characters, with normal line ends and paragraph breaks."""
    t = nfc(c) if compose else c
    t = F.translate(t, INVISIBLE, "")
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = rstrip_lines(t)
    t = F.regexp_replace(t, "\n+", BREAK)  # lone line ends are promoted and long gaps shortened: either way two remain
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    t = F.regexp_replace(t, r"([~;:,.?!-])\1{4,}", "$1$1$1")
    return strip(t)


CUT = "\ufdd1"


def sentences(c: Column) -> Column:
    """Sentences: cut at white space after a full stop, an exclamation or a question mark."""
    marked = F.regexp_replace(strip(c), f"([.!?]){S}+", f"$1{CUT}")
    return F.filter(F.split(marked, CUT, -1), lambda s: s != "")


def exploded(df: DataFrame, array: str, at: str, item: str, *keep: str) -> DataFrame:
    """The columns to keep, and place and item of each element of an array that isn't null.

    A plain explode makes the optimizer filter by the array's size beneath, which computes a costly array again and again; the outer
    one doesn't, and its rows without a place go here.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(at, item)).where(F.col(at).isNotNull())


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where ``body`` uses it within a lambda."""
    return F.transform(F.array(value), body)[0]


def spans(text: Column, pattern: str | Column) -> Column:
    """Every match of a pattern that never matches empty, as ``array<struct<start, end>>`` of code points."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    none = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    def found(hits: Column) -> Column:
        pairs = F.arrays_zip(F.slice(F.split(text, pattern, F.lit(-1)), 1, F.size(hits)).alias("p"), hits.alias("m"))
        return F.when(F.size(hits) > 0, F.aggregate(pairs, zero, step, lambda acc: acc["out"])).otherwise(none)

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), found)


#: letters, the rarest first
_RARE = "zqxjkvbpygfwmuclrdhsnioate"


def anchor(phrase: str) -> str:
    """The end of a phrase that begins with its rarest letter, of three characters at least."""
    at = min(range(max(1, len(phrase) - 2)), key=lambda i: _RARE.find(phrase[i]) if phrase[i] in _RARE else 99)
    return phrase[at:]


def anchors(phrases: tuple[str, ...]) -> dict[str, str]:
    """An anchor for each phrase that a text with the phrase contains; none begins with another."""
    own = {p: anchor(p) for p in phrases}
    short = {a: min((b for b in own.values() if a.startswith(b)), key=len) for a in own.values()}
    return {p: short[a] for p, a in own.items()}


def anchored(phrases: tuple[str, ...]) -> str:
    """A pattern of the places of all anchors, overlapping ones too, each as group 1; most places are told by one look at a letter."""
    every = sorted(set(anchors(phrases).values()), key=lambda a: -_RARE.find(a[0]))  # the more frequent are tried first
    return f"(?=[{''.join(sorted({a[0] for a in every}))}])(?=({any_of(every)}))"


def any_of(words: list[str]) -> str:
    """A pattern of one of the words, none of which begins with another, as a tree of their characters: one step where a list of
    alternatives takes one for each word."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    each = []
    for c, rest in by.items():
        while rest[0] and all(r[:1] == rest[0][0] for r in rest):  # what all have in common
            c, rest = c + rest[0][0], [r[1:] for r in rest]
        each.append(quote(c) + (any_of(rest) if rest[0] else ""))
    return each[0] if len(each) == 1 else f"(?:{'|'.join(each)})"


def around(text: Column, span: Column, left: int, right: int) -> Column:
    """The text from ``left`` characters before a span to ``right`` after it."""
    begin = F.greatest(span["start"] - left, F.lit(0))
    return F.substring(text, begin + 1, span["end"] + right - begin)
