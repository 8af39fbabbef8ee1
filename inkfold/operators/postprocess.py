"""Deterministic clean-up of texts, as Column expressions in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BREAK, SPACE, S, let, rstrip_lines, tokens


def fix_punctuation(c: Column) -> Column:
    """Dashes become commas and semicolons full stops with a capital after; runs of both are collapsed."""
    t = F.regexp_replace(c, f"{S}*[—–]{S}*", ", ")
    t = F.regexp_replace(t, f"{S}+--{S}+", ", ")
    capital = lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p))))
    t = F.array_join(F.transform(F.split(t, f";{S}*(?=[a-zA-Z])", -1), capital), ". ")
    t = F.translate(t, ";", ".")
    t = F.regexp_replace(t, f",{S}*,", ",")
    return F.regexp_replace(t, f"\\.({S}*\\.)+", ".")


def fix_whitespace(c: Column) -> Column:
    t = F.regexp_replace(c, f"[{SPACE}&&[^\\n]]{{2,}}", " ")
    return F.regexp_replace(rstrip_lines(t), "\n{3,}", BREAK)


def fix_curly_quotes(c: Column) -> Column:
    return F.translate(c, "“”‘’", "\"\"''")


EMOJI = r"[\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{2702}-\x{27B0}\x{FE00}-\x{FE0F}]+"


def fix_emojis(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, EMOJI, ""), "  +", " ")


BOLD = r"\*\*([^*]+)\*\*"
BOLD_MOST = 3


def fix_excessive_bold(c: Column) -> Column:
    """All bold marks go where there are more than BOLD_MOST."""
    return let(c, lambda t: F.when(F.regexp_count(t, F.lit(BOLD)) > BOLD_MOST, F.regexp_replace(t, BOLD, "$1")).otherwise(t))


def fix_inline_header_lists(c: Column) -> Column:
    return F.regexp_replace(c, f"(?md)^({S}*[-*]{S}+)\\*\\*([^*:]+):?\\*\\*:?{S}*", "$1$2 ")


HEADING = f"(?d)^(#{{1,6}}){S}+(.+)$"


def _all_upper(w: Column) -> Column:
    return (F.upper(w) == w) & (F.lower(w) != w)


def _sentence_case(line: Column) -> Column:
    words = tokens(F.regexp_extract(line, HEADING, 2))
    rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    eligible = F.filter(rest, lambda w: (F.length(w) > 3) & ~_all_upper(w))
    first = lambda w: F.substring(w, 1, 1)
    capital = F.filter(eligible, lambda w: _all_upper(first(w)))
    new = F.transform(words, lambda w, i: F.when((i == 0) | _all_upper(w), w).otherwise(F.lower(w)))
    change = (F.size(eligible) > 0) & (F.size(capital) >= 0.6 * F.size(eligible))
    return F.when(change, F.concat_ws(" ", F.regexp_extract(line, HEADING, 1), F.array_join(new, " "))).otherwise(line)


def fix_title_case_headings(c: Column) -> Column:
    """Headings of which most longer words are capitalised are put in sentence case."""
    lines = F.transform(F.split(c, "\n", -1), lambda x: F.when(x.rlike(HEADING), _sentence_case(x)).otherwise(x))
    return F.array_join(lines, "\n")


STEPS = (
    ("punctuation", fix_punctuation, "punctuation fixed"),
    ("whitespace", fix_whitespace, "white space normalised"),
    ("curly_quotes", fix_curly_quotes, "quotation marks straightened"),
    ("emojis", fix_emojis, "emojis removed"),
    ("excessive_bold", fix_excessive_bold, "bold marks removed"),
    ("inline_header_lists", fix_inline_header_lists, "list headers simplified"),
    ("title_case_headings", fix_title_case_headings, "headings put in sentence case"),
)


def post_process(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``fixed`` and ``changes``, the messages of the steps that changed something."""
    out, before = df, F.col(text_col)
    for name, fix, _ in STEPS:
        out = out.withColumn(f"__{name}", fix(before))
        before = F.col(f"__{name}")
    names = [text_col, *[f"__{n}" for n, _, _ in STEPS]]
    said = F.array(*[F.when(F.col(a) != F.col(b), F.lit(m)) for a, b, (_, _, m) in zip(names[:-1], names[1:], STEPS, strict=True)])
    return out.withColumns({"fixed": before, "changes": F.array_compact(said)}).drop(*names[1:])
