"""The rewritten text out of a model's raw answer, in Arrow batches.

Layers, of which the first that finds something wins: a JSON object's ``rewrite``; that key by pattern in broken JSON; a value cut off
before its end; the plain answer.  Then remarks about the text are dropped and the length is held near the source's.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, strip, tokens

KEY = "rewrite"
_DECODER = json.JSONDecoder()
_STRICT = re.compile(rf'"{KEY}"\s*:\s*"((?:\\.|[^"\\])*)"', re.S)
_FIELD = rf'"{KEY}"\s*:\s*'
_GREEDY = re.compile(_FIELD + r'"(.+)"' + r"\s*\}", re.S)
_OPEN = re.compile(rf"[\"']?{KEY}[\"']?\s*:\s*", re.I)
_REMARK = re.compile(
    r"\b(?:"
    + "|".join(
        sorted(["explanation", "note that", "while preserving", *(f"i {v}" for v in ("kept", "changed", "rewrote")), *(f"this {n}" for n in ("rewrite", "version")), *(f"{a} version" for a in ("rewritten", "paraphrased")), *(f"the original {n}" for n in ("text",)), "original sentence", "here(?:'s| is) the rewritten"], key=len, reverse=True)
    )
    + r")\b",
    re.I,
)
_MARKERS = tuple(f"{label}:" for label in ("Rewritten", "Paraphrased text", "Corrected rewrite", "Rewritten text"))
_FENCE = "`" * 3
END = ".!?。！？"
_CUT = re.compile(rf"(?<=[{END}])\s+")
_PARAGRAPH = re.compile("\n\\s*\n")
_BLANK_FIRST = re.compile(r"\s*?\n\s*\n")
_DOUBLE, _SINGLE = "\"“”", "'‘’"
_FIRST, _LAST = (re.compile(p.format(f"[\\\\\\s{_DOUBLE}{_SINGLE}]*")) for p in ("{}", r"{}\Z"))


def first_object(text: str) -> dict | None:
    """The first place from which a whole JSON object can be read."""
    at = text.find("{")
    while at >= 0:
        try:
            found, _ = _DECODER.raw_decode(text, at)
            if isinstance(found, dict):
                return found
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return None


def loose_string(value: str) -> str:
    """A JSON string's content, decoded as far as it goes."""
    value = value.strip()
    try:
        return json.loads(f'"{value}"') if value else ""
    except ValueError:
        for code, char in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\\\", "\\")):
            value = value.replace(code, char)
        return value


def without_fence(answer: str) -> str:
    text = answer.strip()
    if text.startswith(_FENCE):
        text = text[3:].lstrip() if text[3:7].lower() != "json" else text[7:].lstrip()
    return text.removesuffix(_FENCE).strip()


def by_pattern(text: str) -> str | None:
    """The longer of the values up to the first and to the last quotation mark."""
    found = []
    for pattern in (_STRICT, _GREEDY):
        if m := pattern.search(text):
            try:
                value = json.loads(f'"{m[1]}"')
            except ValueError:
                value = m[1]
            if value.strip():
                found.append(value)
    return max(found, key=lambda v: len(v.strip()), default=None)


def cut_off(text: str) -> str | None:
    """A value whose end is missing, in what began as JSON; empty if nothing of it is there."""
    raw = without_fence(text)
    m = _OPEN.search(raw)
    if m is None or not re.search(r"\{|json", raw[: m.start()], re.I):
        return None
    tail = raw[m.end() :].lstrip()
    tail = tail[1:] if tail[:1] in ("'", '"') and tail else tail
    tail = re.sub(r"[\s,]*\}+\s*$", "", tail.rstrip().removesuffix(_FENCE)).strip()
    return "" if tail in ('"', "'") else loose_string(tail)


def raw_rewrite(answer: str, source: str) -> str:
    found = (first_object(answer) or {}).get(KEY)
    if isinstance(found, str) and found.strip():
        return found
    if value := by_pattern(answer):
        return value
    value = found if isinstance(found, str) else cut_off(answer)
    if value is not None:  # a blank value is no text, and what stands around it isn't either
        return value
    raw, src = without_fence(answer), source.strip()
    if _BLANK_FIRST.match(answer) and _REMARK.search(_PARAGRAPH.split(raw)[0]):  # a remark about nothing
        return ""
    if raw[:1] == "{" and raw[-1:] == "}" and src[:1] != "{" and src[-1:] != "}":
        return raw[1:-1].strip()
    return raw or answer


def until_remark(parts: list[str]) -> list[str]:
    """Parts up to the first, not counting the very first, that talks about the text."""
    end = next((i for i, p in enumerate(parts) if i and _REMARK.search(p)), len(parts))
    return parts[:end]


def clean(answer: str, source: str) -> str:
    src, text = source.strip(), answer.strip()
    for marker in _MARKERS:
        if marker in text:
            text = text.partition(marker)[2].strip()
    if not text:
        return src
    paras = list(filter(None, map(str.strip, _PARAGRAPH.split(text))))
    if paras:
        text = paras[0] if any(map(_REMARK.search, paras[1:])) else "\n\n".join(paras)
    text = " ".join(until_remark([x.strip() for x in text.split("\n") if x.strip()])) or text
    sents = [s.strip() for s in _CUT.split(text) if s.strip()]
    if len(src) <= 20 and len(sents) > 1:
        text = sents[0]
    elif sents:
        most = max(1, len(re.findall(f"[{END}]+", src))) + 1
        text = " ".join(until_remark(sents)[:most])
    # quotation marks are stripped only of kinds that aren't among those the source begins or ends with; a blank source says nothing of them
    marks = lambda edge: " " + "".join(k for k in (_DOUBLE, _SINGLE) if src and not set(edge) & set(k))
    text = text.lstrip(marks(_FIRST.match(src)[0])).rstrip(marks(_LAST.search(src)[0]))
    return length_guard(text, source) or src


def length_guard(text: str, source: str) -> str:
    """Text cut to a length near its source's, at a sentence's end if that isn't too early."""
    src, text = source.strip(), text.strip()
    if not src or not text:
        return text or src
    n, c = len(src.split()), len(src)
    most_words = max(n + 3, 2 * n) if n <= 3 else max(n + 8, int(n * 1.35))
    most_chars = max(c + 18, int(c * 2.2)) if n <= 3 else max(c + 40, int(c * 1.45))
    words = text.split()
    if len(words) > most_words:
        text = " ".join(words[:most_words])
    if len(text) > most_chars:
        text = text[:most_chars].rstrip(" ,;:-")
        end = max(map(text.rfind, END))
        if end >= max(10, most_chars // 2):
            text = text[: end + 1]
    return text.strip() or src


def _both(fn):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else fn(x, y or "") for x, y in zip(a, b, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")


def extract_rewrite(answer: Column, source: Column) -> Column:
    """The cleaned rewrite; null for a null answer."""
    return _both(lambda a, s: clean(raw_rewrite(a, s), s))(answer, source)


def guard_length(text: Column, source: Column) -> Column:
    """length_guard as an expression; null for null text."""

    def guard(v: Column) -> Column:
        t, s, ws = v["t"], v["s"], v["ws"]
        n, c = v["n"], F.length(s)
        limit = lambda few, far, near, share, x: F.when(n <= 3, F.greatest(x + few, F.floor(x * far).cast("int"))).otherwise(F.greatest(x + near, F.floor(x * share).cast("int")))
        most = limit(3, 2.0, 8, 1.35, n)
        cut = F.when(F.size(ws) > most, F.array_join(F.slice(ws, 1, most), " ")).otherwise(t)

        def by_chars(u: Column) -> Column:
            room = u["room"]
            short = F.regexp_replace(F.substring(u["x"], F.lit(1), room), "[ ,;:-]+\\z", "")

            def at_end(x: Column) -> Column:
                before = F.length(F.regexp_extract(x, f"(?s)^(.*)[{END}]", 1))
                late = x.rlike(f"[{END}]") & (before >= F.greatest(F.lit(10), F.floor(room / 2)))
                return F.when(late, F.substring(x, F.lit(1), before + 1)).otherwise(x)

            return F.when(F.length(u["x"]) > room, let(short, at_end)).otherwise(u["x"])

        held = strip(let(F.struct(cut.alias("x"), limit(18, 2.2, 40, 1.45, c).alias("room")), by_chars))
        return F.when((t == "") | ((s != "") & (held == "")), s).when(s == "", t).otherwise(held)

    t, s = strip(text), strip(F.coalesce(source, F.lit("")))
    return F.when(text.isNotNull(), let(F.struct(t.alias("t"), s.alias("s"), tokens(t).alias("ws"), F.size(tokens(s)).alias("n")), guard))


def response_text(raw: Column) -> Column:
    """The text of a stored answer: a chat message as a string or as parts, or a list of content blocks."""
    chat = F.get_json_object(raw, "$.choices[0].message.content")
    parts = F.from_json(F.coalesce(F.when(chat.startswith("["), chat), F.get_json_object(raw, "$.content")), "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"]), "")
    return F.coalesce(F.when(~chat.startswith("["), chat), joined)
