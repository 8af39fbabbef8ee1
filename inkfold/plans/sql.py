"""The rules and summaries in SQL, for comparison with another engine."""

from __future__ import annotations

from ..functions.lexicon import ABSTRACT_NOUNS, ANYWHERE, BOUNDED, COLLOQUIAL, PARTICIPLES, PHRASES, RULES
from ..functions.text import quote
from ..operators.severity import LEVELS
from .planted import sql_literal

W = r"[\p{L}\p{N}_]"


def lit(text: str) -> str:
    return sql_literal(text)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sentences(src: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """(doc_id, idx, text) of a subquery or table."""
    parts = rf"list_filter(list_transform(string_split(regexp_replace({strip(text_col)}, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: {strip('x')}), lambda x: x <> '')"
    return f"SELECT doc_id, CAST(idx - 1 AS INTEGER) AS idx, text FROM (SELECT {id_col} AS doc_id, generate_subscripts(parts, 1) AS idx, unnest(parts) AS text FROM (SELECT {id_col}, {parts} AS parts FROM ({src})))"


def words(x: str) -> str:
    return rf"CAST(len(regexp_extract_all({x}, '\S+')) AS INTEGER)"


def matches(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(pattern)}))"


_TO = r"(?:to\s+)?"
_AUXILIARY = "|".join(sorted("was were been being is are".split()))
_DET = "(?:no|the|an|a|its|their|our|my|his|her)?"
_ITEM = r"[\p{L}\p{N}_\s-]{3,40}"
PATTERNS = {
    "punct.semicolon": ";",
    "punct.colon_overuse": r":\s+[a-z]",
    "struct.not_x_but_y": rf"(?i)\bnot\s+{_TO}[\s\p{{L}}\p{{N}},_]+,\s*but\s+{_TO}{W}|\brather\s+than\s+{W}|\bnot\s+because\b",
    "struct.triple_parallel": rf"(?i){_DET}\s*{_ITEM},\s*{_DET}\s*{_ITEM},\s*and\s+{_DET}\s*{_ITEM}",
    "struct.tailing_negation": rf",\s+no\s+{W}+(?:\s+{W}+){{0,2}}[.!?]\s*$",
    "content.superficial_ing": rf"(?i),\s*(?:{'|'.join(PARTICIPLES)})\b",
}
PASSIVE = rf"(?i)\b(?:{_AUXILIARY})\s+{W}+(?:ed|en)\b"


def count(rule: str, x: str = "text") -> str:
    """How often a sentence rule fires in a text."""
    if rule == "punct.em_dash":
        return f"({matches(x, '—|–')} + {matches(x, rf'(?:^|[^{W[1:-1]}])--(?:[^{W[1:-1]}]|$)')})"
    if rule in PATTERNS:
        return matches(x, PATTERNS[rule])
    if rule == "struct.abstract_noun_stack":
        nouns = ", ".join(map(lit, ABSTRACT_NOUNS))
        return f"CAST(len(list_filter(regexp_extract_all(lower({x}), '[a-zA-Z]+'), lambda w: w IN ({nouns}))) >= 3 AS INTEGER)"
    mode = RULES[rule].mode
    if mode == BOUNDED:
        each = [matches(x, rf"(?i)\b{quote(p)}\b") for p in PHRASES[rule]]
    elif mode == ANYWHERE:
        each = [matches(x, f"(?i){quote(p)}") for p in PHRASES[rule]]
    else:
        each = [f"CAST(contains(lower({x}), {lit(p)}) AS INTEGER)" for p in PHRASES[rule]]
    return "(" + " + ".join(each) + ")"


def rule_counts(rule: str, src: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    return f"SELECT doc_id, idx, n FROM (SELECT doc_id, idx, CAST({count(rule)} AS INTEGER) AS n FROM ({sentences(src, id_col, text_col)})) WHERE n > 0"


def rhythm(s: str = "s") -> str:
    win = "OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)"
    return f"SELECT doc_id, min(idx) AS first_idx FROM (SELECT doc_id, idx, max(wc) {win} - min(wc) {win} AS spread, avg(wc) {win} AS mean, count(*) {win} AS n FROM (SELECT doc_id, idx, {words('text')} AS wc FROM {s})) WHERE n = 3 AND spread <= 4 AND mean >= 14 GROUP BY doc_id"


def passive(s: str = "s") -> str:
    win = "OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)"
    return (
        f"SELECT doc_id, min(idx) AS first_idx FROM (SELECT doc_id, idx, {matches('t', PASSIVE)} AS p, {words('t')} AS w FROM (SELECT doc_id, idx, string_agg(text, ' ' ORDER BY idx) {win} AS t, count(*) {win} AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM {s}) "
        "WHERE total >= 2 AND n = least(3, total)) WHERE p >= 3 AND p / CAST(w AS DOUBLE) > 0.04 GROUP BY doc_id"
    )


def deficits(src: str = "src", s: str = "s") -> str:
    marks = "|".join(quote(c) for c in COLLOQUIAL)
    return (
        f"SELECT doc_id, NOT regexp_matches(lower(text), {lit(rf'\b(?:{marks})\b')}) AS no_colloquial, least_words > 8 AS no_short_sentence, NOT contains(text, '?') AS no_question "
        f"FROM {src} JOIN (SELECT doc_id, min({words('text')}) AS least_words FROM {s} GROUP BY doc_id) USING (doc_id)"
    )


SENTENCE_RULES = [r.id for r in sorted(RULES.values(), key=lambda r: r.order) if r.order < 20]


def graded(src: str) -> str:
    """WITH clauses src, s, c (counts r1..r24 a sentence), v (with rule_severity)."""
    counts = ", ".join(f"CAST({count(r)} AS INTEGER) AS r{RULES[r].order}" for r in SENTENCE_RULES)
    by = {lev: " + ".join(f"r{r.order}" for r in RULES.values() if r.severity == lev) for lev in LEVELS[:-1]}
    return f"""WITH src AS ({src}), s AS MATERIALIZED ({sentences('SELECT * FROM src')}),
 u AS ({rhythm()}), p AS ({passive()}), d AS ({deficits()}),
 c AS MATERIALIZED (SELECT s.doc_id, s.idx, s.text, {words('s.text')} AS n_words, {counts.replace('(text', '(s.text')},
  CAST(s.idx = 0 AND u.doc_id IS NOT NULL AS INTEGER) AS r20, CAST(s.idx = 0 AND p.doc_id IS NOT NULL AS INTEGER) AS r21,
  CAST(s.idx = 0 AND d.no_colloquial AS INTEGER) AS r22, CAST(s.idx = 0 AND d.no_short_sentence AS INTEGER) AS r23, CAST(s.idx = 0 AND d.no_question AS INTEGER) AS r24
  FROM s LEFT JOIN u USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN d USING (doc_id)),
 v AS MATERIALIZED (SELECT *, CAST({' + '.join(f'r{i}' for i in range(1, 25))} AS INTEGER) AS n_violations,
  CASE WHEN {by['critical']} > 0 OR {by['high']} >= 2 THEN 'critical' WHEN {by['high']} = 1 THEN 'high' WHEN {by['medium']} > 0 THEN 'medium' WHEN {by['low']} > 0 THEN 'low' ELSE 'clean' END AS rule_severity FROM c)"""


def scored(src: str) -> str:
    """graded() and z (with ai_score, doc_mean, doc_std, ai_z_score, severity, heat)."""
    return graded(src) + """,
 a AS (SELECT *, round(1 / (1 + exp(-(-1.0 + 0.8 * n_violations + 0.02 * (n_words - 15)))), 6) AS ai_score FROM v),
 m AS (SELECT *, avg(ai_score) OVER w AS doc_mean, coalesce(stddev_samp(ai_score) OVER w, 0) AS doc_std, count(*) OVER w AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ai_score DESC, idx) - 1 AS k FROM a WINDOW w AS (PARTITION BY doc_id)),
 z0 AS (SELECT *, doc_std >= 0.03 AS model_useful, CASE WHEN doc_std >= 0.03 THEN (ai_score - doc_mean) / doc_std ELSE 0 END AS ai_z_score FROM m),
 z AS (SELECT *, CASE WHEN k / CAST(n AS DOUBLE) < 0.2 THEN 'hot' WHEN k / CAST(n AS DOUBLE) < 0.5 THEN 'warm' ELSE 'low' END AS heat,
  CASE WHEN rule_severity = 'critical' OR NOT model_useful THEN rule_severity WHEN rule_severity = 'clean' AND ai_z_score > 1.5 THEN 'medium'
   WHEN rule_severity = 'medium' AND ai_z_score > 1.0 THEN 'high' WHEN rule_severity = 'high' AND ai_z_score < -1.0 THEN 'medium' ELSE rule_severity END AS severity FROM z0)"""


def by_rule() -> str:
    """(doc_id, idx, rule_id, o, n): counts in long form, of v."""
    return " UNION ALL ".join(f"SELECT doc_id, idx, '{r.id}' AS rule_id, {r.order} AS o, r{r.order} AS n FROM v WHERE r{r.order} > 0" for r in RULES.values())


def fix_punctuation(x: str) -> str:
    t = rf"regexp_replace({x}, '\s*[—–]\s*', ', ', 'g')"
    t = rf"regexp_replace({t}, '\s+--\s+', ', ', 'g')"
    parts = rf"string_split(regexp_replace({t}, ';\s*([a-zA-Z])', chr(31) || '\1', 'g'), chr(31))"
    t = f"array_to_string(list_transform({parts}, lambda q, i: CASE WHEN i = 1 THEN q ELSE upper(q[1]) || q[2:] END), '. ')"
    t = rf"regexp_replace(replace({t}, ';', '.'), ',\s*,', ',', 'g')"
    return rf"regexp_replace({t}, '\.(\s*\.)+', '.', 'g')"


def fix_whitespace(x: str) -> str:
    t = rf"regexp_replace({x}, '[^\S\n]{{2,}}', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({t}, '(?m)[^\S\n]+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"


def fix_curly_quotes(x: str) -> str:
    return f"translate({x}, '“”‘’', '\"\"''''')"


def fix_emojis(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[\x{{1F300}}-\x{{1F64F}}\x{{1F680}}-\x{{1F6FF}}\x{{1F900}}-\x{{1F9FF}}\x{{1FA00}}-\x{{1FAFF}}\x{{2702}}-\x{{27B0}}\x{{FE00}}-\x{{FE0F}}]+', '', 'g'), '  +', ' ', 'g')"


def fix_excessive_bold(x: str) -> str:
    return rf"CASE WHEN len(regexp_extract_all({x}, '\*\*([^*]+)\*\*')) >= 4 THEN regexp_replace({x}, '\*\*([^*]+)\*\*', '\1', 'g') ELSE {x} END"


def fix_inline_header_lists(x: str) -> str:
    mark, bullet = r"\*{2}", r"(\s*[*-]\s+)"
    return rf"regexp_replace({x}, '(?m)^{bullet}{mark}([^:*]+):?{mark}:?\s*', '\1\2 ', 'g')"


def clean_text(x: str) -> str:
    t = f"translate({x}, chr(8203) || chr(173) || chr(65279), '')"
    t = rf"replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    t = rf"regexp_replace({t}, '(?m)[^\S\n]+$', '', 'g')"
    t = rf"regexp_replace({t}, '\n+', chr(10) || chr(10), 'g')"
    t = rf"regexp_replace({t}, '[ \t]{{2,}}', ' ', 'g')"
    for ch in "!?.,;:-~":
        t = f"regexp_replace({t}, '{quote(ch)}{{5,}}', '{ch * 3}', 'g')"
    return strip(t)
