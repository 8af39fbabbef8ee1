"""Splitting, spans, clean-up and prompts in SQL, for comparison with another engine.

Folds are recursive CTEs over numbered pieces; spans come from the lengths of what a pattern matches and of what lies between.
"""

from __future__ import annotations

from ..functions.lexicon import ABSTRACT_NOUNS, ANYWHERE, BOUNDED, PHRASES, RULES
from ..functions.text import quote
from ..operators import decisions, prompts
from ..operators.extraction import END
from ..operators.postprocess import STEPS
from . import sql
from .sql import lit, strip, words

CUT = "chr(31)"
STOPS = ".!?。！？"


def cjk(x: str) -> str:
    t = rf"regexp_replace({strip(x)}, '([{STOPS}])\s+', '\1' || {CUT}, 'g')"
    t = rf"regexp_replace({t}, '([{STOPS}])([A-Z一-鿿])', '\1' || {CUT} || '\2', 'g')"
    return f"list_filter(string_split({t}, {CUT}), lambda y: y <> '')"


def cjk_sentences(src: str) -> str:
    return f"SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS i, unnest(p) AS s FROM (SELECT doc_id, CASE WHEN len(p) > 0 THEN p ELSE [''] END AS p FROM (SELECT doc_id, {cjk('text')} AS p FROM ({src})))"


def hard(src: str, key: str, most: int, name: str) -> str:
    """CTE ``name``: (key, j, piece) of the texts ``t`` of a subquery, cut at the last space before ``most`` characters."""
    at = f"CASE WHEN length(regexp_extract(left(rest, {most}), '(?s)^(.*) ', 1)) > 0 THEN length(regexp_extract(left(rest, {most}), '(?s)^(.*) ', 1)) ELSE {most} END"
    return f"""{name}_r AS (SELECT {key}, 0 AS j, CAST(NULL AS VARCHAR) AS piece, t AS rest FROM ({src})
  UNION ALL SELECT {key}, j + 1, CASE WHEN length(rest) > {most} THEN {strip('left(rest, stop)')} ELSE rest END, CASE WHEN length(rest) > {most} THEN {strip('substr(rest, stop + 1)')} ELSE '' END FROM (SELECT *, {at} AS stop FROM {name}_r WHERE rest <> '')),
 {name} AS (SELECT {key}, j, piece FROM {name}_r WHERE j > 0)"""


def hard_split(src: str, most: int) -> str:
    return f"WITH RECURSIVE {hard(src, 'doc_id', most, 'h')} SELECT doc_id, CAST(j - 1 AS INTEGER) AS i, piece FROM h"


def _parts(src: str, most: int) -> str:
    """CTEs ``para`` (doc_id, i, p) and ``part`` (doc_id, i, j, piece): paragraphs and what long ones are cut to."""
    paras = rf"list_filter(list_transform(string_split_regex(t, '\n\s*\n'), lambda x: {strip('x')}), lambda x: x <> '')"
    return f"""para AS MATERIALIZED (SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS i, unnest(ps) AS p FROM (SELECT doc_id, CASE WHEN len(ps) <= 1 THEN [t] ELSE ps END AS ps FROM (SELECT doc_id, t, {paras} AS ps FROM (SELECT doc_id, {strip('text')} AS t FROM ({src})) WHERE t <> ''))),
 cut AS MATERIALIZED (SELECT doc_id, i, p, {cjk('p')} AS ss FROM para WHERE length(p) > {most}),
 sent AS MATERIALIZED (SELECT doc_id, i, generate_subscripts(ss, 1) AS k, unnest(ss) AS s FROM cut WHERE len(ss) > 1),
 run AS (SELECT doc_id, i, k, length(s) AS n, 0 AS g FROM sent WHERE k = 1
  UNION ALL SELECT s.doc_id, s.i, s.k, CASE WHEN r.n + 1 + length(s.s) > {most} THEN length(s.s) ELSE r.n + 1 + length(s.s) END, CASE WHEN r.n + 1 + length(s.s) > {most} THEN g + 1 ELSE g END FROM run r JOIN sent s ON s.doc_id = r.doc_id AND s.i = r.i AND s.k = r.k + 1),
 {hard('SELECT doc_id, i, p AS t FROM cut WHERE len(ss) <= 1', 'doc_id, i', most, 'h')},
 part AS MATERIALIZED (SELECT doc_id, i, 0 AS j, p AS piece FROM para WHERE length(p) <= {most}
  UNION ALL SELECT doc_id, i, g, {strip("string_agg(s, ' ' ORDER BY k)")} FROM run JOIN sent USING (doc_id, i, k) GROUP BY doc_id, i, g
  UNION ALL SELECT doc_id, i, j, piece FROM h)"""


def chunks(src: str, most: int) -> str:
    return f"WITH RECURSIVE {_parts(src, most)} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INTEGER) AS i, piece AS text, i AS para_idx FROM part"


def merged_chunks(src: str, most: int) -> str:
    """Short paragraphs are packed together, long ones stand for themselves."""
    return f"""WITH RECURSIVE {_parts(src, most)},
 pack AS (SELECT doc_id, i, CASE WHEN length(p) > {most} THEN 0 ELSE length(p) END AS n, i AS begun FROM para WHERE i = 0
  UNION ALL SELECT p.doc_id, p.i, CASE WHEN length(p.p) > {most} THEN 0 WHEN k.n > 0 AND k.n + 2 + length(p.p) <= {most} THEN k.n + 2 + length(p.p) ELSE length(p.p) END,
   CASE WHEN length(p.p) <= {most} AND k.n > 0 AND k.n + 2 + length(p.p) <= {most} THEN k.begun ELSE p.i END FROM pack k JOIN para p ON p.doc_id = k.doc_id AND p.i = k.i + 1),
 done AS (SELECT doc_id, begun AS para_idx, 0 AS j, string_agg(p, chr(10) || chr(10) ORDER BY i) AS text FROM pack JOIN para USING (doc_id, i) WHERE length(p) <= {most} GROUP BY doc_id, begun
  UNION ALL SELECT doc_id, i, j, piece FROM part JOIN para USING (doc_id, i) WHERE length(p) > {most})
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, j) - 1 AS INTEGER) AS i, text, para_idx FROM done"""


def segments(src: str, target: int = 800, overlap: int = 2) -> str:
    return f"""WITH RECURSIVE src AS MATERIALIZED ({src}), s AS MATERIALIZED (SELECT *, {words('text')} AS w FROM ({sql.sentences('SELECT * FROM src')})),
 t AS MATERIALIZED (SELECT doc_id, coalesce(sum(w), 0) AS total FROM src LEFT JOIN s USING (doc_id) GROUP BY doc_id),
 run AS (SELECT doc_id, idx, w AS n, 0 AS g FROM s WHERE idx = 0
  UNION ALL SELECT s.doc_id, s.idx, CASE WHEN r.n + s.w > {target} THEN s.w ELSE r.n + s.w END, CASE WHEN r.n + s.w > {target} THEN g + 1 ELSE g END FROM run r JOIN s ON s.doc_id = r.doc_id AND s.idx = r.idx + 1),
 tail AS (SELECT doc_id, max(g) AS last, arg_max(n, idx) AS n FROM run GROUP BY doc_id),
 seg AS MATERIALIZED (SELECT doc_id, idx, text, CAST(CASE WHEN total <= {target} THEN 0 WHEN g = last AND g > 0 AND tail.n < {target} * 0.4 THEN g - 1 ELSE g END AS INTEGER) AS g FROM run JOIN s USING (doc_id, idx) JOIN tail USING (doc_id) JOIN t USING (doc_id)),
 l AS MATERIALIZED (SELECT doc_id, g, list(idx ORDER BY idx) AS ids, list(text ORDER BY idx) AS ts FROM seg GROUP BY doc_id, g),
 one AS (SELECT doc_id, max(g) AS most FROM l GROUP BY doc_id)
 SELECT d.doc_id, coalesce(l.g, 0) AS seg_idx, CASE WHEN coalesce(most, 0) = 0 AND total <= {target} THEN d.text ELSE array_to_string(l.ts, ' ') END AS text, coalesce(l.ids, CAST([] AS INTEGER[])) AS sentence_indices,
  coalesce(array_to_string(b.ts[greatest(len(b.ts) - {overlap - 1}, 1):], ' '), '') AS context_before, coalesce(array_to_string(a.ts[:{overlap}], ' '), '') AS context_after,
  {words(f"CASE WHEN coalesce(most, 0) = 0 AND total <= {target} THEN d.text ELSE array_to_string(l.ts, ' ') END")} AS word_count
 FROM src d JOIN t USING (doc_id) LEFT JOIN one USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN l b ON b.doc_id = l.doc_id AND b.g = l.g - 1 LEFT JOIN l a ON a.doc_id = l.doc_id AND a.g = l.g + 1"""


MARK = "chr(1)"


def _found(rule: str, sub: int, pattern: str, x: str = "text", first: bool = False, where: str = "true", right: int | None = None) -> str:
    """Rows of a pattern's matches in the sentences ``s``; ``x`` is a text as long as the sentence."""
    r = RULES[rule]
    right = r.context if right is None else right
    p = lit(pattern)
    start = "CAST(list_sum(list_transform(ps[1:k], lambda q: length(q))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda q: length(q))), 0) AS INTEGER)"
    return f"""SELECT doc_id, idx, {r.order} AS o, {sub} AS sub, k, start, stop, substr(text, greatest(start - {r.context}, 0) + 1, stop + {right} - greatest(start - {r.context}, 0)) AS context FROM (
 SELECT doc_id, idx, text, k, start, start + CAST(length(ms[k]) AS INTEGER) AS stop FROM (SELECT *, {start} AS start FROM (
  SELECT *, unnest(range(1, {'2' if first else 'len(ms) + 1'})) AS k FROM (SELECT doc_id, idx, text, regexp_extract_all(x, {p}) AS ms, string_split_regex(x, {p}) AS ps FROM (SELECT doc_id, idx, text, {x} AS x FROM s WHERE {where})) WHERE len(ms) > 0)))"""


def violations(src: str) -> str:
    """graded() and ``viol``: (doc_id, idx, pos, rule_id, severity, start, end, context, suggestion)."""
    W = sql.W
    dash = rf"replace(replace(text, '—', {MARK}), '–', {MARK})"
    pair = rf"'(^|[^{W[1:-1]}])--([^{W[1:-1]}]|$)', '\1' || chr(2) || chr(2) || '\2', 'g'"
    dashes = f"regexp_replace(regexp_replace({dash}, {pair}), {pair})"
    colon = rf"regexp_replace(text, ':(\s+[a-z])', {MARK} || '\1', 'g')"
    parts = [_found("punct.em_dash", 0, "\x01|\x02\x02", dashes), _found("punct.semicolon", 0, ";"), _found("punct.colon_overuse", 0, "\x01", colon)]
    for rule in ("struct.not_x_but_y", "struct.triple_parallel", "content.superficial_ing"):
        parts.append(_found(rule, 0, sql.PATTERNS[rule]))
    parts.append(_found("struct.tailing_negation", 0, sql.PATTERNS["struct.tailing_negation"], right=0))
    nouns = f"list_filter(regexp_extract_all(lower(text), '[a-zA-Z]+'), lambda w: w IN ({', '.join(map(lit, ABSTRACT_NOUNS))}))"
    parts.append(f"SELECT doc_id, idx, {RULES['struct.abstract_noun_stack'].order}, 0, 1, 0, CAST(length(text) AS INTEGER), array_to_string(ns[:5], ', ') FROM (SELECT *, {nouns} AS ns FROM s) WHERE len(ns) >= 3")
    for rule, phrases in PHRASES.items():
        mode = RULES[rule].mode
        for k, p in enumerate(phrases):
            has = f"contains(lower(text), {lit(p)})"
            if mode == BOUNDED:
                parts.append(_found(rule, k, rf"(?i)\b{quote(p)}\b", where=has))
            elif mode == ANYWHERE:
                parts.append(_found(rule, k, f"(?i){quote(p)}", where=has))
            else:
                parts.append(_found(rule, k, quote(p), "lower(text)", True, has))
    body = "JOIN src USING (doc_id)"
    counts = f"(SELECT doc_id, list({words('text')} ORDER BY idx) AS c FROM s GROUP BY doc_id)"
    parts += [
        f"SELECT doc_id, 0, 20, 0, 1, 0, 0, 'sentences from ' || first_idx || ': ' || array_to_string(c[first_idx + 1:first_idx + 3], ', ') || ' words' FROM u JOIN {counts} USING (doc_id)",
        "SELECT doc_id, 0, 21, 0, 1, 0, 0, 'passives from sentence ' || first_idx FROM p",
        f"SELECT doc_id, 0, 22, 0, 1, 0, CAST(length(text) AS INTEGER), 'no spoken word' FROM d {body} WHERE no_colloquial",
        "SELECT doc_id, 0, 23, 0, 1, 0, 0, 'no short sentence' FROM d WHERE no_short_sentence",
        f"SELECT doc_id, 0, 24, 0, 1, 0, CAST(length(text) AS INTEGER), 'no question' FROM d {body} WHERE no_question",
    ]
    table = ", ".join(f"({r.order}, {lit(r.id)}, {lit(r.severity)}, {lit(r.advice)})" for r in RULES.values())
    return sql.graded(src) + f""",
 raw AS ({' UNION ALL '.join(parts)}), rule(o, rule_id, severity, suggestion) AS (VALUES {table}),
 viol AS MATERIALIZED (SELECT doc_id, idx, CAST(row_number() OVER (PARTITION BY doc_id, idx ORDER BY o, sub, k) - 1 AS INTEGER) AS pos, rule_id, severity, start, stop AS "end", context, suggestion FROM raw JOIN rule USING (o))"""


_HEADING = r"^(#{1,6})\s+(.+)$"


def fix_title_case_headings(x: str) -> str:
    upper = lambda w: f"(upper({w}) = {w} AND lower({w}) <> {w})"
    ws = rf"list_filter(string_split_regex(regexp_extract(l, '{_HEADING}', 2), '\s+'), lambda w: w <> '')"
    eligible = f"list_filter({ws}[2:], lambda w: length(w) > 3 AND NOT {upper('w')})"
    capital = f"list_filter({eligible}, lambda w: {upper('w[1]')})"
    new = f"list_transform({ws}, lambda w, i: CASE WHEN i = 1 OR {upper('w')} THEN w ELSE lower(w) END)"
    line = rf"CASE WHEN regexp_matches(l, '{_HEADING}') AND len({eligible}) > 0 AND len({capital}) >= 0.6 * len({eligible}) THEN regexp_extract(l, '{_HEADING}', 1) || ' ' || array_to_string({new}, ' ') ELSE l END"
    return f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: {line}), chr(10))"


def fixed(src: str, columns: str, x: str) -> str:
    """The columns of a subquery, and ``t``, the text x cleaned up."""
    t = f"SELECT {columns}, {x} AS t FROM ({src})"
    for name, _, _ in STEPS:
        fix = fix_title_case_headings if name == "title_case_headings" else getattr(sql, f"fix_{name}")
        t = f"SELECT {columns}, {fix('t')} AS t FROM ({t})"
    return t


def score_text(x: str) -> str:
    every = ", ".join(lit(p) for ps in PHRASES.values() for p in ps)
    hits = f"len(list_filter([{every}], lambda q: contains(lower({x}), q)))"
    return f"round(1 / (1 + exp(-(-1.0 + 0.8 * {hits} + 0.02 * (least({words(x)}, 40) - 15)))), 6)"


def without_phrases(x: str) -> str:
    for ps in PHRASES.values():
        pattern = "|".join(quote(p) for p in sorted(ps, key=len, reverse=True))
        x = f"regexp_replace({x}, {lit(f'(?i)(?:{pattern}),? ?')}, '', 'g')"
    return strip(x)


def with_short_forms(x: str) -> str:
    return rf"regexp_replace({x}, '(?i)\b(do|does|did|is|are|was|were|has|have) not\b', '\1n''t', 'g')"


def without_short_forms(x: str) -> str:
    return rf"regexp_replace({x}, 'n''t\b', ' not', 'g')"


def sentence_grade(x: str) -> str:
    """The grade of a text as one sentence."""
    n = {lev: " + ".join(sql.count(r, x) for r in sql.SENTENCE_RULES if RULES[r].severity == lev) or "0" for lev in sql.LEVELS[:-1]}
    return f"CASE WHEN {n['critical']} > 0 OR {n['high']} >= 2 THEN 'critical' WHEN {n['high']} = 1 THEN 'high' WHEN {n['medium']} > 0 THEN 'medium' WHEN {n['low']} > 0 THEN 'low' ELSE 'clean' END"


def optimized(src: str) -> str:
    """The six stages, with the stand-ins for models."""
    far = "w >= 5 AND NOT (sw > 20 AND abs(w - sw) / CAST(sw AS DOUBLE) > 0.4)"

    def offered(rows: str, where: str) -> str:
        """The best of rows (doc_id, ord, t, a: source, sw: words of what is rewritten)."""
        clean = fixed(rows, "doc_id, ord, a, sw", "t")
        scored = f"SELECT *, t AS b, {score_text('t')} AS s, {words('t')} AS w FROM ({clean})"
        return f"SELECT doc_id, ord, t, s FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim <= 0.5, s, ord) AS n FROM ({likeness(scored, 'doc_id, ord, t, s, w, sw')}) WHERE ({far}) AND {where}) WHERE n = 1"

    human = sql.scored(src) + " SELECT doc_id, s < 0.35 OR (s < 0.45 AND c >= 0.7) AS already_human FROM (SELECT doc_id, avg(ai_score) AS s, avg(CAST(rule_severity = 'clean' AS INTEGER)) AS c FROM z GROUP BY doc_id)"
    return f"""WITH o AS MATERIALIZED (SELECT doc_id, text, already_human, {score_text('text')} AS orig_score, {words('text')} AS n_words FROM ({src}) JOIN ({human}) USING (doc_id)),
 part AS MATERIALIZED (SELECT doc_id, g, t FROM (SELECT doc_id, seg_idx AS g, text AS t FROM ({segments(src)})) JOIN o USING (doc_id) WHERE n_words > 1000 UNION ALL SELECT doc_id, 0, text FROM o WHERE n_words <= 1000),
 c0 AS (SELECT doc_id, 0 AS ord, string_agg(t, ' ' ORDER BY g) AS t FROM part GROUP BY doc_id UNION ALL SELECT doc_id, 1, string_agg({without_phrases('t')}, ' ' ORDER BY g) FROM part GROUP BY doc_id),
 b0 AS MATERIALIZED ({offered("SELECT c0.doc_id, ord, t, text AS a, n_words AS sw FROM c0 JOIN o USING (doc_id) WHERE ord = 0 OR NOT already_human", 'true')}),
 f AS MATERIALIZED (SELECT o.*, b0.ord AS candidate, coalesce(b0.t, text) AS first_text, coalesce(b0.s, orig_score) AS first_score, (orig_score - coalesce(b0.s, orig_score)) / greatest(orig_score, 0.01) < 0.15 AND orig_score > 0.25 AND NOT already_human AS retry FROM o LEFT JOIN b0 USING (doc_id)),
 c1 AS (SELECT doc_id, 0 AS ord, {without_phrases('first_text')} AS t, text AS a, {words('first_text')} AS sw FROM f WHERE retry UNION ALL SELECT doc_id, 1, {with_short_forms(without_phrases('first_text'))}, text, {words('first_text')} FROM f WHERE retry),
 b1 AS MATERIALIZED ({offered('SELECT * FROM c1', 'true')}),
 st AS MATERIALIZED (SELECT f.*, coalesce(b1.t, first_text) AS stage3_text, coalesce(b1.s, first_score) AS stage3_score FROM f LEFT JOIN b1 USING (doc_id)),
 g3 AS MATERIALIZED (SELECT * FROM ({sql.graded('SELECT doc_id, stage3_text AS text FROM st')} SELECT doc_id, idx, text, rule_severity FROM v)),
 bad AS MATERIALIZED (SELECT g.doc_id, g.idx, g.text, (SELECT coalesce(string_agg(r.text, ' ' ORDER BY r.idx), '') FROM g3 r WHERE r.doc_id = g.doc_id AND r.idx <> g.idx) AS rest FROM g3 g WHERE rule_severity IN ('critical', 'high')),
 cand AS MATERIALIZED (SELECT doc_id, idx, text, rest, {without_phrases('t')} AS b FROM ({fixed('SELECT * FROM bad', 'doc_id, idx, text, rest', 'text')})),
 sem AS ({likeness('SELECT doc_id, idx, text AS a, b FROM cand', 'doc_id, idx')}),
 whole AS ({likeness('SELECT cand.doc_id, idx, st.text AS a, rest AS b FROM cand JOIN st USING (doc_id)', 'doc_id, idx')}),
 act AS MATERIALIZED (SELECT doc_id, idx, b, CASE WHEN sem.sim >= 0.65 AND {sentence_grade('b')} IN ('clean', 'low') THEN 'rewritten' WHEN CASE WHEN rest = '' THEN 0.0 ELSE whole.sim END >= 0.85 THEN 'deleted' ELSE 'unfixed_risky' END AS action FROM cand JOIN sem USING (doc_id, idx) JOIN whole USING (doc_id, idx)),
 after AS (SELECT g3.doc_id, g3.idx, coalesce(action, 'kept') AS action, CASE action WHEN 'rewritten' THEN b WHEN 'deleted' THEN '' ELSE text END AS t FROM g3 LEFT JOIN act USING (doc_id, idx)),
 s4 AS MATERIALIZED (SELECT doc_id, coalesce(string_agg(t, ' ' ORDER BY idx) FILTER (WHERE t <> ''), '') AS t4, {', '.join(f"count(*) FILTER (WHERE action = '{a}') AS n_{a}" for a in ('kept', 'rewritten', 'deleted', 'unfixed_risky'))} FROM after GROUP BY doc_id),
 s5 AS MATERIALIZED (SELECT doc_id, t AS t5 FROM ({fixed('SELECT * FROM s4', 'doc_id', with_short_forms('t4'))})),
 s6 AS MATERIALIZED (SELECT doc_id, t AS t6 FROM ({fixed('SELECT * FROM s5', 'doc_id', without_short_forms('t5'))})),
 e AS MATERIALIZED (SELECT st.*, s4.* EXCLUDE (doc_id), t5, t6, CASE WHEN t4 = '' THEN stage3_score ELSE {score_text('t4')} END AS stage4_score, {score_text('t5')} AS stage5_score, {score_text('t6')} AS stage6_score FROM st JOIN s4 USING (doc_id) JOIN s5 USING (doc_id) JOIN s6 USING (doc_id)),
 x AS (SELECT *, text AS a, CASE WHEN stage6_score <= stage5_score + 0.05 THEN t6 ELSE t5 END AS b FROM e)
 SELECT doc_id, CASE WHEN n_words <= 1000 THEN 'short' ELSE 'long' END AS route, already_human, candidate, retry, orig_score, stage3_score, stage4_score, stage5_score, CASE WHEN stage6_score <= stage5_score + 0.05 THEN stage6_score ELSE stage5_score END AS final_score, round(sim, 5) AS final_sem,
  n_kept, n_rewritten, n_deleted, n_unfixed_risky, CASE WHEN stage6_score <= stage5_score + 0.05 THEN 'accepted' ELSE 'rejected' END AS formality, b AS final_text FROM ({likeness('SELECT * FROM x', '*')})"""


def post_process(src: str) -> str:
    t, said = f"SELECT doc_id, text AS t0 FROM ({src})", []
    for k, (name, _, message) in enumerate(STEPS):
        fix = fix_title_case_headings if name == "title_case_headings" else getattr(sql, f"fix_{name}")
        t = f"SELECT *, {fix(f't{k}')} AS t{k + 1} FROM ({t})"
        said.append(f"CASE WHEN t{k} <> t{k + 1} THEN {lit(message)} END")
    return f"SELECT doc_id, t{len(STEPS)} AS fixed, list_filter([{', '.join(said)}], lambda x: x IS NOT NULL) AS changes FROM ({t})"


def mark_positions(src: str) -> str:
    """For the first three sentences; longer ones come first, and none overlaps another."""
    return f"""WITH s AS ({sql.sentences(src)}),
 n AS (SELECT doc_id, k, start, start + length(text) AS stop FROM (SELECT doc_id, s.text, row_number() OVER (PARTITION BY doc_id ORDER BY length(s.text) DESC, s.text) AS k, strpos(d.text, s.text) - 1 AS start FROM (SELECT DISTINCT doc_id, text FROM s WHERE idx < 3) s JOIN documents d USING (doc_id)) WHERE start >= 0),
 b AS (SELECT n.*, NOT EXISTS (SELECT 1 FROM n m WHERE m.doc_id = n.doc_id AND m.k = 1 AND n.k > 1 AND m.start < n.stop AND n.start < m.stop) AS clear FROM n),
 c AS (SELECT b.*, clear AND NOT EXISTS (SELECT 1 FROM b m WHERE m.doc_id = b.doc_id AND m.k = 2 AND b.k > 2 AND m.clear AND m.start < b.stop AND b.start < m.stop) AS kept FROM b)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, stop) - 1 AS INTEGER) AS i, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end" FROM c WHERE kept"""


def marked_parts(src: str) -> str:
    """The texts with brackets around their marks, as a digest."""
    return f"""SELECT d.doc_id, md5(coalesce(string_agg(substr(d.text, prev + 1, start - prev) || '[[' || substr(d.text, start + 1, "end" - start) || ']]', '' ORDER BY start), '') || substr(any_value(d.text), coalesce(max("end"), 0) + 1)) AS marked
 FROM documents d LEFT JOIN (SELECT *, lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS prev FROM ({mark_positions(src)})) m USING (doc_id) GROUP BY d.doc_id"""


def run_summary(src: str) -> str:
    r = lambda x, name: f"round_even({x}, 4) AS {name}"
    return f"""SELECT doc_id, {r('orig_score', 'original_ai_score')}, {r('final_score', 'final_ai_score')}, {r('final_sem', 'final_sem_score')}, CAST(length(final_text) AS INTEGER) AS output_length, n AS total_sentences, n_unfixed_risky AS unfixed_count,
 {r('stage3_score', 'stage3_ai_score')}, {r('stage4_score', 'stage4_ai_score')}, {r('final_score', 'stage5_ai_score')} FROM ({optimized(src)}) JOIN (SELECT doc_id, count(*) AS n FROM ({sql.sentences(src)}) GROUP BY doc_id) USING (doc_id)"""


def event_counts(src: str) -> str:
    """(run_id, type, n) of the events of each run."""
    segs = f"SELECT doc_id, count(*) AS n_segments FROM ({segments(src)}) GROUP BY doc_id"
    kinds = {"stage_start": "6", "stage1_done": "1", "sentence_tagged": "n", "stage2_done": "1", "stage3_progress": "CASE WHEN route = 'long' THEN n_segments ELSE 0 END + CAST(retry AS INTEGER)", "stage3_done": "1", "stage4_sentence": "n_rewritten + n_deleted + n_unfixed_risky", "stage4_done": "1", "stage5_done": "1", "stage6_done": "1", "run_done_v2": "1"}
    rows = ", ".join(f"{{'type': '{k}', 'n': CAST({v} AS BIGINT)}}" for k, v in kinds.items())
    return f"SELECT run_id, e.type AS type, e.n AS n FROM (SELECT CAST(doc_id AS VARCHAR) AS run_id, unnest([{rows}]) AS e FROM ({optimized(src)}) JOIN (SELECT doc_id, count(*) AS n FROM ({sql.sentences(src)}) GROUP BY doc_id) USING (doc_id) JOIN ({segs}) USING (doc_id)) WHERE e.n > 0"


def likeness(src: str, columns: str, size: int = 64) -> str:
    """The columns of a subquery, and ``sim`` of its columns a and b."""
    slots = lambda x: f"list_transform(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: CAST('0x' || md5(w)[:2] AS INTEGER) % {size})"
    vector = lambda x: f"list_transform(range({size}), lambda i: CAST(len(list_filter({x}, lambda s: s = i)) AS DOUBLE))"
    return f"""SELECT {columns}, CASE WHEN a = b THEN 1.0 WHEN list_sum(va) * list_sum(vb) > 0 THEN list_cosine_similarity(va, vb) ELSE 0.0 END AS sim FROM (
  SELECT *, {vector('sa')} AS va, {vector('sb')} AS vb FROM (SELECT *, {slots('a')} AS sa, {slots('b')} AS sb FROM ({src})))"""


def similarity(src: str) -> str:
    """Of columns a and b of a subquery."""
    return f"SELECT doc_id, round(sim, 5) AS sim FROM ({likeness(src, 'doc_id')})"


def guard_length(text: str, source: str) -> str:
    """One expression over columns; steps are nested subqueries of a struct."""
    return f"SELECT doc_id, {_guarded('t', 's')} AS text FROM (SELECT doc_id, {strip(text)} AS t, {strip(source)} AS s FROM documents)"


def _guarded(t: str, s: str) -> str:
    n, c = words(s), f"length({s})"
    most_words = f"CASE WHEN {n} <= 3 THEN greatest({n} + 3, 2 * {n}) ELSE greatest({n} + 8, CAST(floor({n} * 1.35::DOUBLE) AS INTEGER)) END"
    most_chars = f"CASE WHEN {n} <= 3 THEN greatest({c} + 18, CAST(floor({c} * 2.2::DOUBLE) AS INTEGER)) ELSE greatest({c} + 40, CAST(floor({c} * 1.45::DOUBLE) AS INTEGER)) END"
    ws = rf"regexp_extract_all({t}, '\S+')"
    by_words = f"CASE WHEN len({ws}) > {most_words} THEN array_to_string({ws}[:{most_words}], ' ') ELSE {t} END"
    short = f"rtrim(left({by_words}, {most_chars}), ' ,;:-')"
    head = f"regexp_extract({short}, '(?s)^(.*)[{END}]', 1)"
    by_chars = f"CASE WHEN length({by_words}) > {most_chars} THEN CASE WHEN regexp_matches({short}, '[{END}]') AND length({head}) >= greatest(10, ({most_chars}) // 2) THEN left({short}, length({head}) + 1) ELSE {short} END ELSE {by_words} END"
    return f"CASE WHEN {s} = '' OR {t} = '' THEN CASE WHEN {t} = '' THEN {s} ELSE {t} END ELSE {strip(by_chars)} END"


def extracted() -> str:
    """What is left of the answers of the query: the given text, one line of sentences, held near its source's length.

    Each form says the same but the third, which puts words before it.
    """
    body = rf"regexp_replace(text[:200], '[\n\x22\\\\]', ' ', 'g')"
    one = rf"regexp_replace({strip('t')}, '([{END}])\s+', '\1 ', 'g')"
    return f"""SELECT doc_id, {_guarded('trim(t, chr(32))', 's')} AS rewrite FROM (SELECT doc_id, CASE WHEN length(s) <= 20 THEN regexp_replace(t, '([{END}]) .*', '\\1') ELSE t END AS t, s FROM (SELECT doc_id, {one} AS t, {strip('s')} AS s FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 2 THEN 'a "quoted" ' ELSE '' END || {body} AS t, text[:200] AS s FROM documents)))"""


# prompts


def _case(key: str, table: dict[str, str], default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {default} END"


def guide(genre: str) -> str:
    return _case(genre, prompts.GUIDE, lit(prompts.GUIDE["academic"]))


ANSWER, KEEP = lit(prompts.ANSWER), lit("\n" + prompts.KEEP)


def rewrite_prompt(text: str, score: str, genre: str, retry: str) -> str:
    again = f"CASE WHEN {retry} THEN {lit(chr(10) + 'The last attempt changed too little: go further this time.')} ELSE '' END"
    aim = f"chr(10) || format('Score now {{:.2f}}, to get below {{:.2f}}; lines marked hot matter most.', {score}, greatest(0.15, {score} * 0.5))"
    return f"'Rewrite the text below so that it reads as if a person had written it.' || chr(10) || 'Genre: ' || {genre} || '. ' || {guide(genre)} || {again} || {aim} || {KEEP} || {lit(' Stay within a fifth of its length.' + chr(10) * 2)} || {text} || {ANSWER}"


def sentence_prompt(text: str, issues: str, before: str, after: str, score: str) -> str:
    side = lambda label, x: f"CASE WHEN {x} <> '' THEN chr(10) || '[{label}] ' || {x} ELSE '' END"
    return f"{lit('Rewrite only the target; the rest is there for context.' + chr(10))} || coalesce({issues}, '- no rule is broken') || chr(10) || format('Score {{:.3f}}.', {score}) || {KEEP} || {side('before', before)} || chr(10) || '[target] ' || {text} || {side('after', after)} || {ANSWER}"


def polish_prompt(text: str, n_words: str, deficits: str, score: float, genre: str) -> str:
    lines = []
    for t in decisions.TECHNIQUE_ORDER:
        add, most = decisions.TECHNIQUES[t]
        boost = 2 if score > 0.5 else 1 if score > 0.35 else 0
        lines.append(f"{lit(f'- {t}: {prompts.TECHNIQUE_TEXT[t]} (x')} || CAST(least({most}, greatest(1, greatest(1, {n_words} // 500) + {add + boost})) AS INTEGER) || ')'")
    lacks = f"CASE WHEN len({deficits}) > 0 THEN array_to_string(list_transform({deficits}, lambda x: '- ' || {_case('x', prompts.DEFICIT_TEXT, 'x')}), chr(10)) ELSE '- nothing in particular' END"
    force = lit(f"\nThe score is high ({score:.2f}): use the budget up.") if score > 0.35 else "''"
    return f"'Give the text a last human touch.' || chr(10) || 'Genre: ' || {genre} || '. ' || {guide(genre)} || {force} || chr(10) || 'Techniques:' || chr(10) || {' || chr(10) || '.join(lines)} || chr(10) || 'Missing:' || chr(10) || {lacks} || {KEEP} || {lit(' Ask two questions at most.' + chr(10) * 2)} || {text} || {ANSWER}"


def formality_prompt(text: str, genre: str) -> str:
    advice = _case(genre, prompts.FORMAL, "''")
    return f"CASE WHEN {advice} = '' THEN '' ELSE 'The text may have become too informal for its genre, ' || {genre} || '. ' || {advice} || {KEEP} || chr(10) || chr(10) || {text} || {ANSWER} END"


def genre_prompt(text: str) -> str:
    return f"{lit('Name the genre of this text with one word of: ' + ', '.join(sorted(prompts.GUIDE)) + '.' + chr(10) * 2)} || trim(left({text}, 500))"
