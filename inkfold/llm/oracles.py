"""SQL for DuckDB that gives the rows of those operators that SQL can express."""

from __future__ import annotations

import os

from .bpe import VOCAB
from .common import _ODD, data_dir_vocab
from .fingerprints import BLOCKS
from .lines import SHINGLE
from .packing import CAPACITY, CLUSTER_K
from .simhash import _PER_WORD, BITS, BLOCKS as SIMHASH_BLOCKS, K
from .suffixes import MIN_WORDS
from .toxicity import BASE, DIRECT, FUZZY, MARKS, MIN_CONTEXTS, MIN_FUZZY, MIN_FUZZY2, MIN_RATIO, MIN_VARIED, ORDINARY, PAIRS, QUOTE_BYTES, QUOTED, SAYING, THRESHOLD, WINDOW, YOU, varied

_SPACE = r"\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_UNSPACED = r"[\p{Hiragana}\p{Katakana}\p{Han}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
WORDS = rf"regexp_extract_all(regexp_replace(lower(text), '({_UNSPACED})', ' \1 ', 'g'), '[\p{{L}}\p{{N}}\p{{M}}]+')"


def _vocabulary() -> str:
    path = os.path.join(data_dir_vocab(), VOCAB).replace("'", "''")
    return f"SELECT hex(from_base64(token)) AS t, id FROM read_csv('{path}', delim = ' ', header = false, quote = '', escape = '', columns = {{'token': 'VARCHAR', 'id': 'INTEGER'}})"


def byte_pairs() -> str:
    """WITH clauses ending in ``e``: (doc_id, text, tokens).

    Pieces of the pre-tokenizer, of which the last character of a run of white space belongs to what follows; each distinct piece is
    merged pair by pair, the least and then leftmost first.
    """
    piece = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+".replace("'", "''")
    parts = rf"string_split(regexp_replace(text, '([{_SPACE}])([{_SPACE}][^{_SPACE}])', '\1' || chr(31) || '\2', 'g'), chr(31))"
    return rf"""WITH RECURSIVE vocabulary AS MATERIALIZED ({_vocabulary()}),
 numbered AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
 cut AS MATERIALIZED (SELECT r, flatten(list_transform({parts}, lambda x: regexp_extract_all(x, '{piece}'))) AS ps FROM numbered),
 piece AS MATERIALIZED (SELECT DISTINCT unnest(ps) AS p FROM cut),
 merged(p, ts, step) AS (
  SELECT p, CASE WHEN hex(encode(p)) IN (SELECT t FROM vocabulary) THEN [hex(encode(p))] ELSE regexp_extract_all(hex(encode(p)), '..') END, 0 FROM piece
  UNION ALL
  SELECT p, list_concat(ts[:i - 1], [ts[i] || ts[i + 1]], ts[i + 2:]), step + 1 FROM (
   SELECT p, ts, step, arg_min(i, (id, i)) AS i FROM (SELECT p, ts, step, unnest(range(1, len(ts))) AS i FROM merged WHERE len(ts) > 1) JOIN vocabulary ON t = ts[i] || ts[i + 1] GROUP BY p, ts, step)),
 done AS MATERIALIZED (SELECT p, arg_max(ts, step) AS ts FROM merged GROUP BY p),
 ranked AS MATERIALIZED (SELECT p, list(id ORDER BY k) AS ids FROM (SELECT p, generate_subscripts(ts, 1) AS k, unnest(ts) AS t FROM done) JOIN vocabulary USING (t) GROUP BY p),
 e AS (SELECT doc_id, text, CASE WHEN text IS NOT NULL THEN coalesce(tokens, CAST([] AS INTEGER[])) END AS tokens FROM numbered LEFT JOIN (
  SELECT r, flatten(list(ids ORDER BY k)) AS tokens FROM (SELECT r, generate_subscripts(ps, 1) AS k, unnest(ps) AS p FROM cut) JOIN ranked USING (p) GROUP BY r) USING (r))"""


def encoded() -> str:
    return byte_pairs() + " SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, tokens, CAST(octet_length(encode(text)) AS BIGINT) AS decoded_bytes, CASE WHEN text IS NOT NULL THEN true END AS round_trip FROM e"


def token_counts() -> str:
    return byte_pairs() + " SELECT doc_id, CAST(coalesce(len(tokens), 0) AS BIGINT) AS n_tokens FROM e"


def multiset_fingerprints() -> str:
    blank = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
    return f"""WITH numbered AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
 paragraph AS MATERIALIZED (SELECT r, sha256(p) AS own FROM (SELECT r, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x, {blank}))) AS p FROM numbered) WHERE p <> ''),
 block AS (SELECT r, b, sha256(b || ':' || own) AS h FROM paragraph, (SELECT unnest(range({BLOCKS})) AS b)),
 lane AS (SELECT r, b * 8 + k AS lane, sum(CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT)) % 4294967296 AS v FROM block, (SELECT CAST(unnest(range(8)) AS INTEGER) AS k) GROUP BY ALL),
 vector AS (SELECT r, string_agg(lpad(to_hex(CAST(v AS BIGINT)), 8, '0'), '' ORDER BY lane) AS v FROM lane GROUP BY r),
 counted AS (SELECT r, CAST(count(*) AS INTEGER) AS n FROM paragraph GROUP BY r),
 full_ AS (SELECT doc_id, coalesce(n, 0) AS n_paragraphs, CASE WHEN text IS NOT NULL THEN lower(coalesce(v, repeat('0', {64 * BLOCKS}))) END AS vector FROM numbered LEFT JOIN vector USING (r) LEFT JOIN counted USING (r))
 SELECT doc_id, CAST(n_paragraphs AS INTEGER) AS n_paragraphs, vector, substr(sha256(unhex(vector)), 1, 32) AS digest FROM full_"""


def repeated_passages() -> str:
    n = MIN_WORDS
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, dense_rank() OVER (ORDER BY doc_id, text) AS k, doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL),
 win AS MATERIALIZED (SELECT r, k, doc_id, i, md5(array_to_string(w[i + 1:i + {n}], ' ')) AS h FROM (SELECT *, unnest(range(len(w) - {n - 1})) AS i FROM d WHERE len(w) >= {n})),
 again AS (SELECT DISTINCT k, doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
 island AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY i) AS s FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY k ORDER BY i) <= {n} THEN 0 ELSE 1 END AS new FROM again))
 SELECT doc_id, CAST(min(i) AS INTEGER) AS start_word, CAST(max(i) + {n} AS INTEGER) AS end_word, CAST(max(i) + {n} - min(i) AS INTEGER) AS n_words FROM island GROUP BY k, doc_id, s"""


def duplicate_lines() -> str:
    """Exact: candidates by the rarest shingles, of which pairs that are alike share one, then Jaccard and connected components."""
    blank = "' ' || chr(9) || chr(13)"
    n = SHINGLE
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL),
 occ AS MATERIALIZED (SELECT * FROM (SELECT r, doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line, trim(unnest(ls), {blank}) AS x FROM (SELECT *, string_split(text, chr(10)) AS ls FROM d)) WHERE x <> ''),
 own AS MATERIALIZED (SELECT x, row_number() OVER (ORDER BY x) AS u FROM (SELECT DISTINCT x FROM occ)),
 sh AS MATERIALIZED (SELECT DISTINCT u, substr(h, 2 * i + 1, {2 * n}) AS s FROM (SELECT u, h, unnest(range(length(h) // 2 - {n - 1})) AS i FROM (SELECT u, hex(encode(x)) AS h FROM own) WHERE length(h) >= {2 * n})),
 n AS MATERIALIZED (SELECT u, count(*) AS n FROM sh GROUP BY u),
 rare AS MATERIALIZED (SELECT u, s FROM (SELECT u, s, n, row_number() OVER (PARTITION BY u ORDER BY f, s) AS k FROM sh JOIN (SELECT s, count(*) AS f FROM sh GROUP BY s) USING (s) JOIN n USING (u)) WHERE k <= n - (4 * n + 4) // 5 + 1),
 pair AS MATERIALIZED (SELECT DISTINCT a.u, b.u AS v FROM rare a JOIN rare b USING (s) JOIN n na ON na.u = a.u JOIN n nb ON nb.u = b.u WHERE a.u < b.u AND 5 * least(na.n, nb.n) >= 4 * greatest(na.n, nb.n)),
 both_ AS (SELECT p.u, p.v, count(*) AS c FROM pair p JOIN sh a ON a.u = p.u JOIN sh b ON b.u = p.v AND b.s = a.s GROUP BY p.u, p.v),
 like_ AS MATERIALIZED (SELECT b.u, b.v FROM both_ b JOIN n na ON na.u = b.u JOIN n nb ON nb.u = b.v WHERE 5 * c >= 4 * (na.n + nb.n - c)),
 edge AS MATERIALIZED (SELECT u, v FROM like_ UNION ALL SELECT v, u FROM like_),
 reach(u, v) AS (SELECT u, u FROM own UNION SELECT reach.u, edge.v FROM reach JOIN edge ON edge.u = reach.v),
 root AS (SELECT u, min(v) AS g FROM reach GROUP BY u),
 line AS MATERIALIZED (SELECT occ.doc_id, occ.line, g, r, row_number() OVER (PARTITION BY g ORDER BY occ.doc_id NULLS LAST, r, occ.line) AS k, count(*) OVER (PARTITION BY g) AS n FROM occ JOIN own USING (x) JOIN root USING (u))
 SELECT line.doc_id, line.line AS line_no, f.doc_id AS first_doc_id, f.line AS first_line_no, line.n AS group_lines, line.k = 1 AS keep FROM line JOIN line f ON f.g = line.g AND f.k = 1 WHERE line.n > 1"""


_FULL = 1 << 64


def _times(x: str, m: int) -> str:
    """x * m modulo 2**64, by halves of x so that 128 bits are enough."""
    return f"CAST(((CAST({x} AS HUGEINT) % 4294967296) * {m} + ((CAST({x} AS HUGEINT) // 4294967296) * {m} % 4294967296) * 4294967296) % {_FULL} AS UBIGINT)"


def _mixed(src: str, x: str, out: str) -> str:
    """The rows of a subquery with ``out``, the mixed 64-bit word x."""
    t = f"SELECT *, CAST(({x}) % {_FULL} AS UBIGINT) AS m0 FROM ({src})"
    t = f"SELECT * EXCLUDE (m0), xor(m0, m0 >> 30) AS m0 FROM ({t})"
    t = f"SELECT * EXCLUDE (m0), {_times('m0', 0xBF58476D1CE4E5B9)} AS m0 FROM ({t})"
    t = f"SELECT * EXCLUDE (m0), xor(m0, m0 >> 27) AS m0 FROM ({t})"
    t = f"SELECT * EXCLUDE (m0), {_times('m0', 0x94D049BB133111EB)} AS m0 FROM ({t})"
    return f"SELECT * EXCLUDE (m0), xor(m0, m0 >> 31) AS {out} FROM ({t})"


def near_duplicates(k_bits: int = K) -> str:
    """All pairs of fingerprints, and components of those within K bits."""
    golden = 0x9E3779B97F4A7C15
    # the hash of a word: a polynomial of its bytes, and its length, mixed
    raw = f"SELECT w, CAST(length(h) // 2 AS HUGEINT) + list_sum(list_transform(range(1, length(h) // 2 + 1), lambda j: (CAST('0x' || substr(h, 2 * j - 1, 2) AS HUGEINT) + 1) * powers[j] % {_FULL})) AS a FROM (SELECT DISTINCT w, hex(encode(w)) AS h FROM own), (SELECT list(p ORDER BY j) AS powers FROM power)"
    hashed = _mixed(f"SELECT w, a % {_FULL} AS a FROM ({raw})", "a", "x0")
    n_words = -(-SIMHASH_BLOCKS * BITS // _PER_WORD)
    for k in range(1, n_words):
        hashed = _mixed(hashed, f"CAST(x0 AS HUGEINT) + {golden * k % _FULL}", f"x{k}")
    place = lambda c: (c // _PER_WORD, c % _PER_WORD // 4 + 16 * (c % 4))
    votes = ", ".join(f"sum(CAST((x{w} >> {at}) & 1 AS INTEGER)) AS c{c}" for c in range(SIMHASH_BLOCKS * BITS) for w, at in [place(c)])
    longs = -(-SIMHASH_BLOCKS // 2)
    f = ", ".join(" + ".join(f"CASE WHEN 2 * c{c} > total THEN {1 << (c - 2 * BITS * j)} ELSE 0 END" for c in range(2 * BITS * j, min(2 * BITS * (j + 1), SIMHASH_BLOCKS * BITS))) + f" AS f{j}" for j in range(longs))
    fs = ", ".join(f"f{j}" for j in range(longs))
    far = " + ".join(f"bit_count(xor(a.f{j}, b.f{j}))" for j in range(longs))
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, text, count(*) AS n_rows, row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS r FROM documents WHERE text IS NOT NULL GROUP BY doc_id, text),
 own AS MATERIALIZED (SELECT DISTINCT r, unnest({WORDS}) AS w FROM d),
 power(j, p) AS (SELECT 1, CAST(1 AS UBIGINT) UNION ALL SELECT j + 1, {_times('p', int(_ODD))} FROM power WHERE j < (SELECT max(octet_length(encode(w))) FROM own)),
 word AS MATERIALIZED ({hashed}),
 vote AS (SELECT r, count(*) AS total, {votes} FROM own JOIN word USING (w) GROUP BY r),
 print AS MATERIALIZED (SELECT r, {f} FROM vote),
 node AS MATERIALIZED (SELECT {fs}, row_number() OVER (ORDER BY {fs}) AS u FROM (SELECT DISTINCT {fs} FROM print)),
 edge AS MATERIALIZED (SELECT a.u, b.u AS v FROM node a, node b WHERE a.u <> b.u AND {far} <= {k_bits}),
 reach(u, v) AS (SELECT u, u FROM node UNION SELECT reach.u, edge.v FROM reach JOIN edge ON edge.u = reach.v),
 root AS (SELECT u, min(v) AS g FROM reach GROUP BY u),
 member AS MATERIALIZED (SELECT g, d.r, doc_id, n_rows FROM print JOIN node USING ({fs}) JOIN root USING (u) JOIN d USING (r)),
 grp AS (SELECT g, min(r) AS first, CAST(sum(n_rows) AS BIGINT) AS group_rows FROM member GROUP BY g)
 SELECT m.doc_id, f.doc_id AS group_id, m.n_rows, group_rows, m.r = first AS keep FROM member m JOIN grp USING (g) JOIN d f ON f.r = first WHERE group_rows > 1"""


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in sorted(values))


def toxicity() -> str:
    """Every word against every term; distances are counted in characters, and all labels are read, as there are few here."""
    variants = {v for t in BASE if MIN_VARIED <= len(t) < MIN_FUZZY for v in varied(t)} - set(BASE)
    long_terms = _list(t for t in BASE if len(t) >= MIN_FUZZY)
    tokens = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    pattern = rf"{_UNSPACED}|[\p{{L}}\p{{N}}\p{{M}}]+"
    start = "list_sum(list_transform(gaps[1:k], lambda q: length(q))) + coalesce(list_sum(list_transform(ws[1:k - 1], lambda q: length(q))), 0)"
    marks = "".join(sorted(MARKS))
    pairs = " OR ".join(f"(l = '{a}' AND r IN ({_list(b)}))" for a, b in PAIRS.items())
    side = lambda x: rf"regexp_replace({x}, '([\p{{L}}\p{{N}}\p{{M}}])’([\p{{L}}\p{{N}}\p{{M}}])', '\1_\2', 'g')"
    before, after = side("lhs"), side("rhs")
    return rf"""WITH mark AS (SELECT doc_id, max(toxic > 0) AS toxic FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
 lab AS MATERIALIZED (SELECT text, max(toxic) AS toxic, {tokens} AS w FROM (SELECT doc_id, text FROM documents) JOIN mark USING (doc_id) WHERE text IS NOT NULL GROUP BY text),
 size AS (SELECT count(*) FILTER (WHERE toxic) AS na, count(*) FILTER (WHERE NOT toxic) AS nb FROM lab),
 bad AS (SELECT w AS word, count(DISTINCT before) AS contexts, count(DISTINCT text) AS a FROM (SELECT text, unnest(w) AS w, unnest(list_concat([''], w[:len(w) - 1])) AS before FROM lab WHERE toxic) WHERE length(w) >= 4 GROUP BY ALL),
 good AS (SELECT word, count(*) AS b FROM (SELECT unnest(list_distinct(w)) AS word FROM lab WHERE NOT toxic) GROUP BY word),
 both_ AS MATERIALIZED (SELECT word, coalesce(contexts, 0) AS contexts, coalesce(b, 0) AS b, ((coalesce(a, 0) + 0.1::DOUBLE) / (na + 1)) / ((coalesce(b, 0) + 0.1::DOUBLE) / (nb + 1)) AS ratio FROM good FULL JOIN bad USING (word), size),
 term AS MATERIALIZED (SELECT word FROM both_ WHERE contexts >= {MIN_CONTEXTS} AND ratio >= {MIN_RATIO} UNION SELECT unnest([{_list(BASE)}])),
 d AS MATERIALIZED (SELECT row_number() OVER () AS i, doc_id, lower(text) AS x FROM documents),
 cut AS MATERIALIZED (SELECT i, x, regexp_extract_all(x, '{pattern}') AS ws, string_split_regex(x, '{pattern}') AS gaps FROM d WHERE x IS NOT NULL),
 place AS MATERIALIZED (SELECT i, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS w FROM cut),
 word AS MATERIALIZED (SELECT DISTINCT w FROM place),
 near AS MATERIALIZED (SELECT DISTINCT w FROM word, (SELECT unnest([{long_terms}]) AS t) WHERE abs(length(w) - length(t)) <= 2 AND damerau_levenshtein(w, t) <= CASE WHEN length(t) >= {MIN_FUZZY2} THEN 2 ELSE 1 END),
 common AS MATERIALIZED (SELECT word FROM both_ WHERE b > 0 AND ratio < {MIN_RATIO} UNION SELECT unnest([{_list(ORDINARY)}])),
 hit AS MATERIALIZED (SELECT w, w IN (SELECT word FROM term) AS exact FROM word WHERE w IN (SELECT word FROM term) OR (w IN ({_list(variants)}) OR w IN (SELECT w FROM near)) AND w NOT IN (SELECT word FROM common)),
 found AS MATERIALIZED (SELECT i, k, w, exact, CAST({start} AS INTEGER) AS s, ws, x FROM place JOIN hit USING (w) JOIN cut USING (i)),
 side AS (SELECT *, regexp_extract(left(x, s), '[^\n]*$') AS lhs, regexp_extract(substr(x, s + length(w) + 1), '^[^\n]*') AS rhs FROM found),
 seen AS (SELECT *, regexp_extract({before}, '([{marks}])[^{marks}]*$', 1) AS l, length(regexp_extract({before}, '[^{marks}]*$')) AS ln, regexp_extract({after}, '^[^{marks}]*([{marks}])', 1) AS r, length(regexp_extract({after}, '^[^{marks}]*')) AS rn FROM side),
 judged AS (SELECT *, len(list_filter(ws[greatest(k - 3, 1):k - 1], lambda q: q IN ({_list(SAYING)}))) > 0 OR (right(lhs, 1) = left(rhs, 1) AND left(rhs, 1) IN ('''', '`'))
   OR ((length(lhs) - length(replace(lhs, '"', ''))) % 2 = 1 AND contains(rhs, '"')) OR (({pairs}) AND ln < {QUOTE_BYTES} AND rn < {QUOTE_BYTES}) AS quoted,
  len(list_filter(ws[greatest(k - {WINDOW}, 1):k + {WINDOW}], lambda q: q IN ({_list(YOU)}))) > 0 AS direct FROM seen),
 doc AS (SELECT i, CAST(count(*) AS INTEGER) AS n_hits, CAST(count(*) FILTER (WHERE NOT exact) AS INTEGER) AS n_fuzzy, CAST(count(*) FILTER (WHERE quoted) AS INTEGER) AS n_quoted,
  round(sum(CASE WHEN exact THEN 1.0::DOUBLE ELSE {FUZZY}::DOUBLE END * CASE WHEN quoted THEN {QUOTED}::DOUBLE WHEN direct THEN {DIRECT}::DOUBLE ELSE 1.0::DOUBLE END), 6) AS score, list_sort(list(DISTINCT w)) AS terms FROM judged GROUP BY i)
 SELECT doc_id, coalesce(n_hits, 0) AS n_hits, coalesce(n_fuzzy, 0) AS n_fuzzy, coalesce(n_quoted, 0) AS n_quoted, coalesce(score, 0.0::DOUBLE) AS score, coalesce(score, 0.0::DOUBLE) >= {THRESHOLD}::DOUBLE AS toxic, coalesce(terms, CAST([] AS VARCHAR[])) AS terms FROM d LEFT JOIN doc USING (i)"""


def best_fit() -> str:
    """Best fit as a fold over the pieces, of a table that is one group and has each id once: the state is the list of open bins."""
    sized = byte_pairs().replace("WITH RECURSIVE", "WITH RECURSIVE near AS MATERIALIZED (SELECT doc_id, group_id FROM (" + near_duplicates(CLUSTER_K) + ")),", 1)
    return sized + f""",
 doc AS MATERIALIZED (SELECT documents.doc_id, source, coalesce('g' || group_id, 't' || md5(documents.text)) AS cluster FROM documents LEFT JOIN near USING (doc_id)),
 sized AS MATERIALIZED (SELECT doc.*, coalesce(len(tokens), 0) AS n FROM doc JOIN e USING (doc_id)),
 item AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY size DESC, doc_id NULLS LAST, k) AS step FROM (SELECT *, least({CAPACITY}, n - k * {CAPACITY}) AS size FROM (SELECT *, unnest(range((n + {CAPACITY - 1}) // {CAPACITY})) AS k FROM sized WHERE n > 0))),
 fold(step, bins, chosen) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(room BIGINT, s VARCHAR[], c VARCHAR[])[]), CAST(0 AS BIGINT)
  UNION ALL SELECT step, CASE WHEN best > len(bins) THEN list_append(bins, {{'room': {CAPACITY} - size, 's': [source], 'c': [cluster]}}) ELSE list_transform(bins, lambda b, i: CASE WHEN i = best THEN {{'room': b.room - size, 's': list_append(b.s, source), 'c': list_append(b.c, cluster)}} ELSE b END) END, best
  FROM (SELECT p.step, p.size, p.source, p.cluster, bins, coalesce(list_min(list_transform(list_filter(range(1, len(bins) + 1), lambda i: bins[i].room >= p.size AND NOT coalesce(list_contains(bins[i].s, p.source), false) AND NOT list_contains(bins[i].c, p.cluster)), lambda i: bins[i].room * 1000000000 + i)) % 1000000000, len(bins) + 1) AS best FROM fold JOIN item p ON p.step = fold.step + 1))
 SELECT CAST(chosen - 1 AS BIGINT) AS bin_id, CAST(row_number() OVER (PARTITION BY chosen ORDER BY step) - 1 AS INTEGER) AS slot, doc_id, CAST(k AS INTEGER) AS piece, CAST(k * {CAPACITY} AS BIGINT) AS start, CAST(size AS INTEGER) AS n_tokens FROM fold JOIN item USING (step)
 UNION ALL SELECT NULL, NULL, doc_id, 0, 0, 0 FROM sized WHERE n = 0"""
