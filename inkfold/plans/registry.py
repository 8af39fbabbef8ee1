"""Named queries and, where SQL can say it, the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import PHRASES, RULES
from ..operators import decisions, extraction, postprocess, prompts, rules, scoring, severity, similarity, splitting
from ..sources.session import settle
from ..sources.tables import problem, read, spread
from ..streaming import events as ev
from . import analysis, planted, sql, sql_text

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return fn

    return add


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents"))


def all_planted(spark: SparkSession, d: str) -> DataFrame:
    return planted.plant(documents(spark, d).select("doc_id", "text"), planted.ALL)


ALL_SQL = planted.plant_sql(planted.ALL)
PLAIN_SQL = "SELECT doc_id, text FROM documents"
r4 = lambda c: F.round(c, 4)

# splitting


@query("sentence_split", f"SELECT doc_id, idx, text, {sql.words('text')} AS n_words FROM ({sql.sentences(PLAIN_SQL)})")
def _(spark, d):
    return rules.split_documents(documents(spark, d))


@query("sentence_len_stats", f"SELECT doc_id, count(*) AS n, min(w) AS least, max(w) AS most, round(avg(w), 4) AS mean, round(coalesce(stddev_samp(w), 0), 4) AS std FROM (SELECT doc_id, {sql.words('text')} AS w FROM ({sql.sentences(PLAIN_SQL)})) GROUP BY doc_id")
def _(spark, d):
    w = F.col("n_words")
    return rules.split_documents(documents(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n"), F.min(w).alias("least"), F.max(w).alias("most"), r4(F.avg(w)).alias("mean"), r4(F.coalesce(F.stddev_samp(w), F.lit(0.0))).alias("std"))


_PARAS = r"list_filter(list_transform(string_split_regex(" + sql.strip("text") + r", '\n\s*\n'), lambda x: " + sql.strip("x") + "), lambda x: x <> '')"


@query("paragraphs", f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, p FROM (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM (SELECT doc_id, {_PARAS} AS ps FROM (SELECT doc_id, {sql.clean_text('text')} AS text FROM documents)))")
def _(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(splitting.paragraphs(T.clean_text(F.col("text"), compose=False))).alias("i", "p"))


_CJK = ["你好。再见！真的？", "End.Next one。是", "plain"]


@query("cjk_sentences", sql_text.cjk_sentences(planted.plant_sql(_CJK)))
def _(spark, d):
    docs = planted.plant(documents(spark, d).select("doc_id", "text"), _CJK)
    return docs.select("doc_id", F.posexplode(splitting.cjk_sentences(F.col("text"))).alias("i", "s"))


@query("split_finer", f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, p FROM (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM (
 SELECT doc_id, CASE WHEN count(*) <= 1 THEN [any_value(body)] ELSE list(pair ORDER BY k) END AS ps FROM (
  SELECT doc_id, idx // 2 AS k, string_agg(text, ' ' ORDER BY idx) AS pair, any_value(body) AS body FROM (SELECT a.*, b.text AS body FROM ({sql.sentences("SELECT doc_id, " + r"regexp_replace(text, '([.!?])([A-Z])', '\1 \2', 'g')" + " AS text FROM documents")}) a JOIN documents b USING (doc_id)) GROUP BY doc_id, idx // 2) GROUP BY doc_id
  HAVING count(*) > 1))""")
def _(spark, d):
    fine = splitting.split_finer(F.col("text"), 1)
    return documents(spark, d).select("doc_id", fine.alias("ps")).where("size(ps) > 1").select("doc_id", F.posexplode("ps").alias("i", "p"))


@query("chunk_sentences", sql_text.chunks(PLAIN_SQL, 200))
def _(spark, d):
    return T.exploded(splitting.chunks(documents(spark, d).select("doc_id", "text")), "chunks", "i", "c", "doc_id").select("doc_id", "i", "c.text", "c.para_idx")


@query("chunk_merge", sql_text.merged_chunks(f"SELECT doc_id, {sql.clean_text('text')} AS text FROM documents", 600))
def _(spark, d):
    docs = documents(spark, d).select("doc_id", T.clean_text(F.col("text"), compose=False).alias("text"))
    return T.exploded(splitting.chunks(docs, 600, merge=True), "chunks", "i", "c", "doc_id").select("doc_id", "i", "c.text", "c.para_idx")


@query("hard_split", sql_text.hard_split(r"SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM documents", 120))
def _(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(splitting.hard_split(F.regexp_replace("text", r"\s+", " "), 120)).alias("i", "piece"))


@query("segments", sql_text.segments(PLAIN_SQL))
def _(spark, d):
    return splitting.segments(documents(spark, d))


@query("split_align", f"SELECT doc_id, CAST(len(s) AS INTEGER) AS n_new, CASE WHEN len(s) = 5 THEN s WHEN len(s) > 5 THEN list_concat(s[1:4], [array_to_string(s[5:], ' ')]) ELSE list_concat(s, list_transform(range(5 - len(s)), lambda x: '')) END AS aligned FROM (SELECT doc_id, list(text ORDER BY idx) AS s FROM ({sql.sentences(PLAIN_SQL)}) GROUP BY doc_id)")
def _(spark, d):
    own = documents(spark, d).select("doc_id", T.sentences(F.col("text")).alias("s")).where("size(s) > 0")
    return own.select("doc_id", F.size("s").alias("n_new"), splitting.align(F.col("s"), F.lit(5)).alias("aligned"))


# rules


def _rule_query(rule: str) -> None:
    extra = planted.sentences_for(rule)

    @query("rule_" + rule.split(".")[1], sql.rule_counts(rule, planted.plant_sql(extra)))
    def _(spark, d):
        docs = planted.plant(documents(spark, d).select("doc_id", "text"), extra)
        return rules.analyze(docs, rules=[rule]).select("doc_id", "idx", F.size("violations").alias("n")).where("n > 0")


for _r in sql.SENTENCE_RULES:
    _rule_query(_r)

_PAGES = "SELECT page_id, html AS text FROM pages"
for _r in ("punct.em_dash", "punct.semicolon"):

    @query(f"pages_{_r.split('.')[1]}", sql.rule_counts(_r, _PAGES, "page_id"))
    def _(spark, d, rule=_r):
        return rules.analyze(spread(read(spark, d, "pages")), "page_id", "html", [rule]).select("doc_id", "idx", F.size("violations").alias("n")).where("n > 0")


@query("rule_uniform_rhythm", f"WITH s AS ({sql.sentences(PLAIN_SQL)}) {sql.rhythm()}")
def _(spark, d):
    own = documents(spark, d).select("doc_id", F.transform(T.sentences(F.col("text")), T.word_count).alias("c"))
    return own.select("doc_id", rules.rhythm_window(F.col("c")).alias("first_idx")).where("first_idx is not null")


_PASSIVE = planted.SAMPLES["syntax.passive_stack"]


@query("rule_passive_stack", f"WITH s AS ({sql.sentences(planted.plant_sql(_PASSIVE))}) {sql.passive()}")
def _(spark, d):
    own = planted.plant(documents(spark, d).select("doc_id", "text"), _PASSIVE).select("doc_id", "text", T.sentences(F.col("text")).alias("s"))
    return own.select("doc_id", rules.passive_window(F.col("s"), F.col("text")).alias("first_idx")).where("first_idx is not null")


_HUMAN = ["Well, is it so?", "It is so.", "They really came at least once.", "Swell.", ""]


@query("rule_human_deficit", f"WITH src AS ({planted.plant_sql(_HUMAN)}), s AS ({sql.sentences('SELECT * FROM src')}) {sql.deficits()}")
def _(spark, d):
    docs = planted.plant(documents(spark, d).select("doc_id", "text"), _HUMAN)
    own = docs.where(T.strip(F.col("text")) != "").select("doc_id", "text", F.array_min(F.transform(T.sentences(F.col("text")), T.word_count)).alias("c"))
    return own.select("doc_id", (~rules.has_colloquial(F.lower("text"))).alias("no_colloquial"), (F.col("c") > rules.SHORT_WORDS).alias("no_short_sentence"), (~F.col("text").contains("?")).alias("no_question"))


@query("violation_spans", f"SELECT doc_id, idx, CAST(p - 1 AS INTEGER) AS start, CAST(p AS INTEGER) AS \"end\", text[greatest(p - 15, 1):p + 15] AS context FROM (SELECT doc_id, idx, text, unnest(list_filter(range(1, length(text) + 1), lambda i: text[i] = ';')) AS p FROM ({sql.sentences(_PAGES, 'page_id')}))")
def _(spark, d):
    own = rules.analyze(spread(read(spark, d, "pages")), "page_id", "html", ["punct.semicolon"])
    return own.select("doc_id", "idx", F.explode("violations").alias("v")).select("doc_id", "idx", F.col("v.span.start").alias("start"), F.col("v.span.end").alias("end"), "v.context")


@query("violations", sql_text.violations(ALL_SQL) + " SELECT * FROM viol")
def _(spark, d):
    own = rules.analyze(all_planted(spark, d)).select("doc_id", "idx", F.posexplode("violations").alias("pos", "v"))
    return own.select("doc_id", "idx", "pos", "v.rule_id", "v.severity", "v.span.start", "v.span.end", "v.context", "v.suggestion")


# grading

_HIST = ", ".join(f"count(*) FILTER (WHERE rule_severity = '{s}') AS n_{s}" for s in severity.LEVELS)


@query("rule_severity", sql.graded(ALL_SQL) + " SELECT doc_id, idx, rule_severity, n_violations FROM v")
def _(spark, d):
    return analysis.graded(all_planted(spark, d)).select("doc_id", "idx", "rule_severity", F.size("violations").alias("n_violations"))


@query("severity_histogram", sql.graded(PLAIN_SQL) + f" SELECT doc_id, {_HIST}, count(*) AS n_sentences, CAST(sum(n_violations) AS BIGINT) AS n_violations FROM v GROUP BY doc_id")
def _(spark, d):
    return severity.histogram(analysis.graded(documents(spark, d)))


@query("top_issues", sql.graded(ALL_SQL) + f" SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at) AS INTEGER) AS rank, rule_id, n FROM (SELECT doc_id, rule_id, CAST(sum(n) AS BIGINT) AS n, min(idx * 100 + o) AS first_at FROM ({sql.by_rule()}) GROUP BY doc_id, rule_id)")
def _(spark, d):
    return severity.top_issues(analysis.graded(all_planted(spark, d)))


@query("violations_by_category_rollup", sql.graded(ALL_SQL) + f" SELECT split_part(rule_id, '.', 1) AS category, rule_id, CAST(sum(n) AS BIGINT) AS n FROM ({sql.by_rule()}) GROUP BY ROLLUP (category, rule_id)")
def _(spark, d):
    return severity.rollup_by_category(analysis.graded(all_planted(spark, d)))


_NEW = "(rule_id LIKE 'content.%' OR rule_id LIKE 'artifact.%' OR rule_id LIKE 'style.%' OR rule_id = 'struct.tailing_negation')"


@query("rule_family_split", sql.graded(ALL_SQL) + f" SELECT doc_id, CAST(coalesce(sum(n) FILTER (WHERE {_NEW}), 0) AS BIGINT) AS n_new, CAST(coalesce(sum(n) FILTER (WHERE NOT {_NEW}), 0) AS BIGINT) AS n_old FROM ({sql.by_rule()}) GROUP BY doc_id")
def _(spark, d):
    return severity.split_by_family(analysis.graded(all_planted(spark, d)))


_TOP = f"SELECT doc_id, rule_id, CAST(sum(n) AS BIGINT) AS n, min(idx * 100 + o) AS first_at FROM ({sql.by_rule()}) GROUP BY doc_id, rule_id"


@query("document_analysis", sql.graded(ALL_SQL) + f", h AS (SELECT doc_id, {_HIST}, count(*) AS n_sentences, CAST(sum(n_violations) AS BIGINT) AS n_violations FROM v GROUP BY doc_id) SELECT h.*, coalesce(top_issues, CAST([] AS VARCHAR[])) AS top_issues FROM h LEFT JOIN (SELECT doc_id, list(rule_id ORDER BY n DESC, first_at) AS top_issues FROM ({_TOP}) GROUP BY doc_id) USING (doc_id)")
def _(spark, d):
    return analysis.document_analysis(analysis.graded(all_planted(spark, d)))


@query("human_deficits", sql.graded(ALL_SQL) + " SELECT doc_id, list_filter([CASE WHEN r22 > 0 THEN 'human.no_colloquial' END, CASE WHEN r23 > 0 THEN 'human.no_short_sentence' END, CASE WHEN r24 > 0 THEN 'human.no_question' END], lambda x: x IS NOT NULL) AS deficits FROM v WHERE idx = 0")
def _(spark, d):
    return severity.human_deficits(rules.analyze(all_planted(spark, d), rules=severity.HUMAN))


@query("detector_scores", sql.scored(ALL_SQL) + " SELECT doc_id, idx, ai_score, CASE WHEN ai_score > 0.5 THEN 'ai' ELSE 'human' END AS label FROM z")
def _(spark, d):
    return analysis.scored(all_planted(spark, d)).select("doc_id", "idx", "ai_score", scoring.label(F.col("ai_score"))["label"].alias("label"))


@query("z_scores", sql.scored(ALL_SQL) + " SELECT doc_id, idx, round(doc_mean, 4) AS doc_mean, round(doc_std, 4) AS doc_std, model_useful, round(ai_z_score, 3) AS z FROM z")
def _(spark, d):
    return analysis.scored(all_planted(spark, d)).select("doc_id", "idx", r4(F.col("doc_mean")).alias("doc_mean"), r4(F.col("doc_std")).alias("doc_std"), "model_useful", F.round("ai_z_score", 3).alias("z"))


@query("severity_fusion", sql.scored(ALL_SQL) + " SELECT doc_id, severity, count(*) AS n FROM z GROUP BY doc_id, severity")
def _(spark, d):
    return severity.distribution(analysis.scored(all_planted(spark, d)))


@query("heat_rank", sql.scored(ALL_SQL) + " SELECT doc_id, idx, heat FROM z")
def _(spark, d):
    return analysis.scored(all_planted(spark, d)).select("doc_id", "idx", "heat")


@query("already_human", sql.scored(ALL_SQL) + " SELECT doc_id, round(s, 4) AS ai_score, round(c, 4) AS clean_ratio, s < 0.35 OR (s < 0.45 AND c >= 0.7) AS already_human FROM (SELECT doc_id, avg(ai_score) AS s, avg(CAST(rule_severity = 'clean' AS INTEGER)) AS c FROM z GROUP BY doc_id)")
def _(spark, d):
    own = severity.already_human(analysis.scored(all_planted(spark, d)))
    return own.select("doc_id", r4(F.col("ai_score")).alias("ai_score"), r4(F.col("clean_ratio")).alias("clean_ratio"), "already_human")


@query("label_vs_rule_density", sql.graded(ALL_SQL) + " SELECT quality, toxic, count(*) AS n_docs, round(avg(density), 4) AS density FROM labels JOIN (SELECT doc_id, sum(n_violations) / CAST(sum(n_words) AS DOUBLE) AS density FROM v GROUP BY doc_id) USING (doc_id) GROUP BY quality, toxic")
def _(spark, d):
    per = analysis.graded(all_planted(spark, d)).groupBy("doc_id").agg((F.sum(F.size("violations")) / F.sum("n_words")).alias("density"))
    return read(spark, d, "labels").join(per, "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n_docs"), r4(F.avg("density")).alias("density"))


_TURNS = "SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations"


@query("conversation_role_severity", sql.graded(_TURNS) + " SELECT role, rule_severity, count(*) AS n FROM v JOIN (SELECT conv_id * 1000 + turn AS doc_id, role FROM conversations) USING (doc_id) GROUP BY role, rule_severity")
def _(spark, d):
    turns = spread(read(spark, d, "conversations")).withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn"))
    return analysis.graded(turns).join(turns.select("doc_id", "role"), "doc_id").groupBy("role", "rule_severity").agg(F.count("*").alias("n"))


# cleaning and post-processing


@query("clean_text", f"SELECT doc_id, {sql.clean_text('text')} AS text FROM ({planted.plant_sql(planted.CLEAN)})")
def _(spark, d):
    return planted.plant(documents(spark, d).select("doc_id", "text"), planted.CLEAN).select("doc_id", T.clean_text(F.col("text")).alias("text"))


_POST_SQL = planted.plant_sql(planted.POST)


def _post_query(name: str, fix, oracle) -> None:
    @query(f"fix_{name}", oracle and f"SELECT doc_id, {oracle('text')} AS text FROM ({_POST_SQL})")
    def _(spark, d):
        return planted.plant(documents(spark, d).select("doc_id", "text"), planted.POST).select("doc_id", fix(F.col("text")).alias("text"))


for _name, _fix, _ in postprocess.STEPS:
    _post_query(_name, _fix, getattr(sql, f"fix_{_name}", None) or getattr(sql_text, f"fix_{_name}"))


@query("pages_fix_punctuation", f"SELECT page_id, {sql.fix_punctuation('html')} AS html FROM pages")
def _(spark, d):
    return spread(read(spark, d, "pages")).select("page_id", postprocess.fix_punctuation(F.col("html")).alias("html"))


@query("post_process_log", sql_text.post_process(planted.plant_sql(planted.POST)))
def _(spark, d):
    return postprocess.post_process(planted.plant(documents(spark, d).select("doc_id", "text"), planted.POST)).select("doc_id", "fixed", "changes")


@query("doc_validation", "SELECT doc_id, CASE WHEN NOT regexp_matches(text, '\\S') THEN 'blank' WHEN length(text) > 5000 THEN 'too_long' ELSE 'accepted' END AS verdict FROM documents")
def _(spark, d):
    from dataclasses import replace

    from ..functions.config import DEFAULT

    return documents(spark, d).select("doc_id", F.coalesce(problem(F.col("text"), replace(DEFAULT, max_chars=5000)), F.lit("accepted")).alias("verdict"))


# decisions

_CAND_SQL = (
    "SELECT doc_id, ord, CAST(3 + (doc_id * 7 + ord * 13) % 60 AS INTEGER) AS words, CAST(10 + (doc_id * 3) % 40 AS INTEGER) AS source_words, ((doc_id * 37 + ord * 11) % 100) / 100.0::DOUBLE AS ai_score, "
    "((doc_id * 53 + ord * 29) % 100) / 100.0::DOUBLE AS sem, 'c' || doc_id || '-' || ord AS text FROM documents, (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS ord)"
)


def candidates(spark, d) -> DataFrame:
    c = documents(spark, d).select("doc_id", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("ord"))
    i, o = F.col("doc_id"), F.col("ord")
    return c.select(
        "doc_id", "ord", (3 + (i * 7 + o * 13) % 60).cast("int").alias("words"), (10 + (i * 3) % 40).cast("int").alias("source_words"),
        (((i * 37 + o * 11) % 100) / 100.0).alias("ai_score"), (((i * 53 + o * 29) % 100) / 100.0).alias("sem"), F.concat(F.lit("c"), i.cast("string"), F.lit("-"), o.cast("string")).alias("text"),
    )


_LENGTH_OK = "words >= 5 AND NOT (source_words > 20 AND abs(words - source_words) / CAST(source_words AS DOUBLE) > 0.4)"


@query("length_guard", f"SELECT doc_id, ord, {_LENGTH_OK} AS ok FROM ({_CAND_SQL})")
def _(spark, d):
    return candidates(spark, d).select("doc_id", "ord", decisions.length_ok(F.col("words"), F.col("source_words")).alias("ok"))


@query("candidate_select", f"SELECT d.doc_id, coalesce(b.text, 's' || d.doc_id) AS text, b.ord FROM documents d LEFT JOIN (SELECT doc_id, text, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sem > 0.5 DESC, ai_score, ord) AS n FROM ({_CAND_SQL}) WHERE {_LENGTH_OK}) WHERE n = 1) b USING (doc_id)")
def _(spark, d):
    sources = documents(spark, d).select("doc_id", F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("text"))
    return decisions.best_candidates(candidates(spark, d), sources)


@query("retry_gate", f"SELECT doc_id, ord, (ai_score - sem) / greatest(ai_score, 0.01) < 0.15 AND ai_score > 0.25 AND NOT words < 10 AS retry FROM ({_CAND_SQL})")
def _(spark, d):
    return candidates(spark, d).select("doc_id", "ord", decisions.needs_retry(F.col("ai_score"), F.col("sem"), F.col("words") < 10).alias("retry"))


@query("stage4_action", f"SELECT doc_id, ord, CASE WHEN sem >= 0.65 AND words % 2 = 0 THEN 'rewritten' WHEN ai_score >= 0.85 THEN 'deleted' ELSE 'unfixed_risky' END AS action FROM ({_CAND_SQL})")
def _(spark, d):
    return candidates(spark, d).select("doc_id", "ord", decisions.sentence_action(F.col("sem"), F.col("words") % 2 == 0, F.col("ai_score")).alias("action"))


@query("formality_gate", f"SELECT doc_id, ord, CASE WHEN NOT words % 5 < 2 THEN 'skipped' WHEN ai_score <= sem + 0.05 THEN 'accepted' ELSE 'rejected' END AS gate FROM ({_CAND_SQL})")
def _(spark, d):
    genre = F.element_at(F.array(*map(F.lit, ("academic", "professional", "casual", "narrative", "persuasive"))), F.col("words") % 5 + 1)
    return candidates(spark, d).select("doc_id", "ord", decisions.keep_formal(genre, F.col("ai_score"), F.col("sem")).alias("gate"))


@query("polish_settings", f"SELECT doc_id, ord, round(s, 4) AS score, CASE WHEN s > 0.35 THEN 0.8 ELSE 0.7 END::DOUBLE AS temperature, CASE WHEN ai_score > 0.6 THEN 'red' WHEN ai_score > 0.4 THEN 'yellow' ELSE 'green' END AS tier FROM (SELECT *, CASE WHEN words < 10 THEN greatest(ai_score - 0.15, 0) ELSE ai_score END AS s FROM ({_CAND_SQL}))")
def _(spark, d):
    s = decisions.polish_score(F.col("ai_score"), F.col("words") < 10)
    return candidates(spark, d).select("doc_id", "ord", r4(s).alias("score"), decisions.polish_temperature(s).alias("temperature"), decisions.tier(F.col("ai_score")).alias("tier"))


def _budget_sql(name: str) -> str:
    add, most = decisions.TECHNIQUES[name]
    return f"CAST(least({most}, greatest(1, b + {add} + boost)) AS INTEGER) AS {name}"


@query("technique_budget", f"SELECT doc_id, ord, {', '.join(map(_budget_sql, decisions.TECHNIQUE_ORDER))} FROM (SELECT *, greatest(1, (words * 40) // 500) AS b, CASE WHEN ai_score > 0.5 THEN 2 WHEN ai_score > 0.35 THEN 1 ELSE 0 END AS boost FROM ({_CAND_SQL}))")
def _(spark, d):
    own = candidates(spark, d).withColumn("m", decisions.technique_budget(F.col("words") * 40, F.col("ai_score")))
    return own.select("doc_id", "ord", *[F.element_at("m", t).alias(t) for t in decisions.TECHNIQUE_ORDER])


@query("leave_one_out", f"WITH s AS ({sql.sentences(PLAIN_SQL)}) SELECT a.doc_id, a.idx, md5(coalesce(string_agg(b.text, ' ' ORDER BY b.idx), '')) AS rest FROM s a LEFT JOIN s b ON a.doc_id = b.doc_id AND a.idx <> b.idx GROUP BY a.doc_id, a.idx")
def _(spark, d):
    own = documents(spark, d).select("doc_id", F.posexplode(decisions.leave_one_out(T.sentences(F.col("text")))).alias("idx", "t"))
    return own.select("doc_id", "idx", F.md5("t").alias("rest"))


@query("neighbour_context", f"SELECT doc_id, idx, lag(text, 1, '') OVER w AS context_before, lead(text, 1, '') OVER w AS context_after FROM ({sql.sentences(PLAIN_SQL)}) WINDOW w AS (PARTITION BY doc_id ORDER BY idx)")
def _(spark, d):
    return decisions.neighbours(rules.split_documents(documents(spark, d))).select("doc_id", "idx", "context_before", "context_after")


@query("routing", f"SELECT doc_id, CASE WHEN {sql.words('text')} <= 1000 THEN 'short' ELSE 'long' END AS route FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", decisions.route(T.word_count(F.col("text"))).alias("route"))


_BAD = "('critical', 'high')"


@query("stubborn_sentences", sql.scored(ALL_SQL) + f", r AS (SELECT * FROM v WHERE idx % 3 <> 1) SELECT z.doc_id, z.idx, coalesce(r.rule_severity, z.severity) AS now_severity FROM z LEFT JOIN r USING (doc_id, idx) WHERE coalesce(r.rule_severity, z.severity) IN {_BAD}")
def _(spark, d):
    own = settle(analysis.scored(all_planted(spark, d)).select("doc_id", "idx", "severity", "rule_severity"), "scored")  # is used twice
    return decisions.stubborn(own.select("doc_id", "idx", "severity"), own.where("idx % 3 <> 1")).select("doc_id", "idx", "now_severity")


@query("final_remap", f"WITH s AS ({sql.sentences(PLAIN_SQL)}) SELECT s.doc_id, s.idx, coalesce(f.text, s.text) AS final_text FROM s LEFT JOIN (SELECT doc_id, idx, reverse(text) AS text FROM s WHERE idx < 3) f USING (doc_id, idx)")
def _(spark, d):
    own = rules.split_documents(documents(spark, d))
    return decisions.remap(own, own.where("idx < 3").select("doc_id", "idx", F.reverse("text").alias("text"))).select("doc_id", "idx", "final_text")


@query("unfixed_texts", f"SELECT doc_id, list(text ORDER BY idx) AS unfixed FROM ({sql.sentences(PLAIN_SQL)}) WHERE idx % 4 = 1 GROUP BY doc_id")
def _(spark, d):
    own = rules.split_documents(documents(spark, d)).select("doc_id", "idx", F.col("text").alias("final_text"), F.when(F.col("idx") % 4 == 1, "unfixed_risky").otherwise("kept").alias("action"))
    return decisions.unfixed_texts(own)


@query("mark_positions", sql_text.mark_positions(PLAIN_SQL))
def _(spark, d):
    own = documents(spark, d).select("doc_id", "text", F.slice(T.sentences(F.col("text")), 1, 3).alias("needles"))
    return own.select("doc_id", F.posexplode(decisions.mark_positions(F.col("text"), F.col("needles"))).alias("i", "m")).select("doc_id", "i", "m.start", "m.end")


@query("eval_summary", f"SELECT round_even(avg(round_even((1 - sem / greatest(ai_score, 0.01)) * 100, 1)), 4) AS avg_drop, round_even(avg(sem), 4) AS avg_sem, round_even(avg(CAST(ord = words % 3 AS INTEGER)), 4) AS genre_accuracy, count(*) AS n FROM ({_CAND_SQL})")
def _(spark, d):
    return decisions.evaluate(candidates(spark, d).select(F.col("ai_score").alias("orig"), F.col("sem").alias("final"), "sem", F.col("ord").alias("genre"), (F.col("words") % 3).alias("genre_expected")))


# similarity

_VEC = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"


@query("cosine_similarity", f"SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 5) AS sim FROM ({_VEC}) a JOIN ({_VEC}) b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    a = read(spark, d, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(similarity.cosine(F.col("embedding"), F.col("other")), 5).alias("sim"))


@query("sentence_align_top1", f"SELECT vec_id, best_idx, round(s, 5) AS similarity FROM (SELECT a.vec_id, b.vec_id AS best_idx, coalesce(list_cosine_similarity(a.e, b.e), 1.0) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id) AS n FROM ({_VEC}) a LEFT JOIN ({_VEC}) b ON a.label = b.label AND b.vec_id % 2 = 1 WHERE a.vec_id % 2 = 0) WHERE n = 1")
def _(spark, d):
    own = spread(read(spark, d, "embeddings"))
    best = similarity.nearest(own.where("vec_id % 2 = 0"), own.where("vec_id % 2 = 1"), ["label"], "vec_id", "vec_id")
    return best.select("vec_id", "best_idx", F.round("similarity", 5).alias("similarity"))


@query("text_similarity", sql_text.similarity(f"SELECT doc_id, text AS a, {sql.fix_punctuation('''upper(replace(text, 'ß', 'ss'))''')} AS b FROM documents"))
def _(spark, d):
    own = documents(spark, d)
    return own.select("doc_id", F.round(similarity.text_similarity(F.col("text"), postprocess.fix_punctuation(F.upper("text"))), 5).alias("sim"))


# model outputs, prompts

GENRE_ANSWERS = ["academic", "  Narrative. it is", "CASUAL!", "persuasive, mostly", "poem", "", "\"professional\"", "Academic: yes"]


@query("genre_parse", "SELECT doc_id, CASE WHEN g IN ('academic', 'casual', 'narrative', 'persuasive', 'professional') THEN g ELSE 'professional' END AS genre FROM (SELECT doc_id, trim(regexp_extract(lower(a), '\\S+'), '.,;:!?\"''') AS g FROM (SELECT doc_id, ([" + ", ".join(map(planted.sql_literal, GENRE_ANSWERS)) + f"])[doc_id % {len(GENRE_ANSWERS)} + 1] AS a FROM documents))")
def _(spark, d):
    a = F.element_at(F.array(*map(F.lit, GENRE_ANSWERS)), (F.col("doc_id") % len(GENRE_ANSWERS) + 1).cast("int"))
    return documents(spark, d).select("doc_id", scoring.parse_genre(a).alias("genre"))


def _answers(text: Column) -> Column:
    body = F.regexp_replace(F.substring(text, 1, 200), r"[\n\"\\]", " ")
    forms = (
        F.concat(F.lit('{"rewrite": "'), body, F.lit('"}')), F.concat(F.lit('thinking {x} ```json\n{"rewrite": "'), body, F.lit('"}\n```')), F.concat(F.lit('{"rewrite": "a "quoted" '), body, F.lit('"}')),
        F.concat(F.lit('{"rewrite": "'), body), F.concat(F.lit("Rewritten: "), body), F.concat(F.lit("{"), body, F.lit("}")), F.concat(body, F.lit("\n\nNote that I changed it.")),
    )
    return F.element_at(F.array(*forms), (F.col("doc_id") % len(forms) + 1).cast("int"))


@query("extract_rewrite", sql_text.extracted())
def _(spark, d):
    return documents(spark, d).select("doc_id", extraction.extract_rewrite(_answers(F.col("text")), F.substring("text", 1, 200)).alias("rewrite"))


@query("length_guard_text", sql_text.guard_length("text", "text[:150]"))
def _(spark, d):
    return documents(spark, d).select("doc_id", extraction.guard_length(F.col("text"), F.substring("text", 1, 150)).alias("text"))


@query("response_text", "SELECT doc_id, 'to ' || doc_id AS text FROM documents")
def _(spark, d):
    i = F.col("doc_id").cast("string")
    forms = F.array(F.concat(F.lit('{"choices":[{"message":{"content":"to '), i, F.lit('"}}]}')), F.concat(F.lit('{"choices":[{"message":{"content":[{"type":"text","text":"to "},{"type":"text","text":"'), i, F.lit('"}]}}]}')), F.concat(F.lit('{"content":[{"type":"text","text":"to '), i, F.lit('"}]}')))
    return documents(spark, d).select("doc_id", extraction.response_text(F.element_at(forms, (F.col("doc_id") % 3 + 1).cast("int"))).alias("text"))


_LABEL = "CASE WHEN n_violations = 0 AND heat = 'low' THEN 'CLEAN' ELSE concat_ws(' | ', CASE WHEN n_violations > 0 THEN upper(rule_severity) || ': ' || ids END, CASE WHEN heat <> 'low' THEN 'AI-' || heat END) END"


@query("annotated_text", sql.scored(ALL_SQL) + f", ids AS (SELECT doc_id, idx, string_agg(array_to_string(list_transform(range(n), lambda x: rule_id), ', '), ', ' ORDER BY o) AS ids FROM ({sql.by_rule()}) GROUP BY doc_id, idx) SELECT doc_id, md5(string_agg('[' || idx || '][' || {_LABEL} || ']' || CASE WHEN ai_score > 0 THEN format(' (AI:{{:.3f}})', ai_score) ELSE '' END || ' ' || text, chr(10) ORDER BY idx)) AS annotated FROM z LEFT JOIN ids USING (doc_id, idx) GROUP BY doc_id")
def _(spark, d):
    return prompts.annotated(analysis.scored(all_planted(spark, d))).select("doc_id", F.md5("annotated").alias("annotated"))


_LINES = f"string_agg('[' || idx || '][' || {_LABEL} || ']' || CASE WHEN ai_score > 0 THEN format(' (AI:{{:.3f}})', ai_score) ELSE '' END || ' ' || text, chr(10) ORDER BY idx)"
_IDS = f"ids AS (SELECT doc_id, idx, string_agg(array_to_string(list_transform(range(n), lambda x: rule_id), ', '), ', ' ORDER BY o) AS ids FROM ({sql.by_rule()}) GROUP BY doc_id, idx)"


@query("prompt_stage3", sql.scored(ALL_SQL) + f", {_IDS} SELECT doc_id, {sql_text.rewrite_prompt('annotated', 's', chr(39) + 'narrative' + chr(39), 'doc_id % 2 = 0')} AS prompt FROM (SELECT doc_id, {_LINES} AS annotated, avg(ai_score) AS s FROM z LEFT JOIN ids USING (doc_id, idx) GROUP BY doc_id)")
def _(spark, d):
    own = analysis.scored(all_planted(spark, d))
    return prompts.annotated(own, F.avg("ai_score").alias("s")).select("doc_id", prompts.rewrite_prompt(F.col("annotated"), F.col("s"), F.lit("narrative"), F.col("doc_id") % 2 == 0).alias("prompt"))


_ISSUES = "SELECT doc_id, idx, string_agg('- ' || rule_id || ': ' || suggestion, chr(10) ORDER BY pos) AS issues FROM viol GROUP BY doc_id, idx"


@query("prompt_stage4", sql.scored(ALL_SQL).replace(sql.graded(ALL_SQL), sql_text.violations(ALL_SQL)) + f" SELECT doc_id, idx, {sql_text.sentence_prompt('text', 'issues', 'before', 'after', 'ai_score')} AS prompt FROM (SELECT *, lag(text, 1, '') OVER w AS before, lead(text, 1, '') OVER w AS after FROM z WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) LEFT JOIN ({_ISSUES}) USING (doc_id, idx) WHERE rule_severity IN {_BAD}")
def _(spark, d):
    own = decisions.neighbours(analysis.scored(all_planted(spark, d))).where(F.col("rule_severity").isin("critical", "high"))
    return own.select("doc_id", "idx", prompts.sentence_prompt(F.col("text"), F.col("violations"), F.col("context_before"), F.col("context_after"), F.col("ai_score")).alias("prompt"))


_DEFICITS = "list_filter([CASE WHEN r22 > 0 THEN 'human.no_colloquial' END, CASE WHEN r23 > 0 THEN 'human.no_short_sentence' END, CASE WHEN r24 > 0 THEN 'human.no_question' END], lambda x: x IS NOT NULL)"


@query("prompt_stage5", sql.graded(ALL_SQL) + f" SELECT doc_id, {sql_text.polish_prompt('src.text', sql.words('src.text'), 'deficits', 0.4, chr(39) + 'casual' + chr(39))} AS prompt FROM src JOIN (SELECT doc_id, {_DEFICITS} AS deficits FROM v WHERE idx = 0) USING (doc_id)")
def _(spark, d):
    docs = all_planted(spark, d)
    own = docs.join(severity.human_deficits(rules.analyze(docs, rules=severity.HUMAN)), "doc_id")
    budget = decisions.technique_budget(T.word_count(F.col("text")), F.lit(0.4))
    return own.select("doc_id", prompts.polish_prompt(F.col("text"), budget, F.col("deficits"), F.lit(0.4), F.lit("casual")).alias("prompt"))


@query("prompt_stage6", f"SELECT doc_id, {sql_text.formality_prompt('text', 'genre')} AS prompt FROM (SELECT doc_id, text, (['academic', 'professional', 'casual'])[doc_id % 3 + 1] AS genre FROM documents)")
def _(spark, d):
    genre = F.element_at(F.array(*map(F.lit, ("academic", "professional", "casual"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return documents(spark, d).select("doc_id", prompts.formality_prompt(F.col("text"), genre).alias("prompt"))


@query("prompt_genre", f"SELECT doc_id, {sql_text.genre_prompt('text')} AS prompt FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", prompts.genre_prompt(F.col("text")).alias("prompt"))


@query("optimize_documents", sql_text.optimized(ALL_SQL))
def _(spark, d):
    return analysis.optimize(all_planted(spark, d))


@query("run_summary", sql_text.run_summary(ALL_SQL))
def _(spark, d):
    return analysis.run_summary(analysis.run_stages(all_planted(spark, d)))


@query("pipeline_events", sql_text.event_counts(ALL_SQL))
def _(spark, d):
    return ev.pipeline_events(analysis.run_stages(all_planted(spark, d))).groupBy("run_id", "type").agg(F.count("*").alias("n"))


@query("mark_parts", sql_text.marked_parts(PLAIN_SQL))
def _(spark, d):
    own = documents(spark, d).select("doc_id", "text", decisions.mark_positions(F.col("text"), F.slice(T.sentences(F.col("text")), 1, 3)).alias("m"))
    parts = F.transform(decisions.marked_parts(F.col("text"), F.col("m")), lambda p: F.when(p["marked"], F.concat(F.lit("[["), p["text"], F.lit("]]"))).otherwise(p["text"]))
    return own.select("doc_id", F.md5(F.array_join(parts, "")).alias("marked"))


# events


@query("events_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def _(spark, d):
    return ev.tumbling(read(spark, d, "events")).withColumn("total", F.round("total", 2))


@query("events_session", """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
 SELECT user_id, event_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def _(spark, d):
    return ev.sessions(read(spark, d, "events"))


_RUNS = "SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, CASE WHEN event_id % 17 = 0 THEN 'run_done_v2' WHEN event_id % 97 = 0 THEN 'error' WHEN event_id % 5 = 0 THEN 'stage4_sentence' ELSE 'sentence_tagged' END AS type, CASE WHEN event_id % 2 = 0 THEN '{\"action\":\"unfixed_risky\"}' ELSE '{\"action\":\"kept\"}' END AS data FROM events"


@query("run_states", f"SELECT run_id, CASE WHEN count(*) FILTER (WHERE type = 'error') > 0 THEN 'error' WHEN count(*) FILTER (WHERE type = 'run_done_v2') > 0 THEN 'done' ELSE 'running' END AS status, arg_max(type, seq) AS last_type, count(*) AS n_events, count(*) FILTER (WHERE type = 'sentence_tagged') AS n_sentences, count(*) FILTER (WHERE type = 'stage4_sentence' AND seq % 2 = 0) AS unfixed, arg_max(data, seq) FILTER (WHERE type = 'run_done_v2') AS result FROM ({_RUNS}) GROUP BY run_id")
def _(spark, d):
    e = F.col("event_id")
    kind = F.when(e % 17 == 0, "run_done_v2").when(e % 97 == 0, "error").when(e % 5 == 0, "stage4_sentence").otherwise("sentence_tagged")
    data = F.when(e % 2 == 0, '{"action":"unfixed_risky"}').otherwise('{"action":"kept"}')
    return ev.run_states(read(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), e.alias("seq"), "ts", kind.alias("type"), data.alias("data")))
