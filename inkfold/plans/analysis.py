"""Plans from documents to graded sentences, summaries and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.config import DEFAULT, Config
from ..functions.lexicon import PHRASES
from ..functions.text import NOT_AFTER, NOT_BEFORE, let, quote, sentences, strip, word_count
from ..operators import decisions, rules, severity, splitting
from ..operators.postprocess import STEPS
from ..operators.rules import analyze
from ..operators.scoring import stand_in_score
from ..operators.similarity import text_similarity
from ..sources.session import settle


def graded(docs: DataFrame, **columns) -> DataFrame:
    """Sentences with violations and rule_severity."""
    return analyze(docs, **columns).withColumn("rule_severity", severity.rule_severity(F.col("violations")))


def scored(docs: DataFrame, score: Column | None = None, cfg: Config = DEFAULT, **columns) -> DataFrame:
    """Graded sentences with score, z, fused severity and heat."""
    own = graded(docs, **columns)
    score = stand_in_score(F.size("violations"), F.col("n_words")) if score is None else score
    return severity.score_documents(own.withColumn("ai_score", score), cfg=cfg)


def document_analysis(sentences_: DataFrame) -> DataFrame:
    """(doc_id, counts by grade, top_issues): one row a document."""
    issues = severity.top_issues(sentences_).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "rule_id"))), lambda x: x["rule_id"]).alias("top_issues"))
    return severity.histogram(sentences_).join(issues, "doc_id", "left").withColumn("top_issues", F.coalesce("top_issues", F.array().cast("array<string>")))


def score_text(text: Column) -> Column:
    """The stand-in detector of a whole text: stock phrases for violations."""
    every = F.split(F.lit("|".join(p for ps in PHRASES.values() for p in ps)), "[|]")
    hits = let(F.lower(text), lambda low: F.size(F.filter(every, lambda p: low.contains(p))))
    return stand_in_score(hits, F.least(word_count(text), F.lit(40)))


def _fixed(c: Column) -> Column:
    for _, fix, _ in STEPS:
        c = fix(c)
    return c


def without_phrases(c: Column) -> Column:
    """The text without its stock phrases: a stand-in for a rewriter."""
    for ps in PHRASES.values():
        pattern = "|".join(quote(p) for p in sorted(ps, key=len, reverse=True))
        c = F.regexp_replace(c, f"(?iu)(?:{pattern}),? ?", "")
    return strip(c)


_SHORT = f"(?iu){NOT_BEFORE}(do|does|did|is|are|was|were|has|have) not{NOT_AFTER}"


def with_short_forms(c: Column) -> Column:
    """Spoken short forms: a stand-in for a model that polishes."""
    return F.regexp_replace(c, _SHORT, "$1n't")


def without_short_forms(c: Column) -> Column:
    """A stand-in for a model that restores formality."""
    return F.regexp_replace(c, f"n't{NOT_AFTER}", " not")


def offer(ord_: int, text: Column, source: Column) -> Column:
    """A candidate as decisions.best_of takes it."""
    return let(text, lambda t: F.struct(F.lit(ord_).alias("ord"), t.alias("text"), score_text(t).alias("ai_score"), text_similarity(source, t).alias("sem"), word_count(t).alias("words")))


def run_stages(docs: DataFrame, cfg: Config = DEFAULT, id_col: str = "doc_id", text_col: str = "text", genre: str = "professional") -> DataFrame:
    """The six stages with deterministic stand-ins for models: a row a document with texts, scores, tags and what was decided.

    1, 2: score and grade.  3: rewrite the whole, long texts segment by segment, of several candidates the best one, and once more if
    that gained too little; what already reads human is only touched up.  4: sentences that stay bad are rewritten, deleted or left, by
    likeness and by the rules that the new sentence breaks.  5: polish.  6: formality, for genres that need it, if the score allows.
    Every decision is the one real models would get; a model plugs in where a stand-in column is.  Candidates are arrays of their row:
    nothing is shuffled but the grades of a document's sentences.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tags = F.array_sort(F.collect_list(F.struct("idx", "severity", F.size("violations").alias("violations"))))
    clean = F.avg((F.col("rule_severity") == "clean").cast("double"))
    per = scored(own, cfg=cfg).groupBy("doc_id").agg(F.avg("ai_score").alias("mean_score"), clean.alias("clean_ratio"), tags.alias("tags"))
    per = per.select("doc_id", "tags", severity.reads_human(F.col("mean_score"), F.col("clean_ratio"), cfg).alias("already_human"))
    base = own.join(per, "doc_id").withColumns({"orig_score": score_text(F.col("text")), "n_words": word_count(F.col("text"))})
    base = base.withColumn("route", decisions.route(F.col("n_words"), cfg))
    parts = F.when(F.col("route") == "long", splitting.segment_texts(F.col("text"), cfg.segment_words)).otherwise(F.array("text"))
    base = base.withColumn("parts", parts)
    base = base.withColumns({"n_segments": F.size("parts"), "light": _fixed(F.array_join("parts", " ")), "strong": _fixed(F.array_join(F.transform("parts", without_phrases), " "))})
    offered = F.when(F.col("already_human"), F.array(offer(0, F.col("light"), F.col("text")))).otherwise(F.array(offer(0, F.col("light"), F.col("text")), offer(1, F.col("strong"), F.col("text"))))
    state = base.withColumn("best", decisions.best_of(offered, F.col("n_words"), cfg))
    state = state.withColumns({"candidate": F.col("best.ord"), "first_text": F.coalesce("best.text", "text"), "first_score": F.coalesce("best.ai_score", "orig_score")})
    state = state.withColumn("retry", decisions.needs_retry(F.col("orig_score"), F.col("first_score"), F.col("already_human"), cfg))
    again = F.when(F.col("retry"), F.array(offer(0, _fixed(without_phrases(F.col("first_text"))), F.col("text")), offer(1, _fixed(with_short_forms(without_phrases(F.col("first_text")))), F.col("text"))))
    state = state.withColumn("second", decisions.best_of(again, word_count(F.col("first_text")), cfg))
    state = state.select("doc_id", "text", "tags", "n_segments", "route", "already_human", "candidate", "retry", "orig_score", F.coalesce("second.text", "first_text").alias("stage3_text"), F.coalesce("second.ai_score", "first_score").alias("stage3_score"))
    state = settle(state, "rewritten")  # models' answers: not to be asked for again
    # sentences that stay critical or high
    graded3 = settle(graded(state.select("doc_id", F.col("stage3_text").alias("text"))).select("doc_id", "idx", "text", "rule_severity"), "graded")
    bad = graded3.where(F.col("rule_severity").isin("critical", "high")).join(state.select("doc_id", F.col("text").alias("source"), sentences(F.col("stage3_text")).alias("sents")), "doc_id")
    cand = bad.withColumns({"candidate_text": without_phrases(_fixed(F.col("text"))), "rest": F.array_join(F.filter(F.col("sents"), lambda x, i: (i != F.col("idx")) & (x != "")), " ")})
    grade = let(rules.violations_of(F.col("candidate_text")), severity.rule_severity)
    cand = cand.withColumns({"sem": text_similarity(F.col("text"), F.col("candidate_text")), "without_sem": F.when(F.col("rest") == "", 0.0).otherwise(text_similarity(F.col("source"), F.col("rest"))), "passes": grade.isin("clean", "low")})
    cand = cand.withColumn("action", decisions.sentence_action(F.col("sem"), F.col("passes"), F.col("without_sem"), cfg))
    new = F.when(F.col("action") == "rewritten", F.col("candidate_text")).when(F.col("action") == "deleted", "").otherwise(F.col("text"))
    acted = cand.select("doc_id", "idx", "action", F.round("sem", 4).alias("action_sem"), new.alias("new"))
    joined = graded3.join(acted, ["doc_id", "idx"], "left").withColumns({"action": F.coalesce("action", F.lit("kept")), "after": F.coalesce("new", "text")})
    fourth = joined.groupBy("doc_id").agg(
        F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("idx", "after"))), lambda x: x["after"]), lambda x: x != ""), " ").alias("stage4_text"),
        F.array_sort(F.collect_list(F.when(F.col("action") != "kept", F.struct("idx", "action", "action_sem")))).alias("actions"),
        F.count("*").alias("n_sentences"),
        *[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("kept", "rewritten", "deleted", "unfixed_risky")],
    )
    out = state.join(fourth, "doc_id").withColumn("stage4_score", F.when(F.col("stage4_text") == "", F.col("stage3_score")).otherwise(score_text(F.col("stage4_text"))))
    out = out.withColumn("stage5_text", _fixed(with_short_forms(F.col("stage4_text"))))
    out = out.withColumns({"stage5_score": score_text(F.col("stage5_text")), "stage6_text": _fixed(without_short_forms(F.col("stage5_text")))}).withColumn("stage6_score", score_text(F.col("stage6_text")))
    out = out.withColumn("formality", decisions.keep_formal(F.lit(genre), F.col("stage6_score"), F.col("stage5_score"), cfg))
    taken = F.col("formality") == "accepted"
    out = out.withColumns({"final_text": F.when(taken, F.col("stage6_text")).otherwise(F.col("stage5_text")), "final_score": F.when(taken, F.col("stage6_score")).otherwise(F.col("stage5_score"))})
    out = out.withColumn("final_sem", F.round(text_similarity(F.col("text"), F.col("final_text")), 5))
    return out


DECISIONS = (
    "doc_id route already_human candidate retry orig_score stage3_score stage4_score stage5_score final_score final_sem n_kept n_rewritten n_deleted n_unfixed_risky formality final_text"
).split()


def optimize(docs: DataFrame, cfg: Config = DEFAULT, **columns) -> DataFrame:
    """What run_stages decided, and the final text."""
    return run_stages(docs, cfg, **columns).select(*DECISIONS)


def run_summary(stages: DataFrame) -> DataFrame:
    """The summary of each run: scores to four digits, lengths and counts, and the score of each stage."""
    r = lambda c: F.bround(c, 4)
    return stages.select(
        "doc_id", r("orig_score").alias("original_ai_score"), r("final_score").alias("final_ai_score"), r("final_sem").alias("final_sem_score"), F.length("final_text").alias("output_length"),
        F.size("tags").cast("long").alias("total_sentences"), F.col("n_unfixed_risky").alias("unfixed_count"), r("stage3_score").alias("stage3_ai_score"), r("stage4_score").alias("stage4_ai_score"), r("final_score").alias("stage5_ai_score"),
    )
