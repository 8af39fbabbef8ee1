"""Grading, fusion with scores, ranking and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import DEFAULT, Config

LEVELS = ("critical", "high", "medium", "low", "clean")


def _count(violations: Column, level: str) -> Column:
    return F.size(F.filter(violations, lambda v: v["severity"] == level))


def rule_severity(violations: Column) -> Column:
    """The grade of a sentence: two highs count as critical."""
    high = _count(violations, "high")
    return (
        F.when((_count(violations, "critical") > 0) | (high >= 2), "critical")
        .when(high == 1, "high")
        .when(_count(violations, "medium") > 0, "medium")
        .when(_count(violations, "low") > 0, "low")
        .otherwise("clean")
    )


def rank(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(reversed(LEVELS)) for x in (s, i)]), severity)


def fuse(severity: Column, z: Column, useful: Column, cfg: Config = DEFAULT) -> Column:
    """The grade moved by the score's z, where the model tells sentences apart; all bounds are strict."""
    return (
        F.when((severity == "critical") | ~useful, severity)
        .when((severity == "clean") & (z > cfg.z_clean), "medium")
        .when((severity == "medium") & (z > cfg.z_medium), "high")
        .when((severity == "high") & (z < cfg.z_high), "medium")
        .otherwise(severity)
    )


def score_documents(sentences: DataFrame, score: str = "ai_score", cfg: Config = DEFAULT) -> DataFrame:
    """Adds doc_mean, doc_std, model_useful, ai_z_score, severity and heat: windows over one partitioning by document."""
    doc = Window.partitionBy("doc_id")
    by_heat = doc.orderBy(F.col(score).desc(), F.col("idx"))
    out = sentences.withColumns({"doc_mean": F.avg(score).over(doc), "doc_std": F.coalesce(F.stddev_samp(score).over(doc), F.lit(0.0)), "n_sentences": F.count("*").over(doc)})
    out = out.withColumn("model_useful", F.col("doc_std") >= cfg.useful_std)
    out = out.withColumn("ai_z_score", F.when(F.col("model_useful"), (F.col(score) - F.col("doc_mean")) / F.col("doc_std")).otherwise(0.0))
    out = out.withColumn("severity", fuse(F.col("rule_severity"), F.col("ai_z_score"), F.col("model_useful"), cfg))
    part = (F.row_number().over(by_heat) - 1) / F.col("n_sentences")
    return out.withColumn("heat", F.when(part < 0.2, "hot").when(part < 0.5, "warm").otherwise("low"))


def histogram(sentences: DataFrame, severity: str = "rule_severity") -> DataFrame:
    """(doc_id, n_critical .. n_clean, n_sentences, n_violations), zeros included."""
    counts = [F.count_if(F.col(severity) == s).alias(f"n_{s}") for s in LEVELS]
    return sentences.groupBy("doc_id").agg(*counts, F.count("*").alias("n_sentences"), F.sum(F.size("violations")).alias("n_violations"))


def distribution(sentences: DataFrame, severity: str = "severity") -> DataFrame:
    """(doc_id, severity, n): only grades that occur."""
    return sentences.groupBy("doc_id", F.col(severity).alias("severity")).agg(F.count("*").alias("n"))


def top_issues(sentences: DataFrame, k: int | None = None) -> DataFrame:
    """(doc_id, rank, rule_id, n): rules by frequency, ties by first appearance."""
    each = sentences.select("doc_id", "idx", F.posexplode("violations").alias("pos", "v"))
    counts = each.groupBy("doc_id", F.col("v.rule_id").alias("rule_id")).agg(F.count("*").alias("n"), F.min(F.struct("idx", "pos")).alias("at"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "at")))
    return (ranked.where(F.col("rank") <= k) if k else ranked).select("doc_id", "rank", "rule_id", "n")


def rollup_by_category(sentences: DataFrame) -> DataFrame:
    """(category, rule_id, n) with subtotals, nulls standing for all."""
    each = sentences.select(F.explode("violations").alias("v")).select(F.substring_index("v.rule_id", ".", 1).alias("category"), F.col("v.rule_id").alias("rule_id"))
    return each.rollup("category", "rule_id").agg(F.count("*").alias("n"))


NEW_FAMILIES = ("artifact.", "content.", "style.", "struct.tailing_negation")


def split_by_family(sentences: DataFrame) -> DataFrame:
    """(doc_id, n_new, n_old): violations of the rule families that came later, and of the others."""
    rule = F.col("v.rule_id")
    new = F.lit(False)
    for p in NEW_FAMILIES:
        new = new | rule.startswith(p)
    return sentences.select("doc_id", F.explode("violations").alias("v")).groupBy("doc_id").agg(F.count_if(new).alias("n_new"), F.count_if(~new).alias("n_old"))


def reads_human(score: Column, clean_ratio: Column, cfg: Config = DEFAULT) -> Column:
    """A low mean score, or a lowish one with most sentences clean."""
    return (score < cfg.human_score) | ((score < cfg.human_score_soft) & (clean_ratio >= cfg.human_clean_ratio))


def already_human(sentences: DataFrame, score: str = "ai_score", cfg: Config = DEFAULT) -> DataFrame:
    """(doc_id, ai_score, clean_ratio, already_human)."""
    per = sentences.groupBy("doc_id").agg(F.avg(score).alias("ai_score"), F.avg((F.col("rule_severity") == "clean").cast("double")).alias("clean_ratio"))
    return per.withColumn("already_human", reads_human(F.col("ai_score"), F.col("clean_ratio"), cfg))


HUMAN = ["human.no_colloquial", "human.no_short_sentence", "human.no_question"]


def human_deficits(sentences: DataFrame) -> DataFrame:
    """(doc_id, deficits): the distinct human.* rules of a document, in order; sentences analysed by the rules HUMAN are enough."""
    ids = F.array_distinct(F.transform(F.filter("violations", lambda v: v["rule_id"].startswith("human.")), lambda v: v["rule_id"]))
    return sentences.where("idx = 0").select("doc_id", ids.alias("deficits"))
