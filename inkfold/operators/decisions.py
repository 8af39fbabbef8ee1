"""Decisions of the rewriting stages: gates, best of several, actions and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import DEFAULT, Config
from ..functions.text import let


def route(n_words: Column, cfg: Config = DEFAULT) -> Column:
    return F.when(n_words <= cfg.short_words, "short").otherwise("long")


def length_ok(words: Column, source_words: Column, cfg: Config = DEFAULT) -> Column:
    """A candidate isn't tiny, nor too far from the length of a source that isn't short."""
    far = (source_words > cfg.length_from_words) & (F.abs(words - source_words) / source_words > cfg.length_change)
    return (words >= cfg.least_words) & ~far


def best_candidates(candidates: DataFrame, sources: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(doc_id, text, ord): of the candidates of right length, those alike enough if any, the least score, then the first.

    Documents without a candidate keep their source, with a null ord.
    """
    ok = candidates.where(length_ok(F.col("words"), F.col("source_words"), cfg))
    order = Window.partitionBy("doc_id").orderBy((F.col("sem") > cfg.viable_sem).desc(), "ai_score", "ord")
    best = ok.withColumn("n", F.row_number().over(order)).where("n = 1").select("doc_id", F.col("text").alias("chosen"), "ord")
    return sources.join(best, "doc_id", "left").select("doc_id", F.coalesce("chosen", "text").alias("text"), "ord")


def best_of(candidates: Column, source_words: Column, cfg: Config = DEFAULT) -> Column:
    """The same choice among an array of ``struct<ord, text, ai_score, sem, words>`` of a row; null if none has the right length."""
    ok = F.filter(candidates, lambda c: length_ok(c["words"], source_words, cfg))
    ranked = F.transform(ok, lambda c: F.struct((c["sem"] <= cfg.viable_sem).alias("unlike"), c["ai_score"].alias("s"), c["ord"].alias("o"), c.alias("c")))
    return F.array_min(ranked)["c"]


def needs_retry(orig: Column, now: Column, human: Column, cfg: Config = DEFAULT) -> Column:
    gained = (orig - now) / F.greatest(orig, F.lit(0.01))
    return (gained < cfg.retry_improvement) & (orig > cfg.retry_score) & ~human


def stubborn(sentences: DataFrame, rewritten: DataFrame) -> DataFrame:
    """Sentences whose rewritten text at the same place still is critical or high; missing places count by the fused grade."""
    r = rewritten.select("doc_id", "idx", F.col("rule_severity").alias("new_severity"))
    now = F.coalesce("new_severity", "severity")
    return sentences.join(r, ["doc_id", "idx"], "left").withColumn("now_severity", now).where(F.col("now_severity").isin("critical", "high"))


def sentence_action(sem: Column, rules_pass: Column, without: Column, cfg: Config = DEFAULT) -> Column:
    """rewritten, deleted or unfixed_risky; bounds are inclusive."""
    return F.when((sem >= cfg.rewrite_sem) & rules_pass, "rewritten").when(without >= cfg.delete_sem, "deleted").otherwise("unfixed_risky")


def leave_one_out(sents: Column) -> Column:
    """For each sentence the text of all others that aren't empty."""
    return let(sents, lambda s: F.transform(s, lambda _, i: F.array_join(F.filter(s, lambda x, j: (j != i) & (x != "")), " ")))


def neighbours(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds context_before and context_after."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    return df.withColumns({"context_before": F.lag(text, 1, "").over(w), "context_after": F.lead(text, 1, "").over(w)})


TECHNIQUES = {"half_comparison": (-1, 2), "lazy_pronoun": (0, 3), "redundant_modifier": (1, 3), "sentence_tail": (1, 3), "short_sentence_break": (0, 3), "understatement": (0, 3)}
#: the order in which a prompt lists them
TECHNIQUE_ORDER = tuple("understatement lazy_pronoun half_comparison sentence_tail redundant_modifier short_sentence_break".split())


def technique_budget(n_words: Column, score: Column | None = None) -> Column:
    """map of technique to how often it may be used, by length and by score."""
    base = F.greatest(F.lit(1), F.floor(n_words / 500).cast("int"))
    boost = F.lit(0) if score is None else F.when(score > 0.5, 2).when(score > 0.35, 1).otherwise(0)
    entries = []
    for name in TECHNIQUE_ORDER:
        add, most = TECHNIQUES[name]
        entries += [F.lit(name), F.least(F.lit(most), F.greatest(F.lit(1), base + add + boost)).cast("int")]
    return F.create_map(*entries)


def polish_score(score: Column, human: Column) -> Column:
    return F.when(human, F.greatest(score - 0.15, F.lit(0.0))).otherwise(score)


def polish_temperature(score: Column) -> Column:
    return F.when(score > 0.35, 0.8).otherwise(0.7)


def keep_formal(genre: Column, new: Column, old: Column, cfg: Config = DEFAULT) -> Column:
    """skipped for other genres; accepted if the score rises by no more than the slack."""
    return F.when(~genre.isin("academic", "professional"), "skipped").when(new <= old + cfg.formality_slack, "accepted").otherwise("rejected")


def remap(sentences: DataFrame, final: DataFrame) -> DataFrame:
    """Final texts by place; places without one keep their earlier text."""
    f = final.select("doc_id", "idx", F.col("text").alias("final"))
    return sentences.join(f, ["doc_id", "idx"], "left").withColumn("final_text", F.coalesce("final", "text")).drop("final")


def unfixed_texts(sentences: DataFrame) -> DataFrame:
    """(doc_id, unfixed): non-empty texts left as risky, in order."""
    rows = sentences.where((F.col("action") == "unfixed_risky") & (F.col("final_text") != ""))
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "final_text"))), lambda x: x["final_text"]).alias("unfixed"))


def mark_positions(text: Column, needles: Column) -> Column:
    """First places of texts to be marked, longest first where they overlap, by start."""
    ordered = F.array_sort(F.transform(F.array_distinct(F.filter(needles, lambda n: n != "")), lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n"))))
    zero = F.array().cast("array<struct<start:int,end:int>>")

    found = F.filter(F.transform(ordered, lambda x: F.struct((F.instr(text, x["n"]) - 1).alias("start"), (F.instr(text, x["n"]) - 1 + F.length(x["n"])).alias("end"))), lambda s: s["start"] >= 0)
    kept = F.aggregate(found, zero, lambda acc, s: F.when(F.exists(acc, lambda a: (a["start"] < s["end"]) & (s["start"] < a["end"])), acc).otherwise(F.concat(acc, F.array(s))))
    return F.array_sort(kept)


def marked_parts(text: Column, spans: Column) -> Column:
    """The text cut at its marks: ``array<struct<text, marked>>`` without empty parts; joined they are the text."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,marked:boolean>>").alias("out"))
    part = lambda a, b, marked: F.struct(F.substring(text, a + 1, b - a).alias("text"), F.lit(marked).alias("marked"))
    cut = F.aggregate(spans, zero, lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(part(acc["at"], s["start"], False), part(s["start"], s["end"], True))).alias("out")))
    return F.filter(let(cut, lambda c: F.concat(c["out"], F.array(part(c["at"], F.length(text), False)))), lambda p: p["text"] != "")


def tier(score: Column) -> Column:
    return F.when(score > 0.6, "red").when(score > 0.4, "yellow").otherwise("green")


def drop_percent(orig: Column, final: Column) -> Column:
    return F.bround((1 - final / F.greatest(orig, F.lit(0.01))) * 100, 1)


def evaluate(cases: DataFrame) -> DataFrame:
    """Mean drop and similarity, and the share of genres that were right, over (orig, final, sem, genre, genre_expected)."""
    return cases.agg(
        F.bround(F.avg(drop_percent(F.col("orig"), F.col("final"))), 4).alias("avg_drop"),
        F.bround(F.avg("sem"), 4).alias("avg_sem"),
        F.bround(F.avg((F.col("genre") == F.col("genre_expected")).cast("double")), 4).alias("genre_accuracy"),
        F.count("*").alias("n"),
    )

