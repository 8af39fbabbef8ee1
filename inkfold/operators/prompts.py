"""Prompts of the rewriting stages, assembled per document as string expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import RULES
from .decisions import TECHNIQUE_ORDER

GUIDE = {
    "academic": "Argue closely, cite as the source does, let sentences differ in length.",
    "casual": "Write as one talks to a friend; short forms are welcome.",
    "narrative": "Stay with what people see and do; let scenes breathe unevenly.",
    "persuasive": "Take a side, back it with the facts given, and leave slogans out.",
    "professional": "Be brief and concrete; sound like a capable colleague.",
}
FORMAL = {
    "academic": "Take back slang and most short forms; keep concrete detail and uneven rhythm.",
    "professional": "Take back slang; keep names, numbers and a friendly close.",
}
TECHNIQUE_TEXT = {
    "understatement": "say less than you could",
    "lazy_pronoun": "point back with a loose word",
    "half_comparison": "leave a comparison lopsided",
    "sentence_tail": "let a sentence trail off mildly",
    "redundant_modifier": "add a spoken filler",
    "short_sentence_break": "break in with a short sentence",
}
DEFICIT_TEXT = {
    "human.no_colloquial": "nothing sounds spoken: use fillers and loose words",
    "human.no_short_sentence": "every sentence is long: break some",
    "human.no_question": "nothing is asked: turn a statement into a question",
}
ANSWER = '\n\nAnswer with one JSON object and nothing else: {"rewrite": "..."}'
KEEP = "Keep every fact, number and name. Add nothing. Use no dashes."


def _lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), default)


def guide(genre: Column) -> Column:
    return _lookup(GUIDE, genre, F.lit(GUIDE["academic"]))


def sentence_label(violations: Column, severity: Column, heat: Column) -> Column:
    """Grade and rules, and the heat unless it's low; CLEAN if there is neither."""
    ids = F.array_join(F.transform(violations, lambda v: v["rule_id"]), ", ")
    rules = F.when(F.size(violations) > 0, F.concat(F.upper(severity), F.lit(": "), ids))
    hot = F.when(heat != "low", F.concat(F.lit("AI-"), heat))
    both = F.concat_ws(" | ", rules, hot)
    return F.when(both == "", "CLEAN").otherwise(both)


def annotated(sentences: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, annotated): a line for each sentence with its number, label and score, in order; and more aggregates by document."""
    score = F.when(F.col("ai_score") > 0, F.format_string(" (AI:%.3f)", F.col("ai_score"))).otherwise("")
    line = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("]["), sentence_label(F.col("violations"), F.col("rule_severity"), F.col("heat")), F.lit("]"), score, F.lit(" "), F.col("text"))
    rows = sentences.withColumn("x", F.struct("idx", line.alias("line")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("annotated"), *more)


def rewrite_prompt(text: Column, score: Column, genre: Column, retry: Column) -> Column:
    """The whole text, annotated; aims at half the score, 0.15 at least."""
    goal = F.greatest(F.lit(0.15), score * 0.5)
    again = F.when(retry, "\nThe last attempt changed too little: go further this time.").otherwise("")
    aim = F.when(score.isNotNull(), F.format_string("\nScore now %.2f, to get below %.2f; lines marked hot matter most.", score, goal)).otherwise("")
    return F.concat(F.lit("Rewrite the text below so that it reads as if a person had written it.\nGenre: "), genre, F.lit(". "), guide(genre), again, aim, F.lit(f"\n{KEEP} Stay within a fifth of its length.\n\n"), text, F.lit(ANSWER))


def sentence_prompt(sentence: Column, violations: Column, before: Column, after: Column, score: Column) -> Column:
    """One sentence between its neighbours, with what is wrong with it."""
    issues = F.array_join(F.transform(violations, lambda v: F.concat(F.lit("- "), v["rule_id"], F.lit(": "), v["suggestion"])), "\n")
    issues = F.when(F.size(violations) > 0, issues).otherwise("- no rule is broken")
    hint = F.when(score.isNotNull(), F.format_string("\nScore %.3f.", score)).otherwise("")
    lead = F.when(before != "", F.concat(F.lit("\n[before] "), before)).otherwise("")
    tail = F.when(after != "", F.concat(F.lit("\n[after] "), after)).otherwise("")
    return F.concat(F.lit("Rewrite only the target; the rest is there for context.\n"), issues, hint, F.lit(f"\n{KEEP}"), lead, F.lit("\n[target] "), sentence, tail, F.lit(ANSWER))


def polish_prompt(text: Column, budget: Column, deficits: Column, score: Column, genre: Column) -> Column:
    """Techniques with how often each may be used, what the text lacks, and more force from a score of 0.35 on."""
    lines = F.array_join(F.array(*[F.concat(F.lit(f"- {t}: {TECHNIQUE_TEXT[t]} (x"), F.element_at(budget, t).cast("string"), F.lit(")")) for t in TECHNIQUE_ORDER]), "\n")
    lacks = F.array_join(F.transform(deficits, lambda d: F.concat(F.lit("- "), _lookup(DEFICIT_TEXT, d, d))), "\n")
    lacks = F.when(F.size(deficits) > 0, lacks).otherwise("- nothing in particular")
    force = F.when(score > 0.35, F.format_string("\nThe score is high (%.2f): use the budget up.", score)).otherwise("")
    return F.concat(F.lit("Give the text a last human touch.\nGenre: "), genre, F.lit(". "), guide(genre), force, F.lit("\nTechniques:\n"), lines, F.lit("\nMissing:\n"), lacks, F.lit(f"\n{KEEP} Ask two questions at most.\n\n"), text, F.lit(ANSWER))


def formality_prompt(text: Column, genre: Column) -> Column:
    """Empty for genres that need no formality."""
    advice = _lookup(FORMAL, genre, F.lit(""))
    return F.when(advice == "", "").otherwise(F.concat(F.lit("The text may have become too informal for its genre, "), genre, F.lit(". "), advice, F.lit(f"\n{KEEP}\n\n"), text, F.lit(ANSWER)))


def genre_prompt(text: Column) -> Column:
    """Asks for one of the genres, by the first 500 characters."""
    return F.concat(F.lit(f"Name the genre of this text with one word of: {', '.join(sorted(GUIDE))}.\n\n"), F.trim(F.substring(text, 1, 500)))


def rule_reference() -> str:
    return "\n".join(f"{r.id}: {r.advice}" for r in RULES.values())
