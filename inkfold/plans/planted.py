"""Inputs that make every rule fire: documents with sentences added by their id, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import PHRASES

#: sentences for the rules that are patterns, positive and negative
SAMPLES = {
    "punct.em_dash": ["It rained — then it stopped.", "It rained – twice.", "We left -- late.", "A well-known two--three case.", "No dash here."],
    "punct.semicolon": ["One; two; three.", "It ended; nobody knew.", "Plain text."],
    "punct.colon_overuse": ["The answer: nothing.", "At 10:30 they came.", "Two things: first rain; then: snow.", "Names: Anna and Ben."],
    "struct.not_x_but_y": ["It was not a walk, but a run.", "Not to win, but to learn.", "Rather than wait they went.", "Not because of rain.", "He did not go."],
    "struct.triple_parallel": ["The red house, the old barn, and the river were gone.", "Apples, pears.", "Speed, their strength, and its weight count."],
    "struct.abstract_noun_stack": ["The framework and the governance of the ecosystem.", "A framework.", "Alignment, alignment and alignment again."],
    "struct.tailing_negation": ["It just works, no setup required.", "They went, no.", "Fast, no waiting at all!", "Yes, no one knows why it is so."],
    "content.superficial_ing": ["It grew, highlighting a need.", "They met, contributing to peace, fostering trust.", "Highlighting it."],
    "syntax.passive_stack": ["It was opened and was taken. They were broken. It is given.", "He ran. She sat.", "The cup was broken and the door was opened and we were taken."],
    "human.no_question": ["Is it so?", "It is so."],
}


def phrase_sentences(rule: str) -> list[str]:
    """A sentence for each phrase of the rule, some capitalised, and one in which the first phrase is part of a longer word."""
    out = []
    for i, p in enumerate(PHRASES[rule]):
        end = "" if p.endswith("!") else "."
        out.append(f"{p[0].upper()}{p[1:]} they said it again {p}{end}" if i % 2 else f"Now {p} it came to pass{'' if end else ' '}.")
    first = PHRASES[rule][0]
    return [*out, f"Here x{first}y stands.", "Nothing of that kind."]


def sentences_for(rule: str) -> list[str]:
    return SAMPLES.get(rule) or phrase_sentences(rule)


ALL = [s for rule in [*SAMPLES, *PHRASES] for s in sentences_for(rule)]

POST = [
    "a — b; c;;d -- e...", "He said “yes” and ‘no’.", "Fine 😀 day  here 🚀.", "**a** **b** **c** **d** bold", "**a** and **b**", "\n- **Head:** body\n* **Next**: more",
    "\n# The Big Title Case Here\ntext", "\n## API design For Fun", "x;y;", "wait...", "line  with   spaces   \n\n\n\nend", "plain",
]
CLEAN = ["a\nb", "!!!!!! .....", "tab\there", "one\r\ntwo\rthree", "zero​width", "soft­hyphen", "many    spaces", "\n\n\n\n", "trail   \nnext", "ok"]


def plant(docs: DataFrame, extra: list[str], text_col: str = "text") -> DataFrame:
    """Adds one of the texts to each document, by its id."""
    pick = F.element_at(F.array(*map(F.lit, extra)), (F.pmod(F.col("doc_id"), F.lit(len(extra))) + 1).cast("int"))
    return docs.withColumn(text_col, F.concat(F.col(text_col), F.lit(" "), pick))


def sql_literal(text: str) -> str:
    """A string literal with line ends and other controls as chr()."""
    parts, plain = [], ""
    for ch in text:
        if ord(ch) < 32:
            parts += [f"'{plain}'"] if plain else []
            parts.append(f"chr({ord(ch)})")
            plain = ""
        else:
            plain += "''" if ch == "'" else ch
    parts += [f"'{plain}'"] if plain or not parts else []
    return "(" + " || ".join(parts) + ")"


def plant_sql(extra: list[str], table: str = "documents", text_col: str = "text") -> str:
    """The same as a subquery of (doc_id, text)."""
    return f"SELECT doc_id, {text_col} || ' ' || ([{', '.join(map(sql_literal, extra))}])[(doc_id % {len(extra)}) + 1] AS text FROM {table}"
