"""Splitting and chunking, as folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CUT, S, let, strip

STRINGS = "array<string>"
CHUNKS = "array<struct<text:string,para_idx:int>>"


def cjk_sentences(text: Column) -> Column:
    """Sentences of Latin and CJK text: also cut without white space before a capital or an ideograph; never empty."""
    marked = F.regexp_replace(strip(text), f"([.!?。！？])(?:{S}+|(?=[A-Z一-鿿]))", f"$1{CUT}")
    parts = F.filter(F.split(marked, CUT, -1), lambda x: x != "")
    return let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(F.lit(""))))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(strip(text), f"\\n{S}*\\n", -1), strip), lambda x: x != "")


def cut_hard(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` characters, cut at the last space before."""
    out = []
    while len(text) > most:
        at = text.rfind(" ", 0, most)
        at = at if at > 0 else most
        out.append(text[:at].strip())
        text = text[at:].strip()
    return [*out, text] if text else out


def _cut(text: Column, most: int) -> Column:
    """cut_hard() of a text longer than the limit, as a pattern: all that is left if it fits, else up to the last space, else ``most`` characters."""
    space = "(?= )" if most > 1 else "(?!)"
    cut = f".{{1,{max(1, most - 1)}}}{space}|.{{{most}}}"

    def rest(v: Column) -> Column:
        left = strip(v["t"].substr(F.length(v["first"]) + 1, F.length(v["t"])))
        return F.concat(F.array(strip(v["first"])), F.regexp_extract_all(left, F.lit(f"(?s){S}*(.{{1,{most}}}\\z|{cut})"), F.lit(1)))

    return let(F.struct(text.alias("t"), F.regexp_extract(text, f"(?s)\\A(?:{cut})", 0).alias("first")), lambda v: F.transform(rest(v), strip))


def hard_split(text: Column, most: int) -> Column:
    """Pieces of at most ``most`` characters, cut at the last space before."""
    return F.when(F.length(text) > most, _cut(text, most)).when(text == "", F.array().cast(STRINGS)).otherwise(F.array(text))


def group_sentences(sents: Column, most: int) -> Column:
    """Greedy groups of sentences joined by a space, of at most ``most`` characters where a group has several."""
    zero = F.struct(F.lit("").alias("cur"), F.array().cast(STRINGS).alias("out"))

    def step(a: Column, s: Column) -> Column:
        longer = F.when(a["cur"] == "", s).otherwise(F.concat_ws(" ", a["cur"], s))
        flush = (F.length(longer) > most) & (a["cur"] != "")
        return F.struct(F.when(flush, s).otherwise(longer).alias("cur"), F.when(flush, F.concat(a["out"], F.array(strip(a["cur"])))).otherwise(a["out"]).alias("out"))

    return F.aggregate(sents, zero, step, lambda a: F.when(a["cur"] != "", F.concat(a["out"], F.array(strip(a["cur"])))).otherwise(a["out"]))


def chunk_sentences(text: Column, most: int) -> Column:
    """Text in groups of sentences; short text as it is, a single long sentence cut hard."""
    grouped = let(cjk_sentences(text), lambda s: F.when(F.size(s) > 1, group_sentences(s, most)))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.coalesce(grouped, hard_split(text, most)))


def chunks(df: DataFrame, most: int = 200, merge: bool = False, text_col: str = "text", out_col: str = "chunks") -> DataFrame:
    """Adds ``array<struct<text, para_idx>>``: text by paragraphs, long paragraphs by sentences, with the paragraph they begin in.

    With ``merge`` short paragraphs are packed together up to the limit.
    """
    t, pieces = strip(F.col(text_col)), "__pieces"
    paras = let(F.struct(t.alias("t"), paragraphs(t).alias("ps")), lambda v: F.when(v["t"] == "", F.array().cast(STRINGS)).when(F.size(v["ps"]) <= 1, F.array(v["t"])).otherwise(v["ps"]))
    # sentences of long paragraphs, null for others
    own = df.withColumn("__paras", paras).withColumn("__sents", F.transform("__paras", lambda p: F.when(F.length(p) > most, cjk_sentences(p))))
    # the few paragraphs that are one long sentence are cut hard
    own = own.withColumn("__hard", F.zip_with("__paras", "__sents", lambda p, s: F.when(F.size(s) == 1, hard_split(p, most))))

    # lambdas use their own arguments only: a column within one may be computed again for each element
    def piece(x: Column, i: Column) -> Column:
        soft = F.when(x["s"].isNull(), F.array(x["p"])).otherwise(group_sentences(x["s"], most))
        return F.struct(i.cast("int").alias("i"), x["p"].alias("p"), F.coalesce(x["h"], soft).alias("xs"))

    own = own.withColumn(pieces, F.transform(F.arrays_zip(F.col("__paras").alias("p"), F.col("__sents").alias("s"), F.col("__hard").alias("h")), piece))
    if not merge:
        out = F.flatten(F.transform(pieces, lambda x: F.transform(x["xs"], lambda s: F.struct(s.alias("text"), x["i"].alias("para_idx")))))
    else:
        zero = F.struct(F.lit("").alias("cur"), F.lit(0).alias("at"), F.array().cast(CHUNKS).alias("out"))
        one = lambda text, at: F.array(F.struct(text.alias("text"), at.cast("int").alias("para_idx")))

        def step(a: Column, x: Column) -> Column:
            flushed = F.when(a["cur"] != "", F.concat(a["out"], one(a["cur"], a["at"]))).otherwise(a["out"])
            long = F.length(x["p"]) > most
            full = (a["cur"] != "") & (F.length(a["cur"]) + 2 + F.length(x["p"]) > most)
            joined = F.when(a["cur"] == "", x["p"]).otherwise(F.concat(a["cur"], F.lit("\n\n"), x["p"]))
            return F.struct(
                F.when(long, "").when(full, x["p"]).otherwise(joined).alias("cur"),
                F.when(long, x["i"] + 1).when(full | (a["cur"] == ""), x["i"]).otherwise(a["at"]).alias("at"),
                F.when(long, F.concat(flushed, F.transform(x["xs"], lambda s: F.struct(s.alias("text"), x["i"].alias("para_idx"))))).when(full, flushed).otherwise(a["out"]).alias("out"),
            )

        out = F.aggregate(pieces, zero, step, lambda a: F.when(a["cur"] != "", F.concat(a["out"], one(a["cur"], a["at"]))).otherwise(a["out"]))
    return own.withColumn(out_col, out).drop("__paras", "__sents", "__hard", pieces)


def split_finer(text: Column, level: int) -> Column:
    """Level 0: the text; 1: pairs of sentences; from 2: sentences."""
    if level <= 0:
        return F.array(text)
    def finer(sents: Column) -> Column:
        if level > 1:
            return sents
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(sents) - 1) / 2).cast("int")), lambda i: F.array_join(F.slice(sents, i * 2 + 1, 2), " "))

    return let(F.struct(text.alias("t"), cjk_sentences(text).alias("s")), lambda v: F.when(F.size(v["s"]) <= 1, F.array(v["t"])).otherwise(finer(v["s"])))


def segment_numbers(counts: Column, target: int) -> Column:
    """The segment of each sentence: greedy by words; a tail below 40 % of the target joins the segment before."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("seg"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, wc: Column) -> Column:
        flush = (a["run"] + wc > target) & (F.size(a["out"]) > 0) & (F.try_element_at(a["out"], F.lit(-1)) == a["seg"])
        seg = F.when(flush, a["seg"] + 1).otherwise(a["seg"])
        return F.struct(F.when(flush, wc).otherwise(a["run"] + wc).alias("run"), seg.alias("seg"), F.concat(a["out"], F.array(seg)).alias("out"))

    def finish(a: Column) -> Column:
        small = (a["seg"] > 0) & (a["run"] < target * 0.4)
        return F.when(small, F.transform(a["out"], lambda s: F.when(s == a["seg"], s - 1).otherwise(s))).otherwise(a["out"])

    return F.aggregate(counts, zero, step, finish)


def segment_texts(text: Column, target: int = 800) -> Column:
    """The texts of the segments of a document, as an array; a text within the target is one, as it is."""
    from ..functions.text import sentences, word_count

    def of(v: Column) -> Column:
        joined = lambda segs: F.transform(F.sequence(F.lit(0), F.array_max(segs)), lambda g: F.array_join(F.filter(v["s"], lambda x, i: segs[i] == g), " "))
        total = F.aggregate(v["c"], F.lit(0), lambda a, x: a + x)
        return F.when(total <= target, F.array(text)).otherwise(let(segment_numbers(v["c"], target), joined))

    return let(sentences(text), lambda s: let(F.struct(s.alias("s"), F.transform(s, word_count).alias("c")), of))


def segments(docs: DataFrame, target: int = 800, overlap: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, seg_idx, text, sentence_indices, context_before, context_after, word_count); no shuffle, all within a row."""
    from ..functions.text import sentences, word_count

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"), sentences(F.col(text_col)).alias("sents")).withColumn("counts", F.transform("sents", word_count))
    total = F.aggregate("counts", F.lit(0), lambda a, x: a + x)
    own = own.withColumn("total", total).withColumn("segs", F.when(F.col("total") <= target, F.transform("counts", lambda _: F.lit(0))).otherwise(segment_numbers(F.col("counts"), target)))
    each = own.select("doc_id", "body", "sents", "total", "segs", F.explode(F.sequence(F.lit(0), F.coalesce(F.array_max("segs"), F.lit(0)))).alias("seg_idx"))
    at = F.filter(F.transform("segs", lambda s, i: F.when(s == F.col("seg_idx"), i.cast("int"))), lambda i: i.isNotNull())
    of = each.withColumn("sentence_indices", at).withColumn("first", F.coalesce(F.array_min("sentence_indices"), F.lit(0))).withColumn("last", F.coalesce(F.array_max("sentence_indices"), F.lit(-1)))
    pick = lambda frm, n: F.array_join(F.slice("sents", frm + 1, n), " ")
    one = F.coalesce(F.array_max("segs"), F.lit(0)) == 0
    text = F.when(one & (F.col("total") <= target), F.col("body")).otherwise(pick(F.col("first"), F.size("sentence_indices")))
    # contexts come from the neighbouring segment only
    before_n = F.least(F.lit(overlap), F.size(F.filter("segs", lambda s: s == F.col("seg_idx") - 1)))
    after_n = F.least(F.lit(overlap), F.size(F.filter("segs", lambda s: s == F.col("seg_idx") + 1)))
    return of.select(
        "doc_id", "seg_idx", text.alias("text"), "sentence_indices",
        pick(F.greatest(F.col("first") - before_n, F.lit(0)), before_n).alias("context_before"),
        pick(F.col("last") + 1, after_n).alias("context_after"),
        word_count(text).alias("word_count"),
    )


def align(new: Column, n: Column) -> Column:
    """Sentences brought to a count: surplus ones joined to the last, missing ones empty."""

    def fit(s: Column) -> Column:
        size = F.size(s)
        joined = F.concat(F.slice(s, 1, F.greatest(n - 1, F.lit(0))), F.array(F.array_join(F.slice(s, F.greatest(n, F.lit(1)), size), " ")))
        return F.when(size == n, s).when(size > n, joined).otherwise(F.concat(s, F.array_repeat(F.lit(""), F.greatest((n - size).cast("int"), F.lit(0)))))

    return let(new, fit)
