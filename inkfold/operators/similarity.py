"""Vector similarity and alignment of sentences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD, let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors; null for a vector of zeros."""

    def of(x: Column, y: Column) -> Column:
        norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
        return F.when(norm > 0, dot(x, y) / norm)

    return let(F.struct(a.alias("a"), b.alias("b")), lambda v: of(v["a"], v["b"]))


_SLOTS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"


def hashed_counts(text: Column, size: int = 64) -> Column:
    """A deterministic embedding: counts of lower-cased words by hash, of 64 slots at most.

    A word's slot is written as one character, so that a slot is counted by what its removal takes away.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]+"), F.lit(0))
    slot = lambda w: F.conv(F.substring(F.md5(w), 1, 2), 16, 10).cast("int") % size
    marks = F.array_join(F.transform(words, lambda w: F.substring(F.lit(_SLOTS), slot(w) + 1, F.lit(1))), "")
    every = F.split(F.lit(",".join(_SLOTS[:size])), ",")
    return let(marks, lambda m: F.transform(every, lambda c: (F.length(m) - F.length(F.replace(m, c, F.lit("")))).cast("double")))


def text_similarity(a: Column, b: Column, size: int = 64) -> Column:
    """1 for equal texts, else the cosine of their embeddings, 0 where one has no word."""
    return F.when(a == b, 1.0).otherwise(F.coalesce(cosine(hashed_counts(a, size), hashed_counts(b, size)), F.lit(0.0)))


BLOCK = 4096


def _best_of_block(left: pa.Table, right: pa.Table) -> pa.Table:
    """(_l, best_idx, similarity): for each vector of a block the most similar of another block.

    Products of matrices find those within a hair of the best, which are computed again term by term, so that ties are ties.
    """
    a, b = (t.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1) for t in (left, right))
    idx = right.column("_i").to_numpy()
    order = np.argsort(idx, kind="stable")  # of equals the least index comes first
    b, idx = b[order], idx[order]
    with np.errstate(invalid="ignore", divide="ignore"):
        na, nb = (np.sqrt(np.cumsum(x * x, axis=1)[:, -1]) if x.shape[1] else np.zeros(len(x)) for x in (a, b))
        rough = (a / na[:, None]) @ (b / nb[:, None]).T
    rough[np.isnan(rough)] = -2
    best, sim = np.zeros(len(a), np.int64), np.full(len(a), np.nan)
    near = rough >= rough.max(axis=1, keepdims=True) - 1e-9
    row, col = np.nonzero(near)
    for k in range(0, len(row), 1 << 15):
        r, c = row[k : k + (1 << 15)], col[k : k + (1 << 15)]
        with np.errstate(invalid="ignore", divide="ignore"):
            exact = np.cumsum(a[r] * b[c], axis=1)[:, -1] / (na[r] * nb[c]) if a.shape[1] else np.full(len(r), np.nan)
        exact[(na[r] * nb[c]) == 0] = np.nan
        for i, j, s in zip(r.tolist(), c.tolist(), exact.tolist(), strict=True):
            if best[i] == 0 or s > sim[i]:
                best[i], sim[i] = j + 1, s
    return pa.table({"_l": left.column("_i"), "best_idx": pa.array(idx[best - 1]), "similarity": pa.array(sim, mask=np.isnan(sim))})


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_idx: str, right_idx: str, vector: str = "embedding") -> DataFrame:
    """For each left row its most similar right row with the same ``by``; ties go to the least index, no partner gives 1.0.

    Every pair within a group is compared: groups are dealt by hash to blocks of about BLOCK rows, each left block meets each right
    block of its group in a product of matrices, and the best of the blocks is a pre-aggregated maximum.  A task holds two blocks,
    whatever the groups' size.  Vectors are of one length and hold no nulls or NaN; one of zeros is like none, with a null similarity.
    """
    group = F.to_json(F.struct(*[F.col(c) for c in by]), {"ignoreNullFields": "false"}) if by else F.lit("")
    schema = f"_g string, _l {left.schema[left_idx].dataType.simpleString()}, best_idx {right.schema[right_idx].dataType.simpleString()}, similarity double"
    own = left.select(group.alias("_g"), F.col(left_idx).alias("_i"), F.col(vector).alias("_v"))
    other = right.select(group.alias("_g"), F.col(right_idx).alias("_i"), F.col(vector).alias("_v"))
    n = own.groupBy("_g").agg(F.count("*").alias("n")).join(other.groupBy("_g").agg(F.count("*").alias("m")), "_g")
    blocks = n.select("_g", F.ceil(F.col("n") / BLOCK).cast("int").alias("_n"), F.ceil(F.col("m") / BLOCK).cast("int").alias("_m"))
    block = lambda count: F.pmod(F.xxhash64("_i"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    a = own.join(blocks, "_g").select("_g", block("_n").alias("_p"), every("_m").alias("_q"), "_i", "_v")
    b = other.join(blocks, "_g").select("_g", every("_n").alias("_p"), block("_m").alias("_q"), "_i", "_v")

    def best(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        x, y = (x, y) if len(x) and len(y) else (x.slice(0, 0), y.slice(0, 0))
        out = _best_of_block(x, y) if len(x) else pa.table({"_l": x.column("_i"), "best_idx": y.column("_i"), "similarity": pa.array([], pa.float64())})
        return out.add_column(0, "_g", pa.array([key[0].as_py()] * len(out), pa.string()))

    found = a.groupBy("_g", "_p", "_q").cogroup(b.groupBy("_g", "_p", "_q")).applyInArrow(best, schema)
    top = F.max_by(F.struct("best_idx", "similarity"), F.struct("similarity", (-F.col("best_idx")).alias("i")))
    found = found.groupBy("_g", "_l").agg(top.alias("b")).withColumnRenamed("_g", "_k")
    keys = left.select(group.alias("_g"), *by, left_idx).dropDuplicates(["_g", left_idx])
    joined = keys.join(found, (F.col("_g") == F.col("_k")) & F.col(left_idx).eqNullSafe(F.col("_l")), "left")
    return joined.select(*by, left_idx, "b.best_idx", F.when(F.col("b.best_idx").isNull(), 1.0).otherwise(F.col("b.similarity")).alias("similarity"))
