"""Token counts by a separator scan of flat, unindexed token files.

A token file is a bare sequence of little-endian unsigned ids, of 16 bits if the vocabulary allows it and else of 32, in which an
end-of-document id, the first that isn't in the vocabulary, follows each document.
Blocks of a file are read by byte range and searched at once, as arrays.  A block knows its separators and the tokens before its
first and after its last one; an exclusive prefix scan over the blocks of a file gives the number of documents and the tokens
of the unfinished document that each block inherits, which stitches documents together that cross borders.  Scan state is a
pair under an associative operation, so it is computed on a summary row a block; only separators' distances reach the result.

Defined results: a file of no bytes has no documents; empty documents count 0; tokens after the last separator form a document
without an end, reported with ``closed`` false; null text is written as an empty document; a text longer than a block is stitched;
repeated rows and null ids count like any other.  A file has to be a whole number of ids.  Other columns are of no account.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import codec
from .common import ID, TEXT, keyed, shared_dir

BLOCK_BYTES = 1 << 20


def layout(eod: int) -> str:
    """The type of the ids of a file in which ``eod`` is the greatest."""
    return "<u2" if eod < 1 << 16 else "<u4"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri) if not uri.startswith("file:") else uri.replace("file:", "file://", 1))


def write_token_files(docs: DataFrame, folder: str, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode documents to one flat file a task; returns a table (file, ordinal, doc_id) of what was written, in order.

    A task writes under a name of its attempt, and only files named in the returned table count, so attempts that are lost or
    run twice do no harm.
    """

    def run(batches):
        c = codec(vocab)
        eod, kind = c.size, layout(c.size)
        fs, base = _fs(folder)
        name = f"{uuid.uuid4().hex}.bin"
        fs.create_dir(base, recursive=True)
        at = 0
        with fs.open_output_stream(f"{base}/{name}") as out:
            for b in batches:
                ids = b.column(ID)
                for i, text in enumerate(b.column(TEXT)):
                    tokens = c.encode(text.as_py() or "")
                    out.write(np.append(tokens, eod).astype(kind).tobytes())
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(at, at + n)), ids], ["file", "ordinal", "doc_id"])
                at += n

    from .common import table

    return table(keyed(docs, id_col, text_col).drop("_key").mapInArrow(run, "file string, ordinal long, doc_id long"), "token-index")


def blocks(spark: SparkSession, folder: str, files: DataFrame | None = None, block_bytes: int = BLOCK_BYTES, width: int = 2) -> DataFrame:
    """(file, block, begin, end) byte ranges of all files of a folder, or of those in ``files``."""
    fs, base = _fs(folder)
    found = [(f.base_name, f.size) for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.is_file]
    for name, size in found:
        if size % width:
            raise ValueError(f"{name}: {size} bytes are no whole number of tokens")
    sizes = spark.createDataFrame(found, "file string, size long")
    if files is not None:
        sizes = sizes.join(files.select("file").distinct(), "file", "left_semi")
    step = max(width, block_bytes // width * width)
    return sizes.where("size > 0").select("file", F.posexplode(F.sequence(F.lit(0), F.expr(f"size - 1"), F.lit(step))).alias("block", "begin"), "size").select("file", F.col("block").cast("long").alias("block"), "begin", F.least(F.col("begin") + step, "size").alias("end"))


def scan(spark: SparkSession, folder: str, files: DataFrame | None, eod: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, begin, n_tokens, closed): every document of the token files with its first token's place and its length."""
    from .common import table

    kind = layout(eod)
    width = np.dtype(kind).itemsize

    def search(batches):
        fs, base = _fs(folder)
        for b in batches:
            for file, block, begin, end in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                with fs.open_input_file(f"{base}/{file}") as f:
                    ids = np.frombuffer(f.read_at(end - begin, begin), kind)
                at = np.flatnonzero(ids == eod) + begin // width
                last = end // width
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([begin // width], pa.int64()), pa.array([last], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([int(at[-1]) if len(at) else None], pa.int64()), pa.array([at], pa.list_(pa.int64()))], ["file", "block", "first", "last", "n", "last_at", "at"])

    n_blocks = blocks(spark, folder, files, block_bytes, width)
    found = table(n_blocks.repartition("file", "block").mapInArrow(search, "file string, block long, first long, last long, n long, last_at long, at array<long>"), "separators")
    # the prefix scan runs over one narrow row a block
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    state = found.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("documents"), F.coalesce(F.max("last_at").over(before) + 1, F.lit(0)).alias("open_from"))
    joined = found.join(state, ["file", "block"])
    ended = joined.where("n > 0").select(
        "file",
        F.posexplode("at").alias("k", "end"),
        "documents",
        F.expr("concat(array(open_from), transform(slice(at, 1, size(at) - 1), x -> x + 1))").alias("begins"),
    ).select("file", (F.col("documents") + F.col("k")).alias("ordinal"), F.expr("begins[k]").alias("begin"), F.expr("end - begins[k]").alias("n_tokens"), F.lit(True).alias("closed"))
    tail = found.groupBy("file").agg(F.max("last").alias("size"), F.coalesce(F.max("last_at") + 1, F.lit(0)).alias("begin"), F.sum("n").alias("ordinal")).where("begin < size")
    return ended.unionByName(tail.select("file", "ordinal", "begin", (F.col("size") - F.col("begin")).alias("n_tokens"), F.lit(False).alias("closed")))


def token_counts(docs: DataFrame, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of documents, by way of flat token files in the shared folder.

    One row for each row of the input; null text counts 0 tokens.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    index = write_token_files(docs, folder, vocab, id_col, text_col)
    counts = scan(spark, folder, index, codec(vocab).size)
    return index.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
