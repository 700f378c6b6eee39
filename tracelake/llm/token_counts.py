"""Token counts: an exact histogram of encoded lengths with suffix sums.

Every document is encoded whole; what leaves a task is one row for each length it has seen. Suffix sums over the
histogram answer, for every context limit, how many documents and ids reach it, what remains when documents are cut at
it, and what share of documents is no longer: no second look at any text. The sums are taken in two steps (within
ranges of 256 lengths, and over the ranges), so that no task holds all lengths.

Defined results: a null text is an empty one (length 0); an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.codec import codec
from tracelake.llm.common import one_chunk, text_blocks, written

RANGE = 256


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer)
        for block in text_blocks(batches):
            n, docs = np.unique(code.encode(one_chunk(block["text"]))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))], ["n_tokens", "n_docs"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(count, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L of the histogram, as a context limit: documents and ids of length L or more, the total when
    documents are cut at L, and the share of documents of length L or less. The histogram is written once: it is read twice."""
    h = written(hist, "lengths").withColumn("r", F.floor(F.col("n_tokens") / RANGE)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    ranges = h.groupBy("r").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    # One row for each range of lengths: as many as the longest document has ids, divided by RANGE.
    after = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select("r", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"), F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens"))
    inside = Window.partitionBy("r").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    s = h.withColumns({"d_in": F.sum("n_docs").over(inside), "t_in": F.sum("tokens").over(inside)}).join(ranges, "r")
    docs_from, tokens_from = F.col("d_in") + F.col("d_after"), F.col("t_in") + F.col("t_after")
    return s.select(
        "n_tokens",
        "n_docs",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        (F.col("all_tokens") - tokens_from + docs_from * F.col("n_tokens")).alias("tokens_cut"),
        ((F.col("all_docs") - docs_from + F.col("n_docs")) / F.col("all_docs")).alias("share_upto"),
    )


def cut_total(limit: int) -> Column:
    """Aggregate over suffix_sums(): the total of ids when every document is cut at limit, for any limit.

    With L the largest length of at most limit, it is tokens_cut at L plus (limit - L) for each longer document.
    """
    below = F.when(F.col("n_tokens") <= limit, F.struct("n_tokens", (F.col("tokens_cut") + (limit - F.col("n_tokens")) * (F.col("docs_from") - F.col("n_docs"))).alias("v")))
    above = F.max(F.when(F.col("n_tokens") > limit, F.col("docs_from"))) * limit  # no document is as short as limit
    return F.coalesce(F.max(below)["v"], above)


def quantile(q: float) -> Column:
    """Aggregate over suffix_sums(): the least length that a share q of the documents does not exceed."""
    return F.min(F.when(F.col("share_upto") >= q, F.col("n_tokens")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the histogram of all documents with its suffix sums."""
    import public_tokenizers

    return suffix_sums(length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")))
