"""Exact token counts for every context limit from one histogram of lengths.

Documents are aggregated by encoded length (with a map-side combine); all
answers come from the histogram, which has at most as many rows as the longest
document has tokens. Suffix sums are taken within blocks of 1,024 lengths and
over the blocks, so that no task holds all lengths.

Null and empty texts have length 0. A repeated row counts again. An empty table
gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.packing import document_encoder
from plumbline.llm.scratch import texts_of, written
from plumbline.llm.textbatch import slices

BLOCK = 1024


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, forget = document_encoder(path)
        try:
            for _, texts in slices(batches):
                yield pa.record_batch([pa.array([len(ids_of(texts.raw(i).decode("utf-8", "replace"))) // 4 for i in range(len(texts))], pa.int64())], names=["length"])
        finally:
            forget()

    return run


def histogram(docs: DataFrame, path: str) -> DataFrame:
    """(length, n_docs) of ``docs`` (text). Written down, since every answer reads it more than once."""
    lengths = docs.select(F.lit(0).alias("doc_id"), "text").transform(texts_of).mapInArrow(_lengths(path), "length bigint")
    return written(lengths.groupBy("length").agg(F.count("*").alias("n_docs")), "histogram")


def at_limits(counts: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit:

    docs_within and docs_over (fitting whole, or longer), tokens_within,
    truncated_tokens (all documents cut to the limit), total_tokens, and
    quantile (share of documents of at most this length).
    """
    rows = counts.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.expr(f"length div {BLOCK}").alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("bigint")
    above = blocks.select("block", F.coalesce(F.sum("d").over(later), zero).alias("d_above"), F.coalesce(F.sum("t").over(later), zero).alias("t_above"), F.sum("d").over(everything).alias("all_docs"), F.sum("t").over(everything).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    suffix = rows.withColumn("d_in", F.coalesce(F.sum("n_docs").over(inside), zero)).withColumn("t_in", F.coalesce(F.sum("tokens").over(inside), zero))
    over, over_tokens = F.col("d_in") + F.col("d_above"), F.col("t_in") + F.col("t_above")
    return suffix.join(above, "block").select(
        "length",
        "n_docs",
        (F.col("all_docs") - over).alias("docs_within"),
        over.alias("docs_over"),
        (F.col("total_tokens") - over_tokens).alias("tokens_within"),
        (F.col("total_tokens") - over_tokens + over * F.col("length")).alias("truncated_tokens"),
        "total_tokens",
        ((F.col("all_docs") - over) / F.col("all_docs")).alias("quantile"),
    )


def for_limits(counts: DataFrame, limits: Iterable[int]) -> DataFrame:
    """What ``at_limits`` says, for any given limits; n_docs is the number of documents of just that length.

    Empty for an empty histogram.
    """
    given = counts.sparkSession.createDataFrame([(x,) for x in sorted(set(limits))], "wanted bigint")
    fits = F.col("length") <= F.col("wanted")
    zero = F.lit(0).cast("bigint")
    n, tokens = F.col("n_docs"), F.col("length") * F.col("n_docs")
    # A few rows; the histogram has at most as many as the longest document has tokens.
    found = counts.crossJoin(F.broadcast(given)).groupBy("wanted").agg(
        F.sum(F.when(F.col("length") == F.col("wanted"), n).otherwise(zero)).alias("n_docs"),
        F.sum(F.when(fits, n).otherwise(zero)).alias("docs_within"),
        F.sum(F.when(fits, zero).otherwise(n)).alias("docs_over"),
        F.sum(F.when(fits, tokens).otherwise(zero)).alias("tokens_within"),
        F.sum(tokens).alias("total_tokens"),
    )
    return found.select(
        F.col("wanted").alias("length"),
        "n_docs",
        "docs_within",
        "docs_over",
        "tokens_within",
        (F.col("tokens_within") + F.col("docs_over") * F.col("wanted")).alias("truncated_tokens"),
        "total_tokens",
        (F.col("docs_within") / (F.col("docs_within") + F.col("docs_over"))).alias("quantile"),
    )
