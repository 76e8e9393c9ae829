"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` (see
``plumbline.shared``): a lost executor then costs a reread, never a recomputation of
what stood before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.shared import written

#: Rows of an Arrow batch to Python, where the session has Spark's own default of 10,000:
#: a batch of long documents would otherwise be as large as a task's memory.
BATCH_ROWS, DEFAULT_ROWS = 1_000, "10000"


#: Up to so many narrow rows are broadcast, which is some 50 MB; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def few(rows: DataFrame) -> DataFrame:
    """``rows`` written down and counted; marked for a broadcast only if they are few."""
    rows = written(rows, "few")
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def texts_of(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, ``more`` columns and text of documents, to be read in Python in bounded batches.

    Spark bounds a batch by its bytes as well (``maxBytesPerBatch``, 64 MB), so that long
    texts come in batches of few rows; only a single text can be longer than that.
    """
    spark = docs.sparkSession
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, DEFAULT_ROWS) == DEFAULT_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *more, "text")


def below_share(share: Column, *columns: str) -> Column:
    """Whether the columns' hash, read as a number from 0 to 1, lies below ``share``."""
    return (F.xxhash64(*columns, F.lit(77)).cast("double") / F.lit(2.0**64) + 0.5) < share
