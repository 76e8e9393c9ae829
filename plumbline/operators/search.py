"""Deterministic token search over text columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import SchemaError
from plumbline.functions.scalar import quoted


def word_tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and numbers."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def tokens_of(spark: SparkSession, query: str) -> list[str]:
    """A query's tokens, by the same rules as those of a text; computed while planning, without a job."""
    return list(spark.createDataFrame([(query,)], "q string").select(word_tokens(F.col("q"))).first()[0])


def holds(text: Column, token: str) -> Column:
    """Whether a lower-case text has the token as a run of its own. Nearly all texts are
    settled by ``contains``; the expression looks at what stands on both sides."""
    return text.contains(token) & text.rlike(r"(?<![\p{L}\p{N}])" + re.escape(token) + r"(?![\p{L}\p{N}])")


def search(frame: DataFrame, id_column: str, text_columns: list[str], query: str) -> DataFrame:
    """(id) of rows that hold every token of the query, as text and in its order.

    NULL columns hold no tokens; a query without tokens fits every row. One
    narrow scan of the id and text columns; the order is the only shuffle.
    """
    if not id_column or not text_columns:
        raise SchemaError("an id column and text columns are required")
    content = F.concat_ws(" ", *(quoted(c).cast("string") for c in text_columns))
    held = frame.select(quoted(id_column).cast("string").alias("id"), F.lower(content).alias("content"))
    for token in sorted(tokens_of(frame.sparkSession, query), key=len, reverse=True):
        held = held.where(holds(F.col("content"), token))
    return held.select("id").orderBy("id")
