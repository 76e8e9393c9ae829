"""From raw documents to packed sequences: filter, identify, deduplicate, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Between stages the rows are written as Parquet
to the cluster's shared folder and read again.

Rows are what stays or goes, never ids. Null text counts as empty, has no words and
goes with the quality rules. Of equal texts one row stays, that of the largest
doc_id (a null one only if there is no other); of linked documents one row, that of
the smallest doc_id (a null one last, then by the text's hash). So rows that share a
doc_id but not their text are judged apart, and a row that occurs twice stays once.
Other columns are carried along, whatever their names. An empty table gives an empty
result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import exact_dedup, jaccard_join, langid, packing, quality
from plumbline.llm.scratch import written

#: Near copies: word shingles of five, similarity of 0.8 or more.
NEAR = jaccard_join.Rule(5, 80)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the compression bands."""
    return quality.passing(docs, quality.limits_of(docs, sf_dir))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one of the languages that the labels name."""
    return langid.speaking(docs, langid.train(docs.where(~langid.held_out())))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return exact_dedup.keep_last(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest doc_id."""
    return jaccard_join.keep_one(docs, NEAR)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with the sequence and offset of each."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("packing", pack),
]

#: Compression, language and tokens can't be expressed in SQL; a test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
