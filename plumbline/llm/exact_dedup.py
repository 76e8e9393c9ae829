"""Exact duplicates of whole texts by content-defined chunk recipes. DataFrame functions only.

A text is cut where its own content says so: after a sentence or line end that
follows at least ``CHUNK_LEAST`` characters, else after ``CHUNK_MOST``. Equal
texts thus have equal cuts, and the text is the concatenation of its chunks. A
recipe is the ordered list of its chunks' identifiers. Texts of equal recipes
are equal because identifiers are verified: every distinct chunk is moved once
(after a map-side aggregation) to see that no identifier stands for two
different contents; if one did, the next wider kind of identifier is taken, at
last the contents themselves. Only recipes, 8 bytes for about a kilobyte of
text, are grouped and joined; long documents don't move again.

Every row then gets its group's numbers. Groups that hold more than one row in
MOST_HOT, so at most MOST_HOT groups, are broadcast; the rest, of which none is
large, come by a shuffle. So copies of one text never meet in one task.

Null text counts as empty, all empty texts are equal. Of equal texts the rows
with the largest doc_id stay; a null doc_id stays only in a group without any
other. In ``equal_texts`` rows that repeat a doc_id count one by one in
group_size and are kept or not together; ``keep_last`` leaves exactly one row of
each text, of rows with the same doc_id and text the one whose other columns
come first as JSON. An empty table gives an empty result; other columns may have
any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.scratch import few, written

CHUNK_LEAST, CHUNK_MOST = 1024, 8192
CHUNK = rf"(?s).{{{CHUNK_LEAST},{CHUNK_MOST}}}?(?<=[.!?]\s|\n)|.{{1,{CHUNK_MOST}}}"

#: Groups of more than one row in MOST_HOT (and more than HOT_ROWS rows) are broadcast: at most MOST_HOT.
HOT_ROWS, MOST_HOT = 500, 10_000

#: From narrow to wide; the last is exact by itself.
IDENTIFIERS = (
    lambda chunk: F.xxhash64(chunk),
    lambda chunk: F.sha2(chunk.cast("binary"), 256),
    lambda chunk: chunk,
)


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def _ambiguous(docs: DataFrame, identifier) -> bool:
    """Whether some identifier stands for two different chunks."""
    each = docs.select(F.explode(chunks(F.col("text"))).alias("chunk"))
    distinct = each.groupBy(identifier(F.col("chunk")).alias("id"), "chunk").agg(F.lit(1).alias("one"))
    return not distinct.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def equal_texts(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of ``docs`` (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    for identifier in IDENTIFIERS:
        if identifier is IDENTIFIERS[-1] or not _ambiguous(texts, identifier):
            break
    recipe = F.transform(chunks(F.col("text")), identifier)
    recipes = written(texts.select("doc_id", recipe.alias("recipe"), F.octet_length("text").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")), "recipes")
    groups = written(recipes.groupBy("size", "recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    large = F.col("group_size") > max(HOT_ROWS, recipes.count() // MOST_HOT)
    first = recipes.join(F.broadcast(groups.where(large)), ["size", "recipe"], "left")
    found = first.where("group_size IS NOT NULL").unionByName(first.where("group_size IS NULL").drop("keep_id", "group_size").join(groups.where(~large), ["size", "recipe"]))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def without(docs: DataFrame, gone: DataFrame, twice: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``gone``, and one row of each of ``twice``; both (doc_id, text_sha256), distinct.

    A row is known by its doc_id (null is one, too) and its text, so rows that share
    only one of them are never mistaken for each other.
    """
    whole = docs.select(F.struct("*").alias("row"))
    keyed = whole.select("row", F.col("row.doc_id").cast("bigint").alias("id"), text_hash(F.col("row.text")).alias("hash"))

    def listed(rows: DataFrame) -> tuple[DataFrame, Column]:
        rows = few(rows.select(F.col("doc_id").alias("other_id"), F.col("text_sha256").alias("other_hash")))
        return rows, F.col("id").eqNullSafe(F.col("other_id")) & (F.col("hash") == F.col("other_hash"))

    stays = keyed.join(*listed(gone), "left_anti")
    twice = written(twice, "twice")
    if twice.isEmpty():
        return stays.select("row.*")
    # Copies of a row are reduced in each task before anything is moved.
    place = F.to_json(F.struct(*(F.col("row")[c] for c in docs.columns if c != "text"), F.lit("")), {"ignoreNullFields": "false"})
    once = stays.join(*listed(twice), "left_semi").groupBy("id", "hash").agg(F.min_by("row", place).alias("row"))
    return stays.join(*listed(twice), "left_anti").select("row.*").unionByName(once.select("row.*"))


def keep_last(docs: DataFrame) -> DataFrame:
    """``docs`` with exactly one row of each text, that of the largest doc_id."""
    found = written(equal_texts(docs).groupBy("doc_id", "text_sha256", "kept").agg(F.count("*").alias("n")), "found")
    return without(docs, found.where("NOT kept"), found.where("kept AND n > 1"))
