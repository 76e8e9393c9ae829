"""Change journals: their schema, rules, and capture as the difference of two states.

A journal row carries its images as maps from column to (kind, canonical text);
``as_text`` and ``of_text`` turn them into the JSON texts of other programs' journals
and back. A journal is a list of Parquet folders, one for each captured change of a
table, so sequences and tables are clustered in them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.errors import PlumblineError, SchemaError
from plumbline.functions.canonical import canonical, image, image_of_text, image_text
from plumbline.functions.scalar import quoted
from plumbline.plans.model import Schema, Table, Target
from plumbline.shared import written

IMAGE = "map<string,struct<kind:string,value:string>>"
JOURNAL = (
    "source struct<engine:string,version:struct<major:int,minor:int,patch:int>>, sequence bigint, committed_at timestamp, kind string, `table` string, "
    f"primary_key {IMAGE}, before {IMAGE}, after {IMAGE}, transaction_id string, origin string"
)


def source_column(target: Target) -> Column:
    v = target.version
    version = F.struct(F.lit(v.major).alias("major"), F.lit(v.minor).alias("minor"), F.lit(v.patch).alias("patch"))
    return F.struct(F.lit(target.engine).alias("engine"), version.alias("version"))


def capture(schema: Schema, table: Table, old: DataFrame, new: DataFrame, target: Target, after_sequence: int = 0, origin: str = "", transaction: str = "") -> DataFrame:
    """Journal rows that turn ``old`` into ``new``: one full outer join on the primary key.

    A row whose key changes is a delete and an insert. Sequences are consecutive
    and depend on the keys alone, so a task that runs again gives the same ones.
    """
    key = table.primary_key
    if not key:
        raise SchemaError(f"table {table.name!r} needs a primary key to be captured")
    one, two = canonical(old, table), canonical(new, table)
    left = one.toDF(*(f"old.{c}" for c in one.columns)).withColumn("was", F.lit(True))
    right = two.toDF(*(f"new.{c}" for c in two.columns)).withColumn("is", F.lit(True))
    on = [quoted(f"old.{k}").eqNullSafe(quoted(f"new.{k}")) for k in key]
    both = left.join(right, on, "full_outer")
    same = F.lit(True)
    for c in table.columns:
        same = same & quoted(f"old.{c.name}").eqNullSafe(quoted(f"new.{c.name}"))
    kind = F.when(F.col("was").isNull(), "insert").when(F.col("is").isNull(), "delete").otherwise("update")
    changed = both.where(F.col("was").isNull() | F.col("is").isNull() | ~same)
    keys = [table.column(k) for k in key]
    before = F.when(F.col("was"), image(table.columns, "old."))
    after = F.when(F.col("is"), image(table.columns, "new."))
    # A change is addressed by the key that it found.
    primary = F.when(F.col("was"), image(tuple(keys), "old.")).otherwise(image(tuple(keys), "new."))
    rows = changed.select(kind.alias("kind"), primary.alias("primary_key"), before.alias("before"), after.alias("after"), F.concat_ws("\x1f", *(F.coalesce(quoted(f"old.{k}"), quoted(f"new.{k}")) for k in key)).alias("place"))
    # The join is needed once, though its rows are read twice: to count parts and to number them.
    return numbered(written(rows, "changed"), "place", after_sequence).select(
        source_column(target).alias("source"),
        "sequence",
        F.current_timestamp().alias("committed_at"),
        "kind",
        F.lit(table.name).alias("table"),
        "primary_key",
        "before",
        "after",
        F.lit(transaction).alias("transaction_id"),
        F.lit(origin).alias("origin"),
    )


#: Parts in which changes are numbered at the same time.
PARTS = 1 << 16


def numbered(rows: DataFrame, key: str, start: int) -> DataFrame:
    """Consecutive sequences without one task for all rows: parts by a hash of the
    (unique) key, a row number in each, and a running sum over the parts' sizes."""
    parts = rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS)))
    inside = parts.withColumn("place_in_part", F.row_number().over(Window.partitionBy("part").orderBy(key)))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    bases = sizes.withColumn("base", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    return inside.join(bases, "part").withColumn("sequence", F.lit(start) + F.col("base") + F.col("place_in_part")).drop("part", "place_in_part", "base")


def read(journal: DataFrame, after: int, limit: int) -> DataFrame:
    """The next changes after a cursor."""
    if limit <= 0:
        raise SchemaError("a positive limit is required")
    return journal.where(F.col("sequence") > after).orderBy("sequence").limit(limit)


def problems(journal: DataFrame, schema: Schema) -> DataFrame:
    """(sequence, problem) of rows that no journal may hold."""
    def empty(c: str) -> Column:
        return F.col(c).isNull() | (F.size(c) == 0)

    tables = [t.name for t in schema.tables]
    columns = F.create_map(*(x for t in schema.tables for x in (F.lit(t.name), F.array(*(F.lit(c.name) for c in t.columns)))))
    wanted = F.element_at(columns, F.col("table"))

    def partial(c: str) -> Column:
        return F.col(c).isNotNull() & (F.size(F.array_except(wanted, F.map_keys(c))) > 0)

    engine, version = F.col("source.engine"), F.col("source.version")
    no_version = (version["major"] < 0) | (version["minor"] < 0) | (version["patch"] < 0) | (version["major"] + version["minor"] + version["patch"] == 0)
    problem = (
        F.when(F.col("source").isNull() | engine.isNull() | ~engine.isin("sqlite", "postgres"), "unknown engine")
        .when(F.coalesce(no_version, F.lit(True)), "the source has no version")
        .when(F.coalesce(F.col("sequence"), F.lit(0)) <= 0, "the sequence is not above zero")
        .when(F.coalesce(F.col("table"), F.lit("")) == "", "no table is named")
        .when(~F.col("table").isin(*tables), "unknown table")
        .when(empty("primary_key"), "no key is given")
        .when(F.coalesce(~F.col("kind").isin("insert", "update", "delete"), F.lit(True)), "neither insert, update nor delete")
        .when((F.col("kind") == "insert") & empty("after"), "an insert without its row")
        .when((F.col("kind") == "update") & (empty("before") | empty("after")), "an update without both rows")
        .when((F.col("kind") == "delete") & empty("before"), "a delete without its row")
        .when(partial("before") | partial("after"), "an image misses columns")
    )
    return journal.select("sequence", problem.alias("problem")).where("problem IS NOT NULL")


def repeated_sequences(journal: DataFrame) -> DataFrame:
    return journal.groupBy("source", "sequence").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_valid(journal: DataFrame, schema: Schema) -> None:
    """Raise for the change of the least sequence that breaks a rule."""
    twice = repeated_sequences(journal).select("sequence", F.concat(F.lit("sequence given twice by "), F.col("source.engine")).alias("problem"))
    bad = problems(journal, schema).unionByName(twice).orderBy("sequence").first()
    if bad is not None:
        raise PlumblineError(f"change {bad['sequence']}: {bad['problem']}")
    ends = journal.agg(F.min("source").alias("least"), F.max("source").alias("most")).first()
    if ends["least"] != ends["most"]:
        raise PlumblineError("a batch holds changes of one source")


def empty_journal(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], JOURNAL)


def suppressed(journal: DataFrame, origin: str) -> DataFrame:
    """A journal without what replay itself wrote there: no echo goes back."""
    return journal.where(F.coalesce(F.col("origin"), F.lit("")) != origin)


def _by_table(schema: Schema, one: Callable[[Table], Column]) -> Column:
    """The column that ``one`` gives for each table's rows; an error for a table that isn't in the schema."""
    wrong = F.raise_error(F.concat(F.lit("unknown table "), F.col("table")))
    out = None
    for t in schema.tables:
        here = F.col("table") == t.name
        out = F.when(here, one(t)) if out is None else out.when(here, one(t))
    return wrong if out is None else out.otherwise(wrong)


def as_text(journal: DataFrame, schema: Schema) -> DataFrame:
    """A journal whose images are JSON texts."""
    def text(c: str) -> Column:
        def one(t: Table) -> Column:
            own = tuple(t.column(k) for k in t.primary_key) if c == "primary_key" else t.columns
            return image_text(F.col(c), own)

        return _by_table(schema, one).alias(c)

    return journal.select(*(text(c) if c in ("primary_key", "before", "after") else quoted(c) for c in journal.columns))


def of_text(journal: DataFrame, schema: Schema) -> DataFrame:
    """The reverse of as_text, with the columns of JOURNAL."""
    def image_(c: str) -> Column:
        def one(t: Table) -> Column:
            return image_of_text(F.when(F.col("table") == t.name, F.col(c)), t.columns, c != "primary_key")

        return _by_table(schema, one).alias(c)

    return journal.select(*(image_(c) if c in ("primary_key", "before", "after") else quoted(c) for c in journal.columns))


def images(journal: DataFrame, table: Table, column: str) -> list[Column]:
    """Canonical texts of an image, column by column."""
    return [F.col(column)[c.name]["value"].alias(c.name) for c in table.columns]


def tables_of(schema: Schema, frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    return {t.name: canonical(frames[t.name], t) for t in schema.tables}
