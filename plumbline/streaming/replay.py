"""Ordered, idempotent replay of a journal with conflict detection, as one window.

A change that succeeds leaves a state that depends on it alone: its ``after``
image, or nothing. So the state that a change meets is the one that the change
before it (of the same table and key) left, or the destination's row for the
first. That is a ``lag``; the whole batch is checked at once and in parallel. What
comes of it is written down once; conflicts are looked for in it, and the new table
is the untouched rows, as they are, plus the last state of each key. Only rows whose
keys the batch names are put into canonical form.

An update may change its key. It then takes the row from the old key and puts
it at the new one, which must have been free: it becomes two events.

Only the journal is applied: triggers and cascades of the destination don't
run, since their effects are in the source's journal as well.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.errors import ConflictError
from plumbline.functions.canonical import canonical, typed, value_text
from plumbline.functions.scalar import quoted
from plumbline.plans.model import Schema, Table
from plumbline.shared import written
from plumbline.streaming.journal import require_valid

LEDGER = "engine string, version string, sequence bigint"
#: Stands for NULL in a key.
NULL_KEY = "\x00null"


def with_key(frame: DataFrame, table: Table) -> DataFrame:
    """Typed rows with ``_key``, the canonical texts of their primary key."""
    kinds = {f.name.lower(): f for f in frame.schema.fields}
    texts = [value_text(quoted(kinds[k.lower()].name), kinds[k.lower()].dataType, table.column(k).type) for k in table.primary_key]
    return frame.withColumn("_key", F.array(*(F.coalesce(t, F.lit(NULL_KEY)) for t in texts)))


def ledger_rows(journal: DataFrame) -> DataFrame:
    """What the ledger keeps of changes."""
    v = F.col("source.version")
    return journal.select(F.col("source.engine").alias("engine"), F.concat_ws(".", v["major"].cast("string"), v["minor"].cast("string"), v["patch"].cast("string")).alias("version"), "sequence")


def pending(journal: DataFrame, ledger: DataFrame) -> DataFrame:
    """Changes that the ledger doesn't hold yet."""
    v = F.col("source.version")
    version = F.concat_ws(".", v["major"].cast("string"), v["minor"].cast("string"), v["patch"].cast("string"))
    keyed = journal.withColumn("_engine", F.col("source.engine")).withColumn("_version", version)
    done = ledger.select(F.col("engine").alias("_engine"), F.col("version").alias("_version"), "sequence").distinct()
    return keyed.join(done, ["_engine", "_version", "sequence"], "left_anti").select(*journal.columns)


def _state(prefix: Column, table: Table) -> Column:
    """An image as an array of texts in the model's order; comparable, and NULL if there is no row."""
    return F.when(prefix.isNotNull(), F.array(*(prefix[c.name]["value"] for c in table.columns)))


def _same(a: Column, b: Column, n: int) -> Column:
    """Whether two states are equal, NULLs included."""
    out = a.isNotNull() & b.isNotNull()
    for i in range(n):
        out = out & a[i].eqNullSafe(b[i])
    return F.coalesce(out, F.lit(False)) | (a.isNull() & b.isNull())


def events(journal: DataFrame, table: Table) -> DataFrame:
    """(sequence, step, role, key, expected, state) of one table's changes.

    role says what the event asks of the state before it: ``insert``,
    ``update`` or ``delete`` as usual; ``leave`` and ``arrive`` are the two
    halves of an update that changes the key.
    """
    mine = journal.where(F.col("table") == table.name)
    key = [F.coalesce(F.col("primary_key")[k]["value"], F.lit(NULL_KEY)) for k in table.primary_key]
    after_key = [F.coalesce(F.col("after")[k]["value"], F.lit(NULL_KEY)) for k in table.primary_key]
    old, new = F.array(*key), F.array(*after_key)
    moves = (F.col("kind") == "update") & (old != new)
    before, after = _state(F.col("before"), table), _state(F.col("after"), table)
    nothing = F.lit(None).cast("array<string>")

    def event(step: int, role: Column, at: Column, expected: Column, state: Column) -> Column:
        return F.struct(F.lit(step).alias("step"), role.alias("role"), at.alias("key"), expected.alias("expected"), state.alias("state"))

    plain = event(0, F.col("kind"), old, before, F.when(F.col("kind") == "delete", nothing).otherwise(after))
    halves = F.array(event(0, F.lit("leave"), old, before, nothing), event(1, F.lit("arrive"), new, nothing, after))
    each = F.explode(F.when(moves, halves).otherwise(F.array(plain))).alias("e")
    return mine.select("sequence", each).select("sequence", "e.*")


def checked(steps: DataFrame, current: DataFrame, table: Table, tolerant: bool) -> DataFrame:
    """Every event with the state that it meets (``found``) and whether that is allowed (``fine``).

    ``current`` are canonical rows. Rows without events are never in the window.
    """
    n = len(table.columns)
    here = current.select(F.array(*(F.coalesce(quoted(k), F.lit(NULL_KEY)) for k in table.primary_key)).alias("key"), F.array(*(quoted(c.name) for c in table.columns)).alias("present"))
    joined = steps.join(here, "key", "left")
    order = Window.partitionBy("key").orderBy("sequence", "step")
    first = F.row_number().over(order) == 1
    found = F.when(first, F.col("present")).otherwise(F.lag("state").over(order))
    rows = joined.withColumn("found", found)
    meets = _same(F.col("found"), F.col("expected"), n)
    absent = F.col("found").isNull()
    settled = _same(F.col("found"), F.col("state"), n)
    strict = F.when(F.col("role").isin("insert", "arrive"), absent).otherwise(meets)
    fine = strict
    if tolerant:  # but for changes of the key, which must find what they expect
        fine = strict | F.when(F.col("role").isin("insert", "update"), settled).otherwise((F.col("role") == "delete") & absent)
    last = F.lead(F.lit(True)).over(order).isNull()
    return rows.withColumn("fine", fine).withColumn("last", last)


def final_rows(outcome: DataFrame, table: Table, frame: DataFrame) -> DataFrame:
    """(_key, _row): the last state of each key in the columns of ``frame``; null where the row is gone."""
    last = outcome.where("last").select(F.col("key").alias("_key"), "state", *(F.col("state")[i].alias(c.name) for i, c in enumerate(table.columns)))
    values = typed(last, table, ("_key", "state"))
    names = {c.name.lower(): c.name for c in table.columns}
    row = F.struct(*(quoted(names[f.name.lower()]).cast(f.dataType).alias(f.name) for f in frame.schema.fields))
    return values.select("_key", F.when(F.col("state").isNotNull(), row).alias("_row"))


def merged(frame: DataFrame, delta: DataFrame, table: Table) -> DataFrame:
    """``frame`` with the rows of ``delta`` (_key, _row) in the place of those with their keys."""
    untouched = with_key(frame, table).join(delta.select("_key"), "_key", "left_anti").drop("_key")
    return untouched.select(*map(quoted, frame.columns)).unionByName(delta.where("_row IS NOT NULL").select("_row.*"))


def replayed(current: DataFrame, outcome: DataFrame, table: Table) -> DataFrame:
    """Rows after the events of ``outcome``."""
    return merged(current, final_rows(outcome, table, current), table)


@dataclass
class Applied:
    """New tables, what changes in them (_key, _row), the ledger's new rows, and the number of changes applied."""

    tables: dict[str, DataFrame]
    deltas: dict[str, DataFrame]
    ledger: DataFrame
    changes: int


def conflicts(schema: Schema, outcomes: Mapping[str, DataFrame]) -> DataFrame | None:
    """(sequence, table, key, expected, found) of all events that are not allowed."""
    out: DataFrame | None = None
    for name, outcome in outcomes.items():
        bad = outcome.where(~F.col("fine")).select("sequence", F.lit(name).alias("table"), "key", "expected", "found")
        out = bad if out is None else out.unionByName(bad)
    return out


def apply_typed(schema: Schema, tables: Mapping[str, DataFrame], journal: DataFrame, ledger: DataFrame, tolerant: bool = False) -> Applied:
    """Apply a batch to tables of typed columns, or raise the first conflict and change nothing.

    Applied again, it changes nothing: the ledger holds its sequences.
    """
    require_valid(journal, schema)
    todo = written(pending(journal, ledger), "todo")
    counts = {r["table"]: r["count"] for r in todo.groupBy("table").count().collect()}  # no more than the schema's tables
    outcomes: dict[str, DataFrame] = {}
    for t in schema.tables:
        if t.name in counts:
            steps = events(todo, t)
            touched = with_key(tables[t.name], t).join(steps.select(F.col("key").alias("_key")).distinct(), "_key", "left_semi").drop("_key")
            outcomes[t.name] = written(checked(steps, canonical(touched, t), t, tolerant), "outcome")
    bad = conflicts(schema, outcomes)
    first = bad.orderBy("sequence").first() if bad is not None else None
    if first is not None:
        raise ConflictError(first["table"], first["key"], first["expected"], first["found"], first["sequence"])
    deltas = {name: final_rows(outcome, schema.table(name), tables[name]) for name, outcome in outcomes.items()}
    out = {t.name: merged(tables[t.name], deltas[t.name], t) if t.name in deltas else tables[t.name] for t in schema.tables}
    return Applied(out, deltas, ledger_rows(todo), sum(counts.values()))
