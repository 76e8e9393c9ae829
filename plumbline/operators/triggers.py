"""Row triggers over sets of changed rows.

A statement's changes are one DataFrame with the columns ``old.*`` and
``new.*`` as structs (one of them is missing for inserts and deletes). A
trigger filters it by WHEN and turns it into changes of other tables: INSERT is
a projection, UPDATE and DELETE are joins on their condition.

As a set this equals row by row only if no action depends on an earlier one of
the same statement. So it is refused if a trigger writes its own table, or if
an UPDATE would hit the same row twice.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.errors import SchemaError
from plumbline.functions.canonical import carrier
from plumbline.functions.scalar import Compiler, quoted, resolve
from plumbline.operators.constraints import with_defaults, with_generated
from plumbline.plans.model import Action, Expression, Schema, Table, Trigger


def delta(old: DataFrame | None, new: DataFrame | None, key: tuple[str, ...] = ()) -> DataFrame:
    """Changed rows as structs: both sides are joined by the key."""
    if old is None and new is None:
        raise SchemaError("a change has an old or a new side")
    if new is None:
        return old.select(F.struct("*").alias("old"))
    if old is None:
        return new.select(F.struct("*").alias("new"))
    if not key:
        raise SchemaError("updates need a key")
    one = old.select(F.struct("*").alias("old"))
    two = new.select(F.struct("*").alias("new"))
    on = [F.col("old")[k].eqNullSafe(F.col("new")[k]) for k in key]
    return one.join(two, on)


def _flat(changes: DataFrame) -> DataFrame:
    columns = []
    for side in ("old", "new"):
        if side in changes.columns:
            columns += [F.col(side)[f.name].alias(f"{side}.{f.name}") for f in changes.schema[side].dataType.fields]
    return changes.select(*columns)


def _compile(frame: DataFrame, e: Expression, target: dict[str, str] | None = None) -> Column:
    names = {c.lower(): c for c in frame.columns}

    def find(name: str) -> str:
        alias, dot, column = name.rpartition(".")
        if dot and alias.lower() in ("old", "new"):
            got = names.get(f"{alias.lower()}.{column.lower()}")
        else:
            got = (target or {}).get(column.lower()) if not dot or alias.lower() == "target" else None
        if got is None:
            raise SchemaError(f"unknown column {name!r} in a trigger")
        return got

    return Compiler(frame)(resolve(e, find))


def _insert(schema: Schema, action: Action, table: Table, changes: DataFrame, current: DataFrame) -> DataFrame:
    given = changes.select(*(_compile(changes, a.value).alias(a.column) for a in action.assignments))
    rows = with_generated(with_defaults(given, schema, table), table)
    return current.unionByName(rows.select(*(quoted(c).cast(current.schema[c].dataType).alias(c) for c in current.columns)))


def _targets(action: Action, changes: DataFrame, current: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    if action.where is None:
        raise SchemaError(f"a trigger's {action.kind} needs a condition")
    names = {c.lower(): f"t_{i}" for i, c in enumerate(current.columns)}
    target = current.toDF(*names.values())
    condition = _compile(target.crossJoin(changes), action.where, names)
    return target.join(changes, condition), names


def _update(action: Action, changes: DataFrame, current: DataFrame, table: Table) -> DataFrame:
    hit, names = _targets(action, changes, current)
    key = table.primary_key
    if not key:
        raise SchemaError(f"table {table.name!r} has no primary key")
    sets = {a.column.lower(): _compile(hit, a.value, names) for a in action.assignments}
    unknown = set(sets) - set(names)
    if unknown:
        raise SchemaError(f"unknown column {sorted(unknown)[0]!r} in a trigger")
    new = hit.select(*(F.col(names[k.lower()]).alias(f"k{i}") for i, k in enumerate(key)), *(v.alias(f"v_{c}") for c, v in sets.items()))
    keys = [f"k{i}" for i in range(len(key))]
    # A row that two changes hit would depend on their order: refuse it.
    once = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("times"), *(F.first(f"v_{c}").alias(f"v_{c}") for c in sets))
    wrong = F.raise_error(F.lit(f"a trigger updates a row of {table.name} twice")).cast("boolean")
    once = once.withColumn("hit", F.when(F.col("times") == 1, F.lit(True)).otherwise(wrong))
    joined = current.join(once, [quoted(k).eqNullSafe(F.col(f"k{i}")) for i, k in enumerate(key)], "left")
    columns = [F.when(F.col("hit"), F.col(f"v_{c.lower()}").cast(current.schema[c].dataType)).otherwise(quoted(c)).alias(c) if c.lower() in sets else quoted(c) for c in current.columns]
    return joined.select(*columns)


def _delete(action: Action, changes: DataFrame, current: DataFrame) -> DataFrame:
    if action.where is None:
        raise SchemaError("a trigger's delete needs a condition")
    names = {c.lower(): f"t_{i}" for i, c in enumerate(current.columns)}
    target = current.toDF(*names.values())
    condition = _compile(target.crossJoin(changes), action.where, names)
    return target.join(changes, condition, "left_anti").toDF(*current.columns)


def fire(schema: Schema, trigger: Trigger, changes: DataFrame, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables after a trigger has run for ``changes`` (structs old and new)."""
    out = dict(tables)
    flat = _flat(changes)
    if trigger.when is not None:
        flat = flat.where(_compile(flat, trigger.when))
    for action in trigger.actions:
        if action.table == trigger.table:
            raise SchemaError(f"trigger {trigger.name!r} writes its own table")
        table = schema.table(action.table)
        current = out[action.table]
        if action.kind == "insert":
            out[action.table] = _insert(schema, action, table, flat, current)
        elif action.kind == "update":
            out[action.table] = _update(action, flat, current, table)
        elif action.kind == "delete":
            out[action.table] = _delete(action, flat, current)
        else:
            raise SchemaError(f"unsupported trigger action {action.kind!r}")
    return out


def fire_all(schema: Schema, table: str, event: str, changes: DataFrame, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Run a table's triggers of an event: BEFORE ones first, each in the schema's order."""
    out = dict(tables)
    for timing in ("before", "after"):
        for trigger in schema.triggers:
            if (trigger.table, trigger.event, trigger.timing) == (table, event, timing):
                out = fire(schema, trigger, changes, out)
    return out


def empty(frame: DataFrame, table: Table) -> DataFrame:
    """No rows, with a table's columns."""
    return frame.sparkSession.createDataFrame([], ", ".join(f"`{c.name}` {carrier(c.type).simpleString()}" for c in table.columns))
