"""Stored routines: commands with parameters, all or nothing.

A call computes the new state of every table it touches as DataFrames and hands
all of them over at once; an error leaves the old state.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.errors import SchemaError
from plumbline.functions.canonical import typed_value
from plumbline.functions.scalar import over_columns, quoted
from plumbline.operators.constraints import with_generated
from plumbline.plans.model import Action, Expression, Routine, Schema, Type
from plumbline.plans.objects import ROUTINE_CONDITIONS, ROUTINE_LITERALS

#: An argument: its kind (a family or "null") and its canonical text.
Argument = tuple[str, str]


def argument(value: Argument) -> Column:
    kind, text = value
    return F.lit(None) if kind == "null" else typed_value(F.lit(text), Type(kind))


def _allowed(e: Expression, value_only: bool) -> None:
    if e.kind == "parameter" or e.kind in ROUTINE_LITERALS:
        return
    if value_only:
        raise SchemaError(f"a routine can't assign {e.kind!r}")
    if e.kind == "column":
        if "." in e.value:
            raise SchemaError(f"a routine can't use the qualified column {e.value!r}")
        return
    if ROUTINE_CONDITIONS.get(e.kind) != len(e.args):
        raise SchemaError(f"a routine's condition can't use {e.kind!r}")
    for a in e.args:
        _allowed(a, False)


def call(schema: Schema, tables: Mapping[str, DataFrame], name: str, arguments: Mapping[str, Argument]) -> dict[str, DataFrame]:
    """All tables after the routine has run."""
    routine: Routine | None = next((r for r in schema.routines if r.name == name), None)
    if routine is None:
        raise SchemaError(f"routine {name!r} not found")
    for parameter in routine.parameters:
        if parameter.name not in arguments:
            raise SchemaError(f"routine {name!r} misses parameter {parameter.name!r}")
    values = {k: argument(v) for k, v in arguments.items()}
    out = dict(tables)
    for action in routine.actions:
        out[action.table] = _run(schema, action, out, values)
    return out


def _run(schema: Schema, action: Action, tables: Mapping[str, DataFrame], values: Mapping[str, Column]) -> DataFrame:
    table = schema.table(action.table)
    frame = tables[action.table]
    for a in action.assignments:
        _allowed(a.value, True)
    if action.kind == "insert":
        given = {a.column: a.value for a in action.assignments}
        for column in table.columns:
            if column.generated is None and column.name not in given:
                raise SchemaError(f"insert into {table.name!r} misses column {column.name!r}")
        unknown = set(given) - {c.name for c in table.columns}
        if unknown:
            raise SchemaError(f"unknown column {sorted(unknown)[0]!r}")
        one = frame.sparkSession.range(1)
        row = one.select(*(over_columns(one, given[c.name], values).cast(frame.schema[c.name].dataType).alias(c.name) for c in table.columns if c.generated is None))
        added = with_generated(row, table)
        return frame.unionByName(added.select(*(quoted(c).cast(frame.schema[c].dataType).alias(c) for c in frame.columns)))
    if action.where is None or (action.kind == "update" and not action.assignments):
        raise SchemaError(f"a routine's {action.kind} needs a condition" + (" and assignments" if action.kind == "update" else ""))
    _allowed(action.where, False)
    hit = F.coalesce(over_columns(frame, action.where, values), F.lit(False))
    if action.kind == "delete":
        return frame.where(~hit)
    if action.kind != "update":
        raise SchemaError(f"unsupported routine action {action.kind!r}")
    sets = {a.column: over_columns(frame, a.value, values) for a in action.assignments}
    if set(sets) - set(frame.columns):
        raise SchemaError(f"unknown column {sorted(set(sets) - set(frame.columns))[0]!r}")
    changed = frame.select(*(F.when(hit, sets[c].cast(frame.schema[c].dataType)).otherwise(quoted(c)).alias(c) if c in sets else quoted(c) for c in frame.columns))
    return changed.select(*((over_columns(changed, m.generated.expression).cast(frame.schema[c].dataType).alias(c) if (m := table.column(c)) is not None and m.generated is not None else quoted(c)) for c in frame.columns))
