"""Constraints as queries for the rows that break them, and referential actions.

Nothing is enforced row by row: a check is one aggregation or one anti-join
over the whole table, which Catalyst plans like any other query.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.errors import ConstraintError, SchemaError
from plumbline.functions.canonical import carrier
from plumbline.functions.scalar import over_columns, quoted
from plumbline.plans.model import Constraint, Expression, Index, Schema, Table


def _all_set(columns: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & quoted(c).isNotNull()
    return out


def repeated(frame: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Keys without NULL that occur more than once, with their number."""
    keys = [quoted(c) for c in columns]
    return frame.where(_all_set(columns)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def primary_key_violations(frame: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows with a NULL in the key, or with a key that another row has too."""
    null_keys = frame.where(~_all_set(columns)).select(*map(quoted, columns)).withColumn("n", F.lit(1).cast("bigint"))
    return repeated(frame, columns).unionByName(null_keys)


def orphans(child: DataFrame, columns: tuple[str, ...], parent: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Child rows whose key has no NULL and no parent."""
    wanted = parent.select(*(quoted(k).alias(f"k{i}") for i, k in enumerate(keys))).distinct()
    on = [quoted(c) == F.col(f"k{i}") for i, c in enumerate(columns)]
    return child.where(_all_set(columns)).join(wanted, on, "left_anti")


def check_violations(frame: DataFrame, expression: Expression) -> DataFrame:
    """Rows for which a condition is false; unknown passes."""
    return frame.where(~F.coalesce(over_columns(frame, expression), F.lit(True)))


def _substituted(e: Expression, column: str) -> Expression:
    if e.kind == "domain_value":
        return Expression("column", column)
    return Expression(e.kind, e.value, tuple(_substituted(a, column) for a in e.args))


def domain_check(schema: Schema, table: Table, column: str) -> tuple[Expression | None, bool]:
    """The condition of a column's domain over that column, and whether NULL is refused."""
    found = table.column(column)
    if found is None or not found.domain:
        return None, False
    domain = schema.domain(found.domain)
    return (_substituted(domain.check, column) if domain.check is not None else None), domain.not_null


def index_violations(frame: DataFrame, index: Index) -> DataFrame:
    """Keys of a unique index (partial and expression keys too) that occur more than once."""
    part = frame if index.where is None else frame.where(over_columns(frame, index.where))
    keys = [quoted(k.column) if k.column else over_columns(frame, k.expression) for k in index.columns]
    named = part.select(*(k.alias(f"key{i + 1}") for i, k in enumerate(keys)))
    return repeated(named, tuple(named.columns))


@dataclass(frozen=True)
class Violation:
    table: str
    constraint: str
    rows: DataFrame


def violations(schema: Schema, tables: Mapping[str, DataFrame]) -> list[Violation]:
    """A query for every rule of the schema; those of a sound snapshot are all empty."""
    out: list[Violation] = []
    for table in schema.tables:
        frame = tables[table.name]

        def add(name: str, rows: DataFrame, table: Table = table) -> None:
            out.append(Violation(table.name, name, rows))

        for column in table.columns:
            check, required = domain_check(schema, table, column.name)
            if not column.nullable or required:
                add(f"NOT NULL of {column.name}", frame.where(quoted(column.name).isNull()))
            if check is not None:
                add(f"CHECK of domain {column.domain}", check_violations(frame, check))
        for constraint in table.constraints:
            out.append(_constraint(schema, table, constraint, tables))
    for index in schema.indexes:
        if index.unique:
            out.append(Violation(index.table, f"UNIQUE of index {index.name}", index_violations(tables[index.table], index)))
    return out


def _constraint(schema: Schema, table: Table, c: Constraint, tables: Mapping[str, DataFrame]) -> Violation:
    frame = tables[table.name]
    listed = ", ".join(c.columns)
    if c.kind == "primary_key":
        return Violation(table.name, f"PRIMARY KEY ({listed})", primary_key_violations(frame, c.columns))
    if c.kind == "unique":
        return Violation(table.name, f"UNIQUE ({listed})", repeated(frame, c.columns))
    if c.kind == "check" and c.expression is not None:
        return Violation(table.name, "CHECK", check_violations(frame, c.expression))
    if c.kind == "foreign_key" and c.references is not None:
        keys = c.references.columns or schema.table(c.references.table).primary_key
        return Violation(table.name, f"FOREIGN KEY ({listed})", orphans(frame, c.columns, tables[c.references.table], keys))
    raise SchemaError(f"table {table.name!r}: incomplete constraint {c.kind!r}")


def require_sound(schema: Schema, tables: Mapping[str, DataFrame]) -> None:
    """Raise for the first rule that some row breaks."""
    for v in violations(schema, tables):
        n = v.rows.count()
        if n:
            raise ConstraintError(v.table, v.constraint, n)


# --------------------------------------------------------------------------- values that a write adds


def with_defaults(rows: DataFrame, schema: Schema, table: Table) -> DataFrame:
    """Absent columns filled by their DEFAULT, their domain's, or NULL. A NULL that was given stays."""
    have = {c.lower() for c in rows.columns}
    for column in table.columns:
        if column.name.lower() in have or column.generated is not None:
            continue
        default = column.default or (schema.domain(column.domain).default if column.domain else None)
        value = F.lit(None) if default is None else over_columns(rows, default)
        rows = rows.withColumn(column.name, value.cast(carrier(column.type)))
    return rows


def with_generated(rows: DataFrame, table: Table) -> DataFrame:
    """All columns in the model's order, generated ones computed and never taken from the input."""
    return rows.select(*((over_columns(rows, c.generated.expression) if c.generated is not None else quoted(c.name)).cast(carrier(c.type)).alias(c.name) for c in table.columns))


# --------------------------------------------------------------------------- referential actions

#: Rounds of cascading after which a schema counts as endless.
MOST_ROUNDS = 64


def _children(schema: Schema, parent: str) -> list[tuple[Table, Constraint]]:
    return [(t, c) for t in schema.tables for c in t.constraints if c.kind == "foreign_key" and c.references is not None and c.references.table == parent]


def _matching(keys: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return keys.toDF(*(f"k{i}" for i in range(len(columns)))).distinct()


def delete_rows(schema: Schema, tables: Mapping[str, DataFrame], name: str, doomed: DataFrame) -> dict[str, DataFrame]:
    """All tables after ``doomed`` rows (of table ``name``, by its primary key) are deleted.

    CASCADE deletes go on to further tables, in rounds; SET NULL and SET DEFAULT
    change the children; NO ACTION and RESTRICT refuse if a child is left.
    """
    out = dict(tables)
    todo = [(name, doomed)]
    for _ in range(MOST_ROUNDS):
        if not todo:
            return out
        following: list[tuple[str, DataFrame]] = []
        for parent_name, gone in todo:
            parent = schema.table(parent_name)
            key = parent.primary_key
            if not key:
                raise SchemaError(f"table {parent_name!r} has no primary key")
            dead = _matching(gone.select(*map(quoted, key)), key)
            out[parent_name] = out[parent_name].join(dead, [quoted(c) == F.col(f"k{i}") for i, c in enumerate(key)], "left_anti")
            for child, c in _children(schema, parent_name):
                referred = c.references.columns or key
                lost = _matching(gone.select(*map(quoted, referred)), referred)
                on = [quoted(x) == F.col(f"k{i}") for i, x in enumerate(c.columns)]
                hit = out[child.name].join(lost, on, "left_semi")
                action = c.references.on_delete or "no_action"
                if action == "cascade":
                    if not hit.isEmpty():
                        following.append((child.name, hit))
                elif action in ("set_null", "set_default"):
                    out[child.name] = _cleared(schema, child, out[child.name], lost, on, c.columns, action)
                else:
                    n = hit.count()
                    if n:
                        raise ConstraintError(child.name, f"FOREIGN KEY ({', '.join(c.columns)})", n)
        todo = following
    raise SchemaError("deletes cascade without end")


def _cleared(schema: Schema, child: Table, frame: DataFrame, lost: DataFrame, on: list[Column], columns: tuple[str, ...], action: str) -> DataFrame:
    marked = frame.join(lost.withColumn("lost", F.lit(True)), on, "left")
    new = []
    for c in frame.columns:
        column = child.column(c)
        value: Column = F.lit(None)
        if action == "set_default" and column is not None:
            default = column.default or (schema.domain(column.domain).default if column.domain else None)
            value = F.lit(None) if default is None else over_columns(frame, default)
        new.append(F.when(F.col("lost"), value).otherwise(quoted(c)).alias(c) if c in columns else quoted(c))
    return marked.select(*new)


def update_keys(schema: Schema, tables: Mapping[str, DataFrame], name: str, moves: DataFrame) -> dict[str, DataFrame]:
    """All tables after keys of ``name`` change: ``moves`` has old_<key> and new_<key> columns.

    A key that other keys refer to may itself be part of a key: CASCADE goes on
    as long as a child's primary key moves with it.
    """
    out = dict(tables)
    todo = [(name, schema.table(name).primary_key, moves)]
    for _ in range(MOST_ROUNDS):
        if not todo:
            return out
        following: list[tuple[str, tuple[str, ...], DataFrame]] = []
        for parent_name, key, changed in todo:
            out[parent_name] = _moved(out[parent_name], key, key, changed)
            for child, c in _children(schema, parent_name):
                referred = c.references.columns or schema.table(parent_name).primary_key
                if set(referred) != set(key):
                    continue
                order = tuple(c.columns[referred.index(k)] for k in key)
                on = [quoted(x) == F.col(f"old_{k}") for x, k in zip(order, key)]
                hit = out[child.name].join(changed, on, "left_semi")
                action = c.references.on_update or "no_action"
                if action == "cascade":
                    if set(order) == set(child.primary_key):
                        next_moves = changed.select(*(quoted(f"{side}_{k}").alias(f"{side}_{x}") for side in ("old", "new") for x, k in zip(order, key)))
                        if not hit.isEmpty():
                            following.append((child.name, order, next_moves))
                    else:
                        out[child.name] = _moved(out[child.name], order, key, changed)
                elif action in ("set_null", "set_default"):
                    lost = changed.select(*(F.col(f"old_{k}").alias(f"k{i}") for i, k in enumerate(key))).distinct()
                    out[child.name] = _cleared(schema, child, out[child.name], lost, [quoted(x) == F.col(f"k{i}") for i, x in enumerate(order)], order, action)
                else:
                    n = hit.count()
                    if n:
                        raise ConstraintError(child.name, f"FOREIGN KEY ({', '.join(c.columns)})", n)
        todo = following
    raise SchemaError("key updates cascade without end")


def _moved(frame: DataFrame, columns: tuple[str, ...], key: tuple[str, ...], changed: DataFrame) -> DataFrame:
    pairs = changed.select(*(quoted(f"{side}_{k}") for side in ("old", "new") for k in key)).withColumn("moves", F.lit(True))
    on = [quoted(x) == F.col(f"old_{k}") for x, k in zip(columns, key)]
    new = dict(zip(columns, key))
    joined = frame.join(pairs, on, "left")
    return joined.select(*((F.when(F.col("moves"), quoted(f"new_{new[c]}")).otherwise(quoted(c)).alias(c) if c in new else quoted(c)) for c in frame.columns))
