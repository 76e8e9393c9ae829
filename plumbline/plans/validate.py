"""Rules that a schema must keep before anything is run on it."""

from __future__ import annotations

from collections.abc import Iterable

from plumbline.errors import SchemaError
from plumbline.plans.model import Domain, Expression, Index, Schema, Table, Type

#: The type families.
FAMILIES = ("boolean", "integer", "decimal", "float", "text", "binary", "date", "timestamp", "json", "uuid", "vector")
#: Referential actions; empty means none was given.
ACTIONS = ("", "no_action", "restrict", "cascade", "set_null", "set_default")
#: Names that the engine keeps for its own tables.
RESERVED_PREFIX = "__compat_"

CONSTRAINTS = ("primary_key", "unique", "foreign_key", "check")


def contains(expression: Expression | None, kind: str) -> bool:
    """Whether an expression holds a node of this kind at any depth."""
    return expression is not None and (expression.kind == kind or any(contains(a, kind) for a in expression.args))


def _unique(kind: str, names: Iterable[str], where: str = "") -> None:
    seen: set[str] = set()
    for name in names:
        if not name:
            raise SchemaError(f"{where}{kind} without a name")
        if name in seen:
            raise SchemaError(f"{where}duplicate {kind} {name!r}")
        seen.add(name)


def _type(kind: Type, where: str) -> None:
    if not kind.family:
        raise SchemaError(f"{where} has no type")
    if kind.family not in FAMILIES:
        raise SchemaError(f"{where} has the unknown type family {kind.family!r}")
    if len(kind.arguments) > 2:
        raise SchemaError(f"{where}: a type has at most two arguments")
    if kind.family == "vector" and (len(kind.arguments) != 1 or kind.arguments[0] <= 0):
        raise SchemaError(f"{where}: a vector has one positive dimension")


def _domain(domain: Domain) -> None:
    where = f"domain {domain.name!r}"
    _type(domain.type, where)
    if contains(domain.check, "gen_random_uuid"):
        raise SchemaError(f"{where}: CHECK must be deterministic")


def _table(table: Table, domains: dict[str, Domain]) -> None:
    where = f"table {table.name!r}"
    if table.name.startswith(RESERVED_PREFIX):
        raise SchemaError(f"{where} has a reserved name")
    _unique("column", (c.name for c in table.columns), f"{where}: ")
    for column in table.columns:
        at = f"{where}, column {column.name!r}"
        _type(column.type, at)
        if column.domain:
            domain = domains.get(column.domain)
            if domain is None:
                raise SchemaError(f"{at}: unknown domain {column.domain!r}")
            if column.type != domain.type:
                raise SchemaError(f"{at}: its type isn't that of domain {column.domain!r}")
            if not column.nullable or column.default is not None or column.generated is not None:
                raise SchemaError(f"{at}: a column of a domain is nullable, without default and not generated")
        if column.generated is not None:
            if not column.generated.stored:
                raise SchemaError(f"{at}: only STORED generated columns are supported")
            if column.default is not None:
                raise SchemaError(f"{at}: a generated column has no default")
    for constraint in table.constraints:
        if constraint.kind not in CONSTRAINTS:
            raise SchemaError(f"{where}: unknown constraint kind {constraint.kind!r}")
        if constraint.kind == "primary_key":
            for name in constraint.columns:
                column = table.column(name)
                if column is not None and column.generated is not None:
                    raise SchemaError(f"{where}: the generated column {name!r} can't be in the primary key")
        if constraint.kind == "check" and contains(constraint.expression, "gen_random_uuid"):
            raise SchemaError(f"{where}: CHECK must be deterministic")
        if constraint.kind == "foreign_key" and constraint.references is not None:
            for action in (constraint.references.on_update, constraint.references.on_delete):
                if action not in ACTIONS:
                    raise SchemaError(f"{where}: unknown referential action {action!r}")


def _index(index: Index, tables: dict[str, Table]) -> None:
    where = f"index {index.name!r}"
    table = tables.get(index.table)
    if table is None:
        raise SchemaError(f"{where}: unknown table {index.table!r}")
    if not index.columns:
        raise SchemaError(f"{where} has no keys")
    for key in index.columns:
        if (key.expression is not None) == bool(key.column):
            raise SchemaError(f"{where}: a key is a column or an expression")
        if key.column and table.column(key.column) is None:
            raise SchemaError(f"{where}: unknown column {key.column!r}")


def validate(schema: Schema) -> Schema:
    """The schema itself, or a SchemaError that says what is wrong."""
    _unique("domain", (d.name for d in schema.domains))
    domains = {d.name: d for d in schema.domains}
    for domain in schema.domains:
        _domain(domain)
    _unique("table", (t.name for t in schema.tables))
    for table in schema.tables:
        _table(table, domains)
    tables = {t.name: t for t in schema.tables}
    _unique("index", (i.name for i in schema.indexes))
    for index in schema.indexes:
        _index(index, tables)
    _unique("view", (v.name for v in schema.views))
    for view in schema.views:
        if view.name in tables:
            raise SchemaError(f"view {view.name!r} has the name of a table")
        if not view.query.columns:
            raise SchemaError(f"view {view.name!r} has no columns")
        if not view.query.from_.table and view.query.from_.subquery is None:
            raise SchemaError(f"view {view.name!r} has no source")
    _unique("trigger", (t.name for t in schema.triggers))
    for trigger in schema.triggers:
        where = f"trigger {trigger.name!r}"
        if not trigger.table:
            raise SchemaError(f"{where} has no table")
        if trigger.timing not in ("before", "after"):
            raise SchemaError(f"{where}: unknown timing {trigger.timing!r}")
        if trigger.event not in ("insert", "update", "delete"):
            raise SchemaError(f"{where}: unknown event {trigger.event!r}")
        if not trigger.actions:
            raise SchemaError(f"{where} has no actions")
    _unique("routine", (r.name for r in schema.routines))
    for routine in schema.routines:
        where = f"routine {routine.name!r}"
        if not routine.actions:
            raise SchemaError(f"{where} has no actions")
        _unique("parameter", (p.name for p in routine.parameters), f"{where}: ")
        for parameter in routine.parameters:
            if not parameter.type.family:
                raise SchemaError(f"{where}: parameter {parameter.name!r} has no type")
    return schema
