"""The canonical, engine-neutral model: schema, queries, contracts, changes.

Plain dataclasses. ``encode`` and ``decode`` turn them into JSON documents and
back; decoding is strict, so an unknown key is an error and not a silent loss.
A field that has its default value is left out, unless it is marked as always
present.
"""

from __future__ import annotations

import json
import types
import typing
from dataclasses import MISSING, dataclass, field, fields, is_dataclass

from plumbline.errors import SchemaError


def always(default: object = MISSING, factory: object = MISSING, key: str | None = None):
    """A field that is written even if it is empty."""
    meta = {"always": True, "key": key}
    if factory is not MISSING:
        return field(default_factory=factory, metadata=meta)
    return field(metadata=meta) if default is MISSING else field(default=default, metadata=meta)


def named(key: str, default: object = None):
    """A field whose JSON key differs from its Python name."""
    return field(default=default, metadata={"key": key})


@dataclass(frozen=True)
class Expression:
    kind: str = always()
    value: str = ""
    args: tuple[Expression, ...] = ()


@dataclass(frozen=True)
class Type:
    family: str = always("")
    arguments: tuple[int, ...] = ()


@dataclass(frozen=True)
class Generated:
    expression: Expression = always()
    stored: bool = always(False)


@dataclass(frozen=True)
class Column:
    name: str = always("")
    type: Type = always(Type())
    nullable: bool = always(False)
    default: Expression | None = None
    domain: str = ""
    generated: Generated | None = None


@dataclass(frozen=True)
class Reference:
    table: str = always("")
    columns: tuple[str, ...] = always(())
    on_update: str = ""
    on_delete: str = ""


@dataclass(frozen=True)
class Constraint:
    kind: str = always("")
    columns: tuple[str, ...] = always(())
    references: Reference | None = None
    expression: Expression | None = None


@dataclass(frozen=True)
class Table:
    name: str = always("")
    columns: tuple[Column, ...] = always(())
    constraints: tuple[Constraint, ...] = ()

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def primary_key(self) -> tuple[str, ...]:
        return next((c.columns for c in self.constraints if c.kind == "primary_key"), ())


@dataclass(frozen=True)
class Domain:
    name: str = always("")
    type: Type = always(Type())
    check: Expression | None = None
    not_null: bool = False
    default: Expression | None = None


@dataclass(frozen=True)
class IndexKey:
    column: str = ""
    descending: bool = False
    expression: Expression | None = None


@dataclass(frozen=True)
class Index:
    name: str = always("")
    table: str = always("")
    unique: bool = False
    columns: tuple[IndexKey, ...] = always(())
    where: Expression | None = None


@dataclass(frozen=True)
class Projection:
    expression: Expression = always()
    alias: str = ""


@dataclass(frozen=True)
class Source:
    table: str = ""
    alias: str = ""
    subquery: Select | None = None


@dataclass(frozen=True)
class Join:
    kind: str = always()
    table: Source = always()
    on: Expression = always(Expression(""))


@dataclass(frozen=True)
class Ordering:
    expression: Expression = always()
    descending: bool = False


@dataclass(frozen=True)
class Compound:
    operator: str = always()
    query: Select = always()


@dataclass(frozen=True)
class CommonTable:
    name: str = always()
    query: Select = always()


@dataclass(frozen=True)
class Select:
    with_: tuple[CommonTable, ...] = named("with", ())
    distinct: bool = False
    columns: tuple[Projection, ...] = always(())
    from_: Source = always(Source(), key="from")
    joins: tuple[Join, ...] = ()
    where: Expression | None = None
    group_by: tuple[Expression, ...] = ()
    having: Expression | None = None
    compounds: tuple[Compound, ...] = ()
    order_by: tuple[Ordering, ...] = ()
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class View:
    name: str = always("")
    query: Select = always(Select())


@dataclass(frozen=True)
class Assignment:
    column: str = always()
    value: Expression = always()


@dataclass(frozen=True)
class Action:
    kind: str = always("")
    table: str = always("")
    assignments: tuple[Assignment, ...] = ()
    where: Expression | None = None


@dataclass(frozen=True)
class Trigger:
    name: str = always("")
    table: str = always("")
    timing: str = always("")
    event: str = always("")
    when: Expression | None = None
    actions: tuple[Action, ...] = always(())


@dataclass(frozen=True)
class Parameter:
    name: str = always("")
    type: Type = always(Type())


@dataclass(frozen=True)
class Routine:
    name: str = always("")
    parameters: tuple[Parameter, ...] = ()
    actions: tuple[Action, ...] = always(())


@dataclass(frozen=True)
class Schema:
    tables: tuple[Table, ...] = always(())
    indexes: tuple[Index, ...] = ()
    domains: tuple[Domain, ...] = ()
    views: tuple[View, ...] = ()
    triggers: tuple[Trigger, ...] = ()
    routines: tuple[Routine, ...] = ()

    def table(self, name: str) -> Table:
        found = next((t for t in self.tables if t.name == name), None)
        if found is None:
            raise SchemaError(f"table {name!r} not found")
        return found

    def domain(self, name: str) -> Domain:
        found = next((d for d in self.domains if d.name == name), None)
        if found is None:
            raise SchemaError(f"domain {name!r} not found")
        return found


@dataclass(frozen=True)
class Version:
    major: int = always(0)
    minor: int = always(0)
    patch: int = always(0)


#: The two engines that contracts name.
ENGINES = ("sqlite", "postgres")


@dataclass(frozen=True)
class Target:
    engine: str = always("")
    version: Version = always(Version())

    def validate(self) -> None:
        if self.engine not in ENGINES:
            raise SchemaError(f"unknown engine {self.engine!r}")
        numbers = (self.version.major, self.version.minor, self.version.patch)
        if min(numbers) < 0 or not any(numbers):
            raise SchemaError(f"engine version {'.'.join(map(str, numbers))} is not a version")


@dataclass(frozen=True)
class Contract:
    source: Target = always(Target())
    destination: Target = always(Target())
    required_features: tuple[str, ...] = always(())

    def validate(self) -> None:
        self.source.validate()
        self.destination.validate()
        if self.source.engine == self.destination.engine:
            raise SchemaError("source and destination engines must differ")


# --------------------------------------------------------------------------- JSON


def _keys(kind: type) -> dict[str, tuple[str, object]]:
    hints = typing.get_type_hints(kind)
    return {(f.metadata.get("key") or f.name): (f.name, hints[f.name]) for f in fields(kind)}


def encode(value: object) -> object:
    """A JSON-ready value."""
    if is_dataclass(value):
        out = {}
        for f in fields(value):
            held = getattr(value, f.name)
            empty = held is None or held == () or held is False or held == ""
            if not empty or f.metadata.get("always"):
                out[f.metadata.get("key") or f.name] = encode(held)
        return out
    if isinstance(value, (tuple, list)):
        return [encode(x) for x in value]
    return value


def decode(kind: object, data: object, where: str = "") -> typing.Any:
    """``data`` as ``kind``; an unknown key or a wrong type is an error."""
    origin = typing.get_origin(kind)
    if origin in (typing.Union, types.UnionType):
        if data is None:
            return None
        return decode(next(a for a in typing.get_args(kind) if a is not type(None)), data, where)
    if origin is tuple:
        if data is None:
            return ()
        if not isinstance(data, list):
            raise SchemaError(f"{where or 'document'}: a list is expected")
        return tuple(decode(typing.get_args(kind)[0], x, f"{where}[{i}]") for i, x in enumerate(data))
    if is_dataclass(kind):
        if not isinstance(data, dict):
            raise SchemaError(f"{where or 'document'}: an object is expected")
        known = _keys(kind)
        for key in data:
            if key not in known:
                raise SchemaError(f"{where or 'document'}: unknown field {key!r}")
        given = {known[key][0]: decode(known[key][1], x, f"{where}.{key}".lstrip(".")) for key, x in data.items()}
        try:
            return kind(**given)
        except TypeError as error:
            raise SchemaError(f"{where or 'document'}: {error}") from error
    if kind is int and (not isinstance(data, int) or isinstance(data, bool)) or kind is str and not isinstance(data, str) or kind is bool and not isinstance(data, bool):
        raise SchemaError(f"{where or 'document'}: {getattr(kind, '__name__', kind)} is expected")
    return data


def dumps(value: object) -> str:
    """Compact JSON in the order of the model's fields."""
    return json.dumps(encode(value), ensure_ascii=False, separators=(",", ":"))


def loads(kind: type, text: str) -> typing.Any:
    try:
        return decode(kind, json.loads(text))
    except json.JSONDecodeError as error:
        raise SchemaError(f"not a JSON document: {error}") from error
