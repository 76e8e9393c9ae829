"""Canonical expressions as Spark columns.

Names are resolved before compilation: a ``column`` node becomes a ``resolved``
node that names exactly one column of a DataFrame. Only built-in functions are
used, so everything stays inside Catalyst and whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.errors import SchemaError
from plumbline.plans.model import Expression
from plumbline.plans.parser import AGGREGATES

BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
}
UNARY: dict[str, Callable[[Column], Column]] = {
    "not": lambda a: ~a,
    "is_null": lambda a: a.isNull(),
    "is_not_null": lambda a: a.isNotNull(),
    "lower": F.lower,
    "upper": F.upper,
    "length": F.length,
    "abs": F.abs,
    "trim": F.trim,
    "count": F.count,
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
}


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def resolve(expression: Expression, names: Callable[[str], str]) -> Expression:
    """The expression with every column bound to a DataFrame's column."""
    if expression.kind == "column":
        return Expression("resolved", names(expression.value))
    return Expression(expression.kind, expression.value, tuple(resolve(a, names) for a in expression.args))


def literal(expression: Expression) -> Column:
    kind, text = expression.kind, expression.value
    if kind == "null":
        return F.lit(None)
    if kind == "boolean":
        return F.lit(text == "true")
    if kind == "string":
        return F.lit(text)
    if kind == "integer":
        n = int(text)
        return F.lit(n).cast("bigint") if -(1 << 63) <= n < 1 << 63 else F.lit(Decimal(text))
    if "e" in text.lower():
        return F.lit(float(text))
    return F.lit(Decimal(text))


class Compiler:
    """Compiles against one DataFrame; ``known`` maps subexpressions to columns it already has."""

    def __init__(self, frame: DataFrame, known: Mapping[Expression, str] | None = None, parameters: Mapping[str, Column] | None = None) -> None:
        self.frame = frame
        self.known = known or {}
        self.parameters = parameters or {}

    def type_of(self, column: Column) -> T.DataType:
        return self.frame.select(column).schema[0].dataType

    def __call__(self, e: Expression) -> Column:
        if e in self.known:
            return quoted(self.known[e])
        kind = e.kind
        if kind == "resolved":
            if self.known:
                raise SchemaError(f"column {e.value!r} is neither grouped nor aggregated")
            return quoted(e.value)
        if kind in ("null", "boolean", "string", "integer", "decimal"):
            return literal(e)
        if kind == "parameter":
            if e.value not in self.parameters:
                raise SchemaError(f"parameter {e.value!r} not supplied")
            return self.parameters[e.value]
        if kind == "current_timestamp":
            return F.current_timestamp()
        if kind == "gen_random_uuid":
            return F.expr("uuid()")
        if kind == "count" and e.args and e.args[0].kind == "star":
            return F.count(F.lit(1))
        args = [self(a) for a in e.args]
        if kind in BINARY and len(args) == 2:
            return BINARY[kind](*args)
        if kind in UNARY and len(args) == 1:
            return UNARY[kind](*args)
        return self._special(kind, args, e)

    def _special(self, kind: str, args: list[Column], e: Expression) -> Column:
        n = len(args)
        if kind == "like" and n == 2:
            # The grammar has no ESCAPE: a backslash stands for itself.
            return F.ilike(args[0], F.replace(args[1], F.lit("\\"), F.lit("\\\\")))
        if kind == "div" and n == 2:
            integral = all(isinstance(self.type_of(a), T.IntegralType) for a in args)
            return F.call_function("div", *args) if integral else args[0] / args[1]
        if kind == "concat" and n == 2:
            return F.concat(*(a.cast("string") for a in args))
        if kind in ("between", "not_between") and n == 3:
            inside = args[0].between(args[1], args[2])
            return inside if kind == "between" else ~inside
        if kind in ("in", "not_in") and n >= 2:
            inside = args[0].isin(*args[1:])
            return inside if kind == "in" else ~inside
        if kind == "case" and n >= 2:
            whole = F.when(args[0], args[1])
            for i in range(2, n - n % 2, 2):
                whole = whole.when(args[i], args[i + 1])
            return whole.otherwise(args[-1]) if n % 2 else whole
        if kind == "coalesce" and n:
            return F.coalesce(*args)
        if kind == "nullif" and n == 2:
            return F.nullif(*args)
        if kind == "replace" and n == 3:
            return F.replace(*args)
        raise SchemaError(f"unsupported expression {kind!r} with {n} argument(s)")


def aggregates(e: Expression) -> list[Expression]:
    """Outermost aggregate calls, in order; one inside another is an error."""
    if e.kind in AGGREGATES:
        if any(aggregates(a) for a in e.args):
            raise SchemaError("an aggregate can't hold an aggregate")
        return [e]
    return [x for a in e.args for x in aggregates(a)]


def over_columns(frame: DataFrame, expression: Expression, parameters: Mapping[str, Column] | None = None, known: Mapping[Expression, str] | None = None) -> Column:
    """An expression over a DataFrame's own columns (no qualified names)."""
    names = {c.lower(): c for c in frame.columns}

    def find(name: str) -> str:
        got = names.get(name.lower())
        if got is None:
            raise SchemaError(f"unknown column {name!r}")
        return got

    return Compiler(frame, known, parameters)(resolve(expression, find))
