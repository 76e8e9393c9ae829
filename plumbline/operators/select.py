"""Canonical queries as DataFrames.

Each source's columns get names of their own, so that self-joins and equal
column names need no care later; the last projection gives them the query's
names. Catalyst sees one declarative plan: filters and columns are pushed down
to the scans, ORDER BY with LIMIT becomes a top-k, and joins are planned by
size at run time.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.errors import SchemaError
from plumbline.functions.scalar import Compiler, aggregates, quoted, resolve
from plumbline.plans.model import Expression, Ordering, Schema, Select, Source, View
from plumbline.plans.parser import parse_query, refers

STEPS = {"inner": "inner", "left": "left", "cross": "cross"}


class Scope:
    """Names of the sources of one SELECT: alias -> column -> the frame's column."""

    def __init__(self) -> None:
        self.sources: dict[str, dict[str, str]] = {}

    def add(self, alias: str, columns: dict[str, str]) -> None:
        if alias.lower() in self.sources:
            raise SchemaError(f"two sources are called {alias!r}")
        self.sources[alias.lower()] = columns

    def find(self, name: str) -> str:
        alias, dot, column = name.rpartition(".")
        if dot:
            if alias.lower() not in self.sources:
                raise SchemaError(f"unknown source {alias!r}")
            found = [self.sources[alias.lower()].get(column.lower())]
        else:
            found = [c[column.lower()] for c in self.sources.values() if column.lower() in c]
        if not found or found[0] is None:
            raise SchemaError(f"unknown column {name!r}")
        if len(found) > 1:
            raise SchemaError(f"ambiguous column {name!r}")
        return found[0]


class Queries:
    """Runs queries over named tables and views."""

    def __init__(self, tables: Mapping[str, DataFrame], views: Mapping[str, Select] | tuple[View, ...] = ()) -> None:
        self.tables = {k.lower(): v for k, v in tables.items()}
        named = views.items() if isinstance(views, Mapping) else ((v.name, v.query) for v in views)
        self.views = {k.lower(): v for k, v in named}
        self._numbers = count()

    @classmethod
    def of(cls, schema: Schema, tables: Mapping[str, DataFrame]) -> Queries:
        return cls(tables, schema.views)

    def sql(self, text: str) -> DataFrame:
        """Run text of the canonical grammar."""
        return self.run(parse_query(text))

    def view(self, name: str) -> DataFrame:
        return self._named(name, {}, ())

    def run(self, query: Select, scope: Mapping[str, DataFrame] | None = None, inside: tuple[str, ...] = ()) -> DataFrame:
        commons = dict(scope or {})
        for common in query.with_:
            if refers(common.query, common.name):
                raise SchemaError(f"the common table {common.name!r} refers to itself")
            commons[common.name.lower()] = self.run(common.query, commons, inside)
        if not query.compounds:
            return self._select(query, commons, inside)
        kinds = {c.operator for c in query.compounds}
        if "intersect" in kinds and len(kinds) > 1:
            raise SchemaError("INTERSECT can't be mixed with other set operators")
        out = self._select(replace(query, compounds=(), order_by=(), limit=None, offset=None), commons, inside)
        for compound in query.compounds:
            if compound.query.order_by or compound.query.limit is not None or compound.query.offset is not None:
                raise SchemaError("ORDER BY, LIMIT and OFFSET belong after the last branch")
            out = self._set(compound.operator, out, self._select(compound.query, commons, inside))
        return _cut(self._ordered(out, query.order_by), query)

    @staticmethod
    def _set(operator: str, left: DataFrame, right: DataFrame) -> DataFrame:
        if len(left.columns) != len(right.columns):
            raise SchemaError("the branches of a set operation differ in their number of columns")
        if operator == "union_all":
            return left.union(right)
        if operator == "union":
            return left.union(right).distinct()
        if operator == "intersect":
            return left.intersect(right)
        if operator == "except":
            return left.subtract(right)
        raise SchemaError(f"unknown set operator {operator!r}")

    @staticmethod
    def _ordered(frame: DataFrame, order_by: tuple[Ordering, ...]) -> DataFrame:
        """Order a compound by names or numbers of its columns."""
        if not order_by:
            return frame
        keys = []
        for o in order_by:
            position = _ordinal(o.expression, len(frame.columns))
            if position is None:
                names = [c.lower() for c in frame.columns]
                if o.expression.kind != "column" or o.expression.value.lower() not in names:
                    raise SchemaError("a set operation is ordered by its own columns")
                position = names.index(o.expression.value.lower())
            key = quoted(frame.columns[position])
            keys.append(key.desc() if o.descending else key.asc())
        return frame.orderBy(*keys)

    # -- sources

    def _named(self, name: str, commons: Mapping[str, DataFrame], inside: tuple[str, ...]) -> DataFrame:
        key = name.lower()
        if key in commons:
            return commons[key]
        if key in self.tables:
            return self.tables[key]
        if key in self.views:
            if key in inside:
                raise SchemaError(f"view {name!r} depends on itself")
            return self.run(self.views[key], {}, (*inside, key))
        raise SchemaError(f"unknown table {name!r}")

    def _source(self, source: Source, scope: Scope, commons: Mapping[str, DataFrame], inside: tuple[str, ...]) -> DataFrame:
        if (source.subquery is None) == (not source.table):
            raise SchemaError("a source is a table or a derived table")
        if source.subquery is not None:
            if not source.alias:
                raise SchemaError("a derived table needs an alias")
            frame = self.run(source.subquery, commons, inside)
        else:
            frame = self._named(source.table, commons, inside)
        number = next(self._numbers)
        columns: dict[str, str] = {}
        for i, c in enumerate(frame.columns):
            if c.lower() in columns:
                raise SchemaError(f"source {source.alias or source.table!r} has two columns {c!r}")
            columns[c.lower()] = f"s{number}_{i}"
        scope.add(source.alias or source.table, columns)
        return frame.toDF(*columns.values())

    # -- one SELECT

    def _select(self, query: Select, commons: Mapping[str, DataFrame], inside: tuple[str, ...]) -> DataFrame:
        if not query.columns:
            raise SchemaError("a query needs columns")
        scope = Scope()
        frame = self._source(query.from_, scope, commons, inside)
        for join in query.joins:
            other = self._source(join.table, scope, commons, inside)
            if join.kind == "cross":
                frame = frame.crossJoin(other)
            elif join.kind in STEPS:
                on = Compiler(frame.crossJoin(other))(resolve(join.on, scope.find))
                frame = frame.join(other, on, STEPS[join.kind])
            else:
                raise SchemaError(f"unsupported join {join.kind!r}")
        if query.where is not None:
            where = resolve(query.where, scope.find)
            if aggregates(where):
                raise SchemaError("WHERE can't hold an aggregate")
            frame = frame.where(Compiler(frame)(where))

        outputs = [resolve(p.expression, scope.find) for p in query.columns]
        names = [p.alias or (p.expression.value.rpartition(".")[2] if p.expression.kind == "column" else f"column{i + 1}") for i, p in enumerate(query.columns)]
        orders = [self._order_key(o, query, names, outputs, scope) for o in query.order_by]
        having = resolve(query.having, scope.find) if query.having is not None else None
        groups = [resolve(self._group_key(g, query), scope.find) for g in query.group_by]

        calls = [x for e in (*outputs, *(o for o in orders if isinstance(o, Expression)), *([having] if having is not None else [])) for x in aggregates(e)]
        compiler = Compiler(frame)
        if groups or calls or having is not None:
            if any(aggregates(g) for g in groups):
                raise SchemaError("GROUP BY can't hold an aggregate")
            known = {g: f"g{i}" for i, g in enumerate(dict.fromkeys(groups))}
            sums = {c: f"a{i}" for i, c in enumerate(dict.fromkeys(calls))}
            aggregated = [compiler(c).alias(n) for c, n in sums.items()] or [F.count(F.lit(1)).alias("a0")]
            keyed = [compiler(g).alias(n) for g, n in known.items()]
            frame = frame.groupBy(*keyed).agg(*aggregated)
            compiler = Compiler(frame, known | sums | {Expression("grouped"): "a"})
            if having is not None:
                frame = frame.where(compiler(having))
        projected = [compiler(e).alias(f"o{i}") for i, e in enumerate(outputs)]
        hidden = {i: f"h{i}" for i, o in enumerate(orders) if isinstance(o, Expression)}
        if query.distinct and hidden:
            raise SchemaError("with DISTINCT, ORDER BY can only use the query's columns")
        out = frame.select(*projected, *(compiler(orders[i]).alias(n) for i, n in hidden.items()))
        if query.distinct:
            out = out.distinct()
        if orders:
            keys = [F.col(hidden[i]) if i in hidden else F.col(f"o{o}") for i, o in enumerate(orders)]
            out = out.orderBy(*(k.desc() if o.descending else k.asc() for k, o in zip(keys, query.order_by)))
        return _cut(out, query).select(*(F.col(f"o{i}").alias(n) for i, n in enumerate(names)))

    @staticmethod
    def _order_key(order: Ordering, query: Select, names: list[str], outputs: list[Expression], scope: Scope) -> Expression | int:
        """The position of an output, or an expression over the sources."""
        position = _ordinal(order.expression, len(outputs))
        if position is not None:
            return position
        if order.expression.kind == "column":
            same = [i for i, p in enumerate(query.columns) if p.alias and p.alias.lower() == order.expression.value.lower()]
            if same:
                return same[0]
        wanted = resolve(order.expression, scope.find)
        return outputs.index(wanted) if wanted in outputs else wanted

    @staticmethod
    def _group_key(group: Expression, query: Select) -> Expression:
        position = _ordinal(group, len(query.columns))
        return group if position is None else query.columns[position].expression


def _ordinal(e: Expression, n: int) -> int | None:
    if e.kind != "integer":
        return None
    if not 1 <= int(e.value) <= n:
        raise SchemaError(f"there is no column {e.value}")
    return int(e.value) - 1


def _cut(frame: DataFrame, query: Select) -> DataFrame:
    if query.offset is not None:
        frame = frame.offset(query.offset)
    return frame if query.limit is None else frame.limit(query.limit)
