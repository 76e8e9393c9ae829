"""Text of expressions and queries to the canonical model. Nothing is guessed:
what the grammar doesn't hold is refused, even where Spark could run it."""

from __future__ import annotations

from collections.abc import Callable

from plumbline.errors import GrammarError
from plumbline.plans.lexer import Token, tokens, unquoted
from plumbline.plans.model import CommonTable, Compound, Expression, Join, Ordering, Projection, Select, Source

AGGREGATES = ("count", "sum", "avg", "min", "max")
#: name -> (least, most) arguments; None: any number.
FUNCTIONS: dict[str, tuple[int, int | None]] = {
    "count": (1, 1), "sum": (1, 1), "avg": (1, 1), "min": (1, 1), "max": (1, 1), "lower": (1, 1), "upper": (1, 1),
    "length": (1, 1), "abs": (1, 1), "trim": (1, 1), "coalesce": (1, None), "nullif": (2, 2), "replace": (3, 3), "gen_random_uuid": (0, 0),
}

COMPARISONS = {"=": "eq", "<>": "ne", "!=": "ne", "<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}
#: Words that end an expression or a source, and are no names unless quoted.
RESERVED = frozenset(
    "SELECT DISTINCT FROM WHERE GROUP HAVING ORDER BY LIMIT OFFSET UNION INTERSECT EXCEPT ALL JOIN INNER LEFT RIGHT FULL OUTER CROSS NATURAL USING ON AS AND OR NOT IS IN BETWEEN LIKE CASE WHEN THEN ELSE END NULL TRUE FALSE WITH RECURSIVE LATERAL CURRENT_TIMESTAMP EXISTS CAST COLLATE OVER FILTER".split()
)
#: Type names after :: that a default or a generated column may end with.
CASTS = frozenset(
    ["text", "character varying", "varchar", "character", "bpchar", "integer", "bigint", "smallint", "numeric", "double precision", "real", "boolean", "date", "timestamp with time zone", "timestamp without time zone", "timestamptz", "timestamp", "json", "jsonb", "uuid", "bytea"]
)


class Parser:
    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens = tokens(text)
        self.at = 0

    # -- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def word(self, *words: str) -> bool:
        """Take these words if they come next."""
        if all(self.ahead(i).upper == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def sign(self, text: str) -> bool:
        if self.now.kind == "sign" and self.now.text == text:
            self.at += 1
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.word(*words):
            self.fail(f"{' '.join(words)} is expected")

    def need_sign(self, text: str) -> None:
        if not self.sign(text):
            self.fail(f"{text!r} is expected")

    def fail(self, why: str) -> None:
        raise GrammarError(f"{why} at {self.text[self.now.start : self.now.start + 30]!r}")

    def name(self) -> str:
        token = self.now
        if token.kind == "quoted":
            self.at += 1
            return unquoted(token.text)
        if token.kind == "word" and token.upper not in RESERVED:
            self.at += 1
            return token.text
        self.fail("a name is expected")
        raise AssertionError

    def end(self) -> None:
        if self.now.kind != "end":
            self.fail("unexpected text")

    # -- expressions, loosest first

    def expression(self) -> Expression:
        return self._left(self._and, lambda: "or" if self.word("OR") else None)

    def _and(self) -> Expression:
        return self._left(self._not, lambda: "and" if self.word("AND") else None)

    def _not(self) -> Expression:
        if self.word("NOT"):
            return Expression("not", args=(self._not(),))
        left = self._comparison()
        while self.word("IS"):
            kind = "is_not_null" if self.word("NOT") else "is_null"
            self.need("NULL")
            left = Expression(kind, args=(left,))
        return left

    def _comparison(self) -> Expression:
        left = self._concat()
        while True:
            if self.now.kind == "sign" and self.now.text in COMPARISONS:
                kind = COMPARISONS[self.now.text]
                self.at += 1
                left = Expression(kind, args=(left, self._concat()))
                continue
            negated = self.now.upper == "NOT" and self.ahead().upper in ("LIKE", "BETWEEN", "IN")
            if negated:
                self.at += 1
            if self.word("LIKE"):
                like = Expression("like", args=(left, self._concat()))
                left = Expression("not", args=(like,)) if negated else like
            elif self.word("BETWEEN"):
                low = self._concat()
                self.need("AND")
                left = Expression("not_between" if negated else "between", args=(left, low, self._concat()))
            elif self.word("IN"):
                self.need_sign("(")
                left = Expression("not_in" if negated else "in", args=(left, *self._list()))
            else:
                return left

    def _concat(self) -> Expression:
        return self._left(self._sum, lambda: "concat" if self.sign("||") else None)

    def _sum(self) -> Expression:
        return self._left(self._product, lambda: "add" if self.sign("+") else "sub" if self.sign("-") else None)

    def _product(self) -> Expression:
        return self._left(self._primary, lambda: "mul" if self.sign("*") else "div" if self.sign("/") else None)

    def _left(self, part: Callable[[], Expression], operator: Callable[[], str | None]) -> Expression:
        left = part()
        while (kind := operator()) is not None:
            left = Expression(kind, args=(left, part()))
        return left

    def _list(self) -> tuple[Expression, ...]:
        """Expressions up to the closing parenthesis, at least one."""
        items = [self.expression()]
        while self.sign(","):
            items.append(self.expression())
        self.need_sign(")")
        return tuple(items)

    def _primary(self) -> Expression:
        token = self.now
        if token.kind == "sign" and token.text in "+-" and self.ahead().kind in ("number", "hex"):
            self.at += 1
            if self.now.kind == "hex":
                self.fail("a hexadecimal integer has no sign")
            return self._number("" if token.text == "+" else "-")
        if token.kind == "number":
            return self._number("")
        if token.kind == "hex":
            self.at += 1
            bits = int(token.text, 16)
            if bits >= 1 << 64:
                raise GrammarError(f"the hexadecimal integer {token.text} has more than 64 bits")
            return Expression("integer", str(bits - (1 << 64) if bits >= 1 << 63 else bits))
        if token.kind == "string":
            self.at += 1
            return Expression("string", token.text[1:-1].replace("''", "'"))
        if self.sign("("):
            inner = self.expression()
            self.need_sign(")")
            return inner
        if self.word("NULL"):
            return Expression("null")
        if token.upper in ("TRUE", "FALSE"):
            self.at += 1
            return Expression("boolean", token.text.lower())
        if self.word("CURRENT_TIMESTAMP"):
            return Expression("current_timestamp")
        if self.word("CASE"):
            return self._case()
        if token.kind == "word" and self.ahead().kind == "sign" and self.ahead().text == "(":
            return self._call()
        parts = [self.name()]
        while self.sign("."):
            parts.append(self.name())
        if len(parts) > 2:
            self.fail("a name has at most two parts")
        return Expression("column", ".".join(parts))

    def _number(self, sign: str) -> Expression:
        text = self.now.text
        self.at += 1
        return Expression("integer" if text.isdigit() else "decimal", sign + text)

    def _call(self) -> Expression:
        name = self.now.text.lower()
        if name not in FUNCTIONS or not name.isascii():
            self.fail(f"unsupported function {name!r}")
        self.at += 2
        if name == "count" and self.sign("*"):
            args: tuple[Expression, ...] = (Expression("star"),)
            self.need_sign(")")
        elif self.sign(")"):
            args = ()
        else:
            args = self._list()
        least, most = FUNCTIONS[name]
        if len(args) < least or most is not None and len(args) > most:
            raise GrammarError(f"{name} can't have {len(args)} argument(s)")
        return Expression(name, args=args)

    def _case(self) -> Expression:
        args: list[Expression] = []
        if self.now.upper != "WHEN":
            self.fail("only the searched CASE is supported")
        while self.word("WHEN"):
            args.append(self.expression())
            self.need("THEN")
            args.append(self.expression())
        if self.word("ELSE"):
            args.append(self.expression())
        self.need("END")
        return Expression("case", args=tuple(args))

    # -- queries

    def query(self) -> Select:
        commons: list[CommonTable] = []
        if self.word("WITH"):
            if self.now.upper == "RECURSIVE":
                self.fail("WITH RECURSIVE is not supported")
            while True:
                name = self.name()
                if any(_same(name, c.name) for c in commons):
                    self.fail(f"the common table {name!r} is defined twice")
                self.need("AS")
                self.need_sign("(")
                inner = self.query()
                self.need_sign(")")
                if refers(inner, name):
                    self.fail(f"the common table {name!r} refers to itself")
                commons.append(CommonTable(name, inner))
                if not self.sign(","):
                    break
        first = self._select()
        compounds: list[Compound] = []
        while (operator := self._set_operator()) is not None:
            before = compounds[-1].query if compounds else first
            if before.order_by or before.limit is not None or before.offset is not None:
                self.fail("ORDER BY, LIMIT and OFFSET belong after the last branch")
            compounds.append(Compound(operator, self._select()))
        kinds = {c.operator for c in compounds}
        if "intersect" in kinds and len(kinds) > 1:
            self.fail("INTERSECT can't be mixed with other set operators")
        if not compounds:
            return _with(first, with_=tuple(commons))
        last = compounds[-1].query
        compounds[-1] = Compound(compounds[-1].operator, _with(last, order_by=(), limit=None, offset=None))
        return _with(first, with_=tuple(commons), compounds=tuple(compounds), order_by=last.order_by, limit=last.limit, offset=last.offset)

    def _set_operator(self) -> str | None:
        if self.word("UNION"):
            return "union_all" if self.word("ALL") else "union"
        for word in ("INTERSECT", "EXCEPT"):
            if self.word(word):
                if self.now.upper == "ALL":
                    self.fail(f"{word} ALL is not supported")
                return word.lower()
        return None

    def _select(self) -> Select:
        self.need("SELECT")
        distinct = self.word("DISTINCT")
        columns = [self._projection()]
        while self.sign(","):
            columns.append(self._projection())
        self.need("FROM")
        source, joins = self._from()
        where = self.expression() if self.word("WHERE") else None
        group_by: list[Expression] = []
        if self.word("GROUP", "BY"):
            group_by.append(self.expression())
            while self.sign(","):
                group_by.append(self.expression())
        having = self.expression() if self.word("HAVING") else None
        order_by: list[Ordering] = []
        if self.word("ORDER", "BY"):
            order_by.append(self._ordering())
            while self.sign(","):
                order_by.append(self._ordering())
        limit = self._count() if self.word("LIMIT") else None
        offset = self._count() if self.word("OFFSET") else None
        return Select((), distinct, tuple(columns), source, joins, where, tuple(group_by), having, (), tuple(order_by), limit, offset)

    def _projection(self) -> Projection:
        expression = self.expression()
        return Projection(expression, self.name() if self.word("AS") else "")

    def _ordering(self) -> Ordering:
        expression = self.expression()
        descending = self.word("DESC")
        if not descending:
            self.word("ASC")
        if self.now.upper == "NULLS":
            self.fail("NULLS FIRST and NULLS LAST are not supported")
        return Ordering(expression, descending)

    def _count(self) -> int:
        if self.now.kind != "number" or not self.now.text.isdigit():
            self.fail("a non-negative integer is expected")
        self.at += 1
        return int(self.tokens[self.at - 1].text)

    def _from(self) -> tuple[Source, tuple[Join, ...]]:
        # Parentheses around the whole list, but not a derived table.
        if self.now.text == "(" and self.ahead().upper not in ("SELECT", "WITH") and self.now.kind == "sign":
            self.at += 1
            out = self._from()
            self.need_sign(")")
            return out
        source, joins = self._source(), []
        while True:
            if self.word("CROSS", "JOIN"):
                joins.append(Join("cross", self._source()))
                continue
            if self.word("JOIN") or self.word("INNER", "JOIN"):
                kind = "inner"
            elif self.word("LEFT", "OUTER", "JOIN") or self.word("LEFT", "JOIN"):
                kind = "left"
            else:
                return source, tuple(joins)
            other = self._source()
            self.need("ON")
            joins.append(Join(kind, other, self.expression()))

    def _source(self) -> Source:
        if self.sign("("):
            inner = self.query()
            self.need_sign(")")
            self.word("AS")
            if self.now.kind not in ("word", "quoted"):
                self.fail("a derived table needs an alias")
            return Source("", self.name(), inner)
        table = self.name()
        if self.now.text == "." and self.now.kind == "sign":
            self.fail("tables can't be qualified by a schema")
        if self.word("AS"):
            return Source(table, self.name())
        if self.now.kind == "quoted" or self.now.kind == "word" and self.now.upper not in RESERVED:
            return Source(table, self.name())
        return Source(table)


def _with(query: Select, **changes: object) -> Select:
    from dataclasses import replace

    return replace(query, **changes)


def _same(a: str, b: str) -> bool:
    """Equal but for the case of ASCII letters."""
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    return a.translate(fold) == b.translate(fold)


def refers(query: Select, name: str) -> bool:
    """Whether a query reads a table of this name, except where a common table hides it."""
    hidden = False
    for common in query.with_:
        if not hidden and refers(common.query, name):
            return True
        hidden = hidden or _same(common.name, name)
    if hidden:
        return False
    sources = [query.from_, *(j.table for j in query.joins)]
    if any(refers(s.subquery, name) if s.subquery is not None else _same(s.table, name) for s in sources):
        return True
    return any(refers(c.query, name) for c in query.compounds)


def parse_expression(text: str) -> Expression:
    parser = Parser(text)
    out = parser.expression()
    parser.end()
    return out


def parse_query(text: str) -> Select:
    """A query, also behind CREATE VIEW name AS, with at most one semicolon at the end."""
    parser = Parser(text)
    if parser.word("CREATE", "VIEW"):
        parser.name()
        parser.need("AS")
    out = parser.query()
    parser.sign(";")
    parser.end()
    return out


def parse_default(text: str) -> Expression:
    """An expression that may end with a cast to a known type, which is dropped."""
    found = tokens(text)
    casts = [i for i, t in enumerate(found) if t.kind == "cast"]
    if casts:
        at = casts[-1]
        name = " ".join(t.text.lower() for t in found[at + 1 : -1] if t.kind == "word")
        rest = [t for t in found[at + 1 : -1] if t.kind != "word"]
        if name not in CASTS or rest:
            raise GrammarError(f"unsupported cast in {text!r}")
        return parse_default(text[: found[at].start])
    return parse_expression(text)
