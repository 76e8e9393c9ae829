import pytest

from plumbline.errors import GrammarError
from plumbline.plans.model import Expression as E
from plumbline.plans.model import Select, decode, dumps, encode, loads
from plumbline.plans.parser import parse_default, parse_expression, parse_query


def col(name):
    return E("column", name)


def n(value):
    return E("integer", str(value))


@pytest.mark.parametrize(
    "text,tree",
    [
        ("a", col("a")),
        ('t."A b"', col("t.A b")),
        ("NULL", E("null")),
        ("TrUe", E("boolean", "true")),
        ("-3", n(-3)),
        ("+3", n(3)),
        ("1.5", E("decimal", "1.5")),
        (".5e3", E("decimal", ".5e3")),
        ("1.", E("decimal", "1.")),
        ("1e-5", E("decimal", "1e-5")),
        ("0xFF", n(255)),
        ("0xFFFFFFFFFFFFFFFF", n(-1)),
        ("'it''s'", E("string", "it's")),
        ("CURRENT_TIMESTAMP", E("current_timestamp")),
        ("a AND b OR c", E("or", args=(E("and", args=(col("a"), col("b"))), col("c")))),
        ("NOT a = 1", E("not", args=(E("eq", args=(col("a"), n(1))),))),
        ("NOT(a)", E("not", args=(col("a"),))),
        ("a - b - c", E("sub", args=(E("sub", args=(col("a"), col("b"))), col("c")))),
        ("a + b * c", E("add", args=(col("a"), E("mul", args=(col("b"), col("c")))))),
        ("a || b = c", E("eq", args=(E("concat", args=(col("a"), col("b"))), col("c")))),
        ("a IS  NOT\nNULL", E("is_not_null", args=(col("a"),))),
        ("a NOT LIKE 'x'", E("not", args=(E("like", args=(col("a"), E("string", "x"))),))),
        ("a BETWEEN 1 AND 2 AND b", E("and", args=(E("between", args=(col("a"), n(1), n(2))), col("b")))),
        ("a NOT IN (1, NULL)", E("not_in", args=(col("a"), n(1), E("null")))),
        ("CASE WHEN a THEN 1 ELSE 2 END", E("case", args=(col("a"), n(1), n(2)))),
        ("count(*)", E("count", args=(E("star"),))),
        ("Coalesce(a, 'x')", E("coalesce", args=(col("a"), E("string", "x")))),
        ("gen_random_uuid()", E("gen_random_uuid")),
        ("((a))", col("a")),
        ("a - -5", E("sub", args=(col("a"), n(-5)))),
    ],
)
def test_expressions(text, tree):
    assert parse_expression(text) == tree


@pytest.mark.parametrize(
    "text",
    [
        "", "*", "-a", "a % 2", "CASE a WHEN 1 THEN 2 END", "CASE WHEN a THEN 1", "CASE END", "a IN ()", "a IN (SELECT b FROM c)", "EXISTS (SELECT a FROM b)", "(SELECT a FROM b)",
        "a IS DISTINCT FROM b", "CAST(a AS text)", "a::text", "a COLLATE nocase", "a & b", "a << 2", "round(a)", "substr(a, 1)", "sum(DISTINCT a)", "count(DISTINCT a)", "sum(*)", "lower(*)",
        "sum(a) OVER (PARTITION BY b)", "nullif(a)", "replace(a, b)", "coalesce()", "length(a, b)", "gen_random_uuid(1)", "'a' 'b'", "'open", '"open', "1e", "1a", "0x1FFFFFFFFFFFFFFFFF",
        "a b", "a.b.c", "a =", "NOT", "a BETWEEN 1", "a LIKE", "a AND", "(a", "a)", "a;", "$1", "?", "0xZZ", "-0xFF", "a[1]", "{a}",
    ],
)
def test_refused_expressions(text):
    with pytest.raises(GrammarError):
        parse_expression(text)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT a FROM t", "SELECT DISTINCT a AS x, b FROM t u WHERE a = 1 GROUP BY a, b HAVING count(*) > 1 ORDER BY a DESC, 2 LIMIT 1 OFFSET 2;", "CREATE VIEW v AS SELECT a FROM t",
        "SELECT a FROM (t JOIN u ON t.a = u.a)", "SELECT a FROM t CROSS JOIN u LEFT OUTER JOIN w AS x ON a = b", "SELECT a FROM (SELECT b AS a FROM t) d", "SELECT a FROM (WITH c AS (SELECT a FROM t) SELECT a FROM c) d",
        "SELECT a FROM t UNION ALL SELECT b FROM u EXCEPT SELECT c FROM w ORDER BY 1", "SELECT a FROM t INTERSECT SELECT b FROM u INTERSECT SELECT c FROM w", "WITH a AS (SELECT x FROM t), b AS (SELECT x FROM a) SELECT x FROM b",
        "select\ta\nfrom\tt\nwhere\ta\n=\n1", "SELECT a FROM t OFFSET 3", "WITH t AS (SELECT a FROM (WITH t AS (SELECT b AS a FROM u) SELECT a FROM t) x) SELECT a FROM t",
    ],
)
def test_queries_and_their_json(text):
    tree = parse_query(text)
    assert loads(Select, dumps(tree)) == tree
    assert decode(Select, encode(tree)) == tree


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM t", "SELECT a", "SELECT a b FROM t", "SELECT FROM t", "SELECT a FROM t, u", "SELECT a FROM s.t", "SELECT a FROM t RIGHT JOIN u ON a = b", "SELECT a FROM t FULL JOIN u ON a = b",
        "SELECT a FROM t FULL OUTER JOIN u ON a = b", "SELECT a FROM t NATURAL JOIN u", "SELECT a FROM t JOIN u USING (a)", "SELECT a FROM t JOIN u", "SELECT a FROM (SELECT b FROM t)", "SELECT a FROM LATERAL (SELECT b FROM t) x",
        "WITH RECURSIVE a AS (SELECT x FROM a) SELECT x FROM a", "WITH a AS (SELECT x FROM A) SELECT x FROM a", "WITH a AS (SELECT x FROM t UNION SELECT x FROM a) SELECT x FROM a", "WITH a (x) AS (SELECT x FROM t) SELECT x FROM a",
        "SELECT a FROM t GROUP BY", "SELECT a FROM t ORDER BY a NULLS FIRST", "SELECT a FROM t LIMIT -1", "SELECT a FROM t LIMIT 1 + 1", "SELECT a FROM t LIMIT a", "SELECT a FROM t FETCH FIRST 1 ROW ONLY",
        "SELECT a FROM t INTERSECT ALL SELECT b FROM u", "SELECT a FROM t EXCEPT ALL SELECT b FROM u", "(SELECT a FROM t) UNION (SELECT b FROM u)", "SELECT a FROM t UNION SELECT b FROM u INTERSECT SELECT c FROM w",
        "SELECT a FROM t LIMIT 1 UNION SELECT b FROM u", "SELECT a FROM t ORDER BY a UNION SELECT b FROM u", "SELECT a FROM t; SELECT b FROM u", "SELECT a FROM t WHERE", "VALUES (1)", "SELECT sum(a) OVER () FROM t", "INSERT INTO t (a) VALUES (1)",
        "SELECT a FROM t WINDOW w AS (ORDER BY a)", "SELECT a FROM t GROUP BY ROLLUP (a)", "SELECT count(*) FILTER (WHERE a) FROM t", "SELECT a FROM generate_series(1, 2) g", "SELECT a FROM t TABLESAMPLE (1)",
    ],
)
def test_refused_queries(text):
    with pytest.raises(GrammarError):
        parse_query(text)


def test_defaults_drop_known_casts():
    assert parse_default("'x'::character varying") == E("string", "x")
    assert parse_default("(0)::bigint::text") == n(0)
    for bad in ("'x'::regclass", "a::text[]", "'x'::"):
        with pytest.raises(GrammarError):
            parse_default(bad)
