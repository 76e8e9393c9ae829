import pytest

from plumbline.errors import SchemaError
from plumbline.operators.select import Queries


@pytest.fixture(scope="module")
def engine(spark):
    t = spark.createDataFrame([(1, "a", 55), (2, "B", None), (3, None, 7), (2, "b\\x", 7)], "id bigint, name string, score int")
    u = spark.createDataFrame([(2, "x"), (3, "y"), (9, "z")], "id bigint, tag string")
    return Queries({"t": t, "U": u})


def rows(frame):
    return [tuple(r) for r in frame.collect()]


@pytest.mark.parametrize(
    "text,want",
    [
        ("SELECT id FROM t WHERE name LIKE 'B%' ORDER BY id", [(2,), (2,)]),
        ("SELECT name FROM t WHERE name LIKE '%\\x'", [("b\\x",)]),
        ("SELECT id / 2 AS h, id / 2.0 > 1 AS more FROM t ORDER BY id LIMIT 1", [(0, False)]),
        ("SELECT u.id AS i, t.name AS name FROM U u LEFT JOIN t ON u.id = t.id AND t.score = 7 ORDER BY u.id", [(2, "b\\x"), (3, None), (9, None)]),
        ("SELECT a.id AS x, b.id AS y FROM t a JOIN t b ON a.id < b.id AND b.score = 7 ORDER BY 1, 2", [(1, 2), (1, 3), (2, 3), (2, 3)]),
        ("SELECT score AS s, count(*) AS n, sum(id) AS total FROM t GROUP BY score HAVING count(*) > 1", [(7, 2, 5)]),
        ("SELECT count(name) + 1 AS n FROM t", [(4,)]),
        ("SELECT sum(id) AS s FROM t HAVING count(*) > 100", []),
        ("SELECT DISTINCT score AS s FROM t ORDER BY s DESC", [(55,), (7,), (None,)]),
        ("SELECT id AS k FROM t EXCEPT SELECT id FROM u", [(1,)]),
        ("SELECT id AS k FROM t UNION SELECT id FROM u ORDER BY 1 DESC LIMIT 2 OFFSET 1", [(3,), (2,)]),
        ("WITH t AS (SELECT id FROM u) SELECT count(*) AS n FROM t", [(3,)]),
        ("SELECT id AS k FROM t WHERE score NOT IN (55, NULL)", []),
        ("SELECT 'x' || id AS label FROM u WHERE id = 9", [("x9",)]),
        ("SELECT lower(name) AS n FROM t GROUP BY lower(name) ORDER BY lower(name) DESC LIMIT 1", [("b\\x",)]),
        ("SELECT max(score) AS m FROM t GROUP BY id ORDER BY sum(id) DESC, id LIMIT 1", [(7,)]),
        ("SELECT name AS id FROM t ORDER BY id LIMIT 1", [(None,)]),
        ("SELECT CASE WHEN score > 50 THEN 'high' WHEN score IS NULL THEN 'none' END AS c FROM t ORDER BY t.id, t.score", [("high",), ("none",), (None,), (None,)]),
    ],
)
def test_results(engine, text, want):
    assert rows(engine.sql(text)) == want


@pytest.mark.parametrize(
    "text",
    [
        "SELECT nothing FROM t", "SELECT id FROM nowhere", "SELECT id FROM t JOIN u ON t.id = u.id", "SELECT x.id FROM t", "SELECT id FROM t a JOIN u a ON 1 = 1",
        "SELECT id, count(*) FROM t", "SELECT id FROM t WHERE count(*) > 1", "SELECT sum(count(*)) FROM t GROUP BY id", "SELECT id FROM t GROUP BY count(*)", "SELECT DISTINCT id FROM t ORDER BY score",
        "SELECT id FROM t ORDER BY 2", "SELECT id FROM t UNION SELECT id, tag FROM u", "SELECT id AS k FROM t UNION SELECT id FROM u ORDER BY score", "SELECT name FROM t GROUP BY id",
        "SELECT d.a FROM (SELECT id AS a, name AS a FROM t) d",
    ],
)
def test_refused(engine, text):
    with pytest.raises(SchemaError):
        engine.sql(text)


def test_views_are_resolved_and_may_not_loop(engine):
    from plumbline.plans.parser import parse_query

    q = Queries(engine.tables, {"v": parse_query("SELECT id AS k FROM w WHERE id > 1"), "w": parse_query("SELECT id FROM t"), "x": parse_query("SELECT k FROM y"), "y": parse_query("SELECT k FROM x")})
    assert sorted(rows(q.view("V"))) == [(2,), (2,), (3,)]
    with pytest.raises(SchemaError):
        q.view("x")


def test_plans_push_filters_and_columns_down(spark, tmp_path):
    spark.range(1000).selectExpr("id AS a", "id % 7 AS b", "id AS c").write.parquet(str(tmp_path / "w"))
    q = Queries({"w": spark.read.parquet(str(tmp_path / "w"))})
    plan = q.sql("SELECT d.a AS a FROM (SELECT a, b FROM w) d WHERE d.b = 3 ORDER BY a LIMIT 5")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(b,3)" in plan and "ReadSchema: struct<a:bigint,b:bigint>" in plan and "TakeOrderedAndProject" in plan
