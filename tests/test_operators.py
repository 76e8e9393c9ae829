import pytest

from plumbline.errors import ConstraintError, SchemaError
from plumbline.operators import constraints, routines, search, triggers
from plumbline.plans.model import Column, Constraint, Domain, Expression, Generated, Index, IndexKey, Reference, Schema, Table, Type
from plumbline.plans.objects import parse_server_routine, parse_trigger
from plumbline.plans.parser import parse_expression

INT, TEXT = Type("integer"), Type("text")


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_violations(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", -1), (None, "b", None), (2, None, 7)], "id bigint, code string, n bigint")
    t = Table(
        "t",
        (Column("id", INT), Column("code", TEXT, True), Column("n", INT, True, None, "pos")),
        (Constraint("primary_key", ("id",)), Constraint("unique", ("code",)), Constraint("check", (), None, parse_expression("n > 0")), Constraint("foreign_key", ("n",), Reference("p", ("k",)))),
    )
    p = Table("p", (Column("k", INT),), (Constraint("primary_key", ("k",)),))
    schema = Schema((t, p), (Index("i", "t", True, (IndexKey("", False, parse_expression("upper(code)")),), parse_expression("id = 1")),), (Domain("pos", INT, Expression("gte", args=(Expression("domain_value"), Expression("integer", "0"))), True),))
    found = {v.constraint: v.rows.count() for v in constraints.violations(schema, {"t": df, "p": spark.createDataFrame([(5,)], "k bigint")})}
    assert found == {"NOT NULL of id": 1, "NOT NULL of n": 1, "CHECK of domain pos": 1, "PRIMARY KEY (id)": 2, "UNIQUE (code)": 1, "CHECK": 1, "FOREIGN KEY (n)": 2, "NOT NULL of k": 0, "PRIMARY KEY (k)": 0, "UNIQUE of index i": 0}
    with pytest.raises(ConstraintError):
        constraints.require_sound(schema, {"t": df, "p": spark.createDataFrame([(5,)], "k bigint")})


def test_defaults_and_generated(spark):
    t = Table("t", (Column("id", INT), Column("note", TEXT, True, parse_expression("'new'")), Column("d", INT, True, None, "dom"), Column("g", INT, True, None, "", Generated(parse_expression("id * 2"), True))))
    schema = Schema((t,), (), (Domain("dom", INT, None, False, parse_expression("7")),))
    given = spark.createDataFrame([(1, 99)], "id bigint, g bigint")
    assert rows(constraints.with_generated(constraints.with_defaults(given, schema, t), t)) == [(1, "new", 7, 2)]
    kept = spark.createDataFrame([(1, None)], "id bigint, note string")
    assert rows(constraints.with_generated(constraints.with_defaults(kept, schema, t), t)) == [(1, None, 7, 2)]


def family(on_delete, on_update=""):
    a = Table("a", (Column("id", INT),), (Constraint("primary_key", ("id",)),))
    b = Table("b", (Column("id", INT), Column("a", INT, True, parse_expression("3"))), (Constraint("primary_key", ("id",)), Constraint("foreign_key", ("a",), Reference("a", ("id",), on_update, on_delete))))
    c = Table("c", (Column("id", INT), Column("b", INT, True)), (Constraint("primary_key", ("id",)), Constraint("foreign_key", ("b",), Reference("b", ("id",), "", "cascade"))))
    return Schema((a, b, c))


def data(spark):
    return {"a": spark.createDataFrame([(1,), (2,), (3,)], "id bigint"), "b": spark.createDataFrame([(10, 1), (20, 2), (30, None)], "id bigint, a bigint"), "c": spark.createDataFrame([(100, 10), (200, 20), (300, 30)], "id bigint, b bigint")}


def test_referential_actions(spark):
    t = data(spark)
    doomed = t["a"].where("id = 1")
    out = constraints.delete_rows(family("cascade"), t, "a", doomed)
    assert rows(out["a"]) == [(2,), (3,)] and rows(out["b"]) == [(20, 2), (30, None)] and rows(out["c"]) == [(200, 20), (300, 30)]
    assert rows(constraints.delete_rows(family("set_null"), t, "a", doomed)["b"]) == [(10, None), (20, 2), (30, None)]
    assert rows(constraints.delete_rows(family("set_default"), t, "a", doomed)["b"]) == [(10, 3), (20, 2), (30, None)]
    for action in ("", "no_action", "restrict"):
        with pytest.raises(ConstraintError):
            constraints.delete_rows(family(action), t, "a", doomed)
    assert rows(constraints.delete_rows(family("restrict"), t, "a", t["a"].where("id = 3"))["a"]) == [(1,), (2,)]
    moves = spark.createDataFrame([(1, 11)], "old_id bigint, new_id bigint")
    assert rows(constraints.update_keys(family("", "cascade"), t, "a", moves)["b"]) == [(10, 11), (20, 2), (30, None)]
    assert rows(constraints.update_keys(family("", "set_null"), t, "a", moves)["b"]) == [(10, None), (20, 2), (30, None)]
    with pytest.raises(ConstraintError):
        constraints.update_keys(family(""), t, "a", moves)


E_, LOG = Table("e", (Column("id", INT), Column("title", TEXT, True)), (Constraint("primary_key", ("id",)),)), Table("log", (Column("id", INT), Column("note", TEXT, True, parse_expression("'d'"))), (Constraint("primary_key", ("id",)),))


def test_triggers(spark):
    def schema(*texts):
        return Schema((E_, LOG), (), (), (), tuple(map(parse_trigger, texts)))

    e = spark.createDataFrame([(1, "x"), (2, None)], "id bigint, title string")
    log = spark.createDataFrame([(1, "old"), (5, "old")], "id bigint, note string")
    tables = {"e": e, "log": log}
    s = schema("CREATE TRIGGER a AFTER INSERT ON e WHEN NEW.title IS NULL BEGIN INSERT INTO log (id) VALUES (NEW.id + 100); END")
    assert rows(triggers.fire_all(s, "e", "insert", triggers.delta(None, e), tables)["log"]) == [(1, "old"), (102, "d"), (5, "old")]
    s = schema("CREATE TRIGGER b AFTER UPDATE ON e BEGIN UPDATE log SET note = OLD.title || NEW.title || note WHERE id = NEW.id; DELETE FROM log WHERE id > NEW.id + 3; END")
    change = triggers.delta(e.where("id = 1"), spark.createDataFrame([(1, "y")], e.schema), ("id",))
    assert rows(triggers.fire_all(s, "e", "update", change, tables)["log"]) == [(1, "xyold")]
    s = schema("CREATE TRIGGER c BEFORE DELETE ON e BEGIN DELETE FROM log WHERE id = OLD.id; END")
    assert rows(triggers.fire_all(s, "e", "delete", triggers.delta(e, None), tables)["log"]) == [(5, "old")]
    with pytest.raises(SchemaError):
        triggers.fire_all(schema("CREATE TRIGGER d AFTER INSERT ON e BEGIN DELETE FROM e WHERE id = 1; END"), "e", "insert", triggers.delta(None, e), tables)
    twice = triggers.fire_all(schema("CREATE TRIGGER f AFTER INSERT ON e BEGIN UPDATE log SET note = 'z' WHERE id = 1; END"), "e", "insert", triggers.delta(None, e), tables)
    with pytest.raises(Exception, match="twice"):
        twice["log"].collect()


def test_routines(spark):
    r = parse_server_routine("r", "INSERT INTO log (id, note) VALUES (k, label); UPDATE log SET note = 'seen' WHERE note LIKE 'O%' AND id < k; DELETE FROM log WHERE id = 5", "k integer, label text", "void", "sql")
    schema = Schema((LOG,), routines=(r,))
    log = spark.createDataFrame([(1, "old"), (5, "old"), (50, None)], "id bigint, note string")
    args = {"k": ("integer", "9"), "label": ("text", "it's")}
    assert rows(routines.call(schema, {"log": log}, "r", args)["log"]) == [(1, "seen"), (50, None), (9, "it's")]
    assert rows(routines.call(schema, {"log": log}, "r", {"k": ("integer", "0"), "label": ("null", "")})["log"]) == [(0, None), (1, "old"), (50, None)]
    for name, given in (("nope", args), ("r", {"k": ("integer", "1")})):
        with pytest.raises(SchemaError):
            routines.call(schema, {"log": log}, name, given)
    part = Schema((LOG,), routines=(parse_server_routine("p", "INSERT INTO log (id) VALUES (1)", "", "void", "sql"),))
    with pytest.raises(SchemaError):
        routines.call(part, {"log": log}, "p", {})


def test_search(spark):
    df = spark.createDataFrame([(1, "Los árboles", "del BOSQUES x"), (2, None, "nil"), (10, "bosques de", "Árboles"), (3, "a_b 42", None)], "id bigint, title string, body string")
    find = lambda q: [r.id for r in search.search(df, "id", ["title", "body"], q).collect()]
    assert find("árboles bosques") == ["1", "10"] and find("nil") == ["2"] and find(" .") == ["1", "10", "2", "3"] and find("42 A b") == ["3"] and find("arboles") == []
    with pytest.raises(SchemaError):
        search.search(df, "id", [], "x")


def test_registered_queries_cover_their_whole_tables(spark, tmp_path):
    from plumbline.catalogue import QUERIES

    lines = [(k, n, 3 * k, n) for k in (1, 499, 500, 900_000) for n in (1, 2)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, l_suppkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert {tuple(r) for r in QUERIES["q_arith"](spark, str(tmp_path)).collect()} == {(k, n, 2 * p - s + 7) for k, n, p, s in lines}
    orders = [(1, 5, "O"), (2, 5_000, "O"), (3, 6, "F"), (4, 7_000, "P")]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    assert {tuple(r) for r in QUERIES["q_trigger_update"](spark, str(tmp_path)).collect()} == {(1, "X"), (2, "X"), (3, "old"), (4, "old")}
    assert {tuple(r) for r in QUERIES["q_trigger_delete"](spark, str(tmp_path)).collect()} == {(3, "old"), (4, "old")}


def test_search_finds_whole_tokens_only(spark):
    from plumbline.operators.search import search

    rows = [(1, "The cat, of AND"), (2, "theory of and"), (3, None), (4, "\u00c9t\u00e9 the-of_and"), (5, "a1 the1 of and"), (6, "the\u00e9 of and the"), (7, "")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    ids = lambda q: [r.id for r in search(df, "id", ["text"], q).collect()]
    assert ids("of, THE and!") == ["1", "4", "6"]
    assert ids("\u00e9T\u00e9") == ["4"] and ids("1") == [] and ids("a1") == ["5"]
    assert ids("  .") == [str(i) for i in range(1, 8)]


def test_server_store_reads_in_parts(spark):
    from plumbline.errors import SchemaError
    from plumbline.plans.model import Target, Version
    from plumbline.sources.jdbc import Parts, ServerStore

    server = ServerStore(spark, "jdbc:derby:memory:parts;create=true", Target("postgres", Version(17)), {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    rows = spark.range(100).selectExpr("id AS K", "CAST(id AS STRING) AS T")
    server.append("ROWS_", rows)
    got = server.table("ROWS_", Parts("K", 10, 90, 4))
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect())) and server.count("ROWS_") == 100
    with pytest.raises(SchemaError):
        ServerStore(spark, "file:/x", Target("postgres", Version(17)))
