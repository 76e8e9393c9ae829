import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbline import cli
from plumbline.errors import ConflictError, ConstraintError, PlumblineError, SchemaError
from plumbline.plans.model import Column, Constraint, Generated, Reference, Schema, Table, Target, Type, Version, dumps
from plumbline.plans.objects import parse_server_routine
from plumbline.plans.parser import parse_expression
from plumbline.sources.inspect import inspect_catalog, inspect_store
from plumbline.sources.store import Store
from plumbline.streaming import journal as journals
from plumbline.streaming import replay
from plumbline.streaming.stream import journal_stream, replay_stream

INT, TEXT = Type("integer"), Type("text")
ITEMS = Table("items", (Column("id", INT), Column("title", TEXT, True)), (Constraint("primary_key", ("id",)),))
SCHEMA = Schema((ITEMS,))
SQLITE, POSTGRES = Target("sqlite", Version(3, 45)), Target("postgres", Version(17))
SOURCE = ("sqlite", (3, 45, 0))


def image(row):
    return None if row is None else {"id": ("integer", str(row[0])), "title": ("null", None) if row[1] is None else ("text", row[1])}


def change(seq, kind, key, before, after, source=SOURCE, table="items"):
    return (source, seq, datetime(2024, 1, 1), kind, table, None if key is None else {"id": ("integer", str(key))}, image(before), image(after), "", "")


def journal(spark, changes):
    return spark.createDataFrame(changes, journals.JOURNAL)


def ledger(spark):
    return spark.createDataFrame([], replay.LEDGER)


def items(spark, rows):
    return spark.createDataFrame([(str(a), b) for a, b in rows], "id string, title string")


def naive(rows, changes, tolerant):
    """The fold that the window must equal: final rows, or the sequence of the first conflict."""
    state = dict(rows)
    for _, seq, _, kind, _, key, before, after, _, _ in sorted(changes, key=lambda c: c[1]):
        def row(x):
            return None if x is None else (int(x["id"][1]), x["title"][1])

        old, new, at = row(before), row(after), int(key["id"][1])
        now = (at, state[at]) if at in state else None
        if kind == "insert":
            if now is not None and not (tolerant and now == new):
                return seq
        elif kind == "update":
            if now != old:
                if not (tolerant and now == new):
                    return seq
            elif new[0] != at and new[0] in state:
                return seq
        elif now != old and not (tolerant and now is None):
            return seq
        state.pop(at, None)
        if new is not None:
            state[new[0]] = new[1]
    return sorted(state.items(), key=str)


def batch(rnd, moves):
    state = {k: rnd.choice(["a", "b", None]) for k in rnd.sample(range(4), rnd.randrange(4))}
    start, out, model = dict(state), [], dict(state)
    for seq in range(1, rnd.randrange(2, 8)):
        key, kind = rnd.randrange(4), rnd.choice(["insert", "update", "delete"])
        lie = rnd.random() < 0.12
        before = (key, rnd.choice(["a", "b", None]) if lie or key not in model else model[key])
        if not lie and (kind == "insert") == (key in model):
            kind = "update" if key in model else "insert"
        after = (rnd.randrange(4) if moves and kind == "update" and rnd.random() < 0.4 else key, rnd.choice(["a", "b", None]))
        if kind == "delete":
            model.pop(key, None)
        else:
            model.pop(key, None)
            model[after[0]] = after[1]
        out.append(change(seq, kind, key, None if kind == "insert" else before, None if kind == "delete" else after))
    return list(start.items()), out


@pytest.mark.parametrize("moves", [False, True])
@pytest.mark.parametrize("tolerant", [False, True])
def test_replay_equals_a_fold(spark, moves, tolerant):
    """Many random batches at once: each has keys of its own, so one replay checks all."""
    rnd = random.Random(7 + moves)
    good_rows, good_changes, want, bad = [], [], [], []
    for n in range(160):
        rows, changes = batch(rnd, moves)
        result = naive(rows, changes, tolerant)
        base = 10 * n
        rows = [(base + k, v) for k, v in rows]
        shifted = []
        for c in changes:
            move = lambda x: None if x is None else {"id": ("integer", str(int(x["id"][1]) + base)), **({"title": x["title"]} if "title" in x else {})}
            shifted.append((c[0], c[1] + 100 * n, *c[2:5], move(c[5]), move(c[6]), move(c[7]), *c[8:]))
        good_rows += rows
        good_changes += shifted
        if isinstance(result, int):
            bad.append(result + 100 * n)
        else:
            want += [(str(k + base), v) for k, v in result]
    outcome = replay.checked(replay.events(journal(spark, good_changes), ITEMS), items(spark, good_rows), ITEMS, tolerant)
    found = {}
    for r in outcome.where("NOT fine").select("sequence").collect():
        found[r.sequence // 100] = min(found.get(r.sequence // 100, 1 << 60), r.sequence)
    assert sorted(found.values()) == sorted(bad) and 20 < len(bad) < 150
    final = [(r.id, r.title) for r in replay.replayed(items(spark, good_rows), outcome, ITEMS).collect() if int(r.id) // 10 not in found]
    assert sorted(final, key=str) == sorted(want, key=str)


def test_apply_is_ordered_idempotent_and_all_or_nothing(spark):
    start = items(spark, [(1, "one")])
    changes = [change(3, "delete", 1, (1, "uno"), None), change(2, "update", 1, (1, "one"), (1, "uno")), change(1, "insert", 2, None, (2, None))]
    done = replay.apply_typed(SCHEMA, {"items": start}, journal(spark, changes), ledger(spark))
    assert [tuple(r) for r in done.tables["items"].collect()] == [("2", None)] and done.changes == 3
    again = replay.apply_typed(SCHEMA, done.tables, journal(spark, changes), done.ledger)
    assert again.changes == 0 and again.tables["items"].count() == 1
    with pytest.raises(ConflictError) as e:
        replay.apply_typed(SCHEMA, {"items": start}, journal(spark, [change(1, "insert", 3, None, (3, "x")), change(2, "delete", 1, (1, "other"), None)]), ledger(spark))
    assert (e.value.table, e.value.sequence, e.value.expected, e.value.actual) == ("items", 2, ["1", "other"], ["1", "one"])


@pytest.mark.parametrize(
    "changes,message",
    [
        ([change(0, "insert", 1, None, (1, "x"))], "sequence"), ([change(1, "insert", 1, None, None)], "after"), ([change(1, "update", 1, None, (1, "x"))], "before"), ([change(1, "delete", 1, None, None)], "before"),
        ([change(1, "merge", 1, None, (1, "x"))], "kind"), ([change(1, "insert", None, None, (1, "x"))], "key"), ([change(1, "insert", 1, None, (1, "x"), table="nope")], "table"), ([change(1, "insert", 1, None, (1, "x"), table="")], "table"),
        ([change(1, "insert", 1, None, (1, "x")), change(1, "insert", 2, None, (2, "x"))], "duplicate"), ([change(1, "insert", 1, None, (1, "x"), ("oracle", (1, 0, 0)))], "engine"), ([change(1, "insert", 1, None, (1, "x"), ("sqlite", (0, 0, 0)))], "version"),
        ([change(1, "insert", 1, None, (1, "x")), change(2, "insert", 2, None, (2, "x"), ("postgres", (17, 0, 0)))], "one source"),
    ],
)
def test_journals_that_break_a_rule(spark, changes, message):
    with pytest.raises(PlumblineError, match=message):
        journals.require_valid(journal(spark, changes), SCHEMA)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, title string")


def test_capture_numbers_changes_densely(spark):
    old, new = frame(spark, [(i, "a") for i in range(50)]), frame(spark, [(i, "b" if i % 2 else "a") for i in range(10, 60)])
    got = journals.capture(SCHEMA, ITEMS, old, new, SQLITE, 5)
    kinds = sorted((r.kind) for r in got.collect())
    assert kinds.count("delete") == 10 and kinds.count("insert") == 10 and kinds.count("update") == 20
    assert sorted(r.sequence for r in got.collect()) == list(range(6, 46))
    done = replay.apply_typed(SCHEMA, {"items": old}, got, ledger(spark))
    assert done.tables["items"].exceptAll(new).count() == 0 and new.exceptAll(done.tables["items"]).count() == 0
    assert journals.read(got, 10, 3).agg({"sequence": "max"}).first()[0] == 13
    assert journals.suppressed(got.withColumn("origin", got.kind), "delete").count() == 30
    with pytest.raises(SchemaError):
        journals.read(got, 0, 0)
    with pytest.raises(SchemaError):
        journals.capture(SCHEMA, Table("t", ITEMS.columns), old, new, SQLITE)


def filled(spark, path, rows):
    store = Store(spark, str(path), SQLITE)
    store.put_tables(SCHEMA, {"items": frame(spark, rows)})
    return store


def test_store_snapshot_copy_and_rules(spark, tmp_path):
    source = filled(spark, tmp_path / "a", [(1, "áéí 🚀"), (2, None)])
    copy = Store(spark, str(tmp_path / "b"), POSTGRES)
    copy.import_snapshot(source.export_snapshot(SCHEMA))
    assert source.verify(SCHEMA, copy).equivalent and copy.schema() == SCHEMA and inspect_store(copy).exact
    with pytest.raises(SchemaError):
        copy.import_snapshot(source.export_snapshot(SCHEMA))
    broken = filled(spark, tmp_path / "c", [(1, "a"), (1, "b")])
    target = Store(spark, str(tmp_path / "d"), POSTGRES)
    with pytest.raises(ConstraintError):
        target.import_snapshot(broken.export_snapshot(SCHEMA))
    assert target.schema() is None
    copy.insert(SCHEMA, "items", frame(spark, [(3, "x")]))
    assert copy.count("items") == 3 and not source.verify(SCHEMA, copy).equivalent
    with pytest.raises(ConstraintError):
        copy.insert(SCHEMA, "items", frame(spark, [(3, "y")]))
    assert copy.lookup(ITEMS, spark.createDataFrame([(3,), (9,)], "k bigint")).count() == 1
    empty = Store(spark, str(tmp_path / "e"), POSTGRES)
    empty.apply_schema(SCHEMA)
    assert empty.count("items") == 0
    with pytest.raises(SchemaError):
        empty.apply_schema(SCHEMA)


def test_store_generated_columns_and_routines(spark, tmp_path):
    lines = Table("lines", (Column("id", INT), Column("price", INT), Column("total", INT, True, None, "", Generated(parse_expression("price * 2"), True))), (Constraint("primary_key", ("id",)),))
    schema = Schema((lines,), routines=(parse_server_routine("up", "UPDATE lines SET price = p WHERE id = k; INSERT INTO lines (id, price) VALUES (n, p)", "k integer, p integer, n integer", "void", "sql"),))
    store = Store(spark, str(tmp_path / "s"), SQLITE)
    store.apply_schema(schema)
    store.insert(schema, "lines", spark.createDataFrame([(1, 6)], "id bigint, price bigint"))
    store.call(schema, "up", {"k": ("integer", "1"), "p": ("integer", "9"), "n": ("integer", "2")})
    assert sorted(map(tuple, store.table("lines").collect())) == [(1, 9, 18), (2, 9, 18)]
    with pytest.raises(ConstraintError):
        store.call(schema, "up", {"k": ("integer", "1"), "p": ("integer", "5"), "n": ("integer", "2")})
    assert sorted(map(tuple, store.table("lines").collect())) == [(1, 9, 18), (2, 9, 18)]


def test_capture_replay_between_stores_without_echo(spark, tmp_path):
    a, b = filled(spark, tmp_path / "a", [(1, "one")]), Store(spark, str(tmp_path / "b"), POSTGRES)
    a.install_capture(SCHEMA)
    a.install_capture(SCHEMA)
    b.import_snapshot(a.export_snapshot(SCHEMA))
    b.install_capture(SCHEMA)
    a.update_tables(SCHEMA, {"items": frame(spark, [(1, "uno"), (2, "two")])})
    a.update_tables(SCHEMA, {"items": frame(spark, [(2, "two")])})
    assert a.journal().count() == 3
    assert b.apply_changes(SCHEMA, a.changes(0, 100)) == 3
    assert b.apply_changes(SCHEMA, a.changes(0, 100)) == 0
    assert a.verify(SCHEMA, b).equivalent and b.journal().count() == 0
    b.update_tables(SCHEMA, {"items": frame(spark, [(2, "dos")])})
    assert a.apply_changes(SCHEMA, b.changes(0, 10)) == 1
    assert a.verify(SCHEMA, b).equivalent and a.journal().count() == 3


def test_stream(spark, tmp_path):
    a, b = filled(spark, tmp_path / "a", [(1, "one")]), filled(spark, tmp_path / "b", [(1, "one")])
    a.install_capture(SCHEMA)
    for rows in ([(1, "x")], [(1, "x"), (2, "y")], [(2, "z")]):
        a.update_tables(SCHEMA, {"items": frame(spark, rows)})
    for i in range(4):
        a.journal().where(f"sequence = {i + 1}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        replay_stream(journal_stream(spark, str(tmp_path / "in")), b, SCHEMA, str(tmp_path / "check")).awaitTermination()
    assert a.verify(SCHEMA, b).equivalent and b.ledger().count() == 4


def test_catalog(spark):
    spark.range(3).selectExpr("id", "map('a', 1) AS m").createOrReplaceTempView("odd_view")
    found = inspect_catalog(spark)
    assert "odd_view" in [t.name for t in found.schema.tables] and ("column", "odd_view.m") in [(u.kind, u.name) for u in found.unresolved]
    spark.catalog.dropTempView("odd_view")


# --------------------------------------------------------------------------- command line


def contract(features=()):
    return {"source": {"engine": "sqlite", "version": {"major": 3, "minor": 45, "patch": 0}}, "destination": {"engine": "postgres", "version": {"major": 17, "minor": 0, "patch": 0}}, "required_features": list(features)}


def run(capsys, *arguments):
    code = cli.main([str(a) for a in arguments])
    return code, [json.loads(x) for x in capsys.readouterr().out.splitlines()]


def write(path, value):
    path.write_text(json.dumps(value))
    return path


def test_cli_audit_and_usage(capsys, tmp_path):
    code, out = run(capsys, "audit", write(tmp_path / "c.json", contract(["tables", "json"])))
    assert code == 0 and out[0][1] == {"feature": "json", "status": "exact", "reason": "lossless canonical text representation"}
    code, out = run(capsys, "audit", write(tmp_path / "d.json", contract(["views"])))
    assert code == 1 and out[0][0]["status"] == "unknown" and out[1]["code"] == "ERR_AUDIT_NOT_EXACT"
    assert run(capsys, "audit", write(tmp_path / "e.json", contract() | {"x": 1}))[1][0]["code"] == "ERR_CONFIG"
    assert run(capsys, "audit", tmp_path / "missing.json")[1][0]["code"] == "ERR_CONFIG"
    for arguments in ((), ("nope",), ("--dry-run",), ("audit",), ("audit", "a", "b"), ("audit", "--x", "a"), ("cutover", "--dry-run", "--dry-run", "a"), ("audit", "--", "a", "b")):
        code, out = run(capsys, *arguments)
        assert code == 2 and out[0]["code"] == "ERR_USAGE" and out[0]["status"] == "error"


def test_cli_copy_and_cutover(spark, capsys, tmp_path):
    filled(spark, tmp_path / "a", [(1, "one"), (2, "two")])
    schema = json.loads(dumps(SCHEMA))
    config = {"source_dsn": str(tmp_path / "a"), "destination_dsn": str(tmp_path / "b"), "contract": contract(), "schema": schema}
    code, out = run(capsys, "copy", write(tmp_path / "m.json", config))
    assert code == 0 and out[0]["equivalent"] is True and out[0]["source_digest"] == out[0]["destination_digest"]
    write(tmp_path / "s.json", schema)
    options = {"poll_interval_ms": 1, "drain_polls": 1, "batch_limit": 2}
    config = {"source_dsn": str(tmp_path / "a"), "destination_dsn": str(tmp_path / "c"), "contract": contract(), "schema_ref": "s.json", "options": options}
    code, out = run(capsys, "cutover", "--dry-run", write(tmp_path / "x.json", config))
    assert code == 0 and out[0]["source_tables"] == [{"name": "items", "rows": 2}] and out[0]["destination_has_tables"] is False and out[0]["phases"][0] == "install_capture"
    code, out = run(capsys, "cutover", tmp_path / "x.json")
    assert code == 0 and out[0]["status"] == "ready" and out[0]["changes_applied"] == 0
    assert run(capsys, "cutover", tmp_path / "x.json")[1][0]["code"] == "ERR_SNAPSHOT"
    assert run(capsys, "copy", write(tmp_path / "n.json", config | {"schema": schema} | {"options": None}))[1][0]["code"] == "ERR_CONFIG"
    bad = {"tables": [{"name": "t", "columns": [{"name": "a", "type": {"family": "nope"}, "nullable": True}]}]}
    assert run(capsys, "copy", write(tmp_path / "o.json", {"source_dsn": "a", "destination_dsn": "b", "contract": contract(), "schema": bad}))[1][0]["code"] == "ERR_SCHEMA"


def test_drain_catches_up_with_overlap(spark, tmp_path):
    a = filled(spark, tmp_path / "a", [(1, "one")])
    a.install_capture(SCHEMA)
    a.update_tables(SCHEMA, {"items": frame(spark, [(1, "uno"), (2, "two"), (3, "three")])})
    b = Store(spark, str(tmp_path / "b"), POSTGRES)
    b.import_snapshot(a.export_snapshot(SCHEMA))  # the journal holds what the snapshot has already
    a.update_tables(SCHEMA, {"items": frame(spark, [(1, "uno"), (3, "drei")])})
    assert cli.drain(a, b, SCHEMA, cli.Options(1, 1, 2)) == 5
    assert a.verify(SCHEMA, b).equivalent


def test_references_between_tables_on_import(spark, tmp_path):
    child = Table("kids", (Column("id", INT), Column("item", INT, True)), (Constraint("primary_key", ("id",)), Constraint("foreign_key", ("item",), Reference("items", ("id",)))))
    schema = Schema((ITEMS, child))
    a = Store(spark, str(tmp_path / "a"), SQLITE)
    a.put_tables(schema, {"items": frame(spark, [(1, "x")]), "kids": spark.createDataFrame([(1, 1), (2, 7)], "id bigint, item bigint")})
    with pytest.raises(ConstraintError, match="FOREIGN KEY"):
        Store(spark, str(tmp_path / "b"), POSTGRES).import_snapshot(a.export_snapshot(schema))


def test_two_writers_never_lose_a_commit(spark, tmp_path, monkeypatch):
    one, two = filled(spark, tmp_path / "s", [(1, "one")]), Store(spark, str(tmp_path / "s"), SQLITE)
    seen = two._current()
    one.insert(SCHEMA, "items", frame(spark, [(2, "two")]))
    monkeypatch.setattr(two, "_current", lambda: seen)
    for change in (
        lambda: two.insert(SCHEMA, "items", frame(spark, [(3, "three")])),
        lambda: two.update_tables(SCHEMA, {"items": frame(spark, [(1, "x")])}),
        lambda: two.apply_changes(SCHEMA, journal(spark, [change_of(1)])),
    ):
        with pytest.raises(PlumblineError, match="meanwhile"):
            change()
    assert sorted(tuple(r)[:2] for r in one.table("items").collect()) == [(1, "one"), (2, "two")]
    monkeypatch.undo()
    two.insert(SCHEMA, "items", frame(spark, [(3, "three")]))
    assert one.count("items") == 3


def change_of(sequence):
    return change(sequence, "update", 1, (1, "one"), (1, f"v{sequence}"))


def test_layers_follow_the_changes(spark, tmp_path):
    """Batches write what they touch; layers are merged; deleted rows may come back."""
    store = filled(spark, tmp_path / "s", [(i, f"t{i}") for i in range(50)])
    want = {i: f"t{i}" for i in range(50)}
    base = store._current()["tables"]["items"]["base"]
    sequence = 0
    for i in range(12):
        sequence += 2
        changes = [change(sequence - 1, "update", i, (i, want[i]), (i, f"u{i}")), change(sequence, "delete", 49 - i, (49 - i, want[49 - i]), None)]
        assert store.apply_changes(SCHEMA, journal(spark, changes)) == 2
        assert store.apply_changes(SCHEMA, journal(spark, changes)) == 0
        want[i] = f"u{i}"
        del want[49 - i]
        held = store._current()["tables"]["items"]
        assert held["base"] == base and 1 <= len(held["layers"]) <= 8
    assert {r[0]: r[1] for r in store.table("items").collect()} == want
    store.insert(SCHEMA, "items", frame(spark, [(49, "back")]))
    want[49] = "back"
    assert {r[0]: r[1] for r in store.table("items").collect()} == want
    store.compact("items")
    assert store._current()["tables"]["items"]["layers"] == [] and {r[0]: r[1] for r in store.table("items").collect()} == want


def test_images_as_text_and_back(spark):
    columns = (Column("id", Type("integer")), Column("b", Type("binary"), True), Column("f", Type("float"), True), Column("t", Type("text"), True), Column("d", Type("decimal"), True))
    table = Table("x", columns, (Constraint("primary_key", ("id",)),))
    schema = Schema((table,))
    rows = [(1, bytearray(b"\x00\xff"), 0.1, 'a"b', "1.50"), (2, None, None, None, None)]
    new = spark.createDataFrame(rows, "id bigint, b binary, f double, t string, d string")
    got = journals.capture(schema, table, new.limit(0), new, SQLITE)
    text = journals.as_text(got, schema)
    assert sorted(r.after for r in text.collect())[0] == '{"id":"1","b":"00FF","f":"0.1","t":"a\\"b","d":"1.50"}'
    back = journals.of_text(text, schema)
    assert sorted(map(str, back.select("sequence", "primary_key", "before", "after").collect())) == sorted(map(str, got.select("sequence", "primary_key", "before", "after").collect()))
    marked = text.withColumn("after", F.lit('{"id":"7","b":null,"f":"1.00000000000000006e-01","t":null,"d":"\\u0001real2.5"}'))
    assert {(r.after["f"]["value"], r.after["d"]["value"]) for r in journals.of_text(marked, schema).collect()} == {("0.1", "2.5")}
    for bad in ('{"id":"7"}', "nonsense", '{"id":"7","b":null,"f":null,"t":null,"d":null,"z":"1"}'):
        with pytest.raises(Exception, match="invalid row image"):
            journals.of_text(text.withColumn("after", F.lit(bad)), schema).collect()
    with pytest.raises(Exception, match="unknown table"):
        journals.of_text(text.withColumn("table", F.lit("y")), schema).collect()
