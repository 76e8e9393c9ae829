import json
from dataclasses import replace

import pytest

from plumbline.errors import GrammarError, SchemaError
from plumbline.plans.features import audit, infer, require_exact
from plumbline.plans.model import Column, Constraint, Contract, Domain, Expression, Generated, Index, IndexKey, Parameter, Reference, Routine, Schema, Table, Target, Trigger, Type, Version, View, dumps, loads
from plumbline.plans.objects import native_type, parse_create_index, parse_create_table, parse_server_routine, parse_server_trigger, parse_trigger
from plumbline.plans.parser import parse_expression, parse_query
from plumbline.plans.validate import validate
from plumbline.sources.inspect import inspect_ddl

INT = Type("integer")
T = Table("t", (Column("id", INT), Column("name", Type("text"), True)), (Constraint("primary_key", ("id",)),))
UUID = Expression("gen_random_uuid")
TRIGGER = parse_trigger("CREATE TRIGGER x AFTER INSERT ON t BEGIN DELETE FROM u WHERE a = NEW.id; END")


def one(column=None, constraint=None, **more):
    columns = T.columns + ((column,) if column else ())
    constraints = T.constraints + ((constraint,) if constraint else ())
    return Schema((replace(T, columns=columns, constraints=constraints),), **more)


def test_a_sound_schema():
    schema = one(
        Column("v", Type("vector", (3,))),
        Constraint("check", (), None, parse_expression("id > 0")),
        indexes=(Index("i", "t", True, (IndexKey("id"), IndexKey("", True, parse_expression("lower(name)")))),),
        views=(View("v", parse_query("SELECT id FROM t")),),
        triggers=(TRIGGER,),
    )
    assert validate(schema) is schema
    assert loads(Schema, dumps(schema)) == schema


@pytest.mark.parametrize(
    "schema",
    [
        Schema((Table(""),)), Schema((T, T)), Schema((replace(T, name="__compat_schema"),)), one(Column("id", INT)), one(Column("", INT)), one(Column("x", Type(""))), one(Column("x", Type("nope"))),
        one(Column("x", Type("vector"))), one(Column("x", Type("vector", (0,)))), one(Column("x", Type("decimal", (1, 2, 3)))), one(Column("x", INT, True, None, "d")),
        one(Column("x", INT, False, None, "d"), domains=(Domain("d", INT),)), one(Column("x", Type("text"), True, None, "d"), domains=(Domain("d", INT),)), one(domains=(Domain("d", INT), Domain("d", INT))), one(domains=(Domain("d", INT, UUID),)),
        one(Column("x", INT, True, None, "", Generated(Expression("null"), False))), one(Column("x", INT, True, Expression("null"), "", Generated(Expression("null"), True))),
        Schema((Table("t", (Column("id", INT, False, None, "", Generated(Expression("null"), True)),), (Constraint("primary_key", ("id",)),)),)), one(None, Constraint("check", (), None, Expression("eq", args=(UUID, UUID)))),
        one(None, Constraint("foreign_key", ("id",), Reference("t", ("id",), "explode"))), one(None, Constraint("odd", ("id",))), one(indexes=(Index("i", "x", False, (IndexKey("id"),)),)), one(indexes=(Index("i", "t", False, ()),)),
        one(indexes=(Index("i", "t", False, (IndexKey("zz"),)),)), one(indexes=(Index("i", "t", False, (IndexKey("id", False, Expression("null")),)),)), one(views=(View("t", parse_query("SELECT id FROM t")),)), one(views=(View("v"),)),
        one(triggers=(Trigger("x", "t", "instead", "insert", None, TRIGGER.actions),)), one(triggers=(Trigger("x", "t", "after", "truncate", None, TRIGGER.actions),)), one(triggers=(Trigger("x", "t", "after", "insert"),)),
        one(routines=(Routine("r"),)), one(routines=(Routine("r", (Parameter("p", INT), Parameter("p", INT)), TRIGGER.actions),)), one(routines=(Routine("r", (Parameter("p"),), TRIGGER.actions),)),
    ],
)
def test_broken_schemas(schema):
    with pytest.raises(SchemaError):
        validate(schema)


def test_json_is_strict_and_compact():
    assert json.loads(dumps(Schema((T,)))) == {"tables": [{"name": "t", "columns": [{"name": "id", "type": {"family": "integer"}, "nullable": False}, {"name": "name", "type": {"family": "text"}, "nullable": True}], "constraints": [{"kind": "primary_key", "columns": ["id"]}]}]}
    for bad in ('{"tables": [], "extra": 1}', '{"tables": {}}', '{"tables": [{"name": 3}]}', "[", '{"tables": [{"columns": [{"nullable": "yes"}]}]}'):
        with pytest.raises(SchemaError):
            loads(Schema, bad)


SQLITE, POSTGRES = Target("sqlite", Version(3, 45)), Target("postgres", Version(17))


def test_audit():
    findings = audit(Contract(SQLITE, POSTGRES, ("tables", "json", "views", "windows")))
    assert [(f.feature, f.status) for f in findings] == [("tables", "exact"), ("json", "exact"), ("views", "unknown"), ("windows", "unknown")]
    require_exact(findings[:2])
    with pytest.raises(SchemaError):
        require_exact(findings)
    for bad in (Contract(SQLITE, SQLITE), Contract(Target("sqlite"), POSTGRES), Contract(Target("oracle", Version(1)), POSTGRES), Contract(Target("sqlite", Version(-1, 2)), POSTGRES)):
        with pytest.raises(SchemaError):
            audit(bad)


def test_infer_features():
    schema = one(Column("j", Type("json")), Constraint("check", (), None, Expression("boolean", "true")), triggers=(TRIGGER,))
    assert infer(schema) == ["canonical_check_constraints", "canonical_full_text", "canonical_triggers", "json", "primary_keys", "tables"]
    assert infer(Schema()) == ["canonical_full_text", "tables"]


# --------------------------------------------------------------------------- text of objects


def test_triggers():
    text = """create trigger "T 1" after update on "my t" for each row when new.a <> old.a
        begin insert into log ("a b", c) values (new.a, 'x;y'); update u set n = n + 1, m = 'z' where k = new.k; delete from w where k = old.k; end;"""
    t = parse_trigger(text)
    assert (t.name, t.table, t.timing, t.event, [a.kind for a in t.actions]) == ("T 1", "my t", "after", "update", ["insert", "update", "delete"])
    body = "BEGIN INSERT INTO log (a) VALUES (NEW.a); RETURN NEW; END"
    s = parse_server_trigger("CREATE TRIGGER t BEFORE INSERT ON public.e FOR EACH ROW WHEN ((new.a > 1)) EXECUTE FUNCTION f()", body)
    assert (s.table, s.when.kind, len(s.actions)) == ("e", "gt", 1)
    for bad in ("CREATE TRIGGER t AFTER INSERT ON e BEGIN END", "CREATE TRIGGER t INSTEAD OF INSERT ON e BEGIN DELETE FROM a WHERE b; END", "CREATE TRIGGER t AFTER INSERT ON e BEGIN UPDATE a SET b = 1; END",
                "CREATE TRIGGER t AFTER INSERT ON e BEGIN INSERT INTO a (b, c) VALUES (1); END", "CREATE TRIGGER t AFTER INSERT ON e BEGIN SELECT 1; END", "CREATE TRIGGER t AFTER INSERT ON e BEGIN DELETE FROM a; END"):
        with pytest.raises(GrammarError):
            parse_trigger(bad)
    with pytest.raises(GrammarError):
        parse_server_trigger("CREATE TRIGGER t BEFORE INSERT ON other.e FOR EACH ROW EXECUTE FUNCTION f()", body)
    with pytest.raises(GrammarError):
        parse_server_trigger("CREATE TRIGGER t BEFORE INSERT ON e FOR EACH ROW EXECUTE FUNCTION f()", "BEGIN DELETE FROM a WHERE b = 1; END")


def test_routines():
    r = parse_server_routine("r", "BEGIN INSERT INTO t (id, name) VALUES (k, 'x'); UPDATE t SET name = label WHERE id = k AND name LIKE label; DELETE FROM t WHERE name IS NULL; END", "IN k integer, label character varying", "void", "plpgsql")
    assert [p.type.family for p in r.parameters] == ["integer", "text"]
    assert r.actions[0].assignments[0].value == Expression("parameter", "k")
    assert parse_server_routine("p", "DELETE FROM t WHERE id = 1", "", "", "sql", True).parameters == ()
    for args in (("DELETE FROM t WHERE a = b + 1", "", "void", "sql"), ("UPDATE t SET a = b WHERE c = 1", "", "void", "sql"), ("DELETE FROM t WHERE a = 1", "k integer DEFAULT 3", "void", "sql"), ("DELETE FROM t WHERE a = 1", "k money", "void", "sql"),
                 ("DELETE FROM t WHERE a = 1", "", "integer", "sql"), ("DELETE FROM t WHERE a = 1", "", "void", "c"), ("DELETE FROM t WHERE t.a = 1", "", "void", "sql"), ("DELETE FROM t WHERE lower(a) = 'x'", "", "void", "sql")):
        with pytest.raises(GrammarError):
            parse_server_routine("r", *args)


def test_tables_and_indexes():
    t = parse_create_table('CREATE TABLE IF NOT EXISTS "my t" (id INTEGER PRIMARY KEY, "n m" VARCHAR(20) NOT NULL DEFAULT \'a\'::text UNIQUE, p NUMERIC(10,2) CHECK (p >= 0), g INTEGER GENERATED ALWAYS AS (id * 2) STORED, f REAL REFERENCES o (x) ON DELETE SET NULL ON UPDATE CASCADE, v F32_BLOB(3), CONSTRAINT k UNIQUE (id, p), FOREIGN KEY (p, f) REFERENCES o (a, b), CHECK (id > 0))')
    assert [c.type.family for c in t.columns] == ["integer", "text", "decimal", "integer", "float", "vector"]
    assert t.primary_key == ("id",) and not t.column("id").nullable and t.column("n m").default == Expression("string", "a")
    assert {c.kind for c in t.constraints} == {"primary_key", "unique", "check", "foreign_key"}
    assert next(c for c in t.constraints if c.columns == ("f",)).references == Reference("o", ("x",), "cascade", "set_null")
    doubts = []
    parse_create_table("CREATE TABLE t (a INTEGER DEFAULT nextval('s'), b TEXT CHECK (round(b) = 1), c INTEGER AS (a + 1) VIRTUAL)", doubts)
    assert [k for k, _ in doubts] == ["default", "check", "generated_column"]
    i = parse_create_index("CREATE UNIQUE INDEX i ON t USING btree (a DESC, lower(b)) WHERE a > 1")
    assert i.unique and i.columns[0].descending and i.columns[1].expression.kind == "lower" and i.where.kind == "gt"
    with pytest.raises(GrammarError):
        parse_create_index("CREATE INDEX i ON t USING gin (a)")
    assert native_type("DOUBLE PRECISION").family == "float" and native_type("").family == "binary" and native_type("TIMESTAMP").family == "timestamp" and native_type("money").family == "text"


def test_inspection_lists_what_it_cannot_prove():
    found = inspect_ddl(["CREATE TABLE a (id INTEGER)", "CREATE VIEW v AS SELECT id FROM a", "CREATE VIEW w AS SELECT * FROM a", "CREATE TRIGGER t AFTER INSERT ON a FOR EACH ROW EXECUTE FUNCTION f()", "CREATE SEQUENCE s", "CREATE TABLE __compat_schema (k TEXT)"], {"f": "BEGIN DELETE FROM a WHERE id = NEW.id; RETURN NEW; END"})
    assert [t.name for t in found.schema.tables] == ["a"] and [v.name for v in found.schema.views] == ["v"] and [t.name for t in found.schema.triggers] == ["t"]
    assert not found.exact and {(u.kind, u.name) for u in found.unresolved} == {("view", "w"), ("statement", "s")}
    assert inspect_ddl(["CREATE TABLE a (id INTEGER)"]).exact


NATIVE = [
    "CREATE DOMAIN money_amount AS numeric(10,2) CHECK (VALUE >= 0)",
    "CREATE TABLE a (id integer, price money_amount NOT NULL, name text DEFAULT 'x'::text)",
    "CREATE TABLE b (id integer, a_id integer)",
    "ALTER TABLE ONLY a ADD CONSTRAINT a_pkey PRIMARY KEY (id)",
    "ALTER TABLE public.b ADD CONSTRAINT b_fk FOREIGN KEY (a_id) REFERENCES a(id) ON DELETE CASCADE",
    "ALTER TABLE b ADD CHECK (id > 0)",
    "ALTER TABLE b ADD CONSTRAINT odd CHECK (round(id) = 1)",
    "ALTER TABLE missing ADD UNIQUE (x)",
    "CREATE TRIGGER t AFTER INSERT ON a FOR EACH ROW EXECUTE FUNCTION f()",
    "CREATE OR REPLACE FUNCTION f() RETURNS trigger LANGUAGE plpgsql AS $$ BEGIN DELETE FROM b WHERE id = NEW.id; RETURN NEW; END $$",
    "CREATE FUNCTION r(k integer) RETURNS void AS $body$ DELETE FROM b WHERE id = k $body$ LANGUAGE sql;",
    "CREATE PROCEDURE p(IN k integer, label text) LANGUAGE plpgsql AS $$ BEGIN UPDATE a SET name = label WHERE id = k; END $$",
    "CREATE FUNCTION bad(k integer) RETURNS integer AS $$ SELECT 1 $$ LANGUAGE sql",
    "CREATE FUNCTION odd_form(k integer) RETURNS integer RETURN k + 1",
]


def test_inspection_of_a_server():
    found = inspect_ddl(NATIVE)
    schema = found.schema
    assert [t.name for t in schema.tables] == ["a", "b"] and schema.table("a").primary_key == ("id",) and not schema.table("a").column("id").nullable
    assert schema.table("a").column("price").type == Type("decimal", (10, 2)) and schema.table("a").column("name").default == Expression("string", "x")
    assert [c.kind for c in schema.table("b").constraints] == ["foreign_key", "check"] and schema.table("b").constraints[0].references == Reference("a", ("id",), "", "cascade")
    assert [t.name for t in schema.triggers] == ["t"] and [r.name for r in schema.routines] == ["r", "p"]
    assert {(u.kind, u.name) for u in found.unresolved} == {("domain_column", "a.price"), ("check", "b"), ("constraint", "missing"), ("function", "bad"), ("function", "odd_form")}
