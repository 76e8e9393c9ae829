"""Queries over stores, journals, inspection and the command line, and DuckDB SQL that must agree."""

from __future__ import annotations

import atexit
import contextlib
import io
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import cli
from plumbline.errors import PlumblineError
from plumbline.functions.canonical import value_text
from plumbline.operators import constraints, routines, triggers
from plumbline.operators.digest import differences
from plumbline.operators.select import Queries
from plumbline.plans.features import audit, require_exact
from plumbline.plans.model import Column, Constraint, Contract, Reference, Schema, Table, Target, Type, Version, dumps, loads
from plumbline.plans.objects import parse_create_table, parse_server_routine, parse_server_trigger
from plumbline.plans.parser import parse_default, parse_query
from plumbline.shared import shared_dir
from plumbline.sources.inspect import inspect_ddl, inspect_store
from plumbline.sources.jdbc import Parts, ServerStore
from plumbline.sources.store import Store
from plumbline.streaming import journal as journals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SQLITE, POSTGRES = Target("sqlite", Version(3, 45, 0)), Target("postgres", Version(17))
ORDERS = Table("orders", (Column("o_orderkey", Type("integer")), Column("o_custkey", Type("integer"), True), Column("o_orderstatus", Type("text"), True)), (Constraint("primary_key", ("o_orderkey",)),))
SCHEMA = Schema((ORDERS,))
COLUMNS = [c.name for c in ORDERS.columns]


def query(oracle: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(*COLUMNS)


def _store(spark: SparkSession, target: Target = SQLITE) -> Store:
    return Store(spark, f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}", target)


def _filled(spark: SparkSession, rows: DataFrame) -> Store:
    store = _store(spark)
    store.put_tables(SCHEMA, {"orders": rows})
    return store


def _values(*rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t(name, value)"


def _facts(spark: SparkSession, facts: dict[str, object]) -> DataFrame:
    return spark.createDataFrame([(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in facts.items()], "name string, value string")


def _refused(step: Callable[[], object]) -> bool:
    try:
        step()
    except PlumblineError:
        return True
    return False


# --------------------------------------------------------------------------- stores


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def q_store_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after its rows were inserted in two goes."""
    orders = _orders(spark, sf_dir)
    store = _filled(spark, orders.where("o_orderkey % 2 = 0"))
    store.insert(SCHEMA, "orders", orders.where("o_orderkey % 2 <> 0"))
    return store.table("orders")


@query(_values("('exists before', 'false')", "('exists after', 'true')", "('rows', '0')", "('schema is kept', 'true')", "('again is refused', 'true')"))
def q_store_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark)
    before = store.exists("orders")
    store.apply_schema(SCHEMA)
    return _facts(spark, {"exists before": before, "exists after": store.exists("orders"), "rows": store.count("orders"), "schema is kept": store.schema() == SCHEMA, "again is refused": _refused(lambda: store.apply_schema(SCHEMA))})


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey % 13 = 0")
def q_store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    keys = orders.where("o_custkey % 13 = 0").select("o_orderkey").unionByName(orders.select((-1 - F.col("o_orderkey")).alias("o_orderkey")))
    return _filled(spark, orders).lookup(ORDERS, keys)


@query("SELECT 'orders' AS name, CAST(count(*) AS VARCHAR) AS value FROM orders")
def q_store_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, {"orders": _filled(spark, _orders(spark, sf_dir)).count("orders")})


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0")
def q_store_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after changes that are kept as layers over it."""
    orders = _orders(spark, sf_dir)
    store = _filled(spark, orders)
    raised = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    store.update_tables(SCHEMA, {"orders": raised})
    store.update_tables(SCHEMA, {"orders": raised.where("o_orderkey % 4 <> 0")})
    return store.table("orders")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def q_jdbc_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written to a server and read back in parts; the server is the embedded one that Spark brings."""
    folder = os.path.realpath(tempfile.mkdtemp(prefix="plumbline-"))  # not in memory: tables may be larger
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    server = ServerStore(spark, f"jdbc:derby:{folder}/server;create=true", POSTGRES, {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    server.append("ORDERS", _orders(spark, sf_dir))
    rows = server.table("ORDERS", Parts("o_orderkey", 0, 100_000, 4))
    return rows.select(*(F.col(c).alias(c.lower()) for c in rows.columns))


# --------------------------------------------------------------------------- journals


def _captured(spark: SparkSession, sf_dir: str) -> tuple[Store, DataFrame, DataFrame]:
    """A store with capture whose third orders changed and whose fourth are gone."""
    orders = _orders(spark, sf_dir)
    new = orders.where("o_orderkey % 4 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "N").otherwise(F.col("o_orderstatus")))
    store = _filled(spark, orders)
    store.install_capture(SCHEMA)
    store.update_tables(SCHEMA, {"orders": new})
    return store, orders, new


_CHANGED = "SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 'delete' ELSE 'update' END AS kind FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 AND o_orderstatus <> 'N'"


@query(f"SELECT o_orderkey, kind, 'sqlite' AS engine, 'orders' AS table_name, o_custkey AS custkey_before, CASE WHEN kind = 'update' THEN o_custkey END AS custkey_after, o_orderstatus AS was, CASE WHEN kind = 'update' THEN 'N' END AS now FROM ({_CHANGED})")
def q_capture_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store with capture has recorded: both images of every change."""
    journal = _captured(spark, sf_dir)[0].journal()
    value = lambda image, c: F.col(image)[c]["value"]
    return journal.select(
        value("primary_key", "o_orderkey").cast("bigint").alias("o_orderkey"), "kind", F.col("source.engine").alias("engine"), F.col("table").alias("table_name"),
        value("before", "o_custkey").cast("bigint").alias("custkey_before"), value("after", "o_custkey").cast("bigint").alias("custkey_after"),
        value("before", "o_orderstatus").alias("was"), value("after", "o_orderstatus").alias("now"),
    )


@query(f"SELECT least, most, number, different FROM (SELECT CAST(1 AS BIGINT) AS least, count(*) AS most, count(*) AS number, count(*) AS different FROM ({_CHANGED}))")
def q_capture_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences are dense: from 1 to the number of changes, each once."""
    return _captured(spark, sf_dir)[0].journal().agg(F.min("sequence").alias("least"), F.max("sequence").alias("most"), F.count("*").alias("number"), F.countDistinct("sequence").alias("different"))


@query(f"SELECT CAST(10 + i AS BIGINT) AS sequence FROM range(1, 41) t(i) WHERE 10 + i <= (SELECT count(*) FROM ({_CHANGED}))")
def q_journal_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next forty changes after a cursor; the limit is the feature."""
    return _captured(spark, sf_dir)[0].changes(10, 40).select("sequence")


@query(f"""SELECT o_orderkey, '{{"o_orderkey":"' || o_orderkey || '"}}' AS key_text, '{{"o_orderkey":"' || o_orderkey || '","o_custkey":"' || o_custkey || '","o_orderstatus":"' || o_orderstatus || '"}}' AS before_text,
    CASE WHEN kind = 'update' THEN '{{"o_orderkey":"' || o_orderkey || '","o_custkey":"' || o_custkey || '","o_orderstatus":"N"}}' END AS after_text FROM ({_CHANGED})""")
def q_image_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    journal = _captured(spark, sf_dir)[0].journal()
    text = journals.as_text(journal.withColumn("transaction_id", F.col("primary_key")["o_orderkey"]["value"]), SCHEMA)
    return text.select(F.col("transaction_id").cast("bigint").alias("o_orderkey"), F.col("primary_key").alias("key_text"), F.col("before").alias("before_text"), F.col("after").alias("after_text"))


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus END AS status, CASE WHEN o_custkey % 2 = 0 THEN 'text' ELSE 'null' END AS status_kind FROM orders")
def q_image_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images read from another program's JSON text."""
    orders = _orders(spark, sf_dir)
    text = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_custkey").cast("string").alias("o_custkey"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).alias("o_orderstatus")), {"ignoreNullFields": "false"})
    rows = orders.select(F.lit("orders").alias("table"), F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("o_orderkey"))).alias("primary_key"), F.lit(None).cast("string").alias("before"), text.alias("after"))
    found = journals.of_text(rows, SCHEMA)
    return found.select(F.col("primary_key")["o_orderkey"]["value"].cast("bigint").alias("o_orderkey"), F.col("after")["o_custkey"]["value"].cast("bigint").alias("o_custkey"), F.col("after")["o_orderstatus"]["value"].alias("status"), F.col("after")["o_orderstatus"]["kind"].alias("status_kind"))


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal of one change for each order, some of which break a rule."""
    key, empty = F.col("o_orderkey"), F.lit(None).cast(journals.IMAGE)
    image = F.create_map(*(x for c in ORDERS.columns for x in (F.lit(c.name), F.struct(F.lit(c.type.family).alias("kind"), F.col(c.name).cast("string").alias("value")))))
    part = F.create_map(F.lit("o_orderkey"), F.struct(F.lit("integer").alias("kind"), key.cast("string").alias("value")))
    broken = key % 11
    return _orders(spark, sf_dir).select(
        F.struct(F.when(broken == 1, "oracle").otherwise("sqlite").alias("engine"), F.struct(F.when(broken == 2, 0).otherwise(3).alias("major"), F.lit(0).alias("minor"), F.lit(0).alias("patch")).alias("version")).alias("source"),
        F.when(broken == 3, -key).otherwise(key + 1).alias("sequence"), F.current_timestamp().alias("committed_at"),
        F.when(broken == 4, "upsert").when(broken == 5, "insert").when(broken == 7, "delete").otherwise("update").alias("kind"),
        F.when(broken == 8, "nowhere").otherwise("orders").alias("table"), F.when(broken == 9, empty).otherwise(part).alias("primary_key"),
        F.when((broken == 6) | (broken == 7), empty).otherwise(image).alias("before"), F.when(broken == 5, empty).when(broken == 10, part).otherwise(image).alias("after"),
        F.lit("").alias("transaction_id"), F.lit("").alias("origin"),
    )


@query("""SELECT CASE WHEN o_orderkey % 11 = 3 THEN -o_orderkey ELSE o_orderkey + 1 END AS sequence, CASE o_orderkey % 11 WHEN 1 THEN 'unknown engine' WHEN 2 THEN 'the source has no version' WHEN 3 THEN 'the sequence is not above zero'
    WHEN 4 THEN 'neither insert, update nor delete' WHEN 5 THEN 'an insert without its row' WHEN 6 THEN 'an update without both rows' WHEN 7 THEN 'a delete without its row' WHEN 8 THEN 'unknown table'
    WHEN 9 THEN 'no key is given' ELSE 'an image misses columns' END AS problem FROM orders WHERE o_orderkey % 11 <> 0""")
def q_change_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journals.problems(_made(spark, sf_dir), SCHEMA)


@query("SELECT o_orderkey + 1 AS sequence, CAST(2 AS BIGINT) AS n FROM orders WHERE (o_orderkey + 1) % 6 = 0 AND o_orderkey % 11 <> 3")
def q_repeated_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _made(spark, sf_dir)
    return journals.repeated_sequences(made.unionByName(made.where("sequence > 0 AND sequence % 6 = 0"))).select("sequence", "n")


@query(_values("('one source', 'true')", "('two sources', 'false')"))
def q_single_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a batch is taken: of one source, and of two."""
    one = _made(spark, sf_dir).where("sequence % 11 = 1")
    version = F.struct(F.lit(3).alias("major"), F.lit(1).alias("minor"), F.lit(0).alias("patch"))
    two = one.withColumn("source", F.when(F.col("sequence") % 2 == 0, F.struct(F.lit("sqlite").alias("engine"), version.alias("version"))).otherwise(F.col("source")))
    return _facts(spark, {"one source": not _refused(lambda: journals.require_valid(one, SCHEMA)), "two sources": not _refused(lambda: journals.require_valid(two, SCHEMA))})


@query("SELECT o_orderkey + 1 AS sequence FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 2 = 0")
def q_echo_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that replay didn't write itself."""
    made = _made(spark, sf_dir).where("sequence % 11 = 1").withColumn("origin", F.when(F.col("sequence") % 2 == 0, "replay").otherwise(F.lit(None)))
    return journals.suppressed(made, "replay").select("sequence")


_SUPPLIER = Table("supplier", (Column("s_suppkey", Type("integer")), Column("s_nationkey", Type("integer"), True)), (Constraint("primary_key", ("s_suppkey",)),))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey + 100 ELSE s_nationkey END AS s_nationkey FROM supplier WHERE s_suppkey % 5 <> 0")
def q_drain_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A destination after a snapshot and then all changes, read batch by batch after a cursor."""
    schema = Schema((_SUPPLIER,))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    source, copy = _store(spark), _store(spark, POSTGRES)
    source.put_tables(schema, {"supplier": rows})
    source.install_capture(schema)
    copy.import_snapshot(source.export_snapshot(schema))
    source.update_tables(schema, {"supplier": rows.where("s_suppkey % 5 <> 0").withColumn("s_nationkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey") + 100).otherwise(F.col("s_nationkey")))})
    last = source.journal().count()
    cli.drain(source, copy, schema, cli.Options(1, 1, max(1, -(-last // 2))))
    return copy.table("supplier")


# --------------------------------------------------------------------------- rules of tables


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 4 = 0")
def q_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that lack a required value: every fourth customer's, here."""
    table = Table("orders", (Column("o_orderkey", Type("integer")), Column("customer", Type("integer"))))
    orders = _orders(spark, sf_dir).select("o_orderkey", F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("customer"), "o_custkey")
    (first, second) = constraints.violations(Schema((table,)), {"orders": orders})
    return first.rows.unionByName(second.rows).select("o_orderkey", "o_custkey")


def _family(action: str) -> tuple[Schema, Callable[[SparkSession, str], dict[str, DataFrame]]]:
    customer = Table("customer", (Column("c_custkey", Type("integer")),), (Constraint("primary_key", ("c_custkey",)),))
    own = Column("o_custkey", Type("integer"), True, parse_default("1"))
    orders = Table("orders", (Column("o_orderkey", Type("integer")), own), (Constraint("primary_key", ("o_orderkey",)), Constraint("foreign_key", ("o_custkey",), Reference("customer", ("c_custkey",), "", action))))

    def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
        return {"customer": spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "orders": _orders(spark, sf_dir).select("o_orderkey", "o_custkey")}

    return Schema((customer, orders)), tables


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE o_custkey END AS o_custkey FROM orders")
def q_fk_set_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema, tables = _family("set_default")
    given = tables(spark, sf_dir)
    return constraints.delete_rows(schema, given, "customer", given["customer"].where("c_custkey % 3 = 0"))["orders"]


@query(_values("('with orders', 'true')", "('without orders', 'false')"))
def q_fk_restrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a deletion is refused, of customers with orders and of those without."""
    schema, tables = _family("restrict")
    given = tables(spark, sf_dir)
    idle = given["customer"].join(given["orders"], F.col("c_custkey") == F.col("o_custkey"), "left_anti")

    def delete(doomed: DataFrame) -> Callable[[], object]:
        return lambda: constraints.require_sound(schema, constraints.delete_rows(schema, given, "customer", doomed))

    return _facts(spark, {"with orders": _refused(delete(given["customer"].where("c_custkey % 3 = 0"))), "without orders": _refused(delete(idle))})


@query("SELECT o_orderkey AS orderkey, 'new F' AS note FROM orders WHERE o_orderstatus = 'F'")
def q_server_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = Table("log", (Column("orderkey", Type("integer")), Column("note", Type("text"))))
    trigger = parse_server_trigger(
        "CREATE TRIGGER t AFTER INSERT ON public.orders FOR EACH ROW WHEN (NEW.o_orderstatus = 'F') EXECUTE FUNCTION f()",
        "BEGIN INSERT INTO log (orderkey, note) VALUES (NEW.o_orderkey, 'new ' || NEW.o_orderstatus); RETURN NEW; END",
    )
    orders = _orders(spark, sf_dir)
    schema = Schema((ORDERS, log), (), (), (), (trigger,))
    return triggers.fire_all(schema, "orders", "insert", triggers.delta(None, orders), {"orders": orders, "log": triggers.empty(orders, log)})["log"]


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_custkey >= 50 AND o_orderstatus = 'O' THEN 'kept' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE NOT (o_custkey < 50 AND o_orderstatus = 'P')")
def q_server_routine(spark: SparkSession, sf_dir: str) -> DataFrame:
    routine = parse_server_routine("r", "BEGIN UPDATE orders SET o_orderstatus = label WHERE o_custkey >= k AND o_orderstatus = 'O'; DELETE FROM orders WHERE o_custkey < k AND o_orderstatus = 'P'; END", "IN k integer, label text", "void", "plpgsql")
    return routines.call(Schema((ORDERS,), (), (), (), (), (routine,)), {"orders": _orders(spark, sf_dir)}, "r", {"k": ("integer", "50"), "label": ("text", "kept")})["orders"]


@query("SELECT o_orderkey AS k, o_custkey || '.50' AS text FROM orders")
def q_real_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals, every second of which was stored as a real number and is marked so."""
    text = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit("\x01real")).otherwise(""), F.col("o_custkey").cast("string"), F.lit(".50"))
    marked = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("k"), text.alias("text"))
    return marked.select("k", value_text(F.col("text"), marked.schema["text"].dataType, Type("decimal", (20, 2))).alias("text"))


@query("SELECT o_orderkey, o_orderstatus, 'source' AS side FROM orders WHERE o_orderkey % 9 = 0 AND o_orderkey % 10 <> 1 UNION ALL SELECT o_orderkey, '?', 'destination' FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT o_orderkey, o_orderstatus, 'destination' FROM orders WHERE o_orderkey % 10 = 1 AND o_orderkey % 9 <> 0")
def q_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that only one side has; one that the destination has twice is listed once."""
    one = _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    two = one.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 9 == 0, "?").otherwise(F.col("o_orderstatus")))
    return differences(one, two.unionByName(one.where("o_orderkey % 10 = 1")))


# --------------------------------------------------------------------------- grammar, audit, inspection

REFUSED = {
    "mixed intersect": "SELECT n_name FROM nation UNION SELECT r_name FROM region INTERSECT SELECT n_name FROM nation",
    "clause on an inner branch": "SELECT n_name FROM nation LIMIT 1 UNION SELECT r_name FROM region",
    "recursive": "WITH RECURSIVE t AS (SELECT n_name FROM nation) SELECT n_name FROM t",
    "refers to itself": "WITH t AS (SELECT n_name FROM t) SELECT n_name FROM t",
    "star": "SELECT * FROM nation",
    "right join": "SELECT n_name FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey",
    "accepted": "WITH t AS (SELECT n_name FROM nation) SELECT n_name FROM t",
}


@query(_values(*(f"('{k}', '{str(k != 'accepted').lower()}')" for k in REFUSED)))
def q_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("nation", "region"))
    engine = Queries({"nation": nation, "region": region})
    return _facts(spark, {k: _refused(lambda text=text: (parse_query(text), engine.sql(text))) for k, text in REFUSED.items()})


@query(_values("('known', 'accepted')", "('unknown key', 'refused')", "('two documents', 'refused')", "('wrong type', 'refused')", "('no version', 'refused')"))
def q_strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = {"source": {"engine": "sqlite", "version": {"major": 3, "minor": 45, "patch": 0}}, "destination": {"engine": "postgres", "version": {"major": 17, "minor": 0, "patch": 0}}, "required_features": ["tables"]}
    bad = {"known": json.dumps(good), "unknown key": json.dumps(good | {"more": 1}), "two documents": json.dumps(good) * 2, "wrong type": json.dumps(good | {"required_features": 7})}
    facts = {k: "refused" if _refused(lambda text=text: loads(Contract, text)) else "accepted" for k, text in bad.items()}
    facts["no version"] = "refused" if _refused(lambda: Target("sqlite", Version(0, 0, 0)).validate()) else "accepted"
    return _facts(spark, facts)


@query(_values("('tables', 'false')", "('views', 'true')"))
def q_require_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, {f: _refused(lambda f=f: require_exact(audit(Contract(SQLITE, POSTGRES, (f,))))) for f in ("tables", "views")})


@query(_values("('name', 'string x')", "('size', 'integer 3')", "('price', 'decimal 1.50')"))
def q_casts_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = parse_create_table("CREATE TABLE t (name text DEFAULT 'x'::text, size integer DEFAULT 3::integer, price numeric(5,2) DEFAULT 1.50::numeric)")
    return _facts(spark, {c.name: f"{c.default.kind} {c.default.value}" for c in table.columns if c.default is not None})


NATIVE = (
    "CREATE DOMAIN amount AS numeric(10,2) CHECK (VALUE >= 0)",
    "CREATE TABLE a (id integer, price amount NOT NULL, name text DEFAULT 'x'::text)",
    "CREATE TABLE b (id integer, a_id integer)",
    "ALTER TABLE ONLY a ADD CONSTRAINT a_pkey PRIMARY KEY (id)",
    "ALTER TABLE public.b ADD CONSTRAINT b_fk FOREIGN KEY (a_id) REFERENCES a(id) ON DELETE CASCADE",
    "CREATE INDEX by_name ON public.a USING btree (name)",
    "CREATE VIEW v AS SELECT id FROM a WHERE price > 1",
    "CREATE FUNCTION f() RETURNS trigger LANGUAGE plpgsql AS $$ BEGIN DELETE FROM b WHERE id = NEW.id; RETURN NEW; END $$",
    "CREATE TRIGGER t AFTER INSERT ON a FOR EACH ROW EXECUTE FUNCTION f()",
    "CREATE FUNCTION r(k integer) RETURNS void AS $$ DELETE FROM b WHERE id = k $$ LANGUAGE sql",
    "CREATE PROCEDURE p(k integer, label text) LANGUAGE sql AS $$ UPDATE a SET name = label WHERE id = k $$",
    "CREATE FUNCTION bad(k integer) RETURNS integer AS $$ SELECT 1 $$ LANGUAGE sql",
)


@query(_values("('table a', 'id price name; primary_key')", "('table b', 'id a_id; foreign_key')", "('index by_name', 'a')", "('view v', '1')", "('trigger t', 'after insert a')", "('routine r', 'delete b')", "('routine p', 'update a')", "('unresolved a.price', 'domain_column')", "('unresolved bad', 'function')"))
def q_inspect_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found in a server's statements."""
    found = inspect_ddl(NATIVE)
    s = found.schema
    facts = {f"table {t.name}": f"{' '.join(c.name for c in t.columns)}; {' '.join(c.kind for c in t.constraints)}" for t in s.tables}
    facts |= {f"index {i.name}": i.table for i in s.indexes} | {f"view {v.name}": str(len(v.query.columns)) for v in s.views}
    facts |= {f"trigger {t.name}": f"{t.timing} {t.event} {t.table}" for t in s.triggers} | {f"routine {r.name}": " ".join(f"{a.kind} {a.table}" for a in r.actions) for r in s.routines}
    return _facts(spark, facts | {f"unresolved {u.name}": u.kind for u in found.unresolved})


@query(_values("('with a schema', 'metadata true orders')", "('data alone', 'store true orders')", "('families', 'integer integer text')"))
def q_inspect_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema that a store keeps, and of one that keeps none what its data tell."""
    orders, bare = _orders(spark, sf_dir), _store(spark)
    bare.put_tables(None, {"orders": orders})
    one, two = inspect_store(_filled(spark, orders)), inspect_store(bare)

    def said(x) -> str:
        return f"{x.source} {str(x.exact).lower()} {' '.join(t.name for t in x.schema.tables)}"

    return _facts(spark, {"with a schema": said(one), "data alone": said(two), "families": " ".join(c.type.family for c in two.schema.tables[0].columns)})


# --------------------------------------------------------------------------- command line


def _run(*arguments: str) -> tuple[int, list[dict]]:
    out = io.StringIO()
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(io.StringIO()):
        code = cli.main(list(arguments))
    return code, [json.loads(x) for x in out.getvalue().splitlines()]


def _config(value: object) -> str:
    """A file beside the driver, where the command line runs."""
    handle, path = tempfile.mkstemp(suffix=".json", prefix="plumbline-")
    with os.fdopen(handle, "w") as f:
        json.dump(value, f)
    return path


def _contract(*features: str) -> dict:
    return json.loads(dumps(Contract(SQLITE, POSTGRES, features)))


def _migration(spark: SparkSession, sf_dir: str, **more: object) -> tuple[str, Store, Store]:
    source, copy = _filled(spark, _orders(spark, sf_dir)), _store(spark, POSTGRES)
    config = {"source_dsn": source.path, "destination_dsn": copy.path, "contract": _contract("tables"), "schema": json.loads(dumps(SCHEMA))}
    return _config(config | more), source, copy


@query(_values("('exact code', '0')", "('exact', 'tables exact')", "('inexact code', '1')", "('inexact', 'views unknown')", "('error', 'ERR_AUDIT_NOT_EXACT')"))
def q_cli_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    (one, good), (two, bad) = _run("audit", _config(_contract("tables"))), _run("audit", _config(_contract("views")))
    return _facts(spark, {"exact code": one, "exact": f"{good[0][0]['feature']} {good[0][0]['status']}", "inexact code": two, "inexact": f"{bad[0][0]['feature']} {bad[0][0]['status']}", "error": bad[1]["code"]})


@query("SELECT o_orderkey, o_custkey, o_orderstatus, 0 AS code, TRUE AS equivalent FROM orders")
def q_cli_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    config, _, copy = _migration(spark, sf_dir)
    code, out = _run("copy", config)
    return copy.table("orders").select("*", F.lit(code).alias("code"), F.lit(out[0].get("equivalent")).alias("equivalent"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, 0 AS code, 'ready' AS status FROM orders")
def q_cli_cutover(spark: SparkSession, sf_dir: str) -> DataFrame:
    config, _, copy = _migration(spark, sf_dir, options={"poll_interval_ms": 1, "drain_polls": 1, "batch_limit": 500})
    code, out = _run("cutover", config)
    return copy.table("orders").select("*", F.lit(code).alias("code"), F.lit(out[0].get("status")).alias("status"))


@query("SELECT * FROM (VALUES ('code', '0'), ('status', 'plan'), ('phases', 'install_capture snapshot catch_up verify'), ('destination has tables', 'false')) t(name, value) UNION ALL SELECT 'rows', CAST(count(*) AS VARCHAR) FROM orders")
def q_cli_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    code, out = _run("cutover", "--dry-run", _migration(spark, sf_dir)[0])
    plan = out[0]
    return _facts(spark, {"code": code, "status": plan["status"], "phases": " ".join(plan["phases"]), "destination has tables": plan["destination_has_tables"], "rows": plan["source_tables"][0]["rows"]})


@query(_values("('no file', '1 ERR_CONFIG')", "('unknown key', '1 ERR_CONFIG')", "('bad schema', '1 ERR_SCHEMA')", "('no address', '1 ERR_CONNECT_SOURCE')", "('filled destination', '1 ERR_SNAPSHOT')"))
def q_cli_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    config, source, _ = _migration(spark, sf_dir)
    bad = {"tables": [{"name": "t", "columns": [{"name": "a", "type": {"family": "nope"}, "nullable": True}]}]}
    whole = json.loads(open(config, encoding="utf-8").read())
    runs = {
        "no file": _run("audit", config + ".absent"), "unknown key": _run("copy", _config(whole | {"x": 1})), "bad schema": _run("copy", _config(whole | {"schema": bad})),
        "no address": _run("copy", _config(whole | {"source_dsn": ""})), "filled destination": _run("copy", _config(whole | {"destination_dsn": source.path})),
    }
    return _facts(spark, {k: f"{code} {out[0]['code']}" for k, (code, out) in runs.items()})


USAGES = {"nothing": (), "unknown command": ("nope",), "flag first": ("--dry-run",), "no file": ("audit",), "two files": ("audit", "a", "b"), "unknown flag": ("audit", "--x", "a"), "flag twice": ("cutover", "--dry-run", "--dry-run", "a"), "flags ended": ("audit", "--", "--x", "b")}


@query(_values(*(f"('{k}', '2 ERR_USAGE')" for k in USAGES)))
def q_cli_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, {k: f"{code} {out[0]['code']}" for k, given in USAGES.items() for code, out in [_run(*given)]})
