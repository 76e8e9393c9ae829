"""Queries of the engine over the driver's tables, and DuckDB SQL that must agree.

Nearly all are text of the canonical grammar run through the parser; where an
operator isn't a query (constraints, triggers, replay), its inputs are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.canonical import canonical, value_text
from plumbline.functions.scalar import quoted
from plumbline.operators import constraints, routines, search, triggers
from plumbline.operators.digest import table_digest
from plumbline.operators.select import Queries
from plumbline.plans.features import assess, infer
from plumbline.plans.model import Action, Assignment, Column, Constraint, Domain, Expression, Generated, Index, IndexKey, Parameter, Reference, Routine, Schema, Table, Target, Type, Version
from plumbline.plans.objects import parse_trigger
from plumbline.plans.parser import parse_expression, parse_query
from plumbline.sources.inspect import inspect_ddl, inspect_frames
from plumbline.shared import shared_dir, written
from plumbline.sources.store import Store
from plumbline.streaming import journal as journals
from plumbline.streaming import replay
from plumbline.streaming.stream import journal_stream, replay_stream

Query = Callable[[SparkSession, str], DataFrame]
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class _Tables(dict):
    """Tables that are opened when a query names them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise KeyError(name)
        self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self[name]

    def __contains__(self, name: object) -> bool:
        return name in NAMES


def _engine(spark: SparkSession, sf_dir: str, views: dict[str, str] | None = None) -> Queries:
    queries = Queries({}, {k: parse_query(v) for k, v in (views or {}).items()})
    queries.tables = _Tables(spark, sf_dir)
    return queries


QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _grammar(name: str, text: str, oracle: str | None = None, rounded: tuple[str, ...] = (), views: dict[str, str] | None = None) -> None:
    """Register text of the grammar; the oracle runs the same text unless another is given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = _engine(spark, sf_dir, views).sql(text)
        return frame.select(*(F.round(quoted(c), 2).alias(c) if c in rounded else quoted(c) for c in frame.columns))

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or text


# --------------------------------------------------------------------------- relational queries

_grammar(
    "q_view_join_agg",
    "SELECT n.n_name AS nation, sum(o.o_totalprice) AS total FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderstatus = 'F' GROUP BY n.n_name",
    "SELECT n.n_name AS nation, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderstatus = 'F' GROUP BY n.n_name",
    ("total",),
)
_grammar("q_left_join_count", "SELECT c.c_mktsegment AS segment, count(o.o_orderkey) AS n_orders, count(*) AS n_rows FROM customer c LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P') o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment")
_grammar("q_cross_join", "SELECT r.r_name AS region, n.n_name AS nation FROM region r CROSS JOIN nation n")
_grammar("q_theta_join", "SELECT a.n_name AS lower_nation, b.n_name AS higher_nation FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_grammar("q_join_chain", "SELECT r.r_name AS region, count(*) AS n FROM (supplier s INNER JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT OUTER JOIN region r ON n.n_regionkey = r.r_regionkey) GROUP BY r.r_name")
_grammar("q_having", "SELECT o_custkey AS custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
_grammar("q_global_agg", "SELECT count(*) AS n, count(l_returnflag) AS flags, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem")
_grammar("q_min_max_avg", "SELECT o_orderstatus AS status, min(o_totalprice) AS low, max(o_totalprice) AS high, avg(o_orderkey) AS mean_key FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus AS status, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_orderkey), 2) AS mean_key FROM orders GROUP BY o_orderstatus", ("mean_key",))
_grammar("q_sum_expression", "SELECT l_returnflag AS flag, sum(l_linenumber) * 2 AS double_lines, sum(l_orderkey + l_partkey) AS keys FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag AS flag, CAST(sum(l_linenumber) * 2 AS BIGINT) AS double_lines, CAST(sum(l_orderkey + l_partkey) AS BIGINT) AS keys FROM lineitem GROUP BY l_returnflag")
_grammar("q_group_expression", "SELECT lower(o_orderpriority) AS priority, length(o_orderstatus) AS width, count(*) AS n FROM orders GROUP BY lower(o_orderpriority), length(o_orderstatus)")
_grammar("q_having_global", "SELECT max(o_orderkey) AS top FROM orders HAVING count(*) > 1")
_grammar("q_distinct", "SELECT DISTINCT p_brand AS brand, p_size AS size FROM part")
_grammar("q_order_limit_offset", "SELECT o_orderkey AS orderkey, o_custkey AS custkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 50 OFFSET 25")
_grammar("q_topk", "SELECT p_partkey AS partkey, p_retailprice AS price FROM part ORDER BY p_retailprice DESC, 1 LIMIT 20", "SELECT p_partkey AS partkey, p_retailprice AS price FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
_grammar("q_order_hidden", "SELECT n_name AS nation FROM nation ORDER BY n_regionkey DESC, n_nationkey LIMIT 7")
_grammar("q_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_grammar("q_union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
_grammar("q_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier")
_grammar("q_except", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
_grammar("q_compound_chain", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0 ORDER BY k DESC LIMIT 9")
_grammar("q_derived", "SELECT d.custkey AS custkey, d.n AS n FROM (SELECT o_custkey AS custkey, count(*) AS n FROM orders GROUP BY o_custkey) AS d WHERE d.n BETWEEN 5 AND 7")
_grammar("q_cte", "WITH big AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_totalprice > 300000) SELECT big.c AS custkey, count(*) AS n FROM big GROUP BY big.c")
_grammar("q_cte_multi", "WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey), b AS (SELECT n, count(*) AS orders_of FROM a GROUP BY n) SELECT n AS lines, orders_of FROM b")
_grammar("q_cte_shadow", "WITH nation AS (SELECT n2.r_name AS n_name FROM region n2) SELECT n_name AS name FROM nation")
_grammar(
    "q_nested_view",
    "SELECT v.segment AS segment, v.n AS n FROM rich v WHERE v.n > 1",
    "WITH base AS (SELECT c_mktsegment AS segment, c_acctbal AS balance FROM customer), rich AS (SELECT segment, count(*) AS n FROM base WHERE balance > 5000 GROUP BY segment) SELECT segment, n FROM rich WHERE n > 1",
    views={"rich": "CREATE VIEW rich AS SELECT segment, count(*) AS n FROM base WHERE balance > 5000 GROUP BY segment;", "base": "SELECT c_mktsegment AS segment, c_acctbal AS balance FROM customer"},
)

# --------------------------------------------------------------------------- predicates and functions

_grammar("q_between", "SELECT p_partkey AS k FROM part WHERE p_size BETWEEN 10 AND 20")
_grammar("q_not_between", "SELECT p_partkey AS k FROM part WHERE p_size NOT BETWEEN 5 AND 45")
_grammar("q_in", "SELECT event_id AS id, event_type AS kind FROM events WHERE event_type IN ('click', 'error')")
_grammar("q_not_in", "SELECT event_type AS kind, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'error') GROUP BY event_type")
_grammar("q_in_null", "SELECT p_partkey AS k, p_size IN (1, 2, NULL) AS found, p_size NOT IN (3, NULL) AS missing FROM part")
_grammar("q_case", "SELECT event_type AS kind, CASE WHEN value > 100 THEN 'high' WHEN value > 50 THEN 'middle' ELSE 'low' END AS level, count(*) AS n FROM events GROUP BY event_type, CASE WHEN value > 100 THEN 'high' WHEN value > 50 THEN 'middle' ELSE 'low' END")
_grammar("q_case_no_else", "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 'small' END AS size FROM part")
_grammar("q_nullif", "SELECT event_id AS id, nullif(event_type, 'view') AS kind FROM events")
_grammar("q_coalesce", "SELECT event_id AS id, coalesce(nullif(event_type, 'view'), NULL, 'seen') AS kind FROM events")
_grammar("q_like", "SELECT p_partkey AS k, p_name AS name FROM part WHERE p_name LIKE '%RING%' OR p_brand LIKE 'brand#_'", "SELECT p_partkey AS k, p_name AS name FROM part WHERE p_name ILIKE '%RING%' OR p_brand ILIKE 'brand#_'")
_grammar("q_not_like", "SELECT p_partkey AS k FROM part WHERE p_name NOT LIKE 's%'", "SELECT p_partkey AS k FROM part WHERE p_name NOT ILIKE 's%'")
_grammar("q_concat", "SELECT o_orderkey AS k, o_orderpriority || '/' || 'it''s' || nullif(o_orderstatus, 'O') AS label FROM orders")
_grammar("q_lower_upper_length", "SELECT DISTINCT lower(c_mktsegment) AS low, upper(c_mktsegment) AS high, length(c_mktsegment) AS width FROM customer")
_grammar("q_trim_replace_abs", "SELECT c_custkey AS k, trim('  ' || c_mktsegment || ' ') AS segment, replace(c_name, '#', '-') AS name, abs(c_acctbal) AS balance FROM customer")
_grammar("q_arith", "SELECT l_orderkey AS k, l_linenumber AS line, l_partkey * 2 - l_suppkey + 7 AS mixed FROM lineitem")
_grammar("q_int_div", "SELECT o_orderkey AS k, o_orderkey / 7 AS part, (0 - o_custkey) / 4 AS negative FROM orders", "SELECT o_orderkey AS k, o_orderkey // 7 AS part, -(o_custkey // 4) AS negative FROM orders")
_grammar("q_hex_literal", "SELECT o_orderkey + 0xFF AS plain, 0xFFFFFFFFFFFFFFFF AS minus_one, 0x10 AS sixteen FROM orders", "SELECT o_orderkey + CAST(255 AS BIGINT) AS plain, CAST(-1 AS BIGINT) AS minus_one, CAST(16 AS BIGINT) AS sixteen FROM orders")
_grammar("q_precedence_not", "SELECT n_nationkey AS k FROM nation WHERE NOT n_regionkey = 1 AND n_nationkey > 3 OR NOT (n_nationkey < 20)")
_grammar("q_is_null", "SELECT event_type AS kind, count(*) AS n FROM events WHERE nullif(event_type, 'view') IS NULL OR nullif(event_type, 'click') IS NOT NULL GROUP BY event_type")
_grammar("q_booleans", "SELECT n_nationkey AS k, n_nationkey > 5 AND NULL AS unknown_or_false, n_nationkey > 5 OR TRUE AS yes, NOT FALSE AS no FROM nation")
_grammar("q_decimal_literal", "SELECT o_orderkey AS k, 1.50 AS fixed, 1e-3 AS small FROM orders", "SELECT o_orderkey AS k, CAST(1.50 AS DECIMAL(3,2)) AS fixed, CAST(0.001 AS DOUBLE) AS small FROM orders")


def q_uuid_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions and variants of random identifiers; the identifiers themselves differ each time."""
    frame = _engine(spark, sf_dir).sql("SELECT n_nationkey AS k, gen_random_uuid() AS id FROM nation")
    return frame.select("k", F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$").alias("valid"))


QUERIES["q_uuid_v4"] = q_uuid_v4
ORACLE_SQL["q_uuid_v4"] = "SELECT n_nationkey AS k, TRUE AS valid FROM nation"


def q_current_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _engine(spark, sf_dir).sql("SELECT n_nationkey AS k, CURRENT_TIMESTAMP AS now FROM nation")
    return frame.select("k", (F.col("now") > F.lit("2020-01-01").cast("timestamp")).alias("late"))


QUERIES["q_current_timestamp"] = q_current_timestamp
ORACLE_SQL["q_current_timestamp"] = "SELECT n_nationkey AS k, TRUE AS late FROM nation"

# --------------------------------------------------------------------------- constraints


def _read(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    tables = _Tables(spark, sf_dir)
    return [tables[n] for n in names]


def q_pk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    (lines,) = _read(spark, sf_dir, "lineitem")
    return constraints.primary_key_violations(lines, ("l_orderkey", "l_linenumber"))


QUERIES["q_pk_violations"] = q_pk_violations
ORACLE_SQL["q_pk_violations"] = "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"


def q_unique_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Index("one_name", "part", True, (IndexKey("p_brand"), IndexKey("", False, parse_expression("lower(p_name)"))), parse_expression("p_size > 25"))
    return constraints.index_violations(_read(spark, sf_dir, "part")[0], index)


QUERIES["q_unique_partial"] = q_unique_partial
ORACLE_SQL["q_unique_partial"] = "SELECT p_brand AS key1, lower(p_name) AS key2, count(*) AS n FROM part WHERE p_size > 25 GROUP BY p_brand, lower(p_name) HAVING count(*) > 1"


def q_fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = _read(spark, sf_dir, "orders", "customer")
    kept = Queries({"customer": customers}).sql("SELECT c_custkey FROM customer WHERE c_acctbal >= 0")
    return constraints.orphans(orders.select("o_orderkey", "o_custkey"), ("o_custkey",), kept, ("c_custkey",))


QUERIES["q_fk_violations"] = q_fk_violations
ORACLE_SQL["q_fk_violations"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)"


def q_check_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    (customers,) = _read(spark, sf_dir, "customer")
    return constraints.check_violations(customers, parse_expression("c_acctbal >= 0 OR c_mktsegment = 'MACHINERY'")).select("c_custkey", "c_acctbal")


QUERIES["q_check_violations"] = q_check_violations
ORACLE_SQL["q_check_violations"] = "SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_acctbal >= 0 OR c_mktsegment = 'MACHINERY')"

POSITIVE = Schema((Table("part", (Column("p_partkey", Type("integer")), Column("p_size", Type("integer"), True, None, "small"))),), (), (Domain("small", Type("integer"), Expression("lte", args=(Expression("domain_value"), Expression("integer", "40"))), True),))


def q_domain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    (parts,) = _read(spark, sf_dir, "part")
    check, _ = constraints.domain_check(POSITIVE, POSITIVE.tables[0], "p_size")
    return constraints.check_violations(parts.select("p_partkey", "p_size"), check)


QUERIES["q_domain_check"] = q_domain_check
ORACLE_SQL["q_domain_check"] = "SELECT p_partkey, p_size FROM part WHERE p_size > 40"

LINES = Table("lines", (Column("l_orderkey", Type("integer")), Column("l_linenumber", Type("integer")), Column("twice", Type("integer"), True, None, "", Generated(parse_expression("l_linenumber * 2 + l_orderkey"), True)), Column("note", Type("text"), True, parse_expression("'new'"))))


def q_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    (lines,) = _read(spark, sf_dir, "lineitem")
    return constraints.with_generated(constraints.with_defaults(lines.select("l_orderkey", "l_linenumber"), Schema((LINES,)), LINES), LINES)


QUERIES["q_generated"] = q_generated
ORACLE_SQL["q_generated"] = "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_linenumber * 2 + l_orderkey AS BIGINT) AS twice, 'new' AS note FROM lineitem"


def _family(on_delete: str, on_update: str = "") -> Schema:
    nation = Table("nation", (Column("n_nationkey", Type("integer")), Column("n_name", Type("text"))), (Constraint("primary_key", ("n_nationkey",)),))
    customer = Table(
        "customer",
        (Column("c_custkey", Type("integer")), Column("c_nationkey", Type("integer"), True)),
        (Constraint("primary_key", ("c_custkey",)), Constraint("foreign_key", ("c_nationkey",), Reference("nation", ("n_nationkey",), on_update, on_delete))),
    )
    orders = Table("orders", (Column("o_orderkey", Type("integer")), Column("o_custkey", Type("integer"))), (Constraint("primary_key", ("o_orderkey",)), Constraint("foreign_key", ("o_custkey",), Reference("customer", ("c_custkey",), "", "cascade"))))
    return Schema((nation, customer, orders))


def _family_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    nation, customer, orders = _read(spark, sf_dir, "nation", "customer", "orders")
    return {"nation": nation.select("n_nationkey", "n_name"), "customer": customer.select("c_custkey", "c_nationkey"), "orders": orders.select("o_orderkey", "o_custkey")}


def q_fk_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _family_tables(spark, sf_dir)
    return constraints.delete_rows(_family("cascade"), tables, "nation", tables["nation"].where("n_nationkey < 5"))["orders"]


QUERIES["q_fk_cascade_delete"] = q_fk_cascade_delete
ORACLE_SQL["q_fk_cascade_delete"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)"


def q_fk_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _family_tables(spark, sf_dir)
    return constraints.delete_rows(_family("set_null"), tables, "nation", tables["nation"].where("n_nationkey < 5"))["customer"]


QUERIES["q_fk_set_null"] = q_fk_set_null
ORACLE_SQL["q_fk_set_null"] = "SELECT c_custkey, CASE WHEN c_nationkey >= 5 THEN c_nationkey END AS c_nationkey FROM customer"


def q_fk_update_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _family_tables(spark, sf_dir)
    moves = tables["nation"].where("n_nationkey < 3").selectExpr("n_nationkey AS old_n_nationkey", "n_nationkey + 100 AS new_n_nationkey")
    return constraints.update_keys(_family("", "cascade"), tables, "nation", moves)["customer"]


QUERIES["q_fk_update_cascade"] = q_fk_update_cascade
ORACLE_SQL["q_fk_update_cascade"] = "SELECT c_custkey, CASE WHEN c_nationkey < 3 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey FROM customer"

# --------------------------------------------------------------------------- triggers and routines

AUDIT = Table("audit", (Column("orderkey", Type("integer")), Column("note", Type("text"))))
ORDERS = Table("orders", (Column("o_orderkey", Type("integer")), Column("o_custkey", Type("integer")), Column("o_orderstatus", Type("text"))), (Constraint("primary_key", ("o_orderkey",)),))
TOTALS = Table("totals", (Column("custkey", Type("integer")), Column("state", Type("text"))), (Constraint("primary_key", ("custkey",)),))
WITH_TRIGGERS = Schema(
    (ORDERS, AUDIT, TOTALS),
    (), (), (),
    (
        parse_trigger("CREATE TRIGGER log AFTER INSERT ON orders FOR EACH ROW WHEN NEW.o_orderstatus = 'F' BEGIN INSERT INTO audit (orderkey, note) VALUES (NEW.o_orderkey, 'new ' || NEW.o_orderstatus); END"),
        parse_trigger("CREATE TRIGGER mark AFTER UPDATE ON orders BEGIN UPDATE totals SET state = NEW.o_orderstatus WHERE custkey = NEW.o_orderkey; END"),
        parse_trigger("CREATE TRIGGER forget BEFORE DELETE ON orders BEGIN DELETE FROM totals WHERE custkey = OLD.o_orderkey; END"),
    ),
)


def _triggered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    (orders,) = _read(spark, sf_dir, "orders")
    narrow = orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    totals = narrow.select(F.col("o_orderkey").alias("custkey"), F.lit("old").alias("state"))
    return narrow, {"orders": narrow, "audit": triggers.empty(narrow, AUDIT), "totals": totals}


def q_trigger_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, tables = _triggered(spark, sf_dir)
    return triggers.fire_all(WITH_TRIGGERS, "orders", "insert", triggers.delta(None, orders), tables)["audit"]


QUERIES["q_trigger_audit"] = q_trigger_audit
ORACLE_SQL["q_trigger_audit"] = "SELECT o_orderkey AS orderkey, 'new F' AS note FROM orders WHERE o_orderstatus = 'F'"


def q_trigger_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change of all open orders."""
    orders, tables = _triggered(spark, sf_dir)
    old = orders.where("o_orderstatus = 'O'")
    change = triggers.delta(old, old.withColumn("o_orderstatus", F.lit("X")), ("o_orderkey",))
    return triggers.fire_all(WITH_TRIGGERS, "orders", "update", change, tables)["totals"]


QUERIES["q_trigger_update"] = q_trigger_update
ORACLE_SQL["q_trigger_update"] = "SELECT o_orderkey AS custkey, CASE WHEN o_orderstatus = 'O' THEN 'X' ELSE 'old' END AS state FROM orders"


def q_trigger_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deletion of all open orders."""
    orders, tables = _triggered(spark, sf_dir)
    return triggers.fire_all(WITH_TRIGGERS, "orders", "delete", triggers.delta(orders.where("o_orderstatus = 'O'"), None), tables)["totals"]


QUERIES["q_trigger_delete"] = q_trigger_delete
ORACLE_SQL["q_trigger_delete"] = "SELECT o_orderkey AS custkey, 'old' AS state FROM orders WHERE o_orderstatus <> 'O'"

_P = Expression("parameter", "key")
ROUTINES = Schema(
    (Table("nation", (Column("n_nationkey", Type("integer")), Column("n_name", Type("text")), Column("n_regionkey", Type("integer")))),),
    (), (), (), (),
    (
        Routine("add", (Parameter("key", Type("integer")), Parameter("name", Type("text"))), (Action("insert", "nation", (Assignment("n_nationkey", _P), Assignment("n_name", Expression("parameter", "name")), Assignment("n_regionkey", Expression("integer", "1")))),)),
        Routine("rename", (Parameter("key", Type("integer")), Parameter("name", Type("text"))), (Action("update", "nation", (Assignment("n_name", Expression("parameter", "name")),), Expression("gte", args=(Expression("column", "n_nationkey"), _P))),)),
        Routine("drop", (Parameter("key", Type("integer")),), (Action("delete", "nation", (), Expression("eq", args=(Expression("column", "n_regionkey"), _P))),)),
    ),
)


def _routine(routine: str, /, **given: tuple[str, str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        (nation,) = _read(spark, sf_dir, "nation")
        return routines.call(ROUTINES, {"nation": nation}, routine, given)["nation"]

    return run


QUERIES["q_routine_insert"] = _routine("add", key=("integer", "1000"), name=("text", "it's new"))
ORACLE_SQL["q_routine_insert"] = "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 1000, 'it''s new', 1"
QUERIES["q_routine_update"] = _routine("rename", key=("integer", "20"), name=("text", "later"))
ORACLE_SQL["q_routine_update"] = "SELECT n_nationkey, CASE WHEN n_nationkey >= 20 THEN 'later' ELSE n_name END AS n_name, n_regionkey FROM nation"
QUERIES["q_routine_delete"] = _routine("drop", key=("integer", "2"))
ORACLE_SQL["q_routine_delete"] = "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 2"

# --------------------------------------------------------------------------- search


def q_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    (documents,) = _read(spark, sf_dir, "documents")
    return search.search(documents, "doc_id", ["text"], "The, OF and")


QUERIES["q_search_text"] = q_search_text
ORACLE_SQL["q_search_text"] = r"SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), ['the', 'of', 'and'])"


def q_search_multi_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    (parts,) = _read(spark, sf_dir, "part")
    return search.search(parts, "p_partkey", ["p_name", "p_brand", "p_type"], "brand 2 RING")


QUERIES["q_search_multi_col"] = q_search_multi_col
ORACLE_SQL["q_search_multi_col"] = r"SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE list_has_all(regexp_split_to_array(lower(concat_ws(' ', p_name, p_brand, p_type)), '[^\p{L}\p{N}]+'), ['brand', '2', 'ring'])"

# --------------------------------------------------------------------------- canonical values and digests


def q_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = _read(spark, sf_dir, "events")
    return events.select("event_id", value_text(F.col("props"), events.schema["props"].dataType, Type("json")).alias("props"))


QUERIES["q_canonical_json"] = q_canonical_json
ORACLE_SQL["q_canonical_json"] = "SELECT event_id, replace(props, ' ', '') AS props FROM events"


def q_canonical_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = _read(spark, sf_dir, "orders")
    events = _read(spark, sf_dir, "events")[0]
    one = orders.select(F.col("o_orderkey").alias("id"), value_text(F.col("o_orderdate"), orders.schema["o_orderdate"].dataType, Type("timestamp")).alias("text"))
    return one.unionByName(events.select(F.col("event_id").alias("id"), value_text(F.col("ts"), events.schema["ts"].dataType, Type("timestamp")).alias("text")))


QUERIES["q_canonical_timestamp"] = q_canonical_timestamp
ORACLE_SQL["q_canonical_timestamp"] = r"""
    SELECT o_orderkey AS id, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ') AS text FROM orders
    UNION ALL
    SELECT event_id, regexp_replace(regexp_replace(strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%f'), '0+$', ''), '\.$', '') || 'Z' FROM events"""


def q_canonical_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = _read(spark, sf_dir, "events")
    return events.select("event_id", value_text(F.col("value"), events.schema["value"].dataType, Type("float")).alias("text"))


#: The shortest digits of a double as DuckDB prints them; canonical text has no ".0" and exponents beyond 10^-4 and 10^5 only.
_SHORTEST = r"CASE WHEN {0} = 0 THEN '0' WHEN abs({0}) >= 1e-4 AND abs({0}) < 1e6 THEN regexp_replace(CAST({0} AS VARCHAR), '\.0$', '') ELSE regexp_replace(regexp_replace(format('{{:e}}', {0}), '0+e', 'e'), '\.e', 'e') END"

QUERIES["q_canonical_float"] = q_canonical_float
ORACLE_SQL["q_canonical_float"] = f"SELECT event_id, {_SHORTEST.format('value')} AS text FROM events"


def q_canonical_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all vectors; numbers at places where DuckDB prints no exponent are compared, the others read back."""
    (vectors,) = _read(spark, sf_dir, "embeddings")
    text = value_text(F.col("embedding"), vectors.schema["embedding"].dataType, Type("vector", (64,)))
    parts = F.split(F.substring(text, F.lit(2), F.length(text) - 2), ",")
    plain = F.transform(F.arrays_zip(parts.alias("t"), F.col("embedding").alias("v")), lambda x: F.when(F.abs(x["v"]) >= 1e-4, x["t"]).otherwise(F.when(x["t"].cast("double") == x["v"].cast("double"), "small").otherwise("wrong")))
    return vectors.select("vec_id", F.concat(F.lit("["), F.concat_ws(",", plain), F.lit("]")).alias("text"))


QUERIES["q_canonical_vector"] = q_canonical_vector
ORACLE_SQL["q_canonical_vector"] = r"SELECT vec_id, '[' || array_to_string([CASE WHEN abs(x) >= CAST(1e-4 AS DOUBLE) THEN regexp_replace(CAST(CAST(x AS DOUBLE) AS VARCHAR), '\.0$', '') ELSE 'small' END for x in embedding], ',') || ']' AS text FROM embeddings"

ORDER_TEXTS = Table("orders", (Column("o_orderkey", Type("integer")), Column("o_orderpriority", Type("text"), True), Column("o_custkey", Type("integer"))), (Constraint("primary_key", ("o_orderkey",)),))


def q_digest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = _read(spark, sf_dir, "orders")
    return table_digest(canonical(orders, ORDER_TEXTS), ORDER_TEXTS)


QUERIES["q_digest_table"] = q_digest_table
_HASHES = "SELECT sha256('V' || length(CAST(o_custkey AS VARCHAR)) || ':' || o_custkey || ';V' || length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey || ';V' || strlen(o_orderpriority) || ':' || o_orderpriority || ';') AS h FROM orders"
ORACLE_SQL["q_digest_table"] = f"SELECT count(*) AS n_rows, {', '.join(f'CAST(sum(CAST(CAST((chr(48) || chr(120) || substr(h, {1 + 15 * i}, 15)) AS BIGINT) AS DECIMAL(38,0))) AS DECIMAL(38,0)) AS part{i + 1}' for i in range(4))} FROM ({_HASHES})"


def _verdict(changed: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        (orders,) = _read(spark, sf_dir, "orders")
        table = Table("orders", (Column("o_orderkey", Type("integer")), Column("o_orderstatus", Type("text"))))
        one = canonical(orders, table)
        other = one.repartition(5, "o_orderstatus")
        if changed:
            other = other.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == 1, "?").otherwise(F.col("o_orderstatus")))
        two = table_digest(other, table).toDF("n2", *(f"q{i}" for i in range(1, 5)))
        equal = (F.col("n_rows") == F.col("n2")) & (F.col("part1") == F.col("q1")) & (F.col("part2") == F.col("q2")) & (F.col("part3") == F.col("q3")) & (F.col("part4") == F.col("q4"))
        return table_digest(one, table).crossJoin(two).select(F.col("n_rows"), equal.alias("equivalent"))

    return run


QUERIES["q_verify_equal"] = _verdict(False)
ORACLE_SQL["q_verify_equal"] = "SELECT count(*) AS n_rows, TRUE AS equivalent FROM orders"
QUERIES["q_verify_diverged"] = _verdict(True)
ORACLE_SQL["q_verify_diverged"] = "SELECT count(*) AS n_rows, count(*) FILTER (o_orderkey = 1) = 0 AS equivalent FROM orders"

# --------------------------------------------------------------------------- capture and replay

SOURCE = Target("sqlite", Version(3, 45, 0))
KEYED = Schema((Table("orders", (Column("o_orderkey", Type("integer")), Column("o_custkey", Type("integer"), True), Column("o_orderstatus", Type("text"), True)), (Constraint("primary_key", ("o_orderkey",)),)),))


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders before and after: every seventh deleted, every fifth changed, some new ones."""
    (orders,) = _read(spark, sf_dir, "orders")
    old = orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    kept = old.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "N").otherwise(F.col("o_orderstatus")))
    new = old.where("o_orderkey % 11 = 0").select((F.col("o_orderkey") + 10_000_000).alias("o_orderkey"), F.lit(None).cast("bigint").alias("o_custkey"), "o_orderstatus")
    return old, kept.unionByName(new)


_AFTER = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0
    UNION ALL SELECT o_orderkey + 10000000, NULL, o_orderstatus FROM orders WHERE o_orderkey % 11 = 0"""


def _journal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old, new = _states(spark, sf_dir)
    # A journal is stored before it is replayed.
    return old, written(journals.capture(KEYED, KEYED.tables[0], old, new, SOURCE), "journal")


def q_capture_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, changes = _journal(spark, sf_dir)
    key = F.col("primary_key")["o_orderkey"]["value"].cast("bigint")
    return changes.select(key.alias("o_orderkey"), "kind", F.col("before")["o_orderstatus"]["value"].alias("was"), F.col("after")["o_orderstatus"]["value"].alias("now"))


QUERIES["q_capture_diff"] = q_capture_diff
ORACLE_SQL["q_capture_diff"] = f"""
    WITH a AS ({_AFTER})
    SELECT coalesce(o.o_orderkey, a.o_orderkey) AS o_orderkey,
      CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN a.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS kind,
      o.o_orderstatus AS was, a.o_orderstatus AS now
    FROM orders o FULL JOIN a ON o.o_orderkey = a.o_orderkey
    WHERE o.o_orderkey IS NULL OR a.o_orderkey IS NULL OR o.o_orderstatus IS DISTINCT FROM a.o_orderstatus"""


def _replayed(tolerant: bool, twice: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        old, changes = _journal(spark, sf_dir)
        # A tolerant replay starts from a state to which every second order's change has come already.
        here = F.col("o_orderkey") % 2 == 0
        start = _states(spark, sf_dir)[1].where(here).unionByName(old.where(~here)) if tolerant else old
        empty = spark.createDataFrame([], replay.LEDGER)
        done = replay.apply_typed(KEYED, {"orders": start}, changes, empty, tolerant)
        if twice:
            done = replay.apply_typed(KEYED, done.tables, changes, done.ledger, False)
        return done.tables["orders"]

    return run


for _name, _query in (("q_replay_strict", _replayed(False, False)), ("q_replay_tolerant", _replayed(True, False)), ("q_replay_idempotent", _replayed(False, True))):
    QUERIES[_name] = _query
    ORACLE_SQL[_name] = _AFTER


def q_replay_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose change doesn't fit a destination in which every third order differs."""
    old, changes = _journal(spark, sf_dir)
    other = old.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "?").otherwise(F.col("o_orderstatus")))
    table = KEYED.tables[0]
    outcome = replay.checked(replay.events(changes, table), canonical(other, table), table, False)
    return outcome.where("NOT fine").select(F.col("key")[0].cast("bigint").alias("o_orderkey"), F.col("expected")[2].alias("expected"), F.col("found")[2].alias("found"))


QUERIES["q_replay_conflict"] = q_replay_conflict
ORACLE_SQL["q_replay_conflict"] = "SELECT o_orderkey, o_orderstatus AS expected, '?' AS found FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus <> '?' AND (o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 AND o_orderstatus <> 'N')"

# --------------------------------------------------------------------------- stores and streams


def _folder(spark: SparkSession) -> str:
    """A new folder that the cluster shares."""
    return f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}"


def q_snapshot_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after it went through a canonical snapshot into another store."""
    old, _ = _states(spark, sf_dir)
    folder = _folder(spark)
    source, copy = Store(spark, f"{folder}/a", SOURCE), Store(spark, f"{folder}/b", Target("postgres", Version(17)))
    source.put_tables(KEYED, {"orders": old})
    copy.import_snapshot(source.export_snapshot(KEYED))
    return copy.table("orders")


QUERIES["q_snapshot_copy"] = q_snapshot_copy
ORACLE_SQL["q_snapshot_copy"] = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"


def q_stream_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after a stream of all captured changes has been drained into it."""
    old, changes = _journal(spark, sf_dir)
    folder = _folder(spark)
    store = Store(spark, f"{folder}/a", Target("postgres", Version(17)))
    store.put_tables(KEYED, {"orders": old})
    changes.write.parquet(f"{folder}/in")
    replay_stream(journal_stream(spark, f"{folder}/in", 1 << 20), store, KEYED, f"{folder}/check").awaitTermination()
    return store.table("orders")


QUERIES["q_stream_drain"] = q_stream_drain
ORACLE_SQL["q_stream_drain"] = _AFTER

# --------------------------------------------------------------------------- audit and inspection


def q_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("tables", "json", "views", "canonical_views", "lateral")
    return spark.createDataFrame([(f.feature, f.status, f.reason) for f in map(assess, wanted)], "feature string, status string, reason string")


QUERIES["q_audit"] = q_audit
ORACLE_SQL["q_audit"] = "SELECT * FROM (VALUES ('tables','exact',''),('json','exact','lossless canonical text representation'),('views','unknown','requires parser and semantic compiler'),('canonical_views','exact',''),('lateral','unknown','feature is not in the compatibility catalog')) t(feature, status, reason)"


def q_infer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(f,) for f in infer(_family("cascade"))], "feature string")


QUERIES["q_infer_features"] = q_infer_features
ORACLE_SQL["q_infer_features"] = "SELECT * FROM (VALUES ('tables'),('canonical_full_text'),('primary_keys'),('canonical_foreign_keys')) t(feature)"


def q_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of the columns of all tables."""
    tables = _Tables(spark, sf_dir)
    found = inspect_frames({n: tables[n] for n in NAMES})
    return spark.createDataFrame([(t.name, c.name, c.type.family) for t in found.schema.tables for c in t.columns], "table_name string, column_name string, family string")


QUERIES["q_inspect"] = q_inspect
ORACLE_SQL["q_inspect"] = f"""
    SELECT table_name, column_name, CASE WHEN data_type LIKE '%[%' THEN 'vector' WHEN data_type LIKE '%INT%' THEN 'integer' WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'float' WHEN data_type LIKE 'DECIMAL%' THEN 'decimal'
      WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp' WHEN data_type = 'DATE' THEN 'date' WHEN data_type = 'VARCHAR' THEN 'text' ELSE lower(data_type) END AS family
    FROM information_schema.columns WHERE table_name IN ({', '.join(f"'{n}'" for n in NAMES)})"""

DDL = (
    "CREATE TABLE items (id INTEGER PRIMARY KEY, code TEXT NOT NULL UNIQUE, price NUMERIC(10,2) DEFAULT 3 CHECK (price >= 0), total INTEGER GENERATED ALWAYS AS (id * 2) STORED)",
    "CREATE UNIQUE INDEX by_code ON items (lower(code), price DESC) WHERE price > 1",
    "CREATE VIEW cheap AS SELECT id, code FROM items WHERE price < 5",
    "CREATE VIEW broken AS SELECT * FROM items",
)


def q_inspect_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inspect_ddl(DDL)
    rows = [("table", t.name) for t in found.schema.tables] + [("index", i.name) for i in found.schema.indexes] + [("view", v.name) for v in found.schema.views] + [("unresolved", u.name) for u in found.unresolved]
    return spark.createDataFrame(rows, "kind string, name string")


QUERIES["q_inspect_ddl"] = q_inspect_ddl
ORACLE_SQL["q_inspect_ddl"] = "SELECT * FROM (VALUES ('table','items'),('index','by_code'),('view','cheap'),('unresolved','broken')) t(kind, name)"

# --------------------------------------------------------------------------- stores, journals, inspection and the command line

from plumbline import catalogue_stores  # noqa: E402

QUERIES |= catalogue_stores.QUERIES
ORACLE_SQL |= catalogue_stores.ORACLE_SQL
