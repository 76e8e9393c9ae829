import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.errors import ValueFormatError
from plumbline.functions import canonical as c
from plumbline.operators import digest
from plumbline.plans.model import Column, Schema, Table, Type


@pytest.mark.parametrize(
    "value,text",
    [(0.0, "0"), (-0.0, "-0"), (1.0, "1"), (1.5, "1.5"), (0.1, "0.1"), (100000.0, "100000"), (123456.0, "123456"), (1e6, "1e+06"), (1234567.0, "1.234567e+06"), (1e21, "1e+21"), (0.0001, "0.0001"), (0.00001, "1e-05"), (-2.5e-7, "-2.5e-07"), (1e100, "1e+100"), (12345.678, "12345.678"), (5e-324, "5e-324")],
)
def test_float_texts(value, text):
    assert c.float_text(value) == text


@settings(max_examples=500, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_float_texts_read_back(value):
    assert struct.pack("<d", float(c.float_text(value))) == struct.pack("<d", value)


def test_floats_without_a_form():
    for bad in (float("nan"), float("inf")):
        with pytest.raises(ValueFormatError):
            c.float_text(bad)


def test_json_texts():
    assert c.json_text(' {"b": 1.50, "a": [1e2, 123456789012345678901234567890, "é\\u0000", null, true]} ') == '{"a":[1e2,123456789012345678901234567890,"é\\u0000",null,true],"b":1.50}'
    assert c.json_text("{}") == "{}" and c.json_text("[]") == "[]" and c.json_text('{"a":1,"a":2}') == '{"a":2}'
    for bad in ("", "{} {}", "{'a':1}", "NaN", "[1,]", "[Infinity]"):
        with pytest.raises(ValueFormatError):
            c.json_text(bad)


def column(spark, values, kind, family):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", kind)]))
    return [r[0] for r in df.select(c.value_text(F.col("v"), kind, family)).collect()]


def test_columns_of_every_family(spark):
    from decimal import Decimal

    text = T.StringType()
    assert column(spark, ["T", "1", "true", "yes", None], text, Type("boolean")) == ["true", "true", "true", "false", None]
    assert column(spark, [True, False], T.BooleanType(), Type("boolean")) == ["true", "false"]
    assert column(spark, [1, -5, None], T.LongType(), Type("integer")) == ["1", "-5", None]
    assert column(spark, ["1.50", "007", "\x01real2.5"], text, Type("decimal")) == ["1.50", "007", "2.5"]
    assert column(spark, [Decimal("1.50")], T.DecimalType(10, 2), Type("decimal", (10, 2))) == ["1.50"]
    assert column(spark, [1.0, None, 1e21, 0.1], T.DoubleType(), Type("float")) == ["1", None, "1e+21", "0.1"]
    assert column(spark, [b"\x00\x01\xff", None], T.BinaryType(), Type("binary")) == ["AAH/", None]
    assert column(spark, ["2020-01-01", "as is"], text, Type("date")) == ["2020-01-01", "as is"]
    assert column(spark, ["AB-cd"], text, Type("uuid")) == ["AB-cd"]
    assert column(spark, ['{"b":1, "a":2}', None], text, Type("json")) == ['{"a":2,"b":1}', None]
    assert column(spark, [[1.0, 2.5], None], T.ArrayType(T.DoubleType()), Type("vector", (2,))) == ["[1,2.5]", None]
    assert column(spark, ["[1, 2.0,3]", " [ ] "], text, Type("vector")) == ["[1,2,3]", "[]"]
    for bad, kind, family in (("[1]", text, Type("vector", (3,))), ("1,2", text, Type("vector")), (float("nan"), T.DoubleType(), Type("float")), ("{", text, Type("json")), ("yesterday", text, Type("timestamp"))):
        with pytest.raises(Exception):
            column(spark, [bad], kind, family)


def test_timestamps(spark):
    given_ = {
        "2026-07-22T12:34:56.123456789-06:00": "2026-07-22T18:34:56.123456789Z", "2026-07-22T23:59:59Z": "2026-07-22T23:59:59Z", "2026-01-01 00:30:00+02": "2025-12-31T22:30:00Z",
        "2026-01-01 00:30:00.100": "2026-01-01T00:30:00.1Z", "1969-12-31 23:00:00-01:30": "1970-01-01T00:30:00Z", "2024-02-29T00:00:00.000000000Z": "2024-02-29T00:00:00Z",
    }
    assert column(spark, list(given_), T.StringType(), Type("timestamp")) == list(given_.values())
    for bad in ("2026-07-22T12:34:56", "2026-07-22T12:34:56+02", "2026-13-01 00:00:00", "2026-01-01 24:00:00", "2026-01-01", "2026-01-01 00:00:00 +02:00"):
        with pytest.raises(Exception):
            column(spark, [bad], T.StringType(), Type("timestamp"))
    df = spark.sql("SELECT TIMESTAMP '2024-01-02 03:04:05.120' AS v, TIMESTAMP_NTZ '2024-01-02 03:04:05' AS w, DATE '2024-01-02' AS d")
    got = df.select(*(c.value_text(F.col(n), df.schema[n].dataType, Type("timestamp")) for n in "vwd")).first()
    assert tuple(got) == ("2024-01-02T03:04:05.12Z", "2024-01-02T03:04:05Z", "2024-01-02T00:00:00Z")


TABLE = Table("t", (Column("id", Type("integer")), Column("name", Type("text"), True), Column("v", Type("vector"), True), Column("raw", Type("binary"), True), Column("ok", Type("boolean"), True), Column("x", Type("float"), True)))


def frame(spark):
    rows = [(1, "áéí 🚀", [1.0, 2.0], b"\x00\xff", True, 1.5), (2, None, None, None, False, None), (2, None, None, None, False, None)]
    return spark.createDataFrame(rows, "id bigint, name string, v array<double>, raw binary, ok boolean, x double")


def test_round_trip(spark):
    df = frame(spark)
    texts = c.canonical(df, TABLE)
    back = c.typed(texts, TABLE)
    assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0
    assert digest.differences(texts, c.canonical(back, TABLE)).count() == 0


def test_digest_ignores_order_and_counts_repeats(spark):
    schema = Schema((TABLE,))
    texts = c.canonical(frame(spark), TABLE)
    one = digest.snapshot_digest(schema, {"t": texts})
    assert one == digest.snapshot_digest(schema, {"t": texts.repartition(3).orderBy(F.desc("id"))})
    assert one != digest.snapshot_digest(schema, {"t": texts.distinct()})
    assert one != digest.snapshot_digest(schema, {"t": texts.withColumn("name", F.coalesce("name", F.lit("")))})
    assert one != digest.snapshot_digest(schema, {"t": texts.limit(0)})
    report = digest.verify(schema, {"t": texts}, {"t": texts.unionByName(texts)})
    assert not report.equivalent
    with pytest.raises(Exception):
        digest.require_equivalent(report)
