"""Canonical text of values, one column expression for each type family.

A canonical value is a kind and a text. Only the shortest form of floats and
the rewriting of JSON need Python; both work on Arrow batches. Everything else
is built from Spark functions, and none depends on the session's time zone.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.errors import SchemaError, ValueFormatError
from plumbline.functions.scalar import quoted
from plumbline.plans.model import Column as ModelColumn
from plumbline.plans.model import Table, Type

#: Fixed value: what stood before a decimal that was stored as a real number.
REAL_MARKER = "\x01real"

CARRIER = {"boolean": T.BooleanType(), "integer": T.LongType(), "float": T.DoubleType(), "binary": T.BinaryType()}


def carrier(kind: Type) -> T.DataType:
    """The Spark type that holds a family without loss: text where nothing else does."""
    if kind.family == "vector":
        return T.ArrayType(T.DoubleType())
    return CARRIER.get(kind.family, T.StringType())


def family_of(kind: T.DataType) -> Type | None:
    """The family of a Spark type; None if there is none."""
    if isinstance(kind, T.BooleanType):
        return Type("boolean")
    if isinstance(kind, T.IntegralType):
        return Type("integer")
    if isinstance(kind, T.DecimalType):
        return Type("decimal", (kind.precision, kind.scale))
    if isinstance(kind, T.FractionalType):
        return Type("float")
    if isinstance(kind, T.StringType):
        return Type("text")
    if isinstance(kind, T.BinaryType):
        return Type("binary")
    if isinstance(kind, T.DateType):
        return Type("date")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return Type("timestamp")
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        return Type("vector")
    return None


# --------------------------------------------------------------------------- floats


def float_text(value: float) -> str:
    """The shortest digits that read back as the value, with an exponent if that is
    under -4 or over 5."""
    if math.isnan(value) or math.isinf(value):
        raise ValueFormatError(f"{value} has no canonical form")
    if value == 0:
        return "-0" if math.copysign(1, value) < 0 else "0"
    digits, _, power = f"{abs(value)!r}".partition("e")
    whole, _, part = digits.partition(".")
    exponent = int(power or 0) + len(whole) - 1
    digits = (whole + part).lstrip("0")
    if whole == "0":
        exponent -= 1 + len(part) - len(part.lstrip("0"))
    digits = digits.rstrip("0") or "0"
    sign = "-" if value < 0 else ""
    if exponent < -4 or exponent > 5:
        mantissa = digits[0] + ("." + digits[1:] if len(digits) > 1 else "")
        return f"{sign}{mantissa}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"
    if exponent < 0:
        return f"{sign}0.{'0' * (-exponent - 1)}{digits}"
    if len(digits) <= exponent + 1:
        return sign + digits + "0" * (exponent + 1 - len(digits))
    return f"{sign}{digits[: exponent + 1]}.{digits[exponent + 1 :]}"


@F.pandas_udf(T.StringType())
def _float_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in batches:
        yield pd.Series([None if pd.isna(v) and not isinstance(v, float) else float_text(v) if v is not None else None for v in values.astype(object)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _vector_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in batches:
        yield pd.Series([None if v is None else [float_text(float(x)) for x in v] for v in values], dtype=object)


def float_value(column: Column) -> Column:
    # NaN and NULL look alike once they are in pandas: tell them apart before.
    bad = F.isnan(column) | (F.abs(column) == F.lit(float("inf")))
    checked = F.when(bad, F.raise_error(F.lit("NaN and infinity have no canonical form")).cast("double")).otherwise(column)
    return F.when(column.isNotNull(), _float_texts(F.coalesce(checked, F.lit(0.0))))


# --------------------------------------------------------------------------- JSON


class _Number(str):
    """Digits of a number as they were written."""


def _dump(value: object, out: list[str]) -> None:
    if isinstance(value, _Number):
        out.append(str(value))
    elif isinstance(value, dict):
        out.append("{")
        for i, key in enumerate(sorted(value, key=lambda k: k.encode("utf-8", "surrogatepass"))):
            out.append(("," if i else "") + json.dumps(key, ensure_ascii=False) + ":")
            _dump(value[key], out)
        out.append("}")
    elif isinstance(value, list):
        out.append("[")
        for i, item in enumerate(value):
            if i:
                out.append(",")
            _dump(item, out)
        out.append("]")
    else:
        out.append(json.dumps(value, ensure_ascii=False))


def json_text(text: str) -> str:
    """One document with sorted keys, without spaces, numbers digit by digit."""
    try:
        value = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_constant)
    except ValueError as error:
        raise ValueFormatError(f"not one JSON document: {error}") from error
    out: list[str] = []
    _dump(value, out)
    return "".join(out)


def _constant(name: str) -> object:
    raise ValueError(f"{name} is not JSON")


@F.pandas_udf(T.StringType())
def json_value(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in batches:
        yield pd.Series([None if v is None else json_text(v) for v in values], dtype=object)


# --------------------------------------------------------------------------- times

TIMESTAMP = r"^(\d{4}-\d\d-\d\d)([T ])(\d\d):(\d\d):(\d\d)(?:[.,](\d{1,9}))?(Z|[+-]\d\d:\d\d|[+-]\d\d)?$"


def _clock(day: Column, seconds: Column, fraction: Column) -> Column:
    """Text in UTC of a day plus seconds and the digits of a fraction."""
    shifted = F.date_add(day, F.floor(seconds / 86_400).cast("int"))
    left = F.pmod(seconds, F.lit(86_400)).cast("int")
    digits = F.regexp_replace(fraction, "0+$", "")
    tail = F.when(digits == "", "").otherwise(F.concat(F.lit("."), digits))
    time = F.format_string("%02d:%02d:%02d", F.floor(left / 3600).cast("int"), F.floor(left % 3600 / 60).cast("int"), left % 60)
    return F.concat(shifted.cast("string"), F.lit("T"), time, tail, F.lit("Z"))


def timestamp_value(text: Column) -> Column:
    """RFC 3339 in UTC with up to nine digits of a second; no offset means UTC."""
    part = [F.regexp_extract(text, TIMESTAMP, i) for i in range(8)]
    zone = part[7]
    known = F.length(part[0]) > 0
    # With a T the offset has minutes or is Z; it may not be missing.
    known = known & ((part[2] == " ") | (F.length(zone).isin(1, 6)))
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    minutes = F.coalesce(F.substring(zone, 5, 2).try_cast("int"), F.lit(0))
    offset = F.when(F.length(zone) < 3, 0).otherwise(sign * (F.substring(zone, 2, 2).try_cast("int") * 3600 + minutes * 60))
    seconds = part[3].try_cast("int") * 3600 + part[4].try_cast("int") * 60 + part[5].try_cast("int") - offset
    day = part[1].try_cast("date")
    sane = known & day.isNotNull() & (part[3].try_cast("int") < 24) & (part[4].try_cast("int") < 60) & (part[5].try_cast("int") < 60)
    wrong = F.raise_error(F.concat(F.lit("unrecognized timestamp: "), text)).cast("string")
    return F.when(text.isNull(), F.lit(None).cast("string")).when(sane, _clock(day, seconds, part[6])).otherwise(wrong)


def native_timestamp_value(column: Column, zoned: bool) -> Column:
    """The same for Spark's own timestamps (microseconds)."""
    if not zoned:
        return timestamp_value(column.cast("string"))
    micros = F.unix_micros(column)
    seconds = F.floor(micros / 1_000_000)
    fraction = F.format_string("%06d", F.pmod(micros, F.lit(1_000_000)))
    return _clock(F.to_date(F.lit("1970-01-01")), seconds, fraction)


# --------------------------------------------------------------------------- families


def _vector(column: Column, kind: T.DataType, arguments: tuple[int, ...]) -> Column:
    if isinstance(kind, T.StringType):
        trimmed = F.trim(column)
        wrong = F.raise_error(F.concat(F.lit("invalid vector: "), column)).cast("array<double>")
        inner = F.trim(F.substring(trimmed, F.lit(2), F.greatest(F.length(trimmed) - 2, F.lit(0))))
        parts = F.when(inner == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(inner, ","), lambda x: F.trim(x).cast("double")))
        column = F.when(column.isNull(), F.lit(None).cast("array<double>")).when(trimmed.startswith("[") & trimmed.endswith("]"), parts).otherwise(wrong)
    if arguments:
        mismatch = F.raise_error(F.concat(F.lit(f"vector dimension mismatch: declared {arguments[0]}, got "), F.size(column).cast("string"))).cast("array<double>")
        column = F.when(column.isNull() | (F.size(column) == arguments[0]), column).otherwise(mismatch)
    return F.concat(F.lit("["), F.concat_ws(",", _vector_texts(column)), F.lit("]"))


def value_text(column: Column, kind: T.DataType, family: Type) -> Column:
    """Canonical text of a column of Spark type ``kind``; NULL stays NULL."""
    name = family.family
    text = column.cast("string")
    is_text = isinstance(kind, T.StringType)
    if name == "boolean":
        truth = F.lower(text).isin("1", "t", "true")
        out = F.when(truth, "true").otherwise("false")
    elif name == "decimal":
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            out = float_value(column.cast("double"))
        else:
            out = F.when(text.startswith(REAL_MARKER), F.substring(text, len(REAL_MARKER) + 1, 1 << 30)).otherwise(text) if is_text else text
    elif name == "float":
        out = float_value(column.cast("double"))
    elif name == "binary":
        out = F.base64(column)
    elif name == "timestamp":
        out = timestamp_value(text) if is_text else native_timestamp_value(column, isinstance(kind, T.TimestampType)) if not isinstance(kind, T.DateType) else timestamp_value(F.concat(text, F.lit(" 00:00:00")))
    elif name == "date":
        out = F.substring(native_timestamp_value(column, True), 1, 10) if isinstance(kind, T.TimestampType) else text
    elif name == "json":
        out = json_value(text)
    elif name == "vector":
        out = _vector(column, kind, family.arguments)
    elif name in ("integer", "text", "uuid"):
        out = text
    else:
        raise SchemaError(f"unknown type family {name!r}")
    return F.when(column.isNotNull(), out)


def typed_value(text: Column, family: Type) -> Column:
    """The carrier's value of a canonical text."""
    name = family.family
    if name == "boolean":
        return text == "true"
    if name == "integer":
        return text.cast("bigint")
    if name == "float":
        return text.cast("double")
    if name == "binary":
        return F.unbase64(text)
    if name == "vector":
        inner = F.substring(text, F.lit(2), F.length(text) - 2)
        return F.when(inner == "", F.array().cast("array<double>")).otherwise(F.split(inner, ",").cast("array<double>"))
    return text


def canonical(frame: DataFrame, table: Table) -> DataFrame:
    """Canonical texts of a table's columns, in the model's order; a missing column is an error."""
    have = {c.lower(): f for c, f in zip(frame.columns, frame.schema.fields)}
    out = []
    for column in table.columns:
        found = have.get(column.name.lower())
        if found is None:
            raise SchemaError(f"table {table.name!r} has no column {column.name!r}")
        out.append(value_text(quoted(found.name), found.dataType, column.type).alias(column.name))
    return frame.select(*out)


def typed(texts: DataFrame, table: Table, others: tuple[str, ...] = ()) -> DataFrame:
    """The reverse of canonical: columns of carrier types, after ``others`` as they are."""
    return texts.select(*others, *(typed_value(quoted(c.name), c.type).cast(carrier(c.type)).alias(c.name) for c in table.columns))


def image(columns: tuple[ModelColumn, ...], prefix: str = "") -> Column:
    """A row as a map from column to (kind, value), as journals carry it."""
    entries: list[Column] = []
    for c in columns:
        text = quoted(prefix + c.name)
        kind = F.when(text.isNull(), "null").otherwise(c.type.family)
        entries += [F.lit(c.name), F.struct(kind.alias("kind"), text.alias("value"))]
    return F.create_map(*entries)


def image_text(images: Column, columns: tuple[ModelColumn, ...]) -> Column:
    """An image as the JSON text that journals of other programs carry: an object of texts,
    binary in upper-case hex, NULL as null."""

    def text(c: ModelColumn) -> Column:
        value = images[c.name]["value"]
        return F.hex(F.unbase64(value)) if c.type.family == "binary" else value

    fields = F.struct(*(text(c).alias(c.name) for c in columns))
    return F.when(images.isNotNull(), F.to_json(fields, {"ignoreNullFields": "false"}))


def image_of_text(text: Column, columns: tuple[ModelColumn, ...], whole: bool = True) -> Column:
    """The reverse of image_text: values are brought into canonical form on the way.

    A text that isn't a JSON object of texts is an error, and so is a column that is
    missing (but for ``whole=False``, as in the image of a key) or not of the table.
    """
    given = F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})
    names = F.array(*(F.lit(c.name) for c in columns))
    strange = F.array_except(F.map_keys(given), names)
    missing = F.array_except(names, F.map_keys(given))

    def failed(reason: str, what: Column) -> Column:
        return F.raise_error(F.concat(F.lit(f"invalid row image, {reason}: "), what)).cast("map<string,string>")

    # Arguments of Python functions are computed for every row: a NULL text must fail nothing.
    checked = F.when(text.isNotNull() & given.isNull(), failed("not a JSON object", text)).when(F.size(strange) > 0, failed("unknown columns", F.array_join(strange, ", ")))
    if whole:
        checked = checked.when(F.size(missing) > 0, failed("missing columns", F.array_join(missing, ", ")))
    held = checked.otherwise(given)
    entries: list[Column] = []
    for c in columns:
        value = held[c.name]
        if c.type.family == "binary":
            value = F.base64(F.unhex(value))
        elif c.type.family != "text":
            kind = {"float": T.DoubleType(), "vector": T.StringType()}.get(c.type.family, T.StringType())
            value = value_text(value.cast(kind), kind, c.type)
        entries.append(F.struct(F.lit(c.name).alias("key"), F.struct(F.when(value.isNull(), "null").otherwise(c.type.family).alias("kind"), value.alias("value")).alias("value")))
    every = F.map_from_entries(F.array(*entries))
    return F.when(text.isNotNull(), every if whole else F.map_filter(every, lambda k, _: F.array_contains(F.map_keys(held), k)))
