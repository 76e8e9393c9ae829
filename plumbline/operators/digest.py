"""Digests of tables and snapshots that don't depend on the order of rows.

A row's hash is SHA-256 over its canonical values. A table's digest holds the
number of rows and the sums of four 60-bit pieces of these hashes: sums, so
that partial aggregation does nearly all the work and repeated rows count (with
XOR they would cancel). One row per task goes through the network.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.errors import PlumblineError
from plumbline.functions.canonical import canonical
from plumbline.functions.scalar import quoted
from plumbline.plans.model import Schema, Table, always, dumps

PIECES = 4


def row_hash(table: Table) -> Column:
    """SHA-256 of a canonical row: for each column N for NULL, else V, length, text."""
    parts = []
    for c in sorted(table.columns, key=lambda c: c.name):
        text = quoted(c.name)
        parts.append(F.when(text.isNull(), "N;").otherwise(F.concat(F.lit("V"), F.octet_length(text).cast("string"), F.lit(":"), text, F.lit(";"))))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def table_digest(texts: DataFrame, table: Table) -> DataFrame:
    """One row: n_rows and the sums part1 to part4 over canonical rows."""
    hashes = texts.select(row_hash(table).alias("hash"))
    sums = [F.coalesce(F.sum(F.conv(F.substring("hash", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias(f"part{i + 1}") for i in range(PIECES)]
    return hashes.agg(F.count(F.lit(1)).alias("n_rows"), *sums)


@dataclass(frozen=True)
class Report:
    source_digest: str = always("")
    destination_digest: str = always("")
    equivalent: bool = always(False)


def snapshot_digest(schema: Schema, tables: Mapping[str, DataFrame]) -> str:
    """SHA-256 over the schema and the digest of every canonical table."""
    whole = hashlib.sha256(dumps(schema).encode())
    for table in sorted(schema.tables, key=lambda t: t.name):
        row = table_digest(tables[table.name], table).first()
        whole.update(f"\n{table.name}\n{row['n_rows']}".encode())
        for i in range(PIECES):
            whole.update(f" {row[f'part{i + 1}']:f}".encode())
    return whole.hexdigest()


def verify(schema: Schema, source: Mapping[str, DataFrame], destination: Mapping[str, DataFrame]) -> Report:
    one, two = snapshot_digest(schema, source), snapshot_digest(schema, destination)
    return Report(one, two, one == two)


def require_equivalent(report: Report) -> None:
    if not report.equivalent:
        raise PlumblineError(f"the destination differs: its digest is {report.destination_digest}, the source's {report.source_digest}")


def differences(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Rows that only one side has, each as often as it is missing on the other."""
    left = source.exceptAll(destination).withColumn("side", F.lit("source"))
    return left.unionByName(destination.exceptAll(source).withColumn("side", F.lit("destination")))


def canonical_tables(schema: Schema, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    return {t.name: canonical(tables[t.name], t) for t in schema.tables}
