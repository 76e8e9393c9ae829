"""A store: versioned Parquet tables, their schema, a ledger and a journal.

``_state`` holds one small file for each version, numbered; the highest counts. It
lists the folders of all tables. A change writes new folders and then the next
number, which fails if another writer has written it since the state was read: two
writers never undo each other's commits, one of them gets an error and reads again.
Readers see either the old or the new state, never a mixture, and an executor or the
driver lost on the way leaves the old one. Files go through Hadoop's file system, so
a store can be wherever Spark can read and write.

A table is a base and a few layers over it. A layer holds the keys that a change
touched, each with its new row or none, so that what is written follows the number
of changes, not the size of the table. A reader takes the last layer's row of each
key. Beyond MOST_LAYERS the layers are merged into one; ``compact`` makes a new base.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import PlumblineError, SchemaError
from plumbline.functions.canonical import canonical, carrier, typed
from plumbline.functions.scalar import quoted
from plumbline.operators import constraints, routines
from plumbline.operators.digest import Report, verify
from plumbline.operators.select import Queries
from plumbline.plans.model import Schema, Table, Target, dumps, loads
from plumbline.plans.validate import validate
from plumbline.streaming import journal as journals
from plumbline.streaming import replay

STATE = "_state"
#: Layers of a table that are read one by one, and versions of the state that stay.
MOST_LAYERS, OLD_STATES = 8, 20


@dataclass
class Snapshot:
    """A schema and canonical texts of all its tables."""

    schema: Schema
    tables: dict[str, DataFrame]


class Store:
    def __init__(self, spark: SparkSession, path: str, target: Target) -> None:
        target.validate()
        self.spark, self.path, self.target = spark, path.rstrip("/"), target

    # -- files

    def _file(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str:
        path, fs = self._file(name)
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _versions(self) -> list[int]:
        path, fs = self._file(STATE)
        if not fs.exists(path):
            return []
        names = (f.getPath().getName() for f in fs.listStatus(path))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _add(self, number: int, text: str) -> None:
        """Write the state of this number, or fail if there is one."""
        new, fs = self._file(f"{STATE}/{uuid.uuid4().hex}.new")
        stream = fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        place, _ = self._file(f"{STATE}/{number:012d}.json")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration())
        try:  # a rename without overwriting: the second of two fails
            context.rename(new, place, self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except (Py4JJavaError, PySparkException) as error:
            fs.delete(new, False)
            raise PlumblineError("the store has changed meanwhile") from error
        for old in self._versions()[:-OLD_STATES]:
            fs.delete(self._file(f"{STATE}/{old:012d}.json")[0], False)

    # -- state

    def _current(self) -> dict:
        numbers = self._versions()
        if not numbers:
            return {"number": 0, "tables": {}, "schema": None, "ledger": [], "journal": [], "sequence": 0}
        return json.loads(self._read(f"{STATE}/{numbers[-1]:012d}.json"))

    def schema(self) -> Schema | None:
        """The schema that was stored with the data."""
        text = self._current()["schema"]
        return None if text is None else loads(Schema, text)

    def names(self) -> list[str]:
        return sorted(self._current()["tables"])

    def exists(self, table: str) -> bool:
        return table in self._current()["tables"]

    def table(self, table: Table | str, now: dict | None = None) -> DataFrame:
        """A table's typed rows."""
        name = table if isinstance(table, str) else table.name
        now = self._current() if now is None else now
        held = now["tables"].get(name)
        if held is None:
            raise SchemaError(f"table {name!r} is not in the store")
        base = self.spark.read.parquet(*(f"{self.path}/{f}" for f in held["base"]))
        if not held["layers"]:
            return base
        return replay.merged(base, self._layers(held["layers"]), loads(Schema, now["schema"]).table(name))

    def _layers(self, folders: list[str]) -> DataFrame:
        """(_key, _row) of some layers: of each key the last."""
        if len(folders) == 1:
            return self.spark.read.parquet(f"{self.path}/{folders[0]}")
        each = [self.spark.read.parquet(f"{self.path}/{f}").withColumn("_layer", F.lit(i)) for i, f in enumerate(folders)]
        whole = each[0]
        for more in each[1:]:
            whole = whole.unionByName(more)
        return whole.groupBy("_key").agg(F.max_by(F.struct("_row"), "_layer").alias("last")).select("_key", "last._row")

    def tables(self, schema: Schema, now: dict | None = None) -> dict[str, DataFrame]:
        now = self._current() if now is None else now
        return {t.name: self.table(t, now) for t in schema.tables}

    def count(self, table: str) -> int:
        return self.table(table).count()

    def queries(self, schema: Schema) -> Queries:
        return Queries.of(schema, self.tables(schema))

    def lookup(self, table: Table, keys: DataFrame) -> DataFrame:
        """Rows with these primary keys, NULLs included: a null-safe semi-join."""
        frame = self.table(table)
        wanted = keys.toDF(*(f"k{i}" for i in range(len(table.primary_key))))
        on = [quoted(c).eqNullSafe(quoted(f"k{i}")) for i, c in enumerate(table.primary_key)]
        return frame.join(wanted, on, "left_semi")

    # -- commits

    def _commit(self, now: dict, changed: Mapping[str, DataFrame], deltas: Mapping[str, DataFrame] | None = None, added: Mapping[str, DataFrame] | None = None, **more: object) -> None:
        """The version after ``now``: tables replaced by ``changed``, touched by ``deltas`` (_key, _row), or with rows ``added``."""
        version = uuid.uuid4().hex
        tables = {name: {"base": list(held["base"]), "layers": list(held["layers"])} for name, held in now["tables"].items()}

        def put(frame: DataFrame, name: str, kind: str) -> str:
            folder = f"versions/{version}/{kind}/{name}"
            frame.write.parquet(f"{self.path}/{folder}")
            return folder

        for name, frame in changed.items():
            tables[name] = {"base": [put(frame, name, "base")], "layers": []}
        for name, frame in (added or {}).items():
            tables[name]["base"].append(put(frame, name, "base"))
        for name, frame in (deltas or {}).items():
            layers = [*tables[name]["layers"], put(frame, name, "layer")]
            tables[name]["layers"] = layers if len(layers) <= MOST_LAYERS else [put(self._layers(layers), name, "merged")]
        number = now["number"] + 1
        self._add(number, json.dumps(now | {"tables": tables} | more | {"number": number}))

    def compact(self, name: str) -> None:
        """Write a table's rows as a new base without layers."""
        now = self._current()
        self._commit(now, {name: self.table(name, now)})

    def apply_schema(self, schema: Schema) -> None:
        """Empty tables for a schema."""
        validate(schema)
        now = self._current()
        new = {}
        for t in schema.tables:
            if t.name in now["tables"]:
                raise SchemaError(f"table {t.name!r} exists")
            new[t.name] = self.spark.createDataFrame([], ", ".join(f"`{c.name}` {carrier(c.type).simpleString()}" for c in t.columns))
        self._commit(now, new, schema=dumps(schema))

    def put_tables(self, schema: Schema | None, tables: Mapping[str, DataFrame]) -> None:
        """Replace tables by typed rows, whatever was there (for loading test data); without a schema they are data alone."""
        self._commit(self._current(), dict(tables), schema=None if schema is None else dumps(schema))

    def insert(self, schema: Schema, name: str, rows: DataFrame) -> None:
        """Append rows: defaults for absent columns, generated columns computed, rules checked.

        Only the new rows are written.
        """
        now = self._current()
        table = schema.table(name)
        before = self.tables(schema, now)
        whole = constraints.with_generated(constraints.with_defaults(rows, schema, table), table)
        after = {**before, name: before[name].unionByName(whole)}
        constraints.require_sound(schema, after)
        new = whole.select(*(quoted(f.name).cast(f.dataType).alias(f.name) for f in before[name].schema.fields))
        if now.get("captured"):
            self._change(schema, now, {name: after[name]}, before)
        elif now["tables"][name]["layers"]:  # a row may come back whose key a layer deletes
            self._commit(now, {}, {name: replay.with_key(new, table).select("_key", F.struct(*map(quoted, new.columns)).alias("_row"))})
        else:
            self._commit(now, {}, None, {name: new})

    def export_snapshot(self, schema: Schema) -> Snapshot:
        return Snapshot(schema, {t.name: canonical(self.table(t), t) for t in schema.tables})

    def import_snapshot(self, snapshot: Snapshot) -> None:
        """Load a snapshot into tables that don't exist or are empty, all at once.

        Generated columns are computed again; triggers don't fire on a load;
        a row that breaks a rule refuses the whole load.
        """
        schema = validate(snapshot.schema)
        now = self._current()
        for t in schema.tables:
            if t.name in now["tables"] and not self.table(t, now).isEmpty():
                raise SchemaError(f"table {t.name!r} holds rows")
        loaded = {t.name: constraints.with_generated(typed(snapshot.tables[t.name], t), t) for t in schema.tables}
        constraints.require_sound(schema, loaded)
        self._commit(now, loaded, schema=dumps(schema))

    def verify(self, schema: Schema, other: Store) -> Report:
        return verify(schema, self.export_snapshot(schema).tables, other.export_snapshot(schema).tables)

    def call(self, schema: Schema, name: str, arguments: Mapping[str, routines.Argument]) -> None:
        """Run a routine: all its actions or none."""
        now = self._current()
        before = self.tables(schema, now)
        after = routines.call(schema, before, name, arguments)
        constraints.require_sound(schema, after)
        changed = {k: v for k, v in after.items() if v is not before[k]}
        self._change(schema, now, changed, before)

    def _delta(self, table: Table, old: DataFrame, new: DataFrame) -> DataFrame:
        """(_key, _row) of the rows that differ."""
        def keyed(frame: DataFrame, name: str) -> DataFrame:
            return replay.with_key(frame.select(*(quoted(f.name).cast(f.dataType).alias(f.name) for f in old.schema.fields)), table).select("_key", F.struct(*map(quoted, old.columns)).alias(name))

        both = keyed(old, "was").join(keyed(new, "_row"), "_key", "full_outer")
        return both.where(~F.col("was").eqNullSafe(F.col("_row"))).select("_key", "_row")

    def _change(self, schema: Schema, now: dict, changed: Mapping[str, DataFrame], before: Mapping[str, DataFrame]) -> None:
        """Commit new states of tables as layers of what differs; where capture is on, with the journal of the change."""
        deltas = {k: self._delta(schema.table(k), before[k], v) for k, v in changed.items() if schema.table(k).primary_key}
        whole = {k: v for k, v in changed.items() if k not in deltas}
        sequence, folders = now["sequence"], list(now["journal"])
        for name, frame in changed.items():
            if name not in now.get("captured", ()):
                continue
            rows = journals.capture(schema, schema.table(name), before[name], frame, self.target, sequence)
            folder = f"journal/{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/{folder}")
            last = self.spark.read.parquet(f"{self.path}/{folder}").agg({"sequence": "max"}).first()[0]
            if last is not None:
                folders.append(folder)
                sequence = last
        self._commit(now, whole, deltas, journal=folders, sequence=sequence)

    def update_tables(self, schema: Schema, changed: Mapping[str, DataFrame]) -> None:
        """Commit new states of tables, captured if capture is on."""
        now = self._current()
        before = self.tables(schema, now)
        constraints.require_sound(schema, {**before, **changed})
        self._change(schema, now, changed, before)

    # -- capture and replay

    def install_capture(self, schema: Schema) -> None:
        """Record changes of these tables from now on; may be called again."""
        for t in schema.tables:
            if not t.primary_key:
                raise SchemaError(f"table {t.name!r} needs a primary key to be captured")
            for k in t.primary_key:
                if t.column(k) is None:
                    raise SchemaError(f"table {t.name!r}: unknown key column {k!r}")
        now = self._current()
        self._commit(now, {}, captured=sorted({*now.get("captured", []), *(t.name for t in schema.tables)}))

    def journal(self) -> DataFrame:
        folders = [f"{self.path}/{f}" for f in self._current()["journal"]]
        return self.spark.read.schema(journals.JOURNAL).parquet(*folders) if folders else journals.empty_journal(self.spark)

    def changes(self, after: int, limit: int) -> DataFrame:
        """The next captured changes after a cursor."""
        return journals.read(self.journal(), after, limit)

    def ledger(self) -> DataFrame:
        return self._ledger(self._current())

    def _ledger(self, now: dict) -> DataFrame:
        folders = [f"{self.path}/{f}" for f in now["ledger"]]
        return self.spark.read.schema(replay.LEDGER).parquet(*folders) if folders else self.spark.createDataFrame([], replay.LEDGER)

    def apply_changes(self, schema: Schema, changes: DataFrame, tolerant: bool = False) -> int:
        """Replay changes: tables and ledger in one commit. What replay writes isn't captured."""
        now = self._current()
        done = replay.apply_typed(schema, self.tables(schema, now), changes, self._ledger(now), tolerant)
        if not done.changes:
            return 0
        folder = f"ledger/{uuid.uuid4().hex}"
        done.ledger.write.parquet(f"{self.path}/{folder}")
        self._commit(now, {}, done.deltas, ledger=[*now["ledger"], folder])
        return done.changes
