"""JSON command line: ``audit``, ``copy``, ``cutover [--dry-run]``.

Results and errors are one line of JSON on standard output; what happens on the
way goes to standard error. The exit code is 0, or 1, or 2 for wrong usage.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass

from plumbline.errors import ConflictError, PlumblineError
from plumbline.operators.digest import Report, require_equivalent
from plumbline.plans.features import Finding, audit, infer, require_exact
from plumbline.plans.model import Contract, Schema, always, dumps, loads
from plumbline.plans.validate import validate

# Error codes, phases and defaults.
USAGE, CONFIG, NOT_EXACT = "ERR_USAGE", "ERR_CONFIG", "ERR_AUDIT_NOT_EXACT"
CONNECT_SOURCE, CONNECT_DESTINATION = "ERR_CONNECT_SOURCE", "ERR_CONNECT_DESTINATION"
SCHEMA, SNAPSHOT, CONFLICT, CAPTURE, DIVERGED, INTERNAL = "ERR_SCHEMA", "ERR_SNAPSHOT", "ERR_REPLICATION_CONFLICT", "ERR_CAPTURE", "ERR_VERIFY_DIVERGED", "ERR_INTERNAL"
PHASES = ("install_capture", "snapshot", "catch_up", "verify")
POLL_MS, POLLS, BATCH = 1000, 3, 500


class Failure(Exception):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Options:
    poll_interval_ms: int = 0
    drain_polls: int = 0
    batch_limit: int = 0

    def filled(self) -> Options:
        return Options(self.poll_interval_ms if self.poll_interval_ms > 0 else POLL_MS, self.drain_polls if self.drain_polls > 0 else POLLS, self.batch_limit if self.batch_limit > 0 else BATCH)


@dataclass(frozen=True)
class Migration:
    source_dsn: str = ""
    destination_dsn: str = ""
    contract: Contract = always(Contract())
    schema: Schema | None = None
    schema_ref: str = ""


@dataclass(frozen=True)
class Cutover(Migration):
    options: Options = always(Options())


@dataclass(frozen=True)
class CutoverReport:
    status: str = always("")
    code: str = ""
    source_digest: str = always("")
    destination_digest: str = always("")
    changes_applied: int = always(0)


@dataclass(frozen=True)
class PlanTable:
    name: str = always("")
    rows: int = always(0)


@dataclass(frozen=True)
class Plan:
    status: str = always("plan")
    audit: tuple[Finding, ...] = always(())
    source_tables: tuple[PlanTable, ...] = always(())
    destination_has_tables: bool = always(False)
    phases: tuple[str, ...] = always(PHASES)


def split_arguments(known: tuple[str, ...], arguments: list[str]) -> tuple[set[str], list[str]]:
    """Flags and the rest; after ``--`` everything is the rest."""
    flags: set[str] = set()
    rest: list[str] = []
    for i, a in enumerate(arguments):
        if a == "--":
            return flags, rest + arguments[i + 1 :]
        if not a.startswith("-"):
            rest.append(a)
        elif a not in known:
            raise Failure(USAGE, f"unexpected flag {a!r}")
        elif a in flags:
            raise Failure(USAGE, f"duplicate flag {a!r}")
        else:
            flags.add(a)
    return flags, rest


def _under(code: str, step: Callable):
    """The step's result; an error of any kind gets this code."""
    try:
        return step()
    except Failure:
        raise
    except ConflictError as error:
        raise Failure(CONFLICT, str(error)) from error
    except Exception as error:
        raise Failure(code, str(error).split("\n")[0]) from error


def _document(path: str, kind: type):
    def step():
        with open(path, encoding="utf-8") as f:
            return loads(kind, f.read())

    return _under(CONFIG, step)


def _schema(path: str, config: Migration) -> Schema:
    inline = config.schema is not None and bool(config.schema.tables)
    if inline == bool(config.schema_ref):
        raise Failure(CONFIG, "a config has either schema or schema_ref")
    schema = config.schema if inline else _document(os.path.join(os.path.dirname(path), config.schema_ref), Schema)
    return _under(SCHEMA, lambda: validate(schema))


def _findings(contract: Contract, schema: Schema) -> list[Finding]:
    full = Contract(contract.source, contract.destination, (*contract.required_features, *infer(schema)))
    findings = _under(CONFIG, lambda: audit(full))
    _under(NOT_EXACT, lambda: require_exact(findings))
    return findings


def _stores(config: Migration):
    from pyspark.sql import SparkSession

    from plumbline.sources.store import Store

    spark = SparkSession.builder.getOrCreate()

    def opened(dsn: str, target, code: str):
        def step() -> Store:
            if not dsn:
                raise PlumblineError("a data source is required")
            store = Store(spark, dsn, target)
            store.schema()
            return store

        return _under(code, step)

    return opened(config.source_dsn, config.contract.source, CONNECT_SOURCE), opened(config.destination_dsn, config.contract.destination, CONNECT_DESTINATION)


def run_audit(arguments: list[str]) -> int:
    _, rest = split_arguments((), arguments)
    if len(rest) != 1:
        raise Failure(USAGE, "audit takes one argument, the file of a contract")
    contract = _document(rest[0], Contract)
    findings = _under(CONFIG, lambda: audit(contract))
    print(dumps(findings))
    _under(NOT_EXACT, lambda: require_exact(findings))
    return 0


def run_copy(arguments: list[str]) -> int:
    _, rest = split_arguments((), arguments)
    if len(rest) != 1:
        raise Failure(USAGE, "copy takes one argument, the file of a migration")
    config = _document(rest[0], Migration)
    schema = _schema(rest[0], config)
    _findings(config.contract, schema)
    source, destination = _stores(config)
    _under(SNAPSHOT, lambda: destination.import_snapshot(source.export_snapshot(schema)))
    report: Report = _under(SNAPSHOT, lambda: source.verify(schema, destination))
    _under(DIVERGED, lambda: require_equivalent(report))
    print(dumps(report))
    return 0


def drain(source, destination, schema: Schema, options: Options) -> int:
    """Replay the source's journal until it stays empty for a number of polls."""
    cursor = applied = empty = 0
    while True:
        batch = _under(CAPTURE, lambda: source.changes(cursor, options.batch_limit).persist())
        last = _under(CAPTURE, lambda: batch.agg({"sequence": "max", "*": "count"}).first())
        if last["max(sequence)"] is None:
            empty += 1
            if empty >= options.drain_polls:
                return applied
            time.sleep(options.poll_interval_ms / 1000)
            continue
        empty = 0
        _under(INTERNAL, lambda: destination.apply_changes(schema, batch, tolerant=True))
        applied += last["count(1)"]
        cursor = last["max(sequence)"]
        batch.unpersist()


def run_cutover(arguments: list[str]) -> int:
    flags, rest = split_arguments(("--dry-run",), arguments)
    if len(rest) != 1:
        raise Failure(USAGE, "cutover takes one argument, the file of a cutover")
    config = _document(rest[0], Cutover)
    schema = _schema(rest[0], config)
    options = config.options.filled()
    findings = _findings(config.contract, schema)
    print(f"all {len(findings)} features can be carried over", file=sys.stderr)
    source, destination = _stores(config)
    if "--dry-run" in flags:
        counted = tuple(PlanTable(t.name, _under(INTERNAL, lambda t=t: source.count(t.name))) for t in schema.tables)
        print(dumps(Plan("plan", tuple(findings), counted, all(destination.exists(t.name) for t in schema.tables))))
        return 0
    _under(CAPTURE, lambda: source.install_capture(schema))
    print("the source records its changes from now on", file=sys.stderr)
    _under(SNAPSHOT, lambda: destination.import_snapshot(source.export_snapshot(schema)))
    print("the destination holds the snapshot", file=sys.stderr)
    applied = drain(source, destination, schema, options)
    print(f"{applied} changes replayed, none left", file=sys.stderr)
    report = _under(SNAPSHOT, lambda: source.verify(schema, destination))
    print(dumps(CutoverReport("ready" if report.equivalent else "diverged", "" if report.equivalent else DIVERGED, report.source_digest, report.destination_digest, applied)))
    return 0 if report.equivalent else 1


COMMANDS = {"audit": run_audit, "copy": run_copy, "cutover": run_cutover}


def main(arguments: list[str]) -> int:
    try:
        if not arguments or arguments[0] not in COMMANDS:
            first = arguments[0] if arguments else ""
            if first.startswith("-") and first not in ("-h", "-help", "--help"):
                raise Failure(USAGE, "a command comes before its flags")
            raise Failure(USAGE, "audit, copy or cutover is expected")
        return COMMANDS[arguments[0]](arguments[1:])
    except Failure as failure:
        print(str(failure), file=sys.stderr)
        print(json.dumps({"status": "error", "code": failure.code, "message": str(failure)}, separators=(",", ":")))
        return 2 if failure.code == USAGE else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
