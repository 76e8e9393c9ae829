"""Exceptions of the engine."""

from __future__ import annotations


class PlumblineError(Exception):
    """Base of all errors that the engine raises on purpose."""


class GrammarError(PlumblineError):
    """Text outside the canonical grammar."""


class SchemaError(PlumblineError):
    """A schema or a query that breaks a rule of the model."""


class ValueFormatError(PlumblineError):
    """A value outside its family's canonical form."""


class ConstraintError(PlumblineError):
    """Rows that break a constraint."""

    def __init__(self, table: str, constraint: str, rows: int) -> None:
        super().__init__(f"table {table!r}: {rows} row(s) break {constraint}")
        self.table, self.constraint, self.rows = table, constraint, rows


class ConflictError(PlumblineError):
    """A change whose expected state isn't the destination's."""

    def __init__(self, table: str, primary_key: object, expected: object, actual: object, sequence: int) -> None:
        super().__init__(f"conflict in {table!r} at {primary_key} (sequence {sequence}): expected {expected}, found {actual}")
        self.table, self.primary_key, self.expected, self.actual, self.sequence = table, primary_key, expected, actual, sequence
