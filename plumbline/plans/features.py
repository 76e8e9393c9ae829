"""The audit of a contract: which required features move exactly."""

from __future__ import annotations

from dataclasses import dataclass

from plumbline.errors import SchemaError
from plumbline.plans.model import Contract, Schema, always

# Feature names, verdicts and their reasons.
EXACT = (
    "tables", "primary_keys", "transactions", "canonical_foreign_keys", "canonical_check_constraints", "canonical_indexes",
    "canonical_views", "canonical_triggers", "canonical_routines", "canonical_full_text", "canonical_vectors",
)
EXACT_AS_TEXT = ("json", "uuid")
UNKNOWN = ("foreign_keys", "check_constraints", "indexes", "triggers", "views", "stored_routines", "full_text")
TEXT_REASON = "lossless canonical text representation"
DIALECT_REASON = "requires parser and semantic compiler"
FOREIGN_REASON = "feature is not in the compatibility catalog"

OF_FAMILY = {"json": "json", "uuid": "uuid", "vector": "canonical_vectors"}
OF_CONSTRAINT = {"primary_key": "primary_keys", "foreign_key": "canonical_foreign_keys", "check": "canonical_check_constraints"}


@dataclass(frozen=True)
class Finding:
    feature: str = always("")
    status: str = always("")
    reason: str = ""


def assess(feature: str) -> Finding:
    if feature in EXACT:
        return Finding(feature, "exact")
    if feature in EXACT_AS_TEXT:
        return Finding(feature, "exact", TEXT_REASON)
    return Finding(feature, "unknown", DIALECT_REASON if feature in UNKNOWN else FOREIGN_REASON)


def audit(contract: Contract) -> list[Finding]:
    """One finding for each required feature, in their order."""
    contract.validate()
    return [assess(f) for f in contract.required_features]


def require_exact(findings: list[Finding]) -> None:
    for finding in findings:
        if finding.status != "exact":
            raise SchemaError(f"feature {finding.feature!r} is {finding.status}: {finding.reason}")


def infer(schema: Schema) -> list[str]:
    """The features that a schema needs, sorted."""
    need = {"tables", "canonical_full_text"}
    for part, feature in ((schema.views, "canonical_views"), (schema.triggers, "canonical_triggers"), (schema.routines, "canonical_routines"), (schema.indexes, "canonical_indexes")):
        if part:
            need.add(feature)
    for table in schema.tables:
        need |= {OF_FAMILY[c.type.family] for c in table.columns if c.type.family in OF_FAMILY}
        need |= {OF_CONSTRAINT[c.kind] for c in table.constraints if c.kind in OF_CONSTRAINT}
    return sorted(need)
