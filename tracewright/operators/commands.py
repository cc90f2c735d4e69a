"""Typed builders of ledger events: from rows of a table, one event each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.ledger import LATEST, USER

_ENVELOPE = ("event_type", "event_version", "authority", "confidence", "idempotency_key")


def events(rows: DataFrame, event_type: str, payload: dict[str, Column], authority: Column | None = None, confidence: Column | None = None, key: Column | None = None) -> DataFrame:
    """One event of a type for each row, with the latest version's number. Fields that are not given are null."""
    none = F.lit(None).cast("string")
    return rows.select(
        F.lit(event_type).alias("event_type"), F.lit(LATEST.get(event_type, 1)).alias("event_version"),
        (authority if authority is not None else none).alias("authority"),
        (confidence if confidence is not None else F.lit(None).cast("double")).alias("confidence"),
        (key if key is not None else none).alias("idempotency_key"),
        F.struct(*[c.alias(n) for n, c in payload.items()]).alias("payload"),
    )


def assert_(rows: DataFrame, scope: str = "GLOBAL") -> DataFrame:
    """rows: predicate_code, subject_ref, object_ref, confidence."""
    return events(rows, "SemanticAsserted", {c: F.col(c) for c in ("predicate_code", "subject_ref", "object_ref")} | {"scope": F.lit(scope)}, F.lit("machine"), F.col("confidence"))


def override(rows: DataFrame) -> DataFrame:
    """rows: subject_ref, predicate, object_ref."""
    return events(rows, "OverrideApplied", {c: F.col(c) for c in ("subject_ref", "predicate", "object_ref")}, F.lit(USER))


def correct(rows: DataFrame) -> DataFrame:
    """rows: subject_ref, predicate, object_ref, prior_ref."""
    return events(rows, "CorrectionApplied", {c: F.col(c) for c in ("subject_ref", "predicate", "object_ref", "prior_ref")}, F.lit(USER))


def lock(rows: DataFrame, on: bool = True) -> DataFrame:
    """rows: entity_ref."""
    return events(rows, "Locked" if on else "Unlocked", {"entity_ref": F.col("entity_ref")}, F.lit(USER))


def invalidate(rows: DataFrame, scope: str | None = "GLOBAL") -> DataFrame:
    """rows: subject_ref, predicate."""
    return events(rows, "Invalidated", {"subject_ref": F.col("subject_ref"), "predicate": F.col("predicate"), "scope": F.lit(scope).cast("string")})


def contradict(rows: DataFrame) -> DataFrame:
    """rows: subject_ref, predicate, contradicting_ref."""
    return events(rows, "ContradictionRecorded", {c: F.col(c) for c in ("subject_ref", "predicate", "contradicting_ref")})


def resolve(rows: DataFrame, kind: str) -> DataFrame:
    """rows: entity_id, target_entity_id. kind: MERGE, SPLIT, ALIAS, ESTABLISH or UPDATE."""
    if kind not in ("MERGE", "SPLIT", "ALIAS", "ESTABLISH", "UPDATE"):
        raise ValueError(kind)
    return events(rows, "EntityResolved", {"kind": F.lit(kind), "entity_id": F.col("entity_id"), "target_entity_id": F.col("target_entity_id")})


def aligned(pairs: DataFrame, existing: DataFrame) -> DataFrame:
    """Events for alignments (left_ref, right_ref, alignment_type, method) that do not exist yet, each once."""
    key = ["left_ref", "right_ref", "alignment_type", "method"]
    new = pairs.dropDuplicates(key).join(existing.select(*key).distinct(), key, "left_anti")
    return events(new, "Aligned", {c: F.col(c) for c in key}, key=F.concat_ws("|", *key))
