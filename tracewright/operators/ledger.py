"""Append-time operators of the event ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import written

#: The authority that only a user has, and events that need one to decide.
USER = "USER_OVERRIDE"
AUTHORITY_TYPES = ("OverrideApplied", "CorrectionApplied", "EntityResolved", "Locked", "Unlocked", "Invalidated", "ReferenceRebound")
AUTHORITY_PREDICATES = ("speaker", "entity", "character", "canonical_entity", "pronunciation")
#: The fields an event's payload must have.
REQUIRED = {
    "SemanticAsserted": ("predicate_code", "subject_ref", "scope"),
    "EntityResolved": ("kind", "entity_id"),
    "EntityMentioned": ("source_id", "mention_text"),
    "OverrideApplied": ("subject_ref", "predicate", "object_ref"),
    "CorrectionApplied": ("subject_ref", "predicate"),
    "Invalidated": ("subject_ref",),
    "ContradictionRecorded": ("subject_ref", "predicate"),
    "Locked": ("entity_ref",),
    "Unlocked": ("entity_ref",),
}
LATEST = {"SemanticAsserted": 3, "EntityResolved": 2, "OverrideApplied": 2, "CorrectionApplied": 2, "Invalidated": 2, "ContradictionRecorded": 2}


def append(ledger: DataFrame, batch: DataFrame, order: list[str], expected_tail: int | None = None) -> DataFrame:
    """The rows a batch adds, with the sequence numbers that follow the ledger's.

    A row whose idempotency_key the ledger has, or an earlier row of the batch,
    adds nothing. expected_tail: fail unless it is the ledger's last number.
    """
    tail = ledger.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    if expected_tail is not None and expected_tail != tail:
        raise ValueError(f"the ledger ends at {tail}, not at {expected_tail}")
    keyed = batch.where("idempotency_key is not null").join(ledger.where("idempotency_key is not null").select("idempotency_key"), "idempotency_key", "left_anti")
    first = Window.partitionBy("idempotency_key").orderBy(*order)
    keyed = keyed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    rows = keyed.unionByName(batch.where("idempotency_key is null"), allowMissingColumns=True)
    # sorted ranges, numbered on their own, and how many rows lie in the ranges before
    ranged = written(rows.drop("seq").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "appended")
    part = F.shiftrightunsigned("_at", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = ranged.withColumn("_part", part).join(F.broadcast(before), "_part")
    return numbered.withColumn("seq", (F.lit(tail) + F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("bigint")).drop("_at", "_part", "_before")


def first_of_key(ledger: DataFrame) -> DataFrame:
    """seq, first_seq: of every keyed event, the event its key belongs to."""
    keyed = ledger.where("idempotency_key is not null")
    return keyed.join(keyed.groupBy("idempotency_key").agg(F.min("seq").alias("first_seq")), "idempotency_key").select("seq", "first_seq")


def upcast(ledger: DataFrame) -> DataFrame:
    """Adds scope_up, relationship_type_up and version_up: the payload as its latest version has it."""
    t, v, p = F.col("event_type"), F.coalesce("event_version", F.lit(1)), "payload."
    latest = F.lit(1)
    for name, n in LATEST.items():
        latest = F.when(t == name, n).otherwise(latest)
    return ledger.withColumns(
        {
            "scope_up": F.when((t == "SemanticAsserted") & (v < 2), F.coalesce(F.col(p + "scope"), F.lit("GLOBAL"))).otherwise(F.col(p + "scope")),
            "relationship_type_up": F.when(v >= latest, F.col(p + "relationship_type")),
            "version_up": F.greatest(v, latest),
        }
    )


def missing_fields(payload: str = "payload") -> Column:
    """Names of required payload fields that are null, by event_type; empty for a valid event."""
    out = F.array().cast("array<string>")
    for name, fields in REQUIRED.items():
        got = F.array_compact(F.array(*[F.when(F.col(f"{payload}.{f}").isNull(), F.lit(f)) for f in fields]))
        out = F.when(F.col("event_type") == name, got).otherwise(out)
    return out


def poison(events: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Adds verdict PAUSE, SKIP or APPLY. events: event_type, authority, refs; quarantined: ref.

    Events of authority pause first; else one that rests on a quarantined ref is skipped.
    """
    bad = events.select("seq", F.explode("refs").alias("ref")).join(quarantined.select("ref").distinct(), "ref", "left_semi").select("seq").distinct().withColumn("_bad", F.lit(True))
    pause = F.col("event_type").isin(*AUTHORITY_TYPES) | (F.coalesce("authority", F.lit("")) == USER)
    return events.join(bad, "seq", "left").withColumn("verdict", F.when(pause, "PAUSE").when(F.col("_bad"), "SKIP").otherwise("APPLY")).drop("_bad")


def pauses(event_type: Column, predicate: Column) -> Column:
    """Whether a change of authority makes projections wait: of any predicate if none is named, else of one of authority."""
    return event_type.isin("OverrideApplied", "CorrectionApplied", "EntityResolved", "Invalidated") & (predicate.isNull() | F.lower(predicate).isin(*AUTHORITY_PREDICATES))


def mirror(asserted: DataFrame) -> DataFrame:
    """One row a fact: the last assertion wins, but none of the machine over one of the user.

    asserted: fact_id, seq, authority and what else a row has.
    """
    user = F.coalesce(F.col("authority"), F.lit("")) == USER
    pick = F.max_by(F.struct(*[F.col(c) for c in asserted.columns if c != "fact_id"]), F.struct(user, F.col("seq")))
    return asserted.groupBy("fact_id").agg(pick.alias("x")).select("fact_id", "x.*")
