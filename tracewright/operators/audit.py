"""Why a row is as it is: its events, its state before the last one, what caused them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.lineage import closure
from tracewright.operators.state import CHANGES, reduce_state


def history(events: DataFrame, subject: str, predicate: str | None = None) -> DataFrame:
    """The events that speak of a subject, by any of the fields that may name it."""
    named = F.lit(False)
    for c in ("subject_ref", "entity_ref", "source_id", "subject_entity_id", "entity_id"):
        named = named | F.coalesce(F.col(c) == subject, F.lit(False))
    df = events.where(named)
    return df.where(F.coalesce("predicate", "predicate_code") == predicate) if predicate else df


def prior_states(events: DataFrame) -> DataFrame:
    """The state of every row before the last change of its entity: the fold without that event."""
    last = events.where(F.col("entity").isNotNull() & F.col("event_type").isin(*CHANGES)).groupBy("entity").agg(F.max("seq").alias("_last"))
    return reduce_state(events.join(last, "entity").where("seq < _last").drop("_last"))


def causes(events: DataFrame, start: DataFrame) -> DataFrame:
    """seq, cause, distance: all events that caused those of start (seq), directly or through others."""
    got = closure(events, "seq", "causation_id").withColumnRenamed("causation_id", "cause")
    return got.join(start.select("seq").distinct(), "seq", "left_semi")
