"""Active relationship edges from the same ledger.

An edge is active if nothing supersedes its last activation later. What
supersedes is given by patterns over (subject, predicate, scope, relationship
type, object or fact), with fields left open; each pattern is reduced to its
highest sequence number, an edge asks for the at most 16 patterns it matches, and
both meet in one equi-join. No edge meets the single events of a busy subject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.state import with_locks

_ANY = "*"
_SEP = "\u0001"


def _key(*parts: Column | str) -> Column:
    return F.concat_ws(_SEP, *[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit(_ANY)) for p in parts])


def activations(events: DataFrame) -> DataFrame:
    """Rows that put an edge up, of unlocked subjects: assertions, and overrides and corrections with an object."""
    ev = with_locks(events).where("not locked")
    t = F.col("event_type")
    machine = ev.where((t == "SemanticAsserted") & F.col("entity").isNotNull() & F.col("target").isNotNull())
    user = ev.where(t.isin("OverrideApplied", "CorrectionApplied") & F.col("object_ref").isNotNull() & F.col("entity").isNotNull() & F.col("target").isNotNull())
    same = [F.col("entity").alias("subject"), F.col("target").alias("predicate"), "object_ref", F.coalesce("scope", F.lit("GLOBAL")).alias("scope"), "relationship_type", "seq"]
    a = machine.select(*same, F.lit("m").alias("origin"), F.coalesce("p_state", F.lit("UNKNOWN")).alias("state"), F.coalesce("p_authority", "authority", F.lit("machine")).alias("authority"), "confidence")
    b = user.select(*same, F.lit("u").alias("origin"), F.lit("USER_CONFIRMED").alias("state"), F.lit("USER_OVERRIDE").alias("authority"), "confidence")
    both = a.unionByName(b)
    return both.withColumn("fact_id", F.sha2(_key("origin:", F.col("origin"), F.col("subject"), F.col("predicate"), F.col("object_ref"), F.col("scope"), F.col("relationship_type")), 256))


def superseders(events: DataFrame) -> DataFrame:
    """pattern, seq: the highest number of each pattern."""
    t = F.col("event_type")
    s, p = F.col("entity"), F.col("target")
    user = with_locks(events).where("not locked").where(t.isin("OverrideApplied", "CorrectionApplied") & s.isNotNull() & p.isNotNull())
    user = user.select(_key("u", s, p, F.col("relationship_type"), F.when(t == "CorrectionApplied", F.col("prior_ref"))).alias("pattern"), "seq")
    gone = events.where((t == "Invalidated") & s.isNotNull()).select(_key("i", s, p, F.col("scope"), F.col("relationship_type")).alias("pattern"), "seq")
    return user.unionByName(gone).groupBy("pattern").agg(F.max("seq").alias("seq"))


def edge_states(events: DataFrame) -> DataFrame:
    """One row a fact: subject, predicate, object_ref, scope, relationship_type, origin, state, authority, confidence, seq, active, superseded_by."""
    a = activations(events)
    cols = [c for c in a.columns if c != "fact_id"]
    last = a.groupBy("fact_id").agg(F.max_by(F.struct(*cols), "seq").alias("x")).select("fact_id", "x.*")
    s, p, r = F.col("subject"), F.col("predicate"), F.col("relationship_type")
    open_ = F.lit(None).cast("string")
    asks = [_key("u", s, p, rr, pr) for rr in (r, open_) for pr in (open_, F.col("object_ref"), F.col("fact_id"))]
    asks += [_key("i", s, pp, sc, rr) for pp in (p, open_) for sc in (F.col("scope"), open_) for rr in (r, open_)]
    asked = last.select("fact_id", "seq", F.explode(F.array_distinct(F.array(*asks))).alias("pattern"))
    hit = asked.join(superseders(events).withColumnRenamed("seq", "by"), "pattern").where("by > seq").groupBy("fact_id").agg(F.max("by").alias("superseded_by"))
    quarrel = events.where((F.col("event_type") == "ContradictionRecorded") & F.col("entity").isNotNull() & F.col("target").isNotNull()).groupBy(F.col("entity").alias("subject"), F.col("target").alias("predicate")).agg(F.max("seq").alias("_q"))
    out = last.join(hit, "fact_id", "left").join(quarrel, ["subject", "predicate"], "left")
    active = F.col("superseded_by").isNull()
    return out.withColumn("active", active).withColumn("state", F.when(active & (F.col("_q") > F.col("seq")), "CONFLICTING").otherwise(F.col("state"))).drop("_q", "fact_id")
