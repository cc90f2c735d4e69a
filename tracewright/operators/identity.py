"""Canonical identities from their events, who is a member where, and which name means whom.

As in the fold of the state, the rules that look at one event after the other are
put in closed form: an event counts if its entity is not locked before it and no
user has spoken before, unless it is a user's own; each field is the last one that
was given; memberships are the union, in order, of what was given since they were
last left empty. All of it is aggregates that combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.asof import lasts_before
from tracewright.operators.ledger import USER
from tracewright.operators.state import LOCKS, accepted, contributions, with_locks

IDENTITY = "CANONICAL_IDENTITY"
_LISTS = ("aliases", "support_refs")
_MEMBERS = ("source_ids", "work_ids", "continuity_ids")


def identity_events(events: DataFrame) -> DataFrame:
    """The events that speak of an identity: established, updated, or changed by their predicate; and the locks."""
    t = F.col("event_type")
    made = (t == "EntityResolved") & F.col("kind").isin("ESTABLISH", "UPDATE")
    changed = t.isin("OverrideApplied", "CorrectionApplied", "Invalidated") & (F.col("predicate") == IDENTITY)
    who = F.when(made, F.col("entity_id")).otherwise(F.col("entity"))
    return events.where(made | changed | t.isin(*LOCKS)).withColumn("entity", who).where("entity is not null")


def identity_fold(events: DataFrame) -> DataFrame:
    """entity, display_label, canonical_type, classification, aliases, support_refs, source_ids, work_ids, continuity_ids, state, confidence, authority, seq.

    events: see identity_events; also seq, authority, p_state, confidence,
    object_ref (a JSON object of an override changes the fields it has, and no
    others), display_label, canonical_type, classification, and the arrays.
    """
    t = F.col("event_type")
    ev = with_locks(identity_events(events)).where(~t.isin(*LOCKS) & ~F.col("locked"))
    user = F.coalesce(F.col("authority"), F.lit("")) == USER
    first = ev.where(user).groupBy("entity").agg(F.min("seq").alias("_user"))
    ev = ev.join(first, "entity", "left").where(user | F.col("_user").isNull() | (F.col("seq") <= F.col("_user")))
    ovr = t.isin("OverrideApplied", "CorrectionApplied")
    part = ovr & F.coalesce(F.col("object_ref").rlike(r"^\s*\{"), F.lit(False)) & F.get_json_object("object_ref", "$").isNotNull()
    whole = ~part & (t != "Invalidated")

    def given(name: str, path: str | None = None, many: bool = False) -> Column:
        raw = F.get_json_object("object_ref", f"$.{path or name}")
        got = F.from_json(raw, "array<string>") if many else raw
        own = F.coalesce(F.col(name), F.array().cast("array<string>")) if many else F.col(name)
        return F.when(whole, F.struct(own.alias("v"))).when(part & raw.isNotNull(), F.struct(got.alias("v")))

    state = F.when(t == "Invalidated", "INVALIDATED").when(user, "USER_CONFIRMED").when(F.col("kind") == "ESTABLISH", F.coalesce("p_state", F.lit("CONFIRMED"))).otherwise(F.col("p_state"))
    fields = ("display_label", "canonical_type", "classification", *_LISTS)
    ev = ev.withColumns({f"_{f}": given(f, many=f in _LISTS) for f in fields} | {f"_{m}": given(m, f"memberships.{m}", True) for m in _MEMBERS} | {"_state": state})
    # a user who confirms without a classification accepts
    ev = ev.withColumn("_classification", F.when(ovr & user & F.coalesce(F.col("_classification.v"), F.lit("")).eqNullSafe("") & whole, F.struct(F.lit("ACCEPTED").alias("v"))).otherwise(F.col("_classification")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    out = ev.groupBy("entity").agg(
        *[last(f"_{f}")["v"].alias(f) for f in fields], F.coalesce(last("_state"), F.lit("CONFIRMED")).alias("state"), last("confidence").alias("confidence"),
        last("authority").alias("authority"), F.max("seq").alias("seq"), F.max(F.when(t != "Invalidated", F.col("seq"))).alias("_made"),
    ).where("_made is not null").drop("_made")
    none = F.lit(True)
    for m in _MEMBERS:
        none = none & (F.size(F.coalesce(F.col(f"_{m}.v"), F.array().cast("array<string>"))) == 0)
    emptied = ev.groupBy("entity").agg(F.max(F.when(whole & none, F.col("seq"))).alias("_emptied"))
    said = ev.join(emptied, "entity").where("_emptied is null or seq > _emptied")
    items = said.select("entity", "seq", F.explode(F.array(*[F.struct(F.lit(m).alias("field"), F.coalesce(F.col(f"_{m}.v"), F.array().cast("array<string>")).alias("v")) for m in _MEMBERS])).alias("x")).select("entity", "seq", "x.field", F.posexplode("x.v").alias("pos", "item"))
    each = items.groupBy("entity", "field", "item").agg(F.min(F.struct("seq", "pos")).alias("at"))
    lists = each.groupBy("entity", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias("v"))
    wide = lists.groupBy("entity").agg(*[F.max(F.when(F.col("field") == m, F.col("v"))).alias(m) for m in _MEMBERS])
    none_given = F.array().cast("array<string>")
    own = [F.coalesce(f, none_given).alias(f) if f in _LISTS else F.col(f) for f in fields]
    return out.join(wide, "entity", "left").select("entity", *own, *[F.coalesce(m, F.array().cast("array<string>")).alias(m) for m in _MEMBERS], "state", "confidence", "authority", "seq")


def alternatives(events: DataFrame) -> DataFrame:
    """entity, predicate, seq, object_ref, authority, state, confidence, was_seq: what each value of a row replaced.

    One row for each assertion or resolution that gives a row of the state
    another value than the one it had, with that one; seq is the event's. events:
    as for the fold of the state.
    """
    ev = contributions(accepted(events))
    had = lasts_before(
        ev, ["entity", "target"], "seq",
        {"_object": F.when(F.col("valued"), F.struct("obj")), "_authority": F.when(F.col("gives"), F.struct("_auth")), "_state": F.col("_said"), "_confidence": F.when(F.col("sure"), F.struct("confidence")), "was_seq": F.col("seq")},
    )
    new = F.col("event_type").isin("SemanticAsserted", "EntityResolved") & F.col("obj").isNotNull() & F.col("_object.obj").isNotNull() & (F.col("obj") != F.col("_object.obj"))
    resolved = F.col("event_type") == "EntityResolved"  # a resolution looks at the row without its authority
    return had.where(new).select("entity", F.col("target").alias("predicate"), "seq", F.col("_object.obj").alias("object_ref"), F.when(~resolved, F.col("_authority._auth")).alias("authority"), F.coalesce("_state", F.lit("UNKNOWN")).alias("state"), F.col("_confidence.confidence").alias("confidence"), "was_seq")


def scope_tuples(identities: DataFrame) -> DataFrame:
    """entity, source_id, work_id, continuity_id: the scopes an identity is found in.

    Its membership tuples (source, work, continuity; an array of structs) as they
    are; without any, every source with every work and continuity it has; without
    a source one row of nulls, which is everywhere.
    """
    some = lambda c: F.when(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0, F.array_sort(F.array_distinct(c))).otherwise(F.array(F.lit(None).cast("string")))
    blank = lambda c: F.nullif(c, F.lit(""))
    has = F.coalesce(F.size("tuples") > 0, F.lit(False))
    a = identities.where(has).select("entity", F.explode("tuples").alias("t")).select("entity", *[blank(F.col(f"t.{c}")).alias(c) for c in ("source_id", "work_id", "continuity_id")])
    b = identities.where(~has).select("entity", "source_ids", some("work_ids").alias("w"), some("continuity_ids").alias("c"), F.explode(some("source_ids")).alias("source_id"))
    nowhere = F.col("source_id").isNull()
    b = b.withColumn("w", F.when(nowhere, F.array(F.lit(None).cast("string"))).otherwise(F.col("w"))).withColumn("c", F.when(nowhere, F.array(F.lit(None).cast("string"))).otherwise(F.col("c")))
    b = b.select("entity", "source_id", "c", F.explode("w").alias("work_id")).select("entity", "source_id", "work_id", F.explode("c").alias("continuity_id"))
    return a.unionByName(b)


def alias_targets(entity_map: DataFrame, state: DataFrame, events: DataFrame, identities: DataFrame) -> DataFrame:
    """alias, entity_ref, rank: whom an alias may mean, the best source first.

    Sources in order: the entity map (alias, entity_id, canonical_entity_id),
    CANONICAL_ENTITY rows of the state keyed by the alias, ALIAS events, and the
    alias lists of identities (entity_ref, aliases; without regard to case).
    """
    m = entity_map.select("alias", F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.col("entity_id").alias("e")), F.struct(F.lit(2).alias("rank"), F.col("canonical_entity_id").alias("e")))).alias("x")).select("alias", "x.rank", F.col("x.e").alias("entity_ref"))
    s = state.where("predicate = 'CANONICAL_ENTITY'").select(F.col("entity_ref").alias("alias"), F.lit(3).alias("rank"), F.col("object_ref").alias("entity_ref"))
    v = events.where("event_type = 'EntityResolved' and kind = 'ALIAS'").select(F.col("entity_id").alias("alias"), F.lit(4).alias("rank"), F.col("target_entity_id").alias("entity_ref"))
    i = identities.select(F.explode("aliases").alias("alias"), F.lit(5).alias("rank"), "entity_ref").withColumn("alias", F.lower("alias"))
    every = m.unionByName(s).unionByName(v).unionByName(i)
    return every.where("alias is not null and coalesce(entity_ref, '') <> ''").groupBy("alias", "entity_ref").agg(F.min("rank").alias("rank"))
