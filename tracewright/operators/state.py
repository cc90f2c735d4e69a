"""The current state of every (entity, predicate) from a ledger of events.

The rules look at each event in order: locks of the entity, a user's authority
that no machine overrules, values that replace or keep what was there. They are
put in closed form, so that the fold is a few aggregates:

* an event counts if its entity is not locked before it;
* once a user's authority is set it stays, so an event is accepted if it may
  pass anyway or comes no later than the first event that sets it;
* each column is the last contribution among accepted events.

All aggregates combine before the shuffle, and locks are looked up over
stretches of the ledger, so an entity with most of the events is no problem.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.asof import last_before
from tracewright.operators.ledger import USER

CHANGES = ("SemanticAsserted", "OverrideApplied", "CorrectionApplied", "ContradictionRecorded", "Invalidated", "EntityResolved", "EntityMentioned")
LOCKS = ("Locked", "Unlocked")


def routed(ledger: DataFrame) -> DataFrame:
    """Adds entity and target: the row an event is about (target null for events about none).

    ledger: event_type, subject_ref, entity_ref, source_id, subject_entity_id,
    entity_id, predicate, predicate_code.
    """
    t = F.col("event_type")
    target = (
        F.when(t == "EntityResolved", F.lit("CANONICAL_ENTITY")).when(t == "EntityMentioned", F.lit("CANDIDATE"))
        .when(t.isin(*CHANGES), F.coalesce("predicate", "predicate_code"))
    )
    return ledger.withColumn("entity", F.coalesce("subject_ref", "entity_ref", "source_id", "subject_entity_id", "entity_id")).withColumn("target", target)


def with_locks(events: DataFrame) -> DataFrame:
    """Adds locked: whether the entity is locked just before the event."""
    flag = F.when(F.col("event_type") == "Locked", True).when(F.col("event_type") == "Unlocked", False)
    return last_before(events, ["entity"], "seq", flag, "locked").withColumn("locked", F.coalesce("locked", F.lit(False)))


def accepted(events: DataFrame) -> DataFrame:
    """The events that count: their entity is not locked, and no user has decided before, unless it is a user's own.

    Adds _pass, _sets (whether it sets a user's authority) and _auth.
    """
    t = F.col("event_type")
    ev = with_locks(events.where(F.col("entity").isNotNull() & (t.isin(*LOCKS) | (t.isin(*CHANGES) & F.col("target").isNotNull()))))
    ev = ev.where(~t.isin(*LOCKS) & ~F.col("locked"))
    ovr = t.isin("OverrideApplied", "CorrectionApplied")
    env = F.col("authority")
    may_pass = ovr | (F.coalesce(env, F.lit("")) == USER)
    either = F.when(t == "SemanticAsserted", F.coalesce(env, F.col("p_authority"))).otherwise(env)
    ev = ev.withColumn("_pass", may_pass).withColumn("_sets", ovr | (F.coalesce(either, F.lit("")) == USER)).withColumn("_auth", F.when(ovr, USER).otherwise(either))
    first = ev.where("_sets").groupBy("entity", "target").agg(F.min("seq").alias("_user"))
    return ev.join(first, ["entity", "target"], "left").where("_pass or _user is null or seq <= _user")


def contributions(ev: DataFrame) -> DataFrame:
    """Adds what an event gives its row: obj if valued, confidence if sure, _auth if gives, _said (the state)."""
    t = F.col("event_type")
    ovr = t.isin("OverrideApplied", "CorrectionApplied")
    obj = F.when(t == "SemanticAsserted", F.coalesce("object_ref", "object_entity_id")).when(t == "EntityResolved", F.coalesce("target_entity_id", "entity_id")).otherwise(F.col("object_ref"))
    state = (
        F.when(ovr, F.lit("USER_CONFIRMED")).when(t == "ContradictionRecorded", F.lit("CONFLICTING")).when(t == "Invalidated", F.lit("INVALIDATED"))
        .when(t == "EntityMentioned", F.lit("AMBIGUOUS"))
        .when(t == "EntityResolved", F.coalesce("p_state", F.when(F.col("kind").isin("ALIAS", "ESTABLISH"), "CONFIRMED").otherwise("PROBABLE")))
        .when(t == "SemanticAsserted", F.col("p_state"))
    )
    return ev.withColumns(
        {
            "valued": ovr | t.isin("SemanticAsserted", "EntityResolved"), "obj": obj, "_said": state,
            "sure": (t == "OverrideApplied") & F.col("has_confidence") | t.isin("SemanticAsserted", "EntityResolved") & F.col("confidence").isNotNull(),
            "gives": F.col("_auth").isNotNull() | (t == "EntityResolved"),  # a resolution without authority resets it
        }
    )


def reduce_state(events: DataFrame) -> DataFrame:
    """entity, predicate, object_ref, confidence, authority, state, seq.

    events: routed events with entity, target, event_type, seq, authority,
    p_authority, object_ref, object_entity_id, target_entity_id, entity_id,
    confidence, has_confidence, p_state, kind. Events without an entity or a
    target, and all but the row-changing types, leave no row.
    """
    ev = contributions(accepted(events))
    last = lambda value, when: F.max_by(F.struct(value.alias("v")), F.when(when, F.col("seq")))["v"]
    return ev.groupBy("entity", F.col("target").alias("predicate")).agg(
        last(F.col("obj"), F.col("valued")).alias("object_ref"),
        last(F.col("confidence"), F.col("sure")).alias("confidence"),
        last(F.col("_auth"), F.col("gives")).alias("authority"),
        F.coalesce(last(F.col("_said"), F.col("_said").isNotNull()), F.lit("UNKNOWN")).alias("state"),
        F.max("seq").alias("seq"),
    )


def fold_events(events: list[dict]) -> dict[tuple[str, str], dict]:
    """The same fold event by event: the plain form, for tests and for one entity."""
    return fold_from({}, set(), events)[0]


def fold_from(rows: dict[tuple[str, str], dict], locked: set[str], events: list[dict]) -> tuple[dict[tuple[str, str], dict], set[str]]:
    """The rows and the locked entities after more events."""
    rows, locked = dict(rows), set(locked)
    for e in sorted(events, key=lambda x: x["seq"]):
        t, who = e["event_type"], e["entity"]
        if who is None:
            continue
        if t in LOCKS:
            (locked.add if t == "Locked" else locked.discard)(who)
            continue
        if t not in CHANGES or e["target"] is None or who in locked:
            continue
        key = (who, e["target"])
        row = rows.get(key) or {"object_ref": None, "confidence": None, "authority": None, "state": "UNKNOWN", "seq": -1}
        ovr = t in ("OverrideApplied", "CorrectionApplied")
        if not ovr and e["authority"] != USER and row["authority"] == USER:
            continue
        row = dict(row, seq=e["seq"])
        if ovr:
            row.update(object_ref=e["object_ref"], authority=USER, state="USER_CONFIRMED")
            if t == "OverrideApplied" and e["has_confidence"]:
                row["confidence"] = e["confidence"]
        elif t == "SemanticAsserted":
            row["object_ref"] = e["object_ref"] if e["object_ref"] is not None else e["object_entity_id"]
            row["confidence"] = e["confidence"] if e["confidence"] is not None else row["confidence"]
            row["authority"] = e["authority"] or e["p_authority"] or row["authority"]
            row["state"] = e["p_state"] or row["state"]
        elif t == "EntityResolved":
            row["object_ref"] = e["target_entity_id"] or e["entity_id"]
            row["confidence"] = e["confidence"] if e["confidence"] is not None else row["confidence"]
            row["authority"] = e["authority"]
            row["state"] = e["p_state"] or ("CONFIRMED" if e["kind"] in ("ALIAS", "ESTABLISH") else "PROBABLE")
        else:
            row["authority"] = e["authority"] or row["authority"]
            row["state"] = {"ContradictionRecorded": "CONFLICTING", "Invalidated": "INVALIDATED", "EntityMentioned": "AMBIGUOUS"}[t]
        rows[key] = row
    return rows, locked


def reduce_in_order(events: DataFrame) -> DataFrame:
    """reduce_state event by event, one entity a group: for ledgers whose entities have few events each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = fold_events(pdf.astype(object).where(pdf.notna(), None).to_dict("records"))
        return pd.DataFrame([{"entity": k[0], "predicate": k[1], **r} for k, r in got.items()], columns=["entity", "predicate", "object_ref", "confidence", "authority", "state", "seq"])

    return events.where("entity is not null").groupBy("entity").applyInPandas(run, "entity string, predicate string, object_ref string, confidence double, authority string, state string, seq bigint")


def checksum(state: DataFrame) -> DataFrame:
    """rows, checksum: one digest of a state, whatever the order and number of its partitions.

    Each row is digested on its own and the digests are summed, so no task
    holds more than its rows.
    """
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("entity", "predicate", "object_ref", "authority", "state", "seq")])
    part = lambda i: F.sum(F.conv(F.substring(F.sha2(line, 256), 1 + 12 * i, 12), 16, 10).cast("bigint").cast("decimal(38,0)"))
    total = lambda i: F.coalesce(part(i) % F.lit(1 << 48).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).cast("bigint")
    return state.agg(F.count("*").alias("rows"), F.concat_ws("-", *[total(i).cast("string") for i in range(3)]).alias("checksum"))
