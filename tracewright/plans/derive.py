"""Ledger-shaped inputs from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.state import routed

_TYPE = """CASE WHEN event_id % 17 = 0 THEN 'CorrectionApplied' WHEN event_id % 19 = 0 THEN 'EntityResolved'
 WHEN event_type IN ('view', 'click') THEN 'SemanticAsserted' WHEN event_type = 'purchase' AND k < 10 THEN 'OverrideApplied' WHEN event_type = 'purchase' THEN 'SemanticAsserted'
 WHEN event_type = 'error' AND k % 2 = 0 THEN 'ContradictionRecorded' WHEN event_type = 'error' THEN 'Invalidated'
 WHEN event_type = 'signup' AND k < 5 THEN 'Locked' WHEN event_type = 'signup' AND k < 60 THEN 'Unlocked' ELSE 'EntityMentioned' END"""
_COLUMNS = {
    "seq": "event_id + 1",
    "ts": "ts",
    "event_type": "kind",
    "authority": "CASE WHEN kind IN ('OverrideApplied', 'CorrectionApplied') OR event_id % 23 = 0 THEN 'USER_OVERRIDE' WHEN event_id % 3 = 0 THEN NULL ELSE 'machine' END",
    "p_authority": "CASE WHEN event_id % 29 = 0 THEN 'USER_OVERRIDE' END",
    "subject_ref": "CASE WHEN kind IN ('EntityMentioned', 'EntityResolved', 'Locked', 'Unlocked') THEN NULL ELSE concat('e:', CAST(user_id AS STRING)) END",
    "entity_ref": "CASE WHEN kind IN ('Locked', 'Unlocked') THEN concat('e:', CAST(user_id AS STRING)) END",
    "source_id": "CASE WHEN kind = 'EntityMentioned' THEN concat('s:', CAST(user_id % 20 AS STRING)) END",
    "subject_entity_id": "CAST(NULL AS STRING)",
    "entity_id": "CASE WHEN kind IN ('EntityResolved', 'EntityMentioned') THEN concat('e:', CAST(user_id AS STRING)) END",
    "target_entity_id": "CASE WHEN kind = 'EntityResolved' AND k % 2 = 0 THEN concat('e:', CAST(k AS STRING)) END",
    "predicate": "CASE WHEN kind IN ('EntityMentioned', 'EntityResolved', 'Locked', 'Unlocked') OR (kind = 'Invalidated' AND k % 9 = 0) THEN NULL WHEN event_id % 4 = 0 THEN 'SPEAKS' WHEN event_id % 4 = 1 THEN 'HAS_TRAIT' WHEN event_id % 4 = 2 THEN 'HAS_EMOTION' ELSE 'RELATED_TO' END",
    "predicate_code": "CAST(NULL AS STRING)",
    "object_ref": "CASE WHEN kind IN ('SemanticAsserted', 'OverrideApplied') OR (kind = 'CorrectionApplied' AND k % 5 > 0) THEN CASE WHEN event_id % 31 = 0 THEN NULL ELSE concat('o:', CAST(k % 10 AS STRING)) END END",
    "object_entity_id": "CASE WHEN event_id % 31 = 0 THEN concat('x:', CAST(k AS STRING)) END",
    "prior_ref": "CASE WHEN kind = 'CorrectionApplied' AND k % 3 = 0 THEN concat('o:', CAST(k % 7 AS STRING)) END",
    "confidence": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(least(value, 100) / 100, 4) END",
    "has_confidence": "event_id % 5 <> 0",
    "p_state": "CASE event_id % 6 WHEN 0 THEN 'PROBABLE' WHEN 1 THEN 'CONFIRMED' WHEN 2 THEN 'UNKNOWN' END",
    "kind": "CASE k % 5 WHEN 0 THEN 'ALIAS' WHEN 1 THEN 'ESTABLISH' WHEN 2 THEN 'MERGE' WHEN 3 THEN 'SPLIT' ELSE 'UPDATE' END",
    "scope": "CASE WHEN k % 4 = 0 THEN 'SOURCE' WHEN k % 4 = 1 THEN 'GLOBAL' END",
    "relationship_type": "CASE WHEN event_id % 4 = 3 AND k % 3 = 0 THEN 'ALLY' WHEN event_id % 4 = 3 AND k % 3 = 1 THEN 'RIVAL' END",
    "job_id": "concat('job-', CAST(event_id % 40 AS STRING))",
    "k": "k",
}
_KIND_SQL = _TYPE


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table events as a routed ledger."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("kind", F.expr(_KIND_SQL))
    return routed(e.selectExpr(*[f"{x} AS {c}" for c, x in _COLUMNS.items()]))


_ENTITY = "coalesce(subject_ref, entity_ref, source_id, subject_entity_id, entity_id) AS entity"
_TARGET = """CASE WHEN event_type = 'EntityResolved' THEN 'CANONICAL_ENTITY' WHEN event_type = 'EntityMentioned' THEN 'CANDIDATE'
 WHEN event_type IN ('SemanticAsserted','OverrideApplied','CorrectionApplied','ContradictionRecorded','Invalidated') THEN coalesce(predicate, predicate_code) END AS target"""
#: CTEs for DuckDB: ev, the same ledger, and lk, with the lock flag.
LEDGER_SQL = (
    "e0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events), e1 AS (SELECT *, " + _TYPE + " AS kind FROM e0), e2 AS (SELECT "
    + ", ".join(f"{x} AS {c}" for c, x in _COLUMNS.items()).replace("AS STRING)", "AS VARCHAR)")
    + f" FROM e1), ev AS (SELECT *, {_ENTITY}, {_TARGET} FROM e2)"
    + ", lk AS (SELECT *, coalesce(last_value(CASE event_type WHEN 'Locked' THEN true WHEN 'Unlocked' THEN false END IGNORE NULLS) OVER (PARTITION BY entity ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS locked FROM ev WHERE entity IS NOT NULL)"
)
#: CTE st: the reduced state.
STATE_SQL = LEDGER_SQL + """, c0 AS (SELECT *, event_type IN ('OverrideApplied', 'CorrectionApplied') AS ovr,
  CASE WHEN event_type IN ('OverrideApplied', 'CorrectionApplied') THEN 'USER_OVERRIDE' WHEN event_type = 'SemanticAsserted' THEN coalesce(authority, p_authority) ELSE authority END AS au
  FROM lk WHERE NOT locked AND target IS NOT NULL),
c1 AS (SELECT *, coalesce(max(CASE WHEN au = 'USER_OVERRIDE' THEN 1 ELSE 0 END) OVER (PARTITION BY entity, target ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM c0),
c2 AS (SELECT *, ovr OR event_type IN ('SemanticAsserted', 'EntityResolved') AS valued,
  CASE event_type WHEN 'SemanticAsserted' THEN coalesce(object_ref, object_entity_id) WHEN 'EntityResolved' THEN coalesce(target_entity_id, entity_id) ELSE object_ref END AS ob,
  CASE event_type WHEN 'OverrideApplied' THEN 'USER_CONFIRMED' WHEN 'CorrectionApplied' THEN 'USER_CONFIRMED' WHEN 'ContradictionRecorded' THEN 'CONFLICTING' WHEN 'Invalidated' THEN 'INVALIDATED'
   WHEN 'EntityMentioned' THEN 'AMBIGUOUS' WHEN 'EntityResolved' THEN coalesce(p_state, CASE WHEN kind IN ('ALIAS', 'ESTABLISH') THEN 'CONFIRMED' ELSE 'PROBABLE' END) ELSE p_state END AS s
  FROM c1 WHERE ovr OR coalesce(authority, '') = 'USER_OVERRIDE' OR u = 0),
st AS (SELECT entity, target AS predicate,
  (arg_max(struct_pack(v := ob), seq) FILTER (WHERE valued)).v AS object_ref,
  (arg_max(struct_pack(v := confidence), seq) FILTER (WHERE (event_type = 'OverrideApplied' AND has_confidence) OR (event_type IN ('SemanticAsserted', 'EntityResolved') AND confidence IS NOT NULL))).v AS confidence,
  (arg_max(struct_pack(v := au), seq) FILTER (WHERE au IS NOT NULL OR event_type = 'EntityResolved')).v AS authority,
  coalesce(arg_max(s, seq) FILTER (WHERE s IS NOT NULL), 'UNKNOWN') AS state, max(seq) AS seq
  FROM c2 GROUP BY entity, target)"""
#: CTE ed: the edges with active and superseded_by.
EDGES_SQL = LEDGER_SQL + """, a0 AS (
  SELECT entity AS subject, target AS predicate, object_ref, coalesce(scope, 'GLOBAL') AS scope, relationship_type, seq, 'm' AS origin, coalesce(p_state, 'UNKNOWN') AS state, coalesce(p_authority, authority, 'machine') AS authority, confidence
  FROM lk WHERE NOT locked AND event_type = 'SemanticAsserted' AND target IS NOT NULL
  UNION ALL
  SELECT entity, target, object_ref, coalesce(scope, 'GLOBAL'), relationship_type, seq, 'u', 'USER_CONFIRMED', 'USER_OVERRIDE', confidence
  FROM lk WHERE NOT locked AND event_type IN ('OverrideApplied', 'CorrectionApplied') AND target IS NOT NULL AND object_ref IS NOT NULL),
a1 AS (SELECT * FROM a0 QUALIFY row_number() OVER (PARTITION BY origin, subject, predicate, object_ref, scope, relationship_type ORDER BY seq DESC) = 1),
s0 AS (SELECT entity, target, relationship_type AS r, CASE WHEN event_type = 'CorrectionApplied' THEN prior_ref END AS prior, seq FROM lk WHERE NOT locked AND event_type IN ('OverrideApplied', 'CorrectionApplied') AND target IS NOT NULL),
s1 AS (SELECT entity, target, scope AS sc, relationship_type AS r, seq FROM ev WHERE event_type = 'Invalidated' AND entity IS NOT NULL),
a2 AS (SELECT a1.*, greatest(
  (SELECT max(s0.seq) FROM s0 WHERE s0.entity = a1.subject AND s0.target = a1.predicate AND s0.seq > a1.seq AND (s0.r IS NULL OR s0.r = a1.relationship_type) AND (s0.prior IS NULL OR s0.prior = a1.object_ref)),
  (SELECT max(s1.seq) FROM s1 WHERE s1.entity = a1.subject AND (s1.target IS NULL OR s1.target = a1.predicate) AND s1.seq > a1.seq AND (s1.sc IS NULL OR s1.sc = a1.scope) AND (s1.r IS NULL OR s1.r = a1.relationship_type))) AS superseded_by,
  (SELECT max(q.seq) FROM ev q WHERE q.event_type = 'ContradictionRecorded' AND q.entity = a1.subject AND q.target = a1.predicate) AS q FROM a1),
ed AS (SELECT subject, predicate, object_ref, scope, relationship_type, origin, CASE WHEN superseded_by IS NULL AND q > seq THEN 'CONFLICTING' ELSE state END AS state, authority, confidence, seq, superseded_by IS NULL AS active, superseded_by FROM a2)"""
