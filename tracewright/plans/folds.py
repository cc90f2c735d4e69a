"""Queries over the ledger and its folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import edges, ledger, state
from tracewright.plans import derive


def _state(spark, sf) -> DataFrame:
    return state.reduce_state(derive.ledger(spark, sf))


def _edges(spark, sf) -> DataFrame:
    return edges.edge_states(derive.ledger(spark, sf))


def _semantic(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/semantic_event.parquet")


def _poison(spark, sf) -> DataFrame:
    e = derive.ledger(spark, sf).select("seq", "event_type", "authority", "target", F.array_compact(F.array("entity", "object_ref")).alias("refs"))
    bad = spark.read.parquet(f"{sf}/events.parquet").where("event_id % 101 = 0").select(F.concat(F.lit("e:"), F.col("user_id").cast("string")).alias("ref"))
    return ledger.poison(e, bad)


def _facts(spark, sf) -> DataFrame:
    a = edges.activations(derive.ledger(spark, sf)).where("origin = 'm'")
    return a.select(F.concat_ws("|", "subject", "predicate", F.coalesce("object_ref", F.lit("-")), "scope", F.coalesce("relationship_type", F.lit("-"))).alias("fact_id"), "seq", "authority", "confidence", "state")


_POISON_SQL = f"WITH {derive.LEDGER_SQL}, bad AS (SELECT DISTINCT concat('e:', CAST(user_id AS VARCHAR)) AS ref FROM events WHERE event_id % 101 = 0), po AS (SELECT seq, event_type, authority, target, CASE WHEN event_type IN ('OverrideApplied','CorrectionApplied','EntityResolved','Locked','Unlocked','Invalidated','ReferenceRebound') OR coalesce(authority, '') = 'USER_OVERRIDE' THEN 'PAUSE' WHEN entity IN (FROM bad) OR object_ref IN (FROM bad) THEN 'SKIP' ELSE 'APPLY' END AS verdict FROM ev)"
_ST = f"WITH {derive.STATE_SQL} "
_ED = f"WITH {derive.EDGES_SQL} "
_MISSING = {
    t: "[" + ", ".join(f"CASE WHEN payload.{f} IS NULL THEN '{f}' END" for f in fs if f) + "]" for t, fs in ledger.REQUIRED.items()
}
_LATEST_SQL = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in ledger.LATEST.items()) + " ELSE 1 END"

QUERIES = {
    "state_reduce": _state,
    "state_in_order": lambda s, d: state.reduce_in_order(derive.ledger(s, d)),
    "state_conflicting": lambda s, d: _state(s, d).where("state = 'CONFLICTING'").select("entity", "predicate", "object_ref", "seq"),
    "state_user_confirmed": lambda s, d: _state(s, d).where("state = 'USER_CONFIRMED'").groupBy("predicate").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq")),
    "state_locks": lambda s, d: state.with_locks(derive.ledger(s, d).where("entity is not null")).where("locked").select("seq", "entity", "event_type"),
    "state_checksum": lambda s, d: state.checksum(_state(s, d)),
    "state_authority": lambda s, d: _state(s, d).groupBy("authority", "state").agg(F.count("*").alias("n")),
    "edges_active": lambda s, d: _edges(s, d).where("active").drop("active", "superseded_by"),
    "edges_superseded": lambda s, d: _edges(s, d).where("not active").select("subject", "predicate", "object_ref", "scope", "relationship_type", "origin", "seq", "superseded_by"),
    "edges_conflicting": lambda s, d: _edges(s, d).where("state = 'CONFLICTING'").select("subject", "predicate", "object_ref", "scope", "relationship_type", "origin", "seq"),
    "poison_classify": lambda s, d: _poison(s, d).groupBy("event_type", "verdict").agg(F.count("*").alias("n")),
    "poison_first_pause": lambda s, d: _poison(s, d).agg(F.min(F.when(F.col("verdict") == "PAUSE", F.col("seq"))).alias("pause_seq"), F.sum((F.col("verdict") == "SKIP").cast("int")).cast("bigint").alias("skipped")),
    "pause_policy": lambda s, d: derive.ledger(s, d).select("event_type", ledger.pauses(F.col("event_type"), F.when(F.col("seq") % 5 == 0, "Speaker").otherwise(F.col("predicate"))).alias("pauses")).groupBy("event_type", "pauses").agg(F.count("*").alias("n")),
    "ledger_dedupe": lambda s, d: ledger.first_of_key(_semantic(s, d)).where("seq > first_seq").distinct(),
    "ledger_upcast": lambda s, d: ledger.upcast(_semantic(s, d)).groupBy("event_type", "event_version", "version_up", "scope_up", "relationship_type_up").agg(F.count("*").alias("n")),
    "ledger_validate": lambda s, d: _semantic(s, d).select("event_type", F.explode(ledger.missing_fields()).alias("field")).groupBy("event_type", "field").agg(F.count("*").alias("n")),
    "ledger_append": lambda s, d: ledger.append(
        _semantic(s, d).where("event_type <> 'StageCompleted'"),
        _semantic(s, d).where("event_type = 'StageCompleted'").select("event_type", "seq", "idempotency_key", "tx_time").withColumnRenamed("seq", "was").distinct(), ["was", "tx_time"],
    ).select("seq", "was", "idempotency_key"),
    "assertion_mirror": lambda s, d: ledger.mirror(_facts(s, d)),
    "ledger_tail": lambda s, d: _semantic(s, d).agg(F.max("seq").alias("tail"), F.countDistinct("seq").alias("events")),
}

SQL = {
    "state_reduce": _ST + "SELECT * FROM st",
    "state_in_order": _ST + "SELECT * FROM st",
    "state_conflicting": _ST + "SELECT entity, predicate, object_ref, seq FROM st WHERE state = 'CONFLICTING'",
    "state_user_confirmed": _ST + "SELECT predicate, count(*) AS n, max(seq) AS last_seq FROM st WHERE state = 'USER_CONFIRMED' GROUP BY 1",
    "state_locks": f"WITH {derive.LEDGER_SQL} SELECT seq, entity, event_type FROM lk WHERE locked",
    "state_authority": _ST + "SELECT authority, state, count(*) AS n FROM st GROUP BY 1, 2",
    "state_checksum": _ST + ", h AS (SELECT sha256(concat_ws('|', entity, predicate, coalesce(object_ref, ''), coalesce(authority, ''), state, CAST(seq AS VARCHAR))) AS x FROM st) SELECT count(*) AS rows, concat_ws('-', "
    + ", ".join(f"CAST(sum(CAST(('0x' || substr(x, {1 + 12 * i}, 12)) AS BIGINT)::HUGEINT) % 281474976710656 AS VARCHAR)" for i in range(3)) + ") AS checksum FROM h",
    "edges_active": _ED + "SELECT * EXCLUDE (active, superseded_by) FROM ed WHERE active",
    "edges_superseded": _ED + "SELECT subject, predicate, object_ref, scope, relationship_type, origin, seq, superseded_by FROM ed WHERE NOT active",
    "edges_conflicting": _ED + "SELECT subject, predicate, object_ref, scope, relationship_type, origin, seq FROM ed WHERE state = 'CONFLICTING'",
    "poison_classify": _POISON_SQL + " SELECT event_type, verdict, count(*) AS n FROM po GROUP BY 1, 2",
    "poison_first_pause": _POISON_SQL + " SELECT min(seq) FILTER (WHERE verdict = 'PAUSE') AS pause_seq, CAST(count(*) FILTER (WHERE verdict = 'SKIP') AS BIGINT) AS skipped FROM po",
    "pause_policy": f"WITH {derive.LEDGER_SQL} SELECT event_type, event_type IN ('OverrideApplied','CorrectionApplied','EntityResolved','Invalidated') AND (seq % 5 = 0 OR predicate IS NULL) AS pauses, count(*) AS n FROM ev GROUP BY 1, 2",
    "ledger_dedupe": "SELECT DISTINCT seq, first_seq FROM (SELECT seq, min(seq) OVER (PARTITION BY idempotency_key) AS first_seq FROM semantic_event WHERE idempotency_key IS NOT NULL) WHERE seq > first_seq",
    "ledger_upcast": f"SELECT event_type, event_version, greatest(coalesce(event_version, 1), {_LATEST_SQL}) AS version_up, CASE WHEN event_type = 'SemanticAsserted' AND coalesce(event_version, 1) < 2 THEN coalesce(payload.scope, 'GLOBAL') ELSE payload.scope END AS scope_up, CASE WHEN coalesce(event_version, 1) >= {_LATEST_SQL} THEN payload.relationship_type END AS relationship_type_up, count(*) AS n FROM semantic_event GROUP BY ALL",
    "ledger_validate": "SELECT event_type, field, count(*) AS n FROM (SELECT event_type, unnest(CASE event_type " + " ".join(f"WHEN '{t}' THEN {x}" for t, x in _MISSING.items()) + " ELSE [] END) AS field FROM semantic_event) WHERE field IS NOT NULL GROUP BY 1, 2",
    "ledger_append": """WITH l AS (SELECT * FROM semantic_event WHERE event_type <> 'StageCompleted'), b AS (SELECT DISTINCT seq AS was, idempotency_key, tx_time FROM semantic_event WHERE event_type = 'StageCompleted'),
 k AS (SELECT * FROM b WHERE idempotency_key IS NULL UNION ALL (SELECT * FROM b WHERE idempotency_key IS NOT NULL AND idempotency_key NOT IN (SELECT idempotency_key FROM l WHERE idempotency_key IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY was, tx_time) = 1))
 SELECT (SELECT max(seq) FROM l) + row_number() OVER (ORDER BY was, tx_time) AS seq, was, idempotency_key FROM k""",
    "assertion_mirror": f"WITH {derive.EDGES_SQL} SELECT concat_ws('|', subject, predicate, coalesce(object_ref, '-'), scope, coalesce(relationship_type, '-')) AS fact_id, seq, authority, confidence, state FROM a0 WHERE origin = 'm' QUALIFY row_number() OVER (PARTITION BY concat_ws('|', subject, predicate, coalesce(object_ref, '-'), scope, coalesce(relationship_type, '-')) ORDER BY authority = 'USER_OVERRIDE' DESC, seq DESC) = 1",
    "ledger_tail": "SELECT max(seq) AS tail, count(DISTINCT seq) AS events FROM semantic_event",
}
