"""The queries of the general problems: intervals and change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.changefeed import apply_changes
from tracewright.operators.intervals import millis, periods_and_gaps


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods and gaps of every track of source_time and scene_boundary."""
    a = spark.read.parquet(f"{sf_dir}/source_time.parquet").select(F.lit("source_time").alias("record_kind"), "source_id", "track_id", F.col("start_ms").alias("s_"), F.col("end_ms").alias("e_"))
    b = spark.read.parquet(f"{sf_dir}/scene_boundary.parquet").select(F.lit("scene_boundary").alias("record_kind"), "source_id", "track_id", millis(F.col("start_s")).alias("s_"), millis(F.col("end_s")).alias("e_"))
    return periods_and_gaps(a.unionByName(b), ["record_kind", "source_id", "track_id"], "s_", "e_")


_VALUES = ("object_ref", "authority", "state", "confidence")


def _state_after_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.read.parquet(f"{sf_dir}/current_state.parquet").select(F.col("entity_ref").alias("entity"), "predicate", "seq", *_VALUES)
    feed = spark.read.parquet(f"{sf_dir}/semantic_event.parquet").select(
        F.col("event_type").alias("kind"),
        F.coalesce("payload.subject_ref", "payload.entity_ref").alias("entity"),
        F.coalesce("payload.predicate_code", "payload.predicate").alias("predicate"),
        "seq",
        F.col("idempotency_key").alias("k"),
        F.col("payload.object_ref").alias("object_ref"),
        "authority",
        F.col("payload.state").alias("state"),
        "confidence",
    )
    rows = apply_changes(base, feed, values=_VALUES).where("predicate <> 'CANONICAL_IDENTITY'")
    return rows.select(F.col("entity").alias("entity_ref"), "predicate", "seq", *_VALUES)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_ref, predicate, seq of every row of the state after the whole of semantic_event, applied to current_state."""
    return _state_after_feed(spark, sf_dir).select("entity_ref", "predicate", "seq")


def p3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with all their values."""
    return _state_after_feed(spark, sf_dir)


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_rows": p3_rows}

SQL = {
    "p2_found": """
WITH r AS (
  SELECT 'source_time' AS record_kind, source_id, track_id, start_ms AS s, end_ms AS e FROM source_time
  UNION ALL
  SELECT 'scene_boundary', source_id, track_id, CAST(round(start_s * 1000) AS BIGINT), CAST(round(end_s * 1000) AS BIGINT) FROM scene_boundary
), d AS (
  SELECT record_kind, source_id, track_id, s, max(e) AS e FROM r WHERE s < e GROUP BY ALL
), m AS (
  SELECT *, max(e) OVER (PARTITION BY record_kind, source_id, track_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM d
), g AS (
  SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY record_kind, source_id, track_id ORDER BY s) AS n FROM m
), p AS (
  SELECT record_kind, source_id, track_id, n, min(s) AS s, max(e) AS e FROM g GROUP BY ALL
)
SELECT record_kind, source_id, track_id, 'period' AS span_kind, s AS start_ms, e AS end_ms FROM p
UNION ALL
SELECT record_kind, source_id, track_id, 'gap', e, nx FROM (SELECT *, lead(s) OVER (PARTITION BY record_kind, source_id, track_id ORDER BY s) AS nx FROM p) WHERE nx IS NOT NULL
""",
    "p3_found": """
WITH ev AS (
  SELECT DISTINCT event_type AS kind, coalesce(payload.subject_ref, payload.entity_ref) AS e, coalesce(payload.predicate_code, payload.predicate) AS p, seq, idempotency_key AS k FROM semantic_event
), ok AS (
  SELECT * FROM ev WHERE k IS NULL OR seq = (SELECT min(x.seq) FROM ev x WHERE x.k = ev.k)
), img AS (
  SELECT entity_ref AS e, predicate AS p, seq FROM current_state
  UNION
  SELECT e, p, seq FROM ok WHERE kind IN ('SemanticAsserted', 'OverrideApplied', 'CorrectionApplied') AND e IS NOT NULL AND p IS NOT NULL
), last AS (
  SELECT e, p, max(seq) AS seq FROM img GROUP BY e, p
)
SELECT e AS entity_ref, p AS predicate, seq FROM last
WHERE p <> 'CANONICAL_IDENTITY' AND NOT EXISTS (
  SELECT 1 FROM ok d WHERE d.kind = 'Invalidated' AND d.e = last.e AND (d.p IS NULL OR d.p = last.p) AND d.seq >= last.seq)
""",
    "p3_rows": """
WITH ev AS (
  SELECT DISTINCT event_type AS kind, coalesce(payload.subject_ref, payload.entity_ref) AS e, coalesce(payload.predicate_code, payload.predicate) AS p, seq, idempotency_key AS k,
    payload.object_ref AS object_ref, authority, payload.state AS state, confidence FROM semantic_event
), ok AS (
  SELECT * FROM ev WHERE k IS NULL OR seq = (SELECT min(x.seq) FROM ev x WHERE x.k = ev.k)
), img AS (
  SELECT entity_ref AS e, predicate AS p, seq, 0 AS rank, object_ref, authority, state, confidence FROM current_state
  UNION ALL
  SELECT e, p, seq, 1, object_ref, authority, state, confidence FROM ok WHERE kind IN ('SemanticAsserted', 'OverrideApplied', 'CorrectionApplied') AND e IS NOT NULL AND p IS NOT NULL
), last AS (
  SELECT * FROM img QUALIFY row_number() OVER (PARTITION BY e, p ORDER BY seq DESC, rank DESC, object_ref DESC NULLS LAST, authority DESC NULLS LAST, state DESC NULLS LAST, confidence DESC NULLS LAST) = 1
)
SELECT e AS entity_ref, p AS predicate, seq, object_ref, authority, state, confidence FROM last
WHERE p <> 'CANONICAL_IDENTITY' AND NOT EXISTS (
  SELECT 1 FROM ok d WHERE d.kind = 'Invalidated' AND d.e = last.e AND (d.p IS NULL OR d.p = last.p) AND d.seq >= last.seq)
""",
}
