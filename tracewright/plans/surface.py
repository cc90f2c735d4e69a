"""Queries of the typed surface, audits, reports and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import audit, edges, lineage, state
from tracewright.plans import derive
from tracewright.plans.structured import StructuredQuery, page_with_total, structured


def tables(s, d) -> dict[str, DataFrame]:
    """The tables of the surface from the driver's."""
    m = s.read.parquet(f"{d}/source_mention.parquet")
    a = s.read.parquet(f"{d}/semantic_assertion.parquet")
    tuples = m.where("work_id is not null").select("work_id", "source_id").distinct().groupBy("work_id").agg(F.collect_set(F.struct("source_id", "work_id", F.lit(None).cast("string").alias("continuity_id"))).alias("tuples"))
    return {
        "state": s.read.parquet(f"{d}/current_state.parquet").join(tuples, "work_id", "left"),
        "edges": edges.edge_states(derive.ledger(s, d)).where("active"),
        "scenes": s.read.parquet(f"{d}/scene_boundary.parquet").withColumnRenamed("boundary_id", "id"),
        "evidence": a.select(F.explode("support_refs").alias("locator")).distinct().withColumn("source_id", F.regexp_extract("locator", "^source://([^/]+)/", 1)),
        "correspondences": a.where("upper(trim(predicate_code)) = 'CORRESPONDS_TO'"),
        "mentions": m.dropDuplicates(["mention_id"]),
        "resolved": s.read.parquet(f"{d}/semantic_event.parquet").where("event_type = 'EntityMentioned' and payload.entity_id is not null").select("payload.mention_id"),
    }


def _ask(q: StructuredQuery, columns: list[str], paged: bool = True):
    return lambda s, d: structured(tables(s, d), q, paged).select(*columns)


def _links(s, d) -> DataFrame:
    a = s.read.parquet(f"{d}/semantic_assertion.parquet").where("subject_ref is not null and object_ref is not null")
    return a.select(F.col("subject_ref").alias("subject"), F.upper(F.trim("predicate_code")).alias("predicate"), "object_ref").distinct()


def _runs(s, d) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select(F.concat(F.lit("stage-"), (F.col("event_id") % 7).cast("string")).alias("stage"), F.expr("CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'retry' END").alias("action"), "ts")


def _jobs(s, d) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 50).alias("job_id"), F.concat(F.lit("stage-"), (F.col("event_id") % 3).cast("string")).alias("stage"), "event_id", "event_type")
    last = e.groupBy("job_id", "stage").agg(F.max_by("event_type", "event_id").alias("t"))
    return lineage.job_status(last.select("job_id", "stage", F.expr("CASE WHEN t = 'error' AND job_id % 3 = 0 THEN 'FAILED' WHEN t IN ('click', 'view', 'error') THEN 'COMPLETE' ELSE 'RUNNING' END").alias("status")))


def _scoped(s, d) -> DataFrame:
    """The entities of one work that one of its sources tells of: both must stand in one membership."""
    m = s.read.parquet(f"{d}/source_mention.parquet").where("work_id is not null")
    at = m.agg(F.min(F.struct("work_id", "source_id")).alias("x")).first()["x"]
    q = StructuredQuery("ENTITY", work_id=at.work_id, source_id=at.source_id) if at else StructuredQuery("ENTITY", work_id="")
    return structured(tables(s, d), q, False).select("entity_ref", "display_label")


def _start(s, d) -> DataFrame:
    return _links(s, d).agg(F.min("subject").alias("ref"))


_EDGE = ["subject", "predicate", "object_ref", "scope", "relationship_type", "origin", "seq"]
_LIN = "e(stage, depends_on) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b, _ in lineage.STAGES) + "), r(root, stage, distance) AS (SELECT depends_on, stage, 1 FROM e UNION SELECT r.root, e.stage, r.distance + 1 FROM r JOIN e ON e.depends_on = r.stage), de AS (SELECT root, stage, min(distance) AS distance FROM r GROUP BY 1, 2)"
_ED = f"WITH {derive.EDGES_SQL} "
_AUDIT = derive.STATE_SQL.replace("), e1 AS", "), e1 AS", 1).replace(
    ", lk AS (SELECT *,", ", la AS (SELECT entity, max(seq) AS last FROM ev WHERE entity IS NOT NULL AND event_type NOT IN ('Locked', 'Unlocked') GROUP BY 1), lk AS (SELECT *,", 1
).replace("FROM ev WHERE entity IS NOT NULL)", "FROM ev JOIN la USING (entity) WHERE entity IS NOT NULL AND seq < last)", 1)

QUERIES = {
    "q_entity_page": _ask(StructuredQuery("ENTITY", limit=50, offset=5), ["entity_ref", "display_label", "state", "work_id"]),
    "q_entity_name": _ask(StructuredQuery("ENTITY", name="ar"), ["entity_ref", "display_label"], False),
    "q_entity_alias": _ask(StructuredQuery("ENTITY", alias="the silent badger"), ["entity_ref", "display_label"], False),
    "q_entity_scope_tuple": lambda s, d: structured(t := tables(s, d), StructuredQuery("ENTITY"), False).select("entity_ref", F.explode("tuples").alias("t")).groupBy("entity_ref", "t.work_id").agg(F.count("*").alias("sources")),
    "q_entity_total": lambda s, d: page_with_total(structured(tables(s, d), StructuredQuery("ENTITY"), False).select("entity_ref", "display_label"), ["entity_ref"], 20, 40),
    "q_entity_scoped": _scoped,
    "q_utterance": _ask(StructuredQuery("UTTERANCE", min_confidence=0.3), ["subject", "object_ref", "scope", "relationship_type", "origin", "seq", "confidence", "result_kind"], False),
    "q_scene": _ask(StructuredQuery("SCENE", start=10.0, end=60.0), ["id", "source_id", "start_s", "end_s"], False),
    "q_evidence": _ask(StructuredQuery("EVIDENCE", locator="/text/p[0-9]$|/TEXT/p1"), ["locator", "source_id"], False),
    "q_correspondence": _ask(StructuredQuery("CORRESPONDENCE", min_confidence=0.5), ["id", "subject_ref", "object_ref", "confidence"], False),
    "q_contradictions": _ask(StructuredQuery("CONTRADICTIONS", limit=200), ["subject", "predicate", "object_ref", "state", "seq"], False),
    "q_unresolved_aliases": _ask(StructuredQuery("UNRESOLVED_ALIASES"), ["mention_id", "work_id"], False),
    "q_traversal": lambda s, d: lineage.traverse(_links(s, d), _start(s, d), 4),
    "q_relationship_edges": _ask(StructuredQuery("RELATIONSHIP_EDGES", predicate="RELATED_TO", relationship_type="ALLY", scope="GLOBAL"), _EDGE, False),
    "q_temporal_overlap": lambda s, d: s.read.parquet(f"{d}/source_time.parquet").where("end_ms >= 20000 and start_ms <= 30000").select("time_id", "source_id", "start_ms", "end_ms").distinct(),
    "q_spatial_contains": lambda s, d: _spatial(s, d),
    "audit_history": lambda s, d: audit.history(derive.ledger(s, d), "e:7").select("seq", "event_type", "authority", "target"),
    "audit_prior": lambda s, d: audit.prior_states(derive.ledger(s, d)),
    "audit_causes": lambda s, d: audit.causes(e := s.read.parquet(f"{d}/semantic_event.parquet").select("seq", "causation_id").distinct(), e.where("causation_id is not null").select("seq")),
    "report_stage": lambda s, d: lineage.stage_report(_runs(s, d)),
    "job_status": _jobs,
    "lineage_descendants": lambda s, d: lineage.descendants(lineage.stage_edges(s)),
    "invalidation_unaffected": lambda s, d: lineage.unaffected(lineage.stage_edges(s)),
    "freshness": lambda s, d: lineage.freshness(s.read.parquet(f"{d}/semantic_event.parquet").agg(F.max("seq").alias("tail")), s.read.parquet(f"{d}/current_state.parquet").groupBy(F.col("predicate").alias("name")).agg(F.max("seq").alias("applied_seq"), F.lit(False).alias("paused"))),
}


def _spatial(s, d) -> DataFrame:
    from tracewright.plans.structured import spatial_contains

    e = s.read.parquet(f"{d}/semantic_event.parquet").where("payload.spatial is not null")
    first = F.get_json_object("payload.spatial", "$.region")
    return e.select("seq", first.alias("region"), spatial_contains(F.col("payload.spatial"), {"region": "north"}).alias("inside")).distinct()


_TU = "tu AS (SELECT DISTINCT work_id, source_id FROM source_mention WHERE work_id IS NOT NULL)"
_EN = "en AS (SELECT * FROM current_state WHERE object_ref IS NOT NULL AND coalesce(state, '') <> 'INVALIDATED' AND predicate IN ('CANONICAL_IDENTITY', 'CANONICAL_ENTITY') QUALIFY row_number() OVER (PARTITION BY entity_ref ORDER BY predicate <> 'CANONICAL_IDENTITY', coalesce(seq, 0) DESC) = 1)"
SQL = {
    "q_entity_page": f"WITH {_EN} SELECT entity_ref, display_label, state, work_id FROM en ORDER BY entity_ref LIMIT 50 OFFSET 5",
    "q_entity_name": f"WITH {_EN} SELECT entity_ref, display_label FROM en WHERE contains(lower(display_label), 'ar')",
    "q_entity_alias": f"WITH {_EN} SELECT entity_ref, display_label FROM en WHERE len(list_filter(aliases, lambda a: lower(a) = 'the silent badger')) > 0",
    "q_entity_scope_tuple": f"WITH {_EN}, {_TU} SELECT entity_ref, work_id, count(*) AS sources FROM en JOIN tu USING (work_id) GROUP BY 1, 2",
    "q_entity_total": f"WITH {_EN} SELECT entity_ref, display_label, (SELECT count(*) FROM en) AS total FROM en ORDER BY entity_ref LIMIT 20 OFFSET 40",
    "q_entity_scoped": f"WITH {_EN}, {_TU}, w AS (SELECT min(work_id) AS w FROM tu), x AS (SELECT w, min(source_id) AS s FROM tu, w WHERE work_id = w GROUP BY w) SELECT entity_ref, display_label FROM en WHERE work_id = (SELECT w FROM x) AND EXISTS (SELECT 1 FROM tu, x WHERE tu.work_id = x.w AND tu.source_id = x.s)",
    "q_utterance": _ED + "SELECT subject, object_ref, scope, relationship_type, origin, seq, confidence, CASE WHEN authority = 'USER_OVERRIDE' THEN 'INTERPRETATION' ELSE 'SOURCE_EVIDENCE' END AS result_kind FROM ed WHERE active AND predicate = 'SPEAKS' AND confidence >= 0.3",
    "q_scene": "SELECT boundary_id AS id, source_id, start_s, end_s FROM scene_boundary WHERE end_s >= 10.0 AND start_s <= 60.0",
    "q_evidence": "SELECT locator, regexp_extract(locator, '^source://([^/]+)/', 1) AS source_id FROM (SELECT DISTINCT unnest(support_refs) AS locator FROM semantic_assertion) WHERE regexp_matches(locator, '/text/p[0-9]$|/TEXT/p1', 'i')",
    "q_correspondence": "SELECT id, subject_ref, object_ref, confidence FROM semantic_assertion WHERE upper(trim(predicate_code)) = 'CORRESPONDS_TO' AND confidence >= 0.5",
    "q_contradictions": _ED + "SELECT subject, predicate, object_ref, state, seq FROM ed WHERE active AND state = 'CONFLICTING'",
    "q_unresolved_aliases": "SELECT DISTINCT mention_id, work_id FROM source_mention WHERE entity_id IS NULL AND mention_id NOT IN (SELECT payload.mention_id FROM semantic_event WHERE event_type = 'EntityMentioned' AND payload.entity_id IS NOT NULL AND payload.mention_id IS NOT NULL)",
    "q_traversal": "WITH RECURSIVE l AS (SELECT DISTINCT subject_ref AS subject, upper(trim(predicate_code)) AS predicate, object_ref FROM semantic_assertion WHERE subject_ref IS NOT NULL AND object_ref IS NOT NULL), t(ref, predicate, distance) AS (SELECT object_ref, predicate, 1 FROM l WHERE subject = (SELECT min(subject) FROM l) UNION SELECT l.object_ref, l.predicate, t.distance + 1 FROM t JOIN l ON l.subject = t.ref WHERE t.distance < 4) SELECT ref, predicate, CAST(min(distance) AS INT) AS distance FROM t GROUP BY 1, 2",
    "q_relationship_edges": _ED + "SELECT subject, predicate, object_ref, scope, relationship_type, origin, seq FROM ed WHERE active AND predicate = 'RELATED_TO' AND relationship_type = 'ALLY' AND scope = 'GLOBAL'",
    "q_temporal_overlap": "SELECT DISTINCT time_id, source_id, start_ms, end_ms FROM source_time WHERE end_ms >= 20000 AND start_ms <= 30000",
    "q_spatial_contains": "SELECT DISTINCT seq, json_extract_string(payload.spatial, '$.region') AS region, coalesce(json_extract_string(payload.spatial, '$.region') = 'north', false) AS inside FROM semantic_event WHERE payload.spatial IS NOT NULL",
    "audit_history": f"WITH {derive.LEDGER_SQL} SELECT seq, event_type, authority, target FROM ev WHERE 'e:7' IN (coalesce(subject_ref, ''), coalesce(entity_ref, ''), coalesce(source_id, ''), coalesce(entity_id, ''))",
    "audit_prior": f"WITH {_AUDIT} SELECT * FROM st",
    "audit_causes": "WITH RECURSIVE l AS (SELECT DISTINCT seq, causation_id FROM semantic_event WHERE causation_id IS NOT NULL), c(seq, cause, distance) AS (SELECT seq, causation_id, 1 FROM l UNION SELECT c.seq, l.causation_id, c.distance + 1 FROM c JOIN l ON l.seq = c.cause) SELECT seq, cause, CAST(min(distance) AS INT) AS distance FROM c GROUP BY 1, 2",
    "report_stage": "WITH r AS (SELECT 'stage-' || CAST(event_id % 7 AS VARCHAR) AS stage, CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'retry' END AS action, ts FROM events) SELECT stage, count(*) FILTER (WHERE action = 'start') AS start, count(*) FILTER (WHERE action = 'retry') AS retry, count(*) FILTER (WHERE action = 'complete') AS complete, count(*) FILTER (WHERE action = 'fail') AS fail, CASE WHEN max(ts) FILTER (WHERE action = 'complete') >= min(ts) FILTER (WHERE action = 'start') THEN epoch_us(max(ts) FILTER (WHERE action = 'complete')) - epoch_us(min(ts) FILTER (WHERE action = 'start')) END AS micros FROM r GROUP BY 1",
    "job_status": "WITH e AS (SELECT user_id % 50 AS job_id, 'stage-' || CAST(event_id % 3 AS VARCHAR) AS stage, arg_max(event_type, event_id) AS t FROM events GROUP BY 1, 2), s AS (SELECT job_id, CASE WHEN t = 'error' AND job_id % 3 = 0 THEN 'FAILED' WHEN t IN ('click', 'view', 'error') THEN 'COMPLETE' ELSE 'RUNNING' END AS s FROM e) SELECT job_id, CASE WHEN bool_or(s = 'FAILED') THEN 'FAILED' WHEN count(*) FILTER (WHERE s = 'COMPLETE') = count(*) THEN 'COMPLETE' ELSE 'RUNNING' END AS status, count(*) FILTER (WHERE s = 'COMPLETE') AS complete FROM s GROUP BY 1",
    "lineage_descendants": f"WITH RECURSIVE {_LIN} SELECT root, stage, distance FROM de",
    "invalidation_unaffected": f"WITH RECURSIVE {_LIN}, al AS (SELECT stage FROM e UNION SELECT depends_on FROM e) SELECT al.stage AS root, (SELECT count(*) FROM al) - 1 - count(de.stage) AS unaffected FROM al LEFT JOIN de ON de.root = al.stage GROUP BY 1",
    "freshness": "WITH t AS (SELECT max(seq) AS tail FROM semantic_event) SELECT predicate AS name, tail - max(seq) AS lag, CASE WHEN tail - max(seq) <= 0 THEN 'fresh' ELSE 'transient-lag' END AS status FROM current_state, t GROUP BY predicate, tail",
}
