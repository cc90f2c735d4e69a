"""Queries over identities, replays, evidence and small folds of records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import boxes
from tracewright.operators import evidence, identity, lineage, search
from tracewright.operators.replay import Checkpoints, replay
from tracewright.plans import derive
from tracewright.plans.folds import _POISON_SQL
from tracewright.session import shared_dir

#: The fields of identities, by the number of the event that gives them.
_FIELDS = {
    "predicate": "CASE WHEN event_type IN ('OverrideApplied', 'CorrectionApplied', 'Invalidated') AND seq % 3 = 0 THEN 'CANONICAL_IDENTITY' ELSE predicate END",
    "display_label": "CASE WHEN seq % 11 > 0 THEN concat('L', CAST(seq % 7 AS STRING)) END",
    "canonical_type": "CASE seq % 2 WHEN 0 THEN 'character' ELSE 'organisation' END",
    "classification": "CASE WHEN seq % 4 = 0 THEN 'PROPOSED' END",
    "object_ref": "CASE WHEN event_type IN ('OverrideApplied', 'CorrectionApplied') AND seq % 2 = 0 THEN concat('{\"display_label\":\"J', CAST(seq % 5 AS STRING), '\"}') END",
}


def _identity_ledger(s, d) -> DataFrame:
    e = derive.ledger(s, d)
    e = e.select(*[c for c in e.columns if c not in _FIELDS], *[F.expr(x).alias(c) for c, x in _FIELDS.items()])
    none = F.array().cast("array<string>")
    ids = lambda p, *n: F.when(F.col("seq") % 6 > 0, F.array(*[F.concat(F.lit(p), (F.col("seq") % k).cast("string")) for k in n])).otherwise(none)
    return e.withColumns({"aliases": F.array(F.concat(F.lit("a"), (F.col("seq") % 5).cast("string"))), "support_refs": none, "source_ids": ids("s", 4, 9), "work_ids": ids("w", 3), "continuity_ids": none})


def _identities(s, d) -> DataFrame:
    x = identity.identity_fold(_identity_ledger(s, d))
    return x.select("entity", "display_label", "canonical_type", "classification", F.array_join("aliases", ",").alias("aliases"), F.array_join("source_ids", ",").alias("sources"), F.array_join("work_ids", ",").alias("works"), "state", "confidence", "authority", "seq")


def _replay(s, d) -> DataFrame:
    """The checkpoint of a run that pauses, and of the one that is made to go on."""
    events = derive.ledger(s, d).select("seq", "event_type", "authority", F.array_compact(F.array("entity", "object_ref")).alias("refs"))
    bad = s.read.parquet(f"{d}/events.parquet").where("event_id % 101 = 0").select(F.concat(F.lit("e:"), F.col("user_id").cast("string")).alias("ref"))
    store = Checkpoints(s, f"{shared_dir(s)}/tw-checkpoints-{uuid.uuid4().hex}")
    rows = [replay(store, "state", events, bad, lambda df: None), replay(store, "state", events, bad, lambda df: None), replay(store, "state", events, bad, lambda df: None, force_resume=True)]
    keep = ("applied_seq", "pause_seq", "applied", "skipped")
    return s.createDataFrame([(n, *(r[k] for k in keep)) for n, r in enumerate(rows)], "run int, applied_seq bigint, pause_seq bigint, applied bigint, skipped bigint")


def _assertions(s, d) -> DataFrame:
    return s.read.parquet(f"{d}/semantic_assertion.parquet")


def _mentions(s, d) -> DataFrame:
    return s.read.parquet(f"{d}/source_mention.parquet")


def _tuples(s, d) -> DataFrame:
    """Works as identities: every third with the tuples of its sources, the rest with lists."""
    m = _mentions(s, d).where("work_id is not null").select("work_id", "source_id").distinct()
    t = F.collect_set(F.struct("source_id", "work_id", F.lit("").alias("continuity_id")))
    x = m.groupBy("work_id").agg(t.alias("tuples"), F.collect_set("source_id").alias("source_ids"))
    third = F.ascii(F.substring("work_id", -1, 1)) % 3
    return x.select(F.col("work_id").alias("entity"), F.when(third == 0, F.col("tuples")).alias("tuples"), F.when(third == 2, F.array().cast("array<string>")).otherwise(F.col("source_ids")).alias("source_ids"), F.array("work_id").alias("work_ids"), F.array(F.lit("c1"), F.lit("c2")).alias("continuity_ids"))


def _aliases(s, d) -> DataFrame:
    known = _mentions(s, d).where("entity_id is not null").select(F.col("mention_text").alias("alias"), "entity_id", F.lit(None).cast("string").alias("canonical_entity_id"))
    state = s.read.parquet(f"{d}/current_state.parquet")
    return identity.alias_targets(known, state, derive.ledger(s, d), state.where("predicate = 'CANONICAL_IDENTITY'").select("entity_ref", "aliases"))


def _quarantine(s, d) -> DataFrame:
    loc = _assertions(s, d).select(F.explode("support_refs").alias("locator")).distinct()
    bad = loc.where("length(locator) % 3 = 0").select(F.substring_index("locator", "@", 1).alias("ref"))
    return evidence.quarantined_locators(loc, bad)


def _timed(s, d) -> DataFrame:
    e = s.read.parquet(f"{d}/semantic_event.parquet").select("seq", boxes.instant(F.col("payload.narrative_time.from")).alias("from_"), boxes.instant(F.col("payload.narrative_time.to")).alias("to_")).distinct()
    return evidence.overlapping_edges(e, before=F.lit("2001-06-15T00:00:00Z").cast("timestamp")).select("seq")


def _continuity(s, d) -> DataFrame:
    a = _assertions(s, d)
    one = a.agg(F.min("continuity_id")).first()[0] or ""
    return evidence.within_continuity(a.where("subject_ref is not null").select("id", F.col("subject_ref").alias("subject")).distinct(), a.where("upper(trim(predicate_code)) = 'CORRESPONDS_TO'"), one)


def _parts(s, d) -> DataFrame:
    p = s.read.parquet(f"{d}/part.parquet")
    k, z = F.col("p_partkey"), F.col("p_size")
    return p.select("p_partkey", F.when(k % 2 == 0, F.concat_ws(",", (k % 300).cast("string"), z.cast("string"), (z * 3).cast("string"), (k % 90).cast("string"))).otherwise(F.concat(F.lit("pct:"), F.concat_ws(",", (k % 60).cast("string"), z.cast("string"), F.lit("12.5"), (z / 2).cast("string")))).alias("region"))


_JOBS = "WITH e AS (SELECT user_id % 30 AS job_id, 'stage-' || CAST(event_id % 9 AS VARCHAR) AS stage, arg_max(event_type, event_id) AS t FROM events GROUP BY 1, 2)"


def _incomplete(s, d) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").groupBy((F.col("user_id") % 30).alias("job_id"), F.concat(F.lit("stage-"), (F.col("event_id") % 9).cast("string")).alias("stage")).agg(F.max_by("event_type", "event_id").alias("t"))
    stages = e.select("job_id", "stage", F.when(F.col("t") == "view", "COMPLETE").otherwise("RUNNING").alias("status"))
    jobs = e.groupBy("job_id").agg(F.when(F.max("t") == "view", "COMPLETE").otherwise("FAILED").alias("status"))
    return evidence.incomplete(jobs, stages, jobs.select("job_id", F.explode(F.array(F.lit("stage-1"), F.lit("stage-x"))).alias("stage")))


def _lines(s, d) -> DataFrame:
    return s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_linestatus", (F.col("l_linenumber") * 10).alias("start_frame"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") % 10).alias("end_frame")).distinct()


def _manifests(s, d) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    names = sorted({a for a, _, _ in lineage.STAGES} | {b for _, b, _ in lineage.STAGES})
    return evidence.child_manifests(e.select((F.col("event_id") % 50).alias("job_id"), F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("user_id") % len(names)).cast("int") + 1).alias("stage")).distinct(), lineage.stage_edges(s))


def _filtered(s, d) -> DataFrame:
    """Mentions as search documents under five filters at once: the work, kind and language of the first one, its source's locators, and their segment."""
    m = _mentions(s, d).where("work_id is not null and segment_id is not null and lang is not null and mention_kind is not null")
    docs = m.select("mention_id", "source_id", "work_id", "segment_id", F.lit(None).cast("string").alias("continuity_id"), F.col("entity_id").alias("entity_ref"), F.col("mention_kind").alias("kind"), F.col("lang").alias("language"), F.concat_ws("/", F.lit("source:/"), "source_id", F.lit("text"), "segment_id").alias("locator"))
    one = docs.agg(F.min(F.struct("work_id", "kind", "language", "source_id")).alias("x")).first()["x"]
    if one is None:
        return docs.limit(0).select("mention_id", "segment_id").distinct()
    return search.filtered(docs, work_id=one.work_id, kind=one.kind, language=one.language, source_id=one.source_id, locator_prefix=f"source://{one.source_id}/").select("mention_id", "segment_id").distinct()


QUERIES = {
    "search_filtered": _filtered,
    "identity_fold": _identities,
    "state_alternatives": lambda s, d: identity.alternatives(derive.ledger(s, d)),
    "replay_resume": _replay,
    "scope_tuples": lambda s, d: identity.scope_tuples(_tuples(s, d)),
    "alias_targets": _aliases,
    "branches_incomplete": _incomplete,
    "confidence_mean": lambda s, d: evidence.mean_confidence(_assertions(s, d).where("subject_ref is not null").select("subject_ref", "confidence", (F.size("contradiction_refs") > 0).alias("contradicts")), "subject_ref", 9),
    "target_dominant": lambda s, d: evidence.dominant(_assertions(s, d).where("subject_ref is not null").select("subject_ref", F.col("object_ref").alias("target")), "subject_ref"),
    "locators_quarantined": _quarantine,
    "q_edge_temporal": _timed,
    "q_continuity": _continuity,
    "bursts_words": lambda s, d: evidence.bursts(_lines(s, d).select("l_orderkey", "start_frame", "end_frame").distinct(), "l_orderkey", 0.08),
    "scenes_by_chapter": lambda s, d: evidence.chapter_scenes(_lines(s, d).groupBy("l_orderkey", F.col("l_linenumber").alias("ordinal")).agg(F.min("l_linestatus").alias("chapter")), "l_orderkey"),
    "language_id": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", evidence.language(F.nullif("lang", F.lit("und")), F.when(F.col("doc_id") % 2 == 0, "en")).alias("x")).select("doc_id", "x.*"),
    "speakers_unknown": lambda s, d: evidence.unknown_speakers(s.read.parquet(f"{d}/audio_output.parquet").select("media_id", F.explode("asr.utterances.utterance_index").alias("utterance_index")).distinct(), "media_id"),
    "work_sources": lambda s, d: evidence.works_of(_mentions(s, d).select("work_id", "source_id", F.col("mention_kind").alias("role"))).select("work_id", "source_id", F.array_join("roles", ",").alias("roles")),
    "manifests_child": _manifests,
    "region_box": lambda s, d: _parts(s, d).select("p_partkey", boxes.region_box(F.col("region"), F.lit(400), F.lit(300)).alias("b")).select("p_partkey", "b.*"),
}

_ST = f"WITH {derive.STATE_SQL}"
_A = "WITH a AS (SELECT * FROM semantic_assertion WHERE subject_ref IS NOT NULL)"
_STAGE_NAMES = sorted({a for a, _, _ in lineage.STAGES} | {b for _, b, _ in lineage.STAGES})
_F = {c: x.replace("AS STRING", "AS VARCHAR") for c, x in _FIELDS.items()}
_ID = f"""WITH {derive.LEDGER_SQL}, i0 AS (SELECT * EXCLUDE (predicate, object_ref), {', '.join(f'{x} AS {c}' for c, x in _F.items())} FROM lk WHERE NOT locked),
 i1 AS (SELECT *, event_type IN ('OverrideApplied', 'CorrectionApplied') AS ovr, coalesce(authority, '') = 'USER_OVERRIDE' AS usr, object_ref IS NOT NULL AS part, seq % 6 = 0 AS none FROM i0
  WHERE (event_type = 'EntityResolved' AND kind IN ('ESTABLISH', 'UPDATE')) OR (event_type IN ('OverrideApplied', 'CorrectionApplied', 'Invalidated') AND predicate = 'CANONICAL_IDENTITY')),
 i2 AS (SELECT *, min(seq) FILTER (WHERE usr) OVER (PARTITION BY entity) AS u FROM i1),
 i3 AS (SELECT *, event_type <> 'Invalidated' AND NOT part AS whole FROM i2 WHERE usr OR u IS NULL OR seq <= u),
 i4 AS (SELECT *, max(seq) FILTER (WHERE whole AND none) OVER (PARTITION BY entity) AS gone FROM i3),
 m AS (SELECT entity, f, item, min((seq, pos)) AS pl FROM (SELECT entity, seq, f, unnest(v) AS item, unnest(range(0, len(v))) AS pos FROM (
   SELECT entity, seq, 's' AS f, ['s' || CAST(seq % 4 AS VARCHAR), 's' || CAST(seq % 9 AS VARCHAR)] AS v FROM i4 WHERE whole AND NOT none AND (gone IS NULL OR seq > gone)
   UNION ALL SELECT entity, seq, 'w', ['w' || CAST(seq % 3 AS VARCHAR)] FROM i4 WHERE whole AND NOT none AND (gone IS NULL OR seq > gone))) GROUP BY 1, 2, 3),
 l AS (SELECT entity, string_agg(item, ',' ORDER BY pl) FILTER (WHERE f = 's') AS sources, string_agg(item, ',' ORDER BY pl) FILTER (WHERE f = 'w') AS works FROM m GROUP BY 1),
 o AS (SELECT entity,
  (arg_max(struct_pack(v := CASE WHEN part THEN 'J' || CAST(seq % 5 AS VARCHAR) ELSE display_label END), seq) FILTER (WHERE whole OR part)).v AS display_label,
  (arg_max(struct_pack(v := canonical_type), seq) FILTER (WHERE whole)).v AS canonical_type,
  (arg_max(struct_pack(v := CASE WHEN ovr AND usr THEN coalesce(classification, 'ACCEPTED') ELSE classification END), seq) FILTER (WHERE whole)).v AS classification,
  coalesce((arg_max(struct_pack(v := 'a' || CAST(seq % 5 AS VARCHAR)), seq) FILTER (WHERE whole)).v, '') AS aliases,
  arg_max(CASE WHEN event_type = 'Invalidated' THEN 'INVALIDATED' WHEN usr THEN 'USER_CONFIRMED' WHEN kind = 'ESTABLISH' THEN coalesce(p_state, 'CONFIRMED') ELSE p_state END, seq) FILTER (WHERE event_type = 'Invalidated' OR usr OR kind = 'ESTABLISH' OR p_state IS NOT NULL) AS state,
  arg_max(confidence, seq) FILTER (WHERE confidence IS NOT NULL) AS confidence, arg_max(authority, seq) FILTER (WHERE authority IS NOT NULL) AS authority, max(seq) AS seq, bool_or(event_type <> 'Invalidated') AS made FROM i3 GROUP BY 1)
 SELECT o.entity, display_label, canonical_type, classification, aliases, coalesce(sources, '') AS sources, coalesce(works, '') AS works, coalesce(state, 'CONFIRMED') AS state, confidence, authority, seq FROM o LEFT JOIN l USING (entity) WHERE made"""
_BEFORE = "PARTITION BY entity, target ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

SQL = {
    "search_filtered": "WITH m AS (SELECT * FROM source_mention WHERE work_id IS NOT NULL AND segment_id IS NOT NULL AND lang IS NOT NULL AND mention_kind IS NOT NULL), x AS (SELECT * FROM m ORDER BY work_id, mention_kind, lang, source_id NULLS FIRST LIMIT 1) SELECT DISTINCT m.mention_id, m.segment_id FROM m, x WHERE m.work_id = x.work_id AND m.mention_kind = x.mention_kind AND m.lang = x.lang AND m.source_id = x.source_id",
    "identity_fold": _ID,
    "state_alternatives": _ST + f""", h AS (SELECT *, last_value(CASE WHEN valued THEN struct_pack(v := ob) END IGNORE NULLS) OVER ({_BEFORE}) AS po, last_value(CASE WHEN au IS NOT NULL OR event_type = 'EntityResolved' THEN struct_pack(v := au) END IGNORE NULLS) OVER ({_BEFORE}) AS pa,
  last_value(s IGNORE NULLS) OVER ({_BEFORE}) AS ps, last_value(CASE WHEN (event_type = 'OverrideApplied' AND has_confidence) OR (event_type IN ('SemanticAsserted', 'EntityResolved') AND confidence IS NOT NULL) THEN struct_pack(v := confidence) END IGNORE NULLS) OVER ({_BEFORE}) AS pc, lag(seq) OVER (PARTITION BY entity, target ORDER BY seq) AS was_seq FROM c2)
  SELECT entity, target AS predicate, seq, po.v AS object_ref, CASE WHEN event_type <> 'EntityResolved' THEN pa.v END AS authority, coalesce(ps, 'UNKNOWN') AS state, pc.v AS confidence, was_seq FROM h WHERE event_type IN ('SemanticAsserted', 'EntityResolved') AND ob IS NOT NULL AND po.v IS NOT NULL AND ob <> po.v""",
    "replay_resume": _POISON_SQL + """, p AS (SELECT min(seq) AS p FROM po WHERE verdict = 'PAUSE'), r AS (SELECT p, (SELECT count(*) FROM po WHERE seq < p AND verdict = 'APPLY') AS applied, (SELECT count(*) FROM po WHERE seq < p AND verdict = 'SKIP') AS skipped FROM p)
 SELECT n AS run, p AS applied_seq, p AS pause_seq, applied, skipped FROM r, (VALUES (0), (1)) v(n) UNION ALL SELECT 2, max(seq), NULL, count(*), 0 FROM po""",
    "scope_tuples": """WITH m AS (SELECT DISTINCT work_id, source_id FROM source_mention WHERE work_id IS NOT NULL), t AS (SELECT *, ascii(right(work_id, 1)) % 3 AS k FROM m)
 SELECT work_id AS entity, source_id, work_id, CAST(NULL AS VARCHAR) AS continuity_id FROM t WHERE k = 0 UNION ALL SELECT work_id, source_id, work_id, c FROM t, (VALUES ('c1'), ('c2')) v(c) WHERE k = 1 UNION ALL SELECT DISTINCT work_id, NULL, NULL, NULL FROM t WHERE k = 2""",
    "alias_targets": f"""WITH {derive.LEDGER_SQL}, x AS (SELECT mention_text AS alias, entity_id AS entity_ref, 1 AS rank FROM source_mention WHERE entity_id IS NOT NULL UNION ALL SELECT entity_ref, object_ref, 3 FROM current_state WHERE predicate = 'CANONICAL_ENTITY'
 UNION ALL SELECT entity_id, target_entity_id, 4 FROM ev WHERE event_type = 'EntityResolved' AND kind = 'ALIAS' UNION ALL SELECT lower(unnest(aliases)), entity_ref, 5 FROM current_state WHERE predicate = 'CANONICAL_IDENTITY')
 SELECT alias, entity_ref, min(rank) AS rank FROM x WHERE alias IS NOT NULL AND coalesce(entity_ref, '') <> '' GROUP BY 1, 2""",
    "branches_incomplete": _JOBS + ", j AS (SELECT job_id, max(t) = 'view' AS ok FROM e GROUP BY 1) SELECT job_id, 'job:FAILED' AS branch FROM j WHERE NOT ok UNION ALL SELECT job_id, stage || ':RUNNING' FROM e WHERE t <> 'view' UNION ALL SELECT job_id, s || ':cancelled' FROM j, (VALUES ('stage-1'), ('stage-x')) v(s) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.job_id = j.job_id AND e.stage = s)",
    "confidence_mean": _A + " SELECT subject_ref, CASE WHEN bool_or(coalesce(len(contradiction_refs), 0) > 0) THEN 0.0 ELSE coalesce(round(avg(confidence), 9), 0.0) END AS confidence FROM a GROUP BY 1",
    "target_dominant": _A + " SELECT subject_ref, object_ref AS target FROM (SELECT subject_ref, object_ref, count(*) AS n FROM a WHERE object_ref IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY subject_ref ORDER BY n DESC, object_ref) = 1",
    "locators_quarantined": "WITH l AS (SELECT DISTINCT unnest(support_refs) AS locator FROM semantic_assertion), q AS (SELECT DISTINCT split_part(locator, '@', 1) AS ref FROM l WHERE length(locator) % 3 = 0) SELECT locator FROM l WHERE EXISTS (SELECT 1 FROM q WHERE ref <> '' AND starts_with(l.locator, q.ref))",
    "q_edge_temporal": "WITH e AS (SELECT DISTINCT seq, TRY_CAST(payload.narrative_time.\"from\" AS TIMESTAMPTZ) AS f, TRY_CAST(payload.narrative_time.\"to\" AS TIMESTAMPTZ) AS t FROM semantic_event) SELECT seq FROM e WHERE f <= TIMESTAMPTZ '2001-06-15 00:00:00+00'",
    "q_continuity": "WITH c AS (SELECT * FROM semantic_assertion WHERE upper(trim(predicate_code)) = 'CORRESPONDS_TO' AND continuity_id = (SELECT min(continuity_id) FROM semantic_assertion)), r AS (SELECT subject_ref AS x FROM c UNION SELECT object_ref FROM c) SELECT DISTINCT subject_ref AS subject, id FROM semantic_assertion WHERE subject_ref IN (SELECT x FROM r WHERE x IS NOT NULL)",
    "bursts_words": "WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber * 10 AS s, l_linenumber * 10 + CAST(l_quantity AS INT) % 10 AS e FROM lineitem), n AS (SELECT *, CASE WHEN coalesce((s - lag(e) OVER w) * CAST(0.02 AS DOUBLE) >= CAST(0.08 AS DOUBLE), true) THEN 1 ELSE 0 END AS b FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY s, e)), g AS (SELECT *, CAST(sum(b) OVER (PARTITION BY l_orderkey ORDER BY s, e) AS INT) AS word FROM n) SELECT l_orderkey, word, min(s) AS start_frame, max(e) AS end_frame, count(*) AS bursts FROM g GROUP BY 1, 2",
    "scenes_by_chapter": "WITH l AS (SELECT l_orderkey, l_linenumber AS o, min(l_linestatus) AS c FROM lineitem GROUP BY 1, 2), n AS (SELECT *, CASE WHEN lag(c) OVER w IS DISTINCT FROM c OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS b FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY o)), g AS (SELECT *, CAST(sum(b) OVER (PARTITION BY l_orderkey ORDER BY o) AS INT) AS scene FROM n) SELECT l_orderkey, scene, c AS chapter, min(o) AS first, max(o) AS last FROM g GROUP BY 1, 2, 3",
    "language_id": "SELECT doc_id, CASE WHEN coalesce(nullif(lang, 'und'), '') <> '' THEN lang WHEN doc_id % 2 = 0 THEN 'en' ELSE 'unknown' END AS language, CAST(CASE WHEN coalesce(nullif(lang, 'und'), '') <> '' THEN 0.5 WHEN doc_id % 2 = 0 THEN 0.4 ELSE 0.0 END AS DOUBLE) AS confidence, CASE WHEN coalesce(nullif(lang, 'und'), '') <> '' THEN 'declared' WHEN doc_id % 2 = 0 THEN 'config' ELSE 'unknown' END AS origin FROM documents",
    "speakers_unknown": "WITH u AS (SELECT DISTINCT media_id, u.utterance_index AS utterance_index FROM (SELECT media_id, unnest(asr.utterances) AS u FROM audio_output)) SELECT media_id, utterance_index, 'speaker_unknown_utterance_' || CAST(row_number() OVER (PARTITION BY media_id ORDER BY utterance_index) AS VARCHAR) AS speaker_label, CAST(0.3 AS DOUBLE) AS confidence FROM u",
    "work_sources": "SELECT work_id, source_id, coalesce(string_agg(DISTINCT mention_kind, ',' ORDER BY mention_kind), '') AS roles FROM source_mention WHERE work_id IS NOT NULL AND source_id IS NOT NULL GROUP BY 1, 2",
    "manifests_child": "WITH n AS (SELECT DISTINCT event_id % 50 AS job_id, ([" + ", ".join(f"'{n}'" for n in _STAGE_NAMES) + f"])[user_id % {len(_STAGE_NAMES)} + 1] AS stage FROM events), e(stage, depends_on) AS (SELECT DISTINCT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b, _ in lineage.STAGES) + ")) SELECT e.stage, n.job_id FROM n JOIN e ON e.depends_on = n.stage",
    "region_box": "WITH p AS (SELECT p_partkey AS k, p_size AS z FROM part), b AS (SELECT k, CASE WHEN k % 2 = 0 THEN k % 300 ELSE CAST(round_even(CAST(k % 60 AS DOUBLE) / 100.0 * 400, 0) AS BIGINT) END AS x, CASE WHEN k % 2 = 0 THEN z ELSE CAST(round_even(CAST(z AS DOUBLE) / 100.0 * 300, 0) AS BIGINT) END AS y, CASE WHEN k % 2 = 0 THEN z * 3 ELSE 50 END AS w, CASE WHEN k % 2 = 0 THEN k % 90 ELSE CAST(round_even(CAST(z AS DOUBLE) / 2 / 100.0 * 300, 0) AS BIGINT) END AS h FROM p), c AS (SELECT *, w > 0 AND h > 0 AND x + w <= 400 AND y + h <= 300 AS ok FROM b) SELECT k AS p_partkey, CASE WHEN ok THEN x END AS x, CASE WHEN ok THEN y END AS y, CASE WHEN ok THEN w END AS w, CASE WHEN ok THEN h END AS h FROM c",
}
