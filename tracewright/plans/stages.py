"""Queries over stage runs, search documents, contexts and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import commands, segments, stages
from tracewright.plans import surface
from tracewright.plans.structured import compile_question, structured


def _runs(s, d) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select((F.col("user_id") % 40).alias("job_id"), F.concat(F.lit("stage-"), (F.col("event_id") % 3).cast("string")).alias("stage"), F.when(F.col("event_type") == "click", "COMPLETE").otherwise("RUNNING").alias("status"), F.date_trunc("day", "ts").alias("created_at"), F.array(F.col("event_type"), (F.col("event_id") % 9).cast("string")).alias("refs"))


def _claims(s, d) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("event_id").alias("ord"))
    done = e.where("ord % 10 = 0").select("key")
    return stages.claim(e.where("ord % 10 > 0"), done, "key").groupBy("won").agg(F.count("*").alias("n"), F.sum("ord").alias("total"))


def _search_docs(s, d) -> DataFrame:
    t = surface.tables(s, d)
    ident = t["state"].where("predicate = 'CANONICAL_IDENTITY'")
    links = s.read.parquet(f"{d}/semantic_assertion.parquet").select(F.col("subject_ref").alias("subject"), F.upper(F.trim("predicate_code")).alias("predicate"), "object_ref", F.col("id").alias("fact"))
    return stages.search_documents(s.read.parquet(f"{d}/source_mention.parquet"), ident, links).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("ref").alias("refs"), F.countDistinct("text").alias("texts"))


def _wanted(s, d) -> DataFrame:
    return s.read.parquet(f"{d}/source_mention.parquet").select("segment_id", F.col("mention_id").alias("ref"), F.col("mention_text").alias("text"))


def _ask(question: str, *columns: str):
    return lambda s, d: structured(surface.tables(s, d), compile_question(question), False).select(*columns)


QUERIES = {
    "canonical_evidence": lambda s, d: stages.canonical_refs(_runs(s, d)).select("job_id", "stage", F.array_join("refs", ",").alias("refs"), "ambiguous"),
    "stage_claim": _claims,
    "search_documents": _search_docs,
    "embedding_append": lambda s, d: stages.new_embeddings(_wanted(s, d), _wanted(s, d).where("text is null").withColumn("model", F.lit("m")), "m").select("segment_id", "ref"),
    "neighbour_context": lambda s, d: stages.neighbours(segments.paragraphs(s.read.parquet(f"{d}/documents.parquet")), ["doc_id"], "paragraph", "text").select("doc_id", "paragraph", "before", "after"),
    "path_sort": lambda s, d: s.read.parquet(f"{d}/semantic_assertion.parquet").select(F.explode("support_refs").alias("ref")).distinct().select("ref", stages.path_key(F.regexp_replace("ref", "([a-z])([0-9]+)", "$1/$2")).alias("key"), stages.path_number(F.regexp_replace("ref", "p([0-9]+)@", "p/$1@"), "p", 1).alias("paragraph")),
    "command_override": lambda s, d: commands.override(s.read.parquet(f"{d}/current_state.parquet").where("state = 'USER_CONFIRMED'").select(F.col("entity_ref").alias("subject_ref"), "predicate", "object_ref").distinct()).select("event_type", "event_version", "authority", "payload.subject_ref", "payload.predicate", "payload.object_ref"),
    "question_contradictions": _ask("Are there any contradictions?", "subject", "predicate", "object_ref", "seq"),
    "question_entity": _ask("Who is Stardley?", "entity_ref", "display_label"),
    "question_unresolved": _ask("Which names are unresolved?", "mention_id", "work_id"),
}

_PA = r"pa AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS paragraph, unnest(l) AS text FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[\s\x0b\x1c-\x1f\x{85}\p{Z}]*\n'), lambda x: regexp_replace(x, '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '', 'g')), lambda x: x <> '') AS l FROM documents))"
SQL = {
    "canonical_evidence": "WITH r AS (SELECT user_id % 40 AS job_id, 'stage-' || CAST(event_id % 3 AS VARCHAR) AS stage, date_trunc('day', ts) AS c, [event_type, CAST(event_id % 9 AS VARCHAR)] AS refs FROM events WHERE event_type = 'click'), t AS (SELECT * FROM r QUALIFY rank() OVER (PARTITION BY job_id, stage ORDER BY c DESC) = 1) SELECT job_id, stage, array_to_string(list_sort(list_distinct(flatten(list(refs)))), ',') AS refs, count(*) > 1 AS ambiguous FROM t GROUP BY 1, 2",
    "stage_claim": "WITH e AS (SELECT CAST(user_id AS VARCHAR) || '-' || event_type AS k, event_id AS ord FROM events), w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS n FROM e WHERE ord % 10 > 0) SELECT n = 1 AND k NOT IN (SELECT k FROM e WHERE ord % 10 = 0) AS won, count(*) AS n, CAST(sum(ord) AS BIGINT) AS total FROM w GROUP BY 1",
    "search_documents": "WITH d AS (SELECT 'SOURCE_EVIDENCE' AS kind, mention_id AS ref, mention_text AS text FROM source_mention WHERE mention_text IS NOT NULL UNION SELECT 'CANONICAL_ENTITY', entity_ref, unnest(list_filter(list_concat([display_label], coalesce(aliases, [])), lambda x: x IS NOT NULL)) FROM current_state WHERE predicate = 'CANONICAL_IDENTITY' UNION SELECT 'INTERPRETATION', CASE WHEN upper(trim(predicate_code)) IN ('SPEAKS', 'SAYS', 'UTTERANCE', 'PRONUNCIATION') THEN 'assert:' ELSE 'edge:' END || id, coalesce(object_ref, subject_ref) FROM semantic_assertion) SELECT kind, count(*) AS n, count(DISTINCT ref) AS refs, count(DISTINCT text) AS texts FROM d GROUP BY 1",
    "embedding_append": "SELECT DISTINCT segment_id, mention_id AS ref FROM source_mention WHERE segment_id IS NOT NULL AND (segment_id, mention_id) NOT IN (SELECT (segment_id, mention_id) FROM source_mention WHERE mention_text IS NULL AND segment_id IS NOT NULL)",
    "neighbour_context": f"WITH {_PA} SELECT doc_id, CAST(paragraph AS INT) AS paragraph, lag(right(text, 80)) OVER w AS before, lead(left(text, 80)) OVER w AS after FROM pa WINDOW w AS (PARTITION BY doc_id ORDER BY paragraph)",
    "path_sort": "WITH r AS (SELECT DISTINCT unnest(support_refs) AS ref FROM semantic_assertion) SELECT ref, array_to_string([CASE WHEN regexp_full_match(x, '[0-9]+') THEN lpad(CAST(length(CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END) AS VARCHAR), 9, '0') || '.' || CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END ELSE x END for x in string_split(regexp_replace(ref, '([a-z])([0-9]+)', '\\1/\\2', 'g'), '/')], '/') AS key, coalesce(TRY_CAST(nullif(regexp_extract(regexp_replace(ref, 'p([0-9]+)@', 'p/\\1@', 'g'), 'p/([0-9]+)', 1), '') AS INT), 1) AS paragraph FROM r",
    "command_override": "SELECT DISTINCT 'OverrideApplied' AS event_type, 2 AS event_version, 'USER_OVERRIDE' AS authority, entity_ref AS subject_ref, predicate, object_ref FROM current_state WHERE state = 'USER_CONFIRMED'",
    "question_contradictions": surface.SQL["q_contradictions"].replace("object_ref, state, seq FROM ed", "object_ref, seq FROM ed"),
    "question_entity": surface.SQL["q_entity_name"].replace("'ar'", "'stardley'"),
    "question_unresolved": surface.SQL["q_unresolved_aliases"],
}
