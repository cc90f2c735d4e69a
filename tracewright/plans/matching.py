"""Queries over linkage, reconciliation, alignment and timing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as X
from tracewright.operators import alignment as A
from tracewright.operators import linkage as L
from tracewright.operators import media as M
from tracewright.operators.intervals import millis, periods_and_gaps

FIELDS = ("name", "type", "size")
_US = 1_000_000


def _parts(s, d) -> DataFrame:
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("ref"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("size"), "p_brand")


def _words(s, d) -> DataFrame:
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("ref")).distinct()


def _scored(s, d) -> DataFrame:
    pairs = L.block_pairs(_words(s, d), L.token_keys(F.col("ref")))
    sim = X.jaccard(X.tokens(F.lower("left")), X.tokens(F.lower("right")))
    same = (X.soundex(F.col("left")) == X.soundex(F.col("right"))).cast("double")
    zero = F.lit(0.0)
    return pairs.withColumn("score", F.round(L.link_score(sim, zero, zero, same, zero, zero), 6))


def _blocked(s, d) -> DataFrame:
    return L.with_self(L.block_pairs(_words(s, d), L.token_keys(F.col("ref"))), _words(s, d).where("ref is not null"))


def _blocked_model(s, d) -> DataFrame:
    return L.train_blocked(_blocked(s, d), _parts(s, d), FIELDS, "name", "p_brand")


def _observed(s, d) -> DataFrame:
    a = s.read.parquet(f"{d}/semantic_assertion.parquet")
    # ids are text; their order is that of the first statement
    return a.select(F.col("id").alias("ord"), F.upper(F.trim("predicate_code")).alias("predicate_code"), F.trim("subject_ref").alias("subject_ref"), F.trim("object_ref").alias("object_ref"), F.lit("").alias("relationship_type"), "confidence", (F.upper(F.trim("state")) == "CONFLICTING").alias("conflicted"))


def _split(s, d) -> DataFrame:
    a = s.read.parquet(f"{d}/semantic_assertion.parquet").where("subject_ref is not null and object_ref is not null and confidence is not null")
    return L.split_assign(a.select(F.col("subject_ref").alias("ref"), F.col("object_ref").alias("target"), F.round("confidence", 2).alias("confidence")))


def _targets(s, d) -> DataFrame:
    a = s.read.parquet(f"{d}/semantic_assertion.parquet").select("predicate_code", F.when(F.length("authority") > 4, F.col("authority")).alias("t")).distinct()
    p, t = L.relationship_target(F.col("predicate_code"), F.col("t"))
    return a.select("predicate_code", "t", p.alias("target"), t.alias("kind"))


def _units(s, d) -> DataFrame:
    """Utterance-like units of each event user: number, scene, start, end in seconds of the day."""
    e = s.read.parquet(f"{d}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("event_id")
    return e.select("user_id", (F.row_number().over(w)).alias("no"), F.concat(F.col("event_type"), F.lit("/"), F.floor(F.col("value") / 25).cast("string")).alias("scene"), F.col("value").alias("s"), (F.col("value") + 1.0).alias("e")).withColumn("ref", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(":"), F.col("no").cast("string")))


def _sides(s, d) -> tuple[DataFrame, DataFrame]:
    u = _units(s, d)
    return u.withColumn("pair", F.col("user_id")), u.withColumn("pair", F.col("user_id") - 1)


def _frames(s, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return s.read.parquet(f"{d}/events.parquet").select("user_id", (F.row_number().over(w) - 1).alias("i"), (F.col("value") / 500).alias("rms"))


def _scene_ms(s, d) -> DataFrame:
    return s.read.parquet(f"{d}/scene_boundary.parquet").select("source_id", F.col("boundary_id").alias("id"), millis(F.col("start_s")).alias("s"), millis(F.col("end_s")).alias("e")).distinct()


def _covered(s, d) -> DataFrame:
    spans = s.read.parquet(f"{d}/source_time.parquet").select("source_id", "start_ms", "end_ms")
    p = periods_and_gaps(spans, ["source_id"], "start_ms", "end_ms").where("span_kind = 'period'").select("source_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    return M.overlap(_scene_ms(s, d), p, "source_id")


def _verdicts(s, d) -> DataFrame:
    c = _covered(s, d)
    out, why = M.hallucination_verdict(F.col("covered") / (F.col("e") - F.col("s")), (F.col("id") % 10) / 10.0, (F.col("id") % 4).cast("int"), F.lit(3))
    return c.select("id", out.alias("outcome"), why.alias("trigger")).groupBy("outcome", "trigger").agg(F.count("*").alias("n"))


def _cues(s, d) -> DataFrame:
    a = s.read.parquet(f"{d}/audio_output.parquet").select("media_id", F.explode("asr.utterances").alias("u")).select("media_id", "u.utterance_index", "u.text", "u.start_s").distinct()
    return a


def _cue_flags(s, d) -> DataFrame:
    f = M.cue_flags(F.col("text"))
    return _cues(s, d).where("text is not null").groupBy(*[c.alias(n) for n, c in f.items()]).agg(F.count("*").alias("n"))


QUERIES = {
    "block_candidates": lambda s, d: L.block_pairs(_words(s, d), L.token_keys(F.col("ref"))),
    "link_score": lambda s, d: _scored(s, d),
    "link_candidates": lambda s, d: L.candidates(_scored(s, d), floor=0.2).select("left", "right", "score", "place"),
    "link_train": lambda s, d: _blocked_model(s, d).select("field", F.round("m", 8).alias("m"), F.round("u", 8).alias("u")),
    "link_predict": lambda s, d: L.predict_blocked(_blocked(s, d), _parts(s, d), _blocked_model(s, d), FIELDS, "name", match=3.0).select("kind", "left", "right", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "decision"),
    "same_name_pairs": lambda s, d: _parts(s, d).select("name", "ref", F.lead("ref").over(Window.partitionBy("name").orderBy("ref")).alias("next_ref")).where("next_ref is not null"),
    "split_assign": _split,
    "reconcile_promote": lambda s, d: L.reconcile(_observed(s, d)),
    "relationship_target": _targets,
    "align_scene": lambda s, d: A.scene_pairs(*_sides(s, d), ["pair"]).groupBy("pair", "scene").agg(F.count("*").alias("pairs")),
    "align_omissions": lambda s, d: A.unmatched(_sides(s, d)[1].where("pair >= 0"), _sides(s, d)[0], ["pair"]).select("pair", "ref"),
    "align_reordering": lambda s, d: A.reordered(_sides(s, d)[0].alias("l").join(_sides(s, d)[1].alias("r"), (F.col("l.pair") == F.col("r.pair")) & (F.col("l.no") == F.col("r.no")) & (F.col("l.scene") == F.col("r.scene"))).select(F.col("l.pair").alias("pair"), F.col("l.no").alias("a"), (F.col("r.no") + F.when(F.col("l.no") % 50 == 0, -3).otherwise(0)).alias("b")), ["pair"], "a", "b"),
    "align_confidence": lambda s, d: _sides(s, d)[0].alias("l").join(_sides(s, d)[1].alias("r"), (F.col("l.pair") == F.col("r.pair")) & (F.col("l.no") == F.col("r.no"))).select(F.col("l.ref").alias("left_ref"), F.col("r.ref").alias("right_ref"), A.pair_confidence(0.3, F.lit(0.5), F.col("l.s") - F.col("r.s"), F.col("l.e") - F.col("r.e")).alias("confidence")),
    "align_dtw": lambda s, d: A.align_time(*_sides(s, d), "pair"),
    "vad_islands": lambda s, d: M.speech_islands(_frames(s, d), "user_id", "i", "rms"),
    "music_islands": lambda s, d: M.sound_islands(_frames(s, d), "user_id", "i", "rms"),
    "interval_overlap": _covered,
    "halluc_filter": _verdicts,
    "fpr_fnr": lambda s, d: M.error_rates(s.read.parquet(f"{d}/events.parquet").select((F.col("value") > 100).alias("t"), (F.col("event_type") == "error").alias("g")), "t", "g"),
    "scene_shots": lambda s, d: M.scenes(
        s.read.parquet(f"{d}/scene_boundary.parquet").where("start_s is not null and not isnan(start_s)").select(F.col("track_id"), F.round("start_s", 3).alias("start_s")), "track_id", "start_s",
        s.read.parquet(f"{d}/scene_boundary.parquet").where("end_s is not null and not isnan(end_s)").groupBy("track_id").agg(F.round(F.max("end_s"), 3).alias("duration_s")),
    ),
    "frame_sample": lambda s, d: M.sampled_frames(_frames(s, d).withColumn("n", F.count("*").over(Window.partitionBy("user_id"))), "user_id", "i", F.col("n"), 8).select("user_id", "i"),
    "cue_shift": lambda s, d: _cues(s, d).where("start_s is not null").select("media_id", "utterance_index", M.shifted_cue(F.round(F.col("start_s") * 1000).cast("bigint"), F.lit(900_000), F.lit(12_000)).alias("start_ms")),
    "cue_flags": _cue_flags,
    "timecode_ms": lambda s, d: s.read.parquet(f"{d}/source_time.parquet").select("timecode", M.hms_ms(F.col("timecode")).alias("ms")).distinct(),
    "asr_confidence": lambda s, d: s.read.parquet(f"{d}/audio_output.parquet").select("media_id", F.explode("asr.utterances").alias("u")).where("u.start_s is not null and u.end_s is not null and u.confidence is not null").select("media_id", "u.utterance_index", "u.confidence", "u.start_s", "u.end_s").distinct().groupBy("media_id").agg(F.round(F.sum(F.col("confidence") * (F.col("end_s") - F.col("start_s"))) / F.sum(F.col("end_s") - F.col("start_s")), 4).alias("confidence")),
    "tone_slots": lambda s, d: M.nearest_tone(_frames(s, d).withColumn("v", F.col("rms") - 0.1), "user_id", "i", "v", 2000).select("user_id", F.round("frequency", 6).alias("frequency"), "slot"),
}

_P = "p AS (SELECT p_partkey AS ref, p_name AS name, p_type AS type, CAST(p_size AS VARCHAR) AS size, p_brand FROM part)"
_SX = "translate(substr(w, 2), 'bfpvcgjkqsxzdtlmnraeiouhwy', '111122222222334556')"
for _d in "123456":
    _SX = f"regexp_replace({_SX}, '{_d}+', '{_d}', 'g')"
_BK = f"n AS (SELECT DISTINCT p_name AS ref, lower(p_name) AS lo, regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS w FROM part), sx AS (SELECT ref, lo, CASE WHEN length(w) < 2 THEN substr(sha256(lo), 1, 8) ELSE rpad(substr(substr(w, 1, 1) || {_SX}, 1, 4), 4, '0') END AS sx FROM n), k AS (SELECT ref, unnest(list_distinct(list_concat(['t:' || x for x in regexp_extract_all(lo, '[A-Za-z0-9'']+')], ['s:' || sx]))) AS k FROM sx), bp AS (SELECT DISTINCT a.ref AS \"left\", b.ref AS \"right\" FROM k a JOIN k b ON a.k = b.k AND a.ref < b.ref)"
_PR = _BK + ", pa AS (SELECT p_partkey AS ref, p_name AS name, p_type AS type, CAST(p_size AS VARCHAR) AS size, p_brand FROM part), pr AS (SELECT \"left\" AS l, \"right\" AS r FROM bp UNION ALL SELECT DISTINCT name, name FROM pa), g AS (SELECT x.ref AS l, y.ref AS r, coalesce(x.p_brand = y.p_brand, false) AS is_match, " + ", ".join(f"coalesce(x.{f} = y.{f}, false) AS agree_{f}" for f in FIELDS) + " FROM pr JOIN pa x ON x.name = pr.l JOIN pa y ON y.name = pr.r WHERE pr.l <> pr.r OR x.ref < y.ref)"
_MU = f"{_PR}, mu AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, (count(*) FILTER (WHERE is_match AND agree_{f}) + 0.5) / (count(*) FILTER (WHERE is_match) + 1.5) AS m, (count(*) FILTER (WHERE NOT is_match AND agree_{f}) + 0.5) / (count(*) FILTER (WHERE NOT is_match) + 1.5) AS u FROM g" for f in FIELDS) + ")"
_LS = _BK + ", t AS (SELECT ref, sx, regexp_extract_all(lo, '[A-Za-z0-9'']+') AS t FROM sx), ls AS (SELECT \"left\", \"right\", round(0.55 * (len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))) + 0.05 * CASE WHEN a.sx = b.sx THEN 1 ELSE 0 END, 6) AS score FROM bp JOIN t a ON a.ref = \"left\" JOIN t b ON b.ref = \"right\")"
_UN = "un AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS no, event_type || '/' || CAST(CAST(floor(value / 25) AS BIGINT) AS VARCHAR) AS scene, value AS s, value + 1.0 AS e FROM events), l AS (SELECT *, user_id AS pair, 'u' || CAST(user_id AS VARCHAR) || ':' || CAST(no AS VARCHAR) AS ref FROM un), r AS (SELECT *, user_id - 1 AS pair, 'u' || CAST(user_id AS VARCHAR) || ':' || CAST(no AS VARCHAR) AS ref FROM un)"
_FR = "fr AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value / 500 AS rms FROM events)"
_FLOOR = "(SELECT user_id, rms AS floor FROM (SELECT user_id, rms, row_number() OVER (PARTITION BY user_id ORDER BY rms) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM fr) WHERE k = greatest(0, least(n - 1, CAST(floor(n * {0}) AS BIGINT))))"
_CU = "cu AS (SELECT DISTINCT media_id, u.utterance_index AS utterance_index, u.text AS text, u.start_s AS start_s FROM (SELECT media_id, unnest(asr.utterances) AS u FROM audio_output))"
_SC = "sc AS (SELECT DISTINCT source_id, boundary_id AS id, CAST(round(start_s * 1000) AS BIGINT) AS s, CAST(round(end_s * 1000) AS BIGINT) AS e FROM scene_boundary)"
_CV = _SC + """, st AS (SELECT source_id, start_ms AS s, max(end_ms) AS e FROM source_time WHERE start_ms < end_ms GROUP BY 1, 2),
 m AS (SELECT *, max(e) OVER (PARTITION BY source_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM st),
 gr AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY s) AS n FROM m),
 pe AS (SELECT source_id, n, min(s) AS s, max(e) AS e FROM gr GROUP BY 1, 2),
 cv AS (SELECT sc.source_id, sc.id, sc.s, sc.e, CAST(coalesce(sum(CASE WHEN pe.s IS NOT NULL THEN least(sc.e, pe.e) - greatest(sc.s, pe.s) END), 0) AS BIGINT) AS covered FROM sc LEFT JOIN pe ON sc.source_id = pe.source_id AND pe.s < sc.e AND sc.s < pe.e WHERE sc.s < sc.e GROUP BY ALL)"""
_REG = "(" + ", ".join(f"'{x}'" for x in L.REGISTERED) + ")"
_WSP = r"[ \t]"

SQL = {
    "block_candidates": f'WITH {_BK} SELECT * FROM bp',
    "link_train": f"WITH {_MU} SELECT field, round(m, 8) AS m, round(u, 8) AS u FROM mu",
    "link_score": f"WITH {_LS} SELECT * FROM ls",
    "link_candidates": f'WITH {_LS} SELECT * FROM (SELECT "left", "right", score, CAST(row_number() OVER (PARTITION BY "left" ORDER BY score DESC, "right") AS INT) AS place FROM ls WHERE score >= 0.2) WHERE place <= 20',
    "same_name_pairs": "SELECT p_name AS name, p_partkey AS ref, nx AS next_ref FROM (SELECT *, lead(p_partkey) OVER (PARTITION BY p_name ORDER BY p_partkey) AS nx FROM part) WHERE nx IS NOT NULL",
    "split_assign": "WITH c AS (SELECT subject_ref AS ref, object_ref AS target, round(confidence, 2) AS confidence FROM semantic_assertion WHERE subject_ref IS NOT NULL AND object_ref IS NOT NULL AND confidence IS NOT NULL), t AS (SELECT *, rank() OVER (PARTITION BY ref ORDER BY confidence DESC) AS k FROM c) SELECT ref, CASE WHEN count(DISTINCT target) = 1 THEN min(target) END AS target FROM t WHERE k = 1 GROUP BY 1",
    "reconcile_promote": "WITH o AS (SELECT id AS ord, upper(trim(predicate_code)) AS predicate_code, trim(subject_ref) AS subject_ref, trim(object_ref) AS object_ref, '' AS relationship_type, confidence, coalesce(upper(trim(state)) = 'CONFLICTING', false) AS conflicted FROM semantic_assertion), b AS (SELECT *, row_number() OVER (PARTITION BY predicate_code, subject_ref, object_ref ORDER BY ord, confidence DESC NULLS LAST) AS k, count(*) OVER (PARTITION BY predicate_code, subject_ref, object_ref) AS seen, max(conflicted) OVER (PARTITION BY subject_ref) AS bad FROM o) SELECT predicate_code, subject_ref, object_ref, relationship_type, ord, CASE WHEN bad AND subject_ref IS NOT NULL THEN 'CONFLICTING' WHEN coalesce(confidence, 0) >= 0.8 THEN 'CONFIRMED' WHEN coalesce(confidence, 0) >= 0.5 THEN 'PROBABLE' ELSE 'UNKNOWN' END AS state, seen FROM b WHERE k = 1",
    "relationship_target": f"WITH a AS (SELECT DISTINCT predicate_code, CASE WHEN length(authority) > 4 THEN authority END AS t FROM semantic_assertion), n AS (SELECT *, upper(trim(predicate_code)) AS p, CASE WHEN regexp_full_match(upper(trim(t)), '[A-Z][A-Z0-9_]{{0,63}}') THEN upper(trim(t)) END AS u FROM a), x AS (SELECT *, CASE WHEN p = 'RELATED_TO' THEN CASE WHEN u IS NOT NULL THEN p END WHEN p = 'SIBLING_OF' AND u IS NOT NULL AND u <> 'SIBLING_OF' THEN NULL WHEN p IN {_REG} THEN p WHEN u IS NOT NULL OR regexp_full_match(p, '[A-Z][A-Z0-9_]{{0,63}}') THEN 'RELATED_TO' END AS target FROM n) SELECT predicate_code, t, target, CASE WHEN target = 'RELATED_TO' THEN coalesce(u, p) END AS kind FROM x",
    "align_scene": f"WITH {_UN} SELECT l.pair, l.scene, count(*) AS pairs FROM l JOIN r ON l.pair = r.pair AND l.scene = r.scene GROUP BY 1, 2",
    "align_omissions": f"WITH {_UN} SELECT pair, ref FROM r WHERE pair >= 0 AND NOT EXISTS (SELECT 1 FROM l WHERE l.pair = r.pair AND l.scene = r.scene)",
    "align_reordering": f"WITH {_UN}, q AS (SELECT l.pair, l.no AS a, r.no + CASE WHEN l.no % 50 = 0 THEN -3 ELSE 0 END AS b FROM l JOIN r ON l.pair = r.pair AND l.no = r.no AND l.scene = r.scene) SELECT q.pair, coalesce(bool_or((q.a < z.a) <> (q.b < z.b)) FILTER (WHERE q.a < z.a), false) AS reordered FROM q LEFT JOIN q z ON q.pair = z.pair AND q.a < z.a GROUP BY 1",
    "align_confidence": f"WITH {_UN} SELECT l.ref AS left_ref, r.ref AS right_ref, floor(least(0.99, greatest(0.05, CAST(0.3 AS DOUBLE) + CAST(0.4 AS DOUBLE) * 0.5 + CAST(0.3 AS DOUBLE) * greatest(0.0, 1.0 - CAST(0.01 AS DOUBLE) * greatest(abs(l.s - r.s), abs(l.e - r.e))))) * 10000 + 0.5) / 10000 AS confidence FROM l JOIN r ON l.pair = r.pair AND l.no = r.no",
    "vad_islands": f"WITH {_FR}, t AS {_FLOOR.format('0.1')}, o AS (SELECT fr.*, max(CASE WHEN rms >= greatest(floor * 2.5, 0.0001) THEN i END) OVER (PARTITION BY fr.user_id ORDER BY i) AS la FROM fr JOIN t USING (user_id)), n AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM o WHERE i - la <= 2) SELECT user_id, CAST(min(i) AS INT) AS start_frame, CAST(max(i) + 1 AS INT) AS end_frame, max(rms) AS peak FROM n GROUP BY user_id, g HAVING (max(i) + 1 - min(i)) * 0.02 >= 0.05",
    "music_islands": f"WITH {_FR}, t AS {_FLOOR.format('0.25')}, f AS (SELECT fr.*, greatest(floor, 0.001) AS fl FROM fr JOIN t USING (user_id)), o AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY user_id ORDER BY i) - 1 > 2 THEN 1 ELSE 0 END AS nw FROM f WHERE rms > fl), g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY i) AS g FROM o), s AS (SELECT user_id, g, min(i) AS a, max(i) + 1 AS b FROM g GROUP BY 1, 2), x AS (SELECT s.user_id, s.a, s.b, avg(rms) AS mean, stddev_pop(rms) AS sd, max(fl) AS fl FROM s JOIN f ON s.user_id = f.user_id AND f.i >= s.a AND f.i < s.b GROUP BY 1, 2, 3) SELECT user_id, CAST(a AS INT) AS start_frame, CAST(b AS INT) AS end_frame, kind FROM (SELECT *, CASE WHEN (b - a) * 0.02 >= 0.25 AND sd <= 0.5 * greatest(mean, fl) THEN 'music' WHEN (b - a) * 0.02 < 0.25 THEN 'transient' END AS kind FROM x) WHERE kind IS NOT NULL",
    "interval_overlap": f"WITH {_CV} SELECT * FROM cv",
    "halluc_filter": f"WITH {_CV}, v AS (SELECT covered / (e - s) AS b, (id % 10) / 10.0 AS c, id % 4 AS lw FROM cv) SELECT CASE WHEN b < 0.5 OR c < 0.5 OR (lw > 0 AND lw >= 3) THEN 'filtered' ELSE 'kept' END AS outcome, CASE WHEN b < 0.5 THEN 'vad' WHEN c < 0.5 THEN 'energy' WHEN lw > 0 THEN 'logprob' END AS \"trigger\", count(*) AS n FROM v GROUP BY 1, 2",
    "fpr_fnr": "SELECT round(count(*) FILTER (WHERE value <= 100 AND event_type = 'error') / count(*) FILTER (WHERE value <= 100), 6) AS fpr, round(count(*) FILTER (WHERE value > 100 AND event_type <> 'error') / count(*) FILTER (WHERE value > 100), 6) AS fnr FROM events",
    "scene_shots": "WITH d AS (SELECT track_id, round(max(end_s), 3) AS duration_s FROM scene_boundary WHERE end_s IS NOT NULL AND NOT isnan(end_s) GROUP BY 1), c AS (SELECT track_id, round(start_s, 3) AS s FROM scene_boundary WHERE start_s >= 0 AND NOT isnan(start_s) UNION SELECT track_id, 0.0 FROM d) SELECT c.track_id, CAST(row_number() OVER w - 1 AS INT) AS scene_index, round(s, 4) AS start_s, round(coalesce(lead(s) OVER w, duration_s), 4) AS end_s, CAST(round(s * 90000) AS BIGINT) AS start_pts FROM c JOIN d USING (track_id) WINDOW w AS (PARTITION BY c.track_id ORDER BY s)",
    "frame_sample": f"WITH {_FR}, n AS (SELECT *, greatest(1, CAST(floor(count(*) OVER (PARTITION BY user_id) / 8) AS BIGINT)) AS st FROM fr) SELECT user_id, CAST(i AS INT) AS i FROM n WHERE i % st = 0 AND i // st < 8",
    "cue_shift": f"WITH {_CU} SELECT media_id, utterance_index, greatest(0, CAST(round(CAST(round(start_s * 1000) AS BIGINT) + 900000 / 90.0 - 12000) AS BIGINT)) AS start_ms FROM cu WHERE start_s IS NOT NULL",
    "cue_flags": f"WITH {_CU}, f AS (SELECT lower(text) AS low, (contains(text, '♪') OR contains(text, '♫') OR contains(text, '♬') OR contains(text, '[music') OR contains(text, '[song')) AS is_song FROM cu WHERE text IS NOT NULL), g AS (SELECT *, (contains(low, '[sign') OR contains(low, '(sign') OR contains(low, 'sign language') OR contains(low, '[visual') OR contains(low, ' [english]') OR contains(low, 'sings')) AS is_sign FROM f) SELECT is_song, is_sign, (is_song OR is_sign OR contains(low, '[') OR contains(low, ']') OR regexp_matches(low, '\\([a-z]+[a-z ]+\\)')) AS is_hi, count(*) AS n FROM g GROUP BY 1, 2, 3",
    "timecode_ms": r"SELECT DISTINCT timecode, CASE WHEN regexp_matches(timecode, '^(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})$') THEN coalesce(TRY_CAST(regexp_extract(timecode, '^(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})$', 1) AS BIGINT), 0) * 3600000 + CAST(regexp_extract(timecode, '^(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})$', 2) AS BIGINT) * 60000 + CAST(regexp_extract(timecode, '^(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})$', 3) AS BIGINT) * 1000 + CAST(regexp_extract(timecode, '^(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})$', 4) AS BIGINT) END AS ms FROM source_time",
    "asr_confidence": "SELECT media_id, round(sum(c * (e - s)) / sum(e - s), 4) AS confidence FROM (SELECT DISTINCT media_id, u.utterance_index, u.confidence AS c, u.start_s AS s, u.end_s AS e FROM (SELECT media_id, unnest(asr.utterances) AS u FROM audio_output)) WHERE c IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL GROUP BY 1",
    "tone_slots": f"WITH {_FR}, v AS (SELECT user_id, i, rms - 0.1 AS v FROM fr), x AS (SELECT user_id, coalesce(CASE WHEN (v >= 0) <> (lag(v) OVER (PARTITION BY user_id ORDER BY i) >= 0) THEN 1 ELSE 0 END, 0) AS x FROM v), f AS (SELECT user_id, sum(x) / (2 * count(*) / 2000.0) AS f FROM x GROUP BY 1), s AS (SELECT *, greatest(0, least(31, CAST(round((f - 400.0) / 40.0) AS INT))) AS k FROM f) SELECT user_id, round(f, 6) AS frequency, CASE WHEN abs(f - (400.0 + k * 40.0)) <= 15.0 THEN k END AS slot FROM s",
}
