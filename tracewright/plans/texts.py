"""Queries over document text, search and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import ids, locators
from tracewright.functions import text as X
from tracewright.functions import vectors as V
from tracewright.operators import search
from tracewright.operators import segments as S
from tracewright.session import written


def _docs(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")


def _names(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/source_mention.parquet").select("work_id", "mention_text").where("mention_text is not null").distinct()


def _mentions(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/source_mention.parquet")


_W = X.WS
_P = rf"pa AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS paragraph, unnest(l) AS text FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n{_W}*\n'), lambda x: regexp_replace(x, '^{_W}+|{_W}+$', '', 'g')), lambda x: x <> '') AS l FROM documents))"
_S = rf"{_P}, se AS (SELECT doc_id, paragraph, unnest(range(1, len(l) + 1)) AS sentence, unnest(l) AS text FROM (SELECT doc_id, paragraph, CASE WHEN len(l0) > 0 THEN l0 ELSE [text] END AS l FROM (SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_W}+', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^{_W}+|{_W}+$', '', 'g')), lambda x: x <> '') AS l0 FROM pa)))"
_Q = X.QUOTE.replace("'", "''")
# DuckDB has no look-around: what is no ASCII but of a word becomes '_', what is of none '#', and the borders are those of ASCII
_PLAIN = r"regexp_replace(regexp_replace(text, '[^\x00-\x7F\p{L}\p{N}\p{Z}\x{85}]', '#', 'g'), '[^\x00-\x7F\p{Z}\x{85}]', '_', 'g')"
_RUNS = rf"SELECT doc_id, paragraph, {_PLAIN} AS t, regexp_extract_all({_PLAIN}, '\b{X.RUN}\b') AS r FROM pa"
_SOUNDEX = "translate(substr(w, 2), 'bfpvcgjkqsxzdtlmnraeiouhwy', '111122222222334556')"
for _d in "123456":
    _SOUNDEX = f"regexp_replace({_SOUNDEX}, '{_d}+', '{_d}', 'g')"
_TRI = "list_distinct([substr('  ' || lower({0}) || ' ', i, 3) for i in range(1, length({0}) + 2)])"
_LOC = locators.PATTERN
QUERY_WORDS = ("heavy", "bridge")


def _whole_signatures(spark, sf) -> DataFrame:
    """The 64 hashes of the reference."""
    return _docs(spark, sf).select("doc_id", X.signature("text").alias("sig"))


def _whole_pairs(spark, sf, threshold: float = 0.8) -> DataFrame:
    """kind, head, doc_id, similarity: member is a document and the least one with its words, link two such heads that share a band and are this alike.

    Two documents are alike as their heads are. Two sets of this similarity
    differ in at most (1 - t) / (1 + t) of the sum of their sizes, and the
    parities of their words differ in no more places than the sets do, so the
    sets themselves are read for few pairs and no pair is lost.
    """
    p = _docs(spark, sf).select("doc_id", X.profile("text").alias("p")).select("doc_id", "p.words", "p.tokens", "p.parity", F.transform(X.bands(F.col("p.sig")), lambda x: F.xxhash64(x)).alias("bands"))
    p = written(p, "profiles")
    heads = p.where("words is not null").groupBy("words").agg(F.min("doc_id").alias("head"))
    of = p.select("doc_id", "words").join(heads, "words", "left")
    # without a word a document is like none, by the reference's rule not even like itself
    members = of.select(F.lit("member").alias("kind"), F.coalesce("head", "doc_id").alias("head"), "doc_id", F.when(F.col("head").isNull(), 0.0).otherwise(1.0).alias("similarity"))
    r = p.join(heads.select(F.col("head").alias("doc_id")), "doc_id", "left_semi")
    band = r.select("doc_id", F.size("tokens").alias("size"), "parity", F.explode("bands").alias("band"))
    x, y = (band.select("band", F.col("doc_id").alias(f"{n}_id"), F.col("size").alias(f"{n}_size"), F.col("parity").alias(f"{n}_parity")) for n in "xy")
    apart = sum((F.bit_count(F.col("x_parity")[i].bitwiseXOR(F.col("y_parity")[i])) for i in range(4)), F.lit(0))
    size = F.col("x_size") + F.col("y_size")
    near = (F.least("x_size", "y_size") >= threshold * F.greatest("x_size", "y_size")) & (apart <= (1 - threshold) / (1 + threshold) * size + 1e-9)
    met = x.join(y, "band").where("x_id < y_id").where(near).select("x_id", "y_id").distinct()
    sets = r.select("doc_id", "tokens")
    met = met.join(sets.select(F.col("doc_id").alias("x_id"), F.col("tokens").alias("a")), "x_id").join(sets.select(F.col("doc_id").alias("y_id"), F.col("tokens").alias("b")), "y_id")
    links = met.select(F.lit("link").alias("kind"), F.col("x_id").alias("head"), F.col("y_id").alias("doc_id"), X.jaccard(F.col("a"), F.col("b")).alias("s")).where(F.col("s") >= threshold)
    return members.unionByName(links.select("kind", "head", "doc_id", F.round("s", 6).alias("similarity")))


def _vectors(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")


def _probes(spark, sf) -> DataFrame:
    """The queries of the vector searches."""
    return _vectors(spark, sf).where("vec_id % 50 = 0")


def _whole_hybrid(spark, sf) -> DataFrame:
    near = search.nearest_vectors(_vectors(spark, sf), _probes(spark, sf), 40).withColumnRenamed("vec_id", "doc_id")
    return search.hybrid_each(search.exact(search.postings(_docs(spark, sf), "doc_id", "text"), QUERY_WORDS, "doc_id"), near, _probes(spark, sf), "doc_id", 40)


QUERIES = {
    "seg_paragraph": lambda s, d: S.paragraphs(_docs(s, d)),
    "seg_sentence": lambda s, d: S.sentences(_docs(s, d)),
    "seg_token": lambda s, d: S.tokens(_docs(s, d)).groupBy("doc_id", "paragraph").agg(F.count("*").alias("tokens"), F.max("sentence").alias("sentences"), F.countDistinct("token").alias("distinct_tokens")),
    "seg_token_top": lambda s, d: S.tokens(_docs(s, d)).groupBy(F.lower("token").alias("token")).agg(F.count("*").alias("n")),
    "seg_chapters": lambda s, d: S.chapters(_docs(s, d)),
    "struct_dialogue": lambda s, d: S.paragraphs(_docs(s, d)).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(X.is_dialogue(F.col("text")).cast("bigint")).alias("dialogue")),
    "struct_speaker": lambda s, d: S.paragraphs(_docs(s, d)).select("doc_id", "paragraph", X.candidate_speaker(F.col("text")).alias("speaker")).where("speaker is not null"),
    "struct_mentions": lambda s, d: S.mentions(S.paragraphs(_docs(s, d)), ["doc_id", "paragraph"]),
    "struct_cooccur": lambda s, d: S.cooccurrences(S.paragraphs(_docs(s, d)), ["doc_id", "paragraph"]),
    "soundex_key": lambda s, d: _names(s, d).select("mention_text").distinct().select("mention_text", X.soundex(F.col("mention_text")).alias("key")),
    "jaccard_pairs": lambda s, d: search.alike_names(_names(s, d)),
    "minhash_sig": lambda s, d: _whole_signatures(s, d).select("doc_id", F.array_join("sig", ",").alias("signature")),
    "lsh_pairs": _whole_pairs,
    "nfkc_name": lambda s, d: _names(s, d).select("mention_text", X.normalize_name("mention_text").alias("normal"), X.transliteration_key("mention_text").alias("key")),
    "embed_text": lambda s, d: _docs(s, d).select("doc_id", X.embed_text("text").alias("embedding")),
    "locator_parse": lambda s, d: s.read.parquet(f"{d}/semantic_assertion.parquet").select(F.explode("support_refs").alias("locator")).distinct().select("locator", locators.parse(F.col("locator")).alias("p")).select("locator", "p.*"),
    "locator_newest": lambda s, d: search.newest_versions(s.read.parquet(f"{d}/semantic_assertion.parquet").select(F.explode("support_refs").alias("locator")).distinct()),
    "search_exact": lambda s, d: search.exact(search.postings(_docs(s, d), "doc_id", "text"), QUERY_WORDS, "doc_id"),
    "search_fuzzy": lambda s, d: search.fuzzy(_names(s, d).select("mention_text").distinct(), "mention_text", "Rebecca Stardley", 0.3),
    "search_scoped": lambda s, d: search.exact(search.postings(_docs(s, d).where("lang = 'en'"), "doc_id", "text"), QUERY_WORDS, "doc_id").join(_docs(s, d).select("doc_id", "source"), "doc_id"),
    "search_rank_bm25": lambda s, d: search.bm25(search.postings(_docs(s, d), "doc_id", "text"), QUERY_WORDS, "doc_id").select("doc_id", F.round("score", 6).alias("score")),
    "vector_topk": lambda s, d: search.nearest_vectors(_vectors(s, d), _probes(s, d), 20),
    "vector_l2": lambda s, d: search.nearest_vectors(_vectors(s, d), _probes(s, d), None, "l2").withColumnRenamed("score", "distance"),
    "search_hybrid": _whole_hybrid,
    "vector_model_counts": lambda s, d: search.vector_review(s.read.parquet(f"{d}/embeddings.parquet"), "label"),
    "mention_ids": lambda s, d: _mentions(s, d).select("source_id", "segment_id", "mention_text").distinct().select("source_id", "segment_id", "mention_text", ids.mention_id(F.col("source_id"), F.lit("l"), F.coalesce("segment_id", F.lit("")), F.coalesce("mention_text", F.lit(""))).alias("id"), ids.canonical_ref(F.array(F.coalesce("mention_text", F.lit("")), F.lit("x"))).alias("canonical"), ids.fallback_ref(F.lit("character"), F.col("source_id"), F.coalesce("mention_text", F.lit(""))).alias("fallback")),
    "segment_ids": lambda s, d: _docs(s, d).select("doc_id", ids.segment_id(F.col("source"), F.lit("text"), F.concat(F.lit("Chapter/ 1/p"), F.col("doc_id").cast("string"))).alias("segment_id"), ids.uuid5(F.concat(F.lit("1:"), F.col("doc_id").cast("string"))).alias("fact_id")),
}

SQL = {
    "seg_paragraph": f"WITH {_P} SELECT doc_id, CAST(paragraph AS INT) AS paragraph, text FROM pa",
    "seg_sentence": f"WITH {_S} SELECT doc_id, CAST(paragraph AS INT) AS paragraph, CAST(sentence AS INT) AS sentence, text FROM se",
    "seg_token": f"WITH {_S}, t AS (SELECT doc_id, paragraph, sentence, unnest(regexp_extract_all(text, '[A-Za-z0-9'']+')) AS token FROM se) SELECT doc_id, CAST(paragraph AS INT) AS paragraph, count(*) AS tokens, CAST(max(sentence) AS INT) AS sentences, count(DISTINCT token) AS distinct_tokens FROM t GROUP BY 1, 2",
    "seg_token_top": "SELECT lower(t) AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9'']+')) AS t FROM documents) GROUP BY 1",
    "seg_chapters": rf"""WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
 f AS (SELECT *, regexp_matches(line, '{X.CHAPTER}') AS h FROM l WHERE regexp_replace(line, '^{_W}+|{_W}+$', '', 'g') <> ''),
 g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, sum(CASE WHEN h THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS isle FROM f),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, isle, h ORDER BY i) AS pos FROM g),
 o AS (SELECT *, h AND (CASE WHEN isle = 0 THEN pos % 2 = 0 ELSE pos % 2 = 1 END) AS opens FROM k),
 c AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM o),
 r AS (SELECT doc_id, c, coalesce(max(CASE WHEN opens THEN regexp_replace(line, '^{_W}+|{_W}+$', '', 'g') END), 'Chapter 1') AS title, count(*) FILTER (WHERE NOT opens) AS lines FROM c GROUP BY 1, 2)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY c) AS INT) AS chapter, title, CAST(lines AS INT) AS lines FROM r WHERE lines > 0""",
    "struct_dialogue": f"WITH {_P} SELECT doc_id, count(*) AS paragraphs, CAST(sum(CASE WHEN regexp_matches(text, '^{_W}*[—–-]{_W}') OR regexp_matches(text, '{_Q}') THEN 1 ELSE 0 END) AS BIGINT) AS dialogue FROM pa GROUP BY 1",
    "struct_speaker": f"""WITH {_P}, q AS (SELECT doc_id, paragraph, text, list_filter(list_transform(regexp_extract_all(text, '{_Q}'), lambda x: trim(x, '"''“”‘’ ')), lambda x: x <> '') AS q FROM pa),
 b AS (SELECT doc_id, paragraph, substr(text, 1, greatest(0, instr(text, q[1]) - 1)) AS b FROM q WHERE len(q) > 0),
 w AS (SELECT doc_id, paragraph, list_filter(regexp_split_to_array(regexp_replace(b, '[^A-Za-z'' ]+', ' ', 'g'), ' +'), lambda x: regexp_matches(x, '^[A-Z]')) AS w FROM b)
 SELECT doc_id, CAST(paragraph AS INT) AS paragraph, w[len(w)] AS speaker FROM w WHERE len(w) > 0""",
    "struct_mentions": f"WITH {_P}, r AS ({_RUNS}), u AS (SELECT doc_id, paragraph, t, unnest(list_distinct(r)) AS run FROM r) SELECT * FROM (SELECT doc_id, CAST(paragraph AS INT) AS paragraph, run, CAST((length(t) - length(replace(t, run, ''))) / length(run) AS INT) AS times FROM u) WHERE times > 1",
    "struct_cooccur": f"WITH {_P}, r AS ({_RUNS}) SELECT doc_id, CAST(paragraph AS INT) AS paragraph, r[1] AS subject, list_filter(r, lambda x: x <> r[1])[1] AS object FROM r WHERE len(list_distinct(r)) >= 2",
    "soundex_key": rf"WITH n AS (SELECT DISTINCT mention_text, strip_accents(lower(trim(regexp_replace(mention_text, '{_W}+', ' ', 'g')))) AS a FROM source_mention WHERE mention_text IS NOT NULL), w AS (SELECT *, regexp_replace(a, '[^a-z]', '', 'g') AS w FROM n) SELECT mention_text, CASE WHEN length(w) < 2 THEN substr(sha256(a), 1, 8) ELSE rpad(substr(substr(w, 1, 1) || {_SOUNDEX}, 1, 4), 4, '0') END AS key FROM w",
    "locator_parse": f"WITH l AS (SELECT DISTINCT unnest(support_refs) AS locator FROM semantic_assertion) SELECT locator, " + ", ".join(f"{'TRY_CAST(' if 4 <= i <= 6 else ''}nullif(regexp_extract(locator, '{_LOC}', {i}), ''){' AS INT)' if 4 <= i <= 6 else ''} AS {n}" for i, n in enumerate(("source_id", "modality", "segment", "segmenter", "decoder", "renderer", "frag"), 1)) + f", coalesce(regexp_matches(locator, '{_LOC}'), false) AS valid FROM l",
    "locator_newest": f"WITH l AS (SELECT DISTINCT unnest(support_refs) AS locator FROM semantic_assertion), p AS (SELECT locator, regexp_extract(locator, '{_LOC}', 1) AS source_id, regexp_extract(locator, '{_LOC}', 2) AS modality, regexp_extract(locator, '{_LOC}', 3) AS segment, coalesce(TRY_CAST(regexp_extract(locator, '{_LOC}', 4) AS INT), -1) AS a, coalesce(TRY_CAST(regexp_extract(locator, '{_LOC}', 5) AS INT), -1) AS b, coalesce(TRY_CAST(regexp_extract(locator, '{_LOC}', 6) AS INT), -1) AS c FROM l WHERE regexp_matches(locator, '{_LOC}')) SELECT source_id, modality, segment, locator AS newest, versions FROM (SELECT *, row_number() OVER (PARTITION BY source_id, modality, segment ORDER BY a DESC, b DESC, c DESC, locator DESC) AS r, count(*) OVER (PARTITION BY source_id, modality, segment) AS versions FROM p) WHERE r = 1",
    "search_exact": "WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9'']+'))) AS t FROM documents), c AS (SELECT doc_id, t, count(*) AS n FROM t WHERE t IN ('heavy', 'bridge') GROUP BY 1, 2) SELECT doc_id, CAST(sum(n) AS BIGINT) AS score FROM c GROUP BY 1 HAVING count(*) = 2",
    "search_scoped": "WITH t AS (SELECT doc_id, source, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9'']+'))) AS t FROM documents WHERE lang = 'en'), c AS (SELECT doc_id, source, t, count(*) AS n FROM t WHERE t IN ('heavy', 'bridge') GROUP BY 1, 2, 3) SELECT doc_id, source, CAST(sum(n) AS BIGINT) AS score FROM c GROUP BY 1, 2 HAVING count(*) = 2",
    "search_fuzzy": f"WITH n AS (SELECT DISTINCT mention_text FROM source_mention WHERE mention_text IS NOT NULL), t AS (SELECT mention_text, {_TRI.format('mention_text')} AS t, {_TRI.format(chr(39) + 'Rebecca Stardley' + chr(39))} AS q FROM n) SELECT mention_text, round(len(list_intersect(t, q)) / len(list_distinct(list_concat(t, q))), 6) AS similarity FROM t WHERE len(list_intersect(t, q)) / len(list_distinct(list_concat(t, q))) >= 0.3",
    "search_hybrid": """WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9'']+'))) AS t FROM documents), c AS (SELECT doc_id, t, count(*) AS n FROM t WHERE t IN ('heavy', 'bridge') GROUP BY 1, 2), e0 AS (SELECT doc_id, sum(n) AS score FROM c GROUP BY 1 HAVING count(*) = 2 ORDER BY score DESC, doc_id LIMIT 40),
 p AS (SELECT vec_id AS probe_id FROM embeddings WHERE vec_id % 50 = 0), e AS (SELECT * FROM p, e0),
 v AS (SELECT q.vec_id AS probe_id, a.vec_id AS doc_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings q WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) DESC, a.vec_id) <= 40)
 SELECT coalesce(e.probe_id, v.probe_id) AS probe_id, coalesce(e.doc_id, v.doc_id) AS doc_id, round(0.5 * least(1.0, greatest(0.0, coalesce(CAST(e.score AS DOUBLE) / (1 + e.score), 0))) + 0.5 * least(1.0, greatest(0.0, coalesce(v.score, 0))), 7) AS score FROM e FULL JOIN v ON e.doc_id = v.doc_id AND e.probe_id = v.probe_id""",
    "vector_topk": "SELECT q.vec_id AS probe_id, a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings q WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) DESC, a.vec_id) <= 20",
    "vector_l2": "SELECT q.vec_id AS probe_id, a.vec_id, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS distance FROM embeddings a, embeddings q WHERE q.vec_id % 50 = 0",
    "search_rank_bm25": """WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9'']+'))) AS t FROM documents), c AS (SELECT doc_id, t, count(*) AS n FROM t GROUP BY 1, 2), d AS (SELECT doc_id, CAST(sum(n) AS DOUBLE) AS len FROM c GROUP BY 1), a AS (SELECT count(*) AS docs, avg(len) AS avg_len FROM d), f AS (SELECT t, count(*) AS df FROM c WHERE t IN ('heavy', 'bridge') GROUP BY 1)
 SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM c JOIN f USING (t) JOIN d USING (doc_id), a GROUP BY 1""",
    "vector_model_counts": "SELECT label AS model, count(*) AS vectors, CASE WHEN count(*) >= 50000000 THEN 3 WHEN count(*) >= 10000000 THEN 2 WHEN count(*) >= 5000000 THEN 1 ELSE 0 END AS tier FROM embeddings GROUP BY 1",
    "mention_ids": "SELECT DISTINCT source_id, segment_id, mention_text, substr(sha256(source_id || chr(31) || 'l' || chr(31) || coalesce(segment_id, '') || chr(31) || coalesce(mention_text, '')), 1, 32) AS id, 'entity:canonical:' || substr(sha256(array_to_string(list_sort(list_distinct([coalesce(mention_text, ''), 'x'])), chr(31))), 1, 16) AS canonical, 'character:' || source_id || ':' || substr(sha256(coalesce(mention_text, '')), 1, 12) AS fallback FROM source_mention",
}
