"""Exact, ranked, fuzzy, vector and combined search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import ids, locators
from tracewright.functions import text as X
from tracewright.functions import vectors as V


def filtered(
    docs: DataFrame, source_id: str | None = None, work_id: str | None = None, continuity_id: str | None = None, segment_id: str | None = None,
    entity_ref: str | None = None, kind: str | None = None, language: str | None = None, locator_prefix: str | None = None,
) -> DataFrame:
    """The search documents that all given filters let through, before any is ranked. Ids count with and without dashes."""
    for name, v in (("source_id", source_id), ("work_id", work_id), ("continuity_id", continuity_id)):
        if v:
            docs = docs.where(F.col(name) == ids.dashed_uuid(F.lit(v)))
    for name, v in (("segment_id", segment_id), ("entity_ref", entity_ref), ("kind", kind), ("language", language)):
        if v:
            docs = docs.where(F.col(name) == v)
    return docs.where(F.startswith("locator", F.lit(locator_prefix))) if locator_prefix else docs


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, n: how often each lower-case word stands in each document."""
    return docs.select(id_col, F.explode(F.transform(X.tokens(F.col(text_col)), F.lower)).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("n"))


def exact(post: DataFrame, words: Sequence[str], id_col: str) -> DataFrame:
    """id, score: documents with all the words, and how often they stand there."""
    want = sorted({w.lower() for w in words})
    return post.where(F.col("term").isin(want)).groupBy(id_col).agg(F.count("*").alias("k"), F.sum("n").alias("score")).where(F.col("k") == len(want)).select(id_col, "score")


def bm25(post: DataFrame, words: Sequence[str], id_col: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score: documents with any of the words by BM25."""
    size = post.groupBy(id_col).agg(F.sum("n").cast("double").alias("len"))
    whole = size.agg(F.count("*").alias("docs"), F.avg("len").alias("avg_len"))
    hit = post.where(F.col("term").isin(sorted({w.lower() for w in words})))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    # one row, and one row a word of the query: their size does not depend on the data
    x = hit.join(F.broadcast(df), "term").join(size, id_col).crossJoin(F.broadcast(whole))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return x.groupBy(id_col).agg(F.sum(idf * F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))).alias("score"))


def fuzzy(texts: DataFrame, col: str, query: str, threshold: float = 0.3) -> DataFrame:
    """col, similarity: shared among all trigrams of text and query."""
    s = X.jaccard(X.trigrams(F.col(col)), X.trigrams(F.lit(query)))
    return texts.select(col, s.alias("s")).where(F.col("s") >= threshold).select(col, F.round("s", 6).alias("similarity"))


def _matrix(rows: Sequence, dim: int) -> np.ndarray:
    return np.array([np.zeros(dim) if len(r) == 0 else np.asarray(r, dtype=float) for r in rows]).reshape(len(rows), dim)


def _blocks(df: DataFrame, name: str, block: int) -> DataFrame:
    b = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-df.count() // block))))
    return df.groupBy(b.alias("b")).agg(F.collect_list("vec_id").alias(f"{name}_ids"), F.collect_list(F.coalesce("embedding", F.array().cast("array<float>"))).alias(name)).drop("b")


def nearest_vectors(vectors: DataFrame, probes: DataFrame, k: int | None, metric: str = "cosine", block: int = 2048) -> DataFrame:
    """probe_id, vec_id, score: the k nearest of all vectors (all of them for None) to each probe; equal scores by id.

    metric is cosine (6 digits, 0 for zero and missing vectors) or l2 (5 digits,
    the least is nearest). Both sides come in blocks; a pair of blocks is scored
    at once and hands on k rows a probe.
    """

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q_ids, q, v_ids, v in batch[["q_ids", "q", "v_ids", "v"]].itertuples(index=False):
                dim = max((len(r) for r in (*q, *v)), default=0)
                q, v, v_ids = _matrix(q, dim), _matrix(v, dim), np.asarray(v_ids)
                q_len, v_len = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
                for i, (q_id, x) in enumerate(zip(q_ids, q)):
                    if metric == "l2":
                        score, digits = np.sqrt(((v - x) ** 2).sum(axis=1)), 1e5
                    else:
                        n, digits = v_len * q_len[i], 1e6
                        score = np.divide(v @ x, n, out=np.zeros(len(v)), where=n > 0)
                    score = np.copysign(np.floor(np.abs(score) * digits + 0.5) / digits, score) + 0.0
                    order = np.lexsort((v_ids, score if metric == "l2" else -score))[:k]
                    yield pd.DataFrame({"probe_id": q_id, "vec_id": v_ids[order], "score": score[order]})

    got = _blocks(probes, "q", block).crossJoin(_blocks(vectors, "v", block)).mapInPandas(scored, "probe_id long, vec_id long, score double")
    if k is None:
        return got
    w = Window.partitionBy("probe_id").orderBy(F.col("score") if metric == "l2" else F.desc("score"), "vec_id")
    return got.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")


def hybrid_each(text_hits: DataFrame, vector_hits: DataFrame, probes: DataFrame, id_col: str, k: int, weight: float = 0.5) -> DataFrame:
    """probe_id, id, score (7 digits): `hybrid` for each probe. vector_hits: probe_id, id, score, the best k of each probe."""
    best = text_hits.orderBy(F.desc("score"), id_col).limit(k).select(id_col, F.col("score").cast("double").alias("e"))
    a = probes.select(F.col("vec_id").alias("probe_id")).crossJoin(F.broadcast(best))  # k rows
    b = vector_hits.select("probe_id", id_col, F.col("score").alias("v"))
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))
    return a.join(b, ["probe_id", id_col], "full_outer").select("probe_id", id_col, F.round((1 - weight) * unit(F.col("e") / (1 + F.col("e"))) + weight * unit(F.col("v")), 7).alias("score"))


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, id_col: str, k: int, weight: float = 0.5) -> DataFrame:
    """id, score: the best k of either side, fused; a text score s counts s / (1 + s)."""
    a = text_hits.orderBy(F.desc("score"), id_col).limit(k).select(id_col, F.col("score").cast("double").alias("e"))
    b = vector_hits.orderBy(F.desc("score"), id_col).limit(k).select(id_col, F.col("score").alias("v"))
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))
    return a.join(b, id_col, "full_outer").select(id_col, F.round((1 - weight) * unit(F.col("e") / (1 + F.col("e"))) + weight * unit(F.col("v")), 6).alias("score"))


def vector_review(vectors: DataFrame, model_col: str) -> DataFrame:
    """model, vectors, tier: how many thresholds of review the number has crossed."""
    n = F.count("*")
    return vectors.groupBy(F.col(model_col).alias("model")).agg(n.alias("vectors")).withColumn("tier", sum((F.col("vectors") >= x).cast("int") for x in (5_000_000, 10_000_000, 50_000_000)))


def newest_versions(refs: DataFrame) -> DataFrame:
    """source_id, modality, segment, newest, versions: the newest locator of each bare one."""
    p = refs.select("locator", locators.parse(F.col("locator")).alias("p")).where("p.valid")
    rank = F.struct(*[F.coalesce(F.col(f"p.{c}"), F.lit(-1)).alias(c) for c in ("segmenter", "decoder", "renderer")], F.col("locator"))
    return p.groupBy("p.source_id", "p.modality", "p.segment").agg(F.max_by("locator", rank).alias("newest"), F.count("*").alias("versions"))


def alike_names(names: DataFrame, threshold: float = 0.8) -> DataFrame:
    """work_id, left_name, right_name, similarity: names of one work whose word sets are this alike, lower-case spellings by the words of their normal forms.

    A name without a word is like none. Names of the same words all meet, as
    they are all in the result; other names need a size that this similarity allows.
    """
    n = names.where("work_id is not null and mention_text is not null").select("work_id", F.lower("mention_text").alias("name")).distinct()
    n = n.withColumn("t", X.words("name")).where("size(t) >= 1")
    word = n.select("work_id", "name", F.size("t").alias("size"), F.explode("t").alias("w"))
    freq = word.groupBy("work_id", "w").agg(F.count("*").alias("f"))
    order = Window.partitionBy("work_id", "name").orderBy("f", "w")
    rare = word.join(freq, ["work_id", "w"]).withColumn("i", F.row_number().over(order)).where(F.col("i") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size")) + 1)
    a, b = (rare.select("work_id", "w", F.col("name").alias(f"{x}_name"), F.col("size").alias(f"{x}_size")) for x in ("left", "right"))
    fits = F.least("left_size", "right_size") >= threshold * F.greatest("left_size", "right_size")
    pairs = a.join(b, ["work_id", "w"]).where("left_name < right_name").where(fits).select("work_id", "left_name", "right_name").distinct()
    ta, tb = (n.select("work_id", F.col("name").alias(f"{x}_name"), F.col("t").alias(y)) for x, y in (("left", "ta"), ("right", "tb")))
    x = pairs.join(ta, ["work_id", "left_name"]).join(tb, ["work_id", "right_name"]).withColumn("s", X.jaccard(F.col("ta"), F.col("tb")))
    return x.where(F.col("s") >= threshold).select("work_id", "left_name", "right_name", F.round("s", 6).alias("similarity"))
