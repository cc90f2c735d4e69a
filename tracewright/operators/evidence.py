"""What evidence rests on, what is missing, and what is sure: small folds over records of a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def incomplete(jobs: DataFrame, stages: DataFrame, cancelled: DataFrame) -> DataFrame:
    """job_id, branch: what of a job did not end: 'job:STATUS', 'stage:STATUS', and 'stage:cancelled' for stages it never reported.

    jobs: job_id, status; stages: job_id, stage, status; cancelled: job_id, stage.
    """
    a = jobs.where("status <> 'COMPLETE' or status is null").select("job_id", F.concat(F.lit("job:"), F.coalesce("status", F.lit("null"))).alias("branch"))
    b = stages.where(~F.coalesce(F.col("status").isin("complete", "COMPLETED", "COMPLETE"), F.lit(False))).select("job_id", F.concat_ws(":", "stage", F.coalesce("status", F.lit("null"))).alias("branch"))
    c = cancelled.select("job_id", "stage").distinct().join(stages.select("job_id", "stage").distinct(), ["job_id", "stage"], "left_anti").select("job_id", F.concat("stage", F.lit(":cancelled")).alias("branch"))
    return a.unionByName(b).unionByName(c).distinct()


def mean_confidence(answers: DataFrame, key: str, digits: int = 3) -> DataFrame:
    """key, confidence: the mean of what answers are sure of; 0 if any of them contradicts or none is sure. answers: key, confidence, contradicts."""
    bad = F.coalesce(F.max(F.coalesce("contradicts", F.lit(False))), F.lit(False))
    return answers.groupBy(key).agg(F.when(bad, 0.0).otherwise(F.coalesce(F.round(F.avg("confidence"), digits), F.lit(0.0))).alias("confidence"))


def dominant(hits: DataFrame, key: str) -> DataFrame:
    """key, target: the target that most hits of a key name; of equals the first in byte order. hits: key, target."""
    n = hits.where("target is not null").groupBy(key, "target").agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min_by("target", F.struct(-F.col("n"), "target")).alias("target"))


def in_order(values: Column) -> Column:
    """The different values of an array, each where it comes first."""
    return F.array_distinct(values)


def quarantined_locators(locators: DataFrame, quarantine: DataFrame, column: str = "locator") -> DataFrame:
    """Rows whose locator is quarantined itself or lies under a quarantined one (which it begins with).

    A locator asks for each of its beginnings that is as long as some quarantined
    ref, so both sides meet in an equi-join and no row meets all of a list.
    quarantine: ref.
    """
    c = F.col(column)
    q = quarantine.where("ref <> ''").select("ref").distinct()
    # as many numbers as refs have different lengths
    lengths = sorted(r[0] for r in q.select(F.length("ref")).distinct().collect())
    if not lengths:
        return locators.limit(0)
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(c))
    asked = locators.select(column).distinct().select(column, F.explode(F.transform(cuts, lambda n: c.substr(F.lit(1), n))).alias("ref"))
    return locators.join(asked.join(q, "ref", "left_semi").select(column).distinct(), column, "left_semi")


def overlapping_edges(edges: DataFrame, after: Column | None = None, before: Column | None = None) -> DataFrame:
    """Edges whose narrative time (from_, to_: timestamps) meets [after, before]; without a bound on that side all of them, a null end never."""
    df = edges
    if after is not None:
        df = df.where(F.col("to_") >= after)
    return df if before is None else df.where(F.col("from_") <= before)


def within_continuity(rows: DataFrame, correspondences: DataFrame, continuity_id: str, column: str = "subject") -> DataFrame:
    """Rows that a correspondence of a continuity names on either side. correspondences: subject_ref, object_ref, continuity_id."""
    c = correspondences.where(F.col("continuity_id") == continuity_id).select(F.explode(F.array("subject_ref", "object_ref")).alias(column)).where(F.col(column).isNotNull()).distinct()
    return rows.join(c, column, "left_semi")


def bursts(runs: DataFrame, key: str, gap_s: float, frame_s: float = 0.02) -> DataFrame:
    """key, word (from 1), start_frame, end_frame, bursts: runs of sound closer than the gap are one word. runs: key, start_frame, end_frame."""
    w = Window.partitionBy(key).orderBy("start_frame", "end_frame")
    new = F.coalesce((F.col("start_frame") - F.lag("end_frame").over(w)) * frame_s >= gap_s, F.lit(True))
    x = runs.withColumn("word", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return x.groupBy(key, "word").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.count("*").alias("bursts"))


def language(declared: Column, configured: Column) -> Column:
    """language, confidence, origin: as declared (0.5), else as configured (0.4), else unknown (0)."""
    one = lambda v, c, o: F.struct(v.alias("language"), F.lit(c).alias("confidence"), F.lit(o).alias("origin"))
    return F.when(F.coalesce(declared, F.lit("")) != "", one(declared, 0.5, "declared")).when(F.coalesce(configured, F.lit("")) != "", one(configured, 0.4, "config")).otherwise(one(F.lit("unknown"), 0.0, "unknown"))


def unknown_speakers(utterances: DataFrame, key: str) -> DataFrame:
    """Adds speaker_label 'speaker_unknown_utterance_N' and confidence 0.3, N from 1 in the order of utterance_index: candidates, never identities."""
    w = Window.partitionBy(key).orderBy("utterance_index")
    return utterances.withColumn("speaker_label", F.concat(F.lit("speaker_unknown_utterance_"), F.row_number().over(w).cast("string"))).withColumn("confidence", F.lit(0.3))


def chapter_scenes(segments: DataFrame, key: str) -> DataFrame:
    """key, scene (from 1), chapter, first, last: a scene begins wherever the chapter changes. segments: key, ordinal, chapter."""
    w = Window.partitionBy(key).orderBy("ordinal")
    new = F.coalesce(~F.col("chapter").eqNullSafe(F.lag("chapter").over(w)), F.lit(True)) | (F.row_number().over(w) == 1)
    x = segments.withColumn("scene", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return x.groupBy(key, "scene", "chapter").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


def works_of(memberships: DataFrame) -> DataFrame:
    """work_id, source_id, roles: each source of a work once, with its roles in byte order. memberships: work_id, source_id, role."""
    return memberships.where("work_id is not null and source_id is not null").groupBy("work_id", "source_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))


def child_manifests(manifests: DataFrame, edges: DataFrame) -> DataFrame:
    """One manifest for each stage that needs the parent's: its source, segment, tools and evidence are the parent's. edges: stage, depends_on."""
    rest = [c for c in manifests.columns if c != "stage"]
    return manifests.withColumnRenamed("stage", "depends_on").join(edges.select("stage", "depends_on").distinct(), "depends_on").select("stage", *rest)
