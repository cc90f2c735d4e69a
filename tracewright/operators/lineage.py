"""Stage graphs, audits and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.session import discard, written

#: Stages of a source's decomposition and what each needs.
STAGES = (
    ("FORMAT_ANALYSIS", "INGEST", "source_bytes"),
    ("BASIC_SEGMENTATION", "FORMAT_ANALYSIS", "format_analysis"),
    ("LOW_LEVEL_EXTRACTION", "BASIC_SEGMENTATION", "segments"),
    ("STRUCTURAL_ANALYSIS", "LOW_LEVEL_EXTRACTION", "evidence_records"),
    ("ENTITY_RESOLUTION", "STRUCTURAL_ANALYSIS", "structural_assertions"),
    ("ENTITY_RESOLUTION", "LOW_LEVEL_EXTRACTION", "evidence_records"),
    ("CROSS_SOURCE_ALIGNMENT", "ENTITY_RESOLUTION", "resolved_entities"),
    ("CROSS_SOURCE_ALIGNMENT", "STRUCTURAL_ANALYSIS", "structural_assertions"),
    ("SEMANTIC_RECONCILIATION", "ENTITY_RESOLUTION", "resolved_entities"),
    ("SEMANTIC_RECONCILIATION", "CROSS_SOURCE_ALIGNMENT", "alignments"),
    ("CURRENT_SEARCH_PROJECTION", "SEMANTIC_RECONCILIATION", "reconciled_state"),
)


def stage_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STAGES, "stage string, depends_on string, evidence_class string")


def closure(links: DataFrame, start: str, end: str) -> DataFrame:
    """start, end, distance: all that is reached over links of any number, at the least distance.

    Each round joins the table with itself, so the reach doubles; it ends with
    the round that reaches nothing new, with cycles too. Every round is a written
    table. A null on either side is no link.
    """
    reach = written(links.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(F.col(start).alias("a"), F.col(end).alias("b"), F.lit(1).alias("n")).distinct(), "reach")
    size = reach.count()
    while True:
        far = reach.select("a", F.col("b").alias("via"), F.col("n").alias("n1")).join(reach.select(F.col("a").alias("via"), "b", F.col("n").alias("n2")), "via")
        more = written(reach.unionByName(far.select("a", "b", (F.col("n1") + F.col("n2")).alias("n"))).groupBy("a", "b").agg(F.min("n").alias("n")), "reach")
        discard(reach)
        reach, before, size = more, size, more.count()
        if size == before:
            return reach.select(F.col("a").alias(start), F.col("b").alias(end), F.col("n").alias("distance"))


def descendants(edges: DataFrame) -> DataFrame:
    """root, stage, distance: all that depends on a stage, at its least distance. edges: stage, depends_on."""
    return closure(edges, "depends_on", "stage").withColumnRenamed("depends_on", "root")


def unaffected(edges: DataFrame) -> DataFrame:
    """root, unaffected: how many stages an invalidation of root leaves alone."""
    every = edges.select("stage").union(edges.select("depends_on")).distinct()
    d = descendants(edges).groupBy("root").agg(F.count("*").alias("n"))
    total = every.agg(F.count("*").alias("total"))
    # one row: the number of stages
    return every.withColumnRenamed("stage", "root").join(d, "root", "left").crossJoin(F.broadcast(total)).select("root", (F.col("total") - 1 - F.coalesce("n", F.lit(0))).alias("unaffected"))


def traverse(edges: DataFrame, start: DataFrame, depth: int = 4, limit: int | None = None) -> DataFrame:
    """ref, predicate, distance: what is reached from the start refs over at most depth edges.

    edges: subject, predicate, object_ref; start: ref. Each (object, predicate)
    is reached once, at its least distance. limit: rows of one level, a bound
    of the feature.
    """
    depth = min(depth, 4)
    e = edges.where("object_ref is not null").select("subject", "predicate", "object_ref").distinct()
    front = start.select("ref").distinct()
    found = None
    for n in range(1, depth + 1):
        got = front.join(e, F.col("ref") == F.col("subject")).select(F.col("object_ref").alias("ref"), "predicate").distinct().withColumn("distance", F.lit(n))
        if found is not None:
            got = got.join(found.select("ref", "predicate"), ["ref", "predicate"], "left_anti")
        if limit:
            got = got.orderBy("ref", "predicate").limit(limit)
        found = got if found is None else found.unionByName(got)
        front = got.select("ref").distinct()
    return found


def stage_report(runs: DataFrame) -> DataFrame:
    """stage, counts of actions, seconds from the first start to the last finish. runs: stage, action, ts."""
    n = lambda a: F.sum((F.col("action") == a).cast("bigint")).alias(a)
    first, last = F.min(F.when(F.col("action") == "start", F.col("ts"))), F.max(F.when(F.col("action") == "complete", F.col("ts")))
    return runs.groupBy("stage").agg(n("start"), n("retry"), n("complete"), n("fail"), F.when(last >= first, F.unix_micros(F.to_timestamp(last)) - F.unix_micros(F.to_timestamp(first))).alias("micros"))


def job_status(stages: DataFrame) -> DataFrame:
    """job_id, status. stages: job_id, stage, status; expected: how many stages a job has."""
    bad = F.max(F.col("status").isin("FAILED", "QUARANTINED"))
    done = F.sum((F.col("status") == "COMPLETE").cast("bigint"))
    return stages.groupBy("job_id").agg(F.when(bad, "FAILED").when(done == F.count("*"), "COMPLETE").otherwise("RUNNING").alias("status"), done.alias("complete"))


def freshness(tail: DataFrame, applied: DataFrame) -> DataFrame:
    """name, lag, status. tail: tail; applied: name, applied_seq, paused, max_lag."""
    # one row: the ledger's tail
    x = applied.crossJoin(F.broadcast(tail))
    lag = F.col("tail") - F.col("applied_seq")
    return x.select("name", lag.alias("lag"), F.when(F.col("paused"), "rebuild-in-progress").when(lag <= 0, "fresh").otherwise("transient-lag").alias("status"))
