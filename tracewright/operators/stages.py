"""Runs of stages, segments in context, and what is added only once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claim(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """wanted with won: whether its key was free; of equal keys in wanted the first by `ord` wins."""
    first = Window.partitionBy(key).orderBy("ord")
    x = wanted.withColumn("_n", F.row_number().over(first)).join(done.select(key).distinct().withColumn("_had", F.lit(True)), key, "left")
    return x.withColumn("won", (F.col("_n") == 1) & F.col("_had").isNull()).drop("_n", "_had")


def canonical_refs(runs: DataFrame) -> DataFrame:
    """job_id, stage, refs, ambiguous: the refs of the newest complete run of each stage, sorted; ambiguous if two are newest.

    runs: job_id, stage, status, created_at, refs (array).
    """
    done = runs.where("status = 'COMPLETE'")
    newest = done.groupBy("job_id", "stage").agg(F.max("created_at").alias("created_at"))
    top = done.join(newest, ["job_id", "stage", "created_at"])
    return top.groupBy("job_id", "stage").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs"), (F.count("*") > 1).alias("ambiguous"))


def path_key(path: Column) -> Column:
    """A key that sorts structural paths with numbers as numbers, however long: a number has its length before it."""

    def part(x: Column) -> Column:
        n = F.regexp_replace(x, "^0+(?=[0-9])", "")
        return F.when(x.rlike("^[0-9]+$"), F.concat(F.lpad(F.length(n).cast("string"), 9, "0"), F.lit("."), n)).otherwise(x)

    return F.array_join(F.transform(F.split(path, "/"), part), "/")


def path_number(path: Column, level: str, default: int) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(path, rf"{level}/([0-9]+)", 1), F.lit("")).cast("int"), F.lit(default))


def neighbours(parts: DataFrame, keys: list[str], order: str, text: str, n: int = 80) -> DataFrame:
    """Adds before (the last n characters of the part before) and after (the first n of the next)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return parts.withColumn("before", F.lag(F.expr(f"right({text}, {n})")).over(w)).withColumn("after", F.lead(F.expr(f"left({text}, {n})")).over(w))


def search_documents(mentions: DataFrame, identities: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, ref, text: what search sees, one row each (kind, ref, text).

    mentions: mention_id, mention_text; identities: entity_ref, display_label,
    aliases; edges: subject, predicate, object_ref, fact (an id).
    """
    a = mentions.where("mention_text is not null").select(F.lit("SOURCE_EVIDENCE").alias("kind"), F.col("mention_id").alias("ref"), F.col("mention_text").alias("text"))
    names = F.array_compact(F.concat(F.array("display_label"), F.coalesce("aliases", F.array().cast("array<string>"))))
    b = identities.select(F.lit("CANONICAL_ENTITY").alias("kind"), F.col("entity_ref").alias("ref"), F.explode(names).alias("text"))
    spoken = F.col("predicate").isin("SPEAKS", "SAYS", "UTTERANCE", "PRONUNCIATION")
    c = edges.select(F.lit("INTERPRETATION").alias("kind"), F.concat(F.when(spoken, "assert:").otherwise("edge:"), "fact").alias("ref"), F.coalesce("object_ref", "subject").alias("text"))
    return a.unionByName(b).unionByName(c).distinct()


def new_embeddings(wanted: DataFrame, existing: DataFrame, model: str) -> DataFrame:
    """segment_id, ref, text that the model has not embedded yet, each once; without a segment none."""
    key = ["segment_id", "ref"]
    return wanted.where("segment_id is not null").dropDuplicates(key).join(existing.where(F.col("model") == model).select(*key).distinct(), key, "left_anti")
