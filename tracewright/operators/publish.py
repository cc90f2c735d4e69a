"""Generations of a projection: built beside the old one, published at once, kept for readers, then removed."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from tracewright.session import _delete

GRACE_S = 300


class Generations:
    """A folder of generations and a registry of what is published.

    The registry is a small JSON table of one row a generation; the newest one
    with state PUBLISHED is what `current` reads.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _note(self, generation: str, state: str) -> None:
        self.spark.createDataFrame([(generation, state, time.time_ns())], "generation string, state string, at bigint").coalesce(1).write.mode("append").json(f"{self.root}/registry")

    def registry(self) -> DataFrame:
        """generation, state, at: the last state of each generation."""
        fs, p = self._fs(f"{self.root}/registry")
        if not fs.exists(p):
            return self.spark.createDataFrame([], "generation string, state string, at bigint")
        r = self.spark.read.schema("generation string, state string, at bigint").json(f"{self.root}/registry")
        return r.groupBy("generation").agg({"at": "max"}).withColumnRenamed("max(at)", "at").join(r, ["generation", "at"])

    def publish(self, df: DataFrame) -> str:
        """Writes df as a new generation and makes it the current one."""
        name = f"g-{uuid.uuid4().hex}"
        self._note(name, "BUILDING")
        df.write.parquet(f"{self.root}/{name}")
        old = [r.generation for r in self.registry().where("state = 'PUBLISHED'").collect()]
        self._note(name, "PUBLISHED")
        for g in old:
            self._note(g, "RETIRED")
        return name

    def current(self) -> DataFrame:
        r = self.registry().where("state = 'PUBLISHED'").orderBy("at", ascending=False).first()
        if r is None:
            raise LookupError("nothing is published")
        return self.spark.read.parquet(f"{self.root}/{r.generation}")

    def reap(self, grace_s: float = GRACE_S) -> list[str]:
        """Removes generations that were retired longer ago than the grace."""
        old = [r.generation for r in self.registry().where("state = 'RETIRED'").collect() if time.time_ns() - r.at > grace_s * 1e9]
        for g in old:
            _delete(self.spark, f"{self.root}/{g}")
            self._note(g, "REAPED")
        return old


def backup(df: DataFrame, path: str) -> None:
    """All rows as JSON lines, nulls included."""
    df.write.option("ignoreNullFields", "false").option("compression", "gzip").json(path)


def restore(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
