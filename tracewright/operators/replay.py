"""Bringing a projection up to the ledger: checkpoint, poison, pause and resume.

A run classifies the events after the checkpoint. It goes as far as the first
event that pauses, leaves out what rests on quarantined refs, and saves one
checkpoint when the projection is written. The state itself is always folded from
the whole ledger, so all tiers agree. Nothing is looped over: the pause is a
minimum, and what a run applies is a filter.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.ledger import poison

_CHECKPOINT = "projection string, applied_seq bigint, pause_reason string, pause_seq bigint, applied bigint, skipped bigint, at bigint"


class Checkpoints:
    """One JSON row for each save, in a folder; the newest of a projection counts. A row is there as a whole or not at all."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def all(self) -> DataFrame:
        """The newest checkpoint of each projection."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], _CHECKPOINT)
        df = self.spark.read.schema(_CHECKPOINT).json(self.path)
        return df.groupBy("projection").agg(F.max_by(F.struct(*[c for c in df.columns if c != "projection"]), "at").alias("x")).select("projection", "x.*")

    def get(self, projection: str) -> dict:
        r = self.all().where(F.col("projection") == projection).first()
        return r.asDict() if r else {"projection": projection, "applied_seq": 0, "pause_reason": None, "pause_seq": None, "applied": 0, "skipped": 0, "at": 0}

    def save(self, **row: object) -> None:
        self.spark.createDataFrame([{"at": time.time_ns()} | row], _CHECKPOINT).coalesce(1).write.mode("append").json(self.path)

    def paused(self) -> DataFrame:
        """projection, pause_reason, pause_seq, applied_seq of every projection that waits."""
        return self.all().where("pause_reason is not null").select("projection", "pause_reason", "pause_seq", "applied_seq")


def lagging(checkpoints: DataFrame, needed: str, target: int) -> bool:
    """Whether a projection that another one reads has not got as far as that one's target."""
    return not checkpoints.where((F.col("projection") == needed) & F.col("pause_reason").isNull() & (F.col("applied_seq") < target)).isEmpty()


def replay(store: Checkpoints, projection: str, events: DataFrame, quarantined: DataFrame, apply: Callable[[DataFrame], None], force_resume: bool = False, wipe: bool = False, poisoned: bool = True) -> dict:
    """Applies what is new to a projection and returns its checkpoint.

    events: seq, event_type, authority, refs and what `apply` reads; quarantined:
    ref. A projection that is paused stays so until force_resume, which, like
    wipe, applies everything from the start; force_resume also goes through what
    pauses. `apply` gets the events of the run that are neither skipped nor
    beyond the pause; if it fails nothing is saved. An empty ledger keeps the
    checkpoint where it is.
    """
    was = store.get(projection)
    if was["pause_reason"] is not None and not (force_resume or wipe):
        return was
    start = 0 if force_resume or wipe else was["applied_seq"]
    new = events.where(F.col("seq") > start)
    if not poisoned or force_resume:
        run = new.withColumn("verdict", F.lit("APPLY"))
    else:
        run = poison(new, quarantined)
    stop = run.where("verdict = 'PAUSE'").agg(F.min(F.struct("seq", "event_type")).alias("x")).first()["x"]
    run = run if stop is None else run.where(F.col("seq") < stop.seq)
    todo = run.where("verdict = 'APPLY'").drop("verdict")
    n = run.agg(F.max("seq").alias("last"), F.count_if(F.col("verdict") == "APPLY").alias("applied"), F.count_if(F.col("verdict") == "SKIP").alias("skipped")).first()
    apply(todo)
    at = stop.seq if stop is not None else max(was["applied_seq"], n["last"] or 0)
    store.save(projection=projection, applied_seq=at, pause_reason=None if stop is None else f"authority event {stop.event_type}", pause_seq=None if stop is None else stop.seq, applied=n["applied"], skipped=n["skipped"])
    return store.get(projection)
