"""The ledger as a stream.

`state_stream` keeps, for every entity, its rows and lock up to a horizon and the
events after it in the engine's state store, and gives the rows that an input
batch changes. An event that comes late is put in its place by its number and
the rows are folded again from there, so the stream ends with what the batch fold
gives, whatever the order of arrival. `into_generations` appends each batch once,
under the number the engine gives it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewright.operators.state import CHANGES, LOCKS, fold_from

OUT = "entity string, predicate string, object_ref string, confidence double, authority string, state string, seq bigint"


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream, so many files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


_FIELDS = ("seq", "event_type", "target", "authority", "p_authority", "object_ref", "object_entity_id", "target_entity_id", "entity_id", "confidence", "has_confidence", "p_state", "kind")
_ROW = ("object_ref", "confidence", "authority", "state", "seq")


def _folder(horizon: int | None):
    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        who = key[0]
        rows, locked, folded, events, told = json.loads(state.get[0]) if state.exists else ([], False, -1, [], {})
        pdf = pd.concat(list(batches))
        known = {e["seq"]: e for e in events}
        for e in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
            relevant = e["event_type"] in LOCKS or (e["event_type"] in CHANGES and e["target"] is not None)
            if relevant and e["seq"] > folded:
                known.setdefault(e["seq"], {f: e[f] for f in _FIELDS})
        events = [dict(known[s], entity=who) for s in sorted(known)]
        base = {(who, p): r for p, r in rows}
        if horizon is not None and events:
            old = [e for e in events if e["seq"] <= events[-1]["seq"] - horizon]
            if old:
                base, locks = fold_from(base, {who} if locked else set(), old)
                locked, folded, events = bool(locks), events[-1]["seq"] - horizon, events[len(old) :]
        now, _ = fold_from(base, {who} if locked else set(), events)
        new = {p: [r[c] for c in _ROW] for (_, p), r in now.items()}
        changed = sorted(p for p in new | told if new.get(p) != told.get(p))
        state.update((json.dumps([[[p, r] for (_, p), r in base.items()], locked, folded, [{f: e[f] for f in _FIELDS} for e in events], new]),))
        # a row that a late event takes away comes with nothing in it
        yield pd.DataFrame([(who, p, *new.get(p, [None] * len(_ROW))) for p in changed], columns=["entity", "predicate", *_ROW]).astype({"seq": "Int64"})

    return fold


def state_stream(events: DataFrame, horizon: int | None = None) -> DataFrame:
    """The rows that change, as they change; a row that is no more has a null seq. events: as for the batch fold, routed.

    horizon: events so many numbers behind the newest of their entity are folded
    for good, and what comes later than that is too late; this bounds what is
    kept of a busy entity. None keeps all. Of several events with one number the
    first that comes counts.
    """
    return events.where("entity is not null").groupBy("entity").applyInPandasWithState(_folder(horizon), OUT, "kept string", "update", GroupStateTimeout.NoTimeout)


def into_generations(path: str):
    """A function for foreachBatch: one folder a batch, written again if the batch is run again."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every (entity, predicate) from the folders `into_generations` wrote."""
    df = spark.read.schema(OUT + ", batch bigint").parquet(path)
    pick = F.max_by(F.struct("object_ref", "confidence", "authority", "state", "seq"), F.col("batch"))
    return df.groupBy("entity", "predicate").agg(pick.alias("x")).select("entity", "predicate", "x.*").where("seq is not null")


def windowed(events: DataFrame, time_col: str = "ts", every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts of event types in time windows, with a watermark for late rows."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, every), "event_type").agg(F.count("*").alias("n"))
