"""The stream of states against the batch fold."""

import random

import pytest

from tests.test_folds import COLS, random_ledger
from tracewright.operators import state
from tracewright.streaming import ledger as stream


@pytest.mark.parametrize("shuffled", (False, True))
def test_stream_equals_batch(spark, tmp_path, shuffled):
    rows = sorted(random_ledger(3), key=lambda r: r[0])
    if shuffled:
        random.Random(5).shuffle(rows)
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for i in range(0, len(rows), 90):
        spark.createDataFrame(rows[i : i + 90], COLS).coalesce(1).write.mode("append").parquet(src)
    df = spark.createDataFrame(rows, COLS)
    q = stream.state_stream(stream.read(spark, src, df.schema, 1)).writeStream.outputMode("update").foreachBatch(stream.into_generations(out)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    key = lambda d: sorted((tuple(r) for r in d.select("entity", "predicate", "object_ref", "confidence", "authority", "state", "seq").collect()), key=repr)
    assert key(stream.latest(spark, out)) == key(state.reduce_state(df))


def test_windows(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' event_type union all select timestamp'2024-01-01 00:50:00', 'a'").coalesce(1).write.parquet(f"file://{tmp_path}/e")
    s = stream.read(spark, f"file://{tmp_path}/e", "ts timestamp, event_type string")
    q = stream.windowed(s).writeStream.outputMode("complete").format("memory").queryName("windows_out").start()
    q.processAllAvailable()
    q.stop()
    assert [r.n for r in spark.sql("select n from windows_out").collect()] == [2]


def test_late_events_and_the_horizon():
    class State:
        exists, get = False, None

        def update(self, x):
            self.exists, self.get = True, x

    import pandas as pd

    def feed(*batches, horizon=None):
        state, out = State(), {}
        for b in batches:
            df = pd.DataFrame([dict.fromkeys(stream._FIELDS) | {"has_confidence": False} | e for e in b])
            for got in stream._folder(horizon)(("e",), iter([df]), state):
                out |= {r.predicate: None if pd.isna(r.seq) else (r.object_ref, r.authority, int(r.seq)) for r in got.itertuples()}
        return out

    said = lambda n, o, t="p": {"seq": n, "event_type": "SemanticAsserted", "target": t, "object_ref": o, "authority": "machine"}
    over = lambda n, o: {"seq": n, "event_type": "OverrideApplied", "target": "p", "object_ref": o}
    lock = lambda n, on: {"seq": n, "event_type": "Locked" if on else "Unlocked", "target": None}
    assert feed([said(5, "a")], [over(3, "b")]) == {"p": ("b", "USER_OVERRIDE", 3)}
    assert feed([said(5, "a")], [lock(2, True)]) == {"p": None}
    assert feed([said(5, "a")], [lock(2, True)], [lock(4, False)]) == {"p": ("a", "machine", 5)}
    assert feed([lock(6, False)], [lock(2, True), said(7, "x")], [said(4, "y")]) == {"p": ("x", "machine", 7)}
    assert feed([said(1, "a"), said(50, "b", "q")], [over(2, "z")], horizon=10) == {"p": ("a", "machine", 1), "q": ("b", "machine", 50)}
