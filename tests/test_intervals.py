"""Periods and gaps against a plain sweep, and the defined cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from tracewright.operators import intervals
from tracewright.operators.intervals import millis, periods_and_gaps, unite

S = "a string, b bigint, s bigint, e bigint, span_kind string"


def sweep(rows):
    out = []
    by = {}
    for a, b, s, e in rows:
        if s is not None and e is not None and s < e:
            by.setdefault((a, b), []).append((s, e))
    for (a, b), spans in by.items():
        lists = []
        for s, e in sorted(spans):
            if lists and s <= lists[-1][1]:
                lists[-1][1] = max(lists[-1][1], e)
            else:
                lists.append([s, e])
        out += [(a, b, "period", s, e) for s, e in lists]
        out += [(a, b, "gap", x[1], y[0]) for x, y in zip(lists, lists[1:])]
    return sorted(out, key=repr)


def run(spark, rows, piece):
    df = spark.createDataFrame([(*r, "clash") for r in rows], S)
    return sorted((tuple(r) for r in periods_and_gaps(df, ["a", "b"], "s", "e", piece).collect()), key=repr)


def test_random_against_sweep(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(1500):
        a = rnd.choice(["hot", "hot", "x", None])
        s = rnd.randrange(0, 4000)
        e = s + rnd.choice([0, -3, 1, 2, 5, 9, 900 if rnd.random() < 0.02 else 3])
        rows.append((a, rnd.choice([1, None]), rnd.choice([s, s, s, None]) if rnd.random() < 0.05 else s, e))
    rows += rows[:50]
    for n in (1 << 22, 700, 7):
        assert run(spark, rows, n) == sweep(rows)


def test_one_span_over_all_partitions(spark):
    rows = [("k", 1, 0, 10_000)] + [("k", 1, i * 10, i * 10 + 5) for i in range(500)] + [("k", 1, 20_000, 20_001)]
    assert run(spark, rows, 64) == [("k", 1, "gap", 10_000, 20_000), ("k", 1, "period", 0, 10_000), ("k", 1, "period", 20_000, 20_001)]


def test_touching_and_nested_and_empty(spark):
    assert run(spark, [("k", 1, 0, 5), ("k", 1, 5, 7), ("k", 1, 1, 2)], 2) == [("k", 1, "period", 0, 7)]
    assert run(spark, [("k", 1, 5, 5), ("k", 1, None, 7)], 2) == []
    assert run(spark, [], 2) == []


def test_millis(spark):
    df = spark.createDataFrame([(1.2345,), (float("nan"),), (float("inf"),), (None,), (16.65200006189025,)], "x double")
    assert [r[0] for r in df.select(millis(df.x)).collect()] == [1235, None, None, None, 16652]


def test_lists_are_mergeable():
    rnd = np.random.default_rng(3)
    g, s = rnd.integers(0, 3, 400), rnd.integers(-900, 900, 400) * 2**40
    e = s + rnd.integers(1, 30, 400) * 2**40
    whole = unite(g, s, e)
    cut = [unite(g[i::7], s[i::7], e[i::7]) for i in range(7)]
    while len(cut) > 1:
        cut = [unite(*(np.concatenate(x) for x in zip(*cut[i : i + 2]))) for i in range(0, len(cut), 2)]
    assert all((a == b).all() for a, b in zip(whole, cut[0]))


def test_tree_of_two_levels(spark, monkeypatch):
    monkeypatch.setattr(intervals, "FAN_IN", 2)
    rows = [("k", i % 2, i * 3 % 500, i * 3 % 500 + i % 4) for i in range(600)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], S).repartition(9)
    assert sorted((tuple(r) for r in periods_and_gaps(df, ["a", "b"], "s", "e", 50).collect()), key=repr) == sweep(rows)


def test_lists_over_several_batches(spark):
    rows = [(f"t{i % 7}", i % 2, i * 3 % 900, i * 3 % 900 + i % 5) for i in range(800)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], S).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        # a key that is never null and one that may be: both go from batch to batch
        got = periods_and_gaps(df.withColumn("kind", F.lit("x")), ["kind", "a", "b"], "s", "e", 50)
        assert sorted((tuple(r)[1:] for r in got.collect()), key=repr) == sweep(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
