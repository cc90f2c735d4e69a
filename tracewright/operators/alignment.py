"""Correspondence of two sequences of units."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scene_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All units of one scene with each other: keys, scene, left_ref, right_ref.

    left, right: keys, ref, scene. The result is many-to-many by definition.
    """
    return left.select(*keys, "scene", F.col("ref").alias("left_ref")).join(right.select(*keys, "scene", F.col("ref").alias("right_ref")), [*keys, "scene"])


def unmatched(units: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Units whose scene the other side lacks."""
    return units.join(other.select(*keys, "scene").distinct(), [*keys, "scene"], "left_anti")


def pair_confidence(base: float, similarity: Column, start_gap: Column | None = None, end_gap: Column | None = None) -> Column:
    """Base, plus what similarity and closeness in time add, from 0.05 to 0.99."""
    c = F.lit(base) + 0.4 * similarity
    if start_gap is not None:
        c = c + 0.3 * F.greatest(F.lit(0.0), 1.0 - 0.01 * F.greatest(F.abs(start_gap), F.abs(end_gap)))
    return F.floor(F.least(F.lit(0.99), F.greatest(F.lit(0.05), c)) * 10_000 + 0.5) / 10_000


def reordered(pairs: DataFrame, keys: list[str], left_no: str, right_no: str) -> DataFrame:
    """keys, reordered: whether any two pairs stand in another order on the two sides.

    Two pairs disagree if one's left number is smaller while its right one is
    not (a tie is a disagreement). So the order agrees throughout only if equal
    numbers on one side are one number on the other, and the numbers rise
    together; both show in aggregates and one window, without comparing pairs.
    """
    from pyspark.sql import Window

    d = pairs.where(F.col(left_no).isNotNull() & F.col(right_no).isNotNull()).groupBy(*keys, left_no).agg(F.min(right_no).alias("lo"), F.max(right_no).alias("hi"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(left_no).rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("before", F.max("hi").over(w)).groupBy(*keys).agg(F.max((F.col("lo") != F.col("hi")) | F.coalesce(F.col("before") >= F.col("lo"), F.lit(False))).alias("reordered"))


def dtw_path(d: np.ndarray) -> list[tuple[int, int]]:
    """The elastic path through a matrix of distances; of equal costs diagonal before up before left."""
    n, m = d.shape
    if not n or not m:
        return []
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0.0
    cost[1:, 0] = np.cumsum(d[:, 0])
    cost[0, 1:] = np.cumsum(d[0])
    for i in range(1, n + 1):
        row, up = cost[i], cost[i - 1]
        best = np.minimum(up[:-1], up[1:])
        for j in range(1, m + 1):
            row[j] = d[i - 1, j - 1] + min(best[j - 1], row[j - 1])
    out, i, j = [], n, m
    while i and j:
        out.append((i - 1, j - 1))
        a, b, c = cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1]
        if a <= b and a <= c:
            i, j = i - 1, j - 1
        elif b <= c:
            i -= 1
        else:
            j -= 1
    out += [(k, 0) for k in range(i - 1, -1, -1)] + [(0, k) for k in range(j - 1, -1, -1)]
    return out[::-1]


def align_time(left: DataFrame, right: DataFrame, key: str, base: float = 0.3) -> DataFrame:
    """key, left_ref, right_ref, confidence along the time path of each key's two sequences (ref, s, e).

    One key is one pair of documents, whose path is inherently sequential.
    """
    both = left.select(key, "ref", "s", "e", F.lit(0).alias("side")).unionByName(right.select(key, "ref", "s", "e", F.lit(1).alias("side")))
    kind = dict(left.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf.side == k].sort_values(["s", "ref"], ignore_index=True) for k in (0, 1))
        mid = lambda x: ((x.s + x.e) / 2).to_numpy(dtype=float)
        path = dtw_path(np.abs(mid(a)[:, None] - mid(b)[None, :])) if len(a) and len(b) else []
        rows = []
        for i, j in path:
            gap = max(abs(a.s[i] - b.s[j]), abs(a.e[i] - b.e[j]))
            c = base + 0.3 * max(0.0, 1.0 - 0.01 * gap)
            rows.append((pdf[key].iloc[0], a.ref[i], b.ref[j], round(min(0.99, max(0.05, c)), 4)))
        return pd.DataFrame(rows, columns=[key, "left_ref", "right_ref", "confidence"])

    return both.groupBy(key).applyInPandas(run, f"{key} {kind}, left_ref string, right_ref string, confidence double")
