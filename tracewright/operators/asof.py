"""The last value before a row, for keys of any size."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(df: DataFrame, keys: list[str], order: str, value: Column, out: str, width: int = 1 << 20) -> DataFrame:
    """Adds `out`: the last non-null `value` of the same keys at a lower order. See lasts_before."""
    return lasts_before(df, keys, order, {out: value}, width)


def lasts_before(df: DataFrame, keys: list[str], order: str, values: Mapping[str, Column], width: int = 1 << 20) -> DataFrame:
    """Adds for each of `values` its last non-null value of the same keys at a lower order.

    The order column is a whole number. Windows cover stretches of `width`
    orders of one key, and what earlier stretches end with comes from one
    summary row each, so a key with most of the rows is no single task. Null
    keys are one key. Equal orders do not see each other.
    """
    k = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in keys]
    df = df.withColumn("_k", F.concat_ws("\u0001", *k)).withColumn("_b", F.floor(F.col(order) / width))
    df = df.withColumns({f"_v{i}": F.when(v.isNotNull(), F.struct(v.alias("v"))) for i, v in enumerate(values.values())})
    n = range(len(values))
    here = Window.partitionBy("_k", "_b").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"_here{i}": F.last(f"_v{i}", ignorenulls=True).over(here) for i in n})
    ends = df.groupBy("_k", "_b").agg(*[F.max_by(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), F.col(order))).alias(f"_end{i}") for i in n])
    earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_k", "_b", *[F.last(f"_end{i}", ignorenulls=True).over(earlier).alias(f"_carry{i}") for i in n]).where(" or ".join(f"_carry{i} is not null" for i in n))
    df = df.join(ends, ["_k", "_b"], "left").withColumns({out: F.coalesce(f"_here{i}", f"_carry{i}")["v"] for i, out in enumerate(values)})
    return df.drop("_k", "_b", *[f"_{x}{i}" for x in ("v", "here", "carry") for i in n])
