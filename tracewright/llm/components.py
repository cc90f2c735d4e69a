"""Groups of records from pairwise matches, by alternating star rewrites.

Large-star: every neighbour of u that is larger than u is linked to the smallest
record among u and its neighbours. Small-star: u and its smaller neighbours are
linked to the smallest of them. Both keep the connections and together they end,
after a number of rounds that grows as the logarithm of the group size squared
at worst, in stars whose centre is the smallest record of the group.

Both are joins of the edge table with one row a record (its smallest neighbour),
which is aggregated before the shuffle; a record with a third of all links is an
ordinary skewed key of such a join, which adaptive execution splits, because no
group of neighbours is ever gathered. Records are numbered once in the order of
their refs, so that the rounds move numbers and not texts. Every round is written
to the shared folder, so that the plan does not grow and a lost executor costs
no round.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tracewright.session import discard, written

LINKS = ("CORRESPONDS_TO", "ALIAS_OF")


def cleaned(c: Column) -> Column:
    """Without surrounding white space, in lower case."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def _least(edges: DataFrame) -> DataFrame:
    """c, m: the smallest neighbour of each record that has a smaller one."""
    return edges.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """edges: (u, v) with u > v. The result has the same form and no more rows.

    Every pair stands in edges once, the larger record first, so u is among the
    larger neighbours of v, and the smallest record that v knows is v itself
    unless v has a smaller neighbour.
    """
    return edges.join(_least(edges), F.col("v") == F.col("c"), "left").select("u", F.coalesce("m", "v").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """edges: (u, v) with u > v. The result has the same form, distinct."""
    met = edges.join(_least(edges), F.col("u") == F.col("c"))
    return met.select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct()


def _numbered(pairs: DataFrame) -> DataFrame:
    """ref, id: the records that are linked, with numbers in the byte order of their refs.

    Sorted ranges keep their order in the number of the partition, so no rows
    need counting; the table is written, because the ranges are drawn anew
    whenever they are computed.
    """
    refs = pairs.select(F.explode(F.array("u", "v")).alias("ref")).distinct()
    ranged = refs.repartitionByRange("ref").sortWithinPartitions("ref")
    return written(ranged.select("ref", F.monotonically_increasing_id().alias("id")), "records")


def _rewritten(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The edges as a written table, and what tells them from others: count and two sums of hashes, taken while they are written."""
    h = F.xxhash64("u", "v")
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    df = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.pmod(h, F.lit(2**40))).alias("a"), F.sum(F.pmod(F.hash("v", "u").cast("bigint"), F.lit(2**31))).alias("b"))
    out = written(df, name)
    return out, tuple(sorted(seen.get.items()))


def components(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """record_ref, group_ref: one row for each record linked to another one.

    group_ref is the smallest record_ref of the group in byte order. Pairs with
    a null side and pairs of a record with itself link nothing; repeats and
    reversed pairs count once; an empty table gives an empty result. Extra
    columns of pairs are ignored.
    """
    a, b = F.col(left), F.col(right)
    named = pairs.select(F.greatest(a, b).cast("string").alias("u"), F.least(a, b).cast("string").alias("v")).where(a.isNotNull() & b.isNotNull()).where("u > v").distinct()
    named = written(named, "pairs")
    if named.isEmpty():
        return named.select(F.col("u").alias("record_ref"), F.col("v").alias("group_ref"))
    ids = _numbered(named)
    # the rounds carry two numbers an edge
    edges = named.join(ids.select(F.col("ref").alias("u"), F.col("id").alias("x")), "u").join(ids.select(F.col("ref").alias("v"), F.col("id").alias("y")), "v").select(F.col("x").alias("u"), F.col("y").alias("v"))
    edges, seen = _rewritten(edges, "edges")
    discard(named)
    while True:
        half = written(large_star(edges), "large")
        discard(edges)
        edges, now = _rewritten(small_star(half), "small")
        discard(half)
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("u").alias("id"), "v").unionByName(edges.select(F.col("v").alias("id"), "v").distinct())
    centre = ids.join(edges.select(F.col("v").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("v"), F.col("ref").alias("group_ref"))
    return stars.join(ids.withColumnRenamed("ref", "record_ref"), "id").join(centre, "v").select("record_ref", "group_ref")


def same_records(assertions: DataFrame) -> DataFrame:
    """Groups of the records that semantic_assertion states to be the same.

    A row links when its code is one of LINKS and both refs are given; codes
    and refs are compared in lower case without surrounding white space. State
    and authority play no part.
    """
    df = assertions.select(cleaned(F.col("predicate_code")).alias("p"), cleaned(F.col("subject_ref")).alias("s"), cleaned(F.col("object_ref")).alias("o"))
    df = df.where(F.col("p").isin(*[x.lower() for x in LINKS]) & (F.col("s") != "") & (F.col("o") != ""))
    return components(df, "s", "o")
