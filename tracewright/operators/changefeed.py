"""Applying a feed of inserts, updates and deletes as a signed multiset.

Every change that counts adds its after-image with multiplicity +1 and the
before-image it takes away with -1; base rows are images with +1. The image a
change takes away is the last one of its row key (entity, predicate) at a lower
seq. A delete leaves a tombstone, an image like any other, so that a later
insert finds that there is nothing else to take away. Multiplicities are summed
and the rows with a positive sum, tombstones aside, are the state.

Before-images are looked up in stretches of `WIDTH` seqs of one row key, which
bounds what a window holds, however busy a key is. Within a stretch all images
but its last cancel where they are; the last ones, one row a stretch, are summed
in the same way over the stretches of a key. A delete of a whole entity takes
away what is left of its rows at lower seqs: the earlier images that it took away
are gone by then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SETS = ("SemanticAsserted", "OverrideApplied", "CorrectionApplied")
REMOVES = ("Invalidated",)
#: Seqs of one row key that one window holds at most.
WIDTH = 1 << 20
_OLDEST = -(2**63)
_KEY = ["entity", "predicate"]


def without_repeats(changes: DataFrame, key: str = "k", order: str = "seq") -> DataFrame:
    """Drops a change whose non-null key already occurs at a lower order.

    Only keys that occur at more than one order value are joined back, and a
    null key is never a key. Rows without a key are spread over all tasks.
    """
    again = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first_"), F.max(order).alias("last_")).where("first_ < last_").select(F.col(key).alias("key_"), "first_", F.lit(0).alias("salt_"))
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(order), F.lit(4096)).cast("int")).otherwise(0)
    return changes.join(again, (F.col(key) == F.col("key_")) & (salt == F.col("salt_")) & (F.col(order) > F.col("first_")), "left_anti")


def _summed(images: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """Sums the multiplicities of every image (+1) and of the one before it of the same keys (-1).

    Columns: keys, image, n. Everything happens under one partitioning by keys.
    """
    before = F.lag("image").over(Window.partitionBy(*keys).orderBy(order))
    signed = images.withColumn("before", before).select(
        *keys, F.explode(F.when(F.col("before").isNull(), F.array(F.struct("image", F.lit(1).alias("n")))).otherwise(F.array(F.struct("image", F.lit(1).alias("n")), F.struct(F.col("before").alias("image"), F.lit(-1).alias("n"))))).alias("x")
    )
    return signed.select(*keys, "x.image", "x.n").groupBy(*keys, "image").agg(F.sum("n").alias("n")).where("n > 0")


def apply_changes(
    base: DataFrame, changes: DataFrame, sets: Sequence[str] = SETS, removes: Sequence[str] = REMOVES, values: Sequence[str] = (), width: int = WIDTH
) -> DataFrame:
    """The state after the whole feed: entity, predicate, seq of what last set the row, and its values.

    base: entity, predicate, seq and the values. changes: kind, entity,
    predicate, seq, k (the idempotency key) and the values (columns of any type
    but maps). A change in `sets` inserts or replaces the row of its entity and
    predicate; one in `removes` deletes it, or every row of the entity if it has
    no predicate. The order is that of seq; a change leaves a row with a higher
    seq alone, and one whose non-null key occurs at a lower seq does nothing.
    Changes without a seq or an entity, and sets without a predicate, have no row
    to change and do nothing; base rows without a seq count as older than every
    change. Repeats count once; at the same seq a delete wins over a set, a set
    over a base row, and of two sets the one with the larger values stands.
    Empty tables give what the other one gives alone; columns that are not named
    here are ignored.
    """
    live = without_repeats(changes.select("kind", *_KEY, "seq", "k", *values).where("seq is not null"))
    live = live.where(F.col("entity").isNotNull() & F.col("kind").isin(*sets, *removes))
    is_set = F.col("kind").isin(*sets)
    row = F.struct(*values) if values else F.struct(F.lit(0).alias("_"))
    # rank: 0 base row, 1 set, 2 delete
    images = base.select(*_KEY, F.coalesce("seq", F.lit(_OLDEST)).alias("seq"), F.lit(0).alias("rank"), row.alias("row")).unionByName(
        live.where(F.col("predicate").isNotNull()).select(*_KEY, "seq", F.when(is_set, 1).otherwise(2).alias("rank"), F.when(is_set, row).alias("row"))
    )
    images = images.withColumn("stretch", F.floor(F.col("seq") / width))
    piece = [*_KEY, "stretch"]
    # one shuffle: what stands at one seq, the before-images and their sums need the same rows together
    one = images.repartition(*piece).groupBy(*piece, "seq").agg(F.max(F.struct("rank", "row")).alias("x"))
    one = one.select(*piece, F.struct("seq", "x.rank", "x.row").alias("image"))
    ends = _summed(one, piece, "image.seq")
    left = _summed(ends.select(*piece, "image").select(*_KEY, "image"), _KEY, "image.seq").where("image.rank < 2")
    gone = live.where(~is_set & F.col("predicate").isNull()).groupBy(F.col("entity").alias("gone_")).agg(F.max("seq").alias("at_"))
    signed = left.join(gone, F.col("entity") == F.col("gone_"), "left").withColumn("m", F.explode(F.when(F.col("at_") >= F.col("image.seq"), F.array(F.col("n"), -F.col("n"))).otherwise(F.array("n"))))
    state = signed.groupBy(*_KEY, "image").agg(F.sum("m").alias("n")).where("n > 0")
    seq = F.col("image.seq")
    return state.select(*_KEY, F.when(seq != _OLDEST, seq).alias("seq"), *[F.col(f"image.row.{v}").alias(v) for v in values])
