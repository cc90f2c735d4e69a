"""Filling containers of fixed capacity with items of several sizes at once.

An item is a vector (tokens, segments, loss-bearing tokens) and a container has
a limit in each of them. Containers are filled one after the other; the next
item is the one that fits with the largest dot product of its sizes and the room
left (both as parts of the limits), so that an item is drawn to a container that
has room where the item needs it. For each number of tokens the loss sizes of the
items that are left are kept in order, so a choice looks at one candidate for
each number of tokens there is, whatever the number of items.

Items are spread by hash over groups of about `group_size`, which bounds what
one task holds, and every group is packed on its own. The containers that stay
emptier than `full` are opened again and their items packed together in larger
groups, so that only a last container or two is left with room, and not one of
every group.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import discard, written


def fill(sizes: np.ndarray, limits: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Container number and place in it, for each row of sizes (n x 3 integers: tokens, 1, loss <= tokens).

    Every row must fit an empty container. Rows are taken in their order among
    equals, so the result depends on nothing but the input; of equal products
    the item with more tokens goes first.
    """
    cap, segments, bear = (int(x) for x in limits)
    n = len(sizes)
    if n and (sizes > (cap, segments, bear)).any():
        raise ValueError("an item exceeds a limit")
    container, place = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int32)
    # for each number of tokens the loss sizes that items of it have, rising, with their rows
    rows: dict[tuple[int, int], list[int]] = {}
    for i in range(n - 1, -1, -1):
        rows.setdefault((int(sizes[i, 0]), int(sizes[i, 2])), []).append(i)
    tokens = np.array(sorted({k[0] for k in rows}, reverse=True), dtype=np.int64)
    losses: list[list[int]] = [[] for _ in tokens]
    at = {int(t): j for j, t in enumerate(tokens)}
    for t, b in sorted(rows):
        losses[at[t]].append(b)
    most = np.array([x[-1] for x in losses], dtype=np.int64)  # -1 once no item is left
    left, number = n, 0
    while left:
        room, room_l, k = cap, bear, 0
        while k < segments and room:
            first = int(np.searchsorted(-tokens, -room))
            x, y = room / cap / cap, room_l / bear / bear
            # what an item of so many tokens could add at most; exact unless its largest loss does not fit
            most_ = most[first:]
            score = np.where(most_ >= 0, tokens[first:] * x + np.minimum(most_, room_l) * y, -1.0)
            found = None
            while len(score):
                j = int(score.argmax())
                if score[j] < 0:
                    break
                own = losses[first + j]
                e = bisect_right(own, room_l) - 1
                exact = -1.0 if e < 0 else int(tokens[first + j]) * x + own[e] * y
                if exact >= score[j]:
                    found = (first + j, e)
                    break
                score[j] = exact
            if found is None:
                break
            j, e = found
            key = (int(tokens[j]), losses[j][e])
            i = rows[key].pop()
            container[i], place[i] = number, k
            k, left, room, room_l = k + 1, left - 1, room - key[0], room_l - key[1]
            if not rows[key]:
                losses[j].pop(e)
                most[j] = losses[j][-1] if losses[j] else -1
        number += 1
    return container, place


def pack(
    items: DataFrame,
    id_col: str,
    tokens: str,
    loss: str | None = None,
    limits: Sequence[int] = (2048, 1024, 2048),
    group_size: int = 20_000,
    full: float = 0.999,
) -> DataFrame:
    """container_id bigint, the id, piece int, start_token int, n_tokens int, place int.

    limits: tokens, segments (pieces), loss-bearing tokens of a container. An
    item that exceeds a limit of tokens or loss is split into pieces of the
    limit and a rest; the loss-bearing tokens are taken to be its last ones, as
    an answer follows its question. Without `loss` every token bears loss.
    Items of null or no tokens need no room and do not appear. Repeats of an
    item are items. Extra columns are ignored; an empty table gives no rows.
    """
    spark = items.sparkSession
    kind = dict(items.dtypes)[id_col]
    t, m = limits[0], min(limits[0], limits[2])
    size = F.col(tokens).cast("bigint")
    bears = F.least(F.greatest(F.col(loss).cast("bigint"), F.lit(0)), size) if loss else size
    step = F.when(bears > limits[2], m).otherwise(t)
    df = items.select(F.col(id_col).alias("i"), size.alias("n"), F.coalesce(bears, size).alias("b"), step.alias("step")).where("n > 0")
    df = df.select("i", "n", "b", "step", F.posexplode(F.expr("sequence(0, cast((n - 1) div step as int))")).alias("piece", "p_"))
    df = df.withColumn("at", F.col("piece") * F.col("step")).withColumn("n_", F.least("step", F.col("n") - F.col("at")))
    df = df.select(
        "i", "piece", F.col("at").cast("int").alias("at"), F.col("n_").cast("int").alias("n"),
        F.greatest(F.lit(0), F.col("at") + F.col("n_") - F.greatest("at", F.col("n") - F.col("b"))).cast("int").alias("loss"),
    )
    df = written(df, "items")
    schema = f"c bigint, i {kind}, piece int, at int, n int, loss int, place int, used double"

    def level(rows: DataFrame, number: int, per_group: int) -> DataFrame:
        groups = max(1, math.ceil(rows.count() / per_group))

        def run(key: tuple, table: pa.Table) -> pa.Table:
            table = table.sort_by([("n", "descending"), ("loss", "descending"), ("i", "ascending"), ("piece", "ascending")])
            n, b = table.column("n").to_numpy(), table.column("loss").to_numpy()
            sizes = np.stack([n, np.ones_like(n), b], axis=1).astype(np.int64)
            c, place = fill(sizes, limits)
            # how full a container is, by the limit that is nearest
            used = np.max([np.bincount(c, weights=w) / m for w, m in zip(sizes.T, limits)], axis=0) if len(c) else np.zeros(0)
            return pa.table({"c": (np.int64(number) << 56) + (np.int64(key[0].as_py()) << 32) + c, "i": table.column("i"), "piece": table.column("piece"), "at": table.column("at"), "n": table.column("n"), "loss": table.column("loss"), "place": pa.array(place), "used": used[c]})

        spread = rows.withColumn("g", F.pmod(F.xxhash64("i", "piece", "at"), F.lit(groups)).cast("int"))
        # few bytes are much work here: the number of tasks follows the groups, not the bytes
        return spread.repartition(groups, "g").groupBy("g").applyInArrow(run, schema)

    once = written(level(df, 0, group_size), "packed")
    discard(df)
    rest = once.where(F.col("used") < full).select("i", "piece", "at", "n", "loss")
    out = once.where(F.col("used") >= full).unionByName(level(rest, 1, 4 * group_size))
    return out.select(F.col("c").alias("container_id"), F.col("i").alias(id_col), "piece", F.col("at").alias("start_token"), F.col("n").alias("n_tokens"), "place")
