"""Continuous periods and gaps of time intervals, per entity.

The aggregate is a sorted list of disjoint intervals, kept for a piece of time of
one entity: the spans that start in it. Lists are mergeable (`unite`), so the
reduction is a tree:

1. every task unites the spans it reads into one list for each (entity, piece),
   before anything is shuffled; repeats and spans within spans end here;
2. lists of one (entity, piece) are shuffled together and united again, in two
   levels if many tasks have read the input. A list holds at most one interval
   for every two milliseconds of its piece, however many spans went into it;
3. the pieces of one entity differ only in what reaches over their borders. That
   is one number each, the end of the furthest interval, and its running maximum
   over the earlier pieces is all that a list needs to be final.

The final lists give the periods, and their complements the gaps. An entity with
a third of all spans is as many pieces as its time is long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.session import discard, written

#: Milliseconds of a piece: some 70 minutes.
PIECE = 1 << 22
#: Lists of so many tasks are united at once.
FAN_IN = 64
#: Rows that a task holds before it unites them.
HELD = 1 << 18


def millis(seconds: Column) -> Column:
    """Seconds to the nearest millisecond; NaN and infinite values give null."""
    s = seconds.cast("double")
    ok = s.isNotNull() & ~F.isnan(s) & (F.abs(s) < F.lit(9.0e15))
    return F.when(ok, F.round(s * 1000.0).cast("bigint"))


def unite(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The disjoint intervals that cover the same times, sorted, for each group. Intervals that touch are one.

    Intervals come as sorted runs (lists) or single; the stable sort merges runs
    two by two, each pair in linear time, and one sweep closes the result.
    """
    order = np.lexsort((start, group))
    g, s, e = group[order], start[order], end[order]
    if not len(g):
        return g, s, e
    # the running maximum of the ends within a group, over ranks, which cannot overflow
    ends = np.unique(e)
    rank = np.searchsorted(ends, e)
    place = np.cumsum(np.append(False, g[1:] != g[:-1]))
    reach = np.maximum.accumulate(place * len(ends) + rank)
    upto = ends[reach - place * len(ends)]
    opens = np.ones(len(g), dtype=bool)
    opens[1:] = (g[1:] != g[:-1]) | (s[1:] > upto[:-1])
    at = np.flatnonzero(opens)
    return g[at], s[at], upto[np.append(at[1:], len(g)) - 1]


def _groups(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's values, nulls included, and the first row of each number."""
    n = len(columns[0])
    code = np.zeros(n, dtype=np.int64)
    for c in columns:
        d = c.dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    first = np.unique(code, return_index=True)[1]
    return code, first


def _lists(table: pa.Table, keys: int, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> pa.Table:
    """One row for each different value of the first `keys` columns: these, and the united list of its intervals."""
    group, first = _groups([table.column(k).combine_chunks() for k in range(keys)])
    g, s, e = unite(group[row], start, end)
    counts = np.bincount(g, minlength=len(first))
    offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    head = [table.column(k).take(pa.array(first)) for k in range(keys)]
    return pa.table([*head, pa.ListArray.from_arrays(offsets, pa.array(s)), pa.ListArray.from_arrays(offsets, pa.array(e))], names=[*table.column_names[:keys], "starts", "ends"])


def _as(lists: pa.Table, schema: pa.Schema) -> pa.Table:
    """The same rows under a schema that differs only in nullability and the names of list elements."""
    return pa.table([c.cast(f.type) for c, f in zip(lists.columns, schema)], schema=schema)


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = (table.column(c).combine_chunks() for c in ("starts", "ends"))
    return a.flatten().to_numpy(zero_copy_only=False), b.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(a)), a.value_lengths().to_numpy(zero_copy_only=False))


def _schema(df: DataFrame, columns: list[str], more: str) -> T.StructType:
    return T.StructType([df.schema[c] for c in columns] + T._parse_datatype_string(more).fields)


_LISTS = "starts array<bigint>, ends array<bigint>"


def _partial(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The lists of what one task reads: keys, starts, ends. spans: keys, s, e."""
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def give() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            s, e = (t.column(c).to_numpy() for c in ("s", "e"))
            yield from _lists(t, n, s, e, np.arange(len(s))).to_batches()

        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) >= HELD:
                yield from give()
        if held:
            yield from give()

    return spans.mapInArrow(run, _schema(spans, keys, _LISTS))


def _merged(lists: DataFrame, keys: list[str]) -> DataFrame:
    """One list for each value of keys. lists: keys, starts, ends."""
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by keys: only the last list of a batch may go on in the next one
        open_: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch])
            # batches name and type their columns as Spark does; the last list goes on as one of them
            t = t if open_ is None else pa.concat_tables([_as(open_, t.schema), t]).combine_chunks()
            t = _lists(t, n, *_flat(t))
            yield from t.slice(0, len(t) - 1).to_batches()
            open_ = t.slice(len(t) - 1)
        if open_ is not None:
            yield from open_.to_batches()

    return lists.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _schema(lists, keys, _LISTS))


def interval_lists(spans: DataFrame, keys: list[str], piece_ms: int = PIECE) -> DataFrame:
    """keys, piece, starts, ends: the sorted disjoint list of the spans that start in each piece of time.

    spans: keys, s, e (bigint, s < e).
    """
    tasks = spans.rdd.getNumPartitions()
    df = spans.withColumn("piece", F.floor(F.col("s") / piece_ms)).select(*keys, "piece", F.floor(F.spark_partition_id() / FAN_IN).alias("branch"), "s", "e")
    lists = _partial(df, [*keys, "piece", "branch"])
    if tasks > FAN_IN:
        lists = _merged(lists, [*keys, "piece", "branch"])
    return _merged(lists.drop("branch"), [*keys, "piece"])


def _final(lists: DataFrame, keys: list[str]) -> DataFrame:
    """keys, piece, s, before, e, first_before: the intervals that earlier pieces do not reach. e is null for the last one of a piece."""
    n = len(keys) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            s, e, row = _flat(t)
            upto = t.column("upto").combine_chunks()
            there, reach = upto.is_valid().to_numpy(zero_copy_only=False)[row], upto.fill_null(0).to_numpy(zero_copy_only=False)[row]
            same = np.append(False, row[1:] == row[:-1]) if len(row) else np.zeros(0, dtype=bool)
            last = np.append(0, e[:-1]) if len(row) else e
            before = np.where(same & there, np.maximum(last, reach), np.where(same, last, reach))
            known = same | there
            keep = np.flatnonzero(~there | (s > reach))
            r = row[keep]
            end = np.append(r[1:] != r[:-1], True) if len(r) else np.zeros(0, dtype=bool)
            nxt = np.append(before[keep][1:], 0) if len(r) else r
            first = keep[np.searchsorted(r, r)] if len(r) else keep
            take = pa.array(r)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(take) for k in range(n)), pa.array(s[keep]), pa.array(before[keep], mask=~known[keep]), pa.array(nxt, pa.int64(), mask=end), pa.array(before[first], mask=~known[first])],
                names=[*batch.schema.names[:n], "s", "before", "e", "first_before"],
            )

    return lists.select(*keys, "piece", "starts", "ends", "upto").mapInArrow(run, _schema(lists, [*keys, "piece"], "s bigint, before bigint, e bigint, first_before bigint"))


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, piece_ms: int = PIECE) -> DataFrame:
    """Columns: the keys, span_kind ('period' or 'gap'), start_ms, end_ms (bigint).

    Spans that overlap or touch are one period; a gap lies between two
    neighbouring periods of one entity. Null keys are a value like any other.
    A row with a null bound, or an end that is not after its start, takes no
    part; an entity with no other rows does not appear. Repeats count once, an
    empty table gives an empty result, and all other columns of df are ignored.
    """
    k = [f"k{i}" for i in range(len(keys))]
    spans = df.select(*[F.col(c).alias(a) for c, a in zip(keys, k)], F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")).where("s < e")
    # read twice below
    lists = written(interval_lists(spans, k, piece_ms), "lists")
    order = Window.partitionBy(*k).orderBy("piece")
    reach = lists.select(*k, "piece", F.element_at("ends", -1).alias("reach"))
    reach = reach.withColumn("upto", F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("hull", F.max("reach").over(Window.partitionBy(*k)))
    on = F.col("l.piece") == F.col("r.piece")
    for c in k:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    met = lists.alias("l").join(reach.alias("r"), on).select(*[f"l.{c}" for c in k], "l.piece", "starts", "ends", "upto", "hull")
    met = written(met, "reached")
    discard(lists)
    final = written(_final(met, k), "periods")
    # the last period of a piece ends where the next one of the entity has its gap before it, or nothing follows
    hulls = met.select(*k, "piece", "hull")
    same = F.col("o.piece") == F.col("h.piece")
    for c in k:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"h.{c}"))
    last = final.where("e is null").alias("o").join(hulls.alias("h"), same).select(*[f"o.{c}" for c in k], "o.piece", "s", "before", "first_before", "hull")
    last = last.withColumn("e", F.coalesce(F.lead("first_before").over(order), "hull"))
    periods = final.where("e is not null").select(*k, "s", "before", "e").unionByName(last.select(*k, "s", "before", "e"))
    period = F.struct(F.lit("period").alias("span_kind"), F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))
    gap = F.struct(F.lit("gap").alias("span_kind"), F.col("before").alias("start_ms"), F.col("s").alias("end_ms"))
    both = F.when(F.col("before").isNull(), F.array(period)).otherwise(F.array(period, gap))
    out = periods.select(*k, F.explode(both).alias("x"))
    return out.select(*[F.col(a).alias(c) for a, c in zip(k, keys)], "x.span_kind", "x.start_ms", "x.end_ms")
