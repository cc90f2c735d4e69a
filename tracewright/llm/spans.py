"""Long spans that stand verbatim in more than one text.

Compact windows: the tokens of a text are its runs of `gram` code points (a third
of the span at most, see `gram_of`), each with a hash. In the Cartesian tree over
these hashes, the node of a token spans all subsequences in which it is the
minimum, so one row stands for all of them. Only nodes at least
`t = length - gram + 1` wide matter (about 2/t of the tokens); they are the runs
of equal positions in the sliding minimum over t tokens, which gives them without
the narrower rest of the tree.

A span of `length` code points that stands in two texts has the same minimum in
both, whatever the hash, so the windows that share it meet in a join on one
hash: for verbatim spans one is enough, and it misses none.

The spans are then checked. Windows whose whole stretch of text (the starts of
all its spans) is the same in two texts are shared as a whole. Of the others only
those whose minimum occurs in another text are looked into, start by start, and
only the texts that have such windows are read again. Texts are compared by two
hashes that are independent of each other, 96 bits together: among 10^12 spans
the chance of one false match is about 10^-5. Nothing is ever paired: for each
hash the smallest and the largest id tell whether a second text has it, and they
are aggregated before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import discard, written

#: Code points hashed at once; longer texts are cut into overlapping parts.
PART = 1 << 20
#: Ids of texts to be read again that are sent to all tasks (8 MB of numbers); more go through a shuffle.
SENT = 1_000_000

_U = np.uint64
_SEEDS = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))
_AT = _U(22)  # bits of a position beside the hash of its gram


def gram_of(length: int) -> int:
    """The largest power of two that is no more than a third of the span."""
    g = 1
    while g * 6 <= length:
        g *= 2
    return g


def _mixed(x: np.ndarray, m: int) -> np.ndarray:
    x = x * _U(m)
    x ^= x >> _U(32)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(29)
    return x


@lru_cache(maxsize=8)
def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    a = _SEEDS[seed][0]
    out = []
    for base in (a, pow(a, -1, 1 << 64)):
        x = np.full(n, base, dtype=np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


class _Hashes:
    """Hashes of any stretch of some code points, in constant time each."""

    def __init__(self, codes: np.ndarray, seed: int) -> None:
        self.m = _SEEDS[seed][1]
        n = 1 << max(10, int(len(codes) + 1).bit_length())
        up, self.down = _powers(seed, n)
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(_mixed(codes.astype(np.uint64) + _U(_SEEDS[seed][0]), self.m) * up[: len(codes)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64), self.m)

    def grams(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n] + _U(size), self.m)


def _parts(texts: list[str | None], length: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Joined code points of some texts, and (row, offset in the row, start, size) of each part."""
    codes, places, total = [], [], 0
    for row, text in enumerate(texts):
        if not text or len(text) < length:
            continue
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = 0
        while True:
            one = c[at : at + PART]
            if total and total + len(one) > PART:
                yield np.concatenate(codes), places
                codes, places, total = [], [], 0
            places.append((row, at, total, len(one)))
            codes.append(one)
            total += len(one)
            if at + PART >= len(c):
                break
            at += PART - length + 1
    if codes:
        yield np.concatenate(codes), places


def _leftmost_minimum(h: np.ndarray, t: int) -> np.ndarray:
    """Position of the leftmost minimum of every t neighbours, by doubling. Hash and position are one number, so that ties go to the left."""
    v, w = (h >> _AT << _AT) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * w <= t:
        v = np.minimum(v[:-w], v[w:])
        w *= 2
    if t > w:
        v = np.minimum(v[: len(v) - (t - w)], v[t - w :])
    return (v & _U((1 << int(_AT)) - 1)).astype(np.int64)


def compact_windows(texts: list[str | None], length: int) -> dict[str, np.ndarray]:
    """row, g (hash of the minimum), c1 and c2 (hash of the stretch, 96 bits), lo, hi (first and last start)."""
    gram = gram_of(length)
    t = length - gram + 1
    got: dict[str, list[np.ndarray]] = {k: [] for k in ("row", "g", "c1", "c2", "lo", "hi")}
    for codes, places in _parts(texts, length):
        one, two = _Hashes(codes, 0), _Hashes(codes, 1)
        h = one.grams(gram)
        p = _leftmost_minimum(h, t)  # p[s]: of the span that starts at s
        size = np.array([x[3] for x in places])
        begin = np.array([x[2] for x in places])
        count = size - length + 1
        part = np.repeat(np.arange(len(places)), count)
        s = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + begin[part]
        a = p[s]
        new = np.ones(len(s), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(s)) - 1
        lo, hi, a, part = s[first], s[last], a[first], part[first]
        end = hi + length
        c = [_mixed(x.of(lo, end) + (a - lo).astype(np.uint64), x.m) for x in (one, two)]
        gh = h[a]
        # a periodic stretch has a window at every start; neighbours with the same text are one row
        keep = np.ones(len(lo), dtype=bool)
        keep[1:] = (part[1:] != part[:-1]) | (gh[1:] != gh[:-1]) | (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])
        k = np.flatnonzero(keep)
        hi = hi[np.append(k[1:], len(lo)) - 1]
        row = np.array([x[0] for x in places])[part[k]]
        shift = np.array([x[1] - x[2] for x in places])[part[k]]
        for name, v in (("row", row), ("g", gh[k].view(np.int64)), ("c1", c[0][k].view(np.int64)), ("c2", c[1][k].view(np.int64) >> 32), ("lo", lo[k] + shift), ("hi", hi + shift)):
            got[name].append(v)
    return {k: np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for k, v in got.items()}


def span_hashes(text: str, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of text[s : s + length], of 64 and 32 bits, for each start."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    one, two = np.empty(len(starts), dtype=np.uint64), np.empty(len(starts), dtype=np.uint64)
    for at in range(0, len(codes), PART):
        sel = np.flatnonzero((starts >= at) & (starts < at + PART))
        if len(sel):
            part = codes[at : at + PART + length]
            for seed, out in ((0, one), (1, two)):
                out[sel] = _Hashes(part, seed).of(starts[sel] - at, starts[sel] - at + length)
    return one.view(np.int64), (two.view(np.int64) >> 32).astype(np.int32)


def shared_spans(docs: DataFrame, id_col: str, text_col: str, length: int = 200) -> DataFrame:
    """(id, lo, hi): every span of `length` code points that starts in [lo, hi] stands in another text too.

    ids must be unique; texts are compared whole and as they are. Null texts
    and texts shorter than `length` (1 to half of PART) share nothing, nor does a
    passage that repeats within one text only. Extra columns are ignored.
    """
    if not 1 <= length <= PART // 2:
        raise ValueError(f"length must be from 1 to {PART // 2}")
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.length("t") >= length)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = compact_windows(batch.column(1).to_pylist(), length)
            ids = batch.column(0).take(pa.array(w["row"]))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(w[k]) for k in ("g", "c1")), *(pa.array(w[k].astype(np.int32)) for k in ("c2", "lo", "hi"))], names=["i", "g", "c1", "c2", "lo", "hi"])

    w = written(base.mapInArrow(windows, f"i {kind}, g bigint, c1 bigint, c2 int, lo int, hi int"), "windows")
    met = w.groupBy("g").agg(F.min("i").alias("x"), F.max("i").alias("y")).where("x < y").select("g")
    cand = written(w.join(met, "g", "left_semi"), "met")
    discard(w)

    stretch = cand.groupBy("g", "c1", "c2").agg(F.min(F.struct("i", "lo", "hi")).alias("first"), F.max("i").alias("y"))
    stretch = stretch.select("g", "c1", "c2", "first", (F.col("first.i") < F.col("y")).alias("many"))
    whole = cand.join(stretch.where("many").select("g", "c1", "c2"), ["g", "c1", "c2"], "left_semi").select("i", "lo", "hi")

    # stretches of one text only, and one text of each other stretch they may share a part with
    open_ = stretch.where("not many").select("g").distinct()
    once = cand.join(stretch.where("not many").select("g", "c1", "c2"), ["g", "c1", "c2"], "left_semi").select("i", "lo", "hi", F.lit(False).alias("many"))
    others = stretch.where("many").join(open_, "g", "left_semi").select("first.i", "first.lo", "first.hi", F.lit(True).alias("many"))
    asked = written(once.unionByName(others).groupBy("i").agg(F.collect_list(F.struct("lo", "hi", "many")).alias("asked")), "asked")
    # texts that are not asked for are dropped where they are read, if the ids of the others are few enough to be sent there
    again = base.join(F.broadcast(asked.select("i")), "i", "left_semi") if asked.count() <= SENT else base

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, (text, asked) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for many in (False, True):
                    own = [np.arange(x["lo"], x["hi"] + 1) for x in asked if x["many"] == many]
                    if not own:
                        continue
                    starts = np.unique(np.concatenate(own))
                    one, two = span_hashes(text, starts, length)
                    ids = batch.column(0).take(pa.array(np.full(len(starts), n)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(starts.astype(np.int32)), pa.array(one), pa.array(two), pa.array(np.full(len(starts), many))], names=["i", "s", "h1", "h2", "many"])

    single = written(again.join(asked, "i").select("i", "t", "asked").mapInArrow(spans, f"i {kind}, s int, h1 bigint, h2 int, many boolean"), "spans")
    twice = single.groupBy("h1", "h2").agg(F.min("i").alias("x"), F.max("i").alias("y"), F.max("many").alias("m")).where("x < y or m").select("h1", "h2")
    part = single.where("not many").join(twice, ["h1", "h2"], "left_semi").select("i", F.col("s").alias("lo"), F.col("s").alias("hi"))
    out = written(whole.unionByName(part), "shared")
    discard(cand)
    discard(asked)
    discard(single)
    return out.select(F.col("i").alias(id_col), "lo", "hi")


def shared_chars(docs: DataFrame, id_col: str, text_col: str, length: int = 200) -> DataFrame:
    """(id, shared_chars int): code points of a text that lie in spans of at least `length` shared with another text.

    One row for each text that has any; see shared_spans.
    """
    s = shared_spans(docs, id_col, text_col, length).select(F.col(id_col).alias("i"), "lo", (F.col("hi") + length).alias("end"))
    s = s.groupBy("i", "lo").agg(F.max("end").alias("end"))
    upto = F.coalesce(F.max("end").over(Window.partitionBy("i").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("lo"), upto)))
    return s.groupBy("i").agg(F.sum("new").cast("int").alias("shared_chars")).select(F.col("i").alias(id_col), "shared_chars")
