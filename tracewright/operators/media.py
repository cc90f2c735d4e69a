"""Timing operators over frames, spans, cues and cuts.

Sequences are put in islands with windows, overlaps are found with an equi-join
on time bins of several widths, and exact percentiles follow the index rule of a sorted list.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rms_frames(samples: Column, sample_rate: int, frame_s: float = 0.02) -> Column:
    """The root mean square of each frame of a sample array, without overlap."""
    n = max(1, round(frame_s * sample_rate))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(samples) / n).cast("int") - 1)), lambda i: F.slice(samples, i * n + 1, n))
    return F.when(F.size(samples) > 0, F.transform(cut, lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x) / F.size(w)))).otherwise(F.array().cast("array<double>"))


def floor_by_index(frames: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """key, floor: the value at index int(n * share) of each key's sorted values."""
    n = F.count("*")
    counts = frames.groupBy(key).agg(n.alias("n"))
    order = Window.partitionBy(key).orderBy(value)
    x = frames.select(key, value, (F.row_number().over(order) - 1).alias("i")).join(counts, key)
    at = F.greatest(F.lit(0), F.least(F.col("n") - 1, F.floor(F.col("n") * share)))
    return x.where(F.col("i") == at).select(key, F.col(value).alias("floor"))


def speech_islands(frames: DataFrame, key: str, idx: str, rms: str, hangover: int = 2, frame_s: float = 0.02, min_s: float = 0.05) -> DataFrame:
    """key, start_frame, end_frame (exclusive), peak: runs of frames over 2.5 times the low tenth, each lengthened by the hangover."""
    t = floor_by_index(frames, key, rms, 0.1).select(key, F.greatest(F.col("floor") * 2.5, F.lit(1e-4)).alias("threshold"))
    f = frames.join(t, key)
    last = F.last(F.when(F.col(rms) >= F.col("threshold"), F.col(idx)), ignorenulls=True).over(Window.partitionBy(key).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0))
    on = f.withColumn("_last", last).where(F.col(idx) - F.col("_last") <= hangover)
    isle = on.withColumn("_g", F.col(idx) - F.row_number().over(Window.partitionBy(key).orderBy(idx)))
    return isle.groupBy(key, "_g").agg(F.min(idx).alias("start_frame"), (F.max(idx) + 1).alias("end_frame"), F.max(rms).alias("peak")).where((F.col("end_frame") - F.col("start_frame")) * frame_s >= min_s).drop("_g")


def sound_islands(frames: DataFrame, key: str, idx: str, rms: str, gap: int = 2, frame_s: float = 0.02, min_music_s: float = 0.25) -> DataFrame:
    """key, start_frame, end_frame, kind: steady runs as music, short ones as transient, over the low quarter, joined over small gaps."""
    t = floor_by_index(frames, key, rms, 0.25).select(key, F.greatest(F.col("floor"), F.lit(1e-3)).alias("floor"))
    f = frames.join(t, key)
    on = f.where(F.col(rms) > F.col("floor"))
    w = Window.partitionBy(key).orderBy(idx)
    on = on.withColumn("_new", (F.col(idx) - F.lag(idx).over(w) - 1 > gap).cast("int")).withColumn("_g", F.sum(F.coalesce("_new", F.lit(0))).over(w))
    span = on.groupBy(key, "_g").agg(F.min(idx).alias("start_frame"), (F.max(idx) + 1).alias("end_frame"))
    inside = f.join(span, key).where((F.col(idx) >= F.col("start_frame")) & (F.col(idx) < F.col("end_frame")))
    x = inside.groupBy(key, "start_frame", "end_frame").agg(F.avg(rms).alias("mean"), F.stddev_pop(rms).alias("sd"), F.first("floor").alias("floor"))
    long_ = (F.col("end_frame") - F.col("start_frame")) * frame_s >= min_music_s
    kind = F.when(long_ & (F.col("sd") <= 0.5 * F.greatest("mean", "floor")), "music").when(~long_, "transient")
    return x.select(key, "start_frame", "end_frame", kind.alias("kind")).where("kind is not null")


def _level(start: Column, end: Column) -> Column:
    """The least n for which a bin of 4^n ms is as wide as the span."""
    return F.ceil(F.log2((end - start).cast("double")) / 2).cast("int")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, id, s, e, covered: how much of each left span the right spans cover, summed over these.

    Both: key, s, e in ms; left also id. Spans meet in an equi-join on (key,
    level, time bin). The bins of a level are 4^level ms wide; a span is in the
    at most two bins that it touches on its own level and on each higher one
    that occurs, so its length does not matter. A pair meets on the higher of
    its two levels and counts in the bin where its overlap starts.
    """
    a = left.select(key, "id", "s", "e").where("s < e").withColumn("_l", _level(F.col("s"), F.col("e")))
    b = right.select(key, F.col("s").alias("s2"), F.col("e").alias("e2")).where("s2 < e2").withColumn("_l2", _level(F.col("s2"), F.col("e2")))
    # at most 32 numbers
    there = sorted({r[0] for r in a.select("_l").distinct().collect()} | {r[0] for r in b.select("_l2").distinct().collect()})

    def bins(d: DataFrame, own: str, s: str, e: str) -> DataFrame:
        level = F.explode(F.filter(F.array(*[F.lit(n) for n in there]).cast("array<int>"), lambda n: n >= F.col(own)))
        d = d.withColumn("_at", level)
        wide = F.pow(F.lit(4.0), F.col("_at")).cast("bigint")
        return d.withColumn("_b", F.explode(F.array_distinct(F.array(F.floor(F.col(s) / wide), F.floor((F.col(e) - 1) / wide)))))

    x, y = bins(a, "_l", "s", "e"), bins(b, "_l2", "s2", "e2")
    lo, hi = F.greatest("s", "s2"), F.least("e", "e2")
    hit = x.join(y, [key, "_at", "_b"]).where((F.col("_at") == F.greatest("_l", "_l2")) & (lo < hi) & (F.floor(lo / F.pow(F.lit(4.0), F.col("_at")).cast("bigint")) == F.col("_b")))
    got = hit.groupBy(key, "id", "s", "e").agg(F.sum(hi - lo).alias("covered"))
    return left.select(key, "id", "s", "e").where("s < e").join(got, [key, "id", "s", "e"], "left").withColumn("covered", F.coalesce("covered", F.lit(0).cast("bigint")))


def hallucination_verdict(backing: Column, correlation: Column, low_words: Column, words: Column, threshold: float = 0.5) -> tuple[Column, Column]:
    """Outcome and trigger: no voice behind it, then no energy, then words of low confidence."""
    all_low = (low_words > 0) & (low_words >= words)
    outcome = F.when((backing < 0.5) | (correlation < threshold) | all_low, "filtered").otherwise("kept")
    trigger = F.when(backing < 0.5, "vad").when(correlation < threshold, "energy").when(low_words > 0, "logprob")
    return outcome, trigger


def error_rates(labelled: DataFrame, truth: str, guess: str) -> DataFrame:
    """fpr, fnr of boolean columns; 0 where there is nothing to get wrong."""
    n = lambda c: F.sum(c.cast("int"))
    t, g = F.col(truth), F.col(guess)
    return labelled.agg(
        F.round(F.when(n(~t) > 0, n(~t & g) / n(~t)).otherwise(F.lit(0.0)), 6).alias("fpr"),
        F.round(F.when(n(t) > 0, n(t & ~g) / n(t)).otherwise(F.lit(0.0)), 6).alias("fnr"),
    )


def scenes(cuts: DataFrame, key: str, cut_s: str, durations: DataFrame) -> DataFrame:
    """key, scene_index (from 0), start_s, end_s, start_pts: from each cut to the next, the first from 0, the last to the end.

    durations: key, duration_s.
    """
    all_cuts = cuts.select(key, F.col(cut_s).alias("start_s")).unionByName(durations.select(key, F.lit(0.0).alias("start_s"))).distinct().where("start_s >= 0")
    w = Window.partitionBy(key).orderBy("start_s")
    x = all_cuts.withColumn("next", F.lead("start_s").over(w)).withColumn("scene_index", F.row_number().over(w) - 1).join(durations.select(key, "duration_s"), key)
    return x.select(key, "scene_index", F.round("start_s", 4).alias("start_s"), F.round(F.coalesce("next", "duration_s"), 4).alias("end_s"), F.round(F.col("start_s") * 90_000).cast("bigint").alias("start_pts"))


def sampled_frames(items: DataFrame, key: str, idx: str, total: Column, max_frames: int) -> DataFrame:
    """Every step-th frame, step = max(1, total // max_frames), no more than max_frames a key."""
    step = F.greatest(F.lit(1), F.floor(total / max_frames))
    x = items.where(F.col(idx) % step == 0)
    return x.where(F.floor(F.col(idx) / step) < max_frames)


def shifted_cue(ms: Column, mpegts: Column, local_ms: Column) -> Column:
    """A cue's time after the stream's timestamp map, never below 0."""
    return F.greatest(F.lit(0).cast("bigint"), F.round(ms + mpegts / 90.0 - local_ms).cast("bigint"))


def hms_ms(c: Column) -> Column:
    """h:mm:ss.mmm or mm:ss.mmm to ms; null if it is neither."""
    p = r"^(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})$"
    g = lambda i: F.coalesce(F.nullif(F.regexp_extract(c, p, i), F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(c.rlike(p), g(1) * 3_600_000 + g(2) * 60_000 + g(3) * 1_000 + g(4))


def cue_flags(c: Column) -> dict[str, Column]:
    """is_song, is_sign, is_hi of a cue's text."""
    low = F.lower(c)
    any_of = lambda col, marks: F.greatest(*[F.contains(col, F.lit(m)) for m in marks])
    #: Marks in cue texts.
    song = any_of(c, ("♪", "♫", "♬", "[music", "[♪", "[song"))
    sign = any_of(low, ("[sign", "(sign", "sign language", "[visual", " [english]", "sings"))
    hi = song | sign | any_of(low, ("[", "]", "(sighs)", "(laughs)", "(music playing)", "(speaks in", "(telephone rings)", "(door opens)")) | low.rlike(r"\([a-z]+[a-z ]+\)")
    return {"is_song": song, "is_sign": sign, "is_hi": hi}


def nearest_tone(samples: DataFrame, key: str, idx: str, value: str, sample_rate: int, base_hz: float = 400.0, step_hz: float = 40.0, slots: int = 32, tolerance: float = 15.0) -> DataFrame:
    """key, frequency (zero crossings / (2 n / rate)), slot: the nearest tone within the tolerance, else null."""
    w = Window.partitionBy(key).orderBy(idx)
    cross = ((F.col(value) >= 0) != (F.lag(value).over(w) >= 0)).cast("int")
    f = samples.withColumn("_x", F.coalesce(cross, F.lit(0))).groupBy(key).agg((F.sum("_x") / (2 * F.count("*") / F.lit(float(sample_rate)))).alias("frequency"))
    slot = F.greatest(F.lit(0), F.least(F.lit(slots - 1), F.round((F.col("frequency") - base_hz) / step_hz))).cast("int")
    return f.withColumn("slot", F.when(F.abs(F.col("frequency") - (base_hz + slot * step_hz)) <= tolerance, slot))


def ink_regions(images: DataFrame, threshold: int = 128, min_area: int = 4) -> DataFrame:
    """id, x, y, w, h, reading_order: connected dark regions of raw images (id, width, height, content: one byte a pixel)."""

    def regions(width: int, height: int, content: bytes) -> list[tuple[int, int, int, int]]:
        a = np.frombuffer(content, dtype=np.uint8)[: width * height].reshape(height, width) < threshold
        seen, out = np.zeros_like(a), []
        for y, x in zip(*np.nonzero(a)):
            if seen[y, x]:
                continue
            stack, box, n = [(y, x)], [x, y, x, y], 0
            seen[y, x] = True
            while stack:
                j, i = stack.pop()
                n += 1
                box = [min(box[0], i), min(box[1], j), max(box[2], i), max(box[3], j)]
                for v, u in ((j - 1, i), (j + 1, i), (j, i - 1), (j, i + 1)):
                    if 0 <= v < height and 0 <= u < width and a[v, u] and not seen[v, u]:
                        seen[v, u] = True
                        stack.append((v, u))
            if n >= min_area:
                out.append((int(box[0]), int(box[1]), int(box[2] - box[0] + 1), int(box[3] - box[1] + 1)))
        return sorted(out, key=lambda b: (b[1], b[0]))

    def run(it):
        for pdf in it:
            rows = [(i, *r, k) for i, w, h, c in pdf[["id", "width", "height", "content"]].itertuples(index=False) for k, r in enumerate(regions(w, h, c))]
            yield pd.DataFrame(rows, columns=["id", "x", "y", "w", "h", "reading_order"])

    return images.mapInPandas(run, "id string, x int, y int, w int, h int, reading_order int")
