"""WAV and archives from bytes; probe reports of media files."""

from __future__ import annotations

import io
import tarfile
import wave
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the stream fields of a probe report.
PROBE = "streams array<struct<index:int,codec_type:string,codec_name:string,r_frame_rate:string,duration:string,tags:map<string,string>>>"
BITMAP_SUBTITLES = ("dvd_subtitle", "dvb_subtitle", "hdmv_pgs_subtitle", "xsub")


def read_wav(files: DataFrame) -> DataFrame:
    """path, sample_rate, samples (mono, -1 to 1) of 8 or 16 bit PCM; error for what is none."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for path, raw in pdf[["path", "content"]].itertuples(index=False):
                try:
                    with wave.open(io.BytesIO(raw)) as w:
                        data, n = w.readframes(w.getnframes()), w.getnchannels()
                        x = np.frombuffer(data, dtype="<i2") / 32768.0 if w.getsampwidth() == 2 else (np.frombuffer(data, dtype=np.uint8) - 128.0) / 128.0
                        rows.append((path, w.getframerate(), x.reshape(-1, n).mean(axis=1).tolist(), None))
                except (wave.Error, EOFError, ValueError) as e:
                    rows.append((path, None, None, str(e) or "unreadable"))
            out = pd.DataFrame(rows, columns=["path", "sample_rate", "samples", "error"])
            out["sample_rate"] = out["sample_rate"].astype("Int64")
            yield out

    return files.mapInPandas(run, "path string, sample_rate int, samples array<double>, error string")


def list_archives(files: DataFrame, max_entries: int = 10_000, max_bytes: int = 1 << 30) -> DataFrame:
    """path, member, size, reason: members of zip and tar files, and why an archive is refused.

    Links, absolute and climbing paths, too many members and too large contents
    refuse the archive as a whole; nothing is extracted.
    """

    def members(raw: bytes) -> list[tuple[str, int, str | None]]:
        b = io.BytesIO(raw)
        if zipfile.is_zipfile(b):
            return [(i.filename, i.file_size, "link" if (i.external_attr >> 28) == 0xA else None) for i in zipfile.ZipFile(b).infolist()]
        b.seek(0)
        with tarfile.open(fileobj=b) as t:
            return [(m.name, m.size, "link" if m.issym() or m.islnk() else None) for m in t.getmembers()]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for path, raw in pdf[["path", "content"]].itertuples(index=False):
                try:
                    got = members(raw)
                except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError):
                    rows.append((path, None, None, "malformed"))
                    continue
                why = next((r for _, _, r in got if r), None)
                if any(n.startswith(("/", "\\")) or ".." in n.replace("\\", "/").split("/") or n[1:2] == ":" for n, _, _ in got):
                    why = "path"
                elif len(got) > max_entries:
                    why = "entries"
                elif sum(s for _, s, _ in got) > max_bytes:
                    why = "size"
                rows += [(path, None, None, why)] if why else [(path, n, s, None) for n, s, _ in got]
            out = pd.DataFrame(rows, columns=["path", "member", "size", "reason"])
            out["size"] = out["size"].astype("Int64")
            yield out

    return files.mapInPandas(run, "path string, member string, size bigint, reason string")


def tracks(probes: DataFrame) -> DataFrame:
    """path, and each stream of a probe report (JSON text in column report): index, type, codec, fps, language, is_bitmap."""
    x = probes.select("path", F.explode(F.from_json("report", PROBE)["streams"]).alias("s"))
    num, den = F.split("s.r_frame_rate", "/")[0].cast("double"), F.get(F.split("s.r_frame_rate", "/"), F.lit(1)).cast("double")
    return x.select(
        "path", F.col("s.index").alias("index"), F.col("s.codec_type").alias("type"), F.col("s.codec_name").alias("codec"),
        F.when(F.coalesce(den, F.lit(1.0)) == 0, 0.0).otherwise(num / F.coalesce(den, F.lit(1.0))).alias("fps"),
        F.try_element_at("s.tags", F.lit("language")).alias("language"), F.col("s.codec_name").isin(*BITMAP_SUBTITLES).alias("is_bitmap"),
    )


def fixity(objects: DataFrame) -> DataFrame:
    """Adds intact: whether content has the sha512 that names it."""
    return objects.withColumn("intact", F.sha2("content", 512) == F.lower("sha512"))


def byte_range(objects: DataFrame, start: int, end: int, most: int = 1 << 20) -> DataFrame:
    """The bytes [start, end) of each content, no more than `most`."""
    n = max(0, min(end - start, most))
    return objects.withColumn("range", F.substring("content", start + 1, n))
