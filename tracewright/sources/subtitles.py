"""Subtitle documents into cues."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How each format starts, and the file endings that name it.
MARKERS = (("ass", "[Script Info]"), ("ass", "[V4+ Styles]"), ("webvtt", "WEBVTT"), ("ttml", "<tt"), ("sami", "<SAMI"))
ENDINGS = {"srt": "srt", "ass": "ass", "ssa": "ass", "vtt": "webvtt", "ttml": "ttml", "xml": "ttml", "smi": "sami", "sub": "microdvd", "mpl2": "mpl2", "tmp": "tmp"}


def detect_format(text: Column, hint: Column | None = None) -> Column:
    """The format by its marker, then its file ending, then the shape of its first cue; null if nothing tells."""
    s = F.regexp_replace(text, r"^[\s﻿]+", "")
    out = F.lit(None).cast("string")
    shape = (
        F.when(s.rlike(r"^\{\d+\}\{\d+\}"), "microdvd").when(s.rlike(r"^\d{1,2}:\d{2}:\d{2}:"), "tmp")
        .when(s.rlike(r"^\[\d+\]\[\d+\]"), "mpl2").when(s.rlike(r"^\d+[ \t]*(?:\r?\n|$)"), "srt")
    )
    out = shape
    if hint is not None:
        ext = F.lower(F.regexp_extract(hint, r"([A-Za-z0-9]+)$", 1))
        named = F.lit(None).cast("string")
        for e, f in ENDINGS.items():
            named = F.when(ext == e, f).otherwise(named)
        out = F.coalesce(named, shape)
    for f, mark in reversed(MARKERS):
        out = F.when(s.startswith(mark), f).otherwise(out)
    return out


def _ms(t: str) -> int | None:
    m = re.match(r"^\s*(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[.,](\d{1,3}))?", t)
    if not m:
        return None
    frac = (m[4] or "0").ljust(3, "0")
    return int(m[1] or 0) * 3_600_000 + int(m[2]) * 60_000 + int(m[3]) * 1_000 + int(frac)


def _plain(s: str) -> str:
    return " ".join(re.sub(r"<[^>]+>|\{\\[^}]*\}", "", s.replace("\\N", " ").replace("|", " ")).split())


def timestamp_map(text: str) -> int:
    """Milliseconds that a WebVTT timestamp map moves its cues."""
    m = re.search(r"X-TIMESTAMP-MAP=(.*)", text)
    if not m:
        return 0
    ticks, local = re.search(r"MPEGTS:(\d+)", m[1]), re.search(r"LOCAL:([\d:.]+)", m[1])
    return round((int(ticks[1]) if ticks else 0) / 90.0) - ((_ms(local[1]) or 0) if local else 0)


def cues(text: str | None, fmt: str | None, fps: float = 25.0) -> list[dict]:
    """Cues in order: index, start_ms, end_ms, text, style, speaker. A document that can't be read has none."""
    out: list[dict] = []
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")

    def add(a: int | None, b: int | None, s: str, style: str | None = None, speaker: str | None = None) -> None:
        if a is not None:
            out.append({"index": len(out), "start_ms": max(0, a), "end_ms": None if b is None else max(0, b), "text": _plain(s), "style": style, "speaker": speaker})

    if fmt in ("srt", "webvtt"):
        shift = timestamp_map(text) if fmt == "webvtt" else 0
        for block in re.split(r"\n\s*\n", text):
            lines = block.strip("\n").split("\n")
            at = next((i for i, x in enumerate(lines) if "-->" in x), None)
            if at is None:
                continue
            a, b = lines[at].split("-->", 1)
            body = "\n".join(lines[at + 1 :])
            voice = re.match(r"<v(?:\.\S+)?\s+([^>]+)>", body)
            s, e = _ms(a), _ms(b)
            add(None if s is None else s + shift, None if e is None else e + shift, body, speaker=voice[1] if voice else None)
    elif fmt == "microdvd":
        for m in re.finditer(r"^\{(\d+)\}\{(\d+)\}(.*)$", text, re.M):
            add(round(int(m[1]) * 1000 / fps), round(int(m[2]) * 1000 / fps), m[3])
    elif fmt == "mpl2":
        for m in re.finditer(r"^\[(\d+)\]\[(\d+)\](.*)$", text, re.M):
            add(int(m[1]) * 100, int(m[2]) * 100, m[3])
    elif fmt == "tmp":
        got = [(_ms(m[1]), m[2]) for m in re.finditer(r"^\s*(\d{1,2}:\d{2}:\d{2})[:=](.*)$", text, re.M)]
        for i, (a, s) in enumerate(got):
            add(a, got[i + 1][0] if i + 1 < len(got) else None, s)
    elif fmt == "ass":
        fields: list[str] = []
        for line in text.split("\n"):
            if line.startswith("Format:") and "Text" in line:
                fields = [x.strip() for x in line[7:].split(",")]
            elif line.startswith("Dialogue:") and fields:
                v = dict(zip(fields, (x.strip() for x in line[9:].split(",", len(fields) - 1))))
                add(_ms(v.get("Start", "")), _ms(v.get("End", "")), v.get("Text", ""), v.get("Style"), v.get("Name") or None)
    elif fmt == "ttml":
        try:
            for p in ElementTree.fromstring(text).iter():
                if p.tag.endswith("}p") or p.tag == "p":
                    add(_ms(p.attrib.get("begin", "")), _ms(p.attrib.get("end", "")), " ".join(p.itertext()), p.attrib.get("style"))
        except ElementTree.ParseError:
            return []
    elif fmt == "sami":
        got = [(int(m[1]), m[2]) for m in re.finditer(r"<SYNC\s+START\s*=\s*\"?(\d+)\"?[^>]*>(.*?)(?=<SYNC|</BODY|$)", text, re.I | re.S)]
        for i, (a, s) in enumerate(got):
            s = _plain(s.replace("&nbsp;", " "))
            if s:
                add(a, got[i + 1][0] if i + 1 < len(got) else None, s)
    return out


def parse(docs: DataFrame, id_col: str, text_col: str, hint_col: str | None = None, fps: float = 25.0) -> DataFrame:
    """id, format, index, start_ms, end_ms, text, style, speaker; one row without an index for a document of no known format."""
    kind = dict(docs.dtypes)[id_col]
    d = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), detect_format(F.col(text_col), F.col(hint_col) if hint_col else None).alias("f"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for i, t, f in pdf.itertuples(index=False):
                got = cues(t, f, fps)
                rows += [(i, f, c["index"], c["start_ms"], c["end_ms"], c["text"], c["style"], c["speaker"]) for c in got] or [(i, f, None, None, None, None, None, None)]
            out = pd.DataFrame(rows, columns=["i", "format", "index", "start_ms", "end_ms", "text", "style", "speaker"])
            for c in ("index", "start_ms", "end_ms"):
                out[c] = out[c].astype("Int64")
            yield out

    return d.mapInPandas(run, f"i {kind}, format string, index bigint, start_ms bigint, end_ms bigint, text string, style string, speaker string").withColumnRenamed("i", id_col)
