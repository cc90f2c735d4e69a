"""Text sources: decoding, plain text, Markdown, HTML and EPUB, and which is which."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DECODED = T.StructType().add("text", T.StringType()).add("charset", T.StringType()).add("confidence", T.DoubleType())
_BLOCK = T.StructType().add("kind", T.StringType()).add("text", T.StringType()).add("level", T.IntegerType()).add("src", T.StringType()).add("ordinal", T.IntegerType())
_BOMS = ((b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def decoded(raw: bytes | None) -> tuple[str | None, str | None, float]:
    """Text, charset and confidence: by mark, as UTF-8, as Windows-1252 without control codes, else byte by byte."""
    if raw is None:
        return None, None, 0.0
    for mark, name in _BOMS:
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace"), name, 1.0
    try:
        return raw.decode("utf-8"), "utf-8", 1.0
    except UnicodeDecodeError:
        pass
    try:
        text = raw.decode("cp1252")
        if not any(ord(c) < 32 and c not in "\t\n\r\f" or 127 <= ord(c) < 160 for c in text):
            return text, "cp1252", 0.7
    except UnicodeDecodeError:
        pass
    return raw.decode("latin-1"), "latin-1", 0.5


def line_feeds(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


@F.pandas_udf(_DECODED)
def decode_text(raw: pd.Series) -> pd.DataFrame:
    """Bytes to text with line feeds only."""
    got = [decoded(x) for x in raw]
    return pd.DataFrame({"text": [None if t is None else line_feeds(t) for t, _, _ in got], "charset": [c for _, c, _ in got], "confidence": [f for _, _, f in got]})


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha512, content of every file under a path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.col("length").alias("size"), F.sha2("content", 512).alias("sha512"), "content")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    f = read_files(spark, path)
    return f.select("path", "size", "sha512", decode_text("content").alias("d")).select("path", "size", "sha512", "d.*")


def new_sources(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose bytes are not known yet, one a digest."""
    return found.join(known.select("sha512").distinct(), "sha512", "left_anti").groupBy("sha512").agg(F.min("path").alias("path"), F.first("size").alias("size"), F.count("*").alias("copies"))


def markdown_blocks(text: str | None) -> list[dict]:
    """Headings, quotes, list items, images and paragraphs; fenced code as one empty block."""
    out: list[dict] = []
    run: list[str] = []

    def add(kind: str, text: str, level: int = 0, src: str | None = None) -> None:
        out.append({"kind": kind, "text": text, "level": level, "src": src, "ordinal": len(out) + 1})

    def flush() -> None:
        if run:
            add("paragraph", " ".join(run))
            run.clear()

    fence = None
    for line in line_feeds(text or "").split("\n"):
        s = line.strip()
        if fence:
            if s.startswith(fence):
                fence = None
            continue
        if s[:3] in ("```", "~~~"):
            flush()
            fence = s[:3]
            add("fenced", "<fenced>")
        elif m := re.match(r"^(#{1,6})\s+(.*?)\s*#*$", s):
            flush()
            add("heading", m[2], len(m[1]))
        elif m := re.match(r"^!\[([^\]]*)\]\(([^)\s]+)[^)]*\)$", s):
            flush()
            add("image", m[1], src=m[2])
        elif m := re.match(r"^>\s?(.*)$", s):
            flush()
            add("blockquote", m[1])
        elif m := re.match(r"^(?:[-*+]|\d+[.)])\s+(.*)$", s):
            flush()
            add("list_item", m[1])
        elif not s:
            flush()
        else:
            run.append(s)
    flush()
    return out


class _Blocks(HTMLParser):
    _TAGS = {"p": "paragraph", "li": "list_item", "blockquote": "blockquote", "pre": "fenced", "td": "cell", "th": "cell", "div": "paragraph"} | {f"h{i}": "heading" for i in range(1, 7)}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.now: list[str] = []
        self.kind, self.level, self.skip = "paragraph", 0, 0

    def flush(self) -> None:
        text = " ".join("".join(self.now).split())
        if text:
            self.out.append({"kind": self.kind, "text": text, "level": self.level, "src": None, "ordinal": len(self.out) + 1})
        self.now, self.kind, self.level = [], "paragraph", 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "img":
            a = dict(attrs)
            self.flush()
            self.out.append({"kind": "image", "text": a.get("alt") or "", "level": 0, "src": a.get("src"), "ordinal": len(self.out) + 1})
        elif tag == "br":
            self.now.append(" ")
        elif tag in self._TAGS:
            self.flush()
            self.kind = self._TAGS[tag]
            self.level = int(tag[1]) if self.kind == "heading" else 0

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in self._TAGS:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.now.append(data)


def html_blocks(text: str | None) -> list[dict]:
    """Blocks of an HTML page, without scripts and styles."""
    p = _Blocks()
    p.feed(text or "")
    p.close()
    p.flush()
    return p.out


def epub_blocks(raw: bytes | None) -> list[dict]:
    """Blocks of an EPUB in the order of its spine; nothing of what is no valid EPUB. level is the spine item."""
    out: list[dict] = []
    try:
        z = zipfile.ZipFile(io.BytesIO(raw or b""))
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e for e in box.iter() if e.tag.endswith("rootfile")).attrib["full-path"]
        root = ElementTree.fromstring(z.read(opf))
        items = {e.attrib["id"]: e.attrib["href"] for e in root.iter() if e.tag.endswith("}item")}
        for n, ref in enumerate((e for e in root.iter() if e.tag.endswith("}itemref")), 1):
            name = posixpath.normpath(posixpath.join(posixpath.dirname(opf), items[ref.attrib["idref"]]))
            for b in html_blocks(z.read(name).decode("utf-8", "replace")):
                out.append(b | {"src": f"{name}#{b['ordinal']}", "level": n, "ordinal": len(out) + 1})
    except (KeyError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError, OSError, RuntimeError):
        return []
    return out


def _blocks(f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(f)

    return F.pandas_udf(run, T.ArrayType(_BLOCK))


markdown = _blocks(markdown_blocks)
html = _blocks(html_blocks)
epub = _blocks(epub_blocks)

try:
    import pypdf  # noqa: F401

    HAS_PDF = True
except ImportError:
    HAS_PDF = False


def dispatch(files: DataFrame) -> DataFrame:
    """path, format, kind, text, level, src, ordinal, warnings: every file's blocks, by the format its name tells.

    An unknown format is read as plain text, with a warning; a file that can't
    be read gives no text of any kind, with a warning. PDF needs a library.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, raw in pdf[["path", "content"]].itertuples(index=False):
                ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
                fmt = {"md": "markdown", "markdown": "markdown", "htm": "html", "html": "html", "xhtml": "html", "epub": "epub", "pdf": "pdf", "txt": "txt", "text": "txt"}.get(ext, "unknown")
                warn: list[str] = []
                if fmt == "pdf":
                    blocks, warn = [], ["pdf: no library" if not HAS_PDF else "pdf: text layer only"]
                elif fmt == "epub":
                    blocks = epub_blocks(raw)
                    warn = [] if blocks else ["epub: unreadable"]
                else:
                    text = line_feeds(decoded(raw)[0] or "")
                    if fmt == "unknown":
                        warn, fmt = ["format unknown, read as text"], "txt"
                    parse = {"markdown": markdown_blocks, "html": html_blocks}.get(fmt)
                    blocks = parse(text) if parse else [{"kind": "paragraph", "text": b.strip(), "level": 0, "src": None, "ordinal": i} for i, b in enumerate((b for b in re.split(r"\n\s*\n", text) if b.strip()), 1)]
                for b in blocks or [{"kind": None, "text": None, "level": None, "src": None, "ordinal": 0}]:
                    rows.append((path, fmt, b["kind"], b["text"], b["level"], b["src"], b["ordinal"], warn))
            yield pd.DataFrame(rows, columns=["path", "format", "kind", "text", "level", "src", "ordinal", "warnings"])

    return files.mapInPandas(run, "path string, format string, kind string, text string, level int, src string, ordinal int, warnings array<string>")
