"""Documents into chapters, paragraphs, sentences and tokens, and structural findings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import text as X


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, paragraph (from 1), text."""
    return docs.select(id_col, F.posexplode(X.paragraphs(F.col(text_col))).alias("n", "text")).select(id_col, (F.col("n") + 1).alias("paragraph"), "text")


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    p = paragraphs(docs, id_col, text_col)
    return p.select(id_col, "paragraph", F.posexplode(X.sentences(F.col("text"))).alias("n", "text")).select(id_col, "paragraph", (F.col("n") + 1).alias("sentence"), "text")


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    s = sentences(docs, id_col, text_col)
    return s.select(id_col, "paragraph", "sentence", F.posexplode(X.tokens(F.col("text"))).alias("n", "token")).select(id_col, "paragraph", "sentence", (F.col("n") + 1).alias("position"), "token")


def chapters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, chapter (from 1), title, lines (with text).

    A header opens a chapter only if there is text since the last one; else it
    is text itself. One pass over a document's lines.
    """
    opens = re.compile(X.CHAPTER)

    def split(text: str | None) -> list[tuple[str, int]]:
        out, title, n = [], "Chapter 1", 0
        for line in (text or "").split("\n"):
            if not line.strip():
                continue
            if n and opens.match(line):
                out.append((title, n))
                title, n = line.strip(), 0
            else:
                n += 1
        return out + [(title, n)] if n else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(row, k, *x) for row, text in enumerate(batch.column(1).to_pylist()) for k, x in enumerate(split(text), 1)]
            at, no, title, n = zip(*got) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(title, pa.string()), pa.array(n, pa.int32())], names=[id_col, "chapter", "title", "lines"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, chapter int, title string, lines int")


def mentions(par: DataFrame, keys: list[str]) -> DataFrame:
    """keys, run, times: capitalised runs that a paragraph has more than once."""
    # counted inside the row: the text is not copied for every run
    x = par.select(*keys, F.col("text").alias("t"))
    runs = F.array_distinct(F.regexp_extract_all("t", F.lit(X.CAPS), 0))
    counted = F.filter(F.transform(runs, lambda r: F.struct(r.alias("run"), X.occurrences(F.col("t"), r).alias("times"))), lambda c: c["times"] > 1)
    return x.select(*keys, F.explode(counted).alias("x")).select(*keys, "x.run", "x.times")


def cooccurrences(par: DataFrame, keys: list[str]) -> DataFrame:
    """keys, subject, object: the first two different capitalised runs of a paragraph."""
    runs = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(X.CAPS), 0))
    return par.select(*keys, runs.alias("r")).where("size(r) >= 2").select(*keys, F.col("r")[0].alias("subject"), F.col("r")[1].alias("object"))
