"""source:// locators: source://<id>/<modality>/<segment>@v<s.d.r>?frag=<selector>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the grammar of a locator.
PATTERN = r"^source://([^/@?]+)/([^/@?]+)/([^@?]+)(?:@v([0-9]+)\.([0-9]+)\.([0-9]+))?(?:\?frag=(.+))?$"
_PARTS = ("source_id", "modality", "segment", "segmenter", "decoder", "renderer", "frag")


def parse(c: Column) -> Column:
    """A struct of the parts (null where absent) and valid."""
    part = lambda i: F.nullif(F.regexp_extract(c, PATTERN, i), F.lit(""))
    cols = [(part(i + 1).cast("int") if n in ("segmenter", "decoder", "renderer") else part(i + 1)).alias(n) for i, n in enumerate(_PARTS)]
    return F.struct(*cols, F.coalesce(c.rlike(PATTERN), F.lit(False)).alias("valid"))


def build(source_id: Column, modality: Column, segment: Column, version: Column | None = None, frag: Column | None = None) -> Column:
    out = F.concat(F.lit("source://"), source_id, F.lit("/"), modality, F.lit("/"), segment)
    if version is not None:
        out = F.concat(out, F.coalesce(F.concat(F.lit("@v"), version), F.lit("")))
    if frag is not None:
        out = F.concat(out, F.coalesce(F.concat(F.lit("?frag="), frag), F.lit("")))
    return out
