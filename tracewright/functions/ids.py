"""Deterministic identifiers."""

from __future__ import annotations

import base64
import hashlib
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

US = "\x1f"


def _normpath(path: Column) -> Column:
    return F.regexp_replace(F.lower(path), r"\s", "")


@F.pandas_udf(T.StringType())
def _base32_sha512(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else base64.b32encode(hashlib.sha512(x.encode()).digest()).decode().lower()[:43])


def segment_id(identity: Column, modality: Column, path: Column) -> Column:
    return _base32_sha512(F.concat_ws(US, identity, modality, _normpath(path)))


def deterministic_key(identity: Column, modality: Column, path: Column) -> Column:
    return F.concat_ws("#", identity, modality, _normpath(path))


def canonical_ref(tokens: Column) -> Column:
    return F.concat(F.lit("entity:canonical:"), F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(tokens)), US), 256), 1, 16))


def mention_id(source: Column, locator: Column, segment: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(US, source, locator, segment, text), 256), 1, 32)


def fallback_ref(kind: Column, source: Column, value: Column) -> Column:
    return F.concat_ws(":", kind, source, F.substring(F.sha2(value, 256), 1, 12))


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """A name-based UUID, version 5, from SHA-1 with native functions only."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4).substr(F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def dashed_uuid(c: Column) -> Column:
    """32 hex digits with dashes; anything else as it is."""
    return F.when(c.rlike("^[0-9a-fA-F]{32}$"), F.lower(F.regexp_replace(c, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))).otherwise(c)
