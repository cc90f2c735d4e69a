"""The typed query surface: a bounded query of one of ten kinds becomes one lazy plan.

Every filter is a column condition under the limit, so the engine prunes
columns, pushes conditions into the scan and pages over the sorted key. A scope
that a kind has no column for is an error and never left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.lineage import traverse

MAX_LIMIT, DEFAULT_LIMIT, MAX_DEPTH = 200, 20, 4
#: Predicates that speak, and segment types that are scenes.
UTTERANCES = ("SPEAKS", "SAYS", "UTTERANCE", "PRONUNCIATION")
SCENE_TYPES = ("scene", "chapter", "shot", "frame", "section", "act")


class ScopeUnmappableError(ValueError):
    """A scope was asked for that this kind of query can't apply."""


@dataclass(frozen=True)
class StructuredQuery:
    kind: str
    ref: str | None = None
    name: str | None = None
    alias: str | None = None
    predicate: str | None = None
    object_ref: str | None = None
    relationship_type: str | None = None
    scope: str | None = None
    speaker: str | None = None
    min_confidence: float | None = None
    locator: str | None = None
    source_id: str | None = None
    work_id: str | None = None
    continuity_id: str | None = None
    start: float | None = None
    end: float | None = None
    spatial: Mapping[str, object] = field(default_factory=dict)
    depth: int = MAX_DEPTH
    limit: int = DEFAULT_LIMIT
    offset: int = 0

    def bounded(self) -> tuple[int, int, int]:
        return max(1, min(self.limit, MAX_LIMIT)), max(0, self.offset), max(1, min(self.depth, MAX_DEPTH))


def spatial_contains(column: Column, wanted: Mapping[str, object]) -> Column:
    """Whether JSON text holds every leaf of `wanted`."""
    cond = F.lit(True)

    def leaves(prefix: str, value: object):
        if isinstance(value, Mapping):
            for k, v in value.items():
                yield from leaves(f"{prefix}.{k}", v)
        else:
            yield prefix, value

    for path, value in leaves("$", wanted):
        text = value if isinstance(value, str) else json.dumps(value)
        cond = cond & F.coalesce(F.get_json_object(column, path) == F.lit(text), F.lit(False))
    return cond


def overlaps(start: Column, end: Column, lo, hi) -> Column:
    """Spans that meet [lo, hi]; a null bound of the span meets nothing."""
    return (end >= F.lit(lo)) & (start <= F.lit(hi))


def tuple_scope(tuples: Column, **dims: str | None) -> Column:
    """One membership tuple must satisfy all dimensions at once."""
    wanted = {k: v for k, v in dims.items() if v is not None}
    if not wanted:
        return F.lit(True)

    def one(t: Column) -> Column:
        c = F.lit(True)
        for k, v in wanted.items():
            c = c & F.coalesce(t[k] == F.lit(v), F.lit(False))
        return c

    return F.exists(tuples, one)


def page(df: DataFrame, keys: list[str], limit: int, offset: int) -> DataFrame:
    return df.orderBy(*keys).offset(offset).limit(limit)


def page_with_total(df: DataFrame, keys: list[str], limit: int, offset: int) -> DataFrame:
    """A page, and in `total` how many rows there are on all pages."""
    total = df.agg(F.count("*").alias("total"))  # one row
    return page(df, keys, limit, offset).crossJoin(F.broadcast(total))


_SCOPES = {
    "ENTITY": {"work_id", "source_id", "continuity_id"}, "UTTERANCE": {"scope"}, "SCENE": {"source_id"}, "EVIDENCE": {"source_id"},
    "CORRESPONDENCE": {"continuity_id"}, "CONTRADICTIONS": {"scope"}, "UNRESOLVED_ALIASES": {"source_id", "work_id"}, "TRAVERSAL": {"scope"}, "RELATIONSHIP_EDGES": {"scope"},
}


def conditions(q: StructuredQuery, columns: list[str]) -> list[Column]:
    """The filters of a query as column conditions."""
    for s in ("source_id", "work_id", "continuity_id", "scope"):
        if getattr(q, s) is not None and s not in _SCOPES[q.kind]:
            raise ScopeUnmappableError(f"{q.kind} can't be restricted to {s}")
    c: list[Column] = []
    eq = {"ref": ("entity_ref", "subject"), "predicate": ("predicate",), "object_ref": ("object_ref",), "relationship_type": ("relationship_type",), "scope": ("scope",), "speaker": ("subject", "speaker_label"), "source_id": ("source_id",), "work_id": ("work_id",), "continuity_id": ("continuity_id",)}
    has_tuples = q.kind == "ENTITY" and "tuples" in columns
    for name, options in eq.items():
        v = getattr(q, name)
        if v is None or (has_tuples and name in ("source_id", "work_id", "continuity_id")):
            continue
        col = next((o for o in options if o in columns), None)
        if col is None:
            raise ScopeUnmappableError(f"{q.kind} has no {name}")
        c.append(F.col(col) == v)
    if has_tuples:
        c.append(tuple_scope(F.col("tuples"), source_id=q.source_id, work_id=q.work_id, continuity_id=q.continuity_id))
    if q.name is not None:
        c.append(F.contains(F.lower("display_label"), F.lit(q.name.lower())))
    if q.alias is not None:
        c.append(F.exists("aliases", lambda a: F.lower(a) == q.alias.lower()))
    if q.min_confidence is not None:
        c.append(F.col("confidence") >= q.min_confidence)
    if q.locator is not None:
        c.append(F.col("locator").rlike(f"(?i){q.locator}"))
    if q.start is not None and q.end is not None:
        c.append(overlaps(F.col("start_s"), F.col("end_s"), q.start, q.end))
    if q.spatial:
        c.append(spatial_contains(F.col("spatial"), q.spatial))
    return c


def structured(tables: Mapping[str, DataFrame], q: StructuredQuery, paged: bool = True) -> DataFrame:
    """The rows of a query. tables: state, edges, scenes, evidence, correspondences, mentions, resolved."""
    limit, offset, depth = q.bounded()
    kind = q.kind
    if kind == "TRAVERSAL":
        if q.ref is None:
            raise ValueError("a traversal needs a ref to start from")
        start = tables["edges"].sparkSession.createDataFrame([(q.ref,)], "ref string")
        got = traverse(tables["edges"], start, depth, limit=500)
        return page(got, ["distance", "ref", "predicate"], limit, offset) if paged else got
    base, keys = {
        "ENTITY": ("state", ["entity_ref"]), "UTTERANCE": ("edges", ["subject", "predicate", "object_ref"]), "SCENE": ("scenes", ["source_id", "id"]), "EVIDENCE": ("evidence", ["locator"]),
        "CORRESPONDENCE": ("correspondences", ["id"]), "CONTRADICTIONS": ("edges", ["subject", "predicate", "object_ref"]), "UNRESOLVED_ALIASES": ("mentions", ["mention_id"]), "RELATIONSHIP_EDGES": ("edges", ["subject", "predicate", "object_ref"]),
    }[kind]
    df = tables[base]
    for c in conditions(q, df.columns):
        df = df.where(c)
    if kind == "ENTITY":
        # one row a ref, the identity row before an older form
        df = df.where("object_ref is not null and coalesce(state, '') <> 'INVALIDATED'")
        pick = F.min_by(F.struct(*df.columns), F.struct((F.col("predicate") != "CANONICAL_IDENTITY").cast("int"), -F.coalesce("seq", F.lit(0))))
        df = df.where(F.col("predicate").isin("CANONICAL_IDENTITY", "CANONICAL_ENTITY")).groupBy("entity_ref").agg(pick.alias("x")).select("x.*")
    elif kind == "UTTERANCE":
        df = df.where(F.col("predicate").isin(*UTTERANCES)).withColumn("result_kind", F.when(F.col("authority") == "USER_OVERRIDE", "INTERPRETATION").otherwise("SOURCE_EVIDENCE"))
    elif kind == "CONTRADICTIONS":
        df = df.where("state = 'CONFLICTING'")
    elif kind == "UNRESOLVED_ALIASES":
        df = df.where("entity_id is null").join(tables["resolved"].select("mention_id").distinct(), "mention_id", "left_anti")
    return page(df, keys, limit, offset) if paged else df


# --- questions ------------------------------------------------------------

#: The forms of a question and the kind of query each asks for; the first that fits counts.
RULES = (
    (r"\bwhat\s+(?:did|does)\s+(?P<ref>.+?)\s+say\b|\bquotes?\s+(?:of|by)\s+(?P<ref2>.+?)\s*\??$", "UTTERANCE"),
    (r"\bwhat\s+(?P<predicate>emotion)\s+(?:does|did)\s+(?P<ref>.+?)\s+(?:feel|have)\b", "RELATIONSHIP_EDGES"),
    (r"\brelationships?\s+between\s+(?P<ref>.+?)\s+and\s+(?P<object>.+?)\s*\??$", "RELATIONSHIP_EDGES"),
    (r"\b(?:contradict\w*|conflict\w*)\b(?:.*?\b(?:about|for|on)\s+(?P<ref>.+?))?\s*\??$", "CONTRADICTIONS"),
    (r"\bunresolved\b|\bunknown\s+(?:names|aliases)\b", "UNRESOLVED_ALIASES"),
    (r"\b(?:evidence|sources?)\s+(?:for|of)\s+(?P<ref>.+?)\s*\??$", "EVIDENCE"),
    (r"\b(?:related|relationship|relation|connected)\b.*?\b(?:to|of|with)\s+(?P<ref>.+?)\s*\??$", "RELATIONSHIP_EDGES"),
    (r"^\s*who\s+(?:is|was)\s+(?P<ref>.+?)\s*\??$|^\s*tell\s+me\s+about\s+(?P<ref2>.+?)\s*\??$", "ENTITY"),
)


def compile_question(text: str) -> StructuredQuery | None:
    """The query that a question asks for; None if no rule fits. Nothing is guessed."""
    for pattern, kind in RULES:
        m = re.search(pattern, text.strip(), re.I)
        if not m:
            continue
        groups = m.groupdict()
        ref = (groups.get("ref") or groups.get("ref2") or "").strip(" \"'?.") or None
        if kind == "ENTITY":
            return StructuredQuery(kind, name=ref)
        if kind == "EVIDENCE":
            return StructuredQuery(kind, locator=re.escape(ref) if ref else None)
        if kind == "UNRESOLVED_ALIASES":
            return StructuredQuery(kind)
        other = (groups.get("object") or "").strip(" \"'?.") or None
        return StructuredQuery(kind, ref=ref, object_ref=other, predicate="HAS_EMOTION" if groups.get("predicate") else None)
    return None
