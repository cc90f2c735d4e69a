"""Blocking, scoring and probabilistic linkage of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as X


def block_pairs(records: DataFrame, keys: Column, ref: str = "ref") -> DataFrame:
    """left, right: records that share a key, each pair once. keys: an array column.

    Give it distinct records: copies of one record belong in its group, not in
    pairs of their own.
    """
    k = records.select(ref, F.explode(F.array_distinct(keys)).alias("_k")).where("_k is not null and _k <> ''")
    a, b = k.select(F.col(ref).alias("left"), "_k"), k.select(F.col(ref).alias("right"), "_k")
    return a.join(b, "_k").where("left < right").select("left", "right").distinct()


def link_score(name: Column, alias: Column, context: Column, same_type: Column, same_entity: Column, model: Column) -> Column:
    """The weighted sum of six signals."""
    return 0.55 * name + 0.15 * alias + 0.10 * context + 0.05 * same_type + 0.10 * same_entity + 0.05 * model


def candidates(scored: DataFrame, floor: float = 0.25, top: int = 20) -> DataFrame:
    """The best candidates of each left record: a report of the top, ties by right."""
    w = Window.partitionBy("left").orderBy(F.desc("score"), "right")
    return scored.where(F.col("score") >= floor).withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def agreements(pairs: DataFrame, records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """pairs with agree_<field>: equal and not null; a null on either side disagrees."""
    a = records.select(F.col("ref").alias("left"), *[F.col(f).alias(f"l_{f}") for f in fields])
    b = records.select(F.col("ref").alias("right"), *[F.col(f).alias(f"r_{f}") for f in fields])
    x = pairs.join(a, "left").join(b, "right")
    return x.select(*pairs.columns, *[F.coalesce(F.col(f"l_{f}") == F.col(f"r_{f}"), F.lit(False)).alias(f"agree_{f}") for f in fields])


def train(agreed: DataFrame, fields: Sequence[str], prior: float = 0.5) -> DataFrame:
    """field, m, u: how often a field agrees in matches and in others, smoothed. agreed has is_match."""
    n = F.sum(F.col("is_match").cast("bigint"))
    total = F.count("*")
    sums = agreed.agg(n.alias("n"), (total - n).alias("k"), *[F.sum((F.col(f"agree_{f}") & F.col("is_match")).cast("bigint")).alias(f"m_{f}") for f in fields], *[F.sum((F.col(f"agree_{f}") & ~F.col("is_match")).cast("bigint")).alias(f"u_{f}") for f in fields])
    return _model(sums, fields, prior)


def _model(sums: DataFrame, fields: Sequence[str], prior: float) -> DataFrame:
    """field, m, u from one row: n matches and k others, and of these m_<field> and u_<field> that agree."""
    p = prior * len(fields)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), ((F.col(f"m_{f}") + prior) / (F.col("n") + p)).alias("m"), ((F.col(f"u_{f}") + prior) / (F.col("k") + p)).alias("u")) for f in fields])
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def block_classes(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """fields, class: the least ref of the records that are the same in all the fields."""
    return records.groupBy(*fields).agg(F.min("ref").alias("class"))


def with_self(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """The pairs of values (column ref) that share a block, and each value with itself: records of one value share its blocks."""
    return pairs.unionByName(values.select(F.col("ref").alias("left"), F.col("ref").alias("right")))


def train_blocked(pairs: DataFrame, records: DataFrame, fields: Sequence[str], block: str, label: str, prior: float = 0.5) -> DataFrame:
    """field, m, u of all pairs of records whose values of the field `block` are one of the pairs (see with_self).

    A pair with equal label is a match. Pairs are counted, not made: two values
    with c1 and c2 records have c1 * c2 pairs, one with c has c (c - 1) / 2, and
    those equal in other columns are the same sums by these columns.
    """
    rest = [f for f in fields if f != block]
    facets = {"all": [], "label": [label]} | {x: c for f in rest for x, c in ((f"a_{f}", [f]), (f"b_{f}", [f, label]))}
    keys = F.array(*[F.struct(F.lit(x).alias("facet"), (F.to_json(F.struct(*c)) if c else F.lit("")).alias("key"), (F.array_compact(F.array(*[F.col(y).cast("string") for y in c])) if c else F.array().cast("array<string>")).alias("there"), F.lit(len(c)).alias("columns")) for x, c in facets.items()])
    # a null agrees with nothing
    n = records.select(F.col(block).alias("value"), F.explode(keys).alias("x")).where("size(x.there) = x.columns").groupBy("value", "x.facet", "x.key").agg(F.count("*").alias("c"))
    a, b = n.select(F.col("value").alias("left"), "facet", "key", F.col("c").alias("c1")), n.select(F.col("value").alias("right"), "facet", "key", F.col("c").alias("c2"))
    same = F.col("left") == F.col("right")
    met = pairs.join(a, "left").join(b, ["right", "facet", "key"]).select("facet", same.alias("same"), F.when(same, F.expr("c1 * (c1 - 1) div 2")).otherwise(F.col("c1") * F.col("c2")).alias("n"))
    total = lambda x, only=False: F.coalesce(F.sum(F.when((F.col("facet") == x) & (F.col("same") if only else F.lit(True)), F.col("n"))), F.lit(0))
    cols = [total("label").alias("n"), (total("all") - total("label")).alias("k")]
    for f in fields:
        both, agree = (total("label", True), total("all", True)) if f == block else (total(f"b_{f}"), total(f"a_{f}"))
        cols += [both.alias(f"m_{f}"), (agree - both).alias(f"u_{f}")]
    return _model(met.agg(*cols), fields, prior)


def predict_blocked(pairs: DataFrame, records: DataFrame, model: DataFrame, fields: Sequence[str], block: str, match: float = 5.0) -> DataFrame:
    """kind, left, right, weight, probability, decision for all pairs of records that share a block.

    link: two classes (see block_classes) by their least refs; what holds for
    them holds for each record of the one with each of the other. member: a
    class and each of its records, with what holds for any two of them.
    """
    known = records.where(F.col(block).isNotNull())
    classes = block_classes(known, fields)
    a = classes.select(F.col(block).alias("_l"), F.col("class").alias("c1"), *[F.col(f).alias(f"l_{f}") for f in fields])
    b = classes.select(F.col(block).alias("_r"), F.col("class").alias("c2"), *[F.col(f).alias(f"r_{f}") for f in fields])
    agree = [F.coalesce(F.col(f"l_{f}") == F.col(f"r_{f}"), F.lit(False)).alias(f"agree_{f}") for f in fields]
    met = pairs.join(a, F.col("left") == F.col("_l")).join(b, F.col("right") == F.col("_r")).where("_l <> _r or c1 < c2")
    links = met.select(F.least("c1", "c2").alias("left"), F.greatest("c1", "c2").alias("right"), *agree)
    on = F.lit(True)
    for f in fields:
        on = on & F.col(f"r.{f}").eqNullSafe(F.col(f"c.{f}"))
    members = known.alias("r").join(classes.alias("c"), on).select(F.col("c.class").alias("left"), F.col("r.ref").alias("right"), *[F.col(f"r.{f}").isNotNull().alias(f"agree_{f}") for f in fields])
    out = [predict(x, model, fields, match).select(F.lit(kind).alias("kind"), "*") for kind, x in (("link", links), ("member", members))]
    return out[0].unionByName(out[1])


def predict(agreed: DataFrame, model: DataFrame, fields: Sequence[str], match: float = 5.0, possible: float = 0.0, prior: float = 0.1) -> DataFrame:
    """left, right, weight, probability, decision. The model has one row a field."""
    wide = model.groupBy().agg(*[F.max(F.when(F.col("field") == f, F.col(c))).alias(f"{c}_{f}") for f in fields for c in ("m", "u")])
    x = agreed.crossJoin(F.broadcast(wide))
    w = sum((F.when(F.col(f"agree_{f}"), F.log(F.col(f"m_{f}") / F.col(f"u_{f}"))).otherwise(F.log((1 - F.col(f"m_{f}")) / (1 - F.col(f"u_{f}")))) for f in fields), F.lit(0.0))
    e = F.exp(F.least(F.col("weight"), F.lit(50.0)))
    return x.withColumn("weight", w).select(
        "left", "right", "weight", (prior * e / (prior * e + (1 - prior))).alias("probability"),
        F.when(F.col("weight") >= match, "MATCH").when(F.col("weight") >= possible, "POSSIBLE").otherwise("NON_MATCH").alias("decision"),
    )


def split_assign(candidates: DataFrame) -> DataFrame:
    """ref, target: the candidate of highest confidence; null (quarantined) if two share it. candidates: ref, target, confidence."""
    best = candidates.groupBy("ref").agg(F.max("confidence").alias("confidence"))
    top = candidates.join(best, ["ref", "confidence"]).groupBy("ref").agg(F.countDistinct("target").alias("n"), F.min("target").alias("t"))
    return top.select("ref", F.when(F.col("n") == 1, F.col("t")).alias("target"))


def promotion(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "CONFIRMED").when(confidence >= 0.5, "PROBABLE").otherwise("UNKNOWN")


#: Predicates that are registered as they are.
REGISTERED = (
    "SPEAKS", "PRESENT_IN", "CORRESPONDS_TO", "TRANSLATION_OF", "ADAPTATION_OF", "DERIVED_FROM", "CONTRADICTS", "ALIAS_OF", "EXPANDS", "OMITS", "REORDERS", "ALTERNATE_REALIZATION",
    "MENTIONED_IN", "UTTERED_IN", "HAS_TRAIT", "CO_OCCURS", "HAS_EMOTION", "IN_STATE", "HAS_CONTEXT", "STARTS_AT", "SIBLING_OF", "RELATED_TO",
)


def relationship_target(predicate: Column, rel_type: Column) -> tuple[Column, Column]:
    """Predicate and type under which a relationship is kept; a null predicate drops it."""
    p, t = F.upper(F.trim(predicate)), F.upper(F.trim(rel_type))
    ok = lambda c: F.coalesce(c.rlike("^[A-Z][A-Z0-9_]{0,63}$"), F.lit(False))
    t = F.when(ok(t), t)
    # a registered predicate stays as it is, without a type; another well-formed one becomes the type of a RELATED_TO
    target = (
        F.when(p == "RELATED_TO", F.when(t.isNotNull(), p)).when((p == "SIBLING_OF") & t.isNotNull() & (t != "SIBLING_OF"), F.lit(None))
        .when(p.isin(*REGISTERED), p).when(t.isNotNull() | ok(p), F.lit("RELATED_TO"))
    )
    kind = F.when(target == "RELATED_TO", F.coalesce(t, p))
    return target, kind


def reconcile(observations: DataFrame) -> DataFrame:
    """One assertion for each (predicate, subject, object, relationship type): the first in order, with its state.

    observations: ord, predicate_code, subject_ref, object_ref, relationship_type,
    confidence, conflicted. A conflicted subject makes CONFLICTING.
    """
    keys = ["predicate_code", "subject_ref", "object_ref", "relationship_type"]
    first = observations.groupBy(*keys).agg(F.min_by(F.struct("ord", "confidence"), F.struct("ord", F.coalesce(-F.col("confidence"), F.lit(1.0)))).alias("x"), F.count("*").alias("seen"))
    bad = observations.groupBy("subject_ref").agg(F.max(F.coalesce("conflicted", F.lit(False))).alias("bad"))
    x = first.join(bad, "subject_ref", "left")
    return x.select(*keys, F.col("x.ord").alias("ord"), F.when(F.coalesce("bad", F.lit(False)), "CONFLICTING").otherwise(promotion(F.coalesce(F.col("x.confidence"), F.lit(0.0)))).alias("state"), "seen")


def token_keys(name: Column) -> Column:
    """Block keys of a name: its words and its soundex."""
    return F.concat(F.transform(X.tokens(F.lower(name)), lambda t: F.concat(F.lit("t:"), t)), F.array(F.concat(F.lit("s:"), X.soundex(name))))
