"""Linkage, alignment, media, search, surface, lineage and publishing on small inputs."""

import base64
import hashlib
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import ids, locators
from tracewright.functions import text as X
from tracewright.operators import alignment, audit, linkage, lineage, media, publish
from tracewright.plans.structured import ScopeUnmappableError, StructuredQuery, compile_question, spatial_contains, structured, tuple_scope


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_identifiers(spark):
    assert one(spark, ids.uuid5(F.lit("1:é"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "1:é"))
    want = base64.b32encode(hashlib.sha512("s\x1ftext\x1fchapter/1".encode()).digest()).decode().lower()[:43]
    assert one(spark, ids.segment_id(F.lit("s"), F.lit("text"), F.lit("Chapter /1"))) == want
    assert one(spark, ids.dashed_uuid(F.lit("0" * 32))) == "00000000-0000-0000-0000-000000000000"
    assert one(spark, ids.dashed_uuid(F.lit("no"))) == "no"


def test_locators(spark):
    p = one(spark, locators.parse(F.lit("source://s1/text/chapter/1/p2@v1.2.3?frag=char=1,5")))
    assert (p.source_id, p.modality, p.segment, p.segmenter, p.renderer, p.frag, p.valid) == ("s1", "text", "chapter/1/p2", 1, 3, "char=1,5", True)
    assert not one(spark, locators.parse(F.lit("source://s1/text"))).valid
    assert one(spark, locators.build(F.lit("a"), F.lit("text"), F.lit("p1"), F.lit("1.0.0"))) == "source://a/text/p1@v1.0.0"


def test_text_functions(spark):
    assert one(spark, X.soundex(F.lit("Pfister"))) == "p123" and one(spark, X.soundex(F.lit("Tatat"))) == "t300"
    assert one(spark, X.sentences(F.lit("One. Two!\nThree"))) == ["One.", "Two!", "Three"]
    assert one(spark, X.candidate_speaker(F.lit('Then Alice said, "Go."'))) == "Alice"
    assert one(spark, X.normalize_name(F.lit("  ＡＢ  c "))) == "ab c"
    assert one(spark, X.transliteration_key(F.lit("Éa"))) == "ea"
    v = one(spark, X.embed_text(F.lit("a b c")))
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and one(spark, X.embed_text(F.lit(""))) == [0.0] * 64


def test_linkage(spark):
    rec = spark.createDataFrame([("r1", "a", "x"), ("r2", "a", "x"), ("r3", "b", None)], "ref string, f string, g string")
    lab = spark.createDataFrame([("r1", "r2", True), ("r1", "r3", False)], "left string, right string, is_match boolean")
    ag = linkage.agreements(lab, rec, ["f", "g"])
    m = {r.field: (r.m, r.u) for r in linkage.train(ag, ["f", "g"]).collect()}
    assert m["f"] == pytest.approx((1.5 / 2, 0.5 / 2))
    got = {(r.left, r.right): r.decision for r in linkage.predict(ag, linkage.train(ag, ["f", "g"]), ["f", "g"], match=2.0).collect()}
    assert got == {("r1", "r2"): "MATCH", ("r1", "r3"): "NON_MATCH"}


def test_dtw_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        d = rng.integers(0, 9, (rng.integers(1, 6), rng.integers(1, 6))).astype(float)
        path = alignment.dtw_path(d)

        def best(i, j):
            if i == 0 and j == 0:
                return d[0, 0]
            return d[i, j] + min(best(a, b) for a, b in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if a >= 0 and b >= 0)

        assert sum(d[i, j] for i, j in path) == pytest.approx(best(d.shape[0] - 1, d.shape[1] - 1))
        assert path[-1] == (d.shape[0] - 1, d.shape[1] - 1)


def test_reordered(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1), (3, 1, 1), (3, 2, 1)], "k int, a int, b int")
    assert {r.k: r.reordered for r in alignment.reordered(df, ["k"], "a", "b").collect()} == {1: False, 2: True, 3: True}


def test_overlap_counts_each_pair_once(spark):
    a = spark.createDataFrame([("k", 1, 0, 200_000), ("k", 2, 5, 6), ("n", 3, 0, 9)], "key string, id int, s bigint, e bigint")
    b = spark.createDataFrame([("k", 10, 130_000), ("k", 150_000, 150_010)], "key string, s bigint, e bigint")
    assert {r.id: r.covered for r in media.overlap(a, b, "key").collect()} == {1: 130_000, 2: 0, 3: 0}


def test_speech_and_flags(spark):
    rms = [0.01] * 20 + [1.0] * 5 + [0.01] * 10 + [1.0] + [0.01] * 20
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate(rms)], "m string, i int, v double")
    assert [(r.start_frame, r.end_frame) for r in media.speech_islands(df, "m", "i", "v").orderBy("start_frame").collect()] == [(20, 27), (35, 38)]
    f = media.cue_flags(F.lit("[music] la"))
    assert one(spark, f["is_song"]) and one(spark, f["is_hi"]) and not one(spark, f["is_sign"])
    assert one(spark, media.hms_ms(F.lit("01:02:03.004"))) == 3723004 and one(spark, media.hms_ms(F.lit("x"))) is None
    assert one(spark, media.rms_frames(F.array(*[F.lit(float(x)) for x in (3, 4, 0)]), 100)) == pytest.approx([12.5**0.5, 0.0])


def test_ink_regions(spark):
    a = np.full((10, 20), 255, np.uint8)
    a[1:4, 2:6] = 0
    a[6:9, 10:15] = 0
    df = spark.createDataFrame([("i", 20, 10, bytearray(a.tobytes()))], "id string, width int, height int, content binary")
    assert [(r.x, r.y, r.w, r.h) for r in media.ink_regions(df).orderBy("reading_order").collect()] == [(2, 1, 4, 3), (10, 6, 5, 3)]


def test_lineage(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a")], "stage string, depends_on string")
    assert {(r.root, r.stage, r.distance) for r in lineage.descendants(e).collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)}
    assert {r.root: r.unaffected for r in lineage.unaffected(e).collect()} == {"a": 0, "b": 2, "c": 3, "d": 3}
    g = spark.createDataFrame([("a", "P", "b"), ("b", "P", "a"), ("b", "Q", "c"), ("c", "P", "d")], "subject string, predicate string, object_ref string")
    got = lineage.traverse(g, spark.createDataFrame([("a",)], "ref string"), 9)
    assert {(r.ref, r.predicate, r.distance) for r in got.collect()} == {("b", "P", 1), ("a", "P", 2), ("c", "Q", 2), ("d", "P", 3)}


def test_causes(spark):
    e = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "seq bigint, causation_id bigint")
    got = audit.causes(e, spark.createDataFrame([(3,)], "seq bigint"))
    assert {(r.seq, r.cause, r.distance) for r in got.collect()} == {(3, 2, 1), (3, 1, 2)}


def test_structured(spark):
    st = spark.createDataFrame([("e1", "CANONICAL_IDENTITY", "{}", "Ann", ["A."], "CONFIRMED", 3, [("s1", "w1", None)]), ("e1", "CANONICAL_ENTITY", "e1", None, None, "CONFIRMED", 9, None), ("e2", "CANONICAL_IDENTITY", "{}", "Bo", None, "INVALIDATED", 1, None), ("e3", "CANONICAL_IDENTITY", "{}", "Cy", [], "CONFIRMED", 2, [("s1", "w2", None), ("s2", "w1", None)])],
                               "entity_ref string, predicate string, object_ref string, display_label string, aliases array<string>, state string, seq bigint, tuples array<struct<source_id:string,work_id:string,continuity_id:string>>")
    t = {"state": st}
    assert [r.display_label for r in structured(t, StructuredQuery("ENTITY")).collect()] == ["Ann", "Cy"]
    assert [r.entity_ref for r in structured(t, StructuredQuery("ENTITY", source_id="s1", work_id="w1")).collect()] == ["e1"]
    assert [r.entity_ref for r in structured(t, StructuredQuery("ENTITY", alias="a.")).collect()] == ["e1"]
    assert len(structured(t, StructuredQuery("ENTITY", limit=1, offset=1)).collect()) == 1
    with pytest.raises(ScopeUnmappableError):
        structured({"edges": st}, StructuredQuery("CONTRADICTIONS", work_id="w"))


def test_spatial_and_tuples(spark):
    assert one(spark, spatial_contains(F.lit('{"a": {"b": 1, "c": "x"}}'), {"a": {"b": 1}}))
    assert not one(spark, spatial_contains(F.lit('{"a": {"b": 2}}'), {"a": {"b": 1}}))
    assert not one(spark, spatial_contains(F.lit(None).cast("string"), {"a": 1}))


def test_questions():
    assert compile_question("What did Ann Lee say?") == StructuredQuery("UTTERANCE", ref="Ann Lee")
    assert compile_question("Who is Ann?") == StructuredQuery("ENTITY", name="Ann")
    assert compile_question("Any contradictions about Bo?").kind == "CONTRADICTIONS"
    assert compile_question("How is Ann related to Bo?") == StructuredQuery("RELATIONSHIP_EDGES", ref="Bo")
    assert compile_question("evidence for p1?").kind == "EVIDENCE"
    assert compile_question("Show unresolved names").kind == "UNRESOLVED_ALIASES"
    assert compile_question("How are you?") is None


def test_generations(spark, tmp_path):
    g = publish.Generations(spark, f"file://{tmp_path}/g")
    with pytest.raises(LookupError):
        g.current()
    g.publish(spark.range(3))
    g.publish(spark.range(5))
    assert g.current().count() == 5 and g.reap(1e9) == [] and len(g.reap(-1)) == 1 and g.current().count() == 5
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    publish.backup(df, f"file://{tmp_path}/b")
    assert sorted(publish.restore(spark, f"file://{tmp_path}/b", df.schema).collect()) == sorted(df.collect())


def test_tuple_scope_none(spark):
    assert one(spark, tuple_scope(F.lit(None)))
