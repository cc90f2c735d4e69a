"""Identities, replays, evidence and picture regions on written-out cases, folds against the plain form."""

import pytest
from pyspark.sql import functions as F

from tests.test_folds import COLS, random_ledger
from tracewright.functions import boxes
from tracewright.operators import evidence, identity, ledger, lineage, state
from tracewright.operators.asof import lasts_before
from tracewright.operators.replay import Checkpoints, lagging, replay


def test_regions(spark):
    rows = [("10,20,30,40",), ("390,0,11,5",), ("0,0,0,5",), ("-1,0,5,5",), ("pct:10,10,12.5,50",), ("PCT:0,0,100,100",), ("pct:0,0,101,1",), ("x",), (None,), ("1,2,3",), ("99999999999999999999,1,1,1",)]
    got = [r.b and tuple(r.b) for r in spark.createDataFrame(rows, "r string").select(boxes.region_box(F.col("r"), F.lit(400), F.lit(300)).alias("b")).collect()]
    assert got == [(10, 20, 30, 40), None, None, None, (40, 30, 50, 150), (0, 0, 400, 300), None, None, None, None, None]
    x = spark.createDataFrame([(1, 2, 3, 4), (1, -2, 3, 4)], "x int, y int, w int, h int")
    assert [r[0] for r in x.select(boxes.box_region(*map(F.col, "xywh"))).collect()] == ["1,2,3,4", None]
    c = spark.createDataFrame([(200, 120, 80), (60, 50, 20), (255, 255, 0)], "r int, g int, b int")
    assert [tuple(r) for r in c.select(boxes.quantised(F.col("r")), boxes.skin(F.col("r"), F.col("g"), F.col("b"))).collect()] == [(200, True), (56, False), (248, False)]


def test_texts_and_times(spark):
    t = spark.createDataFrame([("2001-03-01T00:00:00Z",), ("2001-03-01T02:00:00+02:00",), ("2001-03-01",), ("2001-13-01T00:00:00Z",), ("soon",), (None,)], "t string")
    got = [r[0] for r in t.select(F.date_format(boxes.instant(F.col("t")), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2001-03-01 00:00"] * 3 + [None] * 3
    w = spark.createDataFrame([("  a bb c d", 7), ("abc", 0), (" ", 1)], "t string, at int")
    assert [r[0] for r in w.select(boxes.token_offset(F.col("t"), F.col("at"))).collect()] == [2, 0, 0]
    assert spark.range(1).select(boxes.stable_json({"b": F.lit(None).cast("string"), "a": F.lit(1)})).first()[0] == '{"a":1,"b":null}'


def test_cursors():
    assert boxes.offset_from(boxes.cursor_for(40)) == 40 and boxes.offset_from(None) == 0
    assert boxes.cursors(20, 20, 41) == (boxes.cursor_for(40), boxes.cursor_for(0)) and boxes.cursors(0, 50, 41) == (None, None)
    for bad in ("no cursor!", "W10=", "eyJvIjoieCJ9"):
        with pytest.raises(ValueError):
            boxes.offset_from(bad)


def test_last_values_in_stretches(spark):
    rows = [("a", n, n if n % 3 == 0 else None, n if n % 7 == 0 else None) for n in range(60)]
    df = spark.createDataFrame(rows, "k string, n bigint, x bigint, y bigint")
    got = {r.n: (r.px, r.py) for r in lasts_before(df, ["k"], "n", {"px": F.col("x"), "py": F.col("y")}, 8).collect()}
    assert got == {n: (max((i for i in range(0, n, 3)), default=None), max((i for i in range(0, n, 7)), default=None)) for n in range(60)}


def test_alternatives_against_one_by_one(spark):
    rows = random_ledger(6)
    names = [c.split()[0] for c in COLS.split(", ")]
    events = sorted((dict(zip(names, r)) for r in rows), key=lambda e: e["seq"])
    want = set()
    for n, e in enumerate(events):
        before, after = state.fold_events(events[:n]), state.fold_events(events[: n + 1])
        key = (e["entity"], e["target"])
        if e["event_type"] in ("SemanticAsserted", "EntityResolved") and before.get(key) != after.get(key) and key in before:
            a, b = before[key], after[key]
            if b["object_ref"] is not None and a["object_ref"] is not None and a["object_ref"] != b["object_ref"]:
                want.add((*key, e["seq"], a["object_ref"], a["authority"] if e["event_type"] == "SemanticAsserted" else None, a["state"], a["confidence"], a["seq"]))
    got = {tuple(r) for r in identity.alternatives(spark.createDataFrame(rows, COLS)).collect()}
    assert got == want and want


ID = "seq bigint, event_type string, kind string, entity string, entity_id string, predicate string, authority string, p_state string, confidence double, object_ref string, display_label string, canonical_type string, classification string, aliases array<string>, support_refs array<string>, source_ids array<string>, work_ids array<string>, continuity_ids array<string>"


def test_identity(spark):
    def made(seq, label, sources, kind="ESTABLISH", who="e", authority="machine"):
        return (seq, "EntityResolved", kind, who, who, None, authority, None, 0.5, None, label, "character", None, ["x"], None, sources, ["w"] if sources else None, None)

    def changed(seq, json, authority="USER_OVERRIDE", what="OverrideApplied"):
        return (seq, what, None, "e", None, identity.IDENTITY, authority, None, None, json, None, None, None, None, None, None, None, None)

    def run(*rows):
        return {r.entity: r for r in identity.identity_fold(spark.createDataFrame(list(rows), ID)).collect()}

    e = run(made(1, "A", ["s1"]), made(5, "B", ["s2", "s1"], "UPDATE"), made(9, "M", ["s3"], "MERGE"))["e"]
    assert (e.display_label, e.source_ids, e.work_ids, e.state, e.seq) == ("B", ["s1", "s2"], ["w"], "CONFIRMED", 5)
    e = run(made(1, "A", ["s1"]), changed(3, '{"display_label": "C", "memberships": {"source_ids": ["s9", "s1"]}}'), made(5, "B", ["s2"], "UPDATE"))["e"]
    assert (e.display_label, e.canonical_type, e.aliases, e.source_ids, e.state, e.authority) == ("C", "character", ["x"], ["s1", "s9"], "USER_CONFIRMED", "USER_OVERRIDE")
    e = run(made(1, "A", ["s1"]), made(2, "B", None, "UPDATE"), made(3, "C", ["s4"], "UPDATE"), changed(4, None, "machine", "Invalidated"))["e"]
    assert (e.display_label, e.source_ids, e.state) == ("C", ["s4"], "INVALIDATED")
    lock = (2, "Locked", None, "e", None, None, None, None, None, None, None, None, None, None, None, None, None, None)
    assert run(made(1, "A", None), lock, made(3, "B", None, "UPDATE"))["e"].display_label == "A"
    assert run() == {} and run(changed(1, None, "machine", "Invalidated")) == {}


def test_replay_pauses_stays_and_goes_on(spark, tmp_path):
    rows = [(1, "SemanticAsserted", "machine", ["a"]), (2, "SemanticAsserted", "machine", ["bad"]), (3, "Locked", None, ["a"]), (4, "SemanticAsserted", "machine", ["a"])]
    ev = spark.createDataFrame(rows, "seq bigint, event_type string, authority string, refs array<string>")
    bad = spark.createDataFrame([("bad",)], "ref string")
    store, seen = Checkpoints(spark, f"file://{tmp_path}/cp"), []
    apply = lambda df: seen.append(sorted(r.seq for r in df.collect()))
    assert replay(store, "p", ev.limit(0), bad, apply)["applied_seq"] == 0
    one = replay(store, "p", ev.where("seq < 3"), bad, apply)
    assert (one["applied_seq"], one["skipped"], one["pause_seq"]) == (2, 1, None)
    two = replay(store, "p", ev, bad, apply)
    assert (two["applied_seq"], two["pause_seq"]) == (3, 3) and "Locked" in two["pause_reason"]
    assert replay(store, "p", ev, bad, apply)["at"] == two["at"] and [r.projection for r in store.paused().collect()] == ["p"]
    assert not lagging(store.all(), "p", 9)  # paused, never fresh
    three = replay(store, "p", ev, bad, apply, force_resume=True)
    assert (three["applied_seq"], three["pause_seq"]) == (4, None) and seen == [[], [1], [], [1, 2, 3, 4]]
    assert lagging(store.all(), "p", 9) and not lagging(store.all(), "p", 4)

    def fails(df):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        replay(store, "p", ev, bad, fails, wipe=True)
    assert store.get("p")["at"] == three["at"]


def test_evidence(spark):
    loc = spark.createDataFrame([("source://s1/text/p1@v1.0.0", 1), ("source://s1/text/p10@v1.0.0", 2), ("source://s2/x", 3), (None, 4)], "locator string, ref int")
    q = spark.createDataFrame([("source://s1/text/p1",), ("source://s2/x",), ("",)], "ref string")
    assert [r.ref for r in evidence.quarantined_locators(loc, q).orderBy("ref").collect()] == [1, 2, 3]
    assert evidence.quarantined_locators(loc, q.limit(0)).collect() == []
    m = spark.createDataFrame([("a", 0.5, False), ("a", 0.6, None), ("b", 0.9, True), ("c", None, False)], "k string, confidence double, contradicts boolean")
    assert {r.k: r.confidence for r in evidence.mean_confidence(m, "k").collect()} == {"a": 0.55, "b": 0.0, "c": 0.0}
    h = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", "z"), ("b", None), ("c", None)], "k string, target string")
    assert {r.k: r.target for r in evidence.dominant(h, "k").collect()} == {"a": "x", "b": "z"}
    assert spark.range(1).select(evidence.in_order(F.array(*[F.lit(x) for x in "baba"]))).first()[0] == ["b", "a"]
    u = spark.createDataFrame([("m", 7), ("m", 3)], "media_id string, utterance_index int")
    assert {r.utterance_index: r.speaker_label[-1] for r in evidence.unknown_speakers(u, "media_id").collect()} == {3: "1", 7: "2"}


def test_closure_ends_with_cycles(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")]
    want = {}
    for start in "abcd":
        front, n = {start}, 0
        while n < 9:
            n, front = n + 1, {y for x, y in links if x in front}
            for y in front:
                want.setdefault((start, y), n)
    e = spark.createDataFrame([*links, (None, "x")], "a string, b string")
    assert {(r.a, r.b): r.distance for r in lineage.closure(e, "a", "b").collect()} == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "a int, b int")
    assert lineage.closure(chain, "a", "b").count() == 100 * 101 // 2


def test_append_numbers_in_order_over_partitions(spark):
    old = spark.createDataFrame([(7, "k1")], "seq bigint, idempotency_key string")
    new = spark.createDataFrame([(i, f"k{i % 50}" if i % 2 else None) for i in range(200)], "was int, idempotency_key string").repartition(7)
    got = ledger.append(old, new, ["was"]).orderBy("seq").collect()
    kept = [i for i in range(200) if i % 2 == 0 or (i < 50 and i != 1)]
    assert [r.was for r in got] == kept and [r.seq for r in got] == list(range(8, 8 + len(kept)))


def test_questions_of_relations_and_filters(spark):
    from tracewright.operators.search import filtered
    from tracewright.plans.structured import compile_question, page_with_total

    q = compile_question("What is the relationship between Ann Lee and Bo Moss?")
    assert (q.kind, q.ref, q.object_ref) == ("RELATIONSHIP_EDGES", "Ann Lee", "Bo Moss")
    q = compile_question("what emotion does Ann feel?")
    assert (q.kind, q.ref, q.predicate) == ("RELATIONSHIP_EDGES", "Ann", "HAS_EMOTION")
    assert compile_question("How long is the river?") is None
    u = "0123456789abcdef0123456789abcdef"
    d = spark.createDataFrame([(1, "01234567-89ab-cdef-0123-456789abcdef", "source://s/x"), (2, "w", "source://t/x"), (3, None, None)], "n int, work_id string, locator string")
    assert [r.n for r in filtered(d, work_id=u).collect()] == [1] and [r.n for r in filtered(d, locator_prefix="source://t").collect()] == [2] and filtered(d).count() == 3
    assert [(r.n, r.total) for r in page_with_total(d, ["n"], 1, 1).collect()] == [(2, 3)]


def test_subtitle_shapes(spark):
    from tracewright.sources.subtitles import detect_format

    t = spark.createDataFrame([("[12][34]Hello",), ("[0:01.5][x] Hello",), ("{1}{2}Hi",)], "t string")
    assert [r[0] for r in t.select(detect_format(F.col("t"))).collect()] == ["mpl2", None, "microdvd"]
