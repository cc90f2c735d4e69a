"""The closed-form folds against the plain ones, on random ledgers."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import edges, ledger, state
from tracewright.operators.asof import last_before

COLS = "seq bigint, event_type string, entity string, target string, authority string, p_authority string, object_ref string, object_entity_id string, target_entity_id string, entity_id string, confidence double, has_confidence boolean, p_state string, kind string, scope string, relationship_type string, prior_ref string"


def random_ledger(seed, n=250):
    r = random.Random(seed)
    types = [*state.CHANGES, "SemanticAsserted", "SemanticAsserted", *state.LOCKS, "StageCompleted"]
    out = []
    for q in range(n):
        t = r.choice(types)
        target = "CANONICAL_ENTITY" if t == "EntityResolved" else "CANDIDATE" if t == "EntityMentioned" else r.choice(["A", "B", None])
        if t in state.LOCKS or t == "StageCompleted":
            target = None
        out.append((q, t, r.choice(["x", "y", "z", None]), target, r.choice([None, "machine", "machine", "USER_OVERRIDE"]) if r.random() < 0.3 else "machine", r.choice([None, "USER_OVERRIDE"]) if r.random() < 0.1 else None,
                    r.choice(["o1", "o2", None]), r.choice([None, "oe"]), r.choice([None, "te"]), "ei", r.choice([None, 0.5, 0.7]), r.random() < 0.5, r.choice([None, "PROBABLE"]), r.choice(["ALIAS", "MERGE"]),
                    r.choice([None, "GLOBAL", "SOURCE"]), r.choice([None, "ALLY"]), r.choice([None, None, "o1"])))
    r.shuffle(out)
    return out


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_state(spark, seed):
    df = spark.createDataFrame(random_ledger(seed), COLS)
    a = state.reduce_state(df)
    b = state.reduce_in_order(df)
    assert key(a.collect()) == key(b.collect())


def plain_edges(rows):
    names = [c.split()[0] for c in COLS.split(", ")]
    locked, live, seen = set(), {}, {}
    for e in sorted((dict(zip(names, r)) for r in rows), key=lambda x: x["seq"]):
        t, s, p = e["event_type"], e["entity"], e["target"]
        if s is None:
            continue
        if t == "Locked":
            locked.add(s)
        elif t == "Unlocked":
            locked.discard(s)
        up = None
        if s not in locked and p is not None:
            if t == "SemanticAsserted":
                up = "m"
            elif t in ("OverrideApplied", "CorrectionApplied"):
                for k in [k for k in live if k[1] == s and k[2] == p and (e["relationship_type"] is None or k[5] == e["relationship_type"]) and (t != "CorrectionApplied" or e["prior_ref"] is None or k[3] == e["prior_ref"])]:
                    del live[k]
                up = "u" if e["object_ref"] is not None else None
        if t == "Invalidated":
            for k in [k for k in live if k[1] == s and (p is None or k[2] == p) and (e["scope"] is None or k[4] == e["scope"]) and (e["relationship_type"] is None or k[5] == e["relationship_type"])]:
                del live[k]
        if up:
            k = (up, s, p, e["object_ref"], e["scope"] or "GLOBAL", e["relationship_type"])
            live[k] = e["seq"]
            seen[k] = 1
    return sorted(((*k, q) for k, q in live.items()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_edges(spark, seed):
    rows = random_ledger(seed)
    got = edges.edge_states(spark.createDataFrame(rows, COLS)).where("active").select("origin", "subject", "predicate", "object_ref", "scope", "relationship_type", "seq").collect()
    assert key(got) == plain_edges(rows)


def test_last_before_over_stretches(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), q, r.choice([None, None, q * 10])) for q in range(300)]
    want, last = {}, {}
    for k, q, v in rows:
        want[q] = last.get(k)
        last[k] = v if v is not None else last.get(k)
    for width in (1, 7, 1 << 20):
        got = last_before(spark.createDataFrame(rows, "k string, q bigint, v bigint"), ["k"], "q", F.col("v"), "was", width)
        assert {x.q: x.was for x in got.collect()} == want


def test_checksum_ignores_partitioning(spark):
    s = state.reduce_state(spark.createDataFrame(random_ledger(9), COLS))
    assert state.checksum(s.repartition(1)).first() == state.checksum(s.repartition(7)).first()
    assert state.checksum(s.where("entity <> 'x'")).first() != state.checksum(s).first()
    assert state.checksum(s.where("false")).first()["rows"] == 0


def test_append(spark):
    old = spark.createDataFrame([(1, "k1"), (2, None)], "seq bigint, idempotency_key string")
    new = spark.createDataFrame([(1, "k1"), (2, "k2"), (3, "k2"), (4, None), (5, None)], "ord int, idempotency_key string")
    got = ledger.append(old, new, ["ord"], expected_tail=2)
    assert [(r.ord, r.seq) for r in got.orderBy("seq").collect()] == [(2, 3), (4, 4), (5, 5)]
    with pytest.raises(ValueError):
        ledger.append(old, new, ["ord"], expected_tail=9)


def test_poison(spark):
    e = spark.createDataFrame([(1, "SemanticAsserted", None, ["a"]), (2, "SemanticAsserted", None, ["bad", "b"]), (3, "Locked", None, ["bad"]), (4, "SemanticAsserted", "USER_OVERRIDE", [])], "seq bigint, event_type string, authority string, refs array<string>")
    got = ledger.poison(e, spark.createDataFrame([("bad",)], "ref string"))
    assert {r.seq: r.verdict for r in got.collect()} == {1: "APPLY", 2: "SKIP", 3: "PAUSE", 4: "PAUSE"}
