"""The change feed against applying its events one by one."""

import random

from tracewright.operators.changefeed import apply_changes

B = "entity string, predicate string, seq bigint, extra string"
C = "kind string, entity string, predicate string, seq bigint, k string, extra string"


def one_by_one(base, feed):
    state = {}
    for e, p, q, _ in base:
        key = (e, p)
        q = -(2**63) if q is None else q
        state[key] = max(state.get(key, q), q)
    keys = {}
    for x in feed:
        if x[4] is not None and x[3] is not None:
            keys[x[4]] = min(keys.get(x[4], x[3]), x[3])
    for kind, e, p, q, k, _ in sorted({x for x in feed if x[3] is not None}, key=lambda x: x[3]):
        if (k is not None and keys[k] < q) or e is None:
            continue
        if kind == "SemanticAsserted" and p is not None and state.get((e, p), q) <= q:
            state[e, p] = q
        if kind == "Invalidated":
            for key in [s for s in state if s[0] == e and (p is None or s[1] == p) and state[s] <= q]:
                del state[key]
    return sorted((e, p, None if q == -(2**63) else q) for (e, p), q in state.items())


def run(spark, base, feed):
    got = apply_changes(spark.createDataFrame(base, B), spark.createDataFrame(feed, C))
    return sorted(tuple(r) for r in got.collect())


def test_random_feeds(spark):
    for seed in range(6):
        rnd = random.Random(seed)
        base = [("e%d" % rnd.randrange(5), "p%d" % rnd.randrange(3), rnd.randrange(60), "x") for _ in range(12)]
        feed = []
        for q in range(1, 80):
            kind = rnd.choice(["SemanticAsserted", "SemanticAsserted", "Invalidated", "StageCompleted"])
            p = None if kind == "Invalidated" and rnd.random() < 0.4 else "p%d" % rnd.randrange(3)
            feed.append((kind, rnd.choice(["e0", "e0", "e1", "e2", None]), p, q, rnd.choice([None, "k%d" % rnd.randrange(40)]), "x"))
        feed += feed[:10]
        rnd.shuffle(feed)
        assert run(spark, base, feed) == one_by_one(base, feed), seed


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [("e", "p", 3, "x")], []) == [("e", "p", 3)]
    assert run(spark, [("e", "p", None, "x")], [("Invalidated", "e", None, 1, None, "x")]) == []
    assert run(spark, [], [("SemanticAsserted", "e", "p", None, None, "x"), ("SemanticAsserted", "e", None, 2, None, "x")]) == []


def test_whole_rows_in_any_order_and_in_stretches(spark):
    rnd = random.Random(11)
    base = [("e%d" % rnd.randrange(3), "p%d" % rnd.randrange(3), rnd.choice([None, rnd.randrange(60)]), "base", 0.5) for _ in range(9)]
    feed = []
    for q in range(1, 90):
        kind = rnd.choice(["SemanticAsserted", "OverrideApplied", "Invalidated"])
        p = None if kind == "Invalidated" and rnd.random() < 0.3 else "p%d" % rnd.randrange(3)
        feed.append((kind, "e%d" % rnd.randrange(3), p, q, rnd.choice([None, "k%d" % rnd.randrange(60)]), f"v{rnd.randrange(2)}", rnd.random()))
    feed += [(*x[:5], "w", None) for x in feed[:30]]
    # row by row: the larger values of one seq stand
    rows = {}
    for e, p, q, *v in base:
        q = -(2**63) if q is None else q
        rows[e, p] = max(rows.get((e, p), (q, 0, v)), (q, 0, v), key=lambda x: (x[0], x[1], [y or 0 if i else y for i, y in enumerate(x[2])]))
    first = {}
    for x in feed:
        if x[4] is not None:
            first[x[4]] = min(first.get(x[4], x[3]), x[3])
    ok = [x for x in feed if x[4] is None or first[x[4]] == x[3]]
    for kind, e, p, q, _, *v in sorted(ok, key=lambda x: (x[3], x[0] == "Invalidated", x[5], x[6] or 0)):
        if kind == "Invalidated":
            for key in [k for k in rows if k[0] == e and p in (None, k[1]) and rows[k][0] <= q]:
                del rows[key]
        elif (e, p) not in rows or rows[e, p][0] <= q:
            rows[e, p] = (q, 1, v)
    want = sorted((e, p, None if q == -(2**63) else q, *v) for (e, p), (q, _, v) in rows.items())
    b = spark.createDataFrame(base, "entity string, predicate string, seq bigint, ref string, sure double")
    for width in (1 << 20, 7):
        rnd.shuffle(feed)
        f = spark.createDataFrame(feed, "kind string, entity string, predicate string, seq bigint, k string, ref string, sure double").repartition(5)
        assert sorted(tuple(r) for r in apply_changes(b, f, values=["ref", "sure"], width=width).collect()) == want
