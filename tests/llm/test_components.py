"""Star rewrites against a union-find."""

import random

import pytest

from tracewright.llm.components import components, same_records


def by_union(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    groups = {}
    for x in list(up):
        groups.setdefault(find(x), []).append(x)
    return sorted((x, min(g)) for g in groups.values() if len(g) > 1 for x in g)


def run(spark, pairs):
    df = spark.createDataFrame([(*p, "clash") for p in pairs], "a string, b string, record_ref string")
    return sorted(tuple(r) for r in components(df, "a", "b").collect())


CASES = {
    "chain": [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)],
    "hub": [("hub", f"x{i}") for i in range(200)] + [(f"x{i}", "hub") for i in range(50)],
    "ties": [("a", "a"), ("b", "b"), ("a", "b"), ("a", "b"), (None, "c"), ("d", None)],
    "empty": [],
    "bytes": [("é", "z"), ("Z", "z"), ("ﬀ", "é"), ("𝒜", "ﬀ")],
}


@pytest.mark.parametrize("name", CASES)
def test_shapes(spark, name):
    assert run(spark, CASES[name]) == by_union(CASES[name])


def test_random(spark):
    r = random.Random(4)
    pairs = [(f"r{r.randrange(400)}", f"r{r.randrange(400)}") for _ in range(260)]
    assert run(spark, pairs) == by_union(pairs)


def test_assertions_are_cleaned(spark):
    rows = [(" Alias_of\t", "\tA ", "b"), ("CORRESPONDS_TO", "B", "c "), ("RELATED_TO", "c", "d"), ("ALIAS_OF", " ", "e"), ("ALIAS_OF", None, "e"), (None, "x", "y"), ("ALIAS_OF", "q", "Q")]
    df = spark.createDataFrame(rows, "predicate_code string, subject_ref string, object_ref string")
    assert sorted(tuple(r) for r in same_records(df).collect()) == [("a", "a"), ("b", "a"), ("c", "a")]
