"""Shared spans against a dictionary of all spans."""

import random

import pytest

from tracewright.llm import spans


def brute(rows, n):
    first, many = {}, set()
    for i, t in rows:
        for s in range(len(t or "") - n + 1):
            if first.setdefault(t[s : s + n], i) != i:
                many.add(t[s : s + n])
    out = {}
    for i, t in rows:
        end = got = 0
        for s in range(len(t or "") - n + 1):
            if t[s : s + n] in many:
                got += s + n - max(s, end)
                end = s + n
        if got:
            out[i] = got
    return out


def run(spark, rows, n=200):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, shared_chars string")
    return {r.doc_id: r.shared_chars for r in spans.shared_chars(df, "doc_id", "text", n).collect()}


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh éß日🙂") for _ in range(r.randrange(3, 9)))
    free = lambda k: " ".join(word() for _ in range(k))
    common = [free(k) for k in (20, 30, 45, 90)] + ["=" * 400, "ab" * 180]
    rows = []
    for i in range(60):
        parts = [free(r.randrange(0, 60))]
        for _ in range(r.randrange(0, 3)):
            c = r.choice(common)
            a = r.randrange(0, max(1, len(c) - 150))
            parts += [c[a : a + r.randrange(150, 400)], free(r.randrange(0, 30))]
        rows.append((i, "".join(parts)))
    one = free(80)
    return rows + [(100, None), (101, ""), (102, "short"), (103, one + free(9) + one), (104, rows[3][1]), (105, rows[3][1]), (106, "=" * 199), (107, "=" * 200)]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_spans(spark, seed):
    rows = texts(seed)
    assert run(spark, rows) == brute(rows, 200)


def test_parts_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(spans, "PART", 700)
    rows = texts(9)
    rows.append((200, "".join(t or "" for _, t in rows)))
    # the workers hash in one part; here the windows of cut texts are compared with those of all spans
    w = spans.compact_windows([rows[-1][1]], 200)
    covered = set()
    for lo, hi in zip(w["lo"], w["hi"]):
        covered |= set(range(lo, hi + 1))
    assert covered == set(range(len(rows[-1][1]) - 199))
    assert run(spark, rows) == brute(rows, 200)


def test_empty(spark):
    assert run(spark, []) == {}
    with pytest.raises(ValueError):
        run(spark, [], 0)
    with pytest.raises(ValueError):
        run(spark, [], spans.PART)


@pytest.mark.parametrize("length", (1, 7, 50, 1000))
def test_any_length(spark, length):
    rows = texts(length)
    if length == 1000:
        r = random.Random(2)
        long_ = ["".join(r.choice("abc dé") for _ in range(1800)) for _ in range(3)]
        rows += [(300 + i, x[: 1000 + i] + "#" * i + x[1000:]) for i, x in enumerate(long_ * 3)]
    assert run(spark, rows, length) == brute(rows, length)


def test_more_ids_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr(spans, "SENT", 2)
    assert run(spark, texts(4)) == brute(texts(4), 200)
