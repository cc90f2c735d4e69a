"""Queries over all pairs, scripts and probes against brute force."""

import hashlib
import math
import re
import unicodedata
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracewright.functions import text as X
from tracewright.operators import search

DOCS = "doc_id long, text string, lang string, source string"


def table(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def run(spark, name, d):
    return entry.queries()[name](spark, d)


def least(words, b):
    return min((hashlib.sha256(f"42\x1f{b}\x1f{w}".encode()).hexdigest()[:16] for w in words), default="0" * 16)


def test_signature_has_64_hashes(spark, tmp_path):
    d = table(spark, tmp_path, "documents", [(1, "Heavy bridge, heavy rain", "en", "s")], DOCS)
    got = run(spark, "minhash_sig", d).first().signature.split(",")
    assert got == [least({"heavy", "bridge", "rain"}, b) for b in range(64)]


def test_signature_of_any_script_and_of_nothing(spark, tmp_path):
    rows = [(1, "Мост и река", "ru", "s"), (2, None, "en", "s"), (3, " ... ", "en", "s"), (4, "Straße, École", "de", "s"), (5, "", "en", "s")]
    d = table(spark, tmp_path, "documents", rows, DOCS)
    got = {r.doc_id: r.signature.split(",") for r in run(spark, "minhash_sig", d).collect()}
    want = {1: {"мост", "и", "река"}, 2: set(), 3: set(), 4: {"strasse", "école"}, 5: set()}
    assert got == {i: [least(w, b) for b in range(64)] for i, w in want.items()}
    assert run(spark, "lsh_pairs", d).where("kind = 'link'").count() == 0


def test_links_of_all_pairs_in_a_block(spark, tmp_path):
    rng = np.random.default_rng(5)
    some = lambda *x: x[rng.integers(len(x))]
    rows = [(i, f"{some('red', 'blue', 'rod')} {some('plate', 'nut', 'cup')}" if i % 9 else None, some("B1", "B2", "B3"), some("S", "T", None), int(rng.integers(1, 4))) for i in range(60)]
    d = table(spark, tmp_path, "part", rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    block = lambda n: {*n.split(), one_soundex[n]}
    names = sorted({r[1] for r in rows if r[1]})
    one_soundex = {r.n: "s:" + r.s for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", X.soundex(F.col("n")).alias("s")).collect()}
    pairs = [(a, b) for a, b in combinations(rows, 2) if a[1] and b[1] and block(a[1]) & block(b[1])]
    agree = lambda a, b: tuple(a[i] is not None and a[i] == b[i] for i in (1, 3, 4))
    yes, no = [agree(a, b) for a, b in pairs if a[2] == b[2]], [agree(a, b) for a, b in pairs if a[2] != b[2]]
    model = {f: tuple((sum(x[i] for x in y) + 0.5) / (len(y) + 1.5) for y in (yes, no)) for i, f in enumerate(("name", "type", "size"))}
    got = {r.field: (r.m, r.u) for r in run(spark, "link_train", d).collect()}
    assert {f: pytest.approx(v, abs=1e-7) for f, v in model.items()} == got
    weight = lambda x: sum(math.log(m / u) if y else math.log((1 - m) / (1 - u)) for y, (m, u) in zip(x, model.values()))
    out = run(spark, "link_predict", d).collect()
    of = {r.right: r.left for r in out if r.kind == "member"}
    inside = {r.left: r.weight for r in out if r.kind == "member"}
    links = {(r.left, r.right): r.weight for r in out if r.kind == "link"}
    assert len(out) == len(of) + len(links) and set(of) == {r[0] for r in rows if r[1]}
    made = {}
    for a, b in combinations(sorted(of), 2):
        w = inside[of[a]] if of[a] == of[b] else links.get((min(of[a], of[b]), max(of[a], of[b])))
        if w is not None:
            made[a, b] = w
    assert made == {(a[0], b[0]): pytest.approx(weight(agree(a, b)), abs=1e-5) for a, b in pairs}


def test_vector_searches_of_every_fiftieth_row(spark, tmp_path):
    v = np.random.default_rng(3).integers(-3, 4, (120, 4)).astype(float)
    v[7] = 0
    d = table(spark, tmp_path, "embeddings", [(i, [float(x) for x in r], 0) for i, r in enumerate(v)], "vec_id long, embedding array<float>, label int")
    table(spark, tmp_path, "documents", [(5, "heavy bridge heavy", "en", "s"), (300, "bridge heavy", "en", "s"), (6, "heavy", "en", "s")], DOCS)
    cos = lambda a, b: round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 6) if a.any() and b.any() else 0.0
    best = {q: sorted(((cos(v[q], x), i) for i, x in enumerate(v)), key=lambda t: (-t[0], t[1])) for q in (0, 50, 100)}
    got = {(r.probe_id, r.vec_id): r.score for r in run(spark, "vector_topk", d).collect()}
    assert got == {(q, i): pytest.approx(s, abs=2e-6) for q, b in best.items() for s, i in b[:20]}
    whole = spark.read.parquet(f"{d}/embeddings.parquet")
    in_blocks = search.nearest_vectors(whole, whole.where("vec_id % 50 = 0"), 20, block=2)
    assert {(r.probe_id, r.vec_id) for r in in_blocks.collect()} == set(got)
    far = {(r.probe_id, r.vec_id): r.distance for r in run(spark, "vector_l2", d).collect()}
    assert far == {(q, i): pytest.approx(float(np.linalg.norm(v[q] - x)), abs=2e-5) for q in best for i, x in enumerate(v)}
    both = {(r.probe_id, r.doc_id): r.score for r in run(spark, "search_hybrid", d).collect()}
    text = {5: 3 / 4, 300: 2 / 3}
    near = {q: {i: s for s, i in b[:40]} for q, b in best.items()}
    assert both == {(q, i): pytest.approx(0.5 * text.get(i, 0) + 0.5 * max(0, near[q].get(i, 0)), abs=2e-6) for q in near for i in {*near[q], *text}}


def test_links_of_documents_that_are_no_heads_of_a_band(spark, tmp_path):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[: 40 + 4 * (i % 6)] + [f"x{int(j)}" for j in rng.integers(0, 500, i % 7)]) for i in range(40)]
    texts += [texts[3].upper(), " ".join(reversed(texts[5].split())), "", None, "other words"]
    d = table(spark, tmp_path, "documents", [(i, t, "en", "s") for i, t in enumerate(texts)], DOCS)
    out = run(spark, "lsh_pairs", d).collect()
    of = {r.doc_id: r.head for r in out if r.kind == "member"}
    links = {(r.head, r.doc_id): r.similarity for r in out if r.kind == "link"}
    words = [frozenset((t or "").lower().split()) for t in texts]
    assert of == {i: words.index(w) if w else i for i, w in enumerate(words)}
    band = lambda w: {(b, *(least(w, 4 * b + i) for i in range(4))) for b in range(16)}
    heads = sorted({of[i] for i, w in enumerate(words) if w})
    bands = {i: band(words[i]) for i in heads}
    alike = {(a, b): len(words[a] & words[b]) / len(words[a] | words[b]) for a, b in combinations(heads, 2) if bands[a] & bands[b]}
    assert links == {k: pytest.approx(s, abs=1e-6) for k, s in alike.items() if s >= 0.8} and len({a for a, _ in links}) > 3


def test_names_of_one_word_and_of_any_script(spark, tmp_path):
    some = [" Rebecca.", "rebecca", "Rebecca Moss", "moss, REBECCA", "Иван", "иван!", "Пётр", "田中", "山本", "École", "ecole", "a b c d e", "a b c d", "a b c", "...", "", "ＲＥＢＥＣＣＡ?"]
    d = table(spark, tmp_path, "source_mention", [*[("w", x) for x in some], ("v", "rebecca"), (None, "rebecca"), ("w", None)], "work_id string, mention_text string")
    got = {(r.work_id, r.left_name, r.right_name): r.similarity for r in run(spark, "jaccard_pairs", d).collect()}
    sets = {x.lower(): {w for w in re.split(r"\W+", unicodedata.normalize("NFKC", x).casefold()) if w} for x in some}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b]}
    assert got == {("w", *k): pytest.approx(s, abs=1e-6) for k, s in alike.items() if s >= 0.8}
    assert ("w", " rebecca.", "rebecca") in got and ("w", "иван", "иван!") in got
