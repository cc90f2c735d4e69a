"""Names: the comparison on written-out cases, the curve, and links of a small work."""

import random

import numpy as np
from pyspark.sql import functions as F

from tracewright.llm import names as N
from tracewright.session import written

SHORT = {"rebecca": {"becky"}}


def fit(a, b, org=False, given=()):
    return N.fit(N.words_of(a), N.words_of(b), org, SHORT, set(given))


def test_words():
    assert N.words_of("Mrs. Stardley, Rebecca") == ["rebecca", "stardley"] or N.words_of("Stardley, Rebecca") == ["rebecca", "stardley"]
    assert N.words_of(" the Red Heron's ") == ["red", "heron"] and N.words_of("ÍñigoBande") == ["inigo", "bande"]
    assert N.words_of("M.T.D.") == ["mtd."] and N.words_of("O.B. Moss") == ["o", "b", "moss"]
    assert N.words_of("???") == N.words_of(None) == N.words_of("  ") == N.words_of("She") == []


def test_levels():
    assert fit("Becky Stardley", "Rebecca Stardley")[0] == 3 and fit("STARDLEY R", "Rebecca Stardley")[0] == 2
    assert fit("Stardlye", "Rebecca Stardley")[0] == 1 and fit("Rebecca", "Rebecca Stardley")[0] == 1
    assert fit("RebeccaS tardley", "Rebecca Stardley")[0] == 3
    assert fit("Susannah Stardley", "Rebecca Stardley") is None and fit("Hester Moss", "Kester Moss", given=("hester",)) is None
    assert fit("Rebecca A. Stardley", "Rebecca Stardley")[0] == 3
    assert fit("Rope Inst., Joorn", "Joorn Rope Institute", True)[0] == 3 and fit("J.R.I.", "Joorn Rope Institute", True)[0] == 3
    assert fit("Joorn Rope", "Joorn Rope Institute", True)[0] == 2 and fit("Joorn Bell Institute", "Joorn Rope Institute", True) is None


def test_edits():
    assert N.edits("abcd", "abdc") == 1 and N.edits("abc", "abc") == 0 and N.edits("kitten", "sitting") == 3


def test_curve():
    n = N.bands_for(0.5, 0.99, 2)
    assert 1 - (1 - 0.25) ** n >= 0.99 > 1 - (1 - 0.25) ** (n - 1)
    a = set(N.bands("stardley"))
    assert a & set(N.bands("stardly")) and len(a) == N.BANDS


REG = "entity_ref string, work_id string, display_label string, aliases array<string>, organisation boolean, extra string"
MEN = "mention_id string, work_id string, mention_text string, entity_id string, words string"


def run(spark, reg, men):
    short = spark.createDataFrame([("Rebecca", "Becky")], "given_name string, short_form string")
    m = spark.createDataFrame([(str(i), w, t, e, "clash") for i, (w, t, e) in enumerate(men)], MEN)
    return {int(r.mention_id): r.entity_ref for r in N.link_mentions(m, spark.createDataFrame([(*r, "x") for r in reg], REG), short).collect()}


def test_links(spark):
    reg = [("e1", "w", "Rebecca Stardley", ["the Silent Badger"], False), ("e2", "w", "Philip Stardley", None, False), ("e3", "w", "Joorn Rope Institute", [], True), ("e4", "v", "Rebecca Moss", [], False)]
    men = [("w", "Becky Stardley", None), ("w", "Stardley", None), ("w", " the silent badger.", None), ("w", "J.R.I.", None), ("w", "Rebecca", None), ("v", "Stardley, Rebecca", None), ("w", "Philip Stradley", None), ("w", None, None),
           ("w", "", None), ("w", "she", None), (None, "Rebecca Stardley", None), ("w", "x" * 5000, None), ("w", "Walter Moss", None), ("w", "P. Stardley", None), ("w", "Becky Stardley", None)]
    got = run(spark, reg, men)
    assert got == {0: "e1", 2: "e1", 3: "e3", 4: "e1", 6: "e2", 13: "e2", 14: "e1"}


def test_somebody_else_named_there(spark):
    reg = [("e1", "w", "Jasper Humiven", [], False), ("e2", "v", "Ivo Prann", [], False)]
    men = [("w", "Humiven", None), ("w", "J. Humiven", None), ("w", "Ivo Humiven", None), ("w", "Jasper Humiven", None)]
    assert run(spark, reg, men) == {1: "e1", 3: "e1"}


def test_empty(spark):
    assert run(spark, [], []) == {} and run(spark, [], [("w", "Ann", None)]) == {} and run(spark, [("e", "w", None, None, None)], [("w", "Ann", None)]) == {}


def test_names_of_any_length(spark):
    label = "Royal and Ancient Society of Bell Founders of the Upper Joorn Valley"
    reg = [("e1", "w", label, [], True), ("e2", "w", "Maria Anna Sofia Luisa Carlota Ines Juana Teresa Pilar Moss", [], False)]
    men = [("w", label, None), ("w", label.upper() + ".", None), ("w", reg[1][2], None), ("w", "Maria Moss", None), ("w", " ".join(f"word{i}" for i in range(3000)), None)]
    assert run(spark, reg, men) == {0: "e1", 1: "e1", 2: "e2", 3: "e2"}


def test_kinds_of_organisations_are_learned(spark):
    # a guild that nobody registered is somebody else in the work, because others are called guilds
    reg = [("e1", "w", "Joorn Rope Guild", [], True), ("e2", "v", "Prann Bell Guild", [], True)]
    men = [("w", "Joorn Rope", None), ("w", "Joorn Rope Guild", None), ("w", "Joorn Bell Guild", None), ("w", "Joorn", None)]
    assert run(spark, reg, men) == {0: "e1", 1: "e1"}


def test_short_forms_that_are_no_names(spark):
    reg = spark.createDataFrame([("e1", "w", "Rebecca Stardley", [], False, "x")], REG)
    men = spark.createDataFrame([("0", "w", "Becky Stardley", None, "clash")], MEN)
    short = spark.createDataFrame([("Rebecca", "Becky"), ("Rebecca", "She"), ("", "Becky"), ("Philip", None)], "given_name string, short_form string")
    assert [tuple(r) for r in N.link_mentions(men, reg, short).select("mention_id", "entity_ref").collect()] == [("0", "e1")]


def test_nothing_that_grows_goes_through_the_driver(spark, monkeypatch):
    plans = []

    def kept(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, name)

    monkeypatch.setattr(N, "written", kept)
    reg = [(f"e{i}", "w", f"Rebecca Stardley{i}", [], False) for i in range(20)]
    run(spark, reg, [("w", f"Becky Stardley{i}", None) for i in range(20)])
    fits = [p for name, p in plans if name in ("round", "near", "met", "fits")]
    assert fits and not any("Broadcast" in p for p in fits)


def test_bands_in_rounds_and_letters(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdé") for _ in range(n))
    words = [word(r.randrange(1, 12)) for _ in range(300)] + ["x" * 70_000, "漢字"]
    cuts = [N.BANDS * k // N.ROUNDS for k in range(N.ROUNDS + 1)]
    assert (np.hstack([N.band_hashes(words, a, b) for a, b in zip(cuts, cuts[1:])]) == N.band_hashes(words)).all()
    assert all(tuple(x) == N.bands(w) for x, w in zip(N.band_hashes(words).tolist(), words))

    def typo(w):
        i, k = r.randrange(len(w)), r.randrange(4)
        return [w[:i] + w[i + 1 :], w[:i] + r.choice("abcdé") + w[i:], w[:i] + r.choice("abcdé") + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]][k]

    pairs = [(w, typo(typo(w) or "a")) for w in (word(r.randrange(2, 14)) for _ in range(3000))] + [(w, typo(w)) for w in (word(r.randrange(2, 9)) for _ in range(1000))]
    pairs = [(a, b) for a, b in pairs if N.edits(a, b) <= (2 if max(len(a), len(b)) >= 8 else 1)]
    rows = [(a, b, int(x).bit_count()) for (a, b), x in zip(pairs, N.letter_sets([a for a, _ in pairs]) ^ N.letter_sets([b for _, b in pairs]))]
    df = spark.createDataFrame(rows, "u string, v string, n int")
    assert len(rows) > 2000 and df.where(~N._edited(F.col("u"), F.col("v"), F.col("n"))).count() == 0
