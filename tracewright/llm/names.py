"""Linking the spellings of names that people type to the entities they mean.

Candidates: the words of a name, its words run together and its initials are cut
into padded q-grams; MinHash bands of these meet within one work. Bands and rows
are taken from the collision curve (`bands_for`), so that a wanted recall holds
at a wanted similarity. Spellings are made distinct before, so that the copies
of a spelling cost nothing.

Verification: a Monge-Elkan comparison. Each word of the spelling takes its best
word of the name (same, short form, initial, abbreviation, typing error) and all
must find one; what kind of words were found gives a level, the mean of the
similarities a score.

Clustering: stars. Registered entities are centres; of the other full names in a
work, those that no more frequent one claims. A spelling belongs to the centre
with the best level and score; one that fits two centres equally well belongs to
none.

What organisations are called by (their last words) is learned from the registry.
Short forms of given names beyond the table are learned too: from the registered
aliases, from mentions that tell their entity, and from pairs of given names
that stand before the same surname in several works and hardly elsewhere.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import discard
from tracewright.session import freed as written

TITLES = frozenset(
    "mr mrs ms miss mister missus mx dr doctor prof professor sir lady lord dame madam madame rev revd reverend capt captain col colonel maj major "
    "lt lieutenant gen general sgt sergeant adm admiral hon judge fr father sr sister br bro brother aunt uncle monsieur mme mlle herr frau".split()
)
_ARTICLES = frozenset(("the", "a", "an"))
#: Words in place of a name.
NO_NAMES = frozenset("i me my he him his she her hers it its they them their we us our you your who someone somebody anyone anybody everyone everybody nobody none unknown anonymous nil null na nan narrator".split())
_FOLD = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i"})
_CAMEL = re.compile(r"(?<=[a-zà-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ])")
_ACRONYM = re.compile(r"^(?:[^\W\d_]\.\s*){2,6}$|^[A-Z]{3,5}$")


def fold(s: str) -> str:
    """Lower case without accents."""
    s = unicodedata.normalize("NFKD", s.casefold().translate(_FOLD))
    return "".join(c for c in s if not unicodedata.combining(c))


def words_of(text: str | None) -> list[str]:
    """The words of a name, folded, surname last if a comma tells; no titles, articles or possessive."""
    if text is None:
        return []
    s = " ".join(unicodedata.normalize("NFC", text).replace("’", "'").split()).strip(" .,;:!?\"-–—_()[]'") if not _ACRONYM.match(text.strip()) else text.strip()
    if _ACRONYM.match(s + "." if len(s) > 2 and s[-2] == "." else s):
        return ["".join(c for c in fold(s) if c.isalpha()) + "."]  # the point marks it as initials
    s = re.sub(r"'s?(?=\s|$|,)", "", s, flags=re.I) if re.search(r"'s?$", s, re.I) else s
    s = re.sub(r"(?<=\b[^\W\d_])\.(?=[^\W\d_])", ". ", _CAMEL.sub(" ", s))
    if ", " in s:
        a, b = s.split(", ", 1)
        s = f"{b} {a}"
    out = ["".join(c for c in fold(w) if c.isalnum()) for w in s.split()]
    out = [w for w in out if w]
    while len(out) > 1 and (out[0] in TITLES or out[0] in _ARTICLES):
        out = out[1:]
    if len(out) > 1 and out[-1] in TITLES:  # "Smith, Dr."
        out = out[:-1]
    if not out or all(w in NO_NAMES or w in _ARTICLES or w in TITLES or w.isdigit() for w in out):
        return []
    return out


@lru_cache(maxsize=200_000)
def edits(a: str, b: str) -> int:
    """Edits between two words, a swap of neighbours counting one."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 2:
        return 3
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[-1]


def _near(a: str, b: str) -> float:
    """1 for the same word, less for one with typing errors, 0 for another."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    if n < 4:
        return 0.0
    d = edits(a, b)
    return 0.9 if d == 1 else 0.82 if d == 2 and n >= 8 else 0.0


def _abbreviates(a: str, b: str) -> bool:
    if not (2 <= len(a) <= 5 < len(b) + 1 and a[0] == b[0] and len(a) < len(b)):
        return False
    rest = iter(b)
    return all(c in rest for c in a)


def fit(spelling: list[str], name: list[str], organisation: bool, short: dict[str, set[str]], given: frozenset[str] | set[str]) -> tuple[int, float] | None:
    """Level and score of a spelling for a name, or None.

    Levels: 3 all that makes the name (given name and surname; all words of an
    organisation; initials), 2 initials and surname, 1 a single part. short: the
    short forms of each word of the name; given: words of the spelling known as
    given names, which are never taken for typing errors of another one.
    """
    if not spelling or not name:
        return None
    if spelling[-1].endswith(".") and len(spelling) == 1:
        if len(name) > 1 and organisation and "".join(w[0] for w in name) == spelling[0][:-1]:
            return 3, 0.9
        return None
    run = "".join(spelling)
    if organisation or len(name) == 1:
        left, score = list(range(len(name))), []
        for w in spelling:
            best, at = 0.0, -1
            for j in left:
                v = _near(w, name[j])
                if not v and organisation and j == len(name) - 1 and _abbreviates(w, name[j]):
                    v = 0.97
                if v > best:
                    best, at = v, j
            if at < 0:
                break
            left.remove(at)
            score.append(best)
        else:
            if not left:
                return 3, sum(score) / len(score)
            if organisation and 0 not in left:
                return (2 if len(spelling) > 1 else 1), sum(score) / len(score)
            return None
        full = "".join(name)
        if len(run) >= 8 and edits(run, full) <= 1 + (len(full) >= 16):
            return 3, 0.84
        return None

    surname, givens = name[-1], name[:-1]
    # which word of the spelling is the surname: the best one, the last of equals
    best_s, at_s = 0.0, -1
    for i, w in enumerate(spelling):
        v = _near(w, surname)
        if v < 1 and w in given:
            v = 0.0
        if v and v >= best_s:
            best_s, at_s = v, i
    rest = [w for i, w in enumerate(spelling) if i != at_s]

    def as_given(w: str, g: str) -> float:
        if w == g:
            return 1.0
        if w in short.get(g, ()):
            return 0.97
        if len(w) == 1:
            return 0.8 if w == g[0] else 0.75 if any(w == s[0] for s in short.get(g, ())) else 0.0
        if w in given:
            return 0.0
        v = _near(w, g)
        return max([v, *(0.95 * _near(w, s) for s in short.get(g, ()))])

    if at_s >= 0 and not rest:
        return 1, best_s
    # a known given name that is not this one's belongs to somebody else
    if any(w in given and not any(as_given(w, g) for g in givens) for w in rest[:1]):
        return None
    if at_s < 0:
        if len(rest) == 1 and len(rest[0]) > 1:
            v = as_given(rest[0], givens[0])
            if v:
                return 1, v
        for g in (givens[0], *short.get(givens[0], ())):
            for whole in {f"{g}{surname}", f"{surname}{g}", "".join(givens) + surname}:
                if len(run) >= 8 and edits(run, whole) <= 1 + (len(whole) >= 14):
                    return 3, 0.84
        return None
    score = [best_s]
    first = as_given(rest[0], givens[0])
    if not first:
        for whole in {f"{givens[0]}{surname}", f"{surname}{givens[0]}"}:
            if edits(run, whole) <= 1 + (len(whole) >= 14):
                return 3, 0.84
        return None
    score.append(first)
    more, extra = list(givens[1:]), 0
    for w in rest[1:]:
        got = [(as_given(w, g), k) for k, g in enumerate(more)]
        v, k = max(got, default=(0.0, 0))
        if v:
            score.append(v)
            more.pop(k)
        else:
            extra += 1
    if extra > (0 if more and len(givens) > 1 else 1):
        return None
    mean = sum(score) / len(score) - 0.05 * extra - 0.01 * len(more)
    return (3 if len(rest[0]) > 1 else 2), mean


# --- candidates -----------------------------------------------------------


def bands_for(similarity: float, recall: float, rows: int = 2) -> int:
    """The least number of bands of so many rows at which a pair of this Jaccard similarity meets with this probability."""
    n = 1
    while 1 - (1 - similarity**rows) ** n < recall:
        n += 1
    return n


#: One edit in a word of five letters leaves 4 of 8 padded bigrams: a similarity of 0.5.
ROWS = 2
BANDS = bands_for(0.5, 0.995, ROWS)
#: The bands meet in so many rounds one after the other, and only the rows of one round lie in a shuffle.
ROUNDS = 3
_P = np.uint64((1 << 61) - 1)
_RNG = np.random.default_rng(20_240_501)
_A = _RNG.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint64)
_B = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint64)


#: Letters of words whose hashes are held at once.
_LETTERS = 1 << 16


def band_hashes(units: list[str], lo: int = 0, hi: int = BANDS) -> np.ndarray:
    """The hashes of bands lo to hi of each word's padded bigrams, a row for each word."""
    a, b = _A[lo * ROWS : hi * ROWS], _B[lo * ROWS : hi * ROWS]
    size = np.array([len(u) + 2 for u in units], dtype=np.int64)
    out, at = [np.zeros((0, hi - lo), dtype=np.int64)], 0
    upto = np.cumsum(size)
    while at < len(units):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _LETTERS, "right")))
        c = np.frombuffer("".join(f"#{u}$" for u in units[at:to]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        grams = (c[:-1] * np.uint64(65_599) + c[1:]) % np.uint64(2_147_483_647)
        ends = np.cumsum(size[at:to])
        grams = np.delete(grams, ends[:-1] - 1)  # of two words
        first = ends - size[at:to] - np.arange(to - at)
        h = np.minimum.reduceat((grams[:, None] * a + b) % _P, first, axis=0).reshape(-1, hi - lo, ROWS)
        x = (h[:, :, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[:, :, 1] * np.uint64(0xC2B2AE3D27D4EB4F))
        out.append((x ^ (np.arange(lo, hi, dtype=np.uint64) << np.uint64(57))).view(np.int64))
        at = to
    return np.concatenate(out)


def letter_sets(units: list[str]) -> np.ndarray:
    """The letters of each word as bits; letters may share a bit, so no letter shows as a change that is none."""
    size = np.array([len(u) + 1 for u in units], dtype=np.int64)
    c = np.frombuffer("".join(f"{u}#" for u in units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bit = np.left_shift(np.int32(1), (c % 31).astype(np.int32), dtype=np.int32)
    return np.bitwise_or.reduceat(bit, np.cumsum(size) - size) if len(units) else bit


def bands(unit: str) -> tuple[int, ...]:
    """The band hashes of one word."""
    return tuple(band_hashes([unit])[0].tolist())


def units(words: list[str], names: bool, short: dict[str, set[str]] | None = None, organisation: bool = False) -> set[str]:
    """What of a name is cut into q-grams. The last word of an organisation, which many share, is none by itself."""
    if not words:
        return set()
    if len(words) == 1:
        return {words[0]} | ({s for s in (short or {}).get(words[0], ())})
    body = words[:-1] if organisation else words
    out = {w for w in body if len(w) > 1}
    out.add("".join(words))
    if names:
        if organisation:
            out.add("".join(w[0] for w in words) + ".")
        else:
            for g in (words[0], *(short or {}).get(words[0], ())):
                out |= {f"{g}{words[-1]}", f"{words[-1]}{g}", g}
    return out


def _meet(a: DataFrame, b: DataFrame, on: list[str] | Column, how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the input, by sorting. Spark takes the size of their files for that of the rows that
    an explode or an Arrow function makes of them, and would send all of these through the driver."""
    return a.join(b.hint("merge"), on, how)


def _cut(rows: DataFrame, side: str) -> DataFrame:
    """rows: work_id, id, words, short, organisation. (work_id, id, unit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for n, (words, short, org) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))):
                got = units(words, side == "name", {k: set(v) for k, v in (short or [])}, org or False)
                at += [n] * len(got)
                out += got
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(out, pa.string())], names=["work_id", "id", "unit"])

    return rows.select("work_id", "id", "words", "short", "organisation").mapInArrow(run, "work_id string, id string, unit string")


def _banded(rows: DataFrame, unit: str, keep: list[str], lo: int, hi: int) -> DataFrame:
    """rows: work_id, unit, distinct. band (a number that tells the band's hash and the work), the columns to keep and letters_<unit>, a row for each band from lo to hi."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1).to_pylist()
            key = band_hashes(words, lo, hi) ^ batch.column(0).to_numpy()[:, None]
            take = pa.array(np.repeat(np.arange(len(key)), hi - lo))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *(batch.column(k).take(take) for k in keep), pa.array(letter_sets(words)).take(take)], names=["band", *keep, f"letters_{unit}"])

    return rows.select(F.xxhash64("work_id").alias("w_"), unit, *[k for k in keep if k != unit]).mapInArrow(run, "band bigint, " + ", ".join(f"{k} string" for k in keep) + f", letters_{unit} int")


def _edited(u: Column, v: Column, changed: Column) -> Column:
    """Whether words may be as near as `edits` must find them: 1 edit in words of less than 8 letters, else 2.

    changed: the number of letters that only one of the two words has, at most; an edit changes two. A swap of neighbours is two
    of Levenshtein's edits and changes none.
    """
    within = lambda n: F.levenshtein(u, v, n) >= 0
    one = F.when(changed == 0, within(2)).when(changed <= 2, within(1)).otherwise(False)
    two = F.when(changed == 0, within(4)).when(changed <= 2, within(3)).when(changed <= 4, within(2)).otherwise(False)
    return (F.abs(F.length(u) - F.length(v)) <= 2) & F.when(F.greatest(F.length(u), F.length(v)) < 8, one).otherwise(two)


def fits(spellings: DataFrame, names: DataFrame) -> DataFrame:
    """work_id, spelling, owner, level, score of all pairs of one work that meet in a band and fit.

    spellings: work_id, id, words, given. names: work_id, id, owner, words,
    short, organisation. The best name of an owner counts.
    """
    none = F.lit(None).cast("map<string,array<string>>")
    s = written(_cut(spellings.withColumn("short", none).withColumn("organisation", F.lit(False)), "spelling"), "units")
    n = written(_cut(names, "name"), "units")
    # pairs of words before pairs of names: a word is compared once, however many names have it
    u, v = F.col("u"), F.col("v")
    su, nu = written(s.select("work_id", F.col("unit").alias("u")).distinct(), "words"), written(n.select("work_id", F.col("unit").alias("v")).distinct(), "words")
    rounds = []
    for k in range(ROUNDS):
        lo, hi = (BANDS * x // ROUNDS for x in (k, k + 1))
        # should two works share a number, then v is not in the work of u, and the pair is lost below
        met = _meet(_banded(su, "u", ["u", "work_id"], lo, hi), _banded(nu, "v", ["v"], lo, hi), ["band"])
        near = met.where((u != v) & _edited(u, v, F.bit_count(F.col("letters_u").bitwiseXOR(F.col("letters_v")))))
        rounds.append(written(near.select("work_id", "u", "v").distinct(), "round"))
    near = reduce(DataFrame.unionByName, rounds).distinct()
    # equal words share all bands: one row in place of as many
    near = written(near.unionByName(_meet(su, nu.withColumn("u", F.col("v")), ["work_id", "u"]).select("work_id", "u", "v")), "near")
    met = _meet(s.select("work_id", F.col("id").alias("spelling"), F.col("unit").alias("u")), near, ["work_id", "u"]).select("work_id", "spelling", "v")
    met = _meet(met, n.select("work_id", F.col("id").alias("name"), F.col("unit").alias("v")), ["work_id", "v"]).select("work_id", "spelling", "name").distinct()
    met = written(met, "met")
    for x in (s, n, su, nu, *rounds, near):
        discard(x)
    pairs = _meet(met, spellings.select("work_id", F.col("id").alias("spelling"), "words", "given"), ["work_id", "spelling"])
    pairs = _meet(pairs, names.select("work_id", F.col("id").alias("name"), "owner", F.col("words").alias("name_words"), "short", "organisation"), ["work_id", "name"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, level, score = [], [], []
            # rows come by names: what is told of a name is made once
            work, name = (batch.column(c).dictionary_encode() for c in (0, 5))
            code = work.indices.to_numpy() * np.int64(len(name.dictionary)) + name.indices.to_numpy()
            _, first, code = np.unique(code, return_index=True, return_inverse=True)
            told = [(n, bool(org), {a: set(b) for a, b in (short or [])}) for n, short, org in zip(*(batch.column(c).take(pa.array(first)).to_pylist() for c in (6, 7, 8)))]
            for k, (w, given, c) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), code.tolist())):
                f = fit(w, *told[c], set(given or ()))
                if f:
                    keep.append(k)
                    level.append(f[0])
                    score.append(f[1])
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), pa.array(level, pa.int32()), pa.array(score, pa.float64())], names=["work_id", "spelling", "owner", "level", "score"])

    got = pairs.select("work_id", "spelling", "owner", "words", "given", "name", "name_words", "short", "organisation").mapInArrow(run, "work_id string, spelling string, owner string, level int, score double")
    got = got.groupBy("work_id", "spelling", "owner").agg(F.max(F.struct("level", "score")).alias("x")).select("work_id", "spelling", "owner", "x.level", "x.score")
    out = written(got, "fits")
    discard(met)
    return out


# --- the operator ---------------------------------------------------------


def _parsed(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Adds words, the words of the name in df[text]."""
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [words_of(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(w, pa.list_(pa.string()))], names=[*keep, "words"])

    return df.select(*keep, text).mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keep) + ", words array<string>")


def _short_forms(given: DataFrame) -> DataFrame:
    """g, short (array): from pairs (g, s)."""
    return given.where("g <> s").groupBy("g").agg(F.collect_set("s").alias("short"))


def link_mentions(mentions: DataFrame, registry: DataFrame, short_forms: DataFrame, tie: float = 0.045) -> DataFrame:
    """mention_id, entity_ref of each mention that means a registered entity of its work.

    mentions: mention_id, work_id, mention_text, entity_id (may be null; only
    teaches short forms). registry: entity_ref, work_id, display_label, aliases,
    organisation. short_forms: given_name, short_form. Null and blank texts,
    words that are no names and rows without a work are never linked, repeated
    rows count once, empty tables link nothing, extra columns are ignored. A
    mention whose level is the same for two entities, or for an entity and
    somebody else named in the work, with scores no further apart than `tie`, is
    not linked.
    """
    m = mentions.select(F.col("mention_id").cast("string").alias("mention_id"), "work_id", "mention_text", F.col("entity_id").cast("string").alias("entity_id")).where("work_id is not null and mention_text is not null").distinct()
    # every distinct text is parsed once
    texts = _parsed(m.groupBy("work_id", "mention_text").agg(F.count("*").alias("n")), "mention_text", ["work_id", "n", "mention_text"])
    texts = written(texts.where("size(words) > 0").withColumn("id", F.concat_ws(" ", "words")), "texts")

    r = registry.where("work_id is not null").select("entity_ref", "work_id", "display_label", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("organisation", F.lit(False)).alias("organisation")).distinct()
    called = r.select("entity_ref", "work_id", "organisation", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("main"), F.col("display_label").alias("text"))), F.transform("aliases", lambda a: F.struct(F.lit(False).alias("main"), a.alias("text"))))).alias("x"))
    called = _parsed(called.select("entity_ref", "work_id", "organisation", "x.main", "x.text").where("text is not null"), "text", ["entity_ref", "work_id", "organisation", "main"])
    called = written(called.where("size(words) > 0").distinct(), "called")
    main = called.where("main").select("entity_ref", "work_id", "organisation", "words")
    persons = main.where("not organisation and size(words) > 1").select("entity_ref", "work_id", F.element_at("words", 1).alias("g"), F.element_at("words", -1).alias("surname"))

    # short forms: the table, aliases, told mentions, and what recurs over works
    alone = lambda df: df.where("size(words) = 2 and length(words[0]) > 1")
    table = _parsed(short_forms.select(F.col("given_name").alias("x"), "short_form"), "x", ["short_form"]).select(F.get("words", 0).alias("g"), "short_form").where("g is not null")
    table = _parsed(table, "short_form", ["g"]).select("g", F.get("words", 0).alias("s")).where("s is not null")
    told = _meet(alone(called.where("not main and not organisation")), persons, ["entity_ref", "work_id"]).where("words[1] = surname").select("g", F.col("words")[0].alias("s"))
    by_id = _meet(m.where("entity_id is not null"), texts, ["work_id", "mention_text"])
    taught = _meet(alone(by_id), persons, (F.col("entity_id") == F.col("entity_ref")) & (by_id["work_id"] == persons["work_id"])).where("words[1] = surname").select("g", F.col("words")[0].alias("s"))
    lexicon = written(persons.select("g").unionByName(table.select("g")).distinct(), "givens")
    beside = (
        _meet(alone(texts), persons.groupBy("work_id", "surname").agg(F.min("g").alias("g"), F.max("g").alias("g2")).where("g = g2"), ["work_id"])
        .where("words[1] = surname").select("work_id", "surname", "g", F.col("words")[0].alias("s")).where("g <> s").distinct()
        .join(lexicon.select(F.col("g").alias("s")), "s", "left_anti")
    )
    pair = beside.groupBy("g", "s").agg(F.count("*").alias("n"))
    learned = pair.join(pair.groupBy("s").agg(F.sum("n").alias("all")), "s").where("n >= 3 and n >= 0.6 * all").select("g", "s")
    # only short forms that are nobody's full given name, unless the table has them
    fresh = told.unionByName(taught).join(lexicon.select(F.col("g").alias("s")), "s", "left_anti").select("g", "s").unionByName(learned)
    forms = written(table.unionByName(fresh).where("length(s) > 1").distinct(), "short")
    short = _short_forms(forms)

    def with_short(df: DataFrame) -> DataFrame:
        x = df.withColumn("g", F.explode("words")).join(short, "g", "left")
        keys = [c for c in df.columns]
        return x.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.when(F.col("short").isNotNull(), F.struct("g", "short")))).alias("short"))

    # names: the label, and aliases that are not its forms (epithets)
    label = main.select(F.col("entity_ref").alias("e"), F.col("work_id").alias("w"), F.element_at("words", -1).alias("end_"), F.element_at("words", 1).alias("start_"))
    epithet = _meet(called.where("not main"), label, (F.col("entity_ref") == F.col("e")) & (F.col("work_id") == F.col("w")))
    epithet = epithet.where(~F.arrays_overlap("words", F.array("end_", "start_")) & (F.size("words") > 1)).select("entity_ref", "work_id", "words")
    names = with_short(main.select("work_id", F.col("entity_ref").alias("owner"), "words", "organisation")).unionByName(
        epithet.select("work_id", F.col("entity_ref").alias("owner"), "words", F.lit(True).alias("organisation"), F.lit(None).cast("map<string,array<string>>").alias("short"))
    )
    longer = _meet(called.where("not main and not organisation and size(words) > 2"), persons, ["entity_ref", "work_id"]).where("element_at(words, -1) = surname and words[0] = g").select("work_id", F.col("entity_ref").alias("owner"), "words", F.lit(False).alias("organisation"))
    names = names.unionByName(with_short(longer)).withColumn("id", F.concat_ws(" ", "owner", F.concat_ws(" ", "words")))
    names = written(names.dropDuplicates(["work_id", "id"]), "names")

    spell = texts.groupBy("work_id", "id").agg(F.first("words").alias("words"), F.sum("n").alias("n"))
    tokens = spell.select("work_id", "id", F.explode("words").alias("g")).join(lexicon.unionByName(forms.select(F.col("s").alias("g"))).distinct(), "g").groupBy("work_id", "id").agg(F.collect_set("g").alias("given"))
    spell = written(_meet(spell, tokens, ["work_id", "id"], "left"), "spellings")
    first = fits(spell, names)

    # others in the work: full names that mean nobody registered
    best = first.groupBy("work_id", F.col("spelling").alias("id")).agg(F.max("level").alias("level"))
    full = spell.where("size(words) > 1 and forall(words, w -> length(w) > 1)")
    full = _meet(full, best.where("level >= 2"), ["work_id", "id"], "left_anti")
    # what organisations are called by: last words that the names of several registered ones share
    kinds = main.where("organisation and size(words) > 1").groupBy(F.element_at("words", -1).alias("end_")).agg(F.min("words").alias("x"), F.max("words").alias("y")).where("x <> y").select("end_", F.lit(True).alias("organisation"))
    full = full.where("not exists(words, w -> w rlike '[0-9]')").withColumn("end_", F.element_at("words", -1)).join(kinds, "end_", "left")
    full = full.select("work_id", "id", "words", F.coalesce("organisation", F.lit(False)).alias("organisation"), "n", "given")
    # a name of a person has a known given name in front; other capitalised words are no persons
    full = full.where(F.col("organisation") | F.arrays_overlap(F.coalesce("given", F.array().cast("array<string>")), F.slice("words", 1, 1)))
    others = with_short(full.select("work_id", F.col("id").alias("owner"), "words", "organisation")).withColumn("id", F.concat(F.lit("other "), F.col("owner"))).withColumn("owner", F.concat(F.lit("other "), F.col("owner")))
    others = written(others, "others")
    second = fits(_meet(spell, best.select("work_id", "id"), ["work_id", "id"], "left_semi"), others)

    # the best two of a spelling are enough to tell a tie
    order = Window.partitionBy("work_id", "spelling").orderBy(F.desc("level"), F.desc("score"), F.desc("owner"))
    top = first.unionByName(second).withColumn("place", F.row_number().over(order)).where("place <= 2")
    at = lambda n: F.max(F.when(F.col("place") == n, F.struct("level", "score", "owner")))
    star = top.groupBy("work_id", "spelling").agg(at(1).alias("best"), at(2).alias("next"))
    star = star.where(F.col("next").isNull() | (F.col("next.level") < F.col("best.level")) | (F.col("best.score") - F.col("next.score") > tie))
    star = star.where("not startswith(best.owner, 'other ')").select("work_id", F.col("spelling").alias("id"), F.col("best.owner").alias("entity_ref"))
    linked = _meet(texts.select("work_id", "mention_text", "id"), star, ["work_id", "id"])
    return _meet(m.select("mention_id", "work_id", "mention_text").distinct(), linked, ["work_id", "mention_text"]).select("mention_id", "entity_ref").distinct()
