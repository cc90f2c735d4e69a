"""Continuous text from scanned pages.

1. Each line becomes a symbol of layout features: its place among the page's
   lines, whether it is a page number or carries one, how often the book has it
   at the edge of a page and inside, its case, how it ends, its indent, its
   length. How often a line recurs is counted over the whole book, with misread
   and dropped letters allowed for.
2. A hidden Markov model labels the lines as header, heading, break (a line that
   opens a paragraph), body (one that goes on with it) or footer. Its
   probabilities are counted over the lines of all pages whose label is plain
   (seeds), with the added counts of `_PRIOR`. The lines of many pages are
   labelled at once.
3. Words broken at line ends are joined, over pages and plates too; the hyphen
   stays if the corpus writes the word with one.
4. A word that is rare in the corpus is misread if it differs in one place from
   a word that is many times more frequent. Rare and frequent words meet in a
   join on the word with a gap; no word is compared with all others.
5. Paragraphs are put together over lines and pages.

Books are never gathered: what a page needs from its book comes through
aggregates and joins, and from the page before through windows over stretches
of `STRETCH` pages.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import discard, written

STATES = ("header", "heading", "break", "body", "footer")
#: The lines of the book's own running text.
TEXT = ("break", "body")
HYPHENS = "-‐‑­¬"
STRETCH = 4096
#: A word seen n times is misread if another is seen RATIO * n - SLACK times.
RATIO, SLACK = 20, 15

_NUM = r"(?:\d{1,5}|[ivxlcdm]{1,7})"
_ONLY_NUMBER = regex.compile(rf"^[\W_]*(?:p(?:age|\.)?\s*)?[\divxlcdm|!oOsSIlL]{{1,7}}(?:\s*(?:of|/)\s*[\divxlcdmoOsSIl|!]{{1,6}})?[\W_]*$", re.I)
_PAGE_OF = regex.compile(r"^[\W_]*(?=.{0,2}[page])\S{3,5}\s*[\divxlcdm]{1,7}\s*\S{1,2}\s*[\divxlcdmo]{1,6}[\W_]*$", re.I)
_SPACED = regex.compile(r"(?<=\S) (?=\S)")
_WITH_NUMBER = regex.compile(rf"^\s*{_NUM}(?:\s{{2,}}|\s+[.·|•–—-]\s+)(?=\S)|(?<=\S)(?:\s{{2,}}|\s+[.·|•–—-]\s+){_NUM}\s*$|(?<=\S)\s+\d{{1,5}}\s*$")
_HEADING = regex.compile(r"^\s*(?:(?:chapter|part|book|section)\s+(?:\d+|[ivxlcdm]+)\b|\d{1,3}\.\s+\p{Lu}[\p{L}\p{M}'’ -]{2,60}$)", re.I)
_TITLED = regex.compile(r"^\s*(?:chapter|part|book|section)\s+(?:\d+|[ivxlcdm]+)\s*[:.\-–—]?\s*|^\s*\d{1,3}\.\s+", re.I)
_EDGE = 2  # lines at the top, and one more at the bottom


def _letters(s: str) -> str:
    return "".join(c for c in s.casefold() if c.isalpha())


def close_up(line: str) -> str:
    """A line set with a space between all its letters, without these.

    What would make a word of more than 60 letters is no spaced line but a row of single letters.
    """
    parts = line.split()
    if len(parts) > 3 and sum(len(x) == 1 for x in parts) >= 0.8 * len(parts):
        lead = len(line) - len(line.lstrip())
        closed = regex.sub(r" {2,}", lambda m: " " * max(1, len(m[0]) - 2), _SPACED.sub("", line[lead:]))
        if max(map(len, closed.split())) <= 60:
            return line[:lead] + closed
    return line


def signature(line: str) -> tuple[str, str]:
    """What a running line has in common from page to page, and 'U' if in capitals, else 'l'."""
    bare = _WITH_NUMBER.sub("", close_up(line))
    up = sum(c.isupper() for c in bare)
    low = sum(c.islower() for c in bare)
    return _letters(bare), "U" if up > 2 * low else "l"


def is_number(line: str) -> bool:
    s = close_up(line).strip()
    if not s:
        return False
    if all(c in "-–—. " for c in s):
        return True  # dashes around a number that is gone
    return bool(_ONLY_NUMBER.match(s) or _PAGE_OF.match(s))


def _places(lines: list[str]) -> list[tuple[int, int, int]]:
    """(line number, place from the top, place from the bottom) of lines with text."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    return [(i, k, len(full) - 1 - k) for k, i in enumerate(full)]


def layout(lines: list[str]) -> list[tuple[int, str, str | None, str, str]]:
    """Of each line with text: its number, its symbol, and what `_recurrence` counts (text, case, place; text null for none).

    In the symbol 'r?' stands where the recurrence is filled in (`_with_recurrence`).
    Lines inside a page tell by an indent or a blank line whether they open a
    paragraph; the rest is looked at on the lines at the edges.
    """
    width = max((len(x.rstrip()) for x in lines), default=1)
    out = []
    for i, top, bottom in _places(lines):
        x = lines[i]
        s = x.strip()
        inside = top >= _EDGE and bottom > _EDGE
        indented = x[:1].isspace()
        where = "t" if top == 0 else "b" if bottom < _EDGE else "i"
        counts = where != "i" or len(s) <= 0.6 * width
        number = is_number(x) if counts or not inside else False
        sig, case = (None, "l") if not counts or number else signature(x)
        if inside:
            symbol = "i:>" if indented or not lines[i - 1].strip() else "i:-"
        else:
            edge = "t0" if top == 0 else "b0" if bottom == 0 else f"t{top}" if top < _EDGE else f"b{bottom}"
            if number:
                kind = "number"
            elif top == 0 and _HEADING.match(x):
                kind = "chapter"
            else:
                closed = close_up(x)
                bare_ = _WITH_NUMBER.sub("", closed).strip()
                words = [w for w in bare_.split() if any(c.isalpha() for c in w)]
                numbered = bare_ != closed.strip() and len(bare_) < 0.8 * width
                big = signature(x)[1] == "U"
                titled = bool(words) and all(w[:1].isupper() or len(w) < 4 for w in words) and words[0][:1].isupper()
                kind = "r?" + ("n" if numbered else "") + ("s" if closed != x else "U" if big else "T" if titled else "l") + ("." if s[-1] in ".!?\"”'’)" else "") + (">" if indented else "") + ("<" if len(s) < 0.75 * width else "")
                if top == 0:
                    kind += "_" if i + 1 < len(lines) and not lines[i + 1].strip() else ""
            symbol = f"{edge}:{kind}"
        if where == "t" and not number and _HEADING.match(x):
            where = "c"
            sig, case = signature(_TITLED.sub("", x))
        if sig is not None and len(sig) < 3:
            sig = None
        out.append((i, symbol, sig, case, where))
    return out


def seed(symbol: str) -> str | None:
    """The label of a line whose symbol leaves no doubt."""
    edge, kind = symbol.split(":", 1)
    if edge == "i":
        return "break" if kind == ">" else "body"
    if kind == "number":
        return "header" if edge == "t0" else "footer" if edge == "b0" else None
    if kind == "chapter":
        return "heading"
    if kind.startswith("r2"):
        return "header" if edge == "t0" else "footer" if edge in ("b0", "b1") else None
    if edge == "t0" and "U" in kind and "n" not in kind and kind.startswith("r0") and kind.endswith("<_"):
        return "heading"
    if kind.startswith("r0l") and "n" not in kind:
        return "break" if ">" in kind else "body"
    return None


#: Added counts of (state, test of the symbol): what holds for printed pages of
#: any book. They decide only where the seeds have nothing to count.
_PRIOR = (
    ("header", lambda e, k: e == "t0" and ("n" in k or "s" in k or "T" in k) and "." not in k, 3.0),
    ("header", lambda e, k: e == "t0" and (k[:2] in ("r1", "r2") or k == "number"), 4.0),
    ("header", lambda e, k: e[0] == "t" and k == "number", 1.0),
    ("heading", lambda e, k: e == "t0" and (k == "chapter" or ("U" in k and "n" not in k and k[:2] == "r0")), 3.0),
    ("footer", lambda e, k: e[0] == "b" and (k[:2] in ("r1", "r2") or k == "number"), 4.0),
    ("footer", lambda e, k: e == "b0" and "n" in k and "." not in k, 1.0),
    ("body", lambda e, k: k != "number" and k != "chapter" and k[:2] in ("r0", "r3") and ">" not in k, 2.0),
    ("break", lambda e, k: k[:2] in ("r0", "r3") and ">" in k, 2.0),
    ("body", lambda e, k: True, 0.05),
)
_ALLOWED = {
    "": STATES,
    "header": STATES,
    "heading": ("break", "body", "footer"),
    "break": ("break", "body", "footer"),
    "body": ("break", "body", "footer"),
    "footer": ("footer",),
}
#: Lines of pages that are labelled together.
_BLOCK = 1 << 17


class LineModel:
    """Hidden Markov model over the lines of a page."""

    def __init__(self, emissions: dict[tuple[str, str], float], moves: dict[tuple[str, str], float]) -> None:
        self.total = {s: sum(n for (a, _), n in emissions.items() if a == s) + 20.0 for s in STATES}
        self.emissions = emissions
        self.move = {}
        for a, to in _ALLOWED.items():
            n = sum(moves.get((a, b), 0.0) + 1.0 for b in to)
            for b in to:
                self.move[a, b] = math.log((moves.get((a, b), 0.0) + 1.0) / n)
        self._known: dict[tuple[str, str], float] = {}

    def emit(self, state: str, symbol: str) -> float:
        key = (state, symbol)
        if key not in self._known:
            e, k = symbol.split(":", 1)
            prior = sum(n for s, test, n in _PRIOR if s == state and test(e, k))
            # the priors are spread over the symbols they speak of
            self._known[key] = math.log((self.emissions.get(key, 0.0) + prior + 1e-4) / (self.total[state] + 20.0))
        return self._known[key]

    def label(self, symbols: list[str]) -> list[str]:
        return self.label_all([symbols])[0]

    def label_all(self, pages: list[list[str]]) -> list[list[str]]:
        """The best states of the lines of each page."""
        if not hasattr(self, "_moves"):
            self._moves = np.array([[self.move.get((a, b), -np.inf) for b in STATES] for a in STATES])
            self._first = np.array([self.move["", b] for b in STATES])
        out: list[list[str]] = [[] for _ in pages]
        # pages of like length together, so that little is filled up
        order = sorted((n for n, p in enumerate(pages) if p), key=lambda n: len(pages[n]))
        while order:
            longest = len(pages[order[-1]])
            some = order[-max(1, _BLOCK // longest) :]
            del order[-len(some) :]
            for n, states in zip(some, self._paths([pages[n] for n in some])):
                out[n] = states
        return out

    def _paths(self, pages: list[list[str]]) -> list[list[str]]:
        known: dict[str, int] = {}
        x = np.full((len(pages), max(map(len, pages))), -1, dtype=np.int32)
        for n, p in enumerate(pages):
            x[n, : len(p)] = [known.setdefault(s, len(known)) for s in p]
        emit = np.array([[self.emit(b, s) for b in STATES] for s in known])
        best = self._first + emit[x[:, 0]]
        back = np.zeros((x.shape[1], len(pages), len(STATES)), dtype=np.int8)
        for t in range(1, x.shape[1]):
            on = np.flatnonzero(x[:, t] >= 0)
            via = best[on][:, :, None] + self._moves
            back[t, on] = via.argmax(axis=1)
            best[on] = via.max(axis=1) + emit[x[on, t]]
        size = np.array([len(p) for p in pages])
        at, got = best.argmax(axis=1), np.zeros(x.shape, dtype=np.int8)
        rows = np.arange(len(pages))
        for t in range(x.shape[1] - 1, -1, -1):
            got[:, t] = at
            on = np.flatnonzero(size > t)
            if t:
                at[on] = back[t, on, at[on]]
        return [[STATES[k] for k in got[n, : size[n]]] for n in rows]


_LINES = "lines array<struct<line_no:int,symbol:string,sig:string,caps:string,side:string>>"


def _looked_at(pages: DataFrame) -> DataFrame:
    """Adds lines (see `layout`) to page_id, pdf_id, page_index, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes = [], []
            for text in batch.column(3).to_pylist():
                got = layout((text or "").split("\n"))
                rows += got
                sizes.append(len(got))
            cols = list(zip(*rows)) or [(), (), (), (), ()]
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            flat = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["line_no", "symbol", "sig", "caps", "side"])
            lines = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], lines], names=["page_id", "pdf_id", "page_index", "text", "lines"])

    return pages.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, pdf_id string, page_index bigint, text string, {_LINES}")


def _recurrence(pages: DataFrame) -> DataFrame:
    """page_id, recurs: map of line number to 2 (the book has it at the edge of pages again and again), 1 (it is the title
    of one of its chapters) or 3 (it recurs inside pages). pages: page_id, pdf_id, lines."""
    e = pages.select("pdf_id", "page_id", F.explode(F.filter("lines", lambda x: x["sig"].isNotNull())).alias("x")).select("pdf_id", "page_id", "x.line_no", "x.sig", "x.caps", "x.side")
    n = lambda s: F.sum(F.when(F.col("side").isin(*s), 1).otherwise(0))
    counts = e.groupBy("pdf_id", "sig", "caps").agg(n("t").alias("top"), n("b").alias("bottom"), n("i").alias("inside"), n("c").alias("title"))
    known = counts.select(
        "pdf_id", "sig", "caps",
        F.when((F.col("inside") > 0) & (F.col("inside") * 3 >= F.col("top") + F.col("bottom")), 3).when(F.greatest("top", "bottom") >= 2, 2).otherwise(0).alias("r"),
    )
    # a title set in capitals once is a heading, and what others have in small letters at the top is its running form
    titles = counts.where("title > 0 or (caps = 'U' and top = 1 and inside = 0)").select("pdf_id", "sig").distinct()
    forms = known.where("r = 2").select("pdf_id", "sig", "caps", "r").unionByName(titles.withColumn("caps", F.lit("l")).withColumn("r", F.lit(1)))
    ends = lambda c: F.explode(F.array(F.concat(F.lit("<"), F.substring(c, 1, 5)), F.concat(F.lit(">"), F.substring(c, -5, 5))))
    probe = known.where("r = 0").select("pdf_id", "sig", "caps").withColumn("end", ends(F.col("sig")))
    near = (
        probe.alias("a").join(forms.withColumn("end", ends(F.col("sig"))).alias("b"), ["pdf_id", "caps", "end"])
        .where(F.levenshtein(F.col("a.sig"), F.col("b.sig"), 3).between(0, F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.length("b.sig") / 6)))))
        .groupBy("pdf_id", F.col("a.sig").alias("sig"), "caps").agg(F.max("b.r").alias("near"))
    )
    known = known.join(near, ["pdf_id", "sig", "caps"], "left").select("pdf_id", "sig", "caps", F.greatest("r", F.coalesce("near", F.lit(0))).alias("r")).where("r > 0")
    return e.join(known, ["pdf_id", "sig", "caps"]).where("side <> 'c'").groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct("line_no", "r"))).alias("recurs"))


def _with_recurrence(pages: DataFrame) -> DataFrame:
    """symbols of the lines with text, in order, the recurrence filled in. pages: lines, recurs."""
    r = lambda x: F.concat(F.lit("r"), F.coalesce(F.try_element_at("recurs", x["line_no"]), F.lit(0)).cast("string"))
    return pages.withColumn("symbols", F.transform("lines", lambda x: F.replace(x["symbol"], F.lit("r?"), r(x))))


def train(pages: DataFrame) -> LineModel:
    """Counts the model's probabilities over the seeds of all pages (symbols)."""
    x = F.col("symbols")
    pairs = pages.where(F.size(x) > 0).select(F.concat(F.array(F.lit("")), F.slice(x, 1, F.size(x) - 1)).alias("a"), x.alias("b")).select(F.explode(F.arrays_zip("a", "b")).alias("x"))
    # as many rows as there are pairs of symbols, whatever the number of pages
    got = pairs.groupBy("x.a", "x.b").agg(F.count("*").alias("n")).collect()
    emissions: dict[tuple[str, str], float] = {}
    moves: dict[tuple[str, str], float] = {}
    for r in got:
        was, now = (seed(r.a) if r.a else ""), seed(r.b)
        if now:
            emissions[now, r.b] = emissions.get((now, r.b), 0.0) + r.n
            if was is not None:
                moves[was, now] = moves.get((was, now), 0.0) + r.n
    return LineModel(emissions, moves)


_STRIP = ".,;:?\"“”„‘’'()[]{}*…«»—–_"


@lru_cache(maxsize=1 << 18)
def bare(token: str) -> str:
    """Lower case without punctuation around."""
    s = token.casefold().strip(_STRIP)
    t = s.rstrip("!").rstrip(_STRIP)
    return t.lstrip("!") if not any(c.isalpha() for c in t.lstrip("!")) else t


@lru_cache(maxsize=1 << 18)
def _word(token: str) -> str | None:
    """The word of a token, None if it has no letters."""
    w = bare(token)
    return w if any(c.isalpha() for c in w) else None


def page_rows(lines: list[str], states: dict[int, str]) -> dict:
    """What one page gives: furniture, words by line, broken words, its first and last line."""
    body = [i for i in sorted(states) if states[i] in ("body", "break", "heading")]
    out: dict = {"furniture": [i for i in sorted(states) if states[i] in ("header", "footer")], "words": [], "broken": [], "first": None, "last": None}
    carried = False  # the first token of this line ends a broken word
    for k, i in enumerate(body):
        tokens = lines[i].split()
        if k == 0:
            out["first"] = (i, states[i], len(lines[i]) - len(lines[i].lstrip()), tokens[0] if tokens else "", "", i)
        # whether a page's first token is a word of its own shows on the page before
        start, end = 1 if carried or k == 0 else 0, len(tokens)
        carried = False
        last = tokens[-1] if tokens else ""
        if len(last) > 1 and last[-1] in HYPHENS and last[-2].isalpha() and states[i] in TEXT:
            if k + 1 < len(body):
                after = lines[body[k + 1]].split()
                out["broken"].append((i, last, after[0] if after else ""))
                carried = True
            end = max(start, end - 1)
        if k == len(body) - 1:
            out["last"] = (i, states[i], len(lines[i]) - len(lines[i].lstrip()), last, lines[i].rstrip(), i)
        out["words"] += [(i, w) for w in map(_word, tokens[start:end]) if w]
    return out


def _gapped(word: Column) -> Column:
    """The keys under which words that differ in one place meet: the word with one, or two neighbouring, letters left out.

    Long words meet under their first and their last 20 letters, one of which
    they share, so that the keys of a word do not grow with the square of it.
    """
    one = F.transform(F.sequence(F.lit(1), F.length(word)), lambda p: F.concat(F.substring(word, 1, p - 1), F.lit("\u0001"), word.substr(p + 1, F.length(word))))
    two = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word) - 1)), lambda p: F.concat(F.substring(word, 1, p - 1), F.lit("\u0001"), word.substr(p + 2, F.length(word))))
    end = F.array(F.concat(word, F.lit("\u0001")))
    half = F.array(F.concat(F.lit("<"), F.substring(word, 1, 20)), F.concat(F.lit(">"), F.substring(word, -20, 20)))
    long_, short = F.length(word) > 40, F.length(word) <= 42
    return F.when(~short, half).otherwise(F.array_distinct(F.concat(one, two, end, F.when(long_, half).otherwise(F.array().cast("array<string>")))))


def corrections(counts: DataFrame) -> DataFrame:
    """word, right: of each misread word, the word it stands for. counts: word, n.

    The word that is meant differs in one place (one letter for another, two for
    one, one for two, or one missing at the end) and is seen RATIO * n - SLACK times; of several,
    the one nearest in length, then the most frequent, then the first.
    """
    w = counts.where(F.length("word") >= 3)
    top = w.agg(F.max("n")).first()[0] or 0
    # a word that no other is frequent enough for is not misread
    rare = w.where(F.col("n") * RATIO - SLACK <= F.lit(top)).select("word", "n", F.explode(_gapped(F.col("word"))).alias("key"))
    right = w.where((F.col("n") >= RATIO - SLACK) & F.col("word").rlike(r"^[\p{L}\p{M}'’-]+$")).select(F.col("word").alias("right"), F.col("n").alias("m"), F.explode(_gapped(F.col("word"))).alias("key"))
    far = F.abs(F.length("word") - F.length("right"))
    met = rare.join(right, "key").where((F.col("m") >= RATIO * F.col("n") - SLACK) & ((far == 1) & ((F.length("word") <= 40) | F.levenshtein("word", "right", 2).between(1, 2)) | (far == 0) & (F.levenshtein("word", "right", 1) == 1)))
    return met.groupBy("word").agg(F.min(F.struct(far.alias("far"), (-F.col("m")).alias("m"), "right"))["right"].alias("right"))


def _before(ends: DataFrame) -> DataFrame:
    """Adds `prev`, the last line of the last earlier page of the book that has text, and `whole`: no page between is missing.

    Pages are looked at in stretches; what earlier stretches end with, however
    many of them have plates only, comes from one row a stretch. `gaps` numbers
    the runs of pages without a missing one.
    """
    at = Window.partitionBy("pdf_id", "stretch").orderBy("page_index", "page_id")
    df = ends.withColumn("stretch", F.floor(F.col("page_index") / STRETCH))
    df = df.withColumn("gap", F.coalesce((F.col("page_index") - F.lag("page_index").over(at) > 1).cast("int"), F.lit(0)))
    df = df.withColumn("gaps", F.sum("gap").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    mine = F.when(F.col("last").isNotNull(), F.struct("gaps", "page_id", "last"))
    df = df.withColumn("p", F.last(mine, ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, -1)))
    tail = df.groupBy("pdf_id", "stretch").agg(F.min("page_index").alias("from_"), F.max("page_index").alias("to_"), F.max("gaps").alias("gaps_"), F.max_by(mine, F.when(mine.isNotNull(), F.struct("page_index", "page_id"))).alias("p_"))
    book = Window.partitionBy("pdf_id").orderBy("stretch")
    earlier = book.rowsBetween(Window.unboundedPreceding, -1)
    tail = tail.withColumn("jump", F.coalesce((F.col("from_") - F.lag("to_").over(book) > 1).cast("int"), F.lit(0)))
    tail = tail.withColumn("base", F.sum("jump").over(book.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("gaps_").over(earlier), F.lit(0)))
    own = lambda p: F.when(p.isNotNull(), F.struct((F.col("base") + p["gaps"]).alias("gaps"), p["page_id"].alias("page_id"), p["last"].alias("last")))
    tail = tail.withColumn("carry", F.last(own(F.col("p_")), ignorenulls=True).over(earlier)).select("pdf_id", "stretch", "base", "carry")
    df = df.join(tail, ["pdf_id", "stretch"]).withColumn("prev", F.coalesce(own(F.col("p")), F.col("carry")))
    return df.withColumn("whole", F.coalesce(F.col("base") + F.col("gaps") == F.col("prev.gaps"), F.lit(False)))


def _ended(text: Column) -> Column:
    return text.rlike(r"[.!?…][\"”’')]*$")


def _goes_on(prev: Column, first: Column, width: Column, indented: Column, share: float) -> Column:
    """Whether a page's first line continues the paragraph that the last line before ends.

    After a word broken at the end it does; a heading, a line that the model
    takes for a break or a note number begins something new. In a book that indents its paragraphs
    the rest goes on. In one that does not, a line in small letters goes on, and
    so does one that would not have fitted after the last line; a line that
    ended early ended its paragraph. share: of the pages of indented books that
    end with a sentence, how many are followed by the same paragraph; if hardly
    any, the end of a sentence at the end of a page ends the paragraph.
    """
    text, word = prev["text"], first["token"]
    broken = text.rlike(rf"\p{{L}}[{HYPHENS}]$")
    ended = _ended(text)
    small = word.rlike(r"^\p{Ll}")
    fits = F.length(text) + 1 + F.length(word) <= width
    new = (first["state"] == "heading") | (prev["state"] == "heading")
    return (
        F.when(new, False)
        .when(broken | (small & ~ended), True)
        .when(first["state"] == "break", False)
        .when(~ended, True)
        .when(indented, True)
        .when(word.rlike(r"^(?:[\"“]|\d{2,}$|\(\d+\)$|\*$)"), False)
        .otherwise(~fits & F.lit(share > 0.25))
    )


_INFO = "struct<line_no:int,state:string,indent:int,token:string,text:string>"


_FACTS = (
    "page_id %s, pdf_id string, page_index bigint, line_nos array<int>, states array<string>, furniture array<int>, word_lines array<int>, words array<string>, "
    f"broken array<struct<line_no:int,a:string,b:string>>, first {_INFO}, last {_INFO}, sizes array<int>, indents int"
)


def labelled(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the pages, what is on them), one row a page each.

    The pages: page_id, pdf_id, page_index, text. What is on them: the states of
    the lines, furniture, words, words broken inside the page, first and last
    line of the book's text, lengths of its lines and how many are indented.

    pages: page_id, pdf_id, page_index, text. Rows of one page_id count once
    (the largest text stands), null and blank texts have no lines, and pages
    without a book are each a book of their own.
    """
    one = pages.select("page_id", F.coalesce(F.col("pdf_id"), F.concat(F.lit("page:"), F.col("page_id").cast("string"))).alias("pdf_id"), F.coalesce(F.col("page_index"), F.lit(0)).cast("bigint").alias("page_index"), F.regexp_replace("text", "\r\n?", "\n").alias("text"))
    one = one.where("page_id is not null").groupBy("page_id").agg(F.max(F.struct("text", "pdf_id", "page_index")).alias("x")).select("page_id", "x.pdf_id", "x.page_index", "x.text")
    one = written(_looked_at(one), "pages")
    recurs = written(_recurrence(one), "recurs")
    marked = _with_recurrence(one.join(recurs, "page_id", "left"))
    model = train(marked.select("symbols"))

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = pa.struct([("line_no", pa.int32()), ("state", pa.string()), ("indent", pa.int32()), ("token", pa.string()), ("text", pa.string())])
        fields = ("line_no", "state", "indent", "token", "text")
        pair = pa.struct([("line_no", pa.int32()), ("a", pa.string()), ("b", pa.string())])

        def lists(rows: list[list], kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)), pa.array([x for r in rows for x in r], kind))

        for batch in batches:
            nos = batch.column(4).to_pylist()
            states = model.label_all(batch.column(5).to_pylist())
            got, sizes, indents = [], [], []
            for text, at, own in zip(batch.column(3).to_pylist(), nos, states):
                lines = (text or "").split("\n")
                got.append(page_rows(lines, dict(zip(at, own))))
                mine = [lines[i] for i, s in zip(at, own) if s in TEXT]
                sizes.append([len(x.rstrip()) for x in mine])
                indents.append(sum(x[:1].isspace() for x in mine))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3], lists(nos, pa.int32()), lists(states, pa.string()), lists([g["furniture"] for g in got], pa.int32()),
                    lists([[i for i, _ in g["words"]] for g in got], pa.int32()), lists([[w for _, w in g["words"]] for g in got], pa.string()),
                    lists([[{"line_no": i, "a": a, "b": b} for i, a, b in g["broken"]] for g in got], pair),
                    *(pa.array([dict(zip(fields, g[k])) if g[k] else None for g in got], info) for k in ("first", "last")),
                    lists(sizes, pa.int32()), pa.array(indents, pa.int32()),
                ],
                names=["page_id", "pdf_id", "page_index", "line_nos", "states", "furniture", "word_lines", "words", "broken", "first", "last", "sizes", "indents"],
            )

    out = marked.select("page_id", "pdf_id", "page_index", "text", F.transform("lines", lambda x: x["line_no"]).alias("nos"), "symbols").mapInArrow(facts, _FACTS % dict(one.dtypes)["page_id"])
    out = written(out, "facts")
    discard(recurs)
    return one, out


def _styles(facts: DataFrame) -> DataFrame:
    """pdf_id, width of its lines, indented: whether its paragraphs are."""
    share = facts.groupBy("pdf_id").agg((F.sum("indents") / F.sum(F.size("sizes")) > 0.02).alias("indented"))
    width = facts.select("pdf_id", F.explode("sizes").alias("n")).groupBy("pdf_id").agg(F.percentile_approx("n", 0.98).alias("width"))
    return width.join(share, "pdf_id")


def _plain(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), r"^[^\p{L}\p{N}!|]+|[^\p{L}\p{N}]+$", "")


def _analysis(pages: DataFrame) -> dict[str, DataFrame]:
    """The pages (text), their states (facts) and what is found on them: furniture, hyphen, misread, continues, and each book's style."""
    text, facts = labelled(pages)
    styles = written(_styles(facts), "styles")
    furniture = facts.select("page_id", F.explode("furniture").alias("line_no"), F.lit("furniture").alias("line_kind"), F.lit("").alias("word"))

    ends = written(_before(facts.select("page_id", "pdf_id", "page_index", "first", "last")).select("page_id", "pdf_id", "first", "prev", "whole"), "ends")
    split = F.col("whole") & F.col("prev.last.text").rlike(rf"\p{{L}}[{HYPHENS}]$")
    opening = ends.where(F.col("first").isNotNull() & ~F.coalesce(split, F.lit(False))).select("page_id", "first.line_no", _plain(F.col("first.token")).alias("word")).where(r"word rlike '\\p{L}'")
    words = facts.select("page_id", F.explode(F.arrays_zip("word_lines", "words")).alias("w")).select("page_id", F.col("w.word_lines").alias("line_no"), F.col("w.words").alias("word")).unionByName(opening)
    joined = ends.where("prev is not null and first is not null").join(styles, "pdf_id", "left")
    joined = written(joined.select("page_id", "first", "prev", "whole", "width", "indented"), "joined")
    full_stop = joined.where(F.col("whole") & F.col("indented") & _ended(F.col("prev.last.text")) & F.col("first.state").isin(*TEXT) & F.col("prev.last.state").isin(*TEXT))
    share = full_stop.agg(F.avg((F.col("first.indent") == 0).cast("double"))).first()[0]
    goes = F.col("whole") & _goes_on(F.col("prev.last"), F.col("first"), F.col("width"), F.coalesce("indented", F.lit(False)), 0.5 if share is None else share)
    goes_on = joined.where(goes).select("page_id", F.col("first.line_no").alias("line_no"), F.lit("continues").alias("line_kind"), F.lit("").alias("word"))

    inside = facts.select("page_id", F.explode("broken").alias("x")).select("page_id", "x.line_no", "x.a", "x.b")
    over = joined.where(F.col("whole") & F.col("first.state").isin(*TEXT) & F.col("prev.last.text").rlike(rf"\p{{L}}[{HYPHENS}]$")).select(F.col("prev.page_id").alias("page_id"), F.col("prev.last.line_no").alias("line_no"), F.col("prev.last.token").alias("a"), F.col("first.token").alias("b"), F.col("page_id").alias("next_page"))
    broken = inside.withColumn("next_page", F.lit(None).cast(dict(facts.dtypes)["page_id"])).withColumn("over", F.lit(False)).unionByName(over.withColumn("over", F.lit(True))).where("b <> ''")
    head = _plain(F.regexp_replace("a", rf"[{HYPHENS}]+$", ""))
    broken = written(broken.select("page_id", "line_no", "over", "next_page", head.alias("head"), _plain(F.col("b")).alias("rest")).select("page_id", "line_no", "over", "next_page", F.concat("head", "rest").alias("closed"), F.concat("head", F.lit("-"), "rest").alias("open")), "broken")

    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    mended = broken.groupBy("closed").agg(F.count("*").alias("n")).select(F.col("closed").alias("word"), "n")
    both = counts.withColumn("k", F.lit(0)).unionByName(mended.withColumn("k", F.lit(1))).groupBy("word").agg(F.sum(F.when(F.col("k") == 0, F.col("n"))).alias("seen"), F.sum("n").alias("n"))
    both = written(both, "words")
    right = written(corrections(both.select("word", "n")), "right")
    misread = words.join(right, "word").select("page_id", "line_no", "word", "right")

    seen = both.select("word", F.coalesce("seen", F.lit(0)).alias("seen"))
    hyphen = (
        broken.join(seen.select(F.col("word").alias("closed"), F.col("seen").alias("n_closed")), "closed", "left")
        .join(seen.select(F.col("word").alias("open"), F.col("seen").alias("n_open")), "open", "left")
        .join(right.select(F.col("word").alias("closed"), F.col("right").alias("true_closed")), "closed", "left")
        .join(right.select(F.col("word").alias("open"), F.col("right").alias("true_open")), "open", "left")
    )
    with_one = (F.coalesce("n_open", F.lit(0)) > F.coalesce("n_closed", F.lit(0)))
    # over a page break the second half may be missing: the word must be known
    known = F.coalesce("n_open", F.lit(0)) + F.coalesce("n_closed", F.lit(0)) > 0
    hyphen = hyphen.where(~F.col("over") | known | F.col("true_closed").isNotNull() | F.col("true_open").isNotNull())
    hyphen = hyphen.select("page_id", "line_no", "next_page", F.when(with_one, F.coalesce("true_open", "open")).otherwise(F.coalesce("true_closed", "closed")).alias("word"))
    carried = hyphen.where("next_page is not null").select(F.col("next_page").alias("page_id"), F.lit(True).alias("carried")).distinct()
    return {"carried": carried, "text": text, "facts": facts, "styles": styles, "furniture": furniture, "hyphen": hyphen, "misread": misread, "continues": goes_on}


def findings(pages: DataFrame) -> DataFrame:
    """page_id, line_no, line_kind, word: every place where a page's text is not the book's.

    'furniture': a running line or page number. 'hyphen': the line a broken
    word begins on, and the whole word. 'misread': a line with a misread word,
    and the true word. 'continues': the first line of text of a page that goes
    on with the paragraph before. See `labelled` for what rows count.
    """
    a = _analysis(pages)
    hyphen = a["hyphen"].select("page_id", "line_no", F.lit("hyphen").alias("line_kind"), "word")
    misread = a["misread"].select("page_id", "line_no", F.lit("misread").alias("line_kind"), F.col("right").alias("word")).distinct()
    return a["furniture"].unionByName(hyphen).unionByName(misread).unionByName(a["continues"])


def _like(raw: str, word: str) -> str:
    """word in place of the letters of raw: its punctuation stays, and a capital at its start."""
    start = next((i for i, c in enumerate(raw) if c not in _STRIP), 0)
    stop = len(raw) - next((i for i, c in enumerate(reversed(raw)) if c not in _STRIP + "!"), 0)
    if start < len(raw) and raw[start].isupper():
        word = raw[start:stop].isupper() and len(word) > 1 and word.upper() or word[:1].upper() + word[1:]
    return raw[:start] + word + raw[stop:]


def page_pieces(text: str, states: dict[int, str], wrong: list[tuple[int, str, str]], joined: dict[int, str], indented: bool, carried: bool) -> list[tuple[str, str]]:
    """(kind, text) of the paragraphs and headings of a page: furniture gone, words joined and put right.

    carried: the page before has taken over the first word, the rest of one broken there.
    """
    lines = text.split("\n")
    body = [i for i in sorted(states) if states[i] in ("body", "break", "heading")]
    fix = {(i, w): r for i, w, r in wrong}
    out: list[list] = []
    skip = carried
    last_body = None
    for k, i in enumerate(body):
        tokens = lines[i].split()
        if skip and tokens:
            tokens = tokens[1:]
        skip = False
        tokens = [_like(t, fix[i, bare(t)]) if (i, bare(t)) in fix else t for t in tokens]
        if i in joined and tokens and tokens[-1][-1:] in HYPHENS:
            rest = lines[body[k + 1]].split()[0] if k + 1 < len(body) and lines[body[k + 1]].split() else ""
            tail = rest[len(rest.rstrip(_STRIP + "!")) :]
            tokens[-1] = _like(tokens[-1].rstrip(HYPHENS), joined[i]) + tail
            skip = bool(rest)
        blank = last_body is not None and any(not lines[j].strip() for j in range(last_body + 1, i))
        kind = "heading" if states[i] == "heading" else "paragraph"
        new = not out or kind != out[-1][0] or (states[i] == "break" if indented else blank)
        if new:
            out.append([kind, []])
        out[-1][1] += tokens
        last_body = i
    return [(kind, " ".join(t)) for kind, t in out if t]


def paragraphs(pages: DataFrame) -> DataFrame:
    """pdf_id, page_id, piece, kind, text: every paragraph and heading of the books, whole, under the page it starts on.

    A paragraph goes on over pages and plates; its pieces come together by where
    it starts, so that no more than one paragraph is ever in one place.
    """
    from tracewright.operators.asof import last_before

    a = _analysis(pages)
    wrong = a["misread"].groupBy("page_id").agg(F.collect_set(F.struct("line_no", "word", "right")).alias("wrong"))
    join = a["hyphen"].groupBy("page_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("line_no", "word")))).alias("joined"))
    goes = a["continues"].select("page_id", F.lit(True).alias("goes")).join(a["carried"], "page_id", "left")
    df = a["text"].drop("lines").join(a["facts"].select("page_id", F.map_from_arrays("line_nos", "states").alias("kinds")), "page_id").join(wrong, "page_id", "left").join(join, "page_id", "left").join(goes, "page_id", "left").join(a["styles"].select("pdf_id", "indented"), "pdf_id", "left")
    kind = dict(df.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            take: list[int] = []
            for n, (text, kinds, wr, jo, go, ind, ca) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3, 10)))):
                got = page_pieces(text or "", dict(kinds or []), [(x["line_no"], x["word"], x["right"]) for x in wr or []], dict(jo or []), bool(ind), bool(ca))
                for k, (what, t) in enumerate(got):
                    take.append(n)
                    rows.append((k, what, t, bool(go) and k == 0))
            t = pa.array(take, pa.int64())
            col = lambda k, ty: pa.array([r[k] for r in rows], ty)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(t) for c in range(3)), col(0, pa.int32()), col(1, pa.string()), col(2, pa.string()), col(3, pa.bool_())], names=["page_id", "pdf_id", "page_index", "piece", "kind", "text", "goes"])

    p = df.select("page_id", "pdf_id", "page_index", "text", "kinds", "wrong", "joined", "goes", "indented", "carried").mapInArrow(run, f"page_id {kind}, pdf_id string, page_index bigint, piece int, kind string, text string, goes boolean")
    p = written(p.withColumn("at", F.col("page_index") * (1 << 32) + F.col("piece")), "pieces")
    p = last_before(p, ["pdf_id"], "at", F.when(~F.col("goes"), F.col("at")), "opened", STRETCH << 32)
    p = p.withColumn("start", F.when(~F.col("goes"), F.col("at")).otherwise(F.coalesce("opened", "at")))
    whole = p.groupBy("pdf_id", "start").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("x"), F.min_by("page_id", "at").alias("page_id"), F.min_by("piece", "at").alias("piece"), F.min_by("kind", "at").alias("kind"))
    return whole.select("pdf_id", "page_id", "piece", "kind", F.array_join(F.transform("x", lambda v: v["text"]), " ").alias("text"))
