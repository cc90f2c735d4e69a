"""Scalar text functions as column expressions; Arrow functions only where Spark has none."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of all scripts, as a class both regex dialects read alike.
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: What opens a chapter, marks dialogue, is a run of capitalised words.
CHAPTER = r"^[ \t]*[Cc][Hh][Aa][Pp][Tt][Ee][Rr][ \t]+[0-9IVXLCDMivxlcdm]+\b"
QUOTE = "\"[^\"]*\"|“[^”]*”|'[^']*'|‘[^’]*’"
DASH = rf"^{WS}*[—–-]{WS}"
RUN = rf"[A-Z][a-z]+(?:{WS}+[A-Z][a-z]+)*"
#: A run between word borders; letters and digits of all scripts are of a word.
CAPS = rf"(?<![\p{{L}}\p{{N}}_]){RUN}(?![\p{{L}}\p{{N}}_])"
QUOTE_MARKS = "\"'“”‘’ "


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def _kept(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def paragraphs(c: Column) -> Column:
    """Blocks between blank lines, stripped, none empty."""
    return _kept(F.split(c, rf"\n{WS}*\n"))


def sentences(c: Column) -> Column:
    """Pieces after . ! ? with white space and at line feeds; the text itself if none is left."""
    got = _kept(F.split(F.regexp_replace(c, rf"([.!?]){WS}+", "$1\n"), "\n"))
    return F.when(F.size(got) > 0, got).otherwise(F.array(c))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[A-Za-z0-9']+"), 0)


def is_dialogue(c: Column) -> Column:
    return c.rlike(DASH) | c.rlike(QUOTE)


def candidate_speaker(c: Column) -> Column:
    """The last capitalised word before the first quotation."""
    quotes = F.filter(F.transform(F.regexp_extract_all(c, F.lit(QUOTE), 0), lambda q: F.btrim(q, F.lit(QUOTE_MARKS))), lambda q: q != "")
    first = F.get(quotes, F.lit(0))
    before = F.substring(c, 1, 1_000_000_000).substr(F.lit(1), F.greatest(F.lit(0), F.instr(c, first) - 1))
    words = F.filter(F.split(F.regexp_replace(before, "[^A-Za-z' ]+", " "), " +"), lambda w: w.rlike("^[A-Z]"))
    return F.when(F.size(quotes) > 0, F.try_element_at(words, F.lit(-1)))


def occurrences(text: Column, part: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-case text with two blanks before and one after."""
    s = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: s.substr(i, F.lit(3))))


def soundex(c: Column) -> Column:
    """First letter and up to three codes; equal codes collapse also over vowels, and the first letter's own code stays.

    Taken from the transliteration key of the name. Fewer than two ASCII letters
    in it: eight digits of its SHA-256.
    """
    key = transliteration_key(c)
    w = F.regexp_replace(key, "[^a-z]", "")
    codes = F.translate(w.substr(F.lit(2), F.length(w)), "bfpvcgjkqsxzdtlmnraeiouhwy", "111122222222334556")
    for d in "123456":
        codes = F.regexp_replace(codes, f"{d}+", d)
    return F.when(F.length(w) < 2, F.substring(F.sha2(key, 256), 1, 8)).otherwise(F.rpad(F.substring(F.concat(F.substring(w, 1, 1), codes), 1, 4), 4, "0"))


def minhash(tokens: Column, n: int = 64, seed: int = 42) -> Column:
    """The least of the first 16 hex digits of SHA-256(seed, number, token), for each number; zeros for no tokens."""
    one = lambda b: F.array_min(F.transform(tokens, lambda t: F.substring(F.sha2(F.concat(F.lit(f"{seed}\x1f"), b.cast("string"), F.lit("\x1f"), t), 256), 1, 16)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.coalesce(one(b), F.lit("0" * 16)))


def bands(signature: Column, rows: int = 4, n: int = 64) -> Column:
    """Band keys of a signature, the last band as short as it comes."""
    return F.array(*[F.concat(F.lit(f"{i}:"), F.array_join(F.slice(signature, i * rows + 1, rows), "|")) for i in range(-(-n // rows))])


def _normal(s: str | None) -> str | None:
    return None if s is None else " ".join(unicodedata.normalize("NFKC", s.strip()).casefold().split())


def _transliterated(s: str | None) -> str | None:
    if s is None:
        return None
    d = unicodedata.normalize("NFD", s.casefold())
    return _normal("".join(c for c in d if not unicodedata.combining(c) or c in "゙゚"))


@F.pandas_udf(T.StringType())
def normalize_name(s: pd.Series) -> pd.Series:
    """NFKC, case folded, single blanks."""
    return s.map(_normal)


@F.pandas_udf(T.StringType())
def transliteration_key(s: pd.Series) -> pd.Series:
    """The normal form without combining marks, but for the Japanese voicing marks."""
    return s.map(_transliterated)


def _embedded(text: str | None, dim: int = 64) -> list[float]:
    v = [0.0] * dim
    for t in re.findall(r"[a-zA-Z0-9']+", (text or "").lower()):
        h = hashlib.blake2b(t.encode(), digest_size=8).digest()
        v[int.from_bytes(h[:4], "big") % dim] += 1.0 if h[4] & 1 else -1.0
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else v


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def embed_text(s: pd.Series) -> pd.Series:
    """A hashed bag of words of unit length in 64 dimensions."""
    return s.map(_embedded)


def _word_set(text: str | None) -> set[str]:
    return {_normal(t) for t in re.split(r"\W+", _normal(text) or "") if t}


@F.pandas_udf(T.ArrayType(T.StringType()))
def words(s: pd.Series) -> pd.Series:
    """The distinct words of the normal form of a text, in any script; none for null."""
    return s.map(lambda t: sorted(_word_set(t)))


@lru_cache(maxsize=50_000)
def _hashed(token: str, n: int = 64, seed: int = 42) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.sha256(f"{seed}\x1f{b}\x1f{token}".encode()).digest()[:8] for b in range(n)), ">u8").astype("u8")


def _signed(words: set[str], n: int = 64) -> np.ndarray:
    sig, some = np.zeros(n, "u8"), list(words)
    for i in range(0, len(some), 4096):
        part = np.minimum.reduce([_hashed(t, n) for t in some[i : i + 4096]])
        sig = np.minimum(sig, part) if i else part
    return sig


def _hex(sig: np.ndarray) -> list[str]:
    h = sig.astype(">u8").tobytes().hex()
    return [h[i : i + 16] for i in range(0, len(h), 16)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def signature(s: pd.Series) -> pd.Series:
    """minhash() with 64 hashes of the words of a text, each word hashed once a worker and not once a text."""
    return s.map(lambda t: _hex(_signed(_word_set(t))))


def _profile(text: str | None) -> tuple:
    some = _word_set(text)
    if not some:
        return None, [], [], [0] * 4
    first, flips = sorted(int(_hashed(t)[0]) for t in some), [0] * 4
    for h in first:
        flips[h >> 6 & 3] ^= 1 << (h & 63)
    signed = lambda x: [i - 2**64 if i >= 2**63 else i for i in x]
    return hashlib.sha256("\x1f".join(sorted(some)).encode()).hexdigest(), _hex(_signed(some)), signed(first), signed(flips)


@F.pandas_udf(T.StructType().add("words", T.StringType()).add("sig", T.ArrayType(T.StringType())).add("tokens", T.ArrayType(T.LongType())).add("parity", T.ArrayType(T.LongType())))
def profile(s: pd.Series) -> pd.DataFrame:
    """Of the word set of a text: a 256-bit hash (null for none), signature, 64-bit hashes, and the parity of their number in 256 buckets."""
    return pd.DataFrame([_profile(t) for t in s], columns=["words", "sig", "tokens", "parity"])
