"""Byte-pair encoding of whole columns with a public vocabulary.

The encoder is exact and linear: an Aho-Corasick automaton over all tokens gives
the longest token at every place of a piece, and a candidate is accepted only if
the pair with the token before it is one that merging would leave apart (a
lookup down both tokens' merge trees). If it is not, the next shorter prefix
token is tried, and if none is left the last token is taken back. A bit for each
place makes sure that no dead end is entered twice.

Pieces (words with their leading space, numbers, signs) repeat all over a
corpus, so each Python worker remembers the ids of pieces it has seen; the
memory is emptied when it holds `_CACHE` pieces, which changes no result.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's authors cut a text into pieces.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CACHE = 400_000
_FAR = 1 << 40


class BytePairs:
    """Encoder and decoder of one vocabulary file of ranks (`base64 rank` a line)."""

    def __init__(self, path: str, pieces: str = PIECES) -> None:
        import ahocorasick
        import regex

        self._find = regex.compile(pieces).findall
        ids: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                ids[base64.b64decode(token)] = int(rank)
        self.ids = ids
        self.size = max(ids.values()) + 1
        tokens = [b""] * self.size
        for token, i in ids.items():
            tokens[i] = token
        self.lengths = [len(t) for t in tokens]
        # decoding: one string of bytes and where each token starts in it
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

        self._left, self._right = list(range(self.size)), list(range(self.size))
        self._pairs: dict[tuple[int, int], int] = {}
        self._shorter = [-1] * self.size
        auto = ahocorasick.Automaton()
        for i, token in enumerate(tokens):  # in the order of merging
            if not token:
                continue
            auto.add_word(token.decode("latin-1"), i)
            n = len(token)
            for cut in range(n - 1, 0, -1):
                a = ids.get(token[:cut])
                if a is None:
                    continue
                if self._shorter[i] < 0:
                    self._shorter[i] = a
                b = ids.get(token[cut:])
                if b is not None and a < i and b < i and self._stay_apart(a, b):
                    self._left[i], self._right[i] = a, b
                    self._pairs[a, b] = i
                    break
        auto.make_automaton()
        self._matches = auto.iter
        self._seen: dict[str, list[int]] = {}

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b together ends in just these two."""
        pairs, left, right = self._pairs, self._left, self._right
        limit = _FAR
        while True:
            if pairs.get((a, b), _FAR) < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest = [0] * n
        lengths = self.lengths
        for end, token in self._matches(data.decode("latin-1")):
            # ends grow, so what stays for a start is its longest token
            longest[end + 1 - lengths[token]] = token
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + lengths[token]
            if open_[end] and (not out or self._stay_apart(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
                continue
            token = self._shorter[token]
            while token < 0:
                open_[at] = 0
                last = out.pop()
                at -= lengths[last]
                token = self._shorter[last]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        seen, out = self._seen, []
        for piece in self._find(text):
            got = seen.get(piece)
            if got is None:
                if len(seen) >= _CACHE:
                    seen.clear()
                got = self.encode_piece(piece)
                if len(piece) < 64:
                    seen[piece] = got
            out += got
        return out

    def decode(self, ids: Iterable[int]) -> str:
        i = np.asarray(list(ids), dtype=np.int64)
        if not len(i):
            return ""
        o, b = self.offsets, self.bytes
        return b"".join(b[s:e].tobytes() for s, e in zip(o[i], o[i + 1])).decode("utf-8", "replace")


_loaded: dict[tuple[str, str], BytePairs] = {}


def encoder(path: str = VOCABULARY, pieces: str = PIECES) -> BytePairs:
    """The encoder of a file, made once in each process."""
    key = (path, pieces)
    if key not in _loaded:
        _loaded[key] = BytePairs(path, pieces)
    return _loaded[key]


def encode_column(df: DataFrame, id_col: str, text_col: str, path: str | None = None, only_count: bool = False) -> DataFrame:
    """(id_col, ids array<int>), or (id_col, n_tokens int) with only_count.

    One row for each row of df. A null or empty text gives an empty list (0).
    Names of special tokens in a text are ordinary text. Other columns of df are
    ignored, whatever their names.
    """
    path = path or os.environ.get("TRACEWRIGHT_VOCABULARY", VOCABULARY)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bp = encoder(path)
        for batch in batches:
            ids = [bp.encode(t) for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
            if only_count:
                second = pa.array(sizes)
            else:
                flat = np.fromiter((x for one in ids for x in one), dtype=np.int32, count=int(sizes.sum()))
                second = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), second], names=["i", "x"])

    out = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"i {kind}, x {'int' if only_count else 'array<int>'}")
    return out.select(F.col("i").alias(id_col), F.col("x").alias("n_tokens" if only_count else "ids"))
