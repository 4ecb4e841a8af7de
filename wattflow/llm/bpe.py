"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until a piece is short, the pieces are encoded, and neighbours
are joined up the tree.  Tokens near the seam may be wrong, as a match of the
split pattern or a merge can span it.  The join therefore re-encodes a window
around the seam and lets it grow on each side to a place where the pattern
always starts a new match, whatever stands before or after: right after a
letter or digit that a character of another kind follows.  A match of the
pattern that ends in a letter (or digit) holds none of the characters that may
follow here, and matching from such a place on looks only forward, so the
tokens outside the window cannot change and are kept.  Decoding looks the
tokens up and concatenates the bytes up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of a piece that is encoded without halving.
LEAF = 4096
# First size of the window on either side of a seam.
REACH = 64
# Tokens of a piece that is decoded without halving.
DECODE_LEAF = 1 << 16

# A place between a letter or digit and an ASCII character that is surely of another kind.
_CUT = regex.compile(r"(?<=\p{L})(?=[\x09-\x0D\x20-\x40\x5B-\x60\x7B-\x7E])"
                     r"|(?<=[0-9])(?=[\x09-\x0D\x20-\x2F\x3A-\x7E])")
# White space as the split pattern understands it; longer runs than a leaf are taken out first.
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG_SPACE = regex.compile(_SPACE + "{%d,}" % (LEAF // 2))


class Tree:
    """Encoder and decoder for one file of ranks and one split pattern."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token = {rank: token for token, rank in ranks.items()}
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    def encode(self, text: str) -> np.ndarray:
        """Token ids, the same as of encoding the whole text at once."""
        if len(text) <= LEAF:
            return np.array(self.plain.encode_ordinary(text), np.uint32)
        # all of a white-space run but its last character is one match by itself,
        # and always starts one where a non-space stands before
        out, at = [], 0
        for run in _LONG_SPACE.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += [self._halves(text[at:run.start()]), self._one_match(text[run.start():end])]
            at = end
        out.append(self._halves(text[at:]))
        return np.concatenate(out)

    def _one_match(self, piece: str) -> np.ndarray:
        return np.array(self.plain._encode_single_piece(piece), np.uint32)

    def _halves(self, text: str) -> np.ndarray:
        if len(text) <= LEAF:
            return np.array(self.plain.encode_ordinary(text), np.uint32)
        middle = len(text) // 2
        return self._join(text, middle, self._halves(text[:middle]), self._halves(text[middle:]))

    def _join(self, text: str, middle: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        first, end, reach = None, None, REACH
        while first is None or end is None:
            if first is None:
                low = max(0, middle - reach)
                cuts = [m.start() for m in _CUT.finditer(text, low, middle)]
                first = cuts[-1] if cuts else 0 if low == 0 else None
            if end is None:
                high = min(len(text), middle + reach)
                # the character after the place has to be in sight
                m = _CUT.search(text, middle, min(len(text), high + 1))
                end = m.start() if m else len(text) if high == len(text) else None
            reach *= 2
        keep = len(left) - self._tokens(left[::-1], len(text[first:middle].encode()))
        drop = self._tokens(right, len(text[middle:end].encode()))
        seam = np.array(self.plain.encode_ordinary(text[first:end]), np.uint32)
        return np.concatenate([left[:keep], seam, right[drop:]])

    def _tokens(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many tokens from the start hold so many bytes (a cut is always a token's edge)."""
        if n_bytes == 0:
            return 0
        ends = np.cumsum(self.length[ids[:n_bytes]])
        k = int(np.searchsorted(ends, n_bytes))
        if k >= len(ends) or ends[k] != n_bytes:
            raise AssertionError("a cut inside a token")
        return k + 1

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return self.plain.decode_bytes(ids.tolist())
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@lru_cache(maxsize=2)
def tree(path: str, pattern: str) -> Tree:
    return Tree(path, pattern)


def _slices(pdf: pd.DataFrame, text_col: str, most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Consecutive rows of about ``most`` characters together."""
    sizes = np.cumsum([len(t or "") for t in pdf[text_col]]) // most
    for _, part in pdf.groupby(sizes, sort=False):
        yield part


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decodes): the token ids of every text, and whether they decode to it.

    A null text is empty; null ids and repeated rows are kept; an empty table gives no rows.
    """
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tree(path, pattern)
        for pdf in batches:
            for part in _slices(pdf, "text"):
                texts = [t or "" for t in part["text"]]
                ids = [bpe.encode(t) for t in texts]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].array, "n_tokens": [len(i) for i in ids],
                    "ids": [i.astype(np.int32) for i in ids],
                    "decodes": [bpe.decode(i) == t.encode() for i, t in zip(ids, texts)]})

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(docs.dtypes)[id_col]
    return (rows.mapInPandas(encode, "doc_id string, n_tokens long, ids array<int>, decodes boolean")
            .withColumn("doc_id", F.col("doc_id").cast(kind)))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode its ids: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Ids are digested as little-endian unsigned 32-bit integers.  A null text is
    empty (no ids); null ids and repeated rows are kept; other columns are
    ignored; an empty table gives no rows.
    """
    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = tree(path, pattern)
        for texts in batches:
            out = []
            for t in texts:
                ids = bpe.encode(t or "")
                out.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                            hashlib.sha256(bpe.decode(ids)).hexdigest()))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
    return (docs.select(F.col(id_col).alias("doc_id"), digest.asNondeterministic()(F.col(text_col)).alias("d"))
            .select("doc_id", "d.*"))
