"""Benchmark decontamination: broadcast windows of normalised test words, scan training texts.

The test items are cut into windows of 13 words.  Their hashes are broadcast
in parts of bounded size; every training text is turned into window hashes,
candidates are looked up, and a hit counts only after its words were compared
with the window's.  Several parts are scanned one after another, each adding to
the hits that the rows already carry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattflow.llm.common import NON_WORD_PATTERN, ascii_lower, cut, whole_text

WINDOW = 13
# Words of test items in one broadcast part, about (with their windows some 500 bytes a word in a worker).
PART_WORDS = 200_000
# Items are dealt out in stretches of so many windows, which bounds a part whatever the items' size.
STRETCH = 4096
# Words of a text looked at in one go (its windows overlap into the next).
TEXT_STRETCH = 1 << 16

# ASCII bytes that are no digit or letter separate words; A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
              for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)

HITS = "n_words: long, hits: array<struct<first: int, end: int>>, items: array<long>, unnamed: boolean"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z: runs of digits, letters and non-ASCII characters."""
    return (text or "").encode().translate(_FOLD).split()


def stretches(benchmark: DataFrame, item_col: str, text_col: str, window: int, null_ids: bool = False) -> DataFrame:
    """(item, words): overlapping stretches of the items' words, so that every window lies in one.

    Items of fewer words are one stretch; items without words and null texts give none, nor do
    null ids unless ``null_ids``; what repeats in an item (or in repeated items) is one stretch.
    """
    words = F.filter(F.split(ascii_lower(whole_text(F.col(text_col))), NON_WORD_PATTERN), lambda w: w != "")
    n = F.size("w")
    starts = F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)), F.lit(STRETCH))
    return (benchmark.select(F.col(item_col).cast("long").alias("item"), words.alias("w"))
            .filter((F.lit(null_ids) | F.col("item").isNotNull()) & (n > 0))
            .select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, STRETCH + window - 1)))
                    .alias("words")).distinct())


class Windows:
    """Lookup of the windows of some item stretches; sent to the executors by broadcast."""

    def __init__(self, rows: list[tuple[int | None, list[str]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        found: dict[tuple, set[int | None]] = {}
        for item, words in rows:
            ids = tuple(self.ids.setdefault(w.encode(), len(self.ids) + 1) for w in words)
            for s in range(max(1, len(ids) - window + 1)):
                found.setdefault(ids[s:s + window], set()).add(item)
        self.found = found
        # sorted hashes by window length, as most items have at least 13 words
        by_length: dict[int, list[tuple]] = {}
        for w in found:
            by_length.setdefault(len(w), []).append(w)
        self.hashes = {n: np.unique(_rolling_many(np.array(ws, np.uint64))) for n, ws in by_length.items()}

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int | None]]:
        """Merged [first, end) spans of words in occurring windows, and the items they are of."""
        spans: list[tuple[int, int]] = []
        items: set[int | None] = set()
        for at in range(0, max(len(words), 1), TEXT_STRETCH):
            part = words[at:at + TEXT_STRETCH + self.window - 1]
            get = self.ids.get
            ids = np.fromiter((get(w, 0) for w in part), np.uint64, len(part))
            for n, known in self.hashes.items():
                starts = np.arange(max(0, len(ids) - n + 1))
                # only stretches of test words can hold a window
                gaps = np.concatenate([[0], np.cumsum(ids == 0)])
                starts = starts[gaps[n:][:len(starts)] == gaps[:len(starts)]] if len(starts) else starts
                if not len(starts):
                    continue
                values = _rolling(ids, starts, n)
                slot = np.minimum(np.searchsorted(known, values), len(known) - 1)
                for s in starts[known[slot] == values]:
                    of = self.found.get(tuple(int(x) for x in ids[s:s + n]))
                    if of is not None:
                        spans.append((at + int(s), at + int(s) + n))
                        items |= of
        return merge(spans), items


def _rolling(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    value = np.zeros(len(starts), np.uint64)
    for j in range(n):
        value = value * _BASE + ids[starts + j]
    return value


def _rolling_many(windows: np.ndarray) -> np.ndarray:
    value = np.zeros(len(windows), np.uint64)
    for j in range(windows.shape[1]):
        value = value * _BASE + windows[:, j]
    return value


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", window: int = WINDOW, part_words: int = PART_WORDS,
         null_ids: bool = False) -> DataFrame:
    """(row, found): every row of ``docs`` as a struct, with HITS as the struct ``found``.

    A null text has no words.  With ``null_ids`` test items of a null id are looked for
    like the others and set ``unnamed``; else they are left out.  The words of the test set are counted first, each
    repeated item once; they are broadcast in ``ceil(words / part_words)`` parts,
    and beyond one part the rows are written to the shared folder between two scans.
    """
    spark = docs.sparkSession
    items = stretches(benchmark, item_col, item_text, window, null_ids)
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = max(1, -(-total // part_words))
    if parts > 1:
        items = cut(items, "test-items")  # each part reads them again
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("found", F.lit(None).cast(f"struct<{HITS}>"))
    for part in range(parts):
        mine = items if parts == 1 else items.filter(
            F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == part)
        sent = spark.sparkContext.broadcast(Windows([(r.item, r.words) for r in mine.collect()], window))
        rows = rows.withColumn("found", _scan(sent)(F.col("row")[text_col], F.col("found")))
        if part + 1 < parts:
            rows = cut(rows, "decontaminate")
    return rows


def _scan(sent):
    @F.pandas_udf(f"struct<{HITS}>")
    def scan(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        windows = sent.value
        for texts, before in batches:
            out = []
            for i, text in enumerate(texts):
                words = words_of(text)
                spans, items = windows.hits(words)
                hits, of = before["hits"].iat[i], before["items"].iat[i]
                if hits is not None and len(hits):
                    spans = merge(spans + [(h["first"], h["end"]) for h in hits])
                if of is not None:
                    items |= {int(x) for x in of}
                unnamed = None in items or bool(of is not None and before["unnamed"].iat[i])
                out.append((len(words), [{"first": a, "end": b} for a, b in spans], sorted(items - {None}), unnamed))
            yield pd.DataFrame(out, columns=["n_words", "hits", "items", "unnamed"])
    # so that the optimizer evaluates it once, wherever its result is used
    return scan.asNondeterministic()


def n_hit(found: Column) -> Column:
    return F.aggregate(found["hits"], F.lit(0).cast("long"), lambda a, h: a + (h["end"] - h["first"]))


def contaminated(found: Column) -> Column:
    """At least one hit word, and at least 5 % of all words."""
    return (n_hit(found) > 0) & (20 * n_hit(found) >= found["n_words"])


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null ids and repeated rows are kept, columns beyond id and text are ignored,
    a null text has no words, an empty table gives no rows and an empty
    benchmark no hits.  With ``null_ids`` the test items of a null id mark words
    too and count as one more item, which has no name for the digest.
    """
    found = F.col("found")
    names = F.array_sort(F.transform(found["items"], lambda x: x.cast("string")))
    return (find(docs.select(id_col, text_col), benchmark, text_col, **options)
            .select(F.col("row")[id_col].alias("doc_id"), found["n_words"].alias("n_words"),
                    n_hit(found).alias("n_hit"), (F.size(found["items"]) + found["unnamed"].cast("int")).cast("long").alias("n_items"),
                    F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
                    contaminated(found).alias("contaminated")))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged.

    Null and empty texts have no words and stay; null ids and repeated rows are
    judged like any other; an empty table stays empty, and an empty
    ``benchmark`` leaves all rows.
    """
    return (find(docs, benchmark, text_col, **options)
            .filter(~contaminated(F.col("found"))).select("row.*"))


def without_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the words of every hit cut out of the text (from the first hit
    word's start to the last one's end; the characters around stay).

    Null and empty texts, other columns and all rows (repeated ones too) stay.
    """
    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, found: pd.DataFrame) -> pd.Series:
        return pd.Series([_without(t, h) for t, h in zip(texts, found["hits"])], dtype=object)

    new = F.when(F.size("found.hits") > 0, cut_out(F.col("row")[text_col], F.col("found"))).otherwise(
        F.col("row")[text_col])
    return (find(docs, benchmark, text_col, **options)
            .select(F.col("row").withField(text_col, new).alias("row")).select("row.*"))


def _without(text: str | None, hits) -> str | None:
    if text is None or hits is None or not len(hits):
        return text
    raw = text.encode()
    folded = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    edges = np.diff(np.concatenate([[0], folded.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    kept, at = [], 0
    for h in hits:
        kept.append(raw[at:starts[h["first"]]])
        at = int(ends[h["end"] - 1])
    return b"".join([*kept, raw[at:]]).decode()
