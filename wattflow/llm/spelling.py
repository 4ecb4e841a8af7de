"""Spelling variant grouping: K-d trees over letter-count vectors.

Two words one edit apart have letter counts at an L1 distance of at most two: a
replaced letter takes one from a count and adds one to another, an inserted one
adds one.  The words of one length form a K-d tree whose planes are "at least v
of letter c".  A word searches the tree of its own length (one count may rise,
one may fall) and the tree one shorter (one count may fall): whatever lies
beyond a plane that more steps than these would cross is pruned.  Words that
remain within the distance are verified letter by letter.

The upper part of the trees is grown by Spark, level by level from exact
histograms of letter counts, until a cell holds at most ``cell_words`` words.
Cells are then searched by as many tasks, each of which continues the tree in
memory.  The planes of the upper part are the only thing every task gets; as a
cell holds at least a 4096th of all words before it is split, one level has at
most 4096 of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattflow.llm.common import cut, whole_text

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MISSPELT_EVERY = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
# Words of a cell that one task searches; the upper tree splits larger ones.
CELL_WORDS = 8192
# Cells at most of one level, by size: a larger table has larger cells.
CELLS = 4096
# Words of a leaf, which are compared with all that come there.
LEAF_WORDS = 48
# Different words counted in memory before they are passed on.
_COUNTED = 400_000
# Pairs compared at a time.
_STRIP = 1 << 22
# Words that travel in one row.
_PACK = 20_000

# A plane: at least so many of a letter. Cells are named by length and turns, "8:0110".
Planes = dict[str, tuple[int, int]]


def run_counts(doc_id: str, text: str | None) -> Counter:
    """How often the text holds each word, after the rule that misspells some of its runs.

    ASCII letters are lower-cased.  A run whose crc32 with the id is divisible
    by 97 loses one letter; a null id stands as nothing before the colon.
    """
    words: Counter = Counter()
    name = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.encode().lower().decode()) if text else ()).items():
        word = run
        h = zlib.crc32(run.encode(), name)
        if h % MISSPELT_EVERY == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
        words[word] += n
    return words


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of at least so many letters that occur at least so often in all texts."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()

        def counted() -> pd.DataFrame:
            return pd.DataFrame({"word": pd.Series(list(words), dtype=str),
                                 "n": np.fromiter(words.values(), np.int64, len(words))})
        for pdf in batches:
            for i, text in zip(pdf["id"], pdf["text"]):
                for word, n in run_counts(i, text).items():
                    if len(word) >= least_length:
                        words[word] += n
                if len(words) > _COUNTED:
                    yield counted()
                    words.clear()
        yield counted()

    rows = docs.select(whole_text(F.col(id_col).cast("string")).alias("id"), F.col(text_col).alias("text"))
    return (rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= least_count))


class _Words:
    """Words of one length as code points, with the counts of letters that were asked for."""

    def __init__(self, words: list[str]):
        self.words = words
        self.points = np.array(words, dtype=str).view(np.uint32).reshape(len(words), -1)
        self._counts: dict[int, np.ndarray] = {}

    def count(self, letter: int) -> np.ndarray:
        if letter not in self._counts:
            self._counts[letter] = (self.points == letter).sum(1, dtype=np.int32)
        return self._counts[letter]


def _by_length(words: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
    sizes = words.str.len().to_numpy()
    for size in np.unique(sizes):
        yield int(size), np.flatnonzero(sizes == size)


def _turns(x: np.ndarray, v: int, up: np.ndarray, down: np.ndarray):
    """Who goes to each side of the plane "at least v": [(turn, who, up, down)], steps left."""
    above, below = x >= v, x < v
    climbs, falls = (x == v - 1) & (up > 0), (x == v) & (down > 0)
    for turn, free, step, up_cost, down_cost in (("1", above, climbs, 1, 0), ("0", below, falls, 0, 1)):
        who = np.flatnonzero(free | step)
        paid = step[who]
        yield turn, who, up[who] - up_cost * paid, down[who] - down_cost * paid


def _cells(words: _Words, planes: Planes, root: str, up: int, down: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(cell, indices of words that visit it, which of them without a step)."""
    n = len(words.words)
    todo = [(root, np.arange(n), np.full(n, up, np.int8), np.full(n, down, np.int8))]
    while todo:
        cell, who, ups, downs = todo.pop()
        if not len(who):
            continue
        plane = planes.get(cell)
        if plane is None:
            yield cell, who, (ups == up) & (downs == down)
            continue
        for turn, some, u, d in _turns(words.count(plane[0])[who], plane[1], ups, downs):
            todo.append((cell + turn, who[some], u, d))


def grow_planes(words: DataFrame, cell_words: int = CELL_WORDS) -> Planes:
    """The planes of the upper trees: every cell of more than ``cell_words`` words (or a
    4096th of all, if that is more) is split by the plane that halves it best, ties by
    letter, then v; cells of words with the same letter counts stay whole."""
    most = max(cell_words, words.count() // CELLS)
    planes: Planes = {}

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, rows in _by_length(pdf["word"]):
                some = _Words(pdf["word"].iloc[rows].tolist())
                for cell, who, _ in _cells(some, planes, f"{size}:", 0, 0):
                    if fresh is not None and cell[:-1] not in fresh:
                        continue
                    points = some.points[who]
                    out = [(cell, 0, 0, len(who))]
                    for letter in np.unique(points):
                        x = (points == letter).sum(1)
                        out += [(cell, int(letter), v, int((x >= v).sum())) for v in range(1, int(x.max()) + 1)]
                    yield pd.DataFrame(out, columns=["cell", "letter", "v", "n"])

    fresh: Planes | None = None  # the cells split last: only their parts may be split now
    while True:
        counts = (words.select("word").mapInPandas(histogram, "cell string, letter int, v int, n long")
                  .groupBy("cell", "letter", "v").agg(F.sum("n").alias("n")))
        # the first row of a cell says how many words it has
        total = F.max(F.when(F.col("letter") == 0, F.col("n"))).over(Window.partitionBy("cell"))
        best = Window.partitionBy("cell").orderBy(F.abs(2 * F.col("n") - F.col("total")), "letter", "v")
        chosen = (counts.withColumn("total", total).filter(F.col("total") > most)
                  .filter((F.col("letter") > 0) & (F.col("n") < F.col("total")))
                  .withColumn("pick", F.row_number().over(best)).filter("pick = 1")
                  .select("cell", "letter", "v").collect())
        if not chosen:
            return planes
        fresh = {r.cell: (r.letter, r.v) for r in chosen}
        planes = {**planes, **fresh}


def _near(points_a: np.ndarray, points_b: np.ndarray) -> np.ndarray:
    """Which rows differ by one edit: same length with one letter replaced, or ``a`` one longer."""
    if points_a.shape[1] == points_b.shape[1]:
        return (points_a != points_b).sum(1) == 1
    size = points_b.shape[1]
    before = np.logical_and.accumulate(points_a[:, :size] == points_b, axis=1).sum(1)
    after = np.logical_and.accumulate((points_a[:, 1:] == points_b)[:, ::-1], axis=1).sum(1)
    return before + after >= size


def _search(home: _Words, visitors: _Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(visitor, home) indices of all pairs one edit apart; visitors are as long or one longer."""
    same = home.points.shape[1] == visitors.points.shape[1]
    letters = np.unique(home.points)
    h = np.stack([home.count(c) for c in letters], axis=1)
    v = np.stack([visitors.count(c) for c in letters], axis=1)
    foreign = visitors.points.shape[1] - v.sum(1)
    odd = np.uint64(1) << (np.arange(len(letters), dtype=np.uint64) % np.uint64(64))
    h_odd = np.bitwise_xor.reduce(np.where(h & 1, odd, np.uint64(0)), axis=1)
    v_odd = np.bitwise_xor.reduce(np.where(v & 1, odd, np.uint64(0)), axis=1)

    def compare(hs: np.ndarray, vs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, _STRIP // len(hs))
        for at in range(0, len(vs), step):
            part = vs[at:at + step]
            # counts within two differ in parity in two letters at most
            i, j = np.nonzero(np.bitwise_count(v_odd[part, None] ^ h_odd[None, hs]) <= 2)
            i, j = part[i], hs[j]
            distance = np.abs(v[i] - h[j]).sum(1) + foreign[i]
            close = distance == 2 if same else distance == 1
            i, j = i[close], j[close]
            near = _near(visitors.points[i], home.points[j])
            yield i[near], j[near]

    n = len(visitors.words)
    todo = [(np.arange(len(home.words)), np.arange(n), np.full(n, int(same), np.int8), np.ones(n, np.int8))]
    while todo:
        hs, vs, up, down = todo.pop()
        if not len(hs) or not len(vs):
            continue
        plane = None
        if len(hs) > LEAF_WORDS:
            x = h[hs]
            halves = [(abs(2 * int(m) - len(hs)), c, k) for k in range(1, int(x.max()) + 1)
                      for c, m in enumerate((x >= k).sum(0)) if 0 < m < len(hs)]
            plane = min(halves, default=None)
        if plane is None:
            yield from compare(hs, vs)
            continue
        _, c, k = plane
        x = h[hs, c]
        sides = {"1": hs[x >= k], "0": hs[x < k]}
        for turn, some, u, d in _turns(v[vs, c], k, up, down):
            todo.append((sides[turn], vs[some], u, d))


def _best(words: np.ndarray, near: np.ndarray, near_n: np.ndarray) -> pd.DataFrame:
    """Of each word: the number of its near words and the one of largest n, ties to the smallest."""
    pairs = pd.DataFrame({"word": words, "near": near, "near_n": near_n})
    pairs = pairs.sort_values(["near_n", "near"], ascending=[False, True])
    grouped = pairs.groupby("word", sort=False)
    first = grouped.first()
    return pd.DataFrame({"word": first.index, "n_near": grouped.size().reindex(first.index).to_numpy(np.int64),
                         "best_n": first["near_n"].to_numpy(np.int64), "best": first["near"].to_numpy()})


_BEST = "word string, n_near long, best_n long, best string"


def near_words(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n_near, best, best_n) of every word of (word, n) that has near words."""
    planes = grow_planes(words, cell_words)

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, rows in _by_length(pdf["word"]):
                some = _Words(pdf["word"].iloc[rows].tolist())
                names, counts = np.array(some.words, dtype=object), pdf["n"].to_numpy(np.int64)[rows]
                for root, up in ((size, 1), (size - 1, 0)):
                    out = []
                    for cell, who, free in _cells(some, planes, f"{root}:", up, 1):
                        for at in range(0, len(who), _PACK):
                            part = who[at:at + _PACK]
                            out.append((cell, size, " ".join(names[part]), counts[part].tobytes(),
                                        (free & (up > 0))[at:at + _PACK].tobytes()))
                    yield pd.DataFrame(out, columns=["cell", "size", "words", "counts", "home"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        of = {int(size): rows for size, rows in pdf.groupby("size")}
        shorter = int(pdf["cell"].iloc[0].split(":")[0])
        lists = {size: (" ".join(rows["words"]).split(" "), np.frombuffer(b"".join(rows["counts"]), np.int64))
                 for size, rows in of.items()}
        if shorter in lists:
            names, counts = lists[shorter]
            at_home = np.flatnonzero(np.frombuffer(b"".join(of[shorter]["home"]), bool))
            if len(at_home):
                home, home_names, home_n = (_Words([names[i] for i in at_home]),
                                            np.array([names[i] for i in at_home], dtype=object), counts[at_home])
                for size, (visiting, n) in lists.items():
                    visiting_names = np.array(visiting, dtype=object)
                    for i, j in _search(home, _Words(visiting)):
                        found.append((visiting_names[i], home_names[j], home_n[j]))
                        if size > shorter:
                            found.append((home_names[j], visiting_names[i], n[i]))
        if not found:
            return pd.DataFrame({"word": [], "n_near": [], "best_n": [], "best": []}).astype(
                {"word": str, "n_near": np.int64, "best_n": np.int64, "best": str})
        return _best(*[np.concatenate(x) for x in zip(*found)])

    packed = words.select("word", "n").mapInPandas(
        visits, "cell string, size int, words string, counts binary, home binary")
    best = F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))
    return (packed.groupBy("cell").applyInPandas(search, _BEST)
            .groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(best).alias("b"))
            .select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word reached.  Forms never turn in a circle, as
    n at least doubles with each, so doubling the steps ends after a few joins."""
    state = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(state.join(onward, "root", "left")
                    .select("word", F.coalesce("next", "root").alias("root"),
                            F.col("next").isNotNull().alias("moved")), "roots")
        state = moved.select("word", "root")
        if moved.filter("moved").limit(1).count() == 0:
            return state


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the texts.

    A word's form is the near word of largest n (ties: smallest in code-point
    order), if that n is at least twice the word's own; root follows forms to
    the last and is the word itself without one.  Null and empty texts hold no
    words; of a null id see ``run_counts``; repeated rows count each; long texts
    are read whole; other columns are ignored; no words give no rows.
    """
    words = cut(word_counts(docs, id_col, text_col), "words")
    near = near_words(words, cell_words)
    known = cut(words.join(near, "word", "left").withColumn(
        "form", F.when(F.col("best_n") >= 2 * F.col("n"), F.col("best"))), "forms")
    root = roots(known.filter(F.col("form").isNotNull()))
    none = F.lit(0).cast("long")
    return known.join(root, "word", "left").select(
        "word", "n", F.coalesce("n_near", none).alias("n_near"), "form",
        F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n"),
        F.coalesce("root", "word").alias("root"))
