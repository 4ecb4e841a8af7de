"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a probability of being
toxic, and the document's is their noisy-or, so document labels train the
sentence scores, which then locate the offending sentences.  Evidence is
carried by words and word beginnings with non-negative weights; a sentence
without any has probability 0, so long clean texts do not add up to toxic ones.

The model is fitted on a bounded sample of labelled rows (``Sample``); every
text is scored whole.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattflow.llm.common import whole_text

THRESHOLD = 0.3
# Beginnings of words that are features beside whole words.
STEMS = (4, 5, 6, 7, 8)
# A feature needs a likelihood ratio statistic of so much, as very many are tried, and so many documents.
MIN_RATIO = 20.0
MIN_DOCS = 4
MAX_FEATURES = 4000
PENALTY = 0.3
STEPS = 400
# Words whose evidence a worker remembers.
REMEMBERED = 200_000

_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Sample:
    """Bounds of the training sample: documents of either label, and characters of both (about)."""
    positive: int = 4000
    negative: int = 4000
    chars: int = 48_000_000


@dataclass
class Model:
    """Weights of words and word beginnings ("stem*"), the sentence bias and the leak of a document."""
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    leak: float = 0.0
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def evidence(self, word: str) -> float:
        z = self.known.get(word)
        if z is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            z = self.known[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return z

    def probability(self, z: float) -> float:
        """Of a sentence with evidence z; 0 without evidence, whatever the bias."""
        return max(0.0, (_sigmoid(self.bias + z) - _sigmoid(self.bias)) / (1 - _sigmoid(self.bias)))

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences with evidence."""
        low, out, at = fold(text or ""), [], 0
        if not any(self.evidence(w) for w in set(_WORD.findall(low))):
            return out
        for stop in [*_SENTENCE.finditer(low), None]:
            end = stop.start() if stop else len(low)
            z = sum(self.evidence(w) for w in set(_WORD.findall(low, at, end)))
            if z > 0:
                out.append((at, end, self.probability(z)))
            at = stop.end() if stop else end
        return out

    def score(self, text: str | None) -> float:
        clean = 1.0 - self.leak
        for _, _, p in self.sentences(text):
            clean *= 1.0 - p
        return 1.0 - clean


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def fold(text: str) -> str:
    """Lower case, character by character, so that positions stay those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def features(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in STEMS if len(word) > n]]


class _Bags:
    """Documents as bags of sentences, sentences as sets of word numbers, in flat arrays."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.words, self.sentence_size, self.doc_size, self.labels = array("i"), array("i"), array("i"), []
        self._met: tuple[set[int], set[int]] = (set(), set())

    def add(self, text: str, label: int) -> bool:
        """A text most of whose sentences were met before under its own label is a copy and adds nothing:
        else the plain words of a toxic text of many near copies would pass for signs of toxicity."""
        low = fold(text)
        bag = [s for s in (sorted(set(_WORD.findall(part))) for part in _SENTENCE.split(low)) if s]
        marks = [crc32("\n".join(s).encode()) for s in bag]
        if bag and 2 * sum(m in self._met[label] for m in marks) > len(marks):
            return False
        self._met[label].update(marks)
        for sentence in bag:
            self.words.extend(self.number.setdefault(w, len(self.number)) for w in sentence)
            self.sentence_size.append(len(sentence))
        self.doc_size.append(len(bag))
        self.labels.append(label)
        return True

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, the sentence of each, the document of each sentence, the labels."""
        sizes, docs = np.frombuffer(self.sentence_size, np.int32), np.frombuffer(self.doc_size, np.int32)
        return (np.frombuffer(self.words, np.int32), np.repeat(np.arange(len(sizes)), sizes),
                np.repeat(np.arange(len(docs)), docs), np.array(self.labels, np.int64))


def fit(rows: Iterator[tuple[str, int]], weight: dict[int, float], chars: int) -> Model:
    """Train on (text, label) rows; ``weight`` undoes the sample's share of each label.

    Reading stops beyond ``chars`` characters of texts that teach something; copies count once.
    """
    bags = _Bags()
    for text, label in rows:
        if chars <= 0:
            break
        if bags.add(text, label):
            chars -= len(text)
    n = {y: bags.labels.count(y) for y in (0, 1)}
    if not n[1]:
        return Model()
    prior = n[1] * weight[1] / (n[1] * weight[1] + n[0] * weight[0])
    if not n[0]:
        return Model(leak=min(prior, 0.99))
    words, s_of_word, d_of_sentence, labels = bags.flat()
    d_of_word = d_of_sentence[s_of_word]
    # each word once in each document
    pairs = np.unique(d_of_word.astype(np.int64) * len(bags.number) + words)
    doc, word = pairs // len(bags.number), pairs % len(bags.number)
    toxic = labels[doc] == 1
    spelled = np.array(list(bags.number), dtype=object)
    index = _chosen_features(spelled, doc, word, toxic, n)
    if not index:
        return Model(leak=min(prior, 0.25))
    # the entries of a sparse matrix: sentences with evidence x features
    of_word = {w: [index[f] for f in features(spelled[w]) if f in index] for w in np.unique(word).tolist()}
    of_word = {w: fs for w, fs in of_word.items() if fs}
    hit = np.isin(words, np.array(list(of_word), np.int32))
    sentences, row = np.unique(s_of_word[hit], return_inverse=True)
    found = [of_word[w] for w in words[hit].tolist()]
    entry_s = np.repeat(row, [len(fs) for fs in found])
    entry_f = np.array([f for fs in found for f in fs], np.int64)
    doc_weight = np.where(labels == 1, weight[1], weight[0])
    doc_weight *= len(labels) / doc_weight.sum()
    return _train(list(index), d_of_sentence[sentences], entry_s, entry_f, labels.astype(float), doc_weight)


def _chosen_features(spelled, doc, word, toxic, n) -> dict[str, int]:
    """The features that speak for toxicity, strongest first, numbered."""
    def in_docs(of_label: np.ndarray, known: dict[str, int] | None) -> dict[str, int]:
        counts: Counter = Counter()
        edges = np.flatnonzero(np.diff(doc[of_label], prepend=-1, append=-1))
        for part in np.split(word[of_label], edges[1:-1]):
            fs = {f for w in part.tolist() for f in features(spelled[w])}
            counts.update(fs if known is None else [f for f in fs if f in known])
        return counts

    toxic_docs = {f: a for f, a in in_docs(toxic, None).items() if a >= MIN_DOCS}
    clean_docs = in_docs(~toxic, toxic_docs)
    ratio = {f: _likelihood_ratio(a, n[1], clean_docs.get(f, 0), n[0]) for f, a in toxic_docs.items()
             if a * n[0] > clean_docs.get(f, 0) * n[1]}
    names = sorted((f for f, r in ratio.items() if r >= MIN_RATIO), key=lambda f: (-ratio[f], f))
    return {f: i for i, f in enumerate(names[:MAX_FEATURES])}


def _likelihood_ratio(a: int, n: int, b: int, m: int) -> float:
    def part(k: int, of: int, p: float) -> float:
        return (k * np.log(p) if k else 0.0) + ((of - k) * np.log1p(-p) if of > k else 0.0)
    p = (a + b) / (n + m)
    return 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, p) - part(b, m, p))


def _train(names, s_doc, entry_s, entry_f, y, doc_weight) -> Model:
    """Maximise the penalised noisy-or likelihood by projected Adam steps."""
    n_s, n_f, n_d = len(s_doc), len(names), len(y)
    w, bias, leak = np.full(n_f, 0.5), -4.0, -4.0  # the leak as a logit
    moment, square = np.zeros(n_f + 2), np.zeros(n_f + 2)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(entry_s, w[entry_f], n_s)
        # log(1 - p) of a sentence: log((1 - sigmoid(z)) / (1 - sigmoid(bias)))
        log_clean = np.logaddexp(0, bias) - np.logaddexp(0, z)
        doc_clean = np.bincount(s_doc, log_clean, n_d) - np.logaddexp(0, leak)
        clean = np.exp(np.minimum(doc_clean, -1e-9))
        # d loss / d doc_clean: clean documents want it 0, toxic ones low
        pull = doc_weight * np.where(y == 1, clean / (1 - clean), -1.0)
        d_z = pull[s_doc] * -_sigmoid(z)
        grad = np.concatenate([
            np.bincount(entry_f, d_z[entry_s], n_f) + PENALTY,
            [d_z.sum() + (pull[s_doc] * _sigmoid(bias)).sum() + 0.1 * (bias + 4), (pull * -_sigmoid(leak)).sum()]])
        moment = 0.9 * moment + 0.1 * grad
        square = 0.999 * square + 0.001 * grad ** 2
        move = 0.05 * (moment / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
        w = np.maximum(w - move[:n_f], 0)
        bias, leak = min(bias - move[-2], -1.0), min(max(leak - move[-1], -9.0), -1.1)
    return Model({f: float(x) for f, x in zip(names, w) if x > 1e-3}, float(bias), float(_sigmoid(leak)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample: Sample = Sample()) -> Model:
    """Fit on labelled documents that are not held out.

    About ``sample.positive`` and ``sample.negative`` rows are chosen by a hash
    of their id (all, when there are fewer), and in proportion fewer when they
    have more than ``sample.chars`` characters; an id with several labels is
    toxic if one says so; null ids and labels teach nothing.
    """
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
             .filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
             .groupBy("id").agg(F.max("y").alias("y")))
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    share = {y: min(1.0, most / n[y]) if n.get(y) else 0.0
             for y, most in ((1, sample.positive), (0, sample.negative))}
    within = lambda: place < F.when(F.col("y") == 1, share[1]).otherwise(share[0])
    # of long texts fewer, before any text is moved
    size = (docs.select(F.col(id_col).alias("id"), F.length(text_col).alias("chars"))
            .join(F.broadcast(known.filter(within())), "id").agg(F.sum("chars")).first()[0] or 0)
    share = {y: s * min(1.0, sample.chars / max(size, 1)) for y, s in share.items()}
    chosen = known.filter(within())
    rows = (docs.select(F.col(id_col).alias("id"), whole_text(F.col(text_col)).alias("text"))
            .join(F.broadcast(chosen), "id")  # at most about sample.positive + sample.negative ids
            .select("id", "text", "y").repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "text"))
    weight = {y: 1 / share[y] if share[y] else 1.0 for y in share}

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = fit(((t, int(y)) for b in batches for t, y in zip(b["text"], b["y"])), weight, sample.chars)
        yield pd.DataFrame([("", model.bias, model.leak), *[(f, w, 0.0) for f, w in model.weights.items()]],
                           columns=["feature", "weight", "leak"])

    got = rows.mapInPandas(learn, "feature string, weight double, leak double").collect()
    own = next((r for r in got if r.feature == ""), None)
    return Model({r.feature: r.weight for r in got if r.feature}, own.weight, own.leak) if own else Model()


def scores(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype=float)
    return score.asNondeterministic()(text)


def offending(text: Column, model: Model, least: float = THRESHOLD) -> Column:
    """array<struct<start, end, score>>: sentences whose own probability is at least ``least``."""
    @F.pandas_udf("array<struct<start: int, end: int, score: double>>")
    def locate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"start": a, "end": b, "score": p} for a, b, p in model.sentences(t) if p >= least]
                             for t in texts], dtype=object)
    return locate.asNondeterministic()(text)


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= 0.3).

    A null or empty text scores the base rate alone; a null id is not held out;
    repeated rows are scored each; columns beyond id and text are ignored; an
    empty table gives no rows.
    """
    return (docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                        scores(F.col(text_col), model).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, unchanged.

    A null or empty text has the base rate alone and stays unless that is over
    the threshold; null ids and repeated rows are judged like any other; an
    empty table stays empty.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       scores(F.col(text_col), model).alias("score"))
    return rows.filter(F.col("score") < THRESHOLD).select("row.*")
