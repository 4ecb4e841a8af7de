"""Ranked lexical search by pipelined term partitioning.

The terms of the items are dealt to a few owners, the rarest to the first.  An
owner holds the postings of its terms, cut into blocks of documents.  For every
block the items travel in bundles past one owner after another: each stage is a
cogroup of bundles and postings by block, in which the owner adds the integer
contributions of its terms to the bundle's sparse document accumulators.  After
the last owner the best documents of every block are merged.

Between stages an accumulator is dropped only when even the largest possible
contributions of the remaining terms leave it below ``k`` documents of the same
block, which it can then never pass.  So rankings are exact, and mostly the
rare terms' accumulators travel.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattflow.llm.common import cut

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
OWNERS = 4
BUNDLE_ITEMS = 32
# A block of documents ends at either of these.
BLOCK_DOCS = 8192
BLOCK_POSTINGS = 1 << 19
# Characters of item terms (with 16 more for each) that one pass over the documents looks for, about.
PASS_CHARS = 8 << 20
# 1e9 * tf // (1000 * tf + 20 * m) stays below this.
_IMPACT_BOUND = 1_000_000

_INDEX = "block long, n_docs long, n_terms long, ids binary, null binary, sizes binary, terms binary, at binary, tf binary"
_POSTINGS = "block long, terms binary, at binary, impact binary, ids binary, null binary"
_BUNDLE = "block long, bundle int, sizes binary, at binary, score binary"
_FOUND = "item int, doc_id long, score long"


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(text.encode().lower().decode()) if text else []


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, terms): the different terms of each item; rows of one id are one item,
    null is an id too, items without terms are left out."""
    @F.pandas_udf("array<string>")
    def different(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(set(terms_of(t))))
    # each term once before an item's are brought together, however many rows have its id
    rows = items.select(F.col(id_col).alias("item_id"), F.explode(different(F.col(text_col))).alias("term")).distinct()
    return rows.groupBy("item_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))


def _empty_block() -> tuple:
    """ids, null, sizes of the documents; terms, at, tf of the postings, without an object for each."""
    return array("q"), array("b"), array("q"), array("i"), array("H"), array("q")


def index(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block of documents: their ids and numbers of terms, and the postings of the
    vocabulary (term number, place in the block, occurrences). Documents without terms are left out."""
    number = {t: i for i, t in enumerate(vocabulary)}

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        ids, null, sizes, terms, at, tf = _empty_block()

        def done() -> pd.DataFrame:
            order = np.argsort(np.frombuffer(terms, np.int32), kind="stable") if terms else []
            pack = lambda x, kind: np.array(x, kind)[order].tobytes()
            return pd.DataFrame({
                "block": [block], "n_docs": [len(ids)], "n_terms": [sum(sizes)],
                "ids": [np.array(ids, np.int64).tobytes()], "null": [np.array(null, bool).tobytes()],
                "sizes": [np.array(sizes, np.int64).tobytes()], "terms": [pack(terms, np.int32)],
                "at": [pack(at, np.uint16)], "tf": [pack(tf, np.int64)]})
        for pdf in batches:
            for i, missing, text in zip(pdf["id"], pdf["null"], pdf["text"]):
                found = terms_of(text)
                if not found:
                    continue
                mine = [(number[t], n) for t, n in Counter(found).items() if t in number]
                terms.extend([t for t, _ in mine])
                tf.extend([n for _, n in mine])
                at.extend([len(ids)] * len(mine))
                ids.append(i)
                null.append(missing)
                sizes.append(len(found))
                if len(ids) >= BLOCK_DOCS or len(terms) >= BLOCK_POSTINGS:
                    yield done()
                    block += 1
                    ids, null, sizes, terms, at, tf = _empty_block()
        if ids:
            yield done()

    i = F.col(id_col).cast("long")
    return docs.select(F.coalesce(i, F.lit(0)).alias("id"), i.isNull().alias("null"),
                       F.col(text_col).alias("text")).mapInPandas(build, _INDEX)


def _document_counts(blocks: DataFrame, n: int) -> np.ndarray:
    """In how many documents each of the n terms stands."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n, np.int64)
        for pdf in batches:
            for terms in pdf["terms"]:
                total += np.bincount(np.frombuffer(terms, np.int32), minlength=n)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": some.astype(np.int32), "df": total[some]})
    df = np.zeros(n, np.int64)
    for r in blocks.select("terms").mapInPandas(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    return df


def _owners(df: np.ndarray, owners: int) -> np.ndarray:
    """The owner of each term: ascending document counts, an even share of all postings each."""
    order = np.lexsort((np.arange(len(df)), df))
    before = np.cumsum(df[order]) - df[order]
    owner = np.zeros(len(df), np.int64)
    owner[order] = np.minimum(before * owners // max(int(df.sum()), 1), owners - 1)
    return owner


def _postings(blocks: DataFrame, mine: np.ndarray, n_docs: int, n_terms: int, last: bool) -> DataFrame:
    """An owner's postings of every block, the occurrences turned into impacts."""
    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                terms = np.frombuffer(r.terms, np.int32)
                keep = mine[terms]
                at, tf = np.frombuffer(r.at, np.uint16)[keep], np.frombuffer(r.tf, np.int64)[keep]
                sizes = np.frombuffer(r.sizes, np.int64)
                # Python integers: the product may pass 64 bits
                m = np.array([50 + 50 * int(s) * n_docs // n_terms for s in sizes], np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[at])
                yield pd.DataFrame({"block": [r.block], "terms": [terms[keep].tobytes()], "at": [at.tobytes()],
                                    "impact": [impact.astype(np.int32).tobytes()],
                                    "ids": [r.ids if last else b""], "null": [r.null if last else b""]})
    return blocks.select("block", "ids", "null", "sizes", "terms", "at", "tf").mapInPandas(select, _POSTINGS)


def _stage(items: list[np.ndarray], weight: np.ndarray, owner: np.ndarray, stage: int, k: int, last: bool):
    """What an owner does to the bundles of a block; the last one gives the k best of each item."""
    rest = np.array([_IMPACT_BOUND * int(weight[t[owner[t] > stage]].sum()) for t in items], np.int64)

    def add(bundles: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(postings):
            block = postings.iloc[0]
            terms, at = np.frombuffer(block["terms"], np.int32), np.frombuffer(block["at"], np.uint16)
            gain = weight[terms] * np.frombuffer(block["impact"], np.int32)
            ids, null = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["null"], bool)
        for b in bundles.itertuples():
            sizes = np.frombuffer(b.sizes, np.int32)
            places, scores = np.frombuffer(b.at, np.uint16), np.frombuffer(b.score, np.int64)
            ends = np.cumsum(sizes)
            n_sizes, n_places, n_scores = [], [], []
            for j, end in enumerate(ends):
                item = b.bundle * BUNDLE_ITEMS + j
                total = np.zeros(BLOCK_DOCS, np.int64)
                total[places[end - sizes[j]:end]] = scores[end - sizes[j]:end]
                mine = items[item][owner[items[item]] == stage]
                for lo, hi in zip(np.searchsorted(terms, mine), np.searchsorted(terms, mine, side="right")):
                    total[at[lo:hi]] += gain[lo:hi]
                kept = np.flatnonzero(total)
                if len(kept) > k:
                    least = np.partition(total[kept], len(kept) - k)[len(kept) - k]
                    kept = kept[total[kept] >= least - rest[item]]
                if last:
                    kept = kept[np.lexsort((ids[kept], null[kept], -total[kept]))[:k]]
                    out.append(pd.DataFrame({"item": np.full(len(kept), item, np.int32), "doc_id":
                               pd.arrays.IntegerArray(ids[kept], null[kept].copy()), "score": total[kept]}))
                n_sizes.append(len(kept))
                n_places.append(kept.astype(np.uint16))
                n_scores.append(total[kept])
            if not last:
                out.append(pd.DataFrame({
                    "block": [b.block], "bundle": [b.bundle], "sizes": [np.array(n_sizes, np.int32).tobytes()],
                    "at": [np.concatenate(n_places).tobytes()], "score": [np.concatenate(n_scores).tobytes()]}))
        return pd.concat(out)
    return add


def _pass(docs: DataFrame, items: list, k: int, id_col: str, text_col: str, owners: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of every block for the items of one pass."""
    vocabulary = sorted({t for r in items for t in r.terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    wanted = [np.array([number[t] for t in r.terms], np.int64) for r in items]
    blocks = cut(index(docs, vocabulary, id_col, text_col), "postings")
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = _document_counts(blocks, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    owner = _owners(df, owners)
    empty = [np.zeros(len(wanted[at:at + BUNDLE_ITEMS]), np.int32).tobytes() for at in range(0, len(wanted), BUNDLE_ITEMS)]
    none = F.lit(b"").alias
    bundles = blocks.select("block", F.posexplode(F.array(*[F.lit(x) for x in empty])).alias("bundle", "sizes"),
                            none("at"), none("score"))
    for stage in range(owners):
        last = stage == owners - 1
        postings = _postings(blocks, owner == stage, n_docs, n_terms, last)
        bundles = bundles.groupBy("block").cogroup(postings.groupBy("block")).applyInPandas(
            _stage(wanted, weight, owner, stage, k, last), _FOUND if last else _BUNDLE)
    return bundles


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", owners: int = OWNERS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for every item.

    A score sums, over the item's different terms, weight * (1e9 * tf div
    (1000 * tf + 20 * m)) with weight floor(1000 * ln((2N + 2) / (2 df + 1)))
    and m = 50 + (50 n N div L); N, L and df cover all documents with a term.
    Equal scores rank by ascending doc_id, a null one last.  Repeated documents
    rank each; rows of one item id (null too) are one item; null and empty texts
    have no terms; columns beyond id and text are ignored; empty tables give no
    rows.  Items are taken in passes of bounded size, each of which reads the
    documents once.
    """
    spark = docs.sparkSession
    wanted = cut(item_terms(items, item_col, item_text), "items")
    chars = wanted.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.length(t) + 16))).first()[0] or 0
    passes = max(1, math.ceil(chars / PASS_CHARS))
    found = []
    for p in range(passes):
        some = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).orderBy("item_id").collect()
        if not some:
            continue
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(some)],
                                      f"item int, item_id {wanted.schema['item_id'].dataType.simpleString()}")
        found.append(_pass(docs, some, k, id_col, text_col, owners).join(F.broadcast(names), "item").drop("item"))
    if not found:
        return wanted.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"),
                                      F.lit(0).cast("long").alias("score"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return (rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
