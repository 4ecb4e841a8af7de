"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits; bit i is set when more than half of the shingle
hashes have it.  Fingerprints that differ in at most d bits agree in at least
``blocks - d`` of the blocks they are split into, so they share one of the
block combinations of that size.  Distinct fingerprints are joined on each
combination and the Hamming distance of every pair is verified.

A combination shared by very many fingerprints is not paired off.  There each
member is hung under all its variants of at most half the distance away (in
the bits outside the shared blocks); two members are within d bits exactly if
they meet at a variant, and members that meet there are chained instead of
paired.  That is exact for even d and grows in proportion to the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattflow.llm.common import attach, connected_components, cut

SHINGLE = 3
DISTANCE = 2
SEED = 42
BLOCKS = 4
# Fingerprints of one block combination that are still paired off.
PAIRED = 64
# Bytes of a text that are split into words at a time.
PIECE = 1 << 20
_STRIP = 1 << 14


def _word_pieces(text: str) -> Iterator[list[bytes]]:
    """Words (A-Z lower-cased, parted by space and \\x09-\\x0D) in lists of bounded size."""
    raw = text.encode().lower()
    at = 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        yield raw[at:end].split()
        at = end


def _bit_counts(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 without words."""
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, np.int64), 0
    tail: list[bytes] = []
    hashes: list[int] = []
    for words in _word_pieces(text or ""):
        words = tail + words
        if len(words) < shingle:
            tail = words
            continue
        columns = [words[j:len(words) - shingle + 1 + j] for j in range(shingle)]
        for s in map(b" ".join, zip(*columns)):
            hashes.append(digest(s, seed))
            if len(hashes) >= _STRIP:
                counts, total, hashes = counts + _bit_counts(hashes), total + len(hashes), []
        tail = words[len(words) - shingle + 1:]
    if not total and not hashes and tail:
        hashes = [digest(b" ".join(tail), seed)]
    if hashes:
        counts, total = counts + _bit_counts(hashes), total + len(hashes)
    if not total:
        return 0
    return int(np.packbits((2 * counts > total).astype(np.uint8)).view(">u8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint as a (signed) long; a null text has none of words."""
    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))
    return simhash.asNondeterministic()(text)


def _masks(blocks: int, agree: int) -> list[int]:
    """Signed bit masks of all combinations of ``agree`` of the blocks."""
    edges = [64 * b // blocks for b in range(blocks + 1)]
    one = [((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in range(blocks)]
    return [int(np.uint64(sum(c)).view(np.int64)) for c in combinations(one, agree)]


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS,
          paired: int = PAIRED) -> DataFrame:
    """(a, b) edges between distinct fingerprints (column ``fp``), enough to connect
    exactly those that chains of links within ``distance`` bits connect."""
    if distance % 2 or not 0 < distance < blocks:
        raise ValueError("distance must be even, positive and below the number of blocks")
    masks = _masks(blocks, blocks - distance)
    keyed = prints.select("fp", F.inline(F.array(*[
        F.struct(F.lit(n).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for n, m in enumerate(masks)])))
    keyed = keyed.withColumn("block", F.xxhash64("part", "key"))
    sizes = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sized = attach(keyed, sizes.withColumn("size", F.col("n")), "block", "n", ["fp"]).filter("size > 1")
    sized, few = cut(sized, "blocks"), F.col("size") <= paired
    left = sized.filter(few).select("block", "part", "key", F.col("fp").alias("a"))
    right = sized.filter(few).select("block", "part", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = left.join(right, ["block", "part", "key"]).filter((F.col("a") < F.col("b")) & near).select("a", "b")

    free = F.element_at(F.array(*[F.lit(~m) for m in masks]), F.col("part") + 1)
    crowded = sized.filter(~few).select("part", "fp", free.alias("free"))
    variants = crowded.select("part", "fp", "free", F.col("fp").alias("meet"))
    for _ in range(distance // 2):
        flipped = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
        allowed = F.filter(flipped, lambda bit: bit.bitwiseAND(F.col("free")) != 0)
        variants = variants.select("part", "fp", "free", F.explode(F.concat(
            F.array(F.col("meet")), F.transform(allowed, lambda bit: F.col("meet").bitwiseXOR(bit))))
            .alias("meet"))
    # a variant has few members, so its smallest stands for all of them
    least = variants.groupBy("part", "meet").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))
    met = (least.filter(F.size("all") > 1).select("a", F.explode("all").alias("b"))
           .filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return pairs.unionByName(met).distinct()


def _classes(rows: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, row, fp): (fp, n, component) and (component, members, best), where ``best``
    is the row of smallest (id, row hash) of the component, null ids last."""
    best = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")
    prints = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("best"))
    nodes = connected_components(links(prints, distance), "a", "b")
    classes = cut(prints.join(nodes, F.col("fp") == F.col("node"), "left")
                  .select("fp", "n", "best", F.coalesce("component", "fp").alias("component")), "classes")
    return classes.drop("best"), classes.groupBy("component").agg(
        F.count(F.lit(1)).alias("members"), F.min("best").alias("best"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (smallest doc_id reachable).

    Equal fingerprints are one class; classes are linked by ``links`` and closed
    by connected components.  A null or empty text has fingerprint 0 like any
    text without words; a null id is never the smallest unless all are null;
    repeated rows are kept; other columns are ignored; an empty table gives no rows.
    """
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.lit(0).alias("row"),
                           fingerprints(F.col(text_col), shingle).alias("fp")), "fingerprints")
    classes, smallest = _classes(rows, distance)
    of_print = attach(classes, smallest, "component", "members", ["fp"]).select(
        "fp", "n", F.col("best.doc_id").alias("component_id"))
    return attach(rows.drop("row"), cut(of_print, "classes"), "fp", "n", ["doc_id"])


def first_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` that stand for their group, unchanged: the one of smallest id in each.

    Of several rows with that id the one of the smallest row hash stays; a group
    whose ids are all null keeps one row too; equal rows are kept once.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(*columns).alias("row"),
                       F.col(text_col).alias("text"))
    rows = cut(rows.select("doc_id", "row", fingerprints(F.col("text"), shingle).alias("fp")), "fingerprints")
    _, smallest = _classes(rows, distance)
    kept = smallest.select(F.col("best.doc_id").alias("kept_id"), F.col("best.row").alias("kept_row"))
    same = lambda a, b, c, d: F.col(a).eqNullSafe(F.col(b)) & (F.col(c) == F.col(d))
    # equal rows need folding; only they are moved a second time
    repeated = cut(rows.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                   .select(F.col("doc_id").alias("many_id"), F.col("row").alias("many_row")), "repeated")
    whole = docs.select(F.col(id_col).alias("id"), F.xxhash64(*columns).alias("hash"), F.struct(*columns).alias("whole"))
    if repeated.isEmpty():
        return whole.join(kept, same("id", "kept_id", "hash", "kept_row"), "left_semi").select("whole.*")
    kept = cut(kept.join(repeated, same("kept_id", "many_id", "kept_row", "many_row"), "left")
               .select("kept_id", "kept_row", F.col("many_row").isNotNull().alias("many")), "kept")
    once, more = (whole.join(kept.filter(f), same("id", "kept_id", "hash", "kept_row"), "left_semi") for f in ("not many", "many"))
    folded = more.groupBy("id", "hash").agg(F.first("whole").alias("whole"))
    return once.select("whole.*").unionByName(folded.select("whole.*"))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
