"""Exact top-k search by exhaustive term-at-a-time accumulation.

Queries and candidates are sparse integer vectors.  Both are dealt into blocks
of bounded size by a hash of their id, and every query block meets every
candidate block once.  Inside such a cell the candidates are turned into
postings (term -> positions and weights); the terms of the query rows are taken
one after another and scatter weight products into dense score arrays, from
which the k best per query are selected by partition.  The partial lists of all
cells are merged by a ranked window, so a result is exact and no task holds
more than one query block and one candidate block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 2048
# Score arrays of one pass: candidates of the block x this many query rows.
QUERY_STRIP = 64

_CELL_SCHEMA = "query_id long, vec_id long, score long, copies int"
_LONG = np.iinfo(np.int64)


def sparse_rows(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, terms, weights): the non-zero components of floor(scale * x), x as double.

    Rows with a null id, a null vector, or a null or non-finite component are
    left out.  Vectors may differ in length (a missing component is 0).
    """
    x = F.col("_x")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    scaled = F.transform(x, lambda v, i: F.struct(
        i.cast("int").alias("term"), F.floor(v * F.lit(float(scale))).cast("double").alias("w")))
    return (vectors.select(F.col(id_col).cast("long").alias("id"),
                           F.col(vector_col).cast("array<double>").alias("_x"))
            .filter(F.col("id").isNotNull() & x.isNotNull()).filter(finite)
            .select("id", F.filter(scaled, lambda s: s["w"] != 0).alias("s"))
            .select("id", F.col("s.term").alias("terms"), F.col("s.w").alias("weights")))


def _flat(col) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated values of a column of arrays, and the row each value is from."""
    sizes = np.fromiter((len(x) for x in col), np.int64, len(col))
    values = np.concatenate([np.asarray(x) for x in col]) if len(col) else np.zeros(0)
    return values, np.repeat(np.arange(len(col)), sizes)


def _search_cell(queries: pd.DataFrame, cands: pd.DataFrame, k: int) -> pd.DataFrame:
    cands = cands.sort_values("id", kind="stable").reset_index(drop=True)
    ids = cands["id"].to_numpy(np.int64)
    c_term, c_row = _flat(cands["terms"])
    c_weight, _ = _flat(cands["weights"])
    q_term, q_row = _flat(queries["terms"])
    q_weight, _ = _flat(queries["weights"])
    # the narrowest sums that provably hold every score, else Python integers
    most = (np.abs(c_weight).max(initial=0), np.abs(q_weight).max(initial=0))
    longest = max(np.bincount(q_row).max(initial=0), 1)
    bound = float(most[0]) * float(most[1]) * float(longest)
    kind = np.int32 if bound < 2.0 ** 30 else np.int64 if bound < 2.0 ** 62 else object
    small = kind is not object
    as_int = (lambda a: a.astype(kind)) if small else (
        lambda a: np.array([int(v) for v in a], dtype=object))
    c_weight, q_weight = as_int(c_weight), as_int(q_weight)
    order = np.argsort(c_term, kind="stable")
    c_term, c_row, c_weight = c_term[order], c_row[order], c_weight[order]
    qids = queries["id"].to_numpy(np.int64)
    copies = cands["copies"].to_numpy(np.int32)
    found_q, found_v, found_s, found_n = [], [], [], []
    for start in range(0, len(qids), QUERY_STRIP):
        strip = qids[start:start + QUERY_STRIP]
        scores = np.zeros((len(ids), len(strip)), dtype=kind)
        mine = (q_row >= start) & (q_row < start + len(strip))
        terms, rows, weights = q_term[mine], q_row[mine] - start, q_weight[mine]
        for term in np.unique(terms):
            lo, hi = np.searchsorted(c_term, term), np.searchsorted(c_term, term, side="right")
            if lo == hi:
                continue
            at = terms == term
            weight = np.zeros(len(strip), dtype=kind)
            np.add.at(weight, rows[at], weights[at])
            scores[c_row[lo:hi]] += c_weight[lo:hi, None] * weight[None, :]
        for j, qid in enumerate(strip):
            allowed = np.flatnonzero(ids != qid)
            s = scores[allowed, j]
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                above = np.flatnonzero(s > least)
                ties = np.flatnonzero(s == least)[:k - len(above)]  # ids ascend: smallest first
                keep = np.concatenate([above, ties])
            else:
                keep = np.arange(len(s))
            found_q.append(np.full(len(keep), qid))
            found_v.append(ids[allowed[keep]])
            found_s.append(s[keep])
            found_n.append(copies[allowed[keep]])
    cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    score = cat(found_s)
    if small:
        score = score.astype(np.int64)
    else:
        score = np.array([min(max(int(v), _LONG.min), _LONG.max) for v in score], dtype=np.int64)
    return pd.DataFrame({"query_id": cat(found_q), "vec_id": cat(found_v), "score": score,
                         "copies": cat(found_n)})


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5,
          candidates_per_block: int = CANDIDATES_PER_BLOCK,
          queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """The k candidates of largest inner product for every query row.

    Inputs are sparse rows (id, terms, weights).  Candidates that carry the
    query's own id are left out; fewer than k candidates give fewer rows; equal
    scores go to the smaller vec_id.  Repeated candidate rows each take a rank;
    repeated query rows count once (two different vectors under one query id
    are ranked together).  Scores beyond 64 bits are exact while ranking within
    a block and are returned as the nearest 64-bit value.  Empty inputs give an
    empty result.  Columns: query_id, rank (from 1), vec_id, score.
    """
    key = ["id", "terms", "weights"]
    queries = queries.select(key).distinct()
    # of a repeated candidate row no more than k copies can rank
    candidates = candidates.groupBy(key).agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies"))
    n_q, n_c = queries.count(), candidates.count()
    q_blocks = max(1, math.ceil(n_q / queries_per_block))
    c_blocks = max(1, math.ceil(n_c / candidates_per_block))
    row = F.xxhash64(*key)
    q = (queries.withColumn("qb", F.pmod(row, F.lit(q_blocks)).cast("int"))
         .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))))
    c = (candidates.withColumn("cb", F.pmod(row, F.lit(c_blocks)).cast("int"))
         .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _search_cell(left, right, k)

    part = (q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb"))
            .applyInPandas(cell, _CELL_SCHEMA))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    merged = part.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    each = merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return (each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
