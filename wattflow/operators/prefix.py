"""Ordered per-key scans that stay spread when one key holds most rows.

A plain ``Window.partitionBy(key)`` puts each key in one task.  ``chunked_scan``
cuts each key's ordered rows at quantiles of the whole order key and a hash of
the row (equal shares of rows, even if all have one date), runs the window
inside (key, chunk) groups, and stitches the chunks together with a small
per-chunk summary:

* running position and exclusive running sums = chunk offset + local value,
* lag 1 / lag 2 across a chunk edge = the previous chunks' last rows,
* first value of the key = first row of its first chunk.

It is meant for the keys above a row bound (``plans.by_size``).  Their quantiles
and summaries (at most CHUNKS rows a key) meet the rows in ordinary joins, so
that any number of keys may be above the bound: adaptive execution broadcasts
them where they are small and splits the partition of a very large key where
they are not.  What follows such a join is dealt anew by (key, chunk), so that
the windows never run over a whole key.  Rows that the order does not tell
apart may fall into neighbouring chunks, as in a plain window they may stand in
any order; where they fall is a hash of the row, the same in every scan.  Sums
are exact as long as their expressions are integers or decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNKS = 256
# Rows of a key, about, of which every so many'th is a cut.
SAMPLED_PER_CUT = 16


def with_chunks(df: DataFrame, keys: list[str], order: list[str], chunks: int = CHUNKS) -> DataFrame:
    """``df`` plus ``_chunk``: how many of the key's cuts lie before the row.

    Cuts are quantiles of (order..., hash of the row), taken from about
    SAMPLED_PER_CUT * chunks rows of the key that their hashes choose.  They
    only balance the chunks; no result depends on them.
    """
    row = F.xxhash64(*df.columns)
    place = F.struct(*order, row.alias("_row"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    chosen = F.pmod(F.xxhash64(row, F.lit("cut")), F.lit(1 << 30)) / F.lit(1 << 30) < F.lit(SAMPLED_PER_CUT * chunks) / F.col("_size")
    # dealt after the join, so that a very large key is not read by one task for its sample
    sample = (df.join(sizes, keys).where(chosen).select(*keys, place.alias("_place")).repartition(*keys).groupBy(*keys)
              .agg(F.sort_array(F.collect_list("_place")).alias("_all")))
    step = F.greatest(F.lit(1), F.floor(F.size("_all") / F.lit(chunks)).cast("int"))
    cuts = sample.select(*keys, F.filter("_all", lambda c, i: (i + 1) % step == 0).alias("_cuts"))
    return (df.join(cuts, keys, "left")
            .withColumn("_chunk", F.coalesce(F.size(F.filter("_cuts", lambda c: c < place)), F.lit(0))).drop("_cuts")
            .repartition(*keys, "_chunk"))


def _summary(base: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column],
             lags: list[str], firsts: list[str]) -> DataFrame:
    """Per (key, chunk): what the chunks after it need to know of those before."""
    part = keys + ["_chunk"]
    up = Window.partitionBy(*part).orderBy(*order)
    x = base.select(*part, *[F.col(c).alias(f"_l_{c}") for c in lags], *[F.col(c).alias(f"_f_{c}") for c in firsts],
                    *[e.alias(f"_s_{k}") for k, e in sums.items()],
                    F.row_number().over(up).alias("_up"), F.count(F.lit(1)).over(Window.partitionBy(*part)).alias("_cn"))
    last = F.col("_cn") - F.col("_up") + 1
    s = x.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_cn"),
        *[F.sum(f"_s_{k}").alias(f"_cs_{k}") for k in sums],
        *[F.max(F.when(last == 1, F.col(f"_l_{c}"))).alias(f"_t1_{c}") for c in lags],
        *[F.max(F.when(last == 2, F.col(f"_l_{c}"))).alias(f"_t2_{c}") for c in lags],
        *[F.max(F.when(F.col("_up") == 1, F.col(f"_f_{c}"))).alias(f"_f_{c}") for c in firsts])
    w = Window.partitionBy(*keys).orderBy("_chunk")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    two = F.lag("_cn", 1).over(w) >= 2
    return s.select(
        *part, F.sum("_cn").over(whole).alias("_n"), F.coalesce(F.sum("_cn").over(before), F.lit(0)).alias("_on"),
        *[F.sum(f"_cs_{k}").over(before).alias(f"_os_{k}") for k in sums],
        *[F.lag(f"_t1_{c}", 1).over(w).alias(f"_p1_{c}") for c in lags],
        *[F.when(two, F.lag(f"_t2_{c}", 1).over(w)).otherwise(F.lag(f"_t1_{c}", 2).over(w)).alias(f"_p2_{c}")
          for c in lags],
        *[F.first(f"_f_{c}").over(whole).alias(f"_first_{c}") for c in firsts])


def chunked_scan(x: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None,
                 lags: list[str] | None = None, firsts: list[str] | None = None,
                 base: DataFrame | None = None) -> DataFrame:
    """Add ordered-scan columns to ``x``, which has ``_chunk`` (``with_chunks`` on ``keys`` or fewer of them):

    ``_rn`` position in key (1-based), ``_n`` rows in key, for each sum name
    ``_before_<name>`` (sum over earlier rows of the key, 0 if none), for each
    lag column ``_lag1_<c>`` / ``_lag2_<c>``, for each first column
    ``_first_<c>``.  ``base`` may name an earlier form of ``x`` that has all the
    summary needs, so that columns added since are not computed twice.
    """
    sums, lags, firsts = sums or {}, lags or [], firsts or []
    part = keys + ["_chunk"]
    w = Window.partitionBy(*part).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    local = x.select(
        "*", F.row_number().over(w).alias("_lrn"),
        *[F.sum(e).over(before).alias(f"_lb_{k}") for k, e in sums.items()],
        *[F.lag(c, 1).over(w).alias(f"_ll1_{c}") for c in lags],
        *[F.lag(c, 2).over(w).alias(f"_ll2_{c}") for c in lags])
    y = local.join(_summary(x if base is None else base, keys, order, sums, lags, firsts), part)
    lrn = F.col("_lrn")
    return y.select(
        *x.columns, "_n", (F.col("_on") + lrn).cast("int").alias("_rn"),
        *[(F.coalesce(F.col(f"_os_{k}"), F.lit(0)) + F.coalesce(F.col(f"_lb_{k}"), F.lit(0))).alias(f"_before_{k}")
          for k in sums],
        *[F.when(lrn >= 2, F.col(f"_ll1_{c}")).otherwise(F.col(f"_p1_{c}")).alias(f"_lag1_{c}") for c in lags],
        *[F.when(lrn >= 3, F.col(f"_ll2_{c}")).when(lrn == 2, F.col(f"_p1_{c}"))
          .otherwise(F.col(f"_p2_{c}")).alias(f"_lag2_{c}") for c in lags],
        *[F.col(f"_first_{c}") for c in firsts])


def ordered_scan(df: DataFrame, keys: list[str], order: list[str],
                 sums: dict[str, Column] | None = None, lags: list[str] | None = None,
                 firsts: list[str] | None = None, chunked: bool = False, chunks: int = CHUNKS) -> DataFrame:
    """``chunked_scan``'s columns, by plain windows or by chunks."""
    sums, lags, firsts = sums or {}, lags or [], firsts or []
    if chunked:
        return chunked_scan(with_chunks(df, keys, order, chunks), keys, order, sums, lags, firsts).drop("_chunk")
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select(
        "*", F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"),
        F.row_number().over(w).alias("_rn"),
        *[F.coalesce(F.sum(e).over(before), F.lit(0)).alias(f"_before_{k}") for k, e in sums.items()],
        *[F.lag(c, 1).over(w).alias(f"_lag1_{c}") for c in lags],
        *[F.lag(c, 2).over(w).alias(f"_lag2_{c}") for c in lags],
        *[F.first(c).over(whole).alias(f"_first_{c}") for c in firsts])
