"""Quality slices, filters and binned distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattflow.functions.numeric import fixed_ratio

# Fixed values from the reference notebooks: missing-share thresholds and the
# cap on average daily use.
HALF = 0.5
TENTH = 0.1
DAILY_CAP = 100


def select_present(df: DataFrame, cols: list[str]) -> DataFrame:
    """Select the listed columns that exist, ignoring the rest."""
    have = set(df.columns)
    return df.select(*[c for c in cols if c in have])


def fill_minus_one(df: DataFrame) -> DataFrame:
    """-1 in numeric columns and "-1" in text columns; dates stay null."""
    return df.na.fill(-1).na.fill("-1")


def slice_counts(df: DataFrame, share_col: str = "perc_missing") -> DataFrame:
    """Rows per missing-share slice and their share of all rows, in one pass.

    Both bounds at 0.5 are inclusive, so a share of exactly 0.5 is in both (T27).
    """
    s = F.col(share_col)
    agg = df.agg(F.count(F.lit(1)).alias("n_total"),
                 F.count_if(s >= HALF).alias("ge_half"),
                 F.count_if(s <= HALF).alias("le_half"),
                 F.count_if(s <= TENTH).alias("le_tenth"))
    long = agg.select("n_total", F.expr(
        "stack(3, 'ge_half', ge_half, 'le_half', le_half, 'le_tenth', le_tenth) AS (slice, n_rows)"))
    return long.select("slice", "n_rows", fixed_ratio(F.col("n_rows"), F.col("n_total"), 10, 4).alias("share"))


def clean_rows(df: DataFrame, share_col: str = "perc_missing", max_share: float = TENTH,
               cap: float = DAILY_CAP, lag_col: str = "daily_kwh_lag") -> DataFrame:
    """Low-missing rows under the daily cap with a finite lag."""
    lag = F.col(lag_col)
    return df.where((F.col(share_col) <= max_share)
                    & (F.col("avg_kwh_day_over_invoice") <= cap)
                    & lag.isNotNull() & ~F.isnan(lag.cast("double")))


def quality_summary(df: DataFrame, share_col: str = "perc_missing", avg_col: str = "tavg_interval_avg") -> DataFrame:
    """Kept shares, rows under the cap and the any-missing check in one pass."""
    s = F.col(share_col)
    capped = (s <= TENTH) & (F.col("avg_kwh_day_over_invoice") <= DAILY_CAP)
    a = F.col(avg_col).cast("double")
    agg = df.agg(F.count(F.lit(1)).alias("n_total"),
                 F.count_if(s <= HALF).alias("_half"),
                 F.count_if(s <= TENTH).alias("_tenth"),
                 F.count_if(capped).alias("n_capped"),
                 F.coalesce(F.bool_or(capped & (a.isNull() | F.isnan(a))), F.lit(False)).alias("any_missing_avg"))
    return agg.select("n_total",
                      fixed_ratio(F.col("_half"), F.col("n_total"), 10, 4).alias("share_le_half"),
                      fixed_ratio(F.col("_tenth"), F.col("n_total"), 10, 4).alias("share_le_tenth"),
                      "n_capped", "any_missing_avg")


def histogram(df: DataFrame, col: str, width: float) -> DataFrame:
    """Counts per fixed-width bin (D21): bin = floor(x / width)."""
    b = F.floor(F.col(col) / F.lit(width)).cast("int")
    return df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density_grid(df: DataFrame, x: str, y: str, x_width: float, y_width: float) -> DataFrame:
    """Counts per rectangular (x, y) bin."""
    bx = F.floor(F.col(x) / F.lit(x_width)).cast("int")
    by = F.floor(F.col(y) / F.lit(y_width)).cast("int")
    return (df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
            .groupBy(bx.alias("bin_x"), by.alias("bin_y")).agg(F.count(F.lit(1)).alias("n")))


# The usual rule of distribution plots, and its limit of bins.
MAX_BINS = 50
SKETCH = 100_000  # accuracy of the quantile sketch: exact up to so many rows, within 1e-5 of the ranks beyond


def _bins(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: of each column the lowest value and the width and number of its bins.

    Width 2 * (q3 - q1) / n ** (1 / 3), at most MAX_BINS bins over the whole
    range, sqrt(n) of them when the quartiles are equal, one when all values are.
    """
    stats = df.agg(F.count(F.lit(1)).cast("double").alias("n"), *[e for i, c in enumerate(cols) for e in (
        F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"),
        F.percentile_approx(c, [0.25, 0.75], SKETCH).alias(f"q{i}"))])

    def number(i: int) -> F.Column:
        span, wide = F.col(f"hi{i}") - F.col(f"lo{i}"), F.col(f"q{i}")[1] - F.col(f"q{i}")[0]
        by_width = F.ceil(span / (2 * wide / F.cbrt("n")))
        return F.when(span == 0, F.lit(1)).otherwise(F.least(F.lit(MAX_BINS), F.when(
            wide == 0, F.floor(F.sqrt("n"))).otherwise(by_width)).cast("int"))
    return stats.select(*[e for i in range(len(cols)) for e in (
        F.col(f"lo{i}"), number(i).alias(f"k{i}"), ((F.col(f"hi{i}") - F.col(f"lo{i}")) / number(i)).alias(f"w{i}"))])


def _place(x: F.Column, i: int) -> F.Column:
    lo, k, w = (F.col(f"{c}{i}") for c in ("lo", "k", "w"))
    return F.when(w == 0, F.lit(0)).otherwise(F.least(F.floor((x - lo) / w).cast("int"), k - 1))


def histogram_auto(df: DataFrame, col: str) -> DataFrame:
    """Counts per bin, with bins chosen from the data (D21): bin, from_value, width, n.

    The bins are one row that the same plan computes and broadcasts.
    """
    rows = df.select(F.col(col).cast("double").alias("v0")).where(F.col("v0").isNotNull())
    placed = rows.join(F.broadcast(_bins(rows, ["v0"]))).withColumn("bin", _place(F.col("v0"), 0))
    return (placed.groupBy("bin", "lo0", "w0").agg(F.count(F.lit(1)).alias("n"))
            .select("bin", (F.col("lo0") + F.col("bin") * F.col("w0")).cast("decimal(18,6)").alias("from_value"),
                    F.col("w0").cast("decimal(18,6)").alias("width"), "n"))


def density_grid_auto(df: DataFrame, x: str, y: str) -> DataFrame:
    """Counts per rectangular bin of two columns, both with bins chosen from the data."""
    rows = df.select(F.col(x).cast("double").alias("v0"), F.col(y).cast("double").alias("v1")).na.drop()
    placed = rows.join(F.broadcast(_bins(rows, ["v0", "v1"])))
    return (placed.groupBy(_place(F.col("v0"), 0).alias("bin_x"), _place(F.col("v1"), 1).alias("bin_y"))
            .agg(F.count(F.lit(1)).alias("n")))
