"""Per-account window features.

All windows are partitioned by account, so one exchange serves them all; the
(account, month) window reuses it with an extra sort.  Ties on the invoice
end date are broken by start date and kWh so results are deterministic (T8).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattflow.functions.numeric import mean4, null_flag
from wattflow.operators.prefix import CHUNKS, chunked_scan, with_chunks

ORDER = ["to_dt", "from_dt", "kwh"]


def exact_avg4(c: str, w) -> F.Column:
    """Windowed mean as an exact decimal, rounded once (half up) to 4 places."""
    x = F.col(c)
    return mean4(F.sum(x).over(w), F.count(x).over(w), 2)


def account_window(order: list[str] | None = None):
    return Window.partitionBy("account_id").orderBy(*(order or ORDER))


def invoice_sequence(df: DataFrame, daily_col: str = "avg_kwh_day_over_invoice") -> DataFrame:
    """Invoice number and lags 1, 2 of kWh and daily kWh."""
    w = account_window()
    return df.select(
        "*",
        F.row_number().over(w).cast("int").alias("invoice_num"),
        F.lag("kwh", 1).over(w).alias("kwh_lag"),
        F.lag("kwh", 2).over(w).alias("kwh_lag_2"),
        F.lag(daily_col, 1).over(w).alias("daily_kwh_lag"),
        F.lag(daily_col, 2).over(w).alias("daily_kwh_lag_2"))


def expanding_features(df: DataFrame, daily_col: str = "avg_kwh_day_over_invoice") -> DataFrame:
    """Expanding averages of the lags, first date, days passed, month average."""
    running = account_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = account_window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    month_before = (Window.partitionBy("account_id", "todt_month").orderBy(*ORDER)
                    .rowsBetween(Window.unboundedPreceding, -1))
    first_date = F.first("from_dt").over(whole)
    out = df.select(
        "*",
        exact_avg4("kwh_lag", running).alias("kwh_updating_avg"),
        exact_avg4("daily_kwh_lag", running).alias("daily_kwh_updating_avg"),
        first_date.alias("first_date"),
        F.datediff("to_dt", first_date).alias("days_passed"),
        exact_avg4(daily_col, month_before).alias("month_avg_preceding"))
    return out.withColumn("month_avg_preceding_flag", null_flag("month_avg_preceding"))


def attribute_flags(df: DataFrame, columns=("gender", "billing_address2", "county_fips", "rate_class")) -> DataFrame:
    """0/1 presence flags for nullable attributes (H9)."""
    return df.withColumns({c + "_flag": null_flag(c) for c in columns})


def feature_windows(df: DataFrame, daily_col: str = "avg_kwh_day_over_invoice",
                    chunked: bool = False) -> DataFrame:
    """All window features (E1-E8): plain windows by account, or chunks for accounts of any size."""
    if chunked:
        return chunked_feature_windows(df, daily_col)
    return expanding_features(invoice_sequence(df, daily_col), daily_col)


def chunked_feature_windows(df: DataFrame, daily_col: str = "avg_kwh_day_over_invoice",
                            chunks: int = CHUNKS) -> DataFrame:
    """``invoice_sequence`` + ``expanding_features`` through chunked scans that share their chunks."""
    def present(c):
        return F.col(c).isNotNull().cast("long")

    def mean_before(c, scale):
        n = F.col(f"_before_{c}_n")
        return mean4(F.col(f"_before_{c}"), F.when(n > 0, n), scale)

    x = with_chunks(df, ["account_id"], ORDER, chunks)
    a = chunked_scan(x, ["account_id"], ORDER,
                     sums={"kwh": F.col("kwh"), "kwh_n": present("kwh"),
                           "daily": F.col(daily_col), "daily_n": present(daily_col)},
                     lags=["kwh", daily_col], firsts=["from_dt"])
    a = a.select(*x.columns,
                 F.col("_rn").alias("invoice_num"),
                 F.col("_lag1_kwh").alias("kwh_lag"), F.col("_lag2_kwh").alias("kwh_lag_2"),
                 F.col(f"_lag1_{daily_col}").alias("daily_kwh_lag"), F.col(f"_lag2_{daily_col}").alias("daily_kwh_lag_2"),
                 mean_before("kwh", 2).alias("kwh_updating_avg"),
                 mean_before("daily", 2).alias("daily_kwh_updating_avg"),
                 F.col("_first_from_dt").alias("first_date"),
                 F.datediff("to_dt", F.col("_first_from_dt")).alias("days_passed"))
    m = chunked_scan(a, ["account_id", "todt_month"], ORDER,
                     sums={"daily": F.col(daily_col), "daily_n": present(daily_col)}, base=x)
    out = m.select(*[c for c in a.columns if c != "_chunk"], mean_before("daily", 2).alias("month_avg_preceding"))
    return out.withColumn("month_avg_preceding_flag", null_flag("month_avg_preceding"))
