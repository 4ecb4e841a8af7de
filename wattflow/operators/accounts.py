"""Per-account preparation of the forecasting path.

The reference builds one Python object per customer and loops over them; here
every step is a column expression or a window over all accounts at once.
All windows partition by account and share one exchange.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattflow.functions.numeric import dec4, mean4, square
from wattflow.operators.prefix import CHUNKS, ordered_scan
from wattflow.operators.windows import ORDER

# Fixed values from the reference: the cutoff after which temperature data
# ends, and the minimum number of complete invoices for a customer.
REFERENCE_CUTOFF = dt.date(2017, 2, 25)
MIN_ROWS = 5
LAG_ROWS = 2
TRAIN_SHARE = 0.8

# Columns of the account features before the averages.
FEATURE_ORDER = ["account_id", "from_dt", "to_dt", "kwh", "station_id", "tavg_interval_sum", "tavg_interval_sum_sq",
                 "year", "month", "day", "days_passed", "prev_pd_kwh", "prev_pd_tavg_interval_sum",
                 "prev_prev_pd_kwh", "prev_prev_pd_tavg_interval_sum", "row_idx", "n_rows", "is_eval"]

# Eligibility reasons.
REASON_STATION = "station_change"
REASON_SHORT = "insufficient_rows"
REASON_NO_TEST = "no_test_rows"

# Peaker classes.
SUMMER = "summer peaker"
WINTER = "winter peaker"
UNCLEAR = "pattern unclear"


def _whole(*keys: str):
    return Window.partitionBy(*keys)


def exact_mean4(x, w) -> F.Column:
    """Windowed mean of an integer column as an exact decimal at 4 places."""
    return mean4(F.sum(x).over(w), F.count(x).over(w))


def eligibility(rows: DataFrame, cutoff: dt.date, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per account: counts, eligible flag and the reason it fails.

    ``rows`` are invoice rows with ``station_id`` and a nullable
    ``tavg_interval_sum``.  Checks run in the reference's order: one station,
    at least ``min_rows`` complete rows, and -- instead of the reference's
    crash -- at least two rows left after the cutoff and the lag drop.
    """
    complete = F.col("tavg_interval_sum").isNotNull()
    before = complete & (F.col("to_dt") <= F.lit(cutoff))
    agg = rows.groupBy("account_id").agg(
        F.countDistinct("station_id").alias("n_stations"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(complete).alias("n_complete"),
        F.count_if(before).alias("_n_before"))
    prepared = F.greatest(F.col("_n_before") - LAG_ROWS, F.lit(0))
    reason = (F.when(F.col("n_stations") != 1, F.lit(REASON_STATION))
              .when(F.col("n_complete") < min_rows, F.lit(REASON_SHORT))
              .when(prepared < 2, F.lit(REASON_NO_TEST)))
    return agg.select("account_id", "n_stations", "n_rows", "n_complete",
                      prepared.alias("n_prepared"), reason.isNull().alias("eligible"),
                      reason.alias("reason"))


def complete_rows(rows: DataFrame) -> DataFrame:
    """Rows with every value present."""
    return rows.na.drop(how="any")


def eligible_rows(rows: DataFrame, elig: DataFrame) -> DataFrame:
    """Complete rows of eligible accounts."""
    ids = elig.where("eligible").select("account_id")
    return complete_rows(rows).join(ids, "account_id", "left_semi")


def ineligible_accounts(rows: DataFrame, elig: DataFrame) -> DataFrame:
    """Accounts that fail, with the reason."""
    ids = rows.select("account_id").distinct()
    passed = elig.where("eligible").select("account_id")
    return ids.join(passed, "account_id", "left_anti").join(elig.select("account_id", "reason"), "account_id")


def _series(kept: DataFrame, chunked: bool, chunks: int = CHUNKS) -> DataFrame:
    """Lags, position, size and days since the first invoice per account."""
    tavg = "tavg_interval_sum"
    s = ordered_scan(kept, ["account_id"], ORDER, lags=["kwh", tavg], firsts=["to_dt"],
                     chunked=chunked, chunks=chunks)
    return s.select(
        *kept.columns, F.datediff("to_dt", F.col("_first_to_dt")).alias("days_passed"),
        F.col("_lag1_kwh").alias("prev_pd_kwh"), F.col(f"_lag1_{tavg}").alias("prev_pd_" + tavg),
        F.col("_lag2_kwh").alias("prev_prev_pd_kwh"), F.col(f"_lag2_{tavg}").alias("prev_prev_pd_" + tavg),
        "_rn", "_n")


def _eligible_in_place(rows: DataFrame, cutoff: dt.date) -> DataFrame:
    """``eligible_rows`` by windows over the account: the rows are read once, and the
    series windows that follow reuse the same exchange."""
    whole = _whole("account_id")
    complete = F.col("tavg_interval_sum").isNotNull()
    before = complete & (F.col("to_dt") <= F.lit(cutoff))
    one_station = F.min("station_id").over(whole) == F.max("station_id").over(whole)
    ok = (one_station & (F.count_if(complete).over(whole) >= MIN_ROWS)
          & (F.count_if(before).over(whole) - LAG_ROWS >= 2))
    return complete_rows(rows.withColumn("_ok", F.coalesce(ok, F.lit(False))).where("_ok").drop("_ok"))


def account_features(rows: DataFrame, cutoff: dt.date, scope: str = "train", chunked: bool = False,
                     chunks: int = CHUNKS) -> DataFrame:
    """Formatted per-account series: cutoff, date parts, lags, hold-out, averages.

    ``scope="train"`` computes the customer and same-month means over the
    training rows only (all but the last); ``scope="all"`` reproduces the
    older variant that averages over all complete rows (T15, D12).
    ``chunked`` is for the accounts above the row bound: their windows run over
    chunks, and their per-account values are joined back.
    """
    if scope not in ("train", "all"):
        raise ValueError(f"scope must be 'train' or 'all', not {scope!r}")
    base = (eligible_rows(rows, eligibility(rows, cutoff)) if chunked
            else _eligible_in_place(rows, cutoff))
    tavg = F.col("tavg_interval_sum")
    kwh = F.col("kwh")

    if not chunked and scope == "all":
        base = base.withColumn("avg_kwh", exact_mean4(kwh, _whole("account_id")))
    kept = base.where(F.col("to_dt") <= F.lit(cutoff)).select(
        "account_id", "from_dt", "to_dt", "kwh", "station_id", "tavg_interval_sum",
        *[c for c in base.columns if c == "avg_kwh"])
    kept = kept.withColumn("month", F.month("to_dt"))
    if not chunked and scope == "all":
        kept = kept.withColumn("_m", exact_mean4(kwh, _whole("account_id", "month")))
    series = _series(kept, chunked, chunks)
    x = series.where(F.col("_rn") > LAG_ROWS).select(
        "account_id", "from_dt", "to_dt", "kwh", "station_id", "tavg_interval_sum",
        square(tavg).alias("tavg_interval_sum_sq"),
        F.year("to_dt").alias("year"), "month", F.dayofmonth("to_dt").alias("day"), "days_passed",
        "prev_pd_kwh", "prev_pd_tavg_interval_sum", "prev_prev_pd_kwh", "prev_prev_pd_tavg_interval_sum",
        (F.col("_rn") - LAG_ROWS).cast("int").alias("row_idx"),
        (F.col("_n") - LAG_ROWS).cast("int").alias("n_rows"),
        (F.col("_rn") == F.col("_n")).alias("is_eval"), *[c for c in kept.columns if c in ("avg_kwh", "_m")])
    train_kwh = F.when(~F.col("is_eval"), kwh)
    if chunked:  # grouped means joined back
        of_account, of_month, value = (x, x, train_kwh) if scope == "train" else (base, kept, kwh)
        acc_mean = of_account.groupBy("account_id").agg(mean4(F.sum(value), F.count(value)).alias("avg_kwh"))
        mon_mean = of_month.groupBy("account_id", "month").agg(mean4(F.sum(value), F.count(value)).alias("_m"))
        x = x.join(acc_mean, "account_id").join(mon_mean, ["account_id", "month"], "left")
    elif scope == "train":
        x = x.select("*", exact_mean4(train_kwh, _whole("account_id")).alias("avg_kwh"),
                     exact_mean4(train_kwh, _whole("account_id", "month")).alias("_m"))
    columns = [c for c in x.columns if c not in ("avg_kwh", "_m")]
    return x.select(*sorted(columns, key=FEATURE_ORDER.index), "avg_kwh",
                    F.coalesce("_m", "avg_kwh").alias("avg_kwh_for_cust_for_current_month"))


def train_test_split(features: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    """Positional split per account: the first floor(n * share) rows train."""
    init = F.floor(F.col("n_rows") * F.lit(share)).cast("int")
    return features.withColumn("is_train", F.col("row_idx") <= init)


def walk_forward_folds(features: DataFrame, share: float = TRAIN_SHARE, chunked: bool = False,
                       chunks: int = CHUNKS) -> DataFrame:
    """One row per walk-forward test row with its training prefix summarised.

    Fold i of an account trains on its first init + i rows and tests the next;
    the training rows are described by count and date range, never listed.
    """
    init = F.floor(F.col("n_rows") * F.lit(share)).cast("int")
    scan = ordered_scan(features.select("account_id", "from_dt", "to_dt", "kwh", "row_idx", "n_rows"),
                        ["account_id"], ORDER, lags=["to_dt"], firsts=["to_dt"], chunked=chunked, chunks=chunks)
    return (scan.select("account_id", "from_dt", "to_dt", "kwh", "row_idx",
                        F.col("_first_to_dt").alias("train_first_to_dt"),
                        F.col("_lag1_to_dt").alias("train_last_to_dt"), init.alias("_init"))
            .where(F.col("row_idx") > F.col("_init"))
            .select("account_id", "from_dt", "to_dt", "kwh",
                    (F.col("row_idx") - F.col("_init") - 1).cast("int").alias("fold"),
                    (F.col("row_idx") - 1).cast("int").alias("n_train"),
                    "train_first_to_dt", "train_last_to_dt"))


def account_extremes(features: DataFrame, value: str = "kwh", target: str = "tavg_interval_sum") -> DataFrame:
    """Max / min of ``value`` per account and ``target`` at those rows.

    Ties on ``value`` go to the earliest invoice.
    """
    early = [-F.unix_date("to_dt"), -F.unix_date("from_dt")]
    late = [F.unix_date("to_dt"), F.unix_date("from_dt")]
    return features.groupBy("account_id").agg(
        F.max(value).alias(f"max_{value}"),
        F.min(value).alias(f"min_{value}"),
        F.max_by(target, F.struct(F.col(value), *early)).alias(f"{target}_at_max"),
        F.min_by(target, F.struct(F.col(value), *late)).alias(f"{target}_at_min"))


def peaker_class(features: DataFrame) -> DataFrame:
    """Summer / winter peaker by temperature at highest vs lowest use."""
    ex = account_extremes(features)
    hi, lo = F.col("tavg_interval_sum_at_max"), F.col("tavg_interval_sum_at_min")
    cls = F.when(hi > lo, F.lit(SUMMER)).when(hi < lo, F.lit(WINTER)).otherwise(F.lit(UNCLEAR))
    return ex.select("account_id", cls.alias("peak_class"))


def macro_average(features: DataFrame, value: str = "kwh") -> DataFrame:
    """Mean of per-account means."""
    per = features.groupBy("account_id").agg(F.avg(value).alias("m"))
    return per.agg(dec4(F.avg("m")).alias(f"macro_avg_{value}"))


def overall_average(features: DataFrame, value: str = "kwh") -> DataFrame:
    """Pooled mean over training rows and over all rows."""
    v = F.col(value)
    train = F.when(~F.col("is_eval"), v)
    return features.agg(
        mean4(F.sum(train), F.count(train)).alias(f"overall_avg_{value}_train"),
        mean4(F.sum(v), F.count(v)).alias(f"overall_avg_{value}_all"))
