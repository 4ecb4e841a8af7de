"""Invoices x daily weather: interval joins and per-invoice reductions.

Two physical forms give the same per-invoice numbers:

* **prefix form** (production path).  Daily weather is reduced to one row per
  station and day, laid on a dense calendar and turned into running totals.
  An invoice's totals over [from, to] are then ``cum(to) - cum(from - 1)``:
  two equi-join lookups on (station, day) per invoice instead of one joined
  row per invoice day.  Work grows with invoices + station-days, not with
  invoices x days, and a hot station is spread over its days by the join key.
* **day form**.  Each invoice is exploded to its days (or to 32-day bins for
  the range join) and equi-joined to weather.  It produces the per-day rows
  the day-level queries return and is the cross-check for the prefix form.

Missing-value rules (SURVEY 2.12): in ``zero`` mode the sentinel counts as 0
in sums *and* averages (SQL path); in ``skip`` mode it is left out (Python
path) and an interval sum of exactly 0 becomes null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattflow.functions.dates import day_sequence, inclusive_days, ymd_to_date
from wattflow.functions.numeric import (READING_TYPE, fixed_ratio, is_missing,
                                        reading_skip, reading_zero, round_int)

DAILY_VALUES = ["n_rows", "n_missing", "sum_zero", "n_zero", "sum_skip", "n_skip"]
PAIR_VALUES = ["n_rows_1", "n_missing_1", "sum_zero_1", "n_zero_1",
               "n_missing_2", "sum_zero_2", "n_zero_2", "n_null_2"]
INVOICE_KEY = ["account_id", "from_dt", "to_dt", "kwh"]
BIN_DAYS = 32


# --------------------------------------------------------------------------
# weather
# --------------------------------------------------------------------------

def parse_weather(weather: DataFrame) -> DataFrame:
    """station_id, ymd, tavg_raw -> plus obs_date (rows with bad dates dropped)."""
    return (weather.select("station_id", "ymd", "tavg_raw",
                           ymd_to_date("ymd").alias("obs_date"))
            .where(F.col("obs_date").isNotNull()))


def daily_weather(weather: DataFrame) -> DataFrame:
    """One row per (station_id, obs_date) with the counts and sums both modes need.

    Duplicate feed rows for a station-day add up exactly as they would in a
    row-level join, so the reduction stays exact.
    """
    w = parse_weather(weather)
    return w.groupBy("station_id", "obs_date").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(is_missing("tavg_raw")).alias("n_missing"),
        F.sum(reading_zero("tavg_raw")).alias("sum_zero"),
        F.count(reading_zero("tavg_raw")).alias("n_zero"),
        F.sum(reading_skip("tavg_raw")).alias("sum_skip"),
        F.count(reading_skip("tavg_raw")).alias("n_skip"))


def last_observed_day(weather: DataFrame) -> Column:
    """The latest weather day, as a scalar subquery of the plan (null without weather)."""
    return parse_weather(weather).agg(F.max("obs_date")).scalar()


def prefix_calendar(daily: DataFrame, keys: list[str], values: list[str], last_day: Column) -> DataFrame:
    """Running totals of ``values`` per key on every day from its first day to ``last_day``.

    One window over the observed days; a day without a reading repeats the
    totals of the day before it.
    """
    w = Window.partitionBy(*keys).orderBy("obs_date")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    observed = daily.select(
        *keys, "obs_date", F.date_sub(F.lead("obs_date").over(w), 1).alias("_until"),
        *[F.sum(F.coalesce(F.col(v), F.lit(0))).over(so_far).alias(v) for v in values])
    return (observed.withColumn("_until", F.coalesce("_until", last_day))
            .select(*keys, F.explode(day_sequence("obs_date", "_until")).alias("obs_date"), *values))


def interval_totals(intervals: DataFrame, calendar: DataFrame, keys: list[str],
                    values: list[str], last_day,
                    from_col: str = "from_dt", to_col: str = "to_dt") -> DataFrame:
    """Totals of ``values`` over [from, to] for every interval row, by two lookups.

    Days past the last weather day are clamped to it; days before a key's
    first day have no calendar row and count 0.
    """
    x = (intervals
         .withColumn("_hi", F.least(F.col(to_col), last_day))
         .withColumn("_lo", F.least(F.date_sub(F.col(from_col), 1), last_day)))
    hi = calendar.select(*keys, F.col("obs_date").alias("_hi"), *[F.col(v).alias("_h_" + v) for v in values])
    lo = calendar.select(*keys, F.col("obs_date").alias("_lo"), *[F.col(v).alias("_l_" + v) for v in values])
    x = x.join(hi, keys + ["_hi"], "left").join(lo, keys + ["_lo"], "left")
    totals = [(F.coalesce(F.col("_h_" + v), F.lit(0)) - F.coalesce(F.col("_l_" + v), F.lit(0))).alias(v)
              for v in values]
    return x.select(*intervals.columns, *totals)


# --------------------------------------------------------------------------
# one station (SQL path and Python path)
# --------------------------------------------------------------------------

def station_totals(inv_station: DataFrame, weather: DataFrame) -> DataFrame:
    """Per invoice-with-station: all DAILY_VALUES over its interval (prefix form)."""
    last_day = last_observed_day(weather)
    cal = prefix_calendar(daily_weather(weather), ["station_id"], DAILY_VALUES, last_day)
    return interval_totals(inv_station, cal, ["station_id"], DAILY_VALUES, last_day)


def zero_mode_stats(t: DataFrame, suffix: str = "", n_rows: str = "n_rows",
                    n_missing: str = "n_missing", sum_zero: str = "sum_zero",
                    n_zero: str = "n_zero") -> list:
    """SQL-path interval statistics from totals."""
    present = F.col(n_zero) > 0
    s = F.when(present, F.col(sum_zero).cast("double"))
    avg = F.when(present, F.col(sum_zero).cast("double") / F.col(n_zero).cast("double"))
    miss = F.col(n_missing).cast("int")
    return [s.alias("tavg_interval_sum" + suffix),
            avg.alias("tavg_interval_avg" + suffix),
            miss.alias("num_missing" + suffix),
            round_int(s + avg * miss).alias("tavg_interval_sum_corrected" + suffix),
            fixed_ratio(miss, inclusive_days("from_dt", "to_dt"), 5, 4).alias("perc_missing" + suffix)]


def invoice_weather_one(inv_station: DataFrame, weather: DataFrame) -> DataFrame:
    """One row per invoice with a reading at its nearest station (S9 stats_frame_2)."""
    t = station_totals(inv_station, weather).where(F.col("n_rows") > 0)
    return t.select(
        "account_id", "zip", "from_dt", "to_dt",
        inclusive_days("from_dt", "to_dt").alias("duration"),
        "kwh", "station_id", "station_dist",
        *zero_mode_stats(t),
        fixed_ratio(F.col("kwh"), inclusive_days("from_dt", "to_dt"), 6, 2).alias("avg_kwh_day_over_invoice"),
        F.month("to_dt").alias("todt_month"),
        F.dayofmonth("to_dt").alias("todt_day"))


def interval_temp_sum(inv_station: DataFrame, weather: DataFrame) -> DataFrame:
    """Python-path interval sum: missing skipped, exactly 0 -> null."""
    t = station_totals(inv_station, weather)
    s = F.col("sum_skip").cast("double")
    return t.select(*inv_station.columns,
                    F.when(s != 0, s).alias("tavg_interval_sum"))


# --------------------------------------------------------------------------
# two stations
# --------------------------------------------------------------------------

def pair_daily(pairs: DataFrame, daily: DataFrame) -> DataFrame:
    """Joint day values for each (station_id_1, station_id_2) pair.

    Station 2 is read only on days station 1 has a row (the left join of the
    reference).  With k station-2 rows on a day, each station-1 row joins
    max(k, 1) times and each station-2 row joins n1 times; the products below
    are those multiplicities, so totals equal the row-level join's.
    """
    d1 = daily.select(F.col("station_id").alias("station_id_1"), "obs_date",
                      *[F.col(c).alias(c + "_1") for c in ("n_rows", "n_missing", "sum_zero", "n_zero")])
    d2 = daily.select(F.col("station_id").alias("station_id_2"), "obs_date",
                      *[F.col(c).alias(c + "_2") for c in ("n_rows", "n_missing", "sum_zero", "n_zero")])
    j = (pairs.join(d1, "station_id_1")
         .join(d2, ["station_id_2", "obs_date"], "left"))
    k = F.coalesce(F.col("n_rows_2"), F.lit(0))
    mult = F.greatest(k, F.lit(1))
    n1 = F.col("n_rows_1")
    return j.select(
        "station_id_1", "station_id_2", "obs_date",
        (n1 * mult).alias("n_rows_1"),
        (F.col("n_missing_1") * mult).alias("n_missing_1"),
        (F.col("sum_zero_1") * mult).alias("sum_zero_1"),
        (F.col("n_zero_1") * mult).alias("n_zero_1"),
        (F.coalesce(F.col("n_missing_2"), F.lit(0)) * n1).alias("n_missing_2"),
        (F.coalesce(F.col("sum_zero_2"), F.lit(0)) * n1).alias("sum_zero_2"),
        (F.coalesce(F.col("n_zero_2"), F.lit(0)) * n1).alias("n_zero_2"),
        F.when(k == 0, n1).otherwise(F.lit(0)).alias("n_null_2"))


def pair_totals(inv_pair: DataFrame, weather: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Per invoice-with-pair: PAIR_VALUES over its interval (prefix form).

    ``pairs`` lists the (station_id_1, station_id_2) combinations; pass the
    station table's pairs (bounded by postal codes) so they need not be read
    off the invoices.
    """
    daily = daily_weather(weather)
    last_day = last_observed_day(weather)
    if pairs is None:
        pairs = inv_pair.select("station_id_1", "station_id_2")
    pairs = pairs.select("station_id_1", "station_id_2").distinct()
    joint = pair_daily(pairs, daily)
    cal = prefix_calendar(joint, ["station_id_1", "station_id_2"], PAIR_VALUES, last_day)
    return interval_totals(inv_pair, cal, ["station_id_1", "station_id_2"], PAIR_VALUES, last_day)


def invoice_weather_two(inv_pair: DataFrame, weather: DataFrame,
                        count_null_as_missing: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    """One row per invoice with readings at both stations (S12 stats_frame_2, no attributes).

    ``count_null_as_missing`` takes the evident intent of the reference's
    ``WHEN NULL`` branch (never true in SQL): a station-1 day with no
    station-2 row counts as a missing station-2 reading with value 0 (T6).
    """
    t = pair_totals(inv_pair, weather, pairs).where(F.col("n_rows_1") > 0)
    if count_null_as_missing:
        t = (t.withColumn("n_missing_2", F.col("n_missing_2") + F.col("n_null_2"))
              .withColumn("n_zero_2", F.col("n_zero_2") + F.col("n_null_2")))
    return t.select(
        "account_id", "zip", "from_dt", "to_dt",
        inclusive_days("from_dt", "to_dt").alias("duration"), "kwh",
        "station_id_1", "station_dist_1", "station_id_2", "station_dist_2",
        *zero_mode_stats(t, "_1", "n_rows_1", "n_missing_1", "sum_zero_1", "n_zero_1"),
        *zero_mode_stats(t, "_2", "n_rows_1", "n_missing_2", "sum_zero_2", "n_zero_2"))


# --------------------------------------------------------------------------
# day form (per-day rows)
# --------------------------------------------------------------------------

def invoice_days(inv: DataFrame) -> DataFrame:
    """One row per invoice day."""
    return inv.select(*inv.columns, F.explode(day_sequence("from_dt", "to_dt")).alias("obs_date"))


def readings_by_day(inv_station: DataFrame, weather: DataFrame) -> DataFrame:
    """Per-day readings by day expansion + equi-join on (station, day)."""
    w = parse_weather(weather).select("station_id", "obs_date", "tavg_raw")
    return invoice_days(inv_station).join(w, ["station_id", "obs_date"], "inner")


def _bin(d) -> F.Column:
    return F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / BIN_DAYS).cast("int")


def readings_interval(inv_station: DataFrame, weather: DataFrame) -> DataFrame:
    """Per-day readings by a range join (C4): equi-join on (station, 32-day bin), then the range test.

    An invoice spans at most a few bins, so the exploded side stays close to
    the invoice count while the station key is spread over bins.
    """
    inv = inv_station.withColumn("_bin", F.explode(F.sequence(_bin(F.col("from_dt")), _bin(F.col("to_dt")))))
    w = parse_weather(weather).select("station_id", "obs_date", "tavg_raw").withColumn("_bin", _bin(F.col("obs_date")))
    j = inv.join(w, ["station_id", "_bin"], "inner").where(
        (F.col("obs_date") >= F.col("from_dt")) & (F.col("obs_date") <= F.col("to_dt")))
    return j.select(*inv_station.columns, "obs_date", "tavg_raw")


def readings_two_stations(inv_pair: DataFrame, weather: DataFrame, literal: bool = False) -> DataFrame:
    """Per-day rows with station 1's reading and station 2's (left joined).

    By default station 2 is matched on the invoice and day.  ``literal=True``
    matches on account, station and day only, as the reference does, so a day
    shared by two invoices of one account is counted twice in each (T7).
    """
    w = parse_weather(weather).select("station_id", "obs_date", "tavg_raw")
    w1 = w.select(F.col("station_id").alias("station_id_1"), "obs_date", F.col("tavg_raw").alias("tavg_raw_1"))
    w2 = w.select(F.col("station_id").alias("station_id_2"), "obs_date", F.col("tavg_raw").alias("tavg_raw_2"))
    days = invoice_days(inv_pair)
    first = days.join(w1, ["station_id_1", "obs_date"], "inner")
    if not literal:
        return first.join(w2, ["station_id_2", "obs_date"], "left")
    second = (days.join(w2, ["station_id_2", "obs_date"], "inner")
              .select("account_id", "station_id_2", "obs_date", "tavg_raw_2"))
    return first.join(second, ["account_id", "station_id_2", "obs_date"], "left")


def reduce_days_one(days: DataFrame) -> DataFrame:
    """Per-day rows -> per-invoice statistics with SQL aggregates (day-form D1/D2)."""
    keys = ["account_id", "zip", "from_dt", "to_dt", "kwh", "station_id", "station_dist"]
    t = days.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(is_missing("tavg_raw")).alias("n_missing"),
        F.sum(reading_zero("tavg_raw")).alias("sum_zero"),
        F.count(reading_zero("tavg_raw")).alias("n_zero"))
    return t.select(
        "account_id", "zip", "from_dt", "to_dt",
        inclusive_days("from_dt", "to_dt").alias("duration"),
        "kwh", "station_id", "station_dist", *zero_mode_stats(t),
        fixed_ratio(F.col("kwh"), inclusive_days("from_dt", "to_dt"), 6, 2).alias("avg_kwh_day_over_invoice"),
        F.month("to_dt").alias("todt_month"),
        F.dayofmonth("to_dt").alias("todt_day"))


def reduce_days_two(days: DataFrame, count_null_as_missing: bool = False) -> DataFrame:
    """Per-day two-station rows -> per-invoice statistics (day-form D3)."""
    keys = ["account_id", "zip", "from_dt", "to_dt", "kwh",
            "station_id_1", "station_dist_1", "station_id_2", "station_dist_2"]
    r2 = F.col("tavg_raw_2")
    miss2 = is_missing(r2)
    v2 = reading_zero(r2)
    if count_null_as_missing:
        miss2 = miss2 | r2.isNull()
        v2 = F.when(r2.isNull(), F.lit(0).cast(READING_TYPE)).otherwise(v2)
    t = days.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows_1"),
        F.count_if(is_missing("tavg_raw_1")).alias("n_missing_1"),
        F.sum(reading_zero("tavg_raw_1")).alias("sum_zero_1"),
        F.count(reading_zero("tavg_raw_1")).alias("n_zero_1"),
        F.count_if(miss2).alias("n_missing_2"),
        F.sum(v2).alias("sum_zero_2"),
        F.count(v2).alias("n_zero_2"))
    t = t.withColumn("sum_zero_2", F.coalesce(F.col("sum_zero_2"), F.lit(0)))
    return t.select(
        "account_id", "zip", "from_dt", "to_dt",
        inclusive_days("from_dt", "to_dt").alias("duration"), "kwh",
        "station_id_1", "station_dist_1", "station_id_2", "station_dist_2",
        *zero_mode_stats(t, "_1", "n_rows_1", "n_missing_1", "sum_zero_1", "n_zero_1"),
        *zero_mode_stats(t, "_2", "n_rows_1", "n_missing_2", "sum_zero_2", "n_zero_2"))
