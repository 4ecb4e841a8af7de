"""Interval joins and reductions: the traps of SURVEY 2.12 on hand-made rows."""

from decimal import Decimal

from pyspark.sql import functions as F

from helpers import D, inv_pair_df, inv_station_df, weather_df
from wattflow.functions.numeric import round_int
from wattflow.operators import readings


def _one(spark, inv_rows, w_rows):
    return readings.invoice_weather_one(inv_station_df(spark, inv_rows), weather_df(spark, w_rows))


def test_sentinel_zero_mode(spark):
    w = [("1", "20200101", "10"), ("1", "20200102", "M"), ("1", "20200103", "20")]
    inv = [(1, 7, D(2020, 1, 1), D(2020, 1, 3), 300, "1", Decimal("1.25"))]
    r = _one(spark, inv, w).collect()[0]
    assert r.tavg_interval_sum == 30.0
    assert r.tavg_interval_avg == 10.0
    assert r.num_missing == 1
    assert r.tavg_interval_sum_corrected == 40
    assert r.duration == 3
    assert r.perc_missing == Decimal("0.3333")
    assert r.avg_kwh_day_over_invoice == Decimal("100.00")


def test_sentinel_skip_mode(spark):
    w = [("1", "20200101", "10"), ("1", "20200102", "M"), ("1", "20200103", "20")]
    inv = [(1, 7, D(2020, 1, 1), D(2020, 1, 3), 300, "1", Decimal("1.25"))]
    r = readings.interval_temp_sum(inv_station_df(spark, inv), weather_df(spark, w)).collect()[0]
    assert r.tavg_interval_sum == 30.0


def test_half_values_round_away_from_zero(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-2.5,)], "x double")
    assert [r[0] for r in df.select(round_int("x")).collect()] == [3, 4, -3]


def test_invoice_without_weather_is_absent(spark):
    w = [("1", "20200101", "10")]
    inv = [(1, 7, D(2021, 1, 1), D(2021, 1, 30), 300, "1", Decimal("1.25")),
           (2, 7, D(2019, 1, 1), D(2019, 1, 30), 300, "1", Decimal("1.25"))]
    assert _one(spark, inv, w).count() == 0
    skip = readings.interval_temp_sum(inv_station_df(spark, inv), weather_df(spark, w)).collect()
    assert [r.tavg_interval_sum for r in skip] == [None, None]


def test_zero_sum_becomes_null(spark):
    w = [("1", "20200101", "5"), ("1", "20200102", "-5"), ("2", "20200101", "M"), ("2", "20200102", "M")]
    inv = [(1, 7, D(2020, 1, 1), D(2020, 1, 2), 10, "1", Decimal("1.25")),
           (2, 8, D(2020, 1, 1), D(2020, 1, 2), 10, "2", Decimal("1.25"))]
    rows = readings.interval_temp_sum(inv_station_df(spark, inv), weather_df(spark, w)).collect()
    assert all(r.tavg_interval_sum is None for r in rows)


def test_interval_clamped_past_last_weather_day(spark):
    w = [("1", "20200101", "10"), ("1", "20200102", "20")]
    inv = [(1, 7, D(2020, 1, 2), D(2020, 2, 28), 300, "1", Decimal("1.25"))]
    r = _one(spark, inv, w).collect()[0]
    assert r.tavg_interval_sum == 20.0 and r.num_missing == 0 and r.duration == 58


def test_null_second_reading(spark):
    # station 1 has three days; station 2 is absent on day 1, 'M' on day 2, 5 on day 3
    w = [("1", "20200101", "10"), ("1", "20200102", "10"), ("1", "20200103", "10"),
         ("2", "20200102", "M"), ("2", "20200103", "5")]
    inv = [(1, 7, D(2020, 1, 1), D(2020, 1, 3), 30, "1", Decimal("1.25"), "2", Decimal("5.50"))]
    r = readings.invoice_weather_two(inv_pair_df(spark, inv), weather_df(spark, w)).collect()[0]
    assert (r.tavg_interval_sum_2, r.tavg_interval_avg_2, r.num_missing_2) == (5.0, 2.5, 1)
    r2 = readings.invoice_weather_two(inv_pair_df(spark, inv), weather_df(spark, w),
                                      count_null_as_missing=True).collect()[0]
    assert r2.num_missing_2 == 2


def test_shared_day_default_and_literal(spark):
    # two invoices of one account share 2020-01-03
    w = [("1", f"2020010{d}", "10") for d in range(1, 6)] + [("2", f"2020010{d}", "20") for d in range(1, 6)]
    inv = [(1, 7, D(2020, 1, 1), D(2020, 1, 3), 30, "1", Decimal("1.25"), "2", Decimal("5.50")),
           (1, 7, D(2020, 1, 3), D(2020, 1, 5), 40, "1", Decimal("1.25"), "2", Decimal("5.50"))]
    pairs = inv_pair_df(spark, inv)
    default = readings.reduce_days_two(readings.readings_two_stations(pairs, weather_df(spark, w)))
    literal = readings.reduce_days_two(readings.readings_two_stations(pairs, weather_df(spark, w), literal=True))
    assert sorted(r.tavg_interval_sum_1 for r in default.collect()) == [30.0, 30.0]
    assert sorted(r.tavg_interval_sum_1 for r in literal.collect()) == [40.0, 40.0]
    prefix = readings.invoice_weather_two(pairs, weather_df(spark, w))
    assert sorted(r.tavg_interval_sum_1 for r in prefix.collect()) == [30.0, 30.0]


def test_range_join_equals_day_expansion(spark):
    w = [("1", f"202001{d:02d}", str(d)) for d in range(1, 32)] + [("1", f"202002{d:02d}", "M") for d in range(1, 29)]
    inv = [(1, 7, D(2020, 1, 20), D(2020, 2, 10), 300, "1", Decimal("1.25")),
           (2, 7, D(2020, 1, 1), D(2020, 1, 31), 300, "1", Decimal("1.25"))]
    a = readings.readings_interval(inv_station_df(spark, inv), weather_df(spark, w))
    b = readings.readings_by_day(inv_station_df(spark, inv), weather_df(spark, w))
    cols = ["account_id", "obs_date", "tavg_raw"]
    assert sorted(a.select(cols).collect()) == sorted(b.select(cols).collect())
    assert a.count() == 22 + 31


def test_prefix_form_equals_day_form_on_fixture(spark):
    from conftest import SMALL
    from wattflow.plans import matched
    from wattflow.sources.fixtures import domain
    d = domain(spark, SMALL)
    inv = matched.invoices_nearest(d)
    prefix = readings.invoice_weather_one(inv, d.weather)
    days = readings.reduce_days_one(readings.readings_by_day(inv, d.weather))
    assert prefix.count() == days.count() > 0
    assert prefix.exceptAll(days.select(*prefix.columns)).count() == 0
    pairs = matched.invoices_paired(d)
    p2 = readings.invoice_weather_two(pairs, d.weather)
    d2 = readings.reduce_days_two(readings.readings_two_stations(pairs, d.weather))
    assert p2.exceptAll(d2.select(*p2.columns)).count() == 0
    assert d2.exceptAll(p2.select(*d2.columns)).count() == 0
