"""Window features, station preference, attributes, fills."""

from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import D
from wattflow.operators import invoices as inv_ops
from wattflow.operators import quality as qa
from wattflow.operators import windows
from wattflow.plans import matched


def test_ties_ordered_by_from_date_then_kwh(spark):
    rows = [(1, D(2020, 1, 1), D(2020, 2, 1), 50, Decimal("1.60")),
            (1, D(2020, 1, 5), D(2020, 2, 1), 40, Decimal("1.40")),
            (1, D(2020, 1, 5), D(2020, 2, 1), 30, Decimal("1.10"))]
    df = spark.createDataFrame(rows, "account_id long, from_dt date, to_dt date, kwh int, avg_kwh_day_over_invoice decimal(6,2)")
    out = windows.invoice_sequence(df).orderBy("invoice_num").collect()
    assert [r.kwh for r in out] == [50, 30, 40]
    assert [r.kwh_lag for r in out] == [None, 50, 30]


def test_expanding_and_month_averages(spark):
    rows = [(1, D(2020, 1, 1), D(2020, 1, 31), 10, Decimal("1.00"), 1),
            (1, D(2020, 2, 1), D(2020, 2, 28), 20, Decimal("2.00"), 2),
            (1, D(2021, 1, 1), D(2021, 1, 31), 31, Decimal("3.00"), 1)]
    df = spark.createDataFrame(rows, "account_id long, from_dt date, to_dt date, kwh int, avg_kwh_day_over_invoice decimal(6,2), todt_month int")
    out = windows.expanding_features(windows.invoice_sequence(df)).orderBy("to_dt").collect()
    assert [r.kwh_updating_avg for r in out] == [None, Decimal("10.0000"), Decimal("15.0000")]
    assert [r.month_avg_preceding for r in out] == [None, None, Decimal("1.0000")]
    assert [r.month_avg_preceding_flag for r in out] == [0, 0, 1]
    assert [r.days_passed for r in out] == [30, 58, 396]


def test_share_exactly_half_keeps_station_one(spark):
    df = spark.createDataFrame(
        [(Decimal("0.5000"), "1", "2", Decimal("1.25"), Decimal("5.50"), 60.4, 70.6, Decimal("0.1000"))],
        "perc_missing_1 decimal(5,4), station_id_1 string, station_id_2 string, station_dist_1 decimal(4,2), "
        "station_dist_2 decimal(4,2), tavg_interval_avg_1 double, tavg_interval_avg_2 double, perc_missing_2 decimal(5,4)")
    r = matched.station_preference(df).collect()[0]
    assert (r.station_id_preferred, r.tavg_interval_avg_preferred, r.perc_missing_preferred) == ("1", 60, Decimal("0.5000"))
    both = qa.slice_counts(df.withColumnRenamed("perc_missing_1", "perc_missing")).collect()
    counts = {r.slice: r.n_rows for r in both}
    assert counts["ge_half"] == 1 and counts["le_half"] == 1


def test_two_attribute_rows(spark):
    rows = [(1, 1, 7, "a", "s", "F", None, 1, "R", 10, "R1"), (1, 1, 7, "a", "s", "F", None, 1, "R", 10, "R2")]
    schema = ("account_id long, account_key long, zip int, city string, state string, gender string, "
              "billing_address2 string, utility_id int, account_type string, county_fips int, rate_class string")
    acc = spark.createDataFrame(rows, schema)
    assert inv_ops.account_attributes(acc).count() == 1
    assert inv_ops.account_attributes(acc, literal=True).count() == 2
    assert inv_ops.account_attributes(acc).collect()[0].city == "A"


def test_fill_minus_one(spark):
    df = spark.createDataFrame([(None, None, None)], "a int, b string, c date")
    r = qa.fill_minus_one(df).collect()[0]
    assert (r.a, r.b, r.c) == (-1, "-1", None)


def test_matched_table_one_row_per_invoice(spark):
    from conftest import SMALL
    from wattflow.sources.fixtures import domain
    m = matched.matched_table_2(domain(spark, SMALL))
    assert m.count() == m.select("account_id", "from_dt", "to_dt", "kwh").distinct().count() > 0


def test_chunked_windows_equal_plain(spark):
    from conftest import SMALL
    from wattflow.sources.fixtures import domain
    base = matched.invoice_weather_1(domain(spark, SMALL)).cache()
    plain = windows.expanding_features(windows.invoice_sequence(base))
    for chunks in (2, 5, 64):
        ch = windows.chunked_feature_windows(base, chunks=chunks).select(*plain.columns)
        assert plain.exceptAll(ch).count() == 0 and ch.exceptAll(plain).count() == 0


def test_known_attributes_beat_missing_ones(spark):
    schema = ("account_id long, account_key long, zip int, city string, state string, gender string, "
              "billing_address2 string, utility_id int, account_type string, county_fips int, rate_class string")
    rows = [(1, 1, 7, "a", "s", None, None, 1, "R", 10, "R2"), (1, 1, 7, "a", "s", "F", None, 1, "R", 10, "R1")]
    assert inv_ops.account_attributes(spark.createDataFrame(rows, schema)).collect()[0].gender == "F"


def test_zero_use_empty_tables_and_large_counts(spark):
    from wattflow.functions.numeric import fixed_ratio, mean4
    from wattflow.operators import clusters as cl
    df = spark.createDataFrame([(1, *[0.0] * 12), (2, *[2.0] * 12)], ["e"] + cl.MONTH_COLS)
    got = cl.load_shares(df, "e").collect()
    assert [r.e for r in got] == [2] and abs(got[0].m_1_pct - 1 / 12) < 1e-12
    r = spark.range(1).select(fixed_ratio(F.lit(1), F.lit(0), 5, 4).alias("a"),
                              mean4(F.lit(6 * 10 ** 10), F.lit(2 * 10 ** 10)).alias("b")).first()
    assert r.a is None and r.b == 3
    assert qa.slice_counts(spark.createDataFrame([], "perc_missing decimal(5,4)")).where("share IS NOT NULL").count() == 0


def test_chunks_of_one_account_and_day(spark):
    """All rows have one date: the cuts fall between start dates, kWh and hashes."""
    from pyspark.sql import functions as F

    from wattflow.operators import prefix
    n = 100_000
    rows = spark.range(n).select(
        F.lit(1).cast("long").alias("account_id"), F.lit(D(2020, 5, 31)).alias("to_dt"),
        F.date_sub(F.lit(D(2020, 5, 1)), (F.col("id") % 2).cast("int")).alias("from_dt"),
        F.pmod(F.xxhash64("id"), F.lit(1_000_000)).cast("int").alias("kwh"), F.col("id").alias("other"))
    rows = rows.checkpoint()
    order = ["to_dt", "from_dt", "kwh"]
    chunked = prefix.with_chunks(rows, ["account_id"], order, 32)
    sizes = [r["count"] for r in chunked.groupBy("_chunk").count().collect()]
    assert 24 <= len(sizes) <= 64 and max(sizes) < 3 * n / 32
    scan = dict(sums={"kwh": F.col("kwh").cast("long")}, lags=["kwh"], firsts=["from_dt"])
    keep = ["from_dt", "kwh", "_n", "_rn", "_before_kwh", "_lag1_kwh", "_lag2_kwh", "_first_from_dt"]
    plain, parts = (prefix.ordered_scan(rows, ["account_id"], order, chunked=c, chunks=32, **scan).select(*keep) for c in (False, True))
    assert plain.exceptAll(parts).count() == 0 and parts.count() == n


def test_chunks_of_equal_rows(spark):
    from pyspark.sql import functions as F

    from wattflow.operators import prefix
    rows = spark.range(4000).select(F.lit(1).alias("k"), F.lit(2).alias("at"), F.lit(5).alias("v"), (F.col("id") % 3).alias("other")).checkpoint()
    got = prefix.ordered_scan(rows, ["k"], ["at"], sums={"v": F.col("v")}, chunked=True, chunks=8).collect()
    assert sorted(r._rn for r in got) == list(range(1, 4001)) and all(r._before_v == 5 * (r._rn - 1) for r in got)


def test_bins_from_the_data(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from wattflow.operators import quality as qa
    rng = np.random.default_rng(2)
    v = rng.normal(10, 3, 500).round(2)
    df = spark.createDataFrame([(float(x), float(x) * 2) for x in v] + [(None, 1.0)], "x double, y double")
    got = sorted((r.bin, float(r.from_value), r.n) for r in qa.histogram_auto(df, "x").collect())
    q1, q3 = np.quantile(v, [0.25, 0.75], method="inverted_cdf")
    k = min(50, int(np.ceil((v.max() - v.min()) / (2 * (q3 - q1) / np.cbrt(500)))))
    want = np.histogram(v, k)[0]
    assert sum(n for _, _, n in got) == 500 and got[0][1] == v.min() and len(want) > got[-1][0]
    # edges may round a value to the neighbouring bin
    assert sum(abs(n - want[b]) for b, _, n in got) <= 4
    assert qa.density_grid_auto(df, "x", "y").agg(F.sum("n")).first()[0] == 500
    one = spark.createDataFrame([(4.0,)] * 5, "x double")
    assert [(r.bin, r.n) for r in qa.histogram_auto(one, "x").collect()] == [(0, 5)]
    tied = spark.createDataFrame([(4.0,)] * 8 + [(5.0,)], "x double")
    assert [(r.bin, r.n) for r in sorted(qa.histogram_auto(tied, "x").collect())] == [(0, 8), (2, 1)]
    assert qa.histogram_auto(one.limit(0), "x").collect() == []


def test_chunked_plans_ask_for_no_broadcast(spark):
    from wattflow.operators import prefix
    # with many keys above the bound their quantiles and summaries are as large as the rows
    rows = spark.range(60).select((F.col("id") % 20).alias("k"), F.col("id").alias("at"), F.col("id").alias("v"))
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        scan = prefix.ordered_scan(rows, ["k"], ["at"], sums={"v": F.col("v")}, lags=["v"], firsts=["at"], chunked=True, chunks=4)
        plan = scan._jdf.queryExecution().toString()
        got = {(r.k, r.at): (r._rn, r._n, r._before_v, r._lag1_v, r._first_at) for r in scan.collect()}
    finally:
        spark.conf.set(key, before)
    assert "roadcast" not in plan
    assert got == {(i % 20, i): (i // 20 + 1, 3, sum(range(i % 20, i, 20)), i - 20 if i >= 20 else None, i % 20) for i in range(60)}
