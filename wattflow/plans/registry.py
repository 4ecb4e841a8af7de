"""Query registry: name -> (spark builder, DuckDB oracle text).

Every builder takes ``(spark, sf_dir)``, derives the domain tables from the
driver's parquet files and returns a DataFrame over the whole tables.  Feature
plans are lazy; fits, seeds, samples and the publish run jobs when built.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattflow.functions.dates import date_to_ymd_int, ymd_to_iso
from wattflow.functions.numeric import reading_skip
from wattflow.operators import invoices as inv_ops
from wattflow.operators import readings
from wattflow.operators import accounts as acc
from wattflow.operators import clusters as cl
from wattflow.operators import evaluate as ev
from wattflow.operators import forecast as fc
from wattflow.operators import quality as qa
from wattflow.operators import sampling as smp
from wattflow.operators import windows
from wattflow.plans import customers
from wattflow.plans import load_curves as lc
from wattflow.plans import models
from wattflow.plans import matched
from wattflow.plans import oracle as O
from wattflow.session import ensure_checkpoint_dir
from wattflow.sources.fixtures import domain
from wattflow.sources.sinks import publish_bucketed, publish_ordered
from wattflow.sources.tables import read_catalog_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


KEY = ["account_id", "from_dt", "to_dt", "kwh"]

# ------------------------------------------------------------------ path A


@query("invoice_distinct", O.sql("SELECT * FROM inv", "inv"))
def q_invoice_distinct(spark, sf):
    d = domain(spark, sf)
    return inv_ops.invoice_distinct(d.accounts, d.invoices)


@query("weather_parsed", O.sql("""
SELECT station_id, ymd, obs_date,
       left(ymd, 4) || '-' || left(right(ymd, 4), 2) || '-' || right(ymd, 2) AS ymd_iso,
       CAST(strftime(obs_date, '%Y%m%d') AS INTEGER) AS ymd_int,
       TRY_CAST(tavg_raw AS DOUBLE) AS tavg
FROM w""", "w"))
def q_weather_parsed(spark, sf):
    w = readings.parse_weather(domain(spark, sf).weather)
    return w.select("station_id", "ymd", "obs_date", ymd_to_iso("ymd").alias("ymd_iso"),
                    date_to_ymd_int("obs_date").alias("ymd_int"),
                    reading_skip("tavg_raw").cast("double").alias("tavg"))


@query("station_nearest", O.sql("SELECT * FROM st1", "st1"))
def q_station_nearest(spark, sf):
    return inv_ops.stations_of_rank(domain(spark, sf).stations, 1)


@query("station_pairs", O.sql("SELECT * FROM pairs", "pairs"))
def q_station_pairs(spark, sf):
    return inv_ops.station_pairs(domain(spark, sf).stations)


DAY_COLS = "account_id, zip, from_dt, to_dt, kwh, station_id, station_dist, obs_date, tavg_raw"


@query("readings_by_day", O.sql(f"SELECT {DAY_COLS} FROM days1", "days1"))
def q_readings_by_day(spark, sf):
    d = domain(spark, sf)
    return readings.readings_by_day(matched.invoices_nearest(d), d.weather)


@query("readings_interval", O.sql(f"SELECT {DAY_COLS} FROM days1", "days1"))
def q_readings_interval(spark, sf):
    d = domain(spark, sf)
    return readings.readings_interval(matched.invoices_nearest(d), d.weather)


@query("invoice_weather_1", O.sql("SELECT * FROM stats1", "stats1"))
def q_invoice_weather_1(spark, sf):
    return matched.invoice_weather_1(domain(spark, sf))


@query("readings_two_stations", O.sql("SELECT * FROM days2", "days2"))
def q_readings_two_stations(spark, sf):
    d = domain(spark, sf)
    return readings.readings_two_stations(matched.invoices_paired(d), d.weather)


@query("invoice_weather_2", O.sql("SELECT * FROM stats2", "stats2"))
def q_invoice_weather_2(spark, sf):
    return matched.invoice_weather_2(domain(spark, sf))


@query("station_preferred", O.sql("SELECT * FROM pref2", "pref2"))
def q_station_preferred(spark, sf):
    return matched.station_preference(matched.invoice_weather_2(domain(spark, sf)))


SMALL_BOUND = 3  # of the *_chunked queries, so that most accounts count as large

SEQ_COLS = ["invoice_num", "kwh_lag", "kwh_lag_2", "daily_kwh_lag", "daily_kwh_lag_2", "avg_kwh_day_over_invoice"]
EXP_COLS = ["kwh_updating_avg", "daily_kwh_updating_avg"]
FIRST_COLS = ["first_date", "days_passed"]
MONTH_COLS = ["todt_month", "month_avg_preceding", "month_avg_preceding_flag"]
FLAG_COLS = ["month_avg_preceding_flag", "gender_flag", "billing_address2_flag", "county_fips_flag", "rate_class_flag"]


@query("matched_table_1_chunked", O.sql("SELECT * FROM matched1", "matched1"))
def q_matched_table_1_chunked(spark, sf):
    """The plan of accounts above the row bound, for every account of more than SMALL_BOUND invoices."""
    return matched.matched_table_1(domain(spark, sf), bound=SMALL_BOUND)


@query("view_read", O.sql("SELECT account_id, to_dt, kwh FROM inv WHERE kwh > 1000", "inv"))
def q_view_read(spark, sf):
    """Columns and a predicate through a registered view (A4)."""
    d = domain(spark, sf)
    inv_ops.invoice_distinct(d.accounts, d.invoices).createOrReplaceTempView("wattflow_invoices")
    return read_catalog_table(spark, "wattflow_invoices", ["account_id", "to_dt", "kwh"], F.col("kwh") > 1000)


@query("published_table", O.sql("SELECT * FROM matched1", "matched1"))
def q_published_table(spark, sf):
    """The ordered publish (A6), read back from the shared folder."""
    path = f"{ensure_checkpoint_dir(spark)}/published-{uuid.uuid4().hex}"
    publish_ordered(matched.matched_table_1(domain(spark, sf)), path, ["account_id", "to_dt"])
    return spark.read.parquet(path)


BUCKETS = 16


@query("bucketed_sequence", O.sql(f"""
SELECT account_id, from_dt, to_dt, kwh, CAST(row_number() OVER (PARTITION BY account_id {O.WINDOW_ORDER}) AS INTEGER) AS invoice_num,
       lag(kwh) OVER (PARTITION BY account_id {O.WINDOW_ORDER}) AS kwh_lag
FROM matched1""", "matched1"))
def q_bucketed_sequence(spark, sf):
    """The bucketed publish (A6) to the catalog, and account windows over the table."""
    name = f"matched_{uuid.uuid4().hex}"
    rows = matched.matched_table_1(domain(spark, sf)).select(*KEY, "todt_month")
    publish_bucketed(rows, name, "account_id", ["account_id", "to_dt"], "todt_month", BUCKETS,
                     f"{ensure_checkpoint_dir(spark)}/{name}")
    return sequence_of(spark.table(name))


def sequence_of(table):
    w = windows.account_window()
    return table.select(*KEY, F.row_number().over(w).cast("int").alias("invoice_num"), F.lag("kwh").over(w).alias("kwh_lag"))


def _cols_query(name: str, cols: list[str], src: str, builder):
    text = O.sql(f"SELECT {', '.join(KEY + cols)} FROM {src}", src)

    @query(name, text)
    def _q(spark, sf):
        return builder(domain(spark, sf)).select(*KEY, *cols)
    return _q


_cols_query("invoice_sequence", SEQ_COLS, "matched1", matched.matched_table_1)
_cols_query("expanding_avgs", EXP_COLS, "matched1", matched.matched_table_1)
_cols_query("first_date_days", FIRST_COLS, "matched1", matched.matched_table_1)
_cols_query("month_avg_preceding", MONTH_COLS, "matched1", matched.matched_table_1)
_cols_query("null_flags", FLAG_COLS, "matched2", matched.matched_table_2)


@query("matched_table_1", O.sql("SELECT * FROM matched1", "matched1"))
def q_matched_table_1(spark, sf):
    return matched.matched_table_1(domain(spark, sf))


@query("matched_table", O.sql("SELECT * FROM matched2", "matched2"))
def q_matched_table(spark, sf):
    return matched.matched_table_2(domain(spark, sf))


@query("customer_count", O.sql("SELECT count(DISTINCT account_id) AS n_accounts FROM matched2", "matched2"))
def q_customer_count(spark, sf):
    return matched.matched_table_2(domain(spark, sf)).agg(F.countDistinct("account_id").alias("n_accounts"))


# ------------------------------------------------------------------ path B


@query("interval_temp_sum", O.sql("SELECT * FROM crows WHERE tavg_interval_sum IS NOT NULL", "crows"))
def q_interval_temp_sum(spark, sf):
    return acc.complete_rows(customers.customer_rows(domain(spark, sf)))


@query("account_eligibility", O.sql("SELECT * FROM celig", "celig"))
def q_account_eligibility(spark, sf):
    return customers.eligibility(domain(spark, sf))


@query("eligible_rows", O.sql("SELECT * FROM celig_rows", "celig_rows"))
def q_eligible_rows(spark, sf):
    d = domain(spark, sf)
    rows = customers.customer_rows(d)
    return acc.eligible_rows(rows, acc.eligibility(rows, customers.FIXTURE_CUTOFF))


@query("ineligible_rows", O.sql("SELECT account_id, reason FROM celig WHERE NOT eligible", "celig"))
def q_ineligible_rows(spark, sf):
    d = domain(spark, sf)
    rows = customers.customer_rows(d)
    return acc.ineligible_accounts(rows, acc.eligibility(rows, customers.FIXTURE_CUTOFF))


@query("account_features", O.sql("SELECT * FROM cfeat", "cfeat"))
def q_account_features(spark, sf):
    return customers.features(domain(spark, sf))


@query("account_features_chunked", O.sql("SELECT * FROM cfeat", "cfeat"))
def q_account_features_chunked(spark, sf):
    return customers.features(domain(spark, sf), bound=SMALL_BOUND)


@query("account_features_all_scope", O.sql("SELECT * FROM cfeat_all", "cfeat_all"))
def q_account_features_all_scope(spark, sf):
    return customers.features(domain(spark, sf), scope="all")


HOLD_COLS = ["account_id", "from_dt", "to_dt", "kwh", "tavg_interval_sum", "month", "avg_kwh",
             "avg_kwh_for_cust_for_current_month"]


@query("holdout_last", O.sql(f"SELECT {', '.join(HOLD_COLS)} FROM cfeat WHERE is_eval", "cfeat"))
def q_holdout_last(spark, sf):
    return customers.features(domain(spark, sf)).where("is_eval").select(*HOLD_COLS)


@query("training_rows", O.sql(f"SELECT {', '.join(HOLD_COLS)} FROM cfeat WHERE NOT is_eval", "cfeat"))
def q_training_rows(spark, sf):
    return customers.features(domain(spark, sf)).where("NOT is_eval").select(*HOLD_COLS)


@query("split_80_20", O.sql("""
SELECT account_id, from_dt, to_dt, kwh, row_idx, n_rows,
       row_idx <= CAST(floor(n_rows * 0.8) AS INTEGER) AS is_train
FROM cfeat""", "cfeat"))
def q_split_80_20(spark, sf):
    f = acc.train_test_split(customers.features(domain(spark, sf)))
    return f.select("account_id", "from_dt", "to_dt", "kwh", "row_idx", "n_rows", "is_train")


@query("walk_forward_folds", O.sql(f"""
SELECT account_id, from_dt, to_dt, kwh,
       CAST(row_idx - CAST(floor(n_rows * 0.8) AS INTEGER) - 1 AS INTEGER) AS fold,
       CAST(row_idx - 1 AS INTEGER) AS n_train, train_first_to_dt, train_last_to_dt
FROM (SELECT *, first_value(to_dt) OVER (PARTITION BY account_id {O.WINDOW_ORDER}
                  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS train_first_to_dt,
             lag(to_dt) OVER (PARTITION BY account_id {O.WINDOW_ORDER}) AS train_last_to_dt
      FROM cfeat) x
WHERE row_idx > CAST(floor(n_rows * 0.8) AS INTEGER)""", "cfeat"))
def q_walk_forward_folds(spark, sf):
    return customers.from_features(domain(spark, sf), acc.walk_forward_folds)


@query("account_extremes", O.sql("""
SELECT account_id, max(kwh) AS max_kwh, min(kwh) AS min_kwh,
       arg_max(tavg_interval_sum, {'v': kwh, 't': -(to_dt - DATE '1970-01-01'), 'f': -(from_dt - DATE '1970-01-01')}) AS tavg_interval_sum_at_max,
       arg_min(tavg_interval_sum, {'v': kwh, 't': to_dt - DATE '1970-01-01', 'f': from_dt - DATE '1970-01-01'}) AS tavg_interval_sum_at_min
FROM cfeat GROUP BY account_id""", "cfeat"))
def q_account_extremes(spark, sf):
    return acc.account_extremes(customers.features(domain(spark, sf)))


@query("peaker_class", O.sql("""
SELECT account_id, CASE WHEN hi > lo THEN 'summer peaker' WHEN hi < lo THEN 'winter peaker'
                        ELSE 'pattern unclear' END AS peak_class
FROM (SELECT account_id,
             arg_max(tavg_interval_sum, {'v': kwh, 't': -(to_dt - DATE '1970-01-01'), 'f': -(from_dt - DATE '1970-01-01')}) AS hi,
             arg_min(tavg_interval_sum, {'v': kwh, 't': to_dt - DATE '1970-01-01', 'f': from_dt - DATE '1970-01-01'}) AS lo
      FROM cfeat GROUP BY account_id) x""", "cfeat"))
def q_peaker_class(spark, sf):
    return acc.peaker_class(customers.features(domain(spark, sf)))


@query("macro_avg", O.sql("""
SELECT CAST(avg(m) AS DECIMAL(18,4)) AS macro_avg_kwh
FROM (SELECT account_id, avg(kwh) AS m FROM cfeat GROUP BY account_id) x""", "cfeat"))
def q_macro_avg(spark, sf):
    return acc.macro_average(customers.features(domain(spark, sf)))


@query("overall_avg", O.sql(f"""
SELECT {O.avg4_agg("CASE WHEN NOT is_eval THEN kwh END")} AS overall_avg_kwh_train,
       {O.avg4_agg("kwh")} AS overall_avg_kwh_all
FROM cfeat""", "cfeat"))
def q_overall_avg(spark, sf):
    return acc.overall_average(customers.features(domain(spark, sf)))


# ------------------------------------------------------------------ quality and distributions
CLEAN_COLS = ["account_id", "from_dt", "to_dt", "kwh", "station_dist", "tavg_interval_avg", "todt_month",
              "daily_kwh_lag", "daily_kwh_updating_avg", "month_avg_preceding_flag",
              "month_avg_preceding", "avg_kwh_day_over_invoice", "invoice_num"]


@query("quality_slices", O.sql(f"""
SELECT slice, n_rows, {O.ratio4("n_rows", "n_total")} AS share FROM (
  SELECT 'ge_half' AS slice, count(*) FILTER (WHERE perc_missing >= 0.5) AS n_rows, count(*) AS n_total FROM matched1
  UNION ALL SELECT 'le_half', count(*) FILTER (WHERE perc_missing <= 0.5), count(*) FROM matched1
  UNION ALL SELECT 'le_tenth', count(*) FILTER (WHERE perc_missing <= 0.1), count(*) FROM matched1) x""", "matched1"))
def q_quality_slices(spark, sf):
    return qa.slice_counts(matched.matched_table_1(domain(spark, sf)))


@query("quality_ratios", O.sql(f"""
SELECT n_total, {O.ratio4("h", "n_total")} AS share_le_half, {O.ratio4("t", "n_total")} AS share_le_tenth,
       n_capped, any_missing_avg FROM (
  SELECT count(*) AS n_total,
         count(*) FILTER (WHERE perc_missing <= 0.5) AS h,
         count(*) FILTER (WHERE perc_missing <= 0.1) AS t,
         count(*) FILTER (WHERE perc_missing <= 0.1 AND avg_kwh_day_over_invoice <= 100) AS n_capped,
         COALESCE(bool_or(CASE WHEN perc_missing <= 0.1 AND avg_kwh_day_over_invoice <= 100
                               THEN tavg_interval_avg IS NULL OR isnan(tavg_interval_avg) END), false) AS any_missing_avg
  FROM matched1) x""", "matched1"))
def q_quality_ratios(spark, sf):
    return qa.quality_summary(matched.matched_table_1(domain(spark, sf)))


def clean_rows_1(d):
    rows = qa.clean_rows(matched.matched_table_1(d))
    return qa.select_present(rows, CLEAN_COLS + ["invoicenum", "dist"]).na.fill(0)


@query("clean_rows", O.sql(f"""
SELECT account_id, from_dt, to_dt, kwh, CAST(COALESCE(station_dist, 0) AS DECIMAL(4,2)) AS station_dist,
       COALESCE(tavg_interval_avg, 0) AS tavg_interval_avg, COALESCE(todt_month, 0) AS todt_month,
       CAST(COALESCE(daily_kwh_lag, 0) AS DECIMAL(6,2)) AS daily_kwh_lag,
       CAST(COALESCE(daily_kwh_updating_avg, 0) AS DECIMAL(18,4)) AS daily_kwh_updating_avg,
       COALESCE(month_avg_preceding_flag, 0) AS month_avg_preceding_flag,
       CAST(COALESCE(month_avg_preceding, 0) AS DECIMAL(18,4)) AS month_avg_preceding,
       CAST(COALESCE(avg_kwh_day_over_invoice, 0) AS DECIMAL(6,2)) AS avg_kwh_day_over_invoice,
       COALESCE(invoice_num, 0) AS invoice_num
FROM clean1""", "clean1"))
def q_clean_rows(spark, sf):
    return clean_rows_1(domain(spark, sf))


@query("usage_histogram", O.sql("""
SELECT CAST(floor(avg_kwh_day_over_invoice / 5) AS INTEGER) AS bin, count(*) AS n
FROM matched1 WHERE avg_kwh_day_over_invoice IS NOT NULL GROUP BY 1""", "matched1"))
def q_usage_histogram(spark, sf):
    return qa.histogram(matched.matched_table_1(domain(spark, sf)), "avg_kwh_day_over_invoice", 5)


@query("usage_temp_grid", O.sql("""
SELECT CAST(floor(avg_kwh_day_over_invoice / 5) AS INTEGER) AS bin_x,
       CAST(floor(tavg_interval_avg / 5) AS INTEGER) AS bin_y, count(*) AS n
FROM matched1 WHERE avg_kwh_day_over_invoice IS NOT NULL AND tavg_interval_avg IS NOT NULL GROUP BY 1, 2""", "matched1"))
def q_usage_temp_grid(spark, sf):
    return qa.density_grid(matched.matched_table_1(domain(spark, sf)), "avg_kwh_day_over_invoice",
                           "tavg_interval_avg", 5, 5)


def _auto(i: int, c: str) -> str:
    span, wide = f"(max({c}) - min({c}))", f"(quantile_disc({c}, 0.75) - quantile_disc({c}, 0.25))"
    k = (f"CASE WHEN {span} = 0 THEN 1 ELSE least(50, CASE WHEN {wide} = 0 THEN floor(sqrt(count(*))) "
         f"ELSE ceil({span} / (2 * {wide} / cbrt(count(*)))) END) END")
    return f"min({c}) AS lo{i}, CAST({k} AS INTEGER) AS k{i}, {span} / ({k}) AS w{i}"


def _in_bin(i: int, c: str) -> str:
    return f"CASE WHEN w{i} = 0 THEN 0 ELSE CAST(least(floor(({c} - lo{i}) / w{i}), k{i} - 1) AS INTEGER) END"


_V = """SELECT CAST(avg_kwh_day_over_invoice AS DOUBLE) AS v0, CAST(tavg_interval_avg AS DOUBLE) AS v1
  FROM matched1 WHERE avg_kwh_day_over_invoice IS NOT NULL"""


@query("usage_histogram_auto", O.sql(f"""
SELECT bin, CAST(lo0 + bin * w0 AS DECIMAL(18,6)) AS from_value, CAST(w0 AS DECIMAL(18,6)) AS width, count(*) AS n
FROM (SELECT {_in_bin(0, 'v0')} AS bin, lo0, w0 FROM ({_V}) v, (SELECT {_auto(0, 'v0')} FROM ({_V}) v) b) x
GROUP BY bin, lo0, w0""", "matched1"))
def q_usage_histogram_auto(spark, sf):
    return qa.histogram_auto(matched.matched_table_1(domain(spark, sf)), "avg_kwh_day_over_invoice")


@query("usage_temp_grid_auto", O.sql(f"""
SELECT {_in_bin(0, 'v0')} AS bin_x, {_in_bin(1, 'v1')} AS bin_y, count(*) AS n
FROM (SELECT * FROM ({_V}) z WHERE v1 IS NOT NULL) v,
  (SELECT {_auto(0, 'v0')}, {_auto(1, 'v1')} FROM ({_V}) z WHERE v1 IS NOT NULL) b GROUP BY 1, 2""", "matched1"))
def q_usage_temp_grid_auto(spark, sf):
    return qa.density_grid_auto(matched.matched_table_1(domain(spark, sf)), "avg_kwh_day_over_invoice", "tavg_interval_avg")


# ------------------------------------------------------------------ sampling and splits
def _md5_bucket(seed, cols):
    parts = " || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"CAST(('0x' || substr(md5('{seed}:' || {parts}), 1, 8)) AS BIGINT) % 1000"


@query("hash_split", O.sql(f"""
SELECT account_id, from_dt, to_dt, kwh,
       CASE WHEN {_md5_bucket(42, KEY)} < 666 THEN 'train' ELSE 'test' END AS split
FROM clean1""", "clean1"))
def q_hash_split(spark, sf):
    rows = clean_rows_1(domain(spark, sf)).select(*KEY)
    return smp.hash_split(rows, 42, KEY)


SAMPLE_N = 100


@query("shuffled_head", O.sql(f"""
SELECT account_id, from_dt, to_dt, kwh FROM clean1
ORDER BY md5('7:' || {" || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in KEY)}), account_id, from_dt, to_dt, kwh LIMIT {SAMPLE_N}""", "clean1"))
def q_shuffled_head(spark, sf):
    """The first rows of the shuffled table, as the notebook looks at them."""
    return smp.shuffle_rows(clean_rows_1(domain(spark, sf)).select(*KEY), 7, KEY).limit(SAMPLE_N)


@query("sample_accounts", O.sql(f"""
SELECT account_id FROM (SELECT DISTINCT account_id FROM crows) x
ORDER BY md5('42:' || CAST(account_id AS VARCHAR)) LIMIT {SAMPLE_N}""", "crows"))
def q_sample_accounts(spark, sf):
    return smp.sample_ids(customers.customer_rows(domain(spark, sf)), SAMPLE_N, 42)


@query("sample_eligible", O.sql(f"""
SELECT account_id FROM celig WHERE eligible
ORDER BY md5('42:' || CAST(account_id AS VARCHAR)) LIMIT {SAMPLE_N}""", "celig"))
def q_sample_eligible(spark, sf):
    return smp.sample_ids(customers.eligibility(domain(spark, sf)).where("eligible"), SAMPLE_N, 42)


MERGE_COLS = ["account_id", "from_dt", "to_dt", "kwh", "tavg_interval_sum", "is_eval"]


@query("merged_samples", O.sql(f"""
SELECT DISTINCT {', '.join(MERGE_COLS)} FROM cfeat
WHERE account_id IN (SELECT account_id FROM celig WHERE eligible ORDER BY md5('1:' || CAST(account_id AS VARCHAR)) LIMIT {SAMPLE_N})
   OR account_id IN (SELECT account_id FROM celig WHERE eligible ORDER BY md5('2:' || CAST(account_id AS VARCHAR)) LIMIT {SAMPLE_N})""",
                                "cfeat", "celig"))
def q_merged_samples(spark, sf):
    return customers.merged_samples(domain(spark, sf), SAMPLE_N, (1, 2), MERGE_COLS, KEY)


# ------------------------------------------------------------------ load curves and clusters
@query("load_pivot", O.sql("SELECT * FROM lpivot", "lpivot"))
def q_load_pivot(spark, sf):
    from wattflow.sources.fixtures import load_points
    return cl.load_pivot(load_points(spark, sf), "entity_id")


@query("load_shares", O.sql("SELECT * FROM lshares", "lshares"))
def q_load_shares(spark, sf):
    return lc.supplier_shares(spark, sf)


@query("account_load_shares", O.sql("SELECT * FROM ashares", "ashares"))
def q_account_load_shares(spark, sf):
    return lc.account_shares(domain(spark, sf))


@query("nearest_centroid", O.sql("SELECT * FROM alabels", "alabels"))
def q_nearest_centroid(spark, sf):
    return lc.account_labels(spark, domain(spark, sf), sf)


@query("cluster_shares", O.sql(f"""
SELECT cluster, n, {O.ratio4("n", "sum(n) OVER ()")} AS pct
FROM (SELECT cluster, count(*) AS n FROM alabels GROUP BY cluster) x""", "alabels"))
def q_cluster_shares(spark, sf):
    return cl.cluster_shares(lc.account_labels(spark, domain(spark, sf), sf))


@query("cluster_labels_joined", O.sql("""
SELECT r.account_id, r.from_dt, r.to_dt, r.kwh, COALESCE(r.gender, '-1') AS gender,
       COALESCE(r.rate_class, '-1') AS rate_class, COALESCE(r.county_fips, -1) AS county_fips,
       COALESCE(l.cluster, -1) AS load_curve_cluster
FROM km_rows r LEFT JOIN alabels l ON l.account_id = r.account_id""", "km_rows", "alabels"))
def q_cluster_labels_joined(spark, sf):
    d = domain(spark, sf)
    rows = lc.clustering_rows(d).select(*KEY, "gender", "rate_class", "county_fips")
    return cl.label_rows(rows, lc.account_labels(spark, d, sf), "account_id")


@query("cluster_labels_complete", O.sql("""
SELECT r.account_id, r.from_dt, r.to_dt, r.kwh, COALESCE(r.gender, '-1') AS gender,
       COALESCE(r.rate_class, '-1') AS rate_class, COALESCE(r.county_fips, -1) AS county_fips,
       COALESCE(l.cluster, -1) AS load_curve_cluster
FROM km_rows r LEFT JOIN (SELECT * FROM alabels WHERE account_id IN (
  SELECT account_id FROM km_rows GROUP BY account_id HAVING count(DISTINCT todt_month) = 12)) l
  ON l.account_id = r.account_id""", "km_rows", "alabels"))
def q_cluster_labels_complete(spark, sf):
    """Labels of complete curves only: rows of other accounts get -1."""
    d = domain(spark, sf)
    return lc.labelled_rows(d, lc.account_labels(spark, d, sf, complete_only=True))


_LABELS = """
SELECT e, CAST(arg_min(c, {'d': GAP, 'c': c}) AS INTEGER) AS cluster
FROM final f JOIN best b ON b.k = f.k AND b.start = f.start, pts x GROUP BY e"""


@query("kmeans_chain", O.kmeans("ashares", "account_id", [cl.KMEANS_K_FINAL], cl.KMEANS_N_INIT, f"""
SELECT r.account_id, r.from_dt, r.to_dt, r.kwh, COALESCE(r.gender, '-1') AS gender,
       COALESCE(r.rate_class, '-1') AS rate_class, COALESCE(r.county_fips, -1) AS county_fips,
       COALESCE(l.cluster, -1) AS load_curve_cluster
FROM km_rows r LEFT JOIN ({_LABELS}) l ON l.e = r.account_id""",
                                " AND ".join(f"m_{m}_pct IS NOT NULL" for m in range(1, 13))))
def q_kmeans_chain(spark, sf):
    return lc.kmeans_chain(domain(spark, sf))


@query("kmeans_k1", O.sql("""
SELECT 1 AS k, CAST(SUM(""" + " + ".join(
    f"(s.m_{m}_pct - mu.m_{m}_pct) * (s.m_{m}_pct - mu.m_{m}_pct)" for m in range(1, 13)) + """) AS DECIMAL(20,10)) AS cost
FROM lshares s, (SELECT """ + ", ".join(f"avg(m_{m}_pct) AS m_{m}_pct" for m in range(1, 13)) + """ FROM lshares) mu""",
                           "lshares"))
def q_kmeans_k1(spark, sf):
    cost = cl.kmeans_one_cost(lc.supplier_shares(spark, sf))
    return cost.select(F.lit(1).alias("k"), F.col("cost").cast("decimal(20,10)").alias("cost"))


@query("kmeans_sweep", O.kmeans("lshares", "entity_id", list(range(1, cl.KMEANS_K_MAX + 1)), cl.KMEANS_N_INIT, """
SELECT k, c AS cost, CAST(-c AS DECIMAL(20,10)) AS score FROM (SELECT k, CAST(CAST((cost + 500000) // 1000000 AS DECIMAL(20,0))
  * CAST(0.0000000001 AS DECIMAL(10,10)) AS DECIMAL(20,10)) AS c FROM best) x"""))
def q_kmeans_sweep(spark, sf):
    return cl.kmeans_sweep(spark, lc.supplier_shares(spark, sf), "entity_id")


@query("kmeans_final", O.kmeans("lshares", "entity_id", [cl.KMEANS_K_FINAL], cl.KMEANS_N_INIT,
                                f"SELECT e AS entity_id, cluster FROM ({_LABELS}) l"))
def q_kmeans_final(spark, sf):
    return cl.kmeans_labels(lc.supplier_shares(spark, sf), "entity_id")


# ------------------------------------------------------------------ evaluation over naive forecasts
def _naive(spark, sf, bound=None):
    return customers.from_features(domain(spark, sf), ev.naive_forecasts, bound=bound)


@query("naive_forecasts_chunked", O.sql("SELECT * FROM naive", "naive"))
def q_naive_forecasts_chunked(spark, sf):
    return _naive(spark, sf, SMALL_BOUND)


@query("naive_wide", O.sql("""
SELECT account_id, from_dt, to_dt, kwh, previous AS predicted_previous, expanding_mean AS predicted_expanding_mean,
       same_month_mean AS predicted_same_month_mean FROM naive_wide""", "naive_wide"))
def q_naive_wide(spark, sf):
    return ev.pivot_predictions(_naive(spark, sf), [ev.PREVIOUS, ev.EXPANDING, ev.SAME_MONTH])


def _naive_errors(spark, sf):
    return ev.error_frame(_naive(spark, sf))


@query("naive_forecasts", O.sql("SELECT * FROM naive", "naive"))
def q_naive_forecasts(spark, sf):
    return _naive(spark, sf)


@query("error_frame", O.sql("SELECT * FROM efr", "efr"))
def q_error_frame(spark, sf):
    return _naive_errors(spark, sf)


@query("errors_by_account", O.sql("SELECT * FROM eacc", "eacc"))
def q_errors_by_account(spark, sf):
    return ev.errors_by_account(_naive_errors(spark, sf))


@query("errors_grand", O.sql(f"""
SELECT model, count(*) AS n_accounts, CAST(SUM(ae) AS DECIMAL(28,4)) AS ae, {O.avg4_scaled("mae", 4)} AS mae
FROM eacc GROUP BY model""", "eacc"))
def q_errors_grand(spark, sf):
    return ev.errors_grand(_naive_errors(spark, sf))


@query("errors_pooled", O.sql(f"""
SELECT model, n, ae, mae,
       CAST(CAST((2 * CAST(ae * 10000 AS HUGEINT) + s) // (2 * s) AS DECIMAL(18,0)) * CAST(0.0001 AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS rel_mae,
       rmse
FROM (SELECT model, {O._ERR_AGGS}, SUM(kwh) AS s FROM efr GROUP BY model) x""", "efr"))
def q_errors_pooled(spark, sf):
    return ev.errors_pooled(_naive_errors(spark, sf))


@query("best_worst_model", O.sql("""
SELECT account_id, arg_min(model, {'a': ae, 'm': model}) AS best_model,
       arg_min(model, {'a': -ae, 'm': model}) AS worst_model
FROM eacc GROUP BY account_id""", "eacc"))
def q_best_worst_model(spark, sf):
    return ev.best_worst_model(_naive_errors(spark, sf))


# ------------------------------------------------------------------ encoders and models
_MONTHS = range(1, 13)


@query("onehot_month", O.sql(f"""
SELECT account_id, from_dt, to_dt, kwh, month,
       {", ".join(f"CAST(CASE WHEN month = {m} AND {m} IN (SELECT month FROM train_months) THEN 1 ELSE 0 END AS DOUBLE) AS month_{m}" for m in _MONTHS)},
       CAST(CASE WHEN month IN (SELECT month FROM train_months) THEN 0 ELSE 1 END AS DOUBLE) AS month_other
FROM cfeat""", "cfeat", "train_months"))
def q_onehot_month(spark, sf):
    return models.onehot_month(customers.features(domain(spark, sf)))


@query("interaction_month_temp", O.sql(f"""
SELECT account_id, from_dt, to_dt, kwh, month, tavg_interval_sum,
       {", ".join(f"CASE WHEN month = {m} AND {m} IN (SELECT month FROM train_months) THEN tavg_interval_sum ELSE 0.0 END AS month_{m}_x_tavg" for m in _MONTHS)},
       CASE WHEN month IN (SELECT month FROM train_months) THEN 0.0 ELSE tavg_interval_sum END AS month_other_x_tavg
FROM cfeat""", "cfeat", "train_months"))
def q_interaction_month_temp(spark, sf):
    return models.interaction_month_temp(customers.features(domain(spark, sf)))


_W1_BEFORE = f"(PARTITION BY account_id {O.WINDOW_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("walk_forward_ols1", O.sql(f"""
SELECT account_id, from_dt, to_dt, kwh, fold, prediction,
       CAST(abs(CAST(kwh AS DECIMAL(18,3)) - prediction) AS DECIMAL(18,3)) AS abs_error FROM (
  SELECT account_id, from_dt, to_dt, kwh,
         CAST(row_idx - CAST(floor(n_rows * 0.8) AS INTEGER) - 1 AS INTEGER) AS fold,
         row_idx, n_rows,
         CAST(CASE WHEN var_pop(tavg_interval_sum) OVER {_W1_BEFORE} > 1e-9
                   THEN regr_intercept(kwh, tavg_interval_sum) OVER {_W1_BEFORE}
                        + regr_slope(kwh, tavg_interval_sum) OVER {_W1_BEFORE} * tavg_interval_sum END
              AS DECIMAL(18,3)) AS prediction
  FROM cfeat) x
WHERE row_idx > CAST(floor(n_rows * 0.8) AS INTEGER)""", "cfeat"))
def q_walk_forward_ols1(spark, sf):
    return customers.from_features(domain(spark, sf), fc.walk_forward_ols1)


@query("walk_forward_ols1_chunked", ORACLE["walk_forward_ols1"])
def q_walk_forward_ols1_chunked(spark, sf):
    return customers.from_features(domain(spark, sf), fc.walk_forward_ols1, bound=SMALL_BOUND)


@query("walk_forward_folds_chunked", ORACLE["walk_forward_folds"])
def q_walk_forward_folds_chunked(spark, sf):
    return customers.from_features(domain(spark, sf), acc.walk_forward_folds, bound=SMALL_BOUND)


def _ols1_errors(spark, sf):
    preds = customers.from_features(domain(spark, sf), fc.walk_forward_ols1)
    return models.model_errors(preds.select(*KEY, F.lit("ols1").alias("model"), "prediction"))


_OLS1_EFR = f"""
SELECT *, abs(error) AS abs_error, CAST(error * error AS DECIMAL(38,8)) AS sq_error FROM (
  SELECT account_id, kwh, 'ols1' AS model, prediction,
         CAST(CAST(kwh AS DECIMAL(18,4)) - CAST(prediction AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS error
  FROM ({ORACLE["walk_forward_ols1"]}) p) x"""


@query("walk_forward_errors_by_account", f"SELECT account_id, model, {O._ERR_AGGS} FROM ({_OLS1_EFR}) e GROUP BY account_id, model")
def q_walk_forward_errors_by_account(spark, sf):
    return ev.errors_by_account(_ols1_errors(spark, sf))


@query("walk_forward_errors_grand", f"""
SELECT model, count(*) AS n_accounts, CAST(SUM(ae) AS DECIMAL(28,4)) AS ae, {O.avg4_scaled("mae", 4)} AS mae
FROM (SELECT account_id, model, {O._ERR_AGGS} FROM ({_OLS1_EFR}) e GROUP BY account_id, model) a GROUP BY model""")
def q_walk_forward_errors_grand(spark, sf):
    return ev.errors_grand(_ols1_errors(spark, sf))


@query("walk_forward_ols_errors")
def q_walk_forward_ols_errors(spark, sf):
    preds = customers.from_features(domain(spark, sf), fc.walk_forward_ols)
    return ev.errors_by_account(models.model_errors(preds.select(*KEY, "model", "prediction")))


@query("walk_forward_ols")
def q_walk_forward_ols(spark, sf):
    return customers.from_features(domain(spark, sf), fc.walk_forward_ols)


@query("walk_forward_rf")
def q_walk_forward_rf(spark, sf):
    return fc.walk_forward_forest(customers.features(domain(spark, sf)))


@query("walk_forward_tree", O.WALK_TREE)
def q_walk_forward_tree(spark, sf):
    """One full tree without bootstrap for every account and fold: what each tree of the forest is, with an exact oracle."""
    got = fc.walk_forward_forest(customers.features(domain(spark, sf)), trees=1, bootstrap=False)
    return (got.where(F.col("prediction").isNotNull())
            .select(*KEY, "fold", F.col("prediction").cast("decimal(18,6)").alias("prediction")))


@query("pooled_tree", O.POOLED_TREE)
def q_pooled_tree(spark, sf):
    """One full tree without bootstrap over all accounts."""
    got = fc.pooled_forecast(customers.features(domain(spark, sf)), fc.POOLED_SPEC, {"tree": fc.Forest(1, bootstrap=False)})
    return got.select(*KEY, F.col("prediction").cast("decimal(18,6)").alias("prediction"))


@query("pooled_ols", O.sql(f"""
SELECT account_id, from_dt, to_dt, kwh, 'ols' AS model, CAST({O.POOLED_LINE} AS DECIMAL(18,3)) AS prediction
FROM cfeat LEFT JOIN pl_level USING (month), pl_mean, pl_s0 WHERE is_eval""", "cfeat", "pl_level", "pl_mean", "pl_s0"))
def q_pooled_ols(spark, sf):
    return models.pooled(customers.features(domain(spark, sf)), ["ols"]).withColumn(
        "prediction", F.col("prediction").cast("decimal(18,3)"))


@query("pooled_rf")
def q_pooled_rf(spark, sf):
    return models.pooled(customers.features(domain(spark, sf)), ["rf"])


@query("pooled_registry")
def q_pooled_registry(spark, sf):
    return models.pooled(customers.features(domain(spark, sf)), ["ols", "rf"])


@query("pooled_errors")
def q_pooled_errors(spark, sf):
    preds = models.pooled(customers.features(domain(spark, sf)), ["ols", "rf"])
    return ev.errors_pooled(ev.error_frame(preds.withColumn("prediction", F.col("prediction").cast("decimal(18,4)"))))


@query("pooled_gbt_tree")
def q_pooled_gbt_tree(spark, sf):
    return models.pooled(customers.features(domain(spark, sf)), ["gbt", "tree"])


_LINE = "SELECT regr_intercept(kwh, tavg_interval_sum) AS i, regr_slope(kwh, tavg_interval_sum) AS s FROM cfeat WHERE NOT is_eval"


@query("pooled_ols1", O.sql(f"""
SELECT account_id, from_dt, to_dt, kwh, 'ols1' AS model, CAST(i + s * tavg_interval_sum AS DECIMAL(18,3)) AS prediction
FROM cfeat, ({_LINE}) l WHERE is_eval""", "cfeat"))
def q_pooled_ols1(spark, sf):
    return fc.pooled_ols1_forecast(customers.features(domain(spark, sf)))


@query("coefficients_ols1", O.sql(f"""
SELECT CAST(i AS DECIMAL(18,6)) AS intercept, CAST(s AS DECIMAL(18,6)) AS slope FROM ({_LINE}) l""", "cfeat"))
def q_coefficients_ols1(spark, sf):
    line = fc.pooled_ols1(customers.features(domain(spark, sf)))
    return line.select(*[F.col(c).cast("decimal(18,6)").alias(c) for c in ("intercept", "slope")])


@query("interaction_pairs", O.sql("""
SELECT account_id, from_dt, to_dt, kwh,
       CASE WHEN seen THEN CAST(month AS VARCHAR) || ':' || station_id END AS month_station,
       1.0::DOUBLE AS pair_value, CAST(tavg_interval_sum * days_passed AS DOUBLE) AS tavg_x_days
FROM (SELECT *, month IN (SELECT month FROM train_months)
        AND station_id IN (SELECT station_id FROM cfeat WHERE NOT is_eval) AS seen FROM cfeat) x""", "cfeat", "train_months"))
def q_interaction_pairs(spark, sf):
    return models.interaction_pairs(customers.features(domain(spark, sf)))


@query("account_effects", O.sql(f"""
SELECT account_id, from_dt, to_dt, kwh, 'account_effects' AS model, CAST({O.ACCOUNT_LINE} AS DECIMAL(18,3)) AS prediction
FROM cfeat JOIN ac_level USING (account_id), ac_s0 WHERE is_eval""", "cfeat", "ac_level", "ac_s0"))
def q_account_effects(spark, sf):
    return fc.account_effects(customers.features(domain(spark, sf))).withColumn(
        "prediction", F.col("prediction").cast("decimal(18,3)"))


@query("temp_ablation_rf")
def q_temp_ablation_rf(spark, sf):
    return models.temp_ablation_rf(customers.features(domain(spark, sf)))


@query("coefficients", O.sql(f"""
SELECT feature, CAST(coefficient AS DECIMAL(18,6)) AS coefficient FROM ({O.COEFFICIENTS}) x""", "pl_level", "pl_mean", "pl_s0"))
def q_coefficients(spark, sf):
    return fc.coefficient_table(customers.features(domain(spark, sf))).withColumn(
        "coefficient", F.col("coefficient").cast("decimal(18,6)"))


@query("temp_ablation")
def q_temp_ablation(spark, sf):
    return models.temp_ablation(customers.features(domain(spark, sf)))


@query("notebook_forest_errors")
def q_notebook_forest_errors(spark, sf):
    return models.notebook_errors(domain(spark, sf))


@query("rf_tree_compare")
def q_rf_tree_compare(spark, sf):
    return fc.tree_count_compare(models.notebook_split(domain(spark, sf)))


@query("cv_line", O.sql(f"""
SELECT fold, CAST(1 - sum((y - i - s * x) * (y - i - s * x)) / sum((y - my) * (y - my)) AS DECIMAL(18,6)) AS r2 FROM (
  SELECT t.fold, t.x, t.y, avg(t.y) OVER (PARTITION BY t.fold) AS my, m.i, m.s
  FROM cvr t JOIN (SELECT f.fold, regr_intercept(y, x) AS i, regr_slope(y, x) AS s
                   FROM cvr, (SELECT DISTINCT fold FROM cvr) f WHERE cvr.fold <> f.fold GROUP BY f.fold) m ON m.fold = t.fold) z
GROUP BY fold""", "cvr"))
def q_cv_line(spark, sf):
    rows = models.notebook_split(domain(spark, sf)).where("split = 'train'")
    return fc.cross_validated_line(rows, "tavg_interval_avg", fc.NOTEBOOK_TARGET)


@query("grid_search")
def q_grid_search(spark, sf):
    return fc.grid_search(models.notebook_split(domain(spark, sf)))


# ------------------------------------------------------------------ preview
PREVIEW_N = 5


@query("preview_rows", O.sql(f"""
SELECT account_id, from_dt, to_dt, kwh, avg_kwh_day_over_invoice, perc_missing FROM matched1
ORDER BY account_id, to_dt, from_dt, kwh LIMIT {PREVIEW_N}""", "matched1"))
def q_preview_rows(spark, sf):
    """First rows of the feature table in publish order: an ordered top-n (F8)."""
    m = matched.matched_table_1(domain(spark, sf))
    return (m.select("account_id", "from_dt", "to_dt", "kwh", "avg_kwh_day_over_invoice", "perc_missing")
            .orderBy("account_id", "to_dt", "from_dt", "kwh").limit(PREVIEW_N))
