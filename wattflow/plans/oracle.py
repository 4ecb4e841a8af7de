"""DuckDB texts of the registered queries (the correctness oracle).

Each text starts from the driver's raw tables, rebuilds the domain tables with
the same integer rules as ``sources.fixtures`` and then states the query the
straightforward way: interval joins with BETWEEN, GROUP BY, window functions.
That is deliberately a different formulation from the Spark plans (prefix
lookups, checked broadcasts), so agreement checks the rewrite as well.

Fragments are named CTEs with dependencies; ``sql(..)`` pulls in what a query
needs in dependency order.
"""

from __future__ import annotations

FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {}


def frag(name: str, deps: tuple[str, ...], body: str) -> None:
    FRAGMENTS[name] = (deps, body)


def sql(select: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in FRAGMENTS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS (\n{FRAGMENTS[n][1]}\n)" for n in order)
    return f"WITH {ctes}\n{select}" if ctes else select


# ---------------------------------------------------------------- domain tables
frag("invoices_d", (), """
SELECT DISTINCT c.c_custkey AS account_key,
       CAST(o.o_orderdate AS DATE) - CAST(27 + c.c_custkey % 4 AS INTEGER) AS from_dt,
       CAST(o.o_orderdate AS DATE) AS to_dt,
       CAST(floor(o.o_totalprice / 100) AS INTEGER) AS kwh
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey""")

frag("accounts_d", (), """
SELECT c.c_custkey AS account_id, c.c_custkey AS account_key, c.c_nationkey AS zip,
       lower(n.n_name) AS city, r.r_name AS state,
       CASE WHEN c.c_custkey % 5 = 0 THEN NULL WHEN c.c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
       CASE WHEN c.c_custkey % 3 = 0 THEN 'UNIT ' || CAST(c.c_custkey AS VARCHAR) END AS billing_address2,
       CAST(c.c_nationkey % 4 AS INTEGER) AS utility_id,
       c.c_mktsegment AS account_type,
       CASE WHEN c.c_custkey % 7 <> 0 THEN CAST(c.c_nationkey * 1000 + c.c_custkey % 97 AS INTEGER) END AS county_fips,
       CASE WHEN c.c_custkey % 11 <> 0 THEN 'R' || CAST(c.c_custkey % 3 AS VARCHAR) END AS rate_class
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey""")

frag("stations_d", (), """
SELECT n_nationkey AS zip, CAST(n_regionkey AS VARCHAR) AS station_id,
       CAST(n_nationkey % 7 + 0.25 AS DECIMAL(4,2)) AS station_dist, 1 AS station_rank FROM nation
UNION ALL
SELECT n_nationkey, CAST((n_regionkey + 1) % 5 AS VARCHAR),
       CAST(5 + n_nationkey % 7 + 0.5 AS DECIMAL(4,2)), 2 FROM nation""")

frag("weather_d", (), """
SELECT CAST(n.n_regionkey AS VARCHAR) AS station_id,
       strftime(l.l_shipdate, '%Y%m%d') AS ymd,
       CASE WHEN count(*) % 4 = 0 OR (n.n_regionkey = 3 AND month(l.l_shipdate) IN (6, 7)) THEN 'M'
            ELSE CAST(75 - 6 * abs(7 - month(l.l_shipdate)) + CAST(floor(avg(l.l_quantity)) AS INTEGER) % 10 AS VARCHAR)
       END AS tavg_raw
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
GROUP BY n.n_regionkey, l.l_shipdate""")

# ---------------------------------------------------------------- path A
frag("inv", ("accounts_d", "invoices_d"), """
SELECT DISTINCT a.account_id, a.zip, i.from_dt, i.to_dt, i.kwh
FROM accounts_d a JOIN invoices_d i ON i.account_key = a.account_key""")

frag("w", ("weather_d",), """
SELECT station_id, ymd, tavg_raw, CAST(try_strptime(ymd, '%Y%m%d') AS DATE) AS obs_date FROM weather_d""")

frag("st1", ("stations_d",), "SELECT zip, station_id, station_dist FROM stations_d WHERE station_rank = 1")

frag("pairs", ("stations_d",), """
SELECT a.zip, a.station_id AS station_id_1, a.station_dist AS station_dist_1,
       b.station_id AS station_id_2, b.station_dist AS station_dist_2
FROM stations_d a JOIN stations_d b ON a.zip = b.zip AND a.station_rank = 1 AND b.station_rank = 2""")

frag("m1", ("inv", "st1"), "SELECT inv.*, st1.station_id, st1.station_dist FROM inv JOIN st1 ON inv.zip = st1.zip")

frag("days1", ("m1", "w"), """
SELECT m1.*, w.obs_date, w.tavg_raw FROM m1 JOIN w
  ON w.station_id = m1.station_id AND w.obs_date >= m1.from_dt AND w.obs_date <= m1.to_dt""")

frag("stats1", ("days1",), """
SELECT account_id, zip, from_dt, to_dt, CAST(to_dt - from_dt + 1 AS INTEGER) AS duration, kwh,
       station_id, station_dist, s AS tavg_interval_sum, a AS tavg_interval_avg, num_missing,
       CAST(round(s + a * num_missing) AS INTEGER) AS tavg_interval_sum_corrected,
       CAST(CAST(num_missing AS DECIMAL(18,0)) / CAST(to_dt - from_dt + 1 AS DECIMAL(18,0)) AS DECIMAL(5,4)) AS perc_missing,
       CAST(CAST(kwh AS DECIMAL(18,0)) / CAST(to_dt - from_dt + 1 AS DECIMAL(18,0)) AS DECIMAL(6,2)) AS avg_kwh_day_over_invoice,
       CAST(month(to_dt) AS INTEGER) AS todt_month, CAST(day(to_dt) AS INTEGER) AS todt_day
FROM (
  SELECT account_id, zip, from_dt, to_dt, kwh, station_id, station_dist,
         SUM(CASE WHEN tavg_raw = 'M' THEN 0 ELSE TRY_CAST(tavg_raw AS DOUBLE) END) AS s,
         AVG(CASE WHEN tavg_raw = 'M' THEN 0 ELSE TRY_CAST(tavg_raw AS DOUBLE) END) AS a,
         CAST(SUM(CASE WHEN tavg_raw = 'M' THEN 1 ELSE 0 END) AS INTEGER) AS num_missing
  FROM days1 GROUP BY account_id, zip, from_dt, to_dt, kwh, station_id, station_dist) t""")

WINDOW_ORDER = "ORDER BY to_dt, from_dt, kwh"


def avg4(x: str, w: str, scale: int) -> str:
    """Exact mean at 4 places, half up, in integer arithmetic (x >= 0)."""
    units = f"CAST(SUM({x}) OVER {w} * {10 ** scale} AS BIGINT)"
    n = f"NULLIF(COUNT({x}) OVER {w}, 0)"
    q = f"(2 * {units} * {10 ** (4 - scale)} + {n}) // (2 * {n})"
    return f"CAST(CAST({q} AS DECIMAL(18,0)) * CAST(0.0001 AS DECIMAL(18,4)) AS DECIMAL(18,4))"


def seq_frag(name: str, src: str) -> None:
    frag(name, (src,), f"""
SELECT *,
       CAST(row_number() OVER (PARTITION BY account_id {WINDOW_ORDER}) AS INTEGER) AS invoice_num,
       lag(kwh, 1) OVER (PARTITION BY account_id {WINDOW_ORDER}) AS kwh_lag,
       lag(kwh, 2) OVER (PARTITION BY account_id {WINDOW_ORDER}) AS kwh_lag_2,
       lag(avg_kwh_day_over_invoice, 1) OVER (PARTITION BY account_id {WINDOW_ORDER}) AS daily_kwh_lag,
       lag(avg_kwh_day_over_invoice, 2) OVER (PARTITION BY account_id {WINDOW_ORDER}) AS daily_kwh_lag_2
FROM {src}""")


def exp_frag(name: str, src: str) -> None:
    run = f"(PARTITION BY account_id {WINDOW_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    whole = f"(PARTITION BY account_id {WINDOW_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    month = f"(PARTITION BY account_id, todt_month {WINDOW_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    frag(name, (src,), f"""
SELECT *, CASE WHEN month_avg_preceding IS NULL THEN 0 ELSE 1 END AS month_avg_preceding_flag FROM (
SELECT *,
       {avg4("kwh_lag", run, 0)} AS kwh_updating_avg,
       {avg4("daily_kwh_lag", run, 2)} AS daily_kwh_updating_avg,
       first_value(from_dt) OVER {whole} AS first_date,
       CAST(to_dt - first_value(from_dt) OVER {whole} AS INTEGER) AS days_passed,
       {avg4("avg_kwh_day_over_invoice", month, 2)} AS month_avg_preceding
FROM {src}) x""")


seq_frag("seq1", "stats1")
exp_frag("matched1", "seq1")

# two stations
frag("m2", ("inv", "pairs"), """
SELECT inv.*, p.station_id_1, p.station_dist_1, p.station_id_2, p.station_dist_2
FROM inv JOIN pairs p ON inv.zip = p.zip""")

frag("days2", ("m2", "w"), """
SELECT m2.*, w1.obs_date, w1.tavg_raw AS tavg_raw_1, w2.tavg_raw AS tavg_raw_2
FROM m2 JOIN w w1 ON w1.station_id = m2.station_id_1 AND w1.obs_date BETWEEN m2.from_dt AND m2.to_dt
LEFT JOIN w w2 ON w2.station_id = m2.station_id_2 AND w2.obs_date = w1.obs_date""")

frag("attrs", ("accounts_d",), """
SELECT account_id, upper(city) AS city, state, gender, billing_address2, utility_id,
       account_type, county_fips, rate_class FROM accounts_d""")

frag("stats2", ("days2", "attrs"), """
SELECT t.account_id, zip, from_dt, to_dt, CAST(to_dt - from_dt + 1 AS INTEGER) AS duration, kwh,
       station_id_1, station_dist_1, station_id_2, station_dist_2,
       s1 AS tavg_interval_sum_1, a1 AS tavg_interval_avg_1, m1 AS num_missing_1,
       CAST(round(s1 + a1 * m1) AS INTEGER) AS tavg_interval_sum_corrected_1,
       CAST(CAST(m1 AS DECIMAL(18,0)) / CAST(to_dt - from_dt + 1 AS DECIMAL(18,0)) AS DECIMAL(5,4)) AS perc_missing_1,
       s2 AS tavg_interval_sum_2, a2 AS tavg_interval_avg_2, m2 AS num_missing_2,
       CAST(round(s2 + a2 * m2) AS INTEGER) AS tavg_interval_sum_corrected_2,
       CAST(CAST(m2 AS DECIMAL(18,0)) / CAST(to_dt - from_dt + 1 AS DECIMAL(18,0)) AS DECIMAL(5,4)) AS perc_missing_2,
       p.city, p.state, p.gender, p.billing_address2, p.utility_id, p.account_type, p.county_fips, p.rate_class
FROM (
  SELECT account_id, zip, from_dt, to_dt, kwh, station_id_1, station_dist_1, station_id_2, station_dist_2,
         SUM(CASE WHEN tavg_raw_1 = 'M' THEN 0 ELSE TRY_CAST(tavg_raw_1 AS DOUBLE) END) AS s1,
         AVG(CASE WHEN tavg_raw_1 = 'M' THEN 0 ELSE TRY_CAST(tavg_raw_1 AS DOUBLE) END) AS a1,
         CAST(SUM(CASE WHEN tavg_raw_1 = 'M' THEN 1 ELSE 0 END) AS INTEGER) AS m1,
         SUM(CASE WHEN tavg_raw_2 = 'M' THEN 0 ELSE TRY_CAST(tavg_raw_2 AS DOUBLE) END) AS s2,
         AVG(CASE WHEN tavg_raw_2 = 'M' THEN 0 ELSE TRY_CAST(tavg_raw_2 AS DOUBLE) END) AS a2,
         CAST(SUM(CASE WHEN tavg_raw_2 = 'M' THEN 1 ELSE 0 END) AS INTEGER) AS m2
  FROM days2
  GROUP BY account_id, zip, from_dt, to_dt, kwh, station_id_1, station_dist_1, station_id_2, station_dist_2) t
JOIN attrs p ON p.account_id = t.account_id""")

frag("pref2", ("stats2",), """
SELECT *,
       CASE WHEN perc_missing_1 <= 0.5 THEN station_id_1 WHEN perc_missing_1 > 0.5 THEN station_id_2 END AS station_id_preferred,
       CASE WHEN perc_missing_1 <= 0.5 THEN station_dist_1 WHEN perc_missing_1 > 0.5 THEN station_dist_2 END AS station_dist_preferred,
       CAST(round(CASE WHEN perc_missing_1 <= 0.5 THEN tavg_interval_avg_1 WHEN perc_missing_1 > 0.5 THEN tavg_interval_avg_2 END) AS INTEGER) AS tavg_interval_avg_preferred,
       CASE WHEN perc_missing_1 <= 0.5 THEN perc_missing_1 WHEN perc_missing_1 > 0.5 THEN perc_missing_2 END AS perc_missing_preferred
FROM stats2""")

frag("pref2d", ("pref2",), """
SELECT *,
       CAST(CAST(kwh AS DECIMAL(18,0)) / CAST(duration AS DECIMAL(18,0)) AS DECIMAL(6,2)) AS avg_kwh_day_over_invoice,
       CAST(month(to_dt) AS INTEGER) AS todt_month, CAST(day(to_dt) AS INTEGER) AS todt_day
FROM pref2""")

seq_frag("seq2", "pref2d")
exp_frag("exp2", "seq2")

frag("matched2", ("exp2",), """
SELECT *,
       CASE WHEN gender IS NULL THEN 0 ELSE 1 END AS gender_flag,
       CASE WHEN billing_address2 IS NULL THEN 0 ELSE 1 END AS billing_address2_flag,
       CASE WHEN county_fips IS NULL THEN 0 ELSE 1 END AS county_fips_flag,
       CASE WHEN rate_class IS NULL THEN 0 ELSE 1 END AS rate_class_flag
FROM exp2""")


# ---------------------------------------------------------------- path B
CUTOFF = "DATE '2001-02-25'"


def avg4_agg(x: str) -> str:
    """Exact mean of an integer expression at 4 places, half up (x >= 0)."""
    n = f"NULLIF(COUNT({x}), 0)"
    q = f"(2 * SUM({x}) * 10000 + {n}) // (2 * {n})"
    return f"CAST(CAST({q} AS DECIMAL(18,0)) * CAST(0.0001 AS DECIMAL(18,4)) AS DECIMAL(18,4))"


frag("crows", ("m1", "w"), """
SELECT m1.account_id, m1.zip, m1.from_dt, m1.to_dt, m1.kwh, m1.station_id, m1.station_dist,
       NULLIF(COALESCE(SUM(TRY_CAST(w.tavg_raw AS DOUBLE)), 0), 0) AS tavg_interval_sum
FROM m1 LEFT JOIN w ON w.station_id = m1.station_id AND w.obs_date BETWEEN m1.from_dt AND m1.to_dt
GROUP BY m1.account_id, m1.zip, m1.from_dt, m1.to_dt, m1.kwh, m1.station_id, m1.station_dist""")

frag("celig", ("crows",), f"""
SELECT account_id, n_stations, n_rows, n_complete, n_prepared, reason IS NULL AS eligible, reason FROM (
  SELECT *, CASE WHEN n_stations <> 1 THEN 'station_change'
                 WHEN n_complete < 5 THEN 'insufficient_rows'
                 WHEN n_prepared < 2 THEN 'no_test_rows' END AS reason
  FROM (
    SELECT account_id, count(DISTINCT station_id) AS n_stations, count(*) AS n_rows,
           count(tavg_interval_sum) AS n_complete,
           greatest(count(CASE WHEN tavg_interval_sum IS NOT NULL AND to_dt <= {CUTOFF} THEN 1 END) - 2, 0) AS n_prepared
    FROM crows GROUP BY account_id) a) b""")

frag("celig_rows", ("crows", "celig"), """
SELECT r.* FROM crows r
WHERE r.tavg_interval_sum IS NOT NULL
  AND r.account_id IN (SELECT account_id FROM celig WHERE eligible)""")

frag("cf_lag", ("celig_rows",), f"""
SELECT account_id, from_dt, to_dt, kwh, station_id, tavg_interval_sum,
       tavg_interval_sum * tavg_interval_sum AS tavg_interval_sum_sq,
       CAST(year(to_dt) AS INTEGER) AS year, CAST(month(to_dt) AS INTEGER) AS month,
       CAST(day(to_dt) AS INTEGER) AS day,
       CAST(to_dt - first_value(to_dt) OVER (PARTITION BY account_id {WINDOW_ORDER}
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS INTEGER) AS days_passed,
       lag(kwh, 1) OVER (PARTITION BY account_id {WINDOW_ORDER}) AS prev_pd_kwh,
       lag(tavg_interval_sum, 1) OVER (PARTITION BY account_id {WINDOW_ORDER}) AS prev_pd_tavg_interval_sum,
       lag(kwh, 2) OVER (PARTITION BY account_id {WINDOW_ORDER}) AS prev_prev_pd_kwh,
       lag(tavg_interval_sum, 2) OVER (PARTITION BY account_id {WINDOW_ORDER}) AS prev_prev_pd_tavg_interval_sum,
       row_number() OVER (PARTITION BY account_id {WINDOW_ORDER}) AS rn,
       count(*) OVER (PARTITION BY account_id) AS n_all
FROM celig_rows WHERE to_dt <= {CUTOFF}""")

frag("cf_base", ("cf_lag",), """
SELECT * EXCLUDE (rn, n_all), CAST(rn - 2 AS INTEGER) AS row_idx, CAST(n_all - 2 AS INTEGER) AS n_rows,
       rn = n_all AS is_eval
FROM cf_lag WHERE rn > 2""")

frag("cfeat", ("cf_base",), f"""
SELECT * EXCLUDE (m_avg), COALESCE(m_avg, avg_kwh) AS avg_kwh_for_cust_for_current_month FROM (
  SELECT *,
         {avg4("CASE WHEN NOT is_eval THEN kwh END", "(PARTITION BY account_id)", 0)} AS avg_kwh,
         {avg4("CASE WHEN NOT is_eval THEN kwh END", "(PARTITION BY account_id, month)", 0)} AS m_avg
  FROM cf_base) x""")

frag("cfeat_all", ("cf_base", "celig_rows"), f"""
SELECT f.*, a.avg_kwh, COALESCE(m.m_avg, a.avg_kwh) AS avg_kwh_for_cust_for_current_month
FROM cf_base f
JOIN (SELECT account_id, {avg4_agg("kwh")} AS avg_kwh FROM celig_rows GROUP BY account_id) a
  ON a.account_id = f.account_id
LEFT JOIN (SELECT account_id, CAST(month(to_dt) AS INTEGER) AS month, {avg4_agg("kwh")} AS m_avg
           FROM celig_rows WHERE to_dt <= {CUTOFF} GROUP BY 1, 2) m
  ON m.account_id = f.account_id AND m.month = f.month""")


# ---------------------------------------------------------------- quality, sampling, curves
def ratio4(n: str, d: str) -> str:
    """n / d at 4 places, half up, in integer arithmetic (n, d >= 0)."""
    q = f"(2 * ({n}) * 10000 + ({d})) // (2 * NULLIF({d}, 0))"
    return f"CAST(CAST({q} AS DECIMAL(18,0)) * CAST(0.0001 AS DECIMAL(18,4)) AS DECIMAL(10,4))"


frag("clean1", ("matched1",), """
SELECT * FROM matched1
WHERE perc_missing <= 0.1 AND avg_kwh_day_over_invoice <= 100
  AND daily_kwh_lag IS NOT NULL AND NOT isnan(CAST(daily_kwh_lag AS DOUBLE))""")

frag("km_rows", ("matched2",), """
SELECT * FROM matched2
WHERE perc_missing_preferred <= 0.5 AND avg_kwh_day_over_invoice <= 100
  AND daily_kwh_lag IS NOT NULL AND NOT isnan(CAST(daily_kwh_lag AS DOUBLE))""")


def _pivot(src: str, entity: str, month: str, value: str) -> str:
    cols = ", ".join(f"avg({value}) FILTER (WHERE {month} = {m}) AS m_{m}" for m in range(1, 13))
    return f"SELECT {entity}, {cols} FROM {src} GROUP BY {entity}"


def _shares(src: str, entity: str) -> str:
    total = " + ".join(f"COALESCE(m_{m}, 0.0)" for m in range(1, 13))
    cols = ", ".join(f"m_{m} / ({total}) AS m_{m}_pct" for m in range(1, 13))
    return f"SELECT {entity}, {cols} FROM {src}"


frag("lpts", (), """
SELECT l_suppkey AS entity_id, CAST(month(l_shipdate) AS INTEGER) AS month, l_quantity AS value FROM lineitem""")
frag("lpivot_all", ("lpts",), _pivot("lpts", "entity_id", "month", "value"))
frag("lpivot", ("lpivot_all",), "SELECT * FROM lpivot_all WHERE " +
     " AND ".join(f"m_{m} IS NOT NULL" for m in range(1, 13)))
frag("lshares", ("lpivot",), _shares("lpivot", "entity_id"))
frag("apivot", ("km_rows",), _pivot("km_rows", "account_id", "todt_month", "kwh"))
frag("ashares", ("apivot",), _shares("apivot", "account_id"))
frag("cents", ("lshares",), """
SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, * EXCLUDE (h) FROM (
  SELECT md5('42:' || CAST(entity_id AS VARCHAR)) AS h, * FROM lshares ORDER BY h LIMIT 4) x""")
_dist = " + ".join(f"COALESCE((a.m_{m}_pct - c.m_{m}_pct) * (a.m_{m}_pct - c.m_{m}_pct), 0.0)" for m in range(1, 13))
frag("alabels", ("ashares", "cents"), f"""
SELECT account_id, arg_min(cluster, {{'d': distance, 'c': cluster}}) AS cluster, min(distance) AS distance FROM (
  SELECT a.account_id, c.cluster, sqrt({_dist}) AS distance FROM ashares a CROSS JOIN cents c) x
GROUP BY account_id""")


# ---------------------------------------------------------------- evaluation
def avg4_scaled(x: str, scale: int) -> str:
    """Exact mean of a decimal expression with ``scale`` places, at 4 places, half up (x >= 0)."""
    units = f"CAST(SUM({x}) * {10 ** scale} AS HUGEINT)"
    n = f"NULLIF(COUNT({x}), 0)"
    q = f"(2 * {units} * {10 ** (4 - scale)} + {n}) // (2 * {n})"
    return f"CAST(CAST({q} AS DECIMAL(18,0)) * CAST(0.0001 AS DECIMAL(18,4)) AS DECIMAL(18,4))"


_BEFORE = f"(PARTITION BY account_id {WINDOW_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_MONTH_BEFORE = f"(PARTITION BY account_id, month {WINDOW_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

frag("naive_wide", ("cfeat",), f"""
SELECT * FROM (
  SELECT account_id, from_dt, to_dt, kwh, row_idx, n_rows,
         CAST(prev_pd_kwh AS DECIMAL(18,4)) AS previous,
         {avg4("kwh", _BEFORE, 0)} AS expanding_mean,
         COALESCE({avg4("kwh", _MONTH_BEFORE, 0)}, {avg4("kwh", _BEFORE, 0)}) AS same_month_mean
  FROM cfeat) x
WHERE row_idx > CAST(floor(n_rows * 0.8) AS INTEGER)""")

frag("naive", ("naive_wide",), """
SELECT account_id, from_dt, to_dt, kwh, 'previous' AS model, previous AS prediction FROM naive_wide
UNION ALL SELECT account_id, from_dt, to_dt, kwh, 'expanding_mean', expanding_mean FROM naive_wide
UNION ALL SELECT account_id, from_dt, to_dt, kwh, 'same_month_mean', same_month_mean FROM naive_wide""")

frag("efr", ("naive",), """
SELECT *, abs(error) AS abs_error, CAST(error * error AS DECIMAL(38,8)) AS sq_error FROM (
  SELECT *, CAST(CAST(kwh AS DECIMAL(18,4)) - prediction AS DECIMAL(18,4)) AS error FROM naive) x""")

_ERR_AGGS = f"""count(*) AS n, CAST(SUM(abs_error) AS DECIMAL(28,4)) AS ae, {avg4_scaled("abs_error", 4)} AS mae,
       sqrt(CAST(SUM(sq_error) AS DOUBLE) / CAST(COUNT(sq_error) AS DOUBLE)) AS rmse"""

frag("eacc", ("efr",), f"SELECT account_id, model, {_ERR_AGGS} FROM efr GROUP BY account_id, model")


# ---------------------------------------------------------------- encoders and one-regressor forecast
frag("train_months", ("cfeat",), "SELECT DISTINCT month FROM cfeat WHERE NOT is_eval")


# ---------------------------------------------------------------- K-means, all sets of centres at once
def kmeans(src: str, entity: str, ks: list[int], n_init: int, select: str, complete: str = "TRUE") -> str:
    """``select`` over pts(e, p), best(k, start, cost) and final(k, start, c, p), after ``src``'s fragments."""
    point = ", ".join(f"CAST(round(m_{m}_pct * 100000000) AS BIGINT)" for m in range(1, 13))
    gap = lambda a, b: " + ".join(f"({a}[{m}] - {b}[{m}]) * ({a}[{m}] - {b}[{m}])" for m in range(1, 13))
    h = "CAST(('0x' || substr(md5('42:' || start || ':{j}:' || CAST(e AS VARCHAR)), 1, 8)) AS BIGINT)"
    seeds = [f"""s0 AS (SELECT start, 0 AS j, arg_min(p, {{'h': {h.format(j=0)}, 'e': e}}) AS p
  FROM pts, (SELECT CAST(range AS VARCHAR) AS start FROM range({n_init})) GROUP BY start)"""]
    for j in range(1, max(ks)):
        before = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(j))
        seeds.append(f"""s{j} AS (SELECT start, {j} AS j, COALESCE(arg_min(p, {{'r': -ln((h + 0.5) / 4294967296) / d, 'e': e}})
    FILTER (WHERE d > 0), arg_min(p, {{'h': h, 'e': e}})) AS p FROM (
  SELECT start, e, any_value(x.p) AS p, {h.format(j=j)} AS h, min({gap("x.p", "s.p")}) AS d
  FROM pts x, ({before}) s GROUP BY start, e) y GROUP BY start)""")
    every = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(max(ks)))
    mean = ", ".join(f"CAST((2 * sum(pt[{m}]) + count(*)) // (2 * count(*)) AS BIGINT)" for m in range(1, 13))
    return sql("", src).rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + f""",
pts AS (SELECT {entity} AS e, [{point}] AS p FROM {src} WHERE {complete}),
{", ".join(seeds)},
lloyd(it, k, start, c, p, shift) AS (
  SELECT 0, k, start, j, p, CAST(1000000000000000000 AS HUGEINT) FROM ({every}) s, (VALUES {", ".join(f"({k})" for k in ks)}) ks(k) WHERE j < k
  UNION ALL
  SELECT it + 1, k, start, c, n, CAST({gap("n", "p")} AS HUGEINT) FROM (
    SELECT l.it, l.k, l.start, l.c, l.p, COALESCE(a.n, l.p) AS n
    FROM (SELECT *, max(shift) OVER (PARTITION BY k, start) AS m FROM lloyd) l LEFT JOIN (
      SELECT k, start, c, [{mean}] AS n FROM (
        SELECT k, start, e, any_value(pt) AS pt, arg_min(c, {{'d': d, 'c': c}}) AS c FROM (
          SELECT l.k, l.start, l.c, x.e, x.p AS pt, {gap("x.p", "l.p")} AS d FROM lloyd l, pts x) y GROUP BY k, start, e) z
      GROUP BY k, start, c) a ON a.k = l.k AND a.start = l.start AND a.c = l.c
    WHERE l.m > 100000000 AND l.it < 300) w),
final AS (SELECT k, start, c, p FROM (SELECT *, max(it) OVER (PARTITION BY k, start) AS last FROM lloyd) x WHERE it = last),
costs AS (SELECT k, start, sum(d) AS cost FROM (
  SELECT k, start, e, CAST(min({gap("x.p", "f.p")}) AS HUGEINT) AS d FROM final f, pts x GROUP BY k, start, e) y GROUP BY k, start),
best AS (SELECT k, arg_min(start, {{'c': cost, 's': CAST(start AS INTEGER)}}) AS start, min(cost) AS cost FROM costs GROUP BY k)
{select.replace("GAP", gap("x.p", "f.p"))}"""


# ---------------------------------------------------------------- pooled least squares by elimination
def effects(p: str, level: str, xs: list[str]) -> str:
    """Fragments <p>_level (intercept and slope of every level), <p>_s0 (c0, c1, ...: the other coefficients).

    Intercepts and temperature slopes are taken out level by level (a level whose
    temperature never varies has no slope); what remains of the other inputs is
    eliminated step by step.  Returns the sum of the others' contributions.
    """
    n = range(len(xs))
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(xs))
    frag(f"{p}_tr", ("cfeat",), f"SELECT {level}, CAST(kwh AS DOUBLE) AS y, CAST(tavg_interval_sum AS DOUBLE) AS t, {cols} FROM cfeat WHERE NOT is_eval")
    frag(f"{p}_dev", (f"{p}_tr",), f"SELECT {level}, " + ", ".join(
        f"{c} - avg({c}) OVER (PARTITION BY {level}) AS {c}" for c in ["y", "t", *[f"x{i}" for i in n]]) + f" FROM {p}_tr")
    slope = lambda c: f"CASE WHEN sum(t * t) > 1e-9 THEN sum(t * {c}) / sum(t * t) ELSE 0 END"
    frag(f"{p}_own", (f"{p}_dev",), f"SELECT {level}, {slope('y')} AS b, " + ", ".join(
        f"{slope(f'x{i}')} AS b{i}" for i in n) + f" FROM {p}_dev GROUP BY {level}")
    frag(f"{p}_res", (f"{p}_dev", f"{p}_own"), "SELECT y - b * t AS y, " + ", ".join(f"x{i} - b{i} * t AS x{i}" for i in n)
         + f" FROM {p}_dev JOIN {p}_own USING ({level})")
    a = {(i, j): f"a{i}{j}" for i in n for j in n if i <= j}
    frag(f"{p}_e0", (f"{p}_res",), "SELECT " + ", ".join([f"sum(x{i} * x{j}) AS {v}" for (i, j), v in a.items()]
                                                        + [f"sum(x{i} * y) AS r{i}" for i in n]) + f" FROM {p}_res")
    for k in list(n)[:-1]:
        step = [f"{v} - a{k}{i} * a{k}{j} / a{k}{k} AS {v}" if i > k else v for (i, j), v in a.items()]
        step += [f"r{i} - a{k}{i} * r{k} / a{k}{k} AS r{i}" if i > k else f"r{i}" for i in n]
        frag(f"{p}_e{k + 1}", (f"{p}_e{k}",), f"SELECT {', '.join(step)} FROM {p}_e{k}")
    last = len(xs) - 1
    frag(f"{p}_s{last}", (f"{p}_e{last}",), f"SELECT *, r{last} / a{last}{last} AS c{last} FROM {p}_e{last}")
    for k in reversed(range(last)):
        known = " - ".join([f"r{k}"] + [f"a{k}{j} * c{j}" for j in range(k + 1, last + 1)])
        frag(f"{p}_s{k}", (f"{p}_s{k + 1}",), f"SELECT *, ({known}) / a{k}{k} AS c{k} FROM {p}_s{k + 1}")
    frag(f"{p}_level", (f"{p}_tr", f"{p}_own", f"{p}_s0"),
         f"SELECT {level}, slope, my - slope * mt - " + " - ".join(f"c{i} * m{i}" for i in n) + " AS level FROM (SELECT *, b - "
         + " - ".join(f"c{i} * b{i}" for i in n) + f" AS slope FROM (SELECT {level}, avg(y) AS my, avg(t) AS mt, "
         + ", ".join(f"avg(x{i}) AS m{i}" for i in n) + f" FROM {p}_tr GROUP BY {level}) m JOIN {p}_own USING ({level}), {p}_s0) x")
    return " + ".join(f"c{i} * {c}" for i, c in enumerate(xs))


_XS = ["prev_pd_kwh", "prev_prev_pd_kwh", "days_passed", "account_id", "avg_kwh"]
_POOLED_REST = effects("pl", "month", _XS)
# of the slots that say the same twice the smallest coefficients: levels around their mean, slopes around theirs
frag("pl_mean", ("pl_level",), "SELECT avg(level) AS level0, sum(slope) / (count(*) + 1) AS slope0 FROM pl_level")
POOLED_LINE = f"COALESCE(level, level0) + COALESCE(slope, slope0) * tavg_interval_sum + {_POOLED_REST}"
COEFFICIENTS = " UNION ALL ".join(
    ["SELECT 'intercept' AS feature, level0 AS coefficient FROM pl_mean", "SELECT 'tavg_interval_sum', slope0 FROM pl_mean"]
    + [f"SELECT '{c}', c{i} FROM pl_s0" for i, c in enumerate(_XS)]
    + ["SELECT 'month=' || month, level - level0 FROM pl_level, pl_mean",
       "SELECT 'month=' || month || '*tavg_interval_sum', slope - slope0 FROM pl_level, pl_mean"])
ACCOUNT_LINE = "level + slope * tavg_interval_sum + " + effects("ac", "account_id", [
    "prev_pd_kwh", "prev_prev_pd_kwh", "days_passed", "tavg_interval_sum_sq", "avg_kwh_for_cust_for_current_month"])


# ---------------------------------------------------------------- cross-validation folds of the notebook's train split
_ROW_KEY = " || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in ("account_id", "from_dt", "to_dt", "kwh"))
_BUCKET = "CAST(('0x' || substr(md5('{seed}:' || " + _ROW_KEY + "), 1, 8)) AS BIGINT)"
frag("cvr", ("clean1",), f"""
SELECT CAST({_BUCKET.format(seed=30)} % 5 AS INTEGER) AS fold, CAST(COALESCE(tavg_interval_avg, 0) AS DOUBLE) AS x,
       CAST(COALESCE(avg_kwh_day_over_invoice, 0) AS DOUBLE) AS y
FROM clean1 WHERE {_BUCKET.format(seed=42)} % 1000 < 666""")


# ---------------------------------------------------------------- one full regression tree per group
def trees(rows: str, n_features: int, keep: str, *names: str) -> str:
    """Leaf mean of every test row: ``rows`` has (g, test, y, x, keep...), x a list of doubles.

    A node is split at the threshold of largest SL * SL / NL + SR * SR / NR, ties to the first
    feature, then to the smallest threshold; a node of one target or of equal inputs is a leaf.
    """
    node = "g, node"
    return sql("", *names).rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + f""",
rows_ AS ({rows}),
tree(it, g, test, y, x, {keep}, node) AS (
  SELECT 0, g, test, y, x, {keep}, '' FROM rows_
  UNION ALL
  SELECT it + 1, t.g, test, y, x, {keep}, t.node || CASE WHEN x[b.b.f] <= b.b.cut THEN '0' ELSE '1' END
  FROM tree t JOIN (
    SELECT {node}, arg_min({{'f': f, 'cut': (v + nv) / 2}}, {{'s': -(ly * ly / lw + (sy - ly) * (sy - ly) / (sw - lw)), 'f': f, 'v': v}}) AS b
    FROM (SELECT {node}, f, v, sum(w) OVER up AS lw, sum(wy) OVER up AS ly, lead(v) OVER up AS nv,
                 sum(w) OVER (PARTITION BY {node}, f) AS sw, sum(wy) OVER (PARTITION BY {node}, f) AS sy
          FROM (SELECT {node}, f, x[f] AS v, CAST(count(*) AS DOUBLE) AS w, CAST(sum(y) AS DOUBLE) AS wy
                FROM tree, (SELECT CAST(range + 1 AS INTEGER) AS f FROM range({n_features})) WHERE NOT test GROUP BY {node}, f, x[f]) c
          WINDOW up AS (PARTITION BY {node}, f ORDER BY v)) r
    WHERE nv IS NOT NULL AND (g, node) IN (SELECT (g, node) FROM tree WHERE NOT test GROUP BY {node} HAVING min(y) < max(y))
    GROUP BY {node}) b ON b.g = t.g AND b.node = t.node),
leaf AS (SELECT g, node, avg(y) AS mean FROM tree WHERE NOT test GROUP BY g, node)
SELECT {keep}, CAST(mean AS DECIMAL(18,6)) AS prediction FROM (
  SELECT *, max(it) OVER (PARTITION BY g, {keep}) AS last FROM tree WHERE test) t JOIN leaf USING (g, node) WHERE it = last"""


_WALK_X = "[" + ", ".join([f"CAST({c} AS DOUBLE)" for c in ("tavg_interval_sum", "prev_pd_kwh", "prev_prev_pd_kwh", "days_passed")]
                         + [f"CAST(month = {m} AS INTEGER)::DOUBLE" for m in range(1, 13)]) + "]"
WALK_TREE = trees(f"""
  SELECT a.account_id || ':' || (t.row_idx - t.init) AS g, a.row_idx = t.row_idx AS test, a.kwh AS y, {_WALK_X.replace("CAST(", "CAST(a.").replace("CAST(a.month", "CAST(a.month")} AS x,
         a.account_id, a.from_dt, a.to_dt, a.kwh, CAST(t.row_idx - t.init - 1 AS INTEGER) AS fold
  FROM cfeat a JOIN (SELECT account_id, row_idx, CAST(floor(n_rows * 0.8) AS INTEGER) AS init FROM cfeat) t
    ON a.account_id = t.account_id AND a.row_idx <= t.row_idx AND t.row_idx > t.init""", 16, "account_id, from_dt, to_dt, kwh, fold", "cfeat")

# months in the order of their text, as the encoder numbers its levels
_LEVELS = sorted(range(1, 13), key=str)
_SEEN = "(month IN (SELECT month FROM train_months))"
_POOLED_X = "[" + ", ".join(
    [f"CAST({c} AS DOUBLE)" for c in ("tavg_interval_sum", "prev_pd_kwh", "prev_prev_pd_kwh", "days_passed", "account_id", "avg_kwh")]
    + [f"CAST(month = {m} AND {_SEEN} AS INTEGER)::DOUBLE" for m in _LEVELS] + [f"CAST(NOT {_SEEN} AS INTEGER)::DOUBLE"]
    + [f"CASE WHEN month = {m} AND {_SEEN} THEN CAST(tavg_interval_sum AS DOUBLE) ELSE 0 END" for m in _LEVELS]) + "]"
POOLED_TREE = trees(f"SELECT 0 AS g, is_eval AS test, kwh AS y, {_POOLED_X} AS x, account_id, from_dt, to_dt, kwh FROM cfeat",
                    31, "account_id, from_dt, to_dt, kwh", "cfeat", "train_months")
