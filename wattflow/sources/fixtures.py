"""Domain tables derived from the driver's TPC-H-like parquet tables.

The analytics work on four inputs (accounts, invoices, stations, weather) plus
load-curve points.  Real deployments read them from the warehouse; for tests
and benchmarks they are derived here from the driver's tables with integer
arithmetic only, so Spark and the DuckDB oracle (``plans.oracle``) build the
same rows.  The rules are documented in FIXTURES.md part 2.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattflow.sources.tables import read_table


@dataclass(frozen=True)
class Domain:
    accounts: DataFrame
    invoices: DataFrame
    stations: DataFrame
    weather: DataFrame


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_key, from_dt, to_dt, kwh -- one row per distinct invoice."""
    cust = read_table(spark, sf_dir, "customer", ["c_custkey"])
    orders = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])
    to_dt = F.to_date("o_orderdate")
    span = (F.lit(27) + F.col("c_custkey") % 4).cast("int")
    return (cust.join(orders, cust.c_custkey == orders.o_custkey, "inner")
            .select(F.col("c_custkey").alias("account_key"),
                    F.date_sub(to_dt, span).alias("from_dt"),
                    to_dt.alias("to_dt"),
                    F.floor(F.col("o_totalprice") / 100).cast("int").alias("kwh"))
            .distinct())


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with the attribute columns of FIXTURES.md part 1."""
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    k = F.col("c_custkey")
    return (cust.join(nation, cust.c_nationkey == nation.n_nationkey)
            .join(region, nation.n_regionkey == region.r_regionkey)
            .select(k.alias("account_id"),
                    k.alias("account_key"),
                    F.col("c_nationkey").alias("zip"),
                    F.lower("n_name").alias("city"),
                    F.col("r_name").alias("state"),
                    F.when(k % 5 == 0, F.lit(None).cast("string"))
                     .when(k % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("gender"),
                    F.when(k % 3 == 0, F.concat(F.lit("UNIT "), k.cast("string"))).alias("billing_address2"),
                    (F.col("c_nationkey") % 4).cast("int").alias("utility_id"),
                    F.col("c_mktsegment").alias("account_type"),
                    F.when(k % 7 != 0, (F.col("c_nationkey") * 1000 + k % 97).cast("int")).alias("county_fips"),
                    F.when(k % 11 != 0, F.concat(F.lit("R"), (k % 3).cast("string"))).alias("rate_class")))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zip, station_id, station_dist, station_rank -- the two nearest stations per zip."""
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    dist = F.col("n_nationkey") % 7
    first = nation.select(F.col("n_nationkey").alias("zip"),
                          F.col("n_regionkey").cast("string").alias("station_id"),
                          (dist + F.lit(0.25)).cast("decimal(4,2)").alias("station_dist"),
                          F.lit(1).alias("station_rank"))
    second = nation.select(F.col("n_nationkey").alias("zip"),
                           ((F.col("n_regionkey") + 1) % 5).cast("string").alias("station_id"),
                           (F.lit(5) + dist + F.lit(0.5)).cast("decimal(4,2)").alias("station_dist"),
                           F.lit(2).alias("station_rank"))
    return first.unionByName(second)


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station_id, ymd ('yyyyMMdd' text), tavg_raw (text, 'M' = missing)."""
    li = read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_quantity", "l_shipdate"])
    sup = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    daily = (li.join(sup, li.l_suppkey == sup.s_suppkey)
             .join(nation, sup.s_nationkey == nation.n_nationkey)
             .groupBy("n_regionkey", "l_shipdate")
             .agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("q")))
    month = F.month("l_shipdate")
    missing = (F.col("n") % 4 == 0) | ((F.col("n_regionkey") == 3) & month.isin(6, 7))
    value = (F.lit(75) - F.lit(6) * F.abs(F.lit(7) - month)
             + F.floor("q").cast("int") % 10)
    return daily.select(F.col("n_regionkey").cast("string").alias("station_id"),
                        F.date_format("l_shipdate", "yyyyMMdd").alias("ymd"),
                        F.when(missing, F.lit("M")).otherwise(value.cast("string")).alias("tavg_raw"))


def load_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, month, value -- monthly load observations (one per line item)."""
    li = read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_quantity", "l_shipdate"])
    return li.select(F.col("l_suppkey").alias("entity_id"),
                     F.month("l_shipdate").alias("month"),
                     F.col("l_quantity").alias("value"))


def domain(spark: SparkSession, sf_dir: str) -> Domain:
    return Domain(accounts(spark, sf_dir), invoices(spark, sf_dir),
                  stations(spark, sf_dir), weather(spark, sf_dir))
