"""Invoice preparation: account join, distinct invoices, station joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattflow.functions.numeric import sum_cols

ATTRIBUTE_COLUMNS = ["city", "state", "gender", "billing_address2", "utility_id",
                     "account_type", "county_fips", "rate_class"]


def invoice_distinct(accounts: DataFrame, invoices: DataFrame) -> DataFrame:
    """account_id, zip, from_dt, to_dt, kwh: distinct invoices of known accounts.

    The distinct combines map-side and then hashes on all five columns, so
    one account with a large share of the invoices is still spread over many
    tasks (hashing on the account alone would put it in one).
    """
    a = accounts.select("account_id", "account_key", "zip")
    return (a.join(invoices, "account_key", "inner")
            .select("account_id", "zip", "from_dt", "to_dt", "kwh")
            .distinct())


def stations_of_rank(stations: DataFrame, rank: int, suffix: str = "") -> DataFrame:
    """Stations of one nearness rank, renamed with ``suffix`` (A3, B1)."""
    return (stations.where(F.col("station_rank") == rank)
            .select("zip", F.col("station_id").alias("station_id" + suffix),
                    F.col("station_dist").alias("station_dist" + suffix)))


def station_pairs(stations: DataFrame) -> DataFrame:
    """zip with its rank-1 and rank-2 station side by side."""
    return stations_of_rank(stations, 1, "_1").join(stations_of_rank(stations, 2, "_2"), "zip", "inner")


def with_nearest_station(inv: DataFrame, stations: DataFrame) -> DataFrame:
    """Invoices with their zip's nearest station.

    The station table has one row per postal code and rank; Spark broadcasts it
    when its size in bytes is below the session's threshold.
    """
    return inv.join(stations_of_rank(stations, 1), "zip", "inner")


def with_station_pair(inv: DataFrame, stations: DataFrame) -> DataFrame:
    return inv.join(station_pairs(stations), "zip", "inner")


def account_attributes(accounts: DataFrame, literal: bool = False) -> DataFrame:
    """Customer attributes with the city upper-cased.

    Default: one row per account, the one with the fewest missing attributes and
    of those the smallest, so joining it never multiplies invoices.  ``literal=True`` keeps every row, as the
    reference's non-distinct attribute table does (T7).
    """
    cols = [F.upper("city").alias("city"), "state", "gender", "billing_address2",
            "utility_id", "account_type", "county_fips", "rate_class"]
    a = accounts.select("account_id", *cols)
    if literal:
        return a
    missing = sum_cols([F.col(c).isNull().cast("int") for c in ATTRIBUTE_COLUMNS])
    picked = a.groupBy("account_id").agg(
        F.min(F.struct(missing.alias("_missing"), *ATTRIBUTE_COLUMNS)).alias("_a"))
    return picked.select("account_id", *[F.col("_a." + c).alias(c) for c in ATTRIBUTE_COLUMNS])
