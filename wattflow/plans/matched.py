"""Path A: invoices to the published feature table (one station and two stations)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattflow.functions.dates import inclusive_days
from wattflow.functions.numeric import fixed_ratio, round_int
from wattflow.operators import invoices as inv_ops
from wattflow.operators import readings
from wattflow.operators import windows
from wattflow.plans.by_size import by_size, written
from wattflow.sources.fixtures import Domain


def invoices_nearest(d: Domain) -> DataFrame:
    """Distinct invoices with the nearest station (S9 table ``m``)."""
    return inv_ops.with_nearest_station(inv_ops.invoice_distinct(d.accounts, d.invoices), d.stations)


def invoices_paired(d: Domain) -> DataFrame:
    """Distinct invoices with both stations (S12 table ``m``)."""
    return inv_ops.with_station_pair(inv_ops.invoice_distinct(d.accounts, d.invoices), d.stations)


def invoice_weather_1(d: Domain) -> DataFrame:
    return readings.invoice_weather_one(invoices_nearest(d), d.weather)


def matched_table_1(d: Domain, bound: int | None = None) -> DataFrame:
    """S10's table: one-station statistics, window features and the month flag."""
    return by_size(d, lambda part, chunked: windows.feature_windows(
        written(invoice_weather_1(part), chunked), chunked=chunked), bound)


def station_preference(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Use station 2 where station 1 misses more than ``threshold`` of days.

    Both branches are explicit and there is no ``otherwise``: a null share
    leaves the preferred columns null, as the reference's two UPDATEs do.
    """
    first = F.col("perc_missing_1") <= threshold
    second = F.col("perc_missing_1") > threshold

    def pick(a, b):
        return F.when(first, F.col(a)).when(second, F.col(b))

    return df.withColumns({
        "station_id_preferred": pick("station_id_1", "station_id_2"),
        "station_dist_preferred": pick("station_dist_1", "station_dist_2"),
        "tavg_interval_avg_preferred": round_int(pick("tavg_interval_avg_1", "tavg_interval_avg_2")),
        "perc_missing_preferred": pick("perc_missing_1", "perc_missing_2"),
    })


def invoice_weather_2(d: Domain, count_null_as_missing: bool = False,
                      literal_attributes: bool = False) -> DataFrame:
    """Two-station statistics per invoice with customer attributes (S12 through stats_frame_2).

    The reduction runs before the attribute join (SURVEY 4), so attribute rows
    never multiply readings.
    """
    stats = readings.invoice_weather_two(invoices_paired(d), d.weather, count_null_as_missing,
                                         pairs=inv_ops.station_pairs(d.stations))
    attrs = inv_ops.account_attributes(d.accounts, literal_attributes)
    return stats.join(attrs, "account_id", "inner")


def matched_table_2(d: Domain, bound: int | None = None, **kw) -> DataFrame:
    """S12's table: two stations, preference, daily kWh, window features, flags."""
    return by_size(d, lambda part, chunked: _matched_two(part, chunked, **kw), bound)


def _matched_two(d: Domain, chunked: bool, **kw) -> DataFrame:
    df = station_preference(invoice_weather_2(d, **kw))
    df = df.withColumns({
        "avg_kwh_day_over_invoice": fixed_ratio(F.col("kwh"), inclusive_days("from_dt", "to_dt"), 6, 2),
        "todt_month": F.month("to_dt"),
        "todt_day": F.dayofmonth("to_dt"),
    })
    df = windows.feature_windows(written(df, chunked), chunked=chunked)
    return windows.attribute_flags(df)
