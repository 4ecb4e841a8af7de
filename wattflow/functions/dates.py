"""Date and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ymd_to_iso(ymd) -> Column:
    """'yyyyMMdd' text -> 'yyyy-MM-dd' text (H1)."""
    s = _c(ymd)
    return F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, 2), F.lit("-"),
                    F.substring(s, 7, 2))


def ymd_to_date(ymd) -> Column:
    """'yyyyMMdd' text -> date; malformed text becomes null (H1/H2)."""
    return F.try_to_date(_c(ymd), "yyyyMMdd")


def date_to_ymd_int(d) -> Column:
    """date -> yyyymmdd as int."""
    return F.date_format(_c(d), "yyyyMMdd").cast("int")


def inclusive_days(from_dt, to_dt) -> Column:
    """Days in [from, to], both ends counted (H3 + 1)."""
    return F.datediff(_c(to_dt), _c(from_dt)) + 1


def day_sequence(from_dt, to_dt) -> Column:
    """Every date in [from, to]."""
    return F.sequence(_c(from_dt), _c(to_dt), F.expr("interval 1 day"))
