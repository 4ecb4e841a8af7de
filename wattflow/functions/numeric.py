"""Numeric expressions: sentinel handling, fixed decimals, rounding, errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the text the weather feed uses for a missing daily reading.
MISSING_SENTINEL = "M"

# Readings are carried as exact decimals so interval sums built from prefix
# differences are exact whatever the input precision.
READING_TYPE = "decimal(18,3)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reading_zero(raw) -> Column:
    """Sentinel counted as 0, other text parsed; bad text -> null (H7)."""
    r = _c(raw)
    return (F.when(r == MISSING_SENTINEL, F.lit(0).cast(READING_TYPE))
            .otherwise(r.try_cast(READING_TYPE)))


def reading_skip(raw) -> Column:
    """Text -> number with the sentinel and bad text as null (H8)."""
    return _c(raw).try_cast(READING_TYPE)


def is_missing(raw) -> Column:
    return _c(raw) == MISSING_SENTINEL


def round_int(x) -> Column:
    """Round half away from zero, then int (T3: stated rule for int columns)."""
    return F.round(_c(x), 0).cast("int")


def fixed_ratio(num, den, precision: int, scale: int) -> Column:
    """num / den in decimal(precision, scale), null on overflow or a zero denominator (H4, T5)."""
    q = F.try_divide(_c(num).cast("decimal(18,0)"), _c(den).cast("decimal(18,0)"))
    return q.try_cast(f"decimal({precision},{scale})")


def dec4(x, precision: int = 18) -> Column:
    """A double or decimal reported at 4 places."""
    return _c(x).try_cast(f"decimal({precision},4)")


def mean4(total, count, scale: int = 0) -> Column:
    """total / count as an exact decimal rounded once, half up, to 4 places.

    Totals of up to 20 digits and any long count fit; Spark's decimal division
    then keeps at least 13 fractional digits before the final rounding.
    """
    q = F.try_divide(_c(total).cast(f"decimal(20,{scale})"), _c(count).cast("decimal(20,0)"))
    return dec4(q)


def null_flag(c) -> Column:
    """1 when present, 0 when null (H9)."""
    return _c(c).isNotNull().cast("int")


def square(c) -> Column:
    """H12."""
    return _c(c) * _c(c)


def sum_cols(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def argmin_label(values: list[Column], labels: list) -> Column:
    """Label of the smallest value, ties to the smallest label."""
    pairs = [F.struct(v.alias("d"), F.lit(lab).alias("label")) for v, lab in zip(values, labels)]
    return F.array_min(F.array(*pairs)).getField("label")
