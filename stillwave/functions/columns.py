"""Column expressions: null-safe comparison, overlap, date parts, geometry, units."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the Earth in kilometres.
EARTH_KM = 6371.0

_COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}


def compare_null_safe(a: Column, b: Column, op: str, policy: bool) -> Column:
    """``a op b``; ``policy`` where either side is null or NaN. Spark ranks NaN above all
    numbers and equal to itself, so it has to be asked for."""
    missing = a.isNull() | b.isNull() | F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
    return F.coalesce(F.when(missing, F.lit(policy)).otherwise(_COMPARE[op](a, b)), F.lit(policy))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two periods overlap; both ends are inclusive, so touching periods do."""
    return (a_start <= b_end) & (b_start <= a_end)


def same_day(start: Column, end: Column) -> Column:
    """Whether a half-open period [start, end) lies within one day."""
    return F.to_date(start) == F.to_date(end - F.expr("interval 1 microsecond"))


def date_parts(ts: Column) -> dict[str, Column]:
    return {
        "year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts),
        "doy": F.dayofyear(ts), "isoweekday": F.weekday(ts) + 1,
    }


def component_letter(channel: Column) -> Column:
    """The last character of a channel code."""
    return F.right(channel, F.lit(1))


def arc_radians(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Central angle of two points, by the spherical law of cosines."""
    a, b = F.radians(lat_a), F.radians(lat_b)
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon_b - lon_a))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def bearing(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Degrees clockwise from north from a to b, 0 to 360."""
    a, b, d = F.radians(lat_a), F.radians(lat_b), F.radians(lon_b - lon_a)
    y, x = F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def is_east_of(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Whether a lies east of b; of points on one meridian the northern one counts."""
    return (lon_a > lon_b) | ((lon_a == lon_b) & (lat_a > lat_b))


def slowness(x: Column, y: Column) -> Column:
    return F.hypot(x, y)


def azimuth(x: Column, y: Column) -> Column:
    return F.degrees(F.atan2(x, y))


def backazimuth(x: Column, y: Column) -> Column:
    """180 degrees less the azimuth's negative remainder; Spark's ``%`` has the sign of the
    dividend, so the remainder is spelled out."""
    return 180.0 - F.pmod(-azimuth(x, y), F.lit(360.0))


def decibel(x: Column) -> Column:
    return 10.0 * F.log10(x)


def lags(samples: int, rate: float) -> Column:
    """Lag times from -samples to samples, by index, so no end is lost to rounding."""
    return F.transform(F.sequence(F.lit(-samples), F.lit(samples)), lambda i: i / F.lit(rate))


def next_power_exponent(n: Column) -> Column:
    """The exponent of the next power of two."""
    return F.ceil(F.log2(n)).cast("int")


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def rounded_product(x: Column, digits: int) -> Column:
    """:func:`rounded` for doubles by way of the product with a power of ten, as SQL engines round. The
    two differ where that product is rounded to a half, and the number's decimal is under it."""
    scale = F.lit(10.0**digits)
    return F.when(F.abs(x) < 1e290, F.round(x * scale) / scale).otherwise(x) + F.lit(0.0)
