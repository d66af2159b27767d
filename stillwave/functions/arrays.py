"""Array kernels as Spark expressions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def demean(x: Column) -> Column:
    m = mean(x)
    return F.transform(x, lambda v: v - m)


def one_bit(x: Column) -> Column:
    """The sign of every sample; zero stays zero."""
    return F.transform(x, lambda v: F.signum(v))


def scaled(x: Column, by: float) -> Column:
    return F.transform(x, lambda v: v * F.lit(by))


def zero_pad(x: Column, before: int, after: int) -> Column:
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    return F.concat(zeros(before), x, zeros(after))


def cosine_taper(x: Column, share: float) -> Column:
    """A half cosine over ``share`` of the length at either end."""
    n = F.size(x)
    width = F.greatest(F.floor(n * F.lit(share)).cast("int"), F.lit(1))

    def weighed(v: Column, i: Column) -> Column:
        edge = F.least(i, n - 1 - i)
        return v * F.when(edge >= width, F.lit(1.0)).otherwise(0.5 * (1 - F.cos(F.lit(3.141592653589793) * edge / width)))

    return F.transform(x, weighed)


def windows(x: Column, length: int, step: int) -> Column:
    """Whole windows only."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(x) - F.lit(length), F.lit(0)), F.lit(step))
    return F.when(F.size(x) >= length, F.transform(starts, lambda i: F.slice(x, i + 1, length))).otherwise(F.array().cast("array<array<double>>"))


def cross_correlation(a: Column, b: Column, max_lag: int, normalise: bool = False) -> Column:
    """Sums of a(i + lag) b(i) for lags from -max_lag to max_lag; with ``normalise`` over
    the root of both energies, 0 where that is 0. For short arrays: the work is the product
    of length and lags."""
    n = F.size(a)
    lags = F.sequence(F.lit(-max_lag), F.lit(max_lag))

    def at(lag: Column) -> Column:
        first = F.slice(a, F.greatest(lag, F.lit(0)) + 1, F.greatest(n - F.abs(lag), F.lit(0)))
        second = F.slice(b, F.greatest(-lag, F.lit(0)) + 1, F.greatest(n - F.abs(lag), F.lit(0)))
        return total(F.zip_with(first, second, lambda u, v: u * v))

    out = F.transform(lags, at)
    if not normalise:
        return out
    energy = F.sqrt(total(F.transform(a, lambda v: v * v)) * total(F.transform(b, lambda v: v * v)))
    return F.transform(out, lambda v: F.when(energy > 0, v / energy).otherwise(F.lit(0.0)))


def combine(parts: list[tuple[Column, Column]]) -> Column:
    """A linear combination of equally long arrays."""
    (w0, x0), *rest = parts
    out = F.transform(x0, _times(w0))
    for w, x in rest:
        out = F.zip_with(out, F.transform(x, _times(w)), lambda a, b: a + b)
    return out


def _times(w: Column):
    return lambda v: v * w


def rotate(code: str, ee: Column, en: Column, ne: Column, nn: Column, back: Column) -> Column:
    """Radial and transverse correlations of two horizontal pairs; ``back`` is the
    backazimuth in degrees at the first station, and the second is seen from there."""
    s, c = F.sin(F.radians(back)), F.cos(F.radians(back))
    weights = {
        "RR": (s * s, s * c, s * c, c * c),
        "TT": (c * c, -(s * c), -(s * c), s * s),
        "RT": (-(s * c), s * s, -(c * c), s * c),
        "TR": (-(s * c), -(c * c), s * s, s * c),
    }[code]
    return combine([(w, x) for w, x in zip(weights, (ee, en, ne, nn), strict=True)])


def rotate_vertical(code: str, e: Column, n: Column, back: Column) -> Column:
    """Correlations of one horizontal pair with a vertical: RZ and ZR, TZ and ZT."""
    s, c = F.sin(F.radians(back)), F.cos(F.radians(back))
    return combine([(-s, e), (-c, n)] if "R" in code else [(-c, e), (s, n)])


def elementwise_mean(x: Column, length: int) -> list[Column]:
    """Aggregates of an array column's places, one by one; for a known, short length."""
    return [F.avg(F.element_at(x, i + 1)) for i in range(length)]
