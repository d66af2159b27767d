"""Transverse Mercator on WGS84 by Krüger's series to the fourth order, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ellipsoid, the scale, and the series' coefficients.
_A, _F, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_N = _F / (2 - _F)
RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ALPHA = (
    _N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3 + 41 / 180 * _N**4,
    13 / 48 * _N**2 - 3 / 5 * _N**3 + 557 / 1440 * _N**4,
    61 / 240 * _N**3 - 103 / 140 * _N**4,
    49561 / 161280 * _N**4,
)
BETA = (
    _N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3 - 1 / 360 * _N**4,
    1 / 48 * _N**2 + 1 / 15 * _N**3 - 437 / 1440 * _N**4,
    17 / 480 * _N**3 - 37 / 840 * _N**4,
    4397 / 161280 * _N**4,
)
DELTA = (
    2 * _N - 2 / 3 * _N**2 - 2 * _N**3 + 116 / 45 * _N**4,
    7 / 3 * _N**2 - 8 / 5 * _N**3 - 227 / 45 * _N**4,
    56 / 15 * _N**3 - 136 / 35 * _N**4,
    4279 / 630 * _N**4,
)
ROOT = 2 * _N**0.5 / (1 + _N)


def zone_of(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6).cast("int") % 60) + 1


def forward(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing; the northing of southern places is from 10 000 km."""
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - ROOT * F.atanh(ROOT * s))
    east = F.radians(lon - (zone * 6 - 183))
    xi, eta = F.atan2(t, F.cos(east)), F.atanh(F.sin(east) / F.sqrt(1 + t * t))
    x = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1)), F.lit(0.0))
    y = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1)), F.lit(0.0))
    return EAST + SCALE * RADIUS * x, F.when(lat < 0, F.lit(SOUTH)).otherwise(F.lit(0.0)) + SCALE * RADIUS * y


def inverse(x: Column, y: Column, zone: Column, northern: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees."""
    xi = (y - F.when(northern, F.lit(0.0)).otherwise(F.lit(SOUTH))) / (SCALE * RADIUS)
    eta = (x - EAST) / (SCALE * RADIUS)
    xi1 = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(BETA, 1)), F.lit(0.0))
    eta1 = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(BETA, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(DELTA, 1)), F.lit(0.0))
    return F.degrees(lat), F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + (zone * 6 - 183)
