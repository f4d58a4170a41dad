"""Angles, directions and frames, in radians unless named otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

C = 299_792_458.0
#: Rotation from J2000 to galactic coordinates (row by row), and the WGS84 ellipsoid.
GALACTIC = ((-0.0548755604162154, -0.8734370902348850, -0.4838350155487132), (0.4941094278755837, -0.4448296299600112, 0.7469822444972189), (-0.8676661490190047, -0.1980763734312015, 0.4559837761750669))
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563
OBLIQUITY = math.radians(23.4392911111)
ECLIPTIC = ((1.0, 0.0, 0.0), (0.0, math.cos(OBLIQUITY), math.sin(OBLIQUITY)), (0.0, -math.sin(OBLIQUITY), math.cos(OBLIQUITY)))


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Angular distance, accurate at all separations."""
    d = lon2 - lon1
    y = F.hypot(F.cos(lat2) * F.sin(d), F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(d))
    return F.atan2(y, F.sin(lat1) * F.sin(lat2) + F.cos(lat1) * F.cos(lat2) * F.cos(d))


def normalised(angle: Column) -> Column:
    """In [-pi, pi)."""
    return angle - 2 * math.pi * F.floor((angle + math.pi) / (2 * math.pi))


def in_cone(lon: Column, lat: Column, lon0: float, lat0: float, radius: float) -> Column:
    """Within a circle; the band in latitude is a plain range that reaches the scan."""
    return lat.between(lat0 - radius, lat0 + radius) & (distance(lon, lat, F.lit(lon0), F.lit(lat0)) <= radius)


def cosines(lon: Column, lat: Column) -> list[Column]:
    return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]


def rotated(lon: Column, lat: Column, matrix: tuple, inverse: bool = False) -> tuple[Column, Column]:
    """(longitude in [0, 2 pi), latitude) in another frame."""
    m = tuple(zip(*matrix, strict=True)) if inverse else matrix
    x, y, z = (sum((F.lit(k) * v for k, v in zip(row[1:], v3[1:], strict=True)), F.lit(row[0]) * v3[0]) for row in m for v3 in [cosines(lon, lat)])
    return F.pmod(F.atan2(y, x), F.lit(2 * math.pi)), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z)))


def galactic(lon: Column, lat: Column) -> tuple[Column, Column]:
    return rotated(lon, lat, GALACTIC)


def ecliptic(lon: Column, lat: Column) -> tuple[Column, Column]:
    return rotated(lon, lat, ECLIPTIC)


def itrf(lon: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
    """Geocentric metres of a WGS84 position."""
    e2 = WGS84_F * (2 - WGS84_F)
    n = WGS84_A / F.sqrt(1 - e2 * F.sin(lat) ** 2)
    return (n + height) * F.cos(lat) * F.cos(lon), (n + height) * F.cos(lat) * F.sin(lon), (n * (1 - e2) + height) * F.sin(lat)


def doppler(value: Column, source: str, to: str) -> Column:
    """Between radio, z (optical), ratio, beta (true) and gamma conventions, by way of the frequency ratio f / f0."""
    ratio = {"radio": 1 - value, "z": 1 / (1 + value), "ratio": value, "beta": F.sqrt((1 - value) / (1 + value)), "gamma": value - F.sqrt(value * value - 1)}[source]
    squared = ratio * ratio
    return {"radio": 1 - ratio, "z": 1 / ratio - 1, "ratio": ratio, "beta": (1 - squared) / (1 + squared), "gamma": (1 + squared) / (2 * ratio)}[to]


def hms(angle: Column) -> Column:
    """HHhMMmSS.mmm of an angle."""
    ms = F.round(F.pmod(angle, F.lit(2 * math.pi)) * (43_200_000 / math.pi)).cast("bigint")
    return F.format_string("%02dh%02dm%02d.%03d", F.floor(ms / 3_600_000) % 24, F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def dms(angle: Column) -> Column:
    """+DDD.MM.SS.mmm of an angle."""
    ms = F.round(F.abs(angle) * (648_000_000 / math.pi)).cast("bigint")
    mark = F.when(angle < 0, "-").otherwise("+")
    return F.format_string("%s%03d.%02d.%02d.%03d", mark, F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
