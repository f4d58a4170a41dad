"""Baseline coordinates and phase centres: UVW turned from one field's tangent frame to another's."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanglass.functions.sky import C


def tangent_axes(ra: Column, dec: Column) -> tuple[list[Column], list[Column], list[Column]]:
    """Unit vectors of u (east), v (north) and w (towards the field) in equatorial coordinates."""
    east = [-F.sin(ra), F.cos(ra), F.lit(0.0)]
    north = [-F.sin(dec) * F.cos(ra), -F.sin(dec) * F.sin(ra), F.cos(dec)]
    field = [F.cos(dec) * F.cos(ra), F.cos(dec) * F.sin(ra), F.sin(dec)]
    return east, north, field


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def rotation(from_ra: Column, from_dec: Column, to_ra: Column, to_dec: Column) -> Column:
    """struct(m00 .. m22): row i of the new coordinates in the old ones; the identity for equal fields."""
    old, new = tangent_axes(from_ra, from_dec), tangent_axes(to_ra, to_dec)
    return F.struct(*(_dot(new[i], old[j]).alias(f"m{i}{j}") for i in range(3) for j in range(3)))


def reprojected(rows: DataFrame, fields: DataFrame, to: tuple[float, float], uvw: tuple[str, str, str] = ("u", "v", "w"), field: str = "field_id") -> DataFrame:
    """``rows`` with u, v, w in the tangent frame at ``to`` (J2000 right ascension and declination), and ``shift``.

    ``fields`` is (row_id, ra, dec), joined by row number; the rotation is computed once a field, not once a row.  ``shift`` is the path
    in metres by which the phase centre moved: the new w less the old.  Rows whose field is unknown have nulls.
    """
    at = fields.select(F.col("row_id").alias(field), rotation(F.col("ra"), F.col("dec"), F.lit(float(to[0])), F.lit(float(to[1]))).alias("__r"))
    d = rows.join(at, field, "left")
    u, v, w = (F.col(c) for c in uvw)
    new = [F.col(f"__r.m{i}0") * u + F.col(f"__r.m{i}1") * v + F.col(f"__r.m{i}2") * w for i in range(3)]
    kept = [F.col(c) for c in rows.columns if c not in uvw]
    return d.select(*kept, *(x.alias(c) for x, c in zip(new, uvw, strict=True)), (new[2] - w).alias("shift"))


def phase_shifted(vis: DataFrame, shift: str | Column = "shift", freq: str | Column = "freq") -> DataFrame:
    """Visibilities (re, im) turned by the path ``shift`` at each channel's frequency; a null path leaves null values."""
    path, f = (F.col(x) if isinstance(x, str) else x for x in (shift, freq))
    angle = -2 * math.pi / C * path * f
    re, im = F.col("re"), F.col("im")
    turned = {"re": re * F.cos("__angle") - im * F.sin("__angle"), "im": re * F.sin("__angle") + im * F.cos("__angle")}
    return vis.withColumn("__angle", angle).select(*(turned[c].alias(c) if c in turned else F.col(c) for c in vis.columns))


def baseline_uvw(x: Column, y: Column, z: Column, sidereal: Column, ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    """UVW of an earth-fixed baseline (metres) at a Greenwich sidereal time, towards a direction of date."""
    h = sidereal - ra
    u = F.sin(h) * x + F.cos(h) * y
    v = -F.sin(dec) * F.cos(h) * x + F.sin(dec) * F.sin(h) * y + F.cos(dec) * z
    w = F.cos(dec) * F.cos(h) * x - F.cos(dec) * F.sin(h) * y + F.sin(dec) * z
    return u, v, w
