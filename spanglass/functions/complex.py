"""Complex numbers as struct<re:double, im:double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def of(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def plus(a: Column, b: Column) -> Column:
    return of(a["re"] + b["re"], a["im"] + b["im"])


def minus(a: Column, b: Column) -> Column:
    return of(a["re"] - b["re"], a["im"] - b["im"])


def times(a: Column, b: Column) -> Column:
    return of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def conj(a: Column) -> Column:
    return of(a["re"], -a["im"])


def norm(a: Column) -> Column:
    """Squared modulus."""
    return a["re"] * a["re"] + a["im"] * a["im"]


def over(a: Column, b: Column) -> Column:
    """Quotient; null where the divisor is zero."""
    n, d = times(a, conj(b)), norm(b)
    return F.when(d != 0, of(F.try_divide(n["re"], d), F.try_divide(n["im"], d)))


def modulus(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def phase(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def polar(amplitude: Column, angle: Column) -> Column:
    return of(amplitude * F.cos(angle), amplitude * F.sin(angle))
