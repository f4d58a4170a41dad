"""Modified Julian dates: doubles that count days since 1858-11-17."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1858-11-17"
SECONDS = 86_400.0


def date_of(mjd: Column) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), F.floor(mjd).cast("int"))


def mjd_of(timestamp: Column) -> Column:
    """From a timestamp without zone; exact to the microsecond."""
    t = timestamp.cast("timestamp_ntz")
    days = F.datediff(t.cast("date"), F.lit(EPOCH).cast("date"))
    return days + (F.hour(t) * 3600 + F.minute(t) * 60 + F.extract(F.lit("second"), t).cast("double")) / SECONDS


def time_of(mjd: Column) -> Column:
    """Fraction of the day."""
    return mjd - F.floor(mjd)


def year(mjd: Column) -> Column:
    return F.year(date_of(mjd))


def month(mjd: Column) -> Column:
    return F.month(date_of(mjd))


def day(mjd: Column) -> Column:
    return F.dayofmonth(date_of(mjd))


def weekday(mjd: Column) -> Column:
    """0 on Mondays."""
    return F.weekday(date_of(mjd))


def week(mjd: Column) -> Column:
    """Weeks of seven days from January 1st, not ISO weeks."""
    return F.ceil(F.dayofyear(date_of(mjd)) / 7).cast("int")


def month_name(mjd: Column) -> Column:
    """Three letters."""
    return F.date_format(date_of(mjd), "MMM")


def weekday_name(mjd: Column) -> Column:
    return F.date_format(date_of(mjd), "EEE")


def mjd_of_text(text: Column, pattern: str = "yyyy/MM/dd") -> Column:
    """From a date as text; null where it is none."""
    return mjd_of(F.try_to_timestamp(text, F.lit(pattern)))


def date_text(mjd: Column) -> Column:
    return F.date_format(date_of(mjd), "yyyy/MM/dd")


def time_text(mjd: Column) -> Column:
    """HH:MM:SS.mmm"""
    ms = F.round(time_of(mjd) * 86_400_000).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def tai_of_utc(mjd: Column, leaps: list[tuple[float, int]]) -> Column:
    """Atomic time; ``leaps`` are (first day, TAI - UTC in seconds), in order."""
    offset = F.lit(0)
    for first, seconds in leaps:
        offset = F.when(mjd >= first, F.lit(seconds)).otherwise(offset)
    return mjd + offset / SECONDS


def buckets(time: Column, first: Column, width: float, eps: float = 1e-6) -> Column:
    """Number of the averaging interval that a time falls in, counted from the scope's first time."""
    return F.floor((time - first + eps) / width).cast("bigint")
