"""Streams of samples: the time averages of stored data, kept up as data arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_means(stream: DataFrame, time: str, value: str, by: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Mean, count and extremes of each window; a window is done once the watermark, ``late`` behind, passes it."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    d = stream.withWatermark(time, late).groupBy(*by, w.alias("w"))
    return d.agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "n", "low", "high")


def sessions(stream: DataFrame, time: str, by: list[str], gap: str, late: str) -> DataFrame:
    """Runs of samples with no gap over ``gap``."""
    d = stream.withWatermark(time, late).groupBy(*by, F.session_window(time, gap).alias("w"))
    return d.agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def clipped(stream: DataFrame, value: str, limit: Column) -> DataFrame:
    """Stateless flagging works on streams as it does on tables."""
    return stream.withColumn("flag", F.coalesce(F.abs(F.col(value)) > limit, F.lit(False)) | F.isnan(value))
