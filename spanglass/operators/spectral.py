"""Spectral axes: channels of moving frames brought to one axis of output channels.

Visibilities are in long form with ``freq`` and ``width`` of each channel.  An output axis is uniform: channel k lies at ``first + k * step``, so
the channels that a moved one reaches are arithmetic and no range join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("overlap", "nearest", "linear", "cubic")


def output_channels(windows: DataFrame, start: int, width: int, n: int, keys: list[str] | None = None) -> DataFrame:
    """(keys.., chan, freq, width) of ``n`` output channels, each of ``width`` neighbouring channels of a window from ``start`` on.

    ``windows`` is (keys.., chan, freq, width), a row a channel.  A negative ``width`` counts down.  The
    centre is that of the outer edges.  Channels beyond a window raise an error.
    """
    if width == 0 or n < 1:
        raise ValueError("width must not be 0, and one channel at least is needed")
    keys = keys or []
    up = abs(width)
    place = (F.col("chan") - start) if width > 0 else (start - F.col("chan"))
    inside = windows.withColumn("__k", F.floor(place / up).cast("int")).filter(F.col("__k").between(0, n - 1))
    edge = F.abs("width") / 2
    bins = inside.groupBy(*keys, "__k").agg(F.min(F.col("freq") - edge).alias("__low"), F.max(F.col("freq") + edge).alias("__high"), F.count(F.lit(1)).alias("__n"))
    groups = windows.select(*keys).distinct().count() if keys else 1
    if bins.filter(F.col("__n") == up).count() != n * groups:
        raise ValueError(f"channels from {start}, {n} times {width}, go beyond a window")
    return bins.select(*keys, F.col("__k").alias("chan"), ((F.col("__low") + F.col("__high")) / 2).alias("freq"), (F.col("__high") - F.col("__low")).alias("width"))


def moved(vis: DataFrame, factor: Column) -> DataFrame:
    """Frequencies and widths times a frame's factor (``functions.earth.frame_factor``), each row by its own."""
    return vis.withColumn("__f", factor).withColumn("freq", F.col("freq") * F.col("__f")).withColumn("width", F.abs(F.col("width") * F.col("__f"))).drop("__f")


def on_axis(vis: DataFrame, keys: list[str], first: float, step: float, n: int, how: str = "overlap") -> DataFrame:
    """(keys.., chan, re, im, flag, weight): spectra on the output axis ``first + k * step``, k from 0 to n - 1.

    * ``overlap``: means weighted by ``weight`` and the share of each channel that lies in the output channel; of unflagged data, or of all if all is flagged.
    * ``nearest``: every channel goes to the output channel that its centre lies in; else as overlap.
    * ``linear``: between the two neighbouring channels of a spectrum (``keys`` tell spectra apart), flagged if one of them is.
    * ``cubic``: through two neighbours on each side; linear in a spectrum's first and last gap.

    Output channels that nothing reaches have no row.  A spectrum of one channel gives its value to the centres within its width.
    Channels without a frequency are left out.
    """
    if how not in MODES:
        raise ValueError(f"one of {MODES}")
    if step == 0 or n < 1:
        raise ValueError("step must not be 0, and one channel at least is needed")
    d = vis.filter("freq IS NOT NULL").withColumn("__p", (F.col("freq") - first) / step)
    return _averaged(d, keys, step, n, how) if how in ("overlap", "nearest") else _between(d, keys, step, n, how == "cubic")


def _averaged(d: DataFrame, keys: list[str], step: float, n: int, how: str) -> DataFrame:
    if how == "nearest":
        reached = d.withColumn("__k", F.floor(F.col("__p") + 0.5).cast("int")).filter(F.col("__k").between(0, n - 1)).withColumn("__share", F.lit(1.0))
    else:
        half = F.abs(F.col("width") / step) / 2
        low, high = F.col("__p") - half + 0.5, F.col("__p") + half + 0.5  # channel k spans k .. k + 1
        begin, end = F.greatest(F.floor(low), F.lit(0)).cast("int"), F.least(F.ceil(high) - 1, F.lit(n - 1)).cast("int")
        d = d.withColumn("__low", low).withColumn("__high", high).filter((F.col("__high") > F.col("__low")) & (end >= begin))
        reached = d.withColumn("__k", F.explode(F.sequence(begin, end)))
        inside = F.least(F.col("__high"), F.col("__k") + 1) - F.greatest(F.col("__low"), F.col("__k").cast("double"))
        reached = reached.withColumn("__share", inside / (F.col("__high") - F.col("__low"))).filter("__share > 0")
    w = F.col("weight") * F.col("__share")
    good = ~F.col("flag")

    def mean(c: str) -> Column:
        of = lambda v: F.try_divide(F.sum(v * F.col(c)), F.sum(v))
        return F.coalesce(of(F.when(good, w)), of(w), F.avg(c)).alias(c)

    return reached.groupBy(*keys, F.col("__k").alias("chan")).agg(mean("re"), mean("im"), F.bool_and("flag").alias("flag"), F.coalesce(F.sum(F.when(good, w)), F.sum(w)).alias("weight"))


def _between(d: DataFrame, keys: list[str], step: float, n: int, cubic: bool) -> DataFrame:
    spectrum = Window.partitionBy(*keys).orderBy("__p")  # a spectrum's channels, some thousands at most
    here = F.struct("__p", "re", "im", "flag", "weight")
    d = d.withColumn("__b", F.lead(here).over(spectrum)).withColumn("__first", F.lag(F.lit(1)).over(spectrum).isNull())
    if cubic:
        d = d.withColumn("__0", F.lag(here).over(spectrum)).withColumn("__3", F.lead(here, 2).over(spectrum))
    p, q = F.col("__p"), F.col("__b.__p")
    reach = F.abs(F.col("width") / step) / 2
    single = F.col("__first") & F.col("__b").isNull()
    begin = F.when(single, F.ceil(p - reach)).otherwise(F.ceil(p))
    end = F.when(single, F.floor(p + reach)).when(F.col("__b").isNull(), F.floor(p)).otherwise(F.ceil(q) - 1)
    begin, end = F.greatest(begin, F.lit(0)).cast("int"), F.least(end, F.lit(n - 1)).cast("int")
    d = d.withColumn("__i", begin).withColumn("__j", end).filter("__j >= __i").withColumn("__k", F.explode(F.sequence("__i", "__j")))
    t = F.when(F.col("__b").isNull() | (q == p), 0.0).otherwise((F.col("__k") - p) / (q - p))
    d = d.withColumn("__t", t)
    t = F.col("__t")

    def line(c: str) -> Column:
        return F.col(c) + F.when(t > 0, t * (F.col(f"__b.{c}") - F.col(c))).otherwise(0.0)

    flag, value = F.col("flag") | F.when(t > 0, F.col("__b.flag")).otherwise(False), line
    if cubic:
        points = [F.col("__0.__p"), p, q, F.col("__3.__p")]
        names = ["__0.{}", "{}", "__b.{}", "__3.{}"]
        four = F.col("__0").isNotNull() & F.col("__3").isNotNull() & (t > 0)
        flag = flag | F.when(four, F.col("__0.flag") | F.col("__3.flag")).otherwise(False)

        def value(c: str) -> Column:
            total = F.lit(0.0)
            for i, name in enumerate(names):
                term = F.col(name.format(c))
                for j in range(4):
                    if j != i:
                        term = term * F.try_divide(F.col("__k") - points[j], points[i] - points[j])
                total = total + term
            return F.coalesce(F.when(four, total), line(c))

    return d.select(*keys, F.col("__k").alias("chan"), value("re").alias("re"), value("im").alias("im"), flag.alias("flag"), line("weight").alias("weight"))
