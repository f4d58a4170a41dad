"""Averaging and flagging of visibilities in long form: one row for each (row, corr, chan), with re, im, flag, weight."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanglass.operators import polynomials
from spanglass.sources.tables import scratch

TASK_ROWS = 250_000  # of a task that sums intervals: some 100 MB


def channel_average(vis: DataFrame, width: int, keys: list[str]) -> DataFrame:
    """Means over ``width`` neighbouring channels: of unflagged data, or of all if all is flagged; flags are ANDed.

    Weights add; sigma (where present) combines as 1 / sqrt(sum of 1 / sigma^2).
    """
    good = ~F.col("flag")
    mean = lambda c: F.coalesce(F.avg(F.when(good, F.col(c))), F.avg(c)).alias(c)
    aggs = [mean("re"), mean("im"), F.bool_and("flag").alias("flag"), F.coalesce(F.nullif(F.sum(F.when(good, F.col("weight"))), F.lit(0.0)), F.sum("weight")).alias("weight")]
    if "sigma" in vis.columns:
        part = F.try_divide(F.lit(1.0), F.col("sigma") * F.col("sigma"))  # a sigma of zero says nothing
        aggs.append(F.coalesce(F.try_divide(F.lit(1.0), F.sqrt(F.coalesce(F.sum(F.when(good, part)), F.sum(part)))), F.lit(0.0)).alias("sigma"))
    return vis.groupBy(*keys, F.floor(F.col("chan") / width).cast("int").alias("chan")).agg(*aggs)


def time_average(vis: DataFrame, seconds: float, scope: list[str], keys: list[str], scalar: bool = False) -> DataFrame:
    """Weighted means over intervals counted from each scope's first time; the time is the interval's middle.

    Vector averages are of the complex values, scalar ones of amplitude (mean) and phase (circular mean).  Without a
    positive sum of weights the mean is unweighted.  The flag is set if any part is flagged.
    """
    # The first time of each scope is a small aggregate, joined back; a window would gather a scope in one task.
    first = vis.groupBy(*scope).agg(F.min("time").alias("__t0"))
    # Intervals may be as many as rows, and a table of sums grows in memory until it has all of a task's: tasks get as many rows however large the input.
    parts = int(min(max(-(-vis.count() // TASK_ROWS), 1), 20_000))
    dealt = vis.repartition(parts, *scope) if parts > int(vis.sparkSession.conf.get("spark.sql.shuffle.partitions")) else vis
    d = dealt.join(first, scope).withColumn("bucket", F.floor((F.col("time") - F.col("__t0") + 1e-6) / seconds).cast("bigint"))

    def mean(x: Column) -> Column:
        w = F.col("weight")
        return F.when(F.sum(w) > 0, F.try_divide(F.sum(w * x), F.sum(w))).otherwise(F.avg(x))

    flag = F.bool_or("flag").alias("flag")
    middle = ((F.min("time") + F.max("time")) / 2).alias("time")
    if scalar:
        a = F.hypot("re", "im")
        phase = F.atan2(mean(F.when(a > 0, F.try_divide(F.col("im"), a)).otherwise(0.0)), mean(F.when(a > 0, F.try_divide(F.col("re"), a)).otherwise(0.0)))
        values = [mean(a).alias("amplitude"), phase.alias("phase")]
    else:
        values = [mean(F.col("re")).alias("re"), mean(F.col("im")).alias("im")]
    return d.repartition(parts, *scope, *keys, "bucket").groupBy(*scope, *keys, "bucket").agg(middle, *values, flag, F.sum("weight").alias("weight"))


# ---- flagging


def clip_zeros(vis: DataFrame, eps: float = 1e-30) -> DataFrame:
    bad = F.isnan("re") | F.isnan("im") | (F.col("re") ** 2 + F.col("im") ** 2 <= eps * eps)
    return vis.withColumn("flag", F.col("flag") | bad)


def flag_where(vis: DataFrame, where: Column, value: bool = True) -> DataFrame:
    """Set or clear flags of selected data."""
    return vis.withColumn("flag", F.when(F.coalesce(where, F.lit(False)), F.lit(value)).otherwise(F.col("flag")))


def quack(main: DataFrame, seconds: float, end: bool = False, scan: list[str] | None = None) -> DataFrame:
    """Flag the first (or last) seconds of each scan, by a joined aggregate of the scan's times."""
    scan = scan or ["observation_id", "array_id", "scan_number"]
    edge = main.groupBy(*scan).agg((F.max("time") if end else F.min("time")).alias("__edge"))
    inside = F.col("__edge") - F.col("time") < seconds if end else F.col("time") - F.col("__edge") < seconds
    return main.join(edge, scan).withColumn("flag_row", F.col("flag_row") | inside).select(*main.columns)


def rflag_time(vis: DataFrame, group: list[str], series: list[str], scale: float = 5.0) -> DataFrame:
    """Flag values whose three-sample standard deviation in time exceeds the group's threshold.

    The threshold is scale * (median + 1.4826 * MAD) of the deviations, over the channels' means in the group.
    """
    w = Window.partitionBy(*series, "chan").orderBy("time").rowsBetween(-1, 1)
    sd = lambda c: F.stddev_pop(F.when(~F.col("flag"), F.col(c))).over(w)
    # Written once, as thresholds and flags both need it and the windows are what costs.
    d = scratch(vis.withColumn("__sd", F.hypot(F.coalesce(sd("re"), F.lit(0.0)), F.coalesce(sd("im"), F.lit(0.0)))), "deviations")
    means = d.filter(~F.col("flag")).groupBy(*group, "chan").agg(F.avg("__sd").alias("m"))
    mid = means.groupBy(*group).agg(F.median("m").alias("__mid"))
    mad = means.join(mid, group).groupBy(*group).agg(F.first("__mid").alias("__mid"), F.median(F.abs(F.col("m") - F.col("__mid"))).alias("__mad"))
    limit = mad.select(*group, (scale * (F.col("__mid") + 1.4826 * F.col("__mad"))).alias("__limit"))
    out = d.join(limit, group, "left").withColumn("flag", F.col("flag") | F.coalesce(F.col("__sd") > F.col("__limit"), F.lit(False)))
    return out.select(*vis.columns)


def rflag_spectral(vis: DataFrame, group: list[str], row: list[str], scale: float = 5.0, low: float = 0.0, high: float = 1e6) -> DataFrame:
    """Flag values far from the median of their spectrum (``row`` tells spectra apart), in the real or the imaginary part.

    The threshold is scale * (median + 1.4826 * MAD), over a group's channels, of their mean absolute distances.  A spectrum whose
    spread (1.4826 * median of the distances) is above ``high`` or below ``low`` is flagged whole.
    """
    good = lambda c: F.when(~F.col("flag"), c)
    middle = vis.groupBy(*row).agg(F.median(good(F.col("re"))).alias("__mr"), F.median(good(F.col("im"))).alias("__mi"))  # a spectrum's channels
    d = vis.join(middle, row).withColumn("__dr", good(F.abs(F.col("re") - F.col("__mr")))).withColumn("__di", good(F.abs(F.col("im") - F.col("__mi"))))
    d = scratch(d, "distances")
    spread = d.groupBy(*row).agg((1.4826 * F.median("__dr")).alias("__sr"), (1.4826 * F.median("__di")).alias("__si"))
    outside = F.coalesce((F.col("__sr") > high) | (F.col("__si") > high) | (F.col("__sr") < low) | (F.col("__si") < low), F.lit(False))
    means = d.filter(~F.col("flag")).select(*group, "chan", F.explode(F.array("__dr", "__di")).alias("__d")).groupBy(*group, "chan").agg(F.avg("__d").alias("m"))
    mid = means.groupBy(*group).agg(F.median("m").alias("__mid"))
    limit = means.join(mid, group).groupBy(*group, "__mid").agg(F.median(F.abs(F.col("m") - F.col("__mid"))).alias("__mad")).select(*group, (scale * (F.col("__mid") + 1.4826 * F.col("__mad"))).alias("__limit"))
    out = d.join(spread.select(*row, outside.alias("__whole")), row, "left").join(limit, group, "left")
    far = F.coalesce((F.col("__dr") > F.col("__limit")) | (F.col("__di") > F.col("__limit")), F.lit(False))
    return out.withColumn("flag", F.col("flag") | F.coalesce("__whole", F.lit(False)) | far).select(*vis.columns)


def _fit_outliers(y: np.ndarray, bad: np.ndarray, degree: int, cutoff: float, rounds: int = 5) -> np.ndarray:
    """Clip around a polynomial fit, again and again."""
    x = np.linspace(-1, 1, len(y))
    for _ in range(rounds):
        good = ~bad
        if good.sum() <= degree + 1:
            break
        ratio = y / np.where((fit := np.polyval(np.polyfit(x[good], y[good], degree), x)) != 0, fit, np.nan)
        spread = np.nanstd(ratio[good])
        new = bad | (np.abs(ratio - 1) > cutoff * spread) if spread > 0 else bad
        if (new == bad).all():
            break
        bad = new
    return bad


def tfcrop(vis: DataFrame, group: list[str], freq_cutoff: float = 3.0, time_cutoff: float = 4.0, degree: int = 3) -> DataFrame:
    """Flag outliers from smooth fits of amplitude, along frequency and then along time, in each group.

    A group is one baseline's, correlation's and scan's time-frequency plane, bounded by the observation's set-up.
    """
    schema = vis.schema

    def clip(plane: pd.DataFrame) -> pd.DataFrame:
        amp = np.hypot(plane["re"], plane["im"])
        grid = plane.assign(amp=amp).pivot_table(index="time", columns="chan", values="amp")
        flags = plane.pivot_table(index="time", columns="chan", values="flag", aggfunc="max").reindex_like(grid).fillna(True).to_numpy(bool)
        values = grid.to_numpy()
        for i in range(len(values)):
            flags[i] = _fit_outliers(np.nan_to_num(values[i]), flags[i], degree, freq_cutoff)
        for j in range(values.shape[1]):
            flags[:, j] = _fit_outliers(np.nan_to_num(values[:, j]), flags[:, j], 1, time_cutoff)
        at = grid.index.get_indexer(plane["time"]), grid.columns.get_indexer(plane["chan"])
        return plane.assign(flag=plane["flag"].to_numpy(bool) | flags[at])

    return vis.groupBy(*group).applyInPandas(clip, schema)


def extended(vis: DataFrame, rows: list[str], grow_time: float = 0.5, grow_freq: float = 0.5, series: list[str] | None = None) -> DataFrame:
    """Extend flags over polarisations, and over a time's channels or a channel's times where more than a share is flagged."""
    d = vis.withColumn("flag", F.max(F.col("flag")).over(Window.partitionBy(*rows, "chan")))
    d = d.withColumn("flag", F.col("flag") | (F.avg(F.col("flag").cast("double")).over(Window.partitionBy(*rows, "corr")) > grow_freq))
    if series:
        d = d.withColumn("flag", F.col("flag") | (F.avg(F.col("flag").cast("double")).over(Window.partitionBy(*series, "corr", "chan")) > grow_time))
    return d


def flag_summary(vis: DataFrame, keys: list[str]) -> DataFrame:
    return vis.groupBy(*keys).agg(F.count_if("flag").alias("flagged"), F.count(F.lit(1)).alias("total"))


def with_version(vis: DataFrame, version: DataFrame, keys: list[str], how: str = "replace") -> DataFrame:
    """Restore a saved flag version (keys, flag): replace, or OR or AND with the present flags."""
    saved = F.coalesce(F.col("__saved"), F.lit(False))
    new = {"replace": saved, "or": F.col("flag") | saved, "and": F.col("flag") & saved}[how]
    return vis.join(version.select(*keys, F.col("flag").alias("__saved")), keys, "left").withColumn("flag", new).select(*vis.columns)


# ---- summaries and splits


def scan_summary(main: DataFrame, keys: list[str], scan: str = "scan_number") -> DataFrame:
    """listobs: of each scan its time range, rows, unflagged share, baselines and mean interval."""
    return main.groupBy(*keys, scan).agg(F.min("time").alias("begin"), F.max("time").alias("end"), F.count(F.lit(1)).alias("n_rows"), F.avg((~F.col("flag_row")).cast("double")).alias("unflagged"), F.count_distinct("antenna1", "antenna2").alias("n_baselines"), F.avg("interval").alias("interval"))


def averaged_over(vis: DataFrame, keys: list[str], scalar: bool = False) -> DataFrame:
    """Weighted means over everything but ``keys`` (field, baseline, antenna or window): vector, or scalar (of amplitudes)."""
    w = F.when(~F.col("flag"), F.col("weight")).otherwise(0.0)
    mean = lambda x: F.coalesce(F.try_divide(F.sum(w * x), F.sum(w)), F.avg(x))
    values = [mean(F.hypot("re", "im")).alias("amplitude")] if scalar else [mean(F.col("re")).alias("re"), mean(F.col("im")).alias("im")]
    return vis.groupBy(*keys).agg(*values, F.bool_and("flag").alias("flag"), F.sum(w).alias("weight"))


def split_windows(windows: DataFrame, first: int, last: int, width: int = 1) -> DataFrame:
    """Spectral windows (row_id, chan_freq, chan_width) of the channels first..last, averaged by ``width``: their new metadata."""
    n = (last - first) // width + 1
    cut = lambda c: F.slice(c, first + 1, last - first + 1)
    group = lambda c, i: F.slice(cut(c), i * width + 1, width)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    each = lambda f: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f)
    d = windows.select("row_id", each(lambda i: F.try_divide(total(group("chan_freq", i)), F.size(group("chan_freq", i)))).alias("chan_freq"), each(lambda i: total(group("chan_width", i))).alias("chan_width"))
    return d.withColumn("num_chan", F.size("chan_freq")).withColumn("ref_frequency", F.get("chan_freq", F.lit(0))).withColumn("total_bandwidth", total(F.col("chan_width")))


def calibration_statistics(gains: DataFrame, keys: list[str]) -> DataFrame:
    """calstat: of unflagged gains' amplitudes, the count, mean, population deviation, extremes and root mean square."""
    a = F.when(~F.col("flag"), F.hypot("g_re", "g_im"))
    return gains.groupBy(*keys).agg(F.count(a).alias("npts"), F.avg(a).alias("mean"), F.stddev_pop(a).alias("sigma"), F.min(a).alias("min"), F.max(a).alias("max"), F.sqrt(F.avg(a * a)).alias("rms"))


# ---- calibration


def gain_corrected(vis: DataFrame, gains: DataFrame, by: list[str]) -> DataFrame:
    """Divide by g1 conj(g2); gains are (by.., antenna, g_re, g_im), already at each row's time.  Rows without one are flagged."""
    g = lambda n: gains.select(*by, F.col("antenna").alias(f"antenna{n}"), F.col("g_re").alias(f"r{n}"), F.col("g_im").alias(f"i{n}"))
    d = vis.join(g(1), [*by, "antenna1"], "left").join(g(2), [*by, "antenna2"], "left")
    re, im = F.expr("r1 * r2 + i1 * i2"), F.expr("i1 * r2 - r1 * i2")
    power = re * re + im * im
    ok = F.coalesce(power > 0, F.lit(False))
    return d.select(*(c for c in vis.columns if c not in ("re", "im", "flag")), F.when(ok, F.try_divide(F.col("re") * re + F.col("im") * im, power)).otherwise(F.col("re")).alias("re"), F.when(ok, F.try_divide(F.col("im") * re - F.col("re") * im, power)).otherwise(F.col("im")).alias("im"), (F.col("flag") | ~ok).alias("flag"))


def solve_gains(vis: DataFrame, group: list[str], antennas: int, reference: int = 0, phase_only: bool = False, rounds: int = 60) -> DataFrame:
    """(group.., antenna, g_re, g_im) for a unit point source, by damped alternating least squares in each solution interval.

    Times and channels of an interval are averaged by Spark first, so a task's group has one row for each baseline.
    """
    mean = vis.filter(~F.col("flag") & (F.col("antenna1") != F.col("antenna2"))).groupBy(*group, "antenna1", "antenna2").agg(F.try_divide(F.sum(F.col("weight") * F.col("re")), F.sum("weight")).alias("re"), F.try_divide(F.sum(F.col("weight") * F.col("im")), F.sum("weight")).alias("im"), F.sum("weight").alias("weight")).filter("weight > 0")

    def solve(edges: pd.DataFrame) -> pd.DataFrame:
        a, b = edges["antenna1"].to_numpy(), edges["antenna2"].to_numpy()
        v, w = edges["re"].to_numpy() + 1j * edges["im"].to_numpy(), edges["weight"].to_numpy()
        m, wt = np.zeros((antennas, antennas), complex), np.zeros((antennas, antennas))
        m[a, b], m[b, a], wt[a, b], wt[b, a] = v, v.conj(), w, w
        g = np.ones(antennas, complex) * math.sqrt(float(np.abs(v).mean()) or 1.0)
        for _ in range(rounds):
            down = (wt * np.abs(g[None, :]) ** 2).sum(axis=1)
            new = np.where(down > 0, (wt * m * g[None, :]).sum(axis=1) / np.where(down > 0, down, 1), g)
            if phase_only:
                new = np.where(new != 0, new / np.where(new != 0, np.abs(new), 1), 1)
            g = (g + new) / 2
        g = g * np.exp(-1j * np.angle(g[reference]))
        out = pd.DataFrame({k: [edges[k].iloc[0]] * antennas for k in group})
        return out.assign(antenna=range(antennas), g_re=g.real, g_im=g.imag)[wt.any(axis=1)]

    kinds = {f.name: f.dataType.simpleString() for f in vis.schema}
    return mean.groupBy(*group).applyInPandas(solve, ", ".join([*(f"{k} {kinds[k]}" for k in group), "antenna int", "g_re double", "g_im double"]))


def flux_scale(gains: DataFrame, reference: str) -> DataFrame:
    """(field, spw, flux): the squared ratio of mean gain amplitudes of the transfer and the reference field, antenna by antenna."""
    amp = gains.groupBy("field", "spw", "antenna").agg(F.avg(F.hypot("g_re", "g_im")).alias("amp"))
    ref = amp.filter(F.col("field") == reference).select("spw", "antenna", F.col("amp").alias("ref"))
    return amp.filter(F.col("field") != reference).join(ref, ["spw", "antenna"]).groupBy("field", "spw").agg(F.pow(F.try_divide(F.avg("amp"), F.avg("ref")), F.lit(2)).alias("flux"), F.count(F.lit(1)).alias("antennas"))


def continuum_subtracted(vis: DataFrame, keys: list[str], line_free: Column, order: int = 1) -> DataFrame:
    """Subtract a polynomial in channel, fitted by weight to unflagged line-free channels of each spectrum.

    Its moments are aggregates; for orders 0 and 1 the fit is closed, so it is SQL all the way.  Spectra with fewer points than a
    higher order needs stay as they are.
    """
    if order > 1:
        last = vis.agg(F.max("chan")).first()[0] or 0
        x = polynomials.scaled(F.col("chan"), 0.0, float(last))
        used = F.when(line_free & ~F.col("flag"), F.col("weight"))
        fits = polynomials.fitted(vis, keys, x, ["re", "im"], order, used).drop("n")
        d = vis.withColumn("__x", x).join(fits, keys, "left")
        less = lambda c: F.col(c) - F.coalesce(polynomials.evaluated(F.col(f"c_{c}"), F.col("__x"), order), F.lit(0.0))
        return d.select(*(less(c).alias(c) if c in ("re", "im") else F.col(c) for c in vis.columns))
    w = F.when(line_free & ~F.col("flag"), F.col("weight")).otherwise(0.0)
    x = F.col("chan").cast("double")
    sums = {"s0": w, "s1": w * x, "s2": w * x * x} | {f"{k}{c}": w * F.col(c) * (x if k == "m" else 1.0) for c in ("re", "im") for k in ("n", "m")}
    fit = vis.groupBy(*keys).agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    d = vis.join(fit, keys)
    for c in ("re", "im"):
        slope = F.when(det != 0, F.try_divide(F.col("s0") * F.col(f"m{c}") - F.col("s1") * F.col(f"n{c}"), det)).otherwise(0.0) if order else F.lit(0.0)
        base = F.when(F.col("s0") > 0, F.try_divide(F.col(f"n{c}") - slope * F.col("s1"), F.col("s0"))).otherwise(0.0)
        d = d.withColumn(f"__{c}", F.col(c) - base - slope * x)
    return d.select(*(F.col(f"__{c}").alias(c) if c in ("re", "im") else F.col(c) for c in vis.columns))


# ---- imaging: weights and gridding


def cells(uv: DataFrame, cell: float) -> DataFrame:
    return uv.withColumn("iu", F.round(F.col("u") / cell).cast("int")).withColumn("iv", F.round(F.col("v") / cell).cast("int"))


def weighted(uv: DataFrame, cell: float, mode: str = "natural", robust: float = 0.5) -> DataFrame:
    """Imaging weights: natural, uniform (by the density of a cell) or Briggs' compromise."""
    if mode == "natural":
        return uv.withColumn("imaging_weight", F.col("weight"))
    d = cells(uv, cell)
    density = d.groupBy("iu", "iv").agg(F.sum("weight").alias("density"))
    d = d.join(density, ["iu", "iv"])
    if mode == "uniform":
        w = F.try_divide(F.col("weight"), F.col("density"))
    else:
        f2 = (5 * 10**-robust) ** 2
        total = density.agg((F.try_divide(F.sum(F.col("density") * F.col("density")), F.sum("density"))).alias("__mean"))
        d = d.join(F.broadcast(total))  # one row
        w = F.col("weight") / (1 + F.coalesce(F.try_divide(F.col("density") * f2, F.col("__mean")), F.lit(0.0)))
    return d.withColumn("imaging_weight", F.coalesce(w, F.lit(0.0))).select(*uv.columns, "imaging_weight")


def gridded(uv: DataFrame, cell: float, support: int = 3) -> DataFrame:
    """(gu, gv, re, im, weight): each sample spread over (2 support + 1)^2 cells with a Gaussian taper and summed.

    Sums combine before the shuffle, so a dense middle of the plane is no hot spot.
    """
    taps = F.sequence(F.lit(-support), F.lit(support))
    d = cells(uv, cell).withColumn("du", F.explode(taps)).withColumn("dv", F.explode(taps))
    x, y = F.col("u") / cell - F.col("iu") - F.col("du"), F.col("v") / cell - F.col("iv") - F.col("dv")
    w = F.col("imaging_weight") * F.exp(-(x * x + y * y))
    return d.groupBy((F.col("iu") + F.col("du")).alias("gu"), (F.col("iv") + F.col("dv")).alias("gv")).agg(F.sum(w * F.col("re")).alias("re"), F.sum(w * F.col("im")).alias("im"), F.sum(w).alias("weight"))


def stokes(vis: DataFrame, keys: list[str], xx: int, yy: int) -> DataFrame:
    """Half sum and half difference of two correlations."""
    of = lambda c, k: F.max(F.when(F.col("corr") == k, F.col(c)))
    return vis.filter(F.col("corr").isin(xx, yy)).groupBy(*keys).agg(*(((of(c, xx) + s * of(c, yy)) / 2).alias(f"{n}_{c}") for n, s in (("i", 1), ("q", -1)) for c in ("re", "im")))

