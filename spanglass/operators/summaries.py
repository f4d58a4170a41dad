"""Summaries of a dataset: what was observed, when, where and how, and which part of the uv plane was covered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanglass.functions.sky import C
from spanglass.sources.dataset import Dataset

#: Names of correlation types.
CORRELATIONS = {1: "I", 2: "Q", 3: "U", 4: "V", 5: "RR", 6: "RL", 7: "LR", 8: "LL", 9: "XX", 10: "XY", 11: "YX", 12: "YY"}


def _unflagged(dataset: Dataset) -> DataFrame:
    """Main rows with ``__good``, the share of a row's data that is not flagged (none of a row that is flagged whole), and their window."""
    main = dataset.main.join(dataset["data_description"].select(F.col("row_id").cast("int").alias("data_desc_id"), F.col("spectral_window_id").alias("__window")), "data_desc_id", "left")
    if "vis" in dataset.tables:
        share = dataset["vis"].groupBy("row_id").agg(F.avg((~F.col("flag")).cast("double")).alias("__share"))
        main = main.join(share, "row_id", "left")
    else:
        main = main.withColumn("__share", F.lit(1.0))
    return main.withColumn("__good", F.when(F.col("flag_row"), 0.0).otherwise(F.coalesce("__share", F.lit(1.0))))


def scans(dataset: Dataset) -> DataFrame:
    """A row a scan (observation, array, scan): rows, fields, data descriptions, windows, states and intents as sorted arrays, times, mean interval of all and by window,
    and the number of unflagged rows, in which a row counts by its share of unflagged data.
    """
    main = _unflagged(dataset)
    keys = ["observation_id", "array_id", "scan_number"]
    names = dataset["field"].select(F.col("row_id").cast("int").alias("field_id"), F.col("name").alias("__field"))
    intents = dataset["state"].select(F.col("row_id").cast("int").alias("state_id"), F.col("obs_mode").alias("__mode"))
    d = main.join(names, "field_id", "left").join(intents, "state_id", "left")
    some = lambda c: F.array_sort(F.collect_set(c))  # noqa: E731  as many as a scan has set-ups
    by_window = d.groupBy(*keys, "__window").agg(F.avg("interval").alias("i")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__window", "i"))), lambda s: s["i"]).alias("intervals"))
    out = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), some("field_id").alias("field_ids"), some("__field").alias("field_names"), some("data_desc_id").alias("data_desc_ids"), some("__window").alias("window_ids"), some("state_id").alias("state_ids"),
        some(F.filter(F.split(F.coalesce("__mode", F.lit("")), ","), lambda x: x != "")).alias("__intents"), F.min(F.col("time") - F.col("interval") / 2).alias("begin"), F.max(F.col("time") + F.col("interval") / 2).alias("end"),
        F.avg("interval").alias("interval"), F.sum("__good").alias("unflagged"), F.count_distinct("antenna1", "antenna2").alias("n_baselines"),
    )
    return out.join(by_window, keys).withColumn("intents", F.array_sort(F.array_distinct(F.flatten("__intents")))).drop("__intents")


def fields(dataset: Dataset) -> DataFrame:
    """A row a field: its name, code, source, direction, and its rows and unflagged rows in the main table (0 of unobserved ones)."""
    counts = _unflagged(dataset).groupBy(F.col("field_id").cast("bigint").alias("row_id")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("__good").alias("unflagged"))
    d = dataset["field"]
    direction = [F.get("phase_dir", F.lit(i)).alias(n) for i, n in enumerate(("ra", "dec")) if "phase_dir" in d.columns]
    kept = [c for c in ("name", "code", "source_id", "time") if c in d.columns]
    return d.join(counts, "row_id", "left").select(F.col("row_id").alias("field_id"), *kept, *direction, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("unflagged", F.lit(0.0)).alias("unflagged"))


def windows(dataset: Dataset) -> DataFrame:
    """A row a spectral window: channels, frequencies, bandwidth, and the data descriptions, polarisations and correlations that go with it."""
    kinds = F.create_map(*(x for k, v in CORRELATIONS.items() for x in (F.lit(k), F.lit(v))))
    named = F.transform("corr_type", lambda c: F.coalesce(F.try_element_at(kinds, c), F.concat(F.lit("type "), c.cast("string"))))
    polarisations = dataset["polarization"].select(F.col("row_id").alias("__p"), named.alias("__c"))
    links = dataset["data_description"].join(polarisations, F.col("polarization_id") == F.col("__p"), "left").groupBy(F.col("spectral_window_id").cast("bigint").alias("row_id"))
    links = links.agg(F.array_sort(F.collect_set("row_id")).alias("data_desc_ids"), F.array_sort(F.collect_set("polarization_id")).alias("polarization_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__c")))).alias("correlations"))
    first, last = F.get("chan_freq", F.lit(0)), F.try_element_at("chan_freq", F.lit(-1))
    w = dataset["spectral_window"]
    return w.join(links, "row_id", "left").select(
        F.col("row_id").alias("spectral_window_id"), *(c for c in ("name",) if c in w.columns), F.size("chan_freq").alias("n_channels"), first.alias("first_frequency"), F.get("chan_width", F.lit(0)).alias("channel_width"),
        ((first + last) / 2).alias("centre_frequency"), F.array_min("chan_freq").alias("min_frequency"), F.array_max("chan_freq").alias("max_frequency"), F.aggregate("chan_width", F.lit(0.0), lambda s, x: s + F.abs(x)).alias("bandwidth"),
        *(F.coalesce(c, F.array().cast(k)).alias(c) for c, k in (("data_desc_ids", "array<bigint>"), ("polarization_ids", "array<int>"), ("correlations", "array<string>"))),
    )


def observations(dataset: Dataset) -> DataFrame:
    """A row an observation: who and where, and the first and last time of its rows (null of one without rows)."""
    times = dataset.main.groupBy(F.col("observation_id").cast("bigint").alias("row_id")).agg(F.min(F.col("time") - F.col("interval") / 2).alias("begin"), F.max(F.col("time") + F.col("interval") / 2).alias("end"), F.count(F.lit(1)).alias("n_rows"))
    d = dataset["observation"]
    kept = [c for c in ("telescope_name", "observer", "project", "release_date") if c in d.columns]
    return d.join(times, "row_id", "left").select(F.col("row_id").alias("observation_id"), *kept, "begin", "end", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def antennas(dataset: Dataset) -> DataFrame:
    """A row an antenna: name, station, size, geocentric longitude, latitude and radius, and the rows that it takes part in (autocorrelations once)."""
    main = dataset.main
    ends = main.select(F.explode(F.array_distinct(F.array(F.col("antenna1").cast("bigint"), F.col("antenna2").cast("bigint")))).alias("row_id")).groupBy("row_id").agg(F.count(F.lit(1)).alias("n_rows"))
    d = dataset["antenna"]
    x, y, z = (F.get("position", F.lit(i)) for i in range(3))
    place = [F.atan2(y, x).alias("longitude"), F.atan2(z, F.hypot(x, y)).alias("latitude"), F.sqrt(x * x + y * y + z * z).alias("radius")] if "position" in d.columns else []
    kept = [c for c in ("name", "station", "type", "mount", "dish_diameter") if c in d.columns]
    return d.join(ends, "row_id", "left").select(F.col("row_id").alias("antenna_id"), *kept, *place, F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def info(dataset: Dataset) -> DataFrame:
    """One row: how many rows each table has, and the times from the first to the last."""
    m = dataset.main.agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.col("time") - F.col("interval") / 2).alias("begin"), F.max(F.col("time") + F.col("interval") / 2).alias("end"))
    out = m.withColumn("elapsed", F.col("end") - F.col("begin"))
    for name in ("observation", "field", "spectral_window", "polarization", "data_description", "antenna"):
        if name in dataset.tables:
            out = out.crossJoin(F.broadcast(dataset[name].agg(F.count(F.lit(1)).alias(f"n_{name}"))))  # one row
    return out


def listing(dataset: Dataset) -> dict[str, DataFrame]:
    """All sections by name, evaluated when asked for."""
    kept = lambda name, new, *columns: dataset[name].select(F.col("row_id").alias(new), *(c for c in columns if c in dataset[name].columns))
    found = {"info": info(dataset), "observations": observations(dataset), "scans": scans(dataset), "fields": fields(dataset), "windows": windows(dataset), "antennas": antennas(dataset)}
    found["polarizations"] = kept("polarization", "polarization_id", "num_corr", "corr_type")
    found["data_descriptions"] = kept("data_description", "data_desc_id", "spectral_window_id", "polarization_id", "flag_row")
    if "source" in dataset.tables:
        found["sources"] = dataset["source"].select(*(c for c in ("source_id", "name", "code", "spectral_window_id", "calibration_group", "num_lines", "rest_frequency", "sysvel", "time", "direction") if c in dataset["source"].columns))
    return found


def uv_coverage(dataset: Dataset, mirrored: bool = False) -> DataFrame:
    """(antenna1, antenna2, field_id, spectral_window_id, centre_frequency, row_id, time, u, v, w): baselines in wavelengths at their window's centre.

    A track is what shares the first four; autocorrelations and rows flagged whole are left out.  With ``mirrored`` each point comes again at -u, -v, -w.
    """
    centre = windows(dataset).select(F.col("spectral_window_id").cast("int").alias("spectral_window_id"), "centre_frequency")
    link = dataset["data_description"].select(F.col("row_id").cast("int").alias("data_desc_id"), F.col("spectral_window_id").cast("int").alias("spectral_window_id"))
    d = dataset.main.filter("antenna1 <> antenna2 AND NOT flag_row").join(link, "data_desc_id").join(centre, "spectral_window_id")
    k = F.col("centre_frequency") / C
    out = d.select("antenna1", "antenna2", "field_id", "spectral_window_id", "centre_frequency", "row_id", "time", *((F.get("uvw", F.lit(i)) * k).alias(c) for i, c in enumerate("uvw")))
    if mirrored:
        sign = F.explode(F.array(F.lit(1), F.lit(-1)))
        out = out.withColumn("__s", sign).select(*((F.col(c) * F.col("__s")).alias(c) if c in ("u", "v", "w") else F.col(c) for c in out.columns))
    return out
