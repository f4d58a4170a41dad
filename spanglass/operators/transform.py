"""Split: a dataset of selected rows and channels, averaged, with metadata that fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanglass.operators.rows import with_row_id
from spanglass.operators.visibilities import channel_average
from spanglass.sources.dataset import Dataset


def _renumbered(table: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the used rows of a subtable numbered anew in their old order, (old, new) row numbers)."""
    kept = table.join(used.select(F.col("id").cast("bigint").alias("row_id")).distinct(), "row_id", "left_semi")
    numbers = with_row_id(kept.select(F.col("row_id").alias("old")), ["old"], "new")
    return kept.join(numbers, kept["row_id"] == numbers["old"]).drop("row_id", "old").withColumnRenamed("new", "row_id").select(*table.columns), numbers


def split(dataset: Dataset, rows: Column | None = None, channels: dict[int, tuple[int, int]] | None = None, width: int = 1, keep_flags: bool = True, by_time: bool = True) -> Dataset:
    """A dataset of the main rows that ``rows`` selects and the channels first..last of each window in ``channels`` (all windows whole, if none are given).

    Data are the table ``vis`` (row_id, corr, chan, re, im, flag, weight, and sigma where it is there), keyed by the main row's ``row_id``.  ``width`` neighbouring
    channels become one: means of unflagged data (of all, if all is flagged), flags ANDed, weights added.
    Rows of windows that are not selected go; without ``keep_flags`` so do rows that are flagged whole.  Main rows are ordered by time (ties as before) and
    numbered anew; data descriptions, windows, polarisations and fields that no row uses go, and the references follow.  Other subtables stay.
    """
    if width < 1:
        raise ValueError("width is 1 or more")
    main = dataset.main if rows is None else dataset.main.filter(F.coalesce(rows, F.lit(False)))
    link = dataset["data_description"].select(F.col("row_id").cast("int").alias("data_desc_id"), F.col("spectral_window_id").alias("__window"))
    main = main.join(link, "data_desc_id")
    windows = dataset["spectral_window"]
    if channels is None:
        ranges = windows.select(F.col("row_id").cast("int").alias("__window"), F.lit(0).alias("__first"), (F.col("num_chan") - 1).alias("__last"))
    else:
        ranges = windows.sparkSession.createDataFrame([(int(w), int(a), int(b)) for w, (a, b) in channels.items()], "__window int, __first int, __last int")
    main = main.join(ranges, "__window")
    vis = dataset["vis"]
    if not keep_flags:
        whole = vis.groupBy("row_id").agg(F.bool_and("flag").alias("__whole"))
        main = main.filter("NOT flag_row").join(whole, "row_id", "left").filter("NOT coalesce(__whole, false)").drop("__whole")

    order = ["time", "row_id"] if by_time else ["row_id"]
    numbered = with_row_id(main.withColumnRenamed("row_id", "__old"), [c if c != "row_id" else "__old" for c in order])
    inside = vis.withColumnRenamed("row_id", "__old").join(numbered.select("__old", "row_id", "__first", "__last"), "__old").filter("chan BETWEEN __first AND __last")
    inside = inside.withColumn("chan", F.col("chan") - F.col("__first")).drop("__old", "__first", "__last")
    averaged = channel_average(inside, width, ["row_id", "corr"]) if width > 1 else inside
    fields, field_numbers = _renumbered(dataset["field"], numbered.select(F.col("field_id").alias("id")))
    links, link_numbers = _renumbered(dataset["data_description"], numbered.select(F.col("data_desc_id").alias("id")))
    kept_windows, window_numbers = _renumbered(windows, links.select(F.col("spectral_window_id").alias("id")))
    polarisations, polarisation_numbers = _renumbered(dataset["polarization"], links.select(F.col("polarization_id").alias("id")))

    def follow(d: DataFrame, column: str, numbers: DataFrame) -> DataFrame:
        kind = d.schema[column].dataType
        return d.join(numbers, d[column] == numbers["old"]).withColumn(column, F.col("new").cast(kind)).drop("old", "new")

    out = follow(follow(numbered.drop("__old", "__window", "__first", "__last"), "field_id", field_numbers), "data_desc_id", link_numbers)
    links = follow(follow(links, "spectral_window_id", window_numbers), "polarization_id", polarisation_numbers)
    return dataset.replaced(
        main=out.select(*dataset.main.columns),
        vis=averaged,
        field=fields,
        data_description=links.select(*dataset["data_description"].columns),
        spectral_window=_cut(kept_windows, ranges.join(window_numbers, ranges["__window"] == window_numbers["old"]).select(F.col("new").alias("row_id"), "__first", "__last"), width),
        polarization=polarisations,
    )


def _cut(windows: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """Windows of channels __first..__last each, averaged; the last channel of a window may be narrower."""
    arrays = [c for c in ("chan_freq", "chan_width", "effective_bw", "resolution") if c in windows.columns]
    d = windows.join(ranges, "row_id")
    for c in arrays:
        d = d.withColumn(c, F.slice(c, F.col("__first") + 1, F.col("__last") - F.col("__first") + 1))
    d = d.drop("__first", "__last")
    if width > 1:
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        part = lambda c, i: F.slice(c, i * width + 1, width)

        def averaged(c: str) -> Column:
            one = (lambda i: total(part(c, i)) / F.size(part(c, i))) if c == "chan_freq" else (lambda i: total(part(c, i)))
            return F.transform(F.sequence(F.lit(0), F.ceil(F.size(c) / width).cast("int") - 1), one)

        for c in arrays:
            d = d.withColumn(f"__{c}", averaged(c))
        d = d.drop(*arrays).withColumnsRenamed({f"__{c}": c for c in arrays})
    told = {"num_chan": F.size("chan_freq"), "ref_frequency": F.get("chan_freq", F.lit(0)), "total_bandwidth": F.aggregate("chan_width", F.lit(0.0), lambda s, x: s + F.abs(x))}
    return d.select(*(told[c].cast(windows.schema[c].dataType).alias(c) if c in told else F.col(c) for c in windows.columns))
