"""Selection of visibility rows by structured selectors, all of them ANDed.

``dims`` are the small subtables, each with a row_id: data_description (spectral_window_id, polarization_id),
spectral_window (ref_frequency), polarization (corr_type array), antenna (name), field (name), state (obs_mode).
Names and patterns are looked up there, and the fact table sees plain predicates on its key columns, which
reach the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanglass.functions import logic
from spanglass.functions.sky import C

UNITS = {"m": 1.0, "km": 1000.0}
WAVES = {"lambda": 1.0, "klambda": 1e3, "mlambda": 1e6, "glambda": 1e9}


def _ids(dim: DataFrame, where: Column) -> list[int]:
    return [r.row_id for r in dim.filter(where).select("row_id").collect()]  # rows of a subtable, not of the data


def named(dim: DataFrame, column: str, wanted: list) -> list[int]:
    """Row ids for ids, (first, last) ranges, names and shell patterns; a pattern or name without a match is an error."""
    out: list[int] = []
    for w in wanted:
        if isinstance(w, tuple):
            out += range(w[0], w[1] + 1)
        elif isinstance(w, int):
            out.append(w)
        else:
            found = _ids(dim, logic.glob(F.col(column), w))
            if not found:
                raise ValueError(f"nothing matches {w!r}")
            out += found
    return sorted(set(out))


def numbers(column: str, wanted: list) -> Column:
    """A column among ids and inclusive (first, last) ranges."""
    return logic.in_ranges(F.col(column), *((w, w) if isinstance(w, int) else w for w in wanted))


def uv_distance(uvw: str = "uvw") -> Column:
    return F.hypot(F.get(uvw, F.lit(0)), F.get(uvw, F.lit(1)))


def select(main: DataFrame, dims: dict[str, DataFrame], *, field: list | None = None, spw: list[int] | None = None, scan: list | None = None, antenna: list | None = None, baselines: list[tuple] | None = None, intent: list[str] | None = None, correlation: list[int] | None = None, uvrange: tuple | None = None, time: tuple | None = None, observation: list | None = None, array: list | None = None, state: list | None = None, feed: list | None = None, where: Column | None = None) -> DataFrame:
    """Rows that all given selectors accept.

    ``uvrange`` is (low, high, unit), either bound None; ``time`` is (first, last) in seconds, or one time, which
    accepts rows within half their exposure.  ``correlation`` wants data descriptions that have all the types.
    """
    out: list[Column] = []
    if field is not None:
        out.append(F.col("field_id").isin(named(dims["field"], "name", field)))
    if spw is not None:
        out.append(F.col("data_desc_id").isin(_ids(dims["data_description"], F.col("spectral_window_id").isin(spw))))
    if correlation is not None:
        held = F.size(F.array_except(F.array(*map(F.lit, correlation)), "corr_type")) == 0
        pols = _ids(dims["polarization"], held)
        out.append(F.col("data_desc_id").isin(_ids(dims["data_description"], F.col("polarization_id").isin(pols))))
    if intent is not None:
        out.append(F.col("state_id").isin(named(dims["state"], "obs_mode", intent)))
    if antenna is not None:
        ids = named(dims["antenna"], "name", antenna)
        out.append(F.col("antenna1").isin(ids) | F.col("antenna2").isin(ids))
    if baselines is not None:
        pairs = [(named(dims["antenna"], "name", [a]), named(dims["antenna"], "name", [b])) for a, b in baselines]
        out.append(reduce(lambda x, y: x | y, [F.col("antenna1").isin(a) & F.col("antenna2").isin(b) for a, b in pairs]))
    for column, wanted in (("scan_number", scan), ("observation_id", observation), ("array_id", array), ("state_id", state)):
        if wanted is not None:
            out.append(numbers(column, wanted))
    if feed is not None:
        out.append(numbers("feed1", feed) | numbers("feed2", feed))
    if time is not None:
        out.append(F.col("time").between(*time) if len(time) == 2 else F.abs(F.col("time") - time[0]) <= F.col("exposure") / 2)
    if where is not None:
        out.append(where)
    d = main.filter(reduce(lambda a, b: a & b, out)) if out else main
    if uvrange is not None:
        low, high, unit = uvrange
        if unit in UNITS:
            scale: Column = F.lit(UNITS[unit])
        else:  # wavelengths, at the reference frequency of the row's spectral window
            windows = dims["data_description"].select(F.col("row_id").alias("data_desc_id"), "spectral_window_id").join(dims["spectral_window"].select(F.col("row_id").alias("spectral_window_id"), "ref_frequency"), "spectral_window_id")
            d = d.join(windows.select("data_desc_id", (F.try_divide(F.lit(C), F.col("ref_frequency")) * WAVES[unit]).alias("__wave")), "data_desc_id")
            scale = F.col("__wave")
        if low is not None:
            d = d.filter(uv_distance() >= low * scale)
        if high is not None:
            d = d.filter(uv_distance() <= high * scale)
    return d.select(*main.columns)
