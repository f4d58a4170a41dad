"""A dataset: one main table of rows in time and the subtables that describe them, under one handle.

Subtables are keyed by row number (``row_id``), which the main table and other subtables refer to.  A dataset is a folder with one Parquet folder a
table; the list of tables is written last, so a save that breaks off leaves nothing that opens.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns that each table needs, with their types and units.
REQUIRED = {
    "main": "antenna1 int, antenna2 int, array_id int, data_desc_id int, exposure double s, feed1 int, feed2 int, field_id int, flag_row boolean, interval double s, observation_id int, processor_id int, scan_number int, sigma array<float>, state_id int, time double s, time_centroid double s, uvw array<double> m, weight array<float>",
    "antenna": "dish_diameter double m, flag_row boolean, mount string, name string, offset array<double> m, position array<double> m, station string, type string",
    "data_description": "flag_row boolean, polarization_id int, spectral_window_id int",
    "feed": "antenna_id int, beam_id int, feed_id int, interval double s, num_receptors int, polarization_type array<string>, position array<double> m, receptor_angle array<double> rad, spectral_window_id int, time double s",
    "field": "code string, delay_dir array<double> rad, flag_row boolean, name string, num_poly int, phase_dir array<double> rad, reference_dir array<double> rad, source_id int, time double s",
    "flag_cmd": "applied boolean, command string, interval double s, level int, reason string, severity int, time double s, type string",
    "history": "application string, app_params array<string>, cli_command array<string>, message string, object_id int, observation_id int, origin string, priority string, time double s",
    "observation": "flag_row boolean, log array<string>, observer string, project string, release_date double s, schedule array<string>, schedule_type string, telescope_name string, time_range array<double> s",
    "pointing": "antenna_id int, direction array<double> rad, interval double s, name string, num_poly int, target array<double> rad, time double s, time_origin double s, tracking boolean",
    "polarization": "corr_type array<int>, flag_row boolean, num_corr int",
    "processor": "flag_row boolean, mode_id int, sub_type string, type string, type_id int",
    "spectral_window": "chan_freq array<double> Hz, chan_width array<double> Hz, effective_bw array<double> Hz, flag_row boolean, freq_group int, freq_group_name string, if_conv_chain int, meas_freq_ref int, name string, net_sideband int, num_chan int, ref_frequency double Hz, resolution array<double> Hz, total_bandwidth double Hz",
    "state": "cal double K, flag_row boolean, load double K, obs_mode string, ref boolean, sig boolean, sub_scan int",
}
#: Fixed values: (table, column, table referred to, whether -1 stands for none).
REFERENCES = [
    ("main", "antenna1", "antenna", False), ("main", "antenna2", "antenna", False), ("main", "data_desc_id", "data_description", False), ("main", "field_id", "field", False),
    ("main", "observation_id", "observation", False), ("main", "processor_id", "processor", True), ("main", "state_id", "state", True),
    ("data_description", "polarization_id", "polarization", False), ("data_description", "spectral_window_id", "spectral_window", False),
    ("feed", "antenna_id", "antenna", False), ("feed", "spectral_window_id", "spectral_window", True), ("history", "observation_id", "observation", True), ("pointing", "antenna_id", "antenna", False),
]
#: Fixed values: (table, column with a count, column with as many cells).
SIZES = [("spectral_window", "num_chan", c) for c in ("chan_freq", "chan_width", "effective_bw", "resolution")] + [("polarization", "num_corr", "corr_type")]
REPORT = "table string, column string, issue string, detail string, n bigint"


def columns_of(table: str) -> list[tuple[str, str, str | None]]:
    """(column, type, unit) that a table needs."""
    return [(name, kind, unit[0] if unit else None) for name, kind, *unit in (c.split() for c in REQUIRED[table].split(", "))]


@dataclass
class Dataset:
    """Tables by name; ``main`` and those that are there of the others, and any further ones."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Dataset:
        """Only schemas are read; rows when they are asked for."""
        names = [r.name for r in spark.read.parquet(f"{path}/_tables").collect()]
        return cls({n: spark.read.parquet(f"{path}/{n}") for n in names})

    @classmethod
    def empty(cls, spark: SparkSession) -> Dataset:
        """Every required table, without rows, with its units."""
        made = {}
        for table in REQUIRED:
            fields = [T.StructField(c, spark.createDataFrame([], f"x {kind}").schema[0].dataType, True, {"unit": unit} if unit else {}) for c, kind, unit in columns_of(table)]
            made[table] = spark.createDataFrame([], T.StructType([T.StructField("row_id", T.LongType()), *fields]))
        return cls(made)

    def save(self, path: str) -> None:
        """A new folder; one that is there raises."""
        spark = self.main.sparkSession
        for name, df in self.tables.items():
            df.write.mode("errorifexists").parquet(f"{path}/{name}")
        spark.createDataFrame([(n,) for n in self.tables], "name string").coalesce(1).write.mode("errorifexists").parquet(f"{path}/_tables")

    @property
    def main(self) -> DataFrame:
        return self["main"]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"no table {name!r}; there are {sorted(self.tables)}")
        return self.tables[name]

    def replaced(self, **tables: DataFrame) -> Dataset:
        """Another handle, with some tables in place of its own."""
        return Dataset({**self.tables, **tables})

    def with_main(self, keep: DataFrame) -> Dataset:
        """The dataset of some main rows; subtables stay whole, so row numbers stay right."""
        return self.replaced(main=keep)

    def described(self, *columns: str) -> DataFrame:
        """The main table with columns of its subtables, given as ``table.column`` and named ``table_column``.

        Window and polarisation are reached by way of the data description.  Rows that refer to nothing have nulls.
        """
        out, via = self.main, {"antenna1": "antenna", "antenna2": "antenna", "field": "field_id", "state": "state_id", "observation": "observation_id", "processor": "processor_id", "data_description": "data_desc_id"}
        wanted: dict[str, list[str]] = {}
        for c in columns:
            table, _, column = c.partition(".")
            wanted.setdefault(table, []).append(column)
        if {"spectral_window", "polarization"} & set(wanted):
            link = self["data_description"].select(F.col("row_id").alias("data_desc_id"), F.col("spectral_window_id").alias("__spectral_window"), F.col("polarization_id").alias("__polarization"))
            out = out.join(link, "data_desc_id", "left")
        for table, names in wanted.items():
            key = f"__{table}" if table in ("spectral_window", "polarization") else table if table in ("antenna1", "antenna2") else via[table]
            source = self["antenna" if table in ("antenna1", "antenna2") else table]
            out = out.join(source.select(F.col("row_id").alias(key), *(F.col(n).alias(f"{table}_{n}") for n in names)), key, "left")
        return out.drop("__spectral_window", "__polarization")

    # ---- checks

    def schema_issues(self) -> list[tuple[str, str | None, str, str]]:
        """(table, column, issue, detail) of what the schemas alone show."""
        found = []
        for table in REQUIRED:
            if table not in self.tables:
                found.append((table, None, "missing table", ""))
                continue
            schema = {f.name: f for f in self.tables[table].schema}
            if table != "main" and "row_id" not in schema:
                found.append((table, "row_id", "missing column", "bigint"))
            for column, kind, unit in columns_of(table):
                if column not in schema:
                    found.append((table, column, "missing column", kind))
                    continue
                f = schema[column]
                if f.dataType.simpleString() != kind:
                    found.append((table, column, "wrong type", f"{f.dataType.simpleString()}, not {kind}"))
                if unit and "unit" not in (f.metadata or {}):
                    found.append((table, column, "missing unit", unit))
                elif unit and f.metadata["unit"] != unit:
                    found.append((table, column, "wrong unit", f"{f.metadata['unit']}, not {unit}"))
        return found

    def report(self, schemas: bool = True) -> DataFrame:
        """(table, column, issue, detail, n): missing tables and columns, wrong types and units, row numbers that refer to nothing, row numbers with gaps or repeats, and counts that
        their arrays do not have; ``n`` is how many rows show it.  Issues that no row shows are left out.
        """
        spark = self.main.sparkSession
        parts = [spark.createDataFrame([(*i, 1) for i in self.schema_issues()] if schemas else [], REPORT)]
        row = lambda d, table, column, issue, detail: d.select(F.lit(table).alias("table"), F.lit(column).alias("column"), F.lit(issue).alias("issue"), F.lit(detail).alias("detail"), F.col("n").cast("bigint").alias("n"))
        has = lambda table, *columns: table in self.tables and set(columns) <= set(self.tables[table].columns)
        for table, column, to, none in REFERENCES:
            if has(table, column) and has(to, "row_id"):
                keys = self[table].filter(F.col(column).isNull() | (F.col(column) != -1)) if none else self[table]
                counts = keys.groupBy(F.col(column).cast("bigint").alias("__key")).agg(F.count(F.lit(1)).alias("__n"))  # a row for each key, before the join
                lost = counts.join(self[to].select(F.col("row_id").alias("__key")), "__key", "left_anti").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"))
                parts.append(row(lost, table, column, "refers to nothing", to))
        for table, df in self.tables.items():
            if table != "main" and has(table, "row_id"):
                numbers = df.agg(F.count(F.lit(1)).alias("c"), F.count_distinct("row_id").alias("d"), F.min("row_id").alias("a"), F.max("row_id").alias("b"))
                whole = (F.col("c") == 0) | ((F.col("d") == F.col("c")) & (F.col("a") == 0) & (F.col("b") == F.col("c") - 1))
                parts.append(row(numbers.select(F.when(F.coalesce(whole, F.lit(False)), 0).otherwise(F.col("c")).alias("n")), table, "row_id", "row numbers are not 0, 1, 2 ...", ""))
        for table, count, cells in SIZES:
            if has(table, count, cells):
                wrong = F.coalesce(F.size(cells), F.lit(-1)) != F.coalesce(F.col(count), F.lit(-1))
                parts.append(row(self[table].agg(F.count_if(wrong).alias("n")), table, cells, "another size than told", count))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.filter("n > 0")
