"""Tables on disk: Parquet with keywords kept in the schema's metadata."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def open_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_table(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "errorifexists") -> None:
    (df.select(*columns) if columns else df).write.mode(mode).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Rows must have the table's columns; order does not matter."""
    old = df.sparkSession.read.parquet(path)
    df.select(*old.columns).write.mode("append").parquet(path)


def with_keyword(df: DataFrame, column: str, **keywords) -> DataFrame:
    """Column keywords (unit, frame, shape ...) travel with the schema, to Parquet and back."""
    kept = {**(df.schema[column].metadata or {}), **keywords}
    return df.select(*(F.col(c).alias(c, metadata=kept) if c == column else F.col(c) for c in df.columns))


def keywords(df: DataFrame, column: str) -> dict:
    return dict(df.schema[column].metadata or {})


def chunks(df: DataFrame, row: str, size: int) -> DataFrame:
    """Number blocks of rows, for bounded work on each by group."""
    return df.withColumn("chunk", F.floor(F.col(row) / size).cast("bigint"))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; set to a new folder only where it is unset, as on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them reach")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
