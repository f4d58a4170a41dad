"""Where jobs keep intermediate tables: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; set to a new folder only where it is unset on one machine, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them reach")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


BATCH_BYTES = 4_000_000
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on Arrow batches of this session hold at most ``most`` bytes (or one row), however long the texts are."""
    spark.conf.set(_LIMIT, str(most))


def table_of(df: DataFrame, name: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    While it is written, Arrow batches hold at most ``batch_bytes`` (or one row), however long the texts are.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_LIMIT)
    spark.conf.set(_LIMIT, str(batch_bytes))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_LIMIT, before)
    return spark.read.schema(df.schema).parquet(path)
