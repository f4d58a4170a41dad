"""Named snapshots of flags: saved, listed, restored, deleted, renamed.

Every operation is a row appended to a log; which versions there are follows from the log.  Flags are written to a folder of their own before
the row that names it, so a write that breaks off is never seen.  One writer at a time is assumed, as with the tables themselves.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "seq bigint, operation string, name string, target string, comment string, folder string, rows bigint"
MERGES = ("replace", "or", "and")


def merged(new: Column, old: Column, how: str) -> Column:
    if how not in MERGES:
        raise ValueError(f"one of {MERGES}")
    return {"replace": new, "or": new | old, "and": new & old}[how]


class FlagVersions:
    """The versions below ``path`` of flags that ``keys`` tell apart."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _log(self) -> list:
        """All operations in order; there are as many as were made by hand."""
        try:
            return self.spark.read.schema(_LOG).parquet(f"{self.path}/log").orderBy("seq").collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def _versions(self) -> dict[str, dict]:
        found: dict[str, dict] = {}
        for r in self._log():
            if r.operation == "save":
                old = found.get(r.name, {})
                found[r.name] = {"comment": r.comment or old.get("comment", ""), "folder": r.folder, "rows": r.rows}
            elif r.operation == "delete":
                del found[r.name]
            else:
                found = {r.target if n == r.name else n: (v | {"comment": r.comment} if n == r.name else v) for n, v in found.items()}
        return found

    def _append(self, operation: str, name: str, target: str | None = None, comment: str = "", folder: str | None = None, rows: int | None = None) -> None:
        seq = max((r.seq for r in self._log()), default=0) + 1
        self.spark.createDataFrame([(seq, operation, name, target, comment, folder, rows)], _LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _known(self, name: str) -> dict:
        versions = self._versions()
        if name not in versions:
            raise ValueError(f"no flag version {name!r}")
        return versions[name]

    @staticmethod
    def _named(name: str) -> None:
        if not name or name == "main" or "/" in name:
            raise ValueError(f"illegal flag version name {name!r}")

    def list(self) -> list[tuple[str, str]]:
        """(name, comment) in the order in which they were first saved."""
        return [(n, v["comment"]) for n, v in self._versions().items()]

    def flags(self, name: str) -> DataFrame:
        """(keys.., flag) of a version."""
        return self.spark.read.parquet(self._known(name)["folder"])

    def save(self, table: DataFrame, name: str, comment: str = "", merge: str = "replace") -> None:
        """Save the flags of ``table``; a version that is there is merged with them, and keeps its comment if none is given."""
        self._named(name)
        new = table.select(*self.keys, "flag")
        old = self._versions().get(name)
        if old and merge != "replace":
            before = self.spark.read.parquet(old["folder"]).withColumnRenamed("flag", "__old")
            if before.count() != new.count():
                raise ValueError(f"flag version {name!r} has other rows")
            new = new.join(before, self.keys, "left").select(*self.keys, merged(F.col("flag"), F.coalesce("__old", F.lit(False)), merge).alias("flag"))
        elif merge not in MERGES:
            raise ValueError(f"one of {MERGES}")
        folder = f"{self.path}/flags-{uuid.uuid4().hex}"
        new.write.parquet(folder)
        self._append("save", name, comment=comment, folder=folder, rows=self.spark.read.parquet(folder).count())

    def restore(self, table: DataFrame, name: str, merge: str = "replace") -> DataFrame:
        """``table`` with a version's flags in place of its own, or with both; another number of rows raises."""
        version = self._known(name)
        if table.count() != version["rows"]:
            raise ValueError(f"flag version {name!r} has {version['rows']} rows")
        saved = self.spark.read.parquet(version["folder"]).withColumnRenamed("flag", "__saved")
        flag = merged(F.coalesce("__saved", F.lit(False)), F.col("flag"), merge)
        return table.join(saved, self.keys, "left").select(*(flag.alias(c) if c == "flag" else F.col(c) for c in table.columns))

    def delete(self, name: str) -> None:
        """The version is no longer listed; its folder stays until the store is cleared, so readers that have begun go on."""
        self._known(name)
        self._append("delete", name)

    def rename(self, name: str, to: str, comment: str = "") -> None:
        self._named(to)
        self._known(name)
        if to in self._versions():
            raise ValueError(f"flag version {to!r} is there already")
        self._append("rename", name, target=to, comment=comment)
