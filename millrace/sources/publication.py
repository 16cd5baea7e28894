"""Publication of several tables at once: staged, gated, and made current by one change of a manifest.

A root folder holds ``versions/<version>/<table>`` and a manifest that names the current version. Readers go by the manifest, so they see all
tables of one version or all of another. A version is staged beside the current one, read back, and checked; only if no check finds a row
does the manifest change, by one atomic rename. A crash at any moment leaves the old version current, and publishing the version again finishes
or repeats the work; a version that is current already is left alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Check = Callable[[dict[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Report:
    """What became of a publication: the findings of each check, and whether the version is current now."""

    version: str
    current: bool
    findings: dict[str, int] = field(default_factory=dict)


class Publication:
    """Tables under a folder of any file system that Spark reaches."""

    MANIFEST = "CURRENT"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _files(self):  # noqa: ANN202
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict | None:
        """The manifest (version and tables), or None before the first publication."""
        if not self._files().exists(self._path(self.MANIFEST)):
            return None
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.root}/{self.MANIFEST}").first()["value"])

    def tables(self) -> dict[str, DataFrame]:
        """The current version's tables."""
        now = self.manifest()
        return self.staged(now["version"], now["tables"]) if now else {}

    def staged(self, version: str, names: list[str]) -> dict[str, DataFrame]:
        """A version's tables as they were written."""
        return {n: self.spark.read.parquet(f"{self.root}/versions/{version}/{n}") for n in names}

    def stage(self, version: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Write a version's tables, over those of an attempt that did not end; the current version can't be staged."""
        now = self.manifest()
        if now and now["version"] == version:
            raise ValueError(f"version {version} is current")
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/versions/{version}/{name}")
        return self.staged(version, [*tables])

    def _swap(self, version: str, names: list[str]) -> None:
        """Make a version current: a manifest written aside, then renamed over the old one."""
        jvm, aside = self.spark._jvm, self._path(f".{self.MANIFEST}-{version}")
        out = self._files().create(aside, True)
        out.write(bytearray(json.dumps({"version": version, "tables": names}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(aside, self._path(self.MANIFEST), options)

    def publish(self, version: str, tables: dict[str, DataFrame], checks: dict[str, Check]) -> Report:
        """Stage, check and, if nothing is found, make current. Each check gets the staged tables and returns the rows that are wrong."""
        now = self.manifest()
        if now and now["version"] == version:
            return Report(version, True)
        there = self.stage(version, tables)
        parts = [check(there).select(F.lit(name).alias("name")) for name, check in checks.items()]
        found = dict.fromkeys(checks, 0)
        for part in parts:
            found |= {r["name"]: r["n"] for r in part.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row
        if any(found.values()):
            return Report(version, False, found)
        self._swap(version, [*tables])
        return Report(version, True, found)


def orphans(child: str, key: str, parent: str, parent_key: str) -> Check:
    """Rows of ``child`` whose key isn't null and that ``parent`` lacks."""
    return lambda t: t[child].filter(F.col(key).isNotNull()).join(t[parent].select(F.col(parent_key).alias("_p")), F.col(key) == F.col("_p"), "left_anti")


def repeated(table: str, *keys: str) -> Check:
    """Keys that a table has more than once."""
    return lambda t: t[table].groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")


def lacking(table: str, *columns: str) -> Check:
    """Rows with a null in a column that must have a value."""
    return lambda t: t[table].filter(" or ".join(f"`{c}` is null" for c in columns))
