"""Helpers shared by the training-data operators: shared storage, words, hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters outside the six ASCII white-space code points.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    This is the cluster's ``spark.checkpoint.dir``. A local session without that
    setting (as in tests on one machine) gets a folder of its own; on a cluster it has to be set.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _own_dir[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: what follows survives the loss of any executor
    without running what came before again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(*frames: DataFrame) -> None:
    """Delete the files of frames from :func:`materialize` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        own = shared_dir(spark)
        for file in df.inputFiles():
            folder = file.rpartition("/")[0]
            if folder.replace("file:///", "/").startswith(own.replace("file://", "")):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
                break


def word_count(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(*parts: Column, seed: int = 0) -> Column:
    """60 uniform bits from the parts' decimal or text forms (null is a value of its own)."""
    joined = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def named(column: str) -> Column:
    """A column by its name, in which dots and backticks are plain characters."""
    return F.col("`" + column.replace("`", "``") + "`")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row, maps included."""
    has_map = [c for c in df.columns if "map<" in df.schema[c].dataType.simpleString()]
    return F.xxhash64(*[F.to_json(F.struct(named(c))) if c in has_map else named(c) for c in df.columns])


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of a few rows computed on the driver, as a JVM-side relation."""
    import json

    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def bound_batches(df: DataFrame, size: int = 8 << 20) -> None:
    """Let texts reach Python in Arrow batches of about ``size`` bytes, whatever their length (a setting of the session)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


_held: list[dict] = []


def hold(*tables: dict) -> None:
    """Make these the lookup tables that this Python worker keeps; those of another operator are emptied.

    Workers outlive tasks and stages: without this, a pipeline would keep every operator's tables and freed buffers at once.
    """
    pa.set_memory_pool(pa.system_memory_pool())  # gives large buffers back when they are freed
    for t in _held:
        if not any(t is u for u in tables):
            t.clear()
    _held[:] = tables
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
