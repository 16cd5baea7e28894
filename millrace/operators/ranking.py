"""First, last, best and top rows per key, with every tie decided by the caller's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key. Spark keeps only n rows a key from each map task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key with their place."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= n)


def dedupe_first(df: DataFrame, keys: list[str], position: Column) -> DataFrame:
    """One row per key: the one of the least position, by a map-side combined aggregate."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, position).alias("_row")).select("_row.*")


def dedupe_last(df: DataFrame, keys: list[str], position: Column) -> DataFrame:
    """One row per key: the one of the greatest position, with ``first_position``, the key's least."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, position).alias("_row"), F.min(position).alias("first_position")).select("_row.*", "first_position")


def keep_top_priority(df: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """All rows whose priority is their key's greatest."""
    best = df.groupBy(*keys).agg(F.max(priority).alias("_best"))
    return df.join(best, keys).filter(F.col(priority) == F.col("_best")).drop("_best")


def mode_per(df: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    """Each key's most frequent value, the least of ties. Values are counted before any key is gathered."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    least = F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(least.alias("_m")).select(*keys, F.col("_m.v").alias(alias))


def numbered_top(df: DataFrame, order: list[Column], n: int, place: str = "place") -> DataFrame:
    """The first ``n`` rows of the whole table with their place: each task passes on n rows, and only n are numbered."""
    few = df.orderBy(*order).limit(n)
    return few.withColumn(place, F.row_number().over(Window.orderBy(*order)).cast("long"))
