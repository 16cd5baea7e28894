"""Counts by facet, density, spines, rates and completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranking import mode_per


def density(df: DataFrame, key: str, bucket: Column, buckets: list[str], modes: dict[str, str], extra: dict[str, Column]) -> DataFrame:
    """Per key: the total, a count per bucket (others only in the total), the mode of some columns and other aggregates."""
    counts = [F.count_if(bucket == b).alias(b) for b in buckets]
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("total"), *counts, *[c.alias(a) for a, c in extra.items()])
    for column, alias in modes.items():
        out = out.join(mode_per(df, [key], column, alias), key, "left")
    return out


def zero_fill(spine: DataFrame, facts: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """All keys of the spine, with 0 where there are no facts."""
    return spine.join(facts, keys, "left").fillna(0, measures)


def date_spine(df: DataFrame, first: Column, last: Column, alias: str) -> DataFrame:
    """All dates from the least ``first`` to the greatest ``last``, from two aggregated values."""
    return df.agg(F.min(first).alias("a"), F.max(last).alias("b")).select(F.explode(F.sequence("a", "b")).alias(alias))


def rate(cond: Column) -> Column:
    """The share of rows that meet a condition; 0 for no rows."""
    return F.coalesce(F.avg(F.coalesce(cond, F.lit(False)).cast("int")), F.lit(0.0))


def facet_counts(df: DataFrame, facets: list[str], skip: tuple[str, ...] = ("", "unknown")) -> DataFrame:
    """(facet, value, n) in one pass: rows become (facet, value) pairs that are combined in the map stage."""
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets])
    long = df.select(F.explode(pairs).alias("p")).select("p.*")
    return long.filter(F.col("value").isNotNull() & ~F.lower("value").isin(*skip)).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def leave_one_out(df: DataFrame, filters: dict[str, list]) -> DataFrame:
    """(facet, value, n, active): for each value of each facet, the rows that pass all other facets' filters.

    One pass: a row counts for a facet if it passes the others. Active values stay with 0 when nothing is left.
    """
    passes = {f: F.coalesce(F.col(f).isin(*vs), F.lit(False)) if vs else F.lit(True) for f, vs in filters.items()}

    def others(f: str) -> Column:
        return reduce(lambda a, b: a & b, [p for g, p in passes.items() if g != f], F.lit(True))

    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"), others(f).alias("counts")) for f in filters])
    long = df.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("value").isNotNull())
    counted = long.groupBy("facet", "value").agg(F.count_if("counts").alias("n"))
    active = reduce(lambda a, b: a | b, [(F.col("facet") == f) & F.col("value").isin(*[str(v) for v in vs]) for f, vs in filters.items() if vs], F.lit(False))
    return counted.withColumn("active", active).filter((F.col("n") > 0) | F.col("active"))


def share_of_top(df: DataFrame, count: str, within: list[str]) -> DataFrame:
    """``intensity``, the count's share of its group's greatest in hundredths, and ``size`` by halves of it."""
    top = F.max(count).over(Window.partitionBy(*within))
    size = F.when(top == 1, "medium").when(F.col(count) == top, "large").when(F.col(count) >= F.ceil(top / 2), "medium").otherwise("small")
    return df.withColumn("intensity", F.floor(F.col(count) * 100 / top + 0.5) / 100).withColumn("size", size)


def missing_required(required: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Required keys that were not seen."""
    return required.join(seen.select(*keys).distinct(), keys, "left_anti")
