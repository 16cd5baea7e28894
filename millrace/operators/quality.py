"""Expectations: row rules, health checks, drift and thresholds as result rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import errors


def issues(df: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(key, issue): one row for each rule that a row breaks."""
    return df.select(key, F.explode(errors(*rules)).alias("issue"))


def failures(check: str, df: DataFrame, bad: Column) -> DataFrame:
    """(check, failed): how many rows fail."""
    return df.agg(F.count_if(bad).alias("failed")).select(F.lit(check).alias("check"), "failed")


def orphans(check: str, child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(check, failed): children whose non-null key has no parent."""
    lost = child.filter(F.col(key).isNotNull()).join(parent, child[key] == parent[parent_key], "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("failed")).select(F.lit(check).alias("check"), "failed")


def duplicates(check: str, df: DataFrame, keys: list[str]) -> DataFrame:
    """(check, failed): keys that occur more than once."""
    return df.groupBy(*keys).count().filter("count > 1").agg(F.count(F.lit(1)).alias("failed")).select(F.lit(check).alias("check"), "failed")


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks).withColumn("ok", F.col("failed") == 0)
