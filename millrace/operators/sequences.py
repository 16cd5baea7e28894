"""Neighbours in time: gaps, islands, hops, connectors and scores of a day's sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The previous row's columns as ``prev_<column>``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def gap_class(minutes: Column, tight: int = 30, short: int = 90) -> Column:
    return F.when(minutes.isNull(), "first").when(minutes < 0, "overlap").when(minutes <= tight, "tight").when(minutes <= short, "short").otherwise("open")


def islands(df: DataFrame, keys: list[str], ts: str, tie: str, gap_seconds: int) -> DataFrame:
    """(keys, island, first, last, n): runs without a gap of ``gap_seconds`` or more."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    new = F.coalesce(F.timestamp_diff("SECOND", F.lag(ts).over(w), F.col(ts)) >= gap_seconds, F.lit(False))
    marked = df.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w))
    return marked.groupBy(*keys, "island").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"))


def transitions(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Rows whose state differs from the previous row's, with it."""
    return with_previous(df, keys, order, [state]).filter(F.col(f"prev_{state}").isNotNull() & (F.col(f"prev_{state}") != F.col(state)))


def pace(df: DataFrame, keys: list[str], ts: str, tie: str, place: str, short_minutes: int = 30) -> DataFrame:
    """A 0 to 100 score per key: 92, less 13 for each short gap and 7 for each change of place after the first."""
    p = with_previous(df, keys, [ts, tie], [ts, place])
    gap = F.timestamp_diff("SECOND", F.col(f"prev_{ts}"), F.col(ts)) / 60
    out = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"), F.count_if(gap < short_minutes).alias("short_gaps"), F.count_if(F.col(f"prev_{place}") != F.col(place)).alias("moves"))
    score = 92 - 13 * F.col("short_gaps") - 7 * F.greatest(F.lit(0), F.col("moves") - 1)
    return out.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)))
