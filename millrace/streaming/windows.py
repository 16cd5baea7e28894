"""Structured Streaming forms of the limiter, the operation ledger and the latest-snapshot cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def window_counts(stream: DataFrame, ts: str, keys: list[str], window: str, late: str) -> DataFrame:
    """Fixed windows counted per key; a window is final once the watermark passes it."""
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, window), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), *keys, "n")


def over_limit(counts: DataFrame, most: int) -> DataFrame:
    """Windows above a limit; a limit of 0 or less allows all."""
    return counts.filter((F.lit(most) > 0) & (F.col("n") > most))


def apply_once(stream: DataFrame, op_id: str, ts: str, late: str) -> DataFrame:
    """Each operation id once within the watermark; state for older ids is dropped."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([op_id])


def sessions(stream: DataFrame, ts: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Session windows per key (an extension: windows that a gap closes)."""
    counted = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("session_window.start").alias("first_ts"), F.col("session_window.end").alias("end_ts"), *keys, "n")


def latest_snapshot(df: DataFrame, keys: list[str], fetched: str, now: Column, ttl_seconds: int) -> DataFrame:
    """Each key's latest row if it has not expired."""
    row = F.struct(*[F.col(c) for c in df.columns])
    latest = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(row, F.col(fetched)).alias("r")).select("r.*")
    return latest.filter(F.timestamp_diff("SECOND", F.col(fetched), now) < ttl_seconds)


def run_available(out: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what its source has now, into parquet files with exactly-once commits."""
    q = out.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
