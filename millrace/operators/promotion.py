"""Review, promotion, retention and layered limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def promote(candidates: DataFrame, decisions: DataFrame, key: str, content: str, blocked: Column) -> DataFrame:
    """Every candidate with its outcome: approved, rejected, stale (decided on other content), review or automatic.

    ``decisions`` has key, decision and ``content``, the content hash it was made on; the last by ``decided`` counts.
    """
    last = decisions.groupBy(key).agg(F.max_by(F.struct("decision", F.col(content).alias("seen")), "decided").alias("d"))
    met = candidates.join(last, key, "left")
    outcome = (
        F.when(F.col("d").isNotNull() & (F.col("d.seen") != F.col(content)), "stale")
        .when(F.col("d.decision") == "approve", "approved")
        .when(F.col("d.decision").isNotNull(), "rejected")
        .when(F.coalesce(blocked, F.lit(True)), "review")
        .otherwise("automatic")
    )
    return met.withColumn("outcome", outcome).drop("d")


def layered_limits(df: DataFrame, keys: list[str], order: list[str], limits: dict[str, tuple[Column, int]]) -> DataFrame:
    """The first limit that a request exceeds, if any, and the tightest rest. ``limits``: name to (window column, most); 0 or less allows all."""
    for name, (window, _) in limits.items():
        df = df.withColumn(f"_w_{name}", window)
    used = {name: F.row_number().over(Window.partitionBy(*keys, f"_w_{name}").orderBy(*order)) for name in limits}
    df = df.withColumns({f"_u_{name}": u for name, u in used.items()})
    active = {name: most for name, (_, most) in limits.items() if most > 0}
    failed = F.coalesce(*[F.when(F.col(f"_u_{name}") > most, F.lit(name)) for name, most in active.items()], F.lit(None).cast("string"))
    rest = [F.greatest(F.lit(most) - F.col(f"_u_{name}"), F.lit(0)) for name, most in active.items()]
    tightest = F.least(*rest) if len(rest) > 1 else rest[0] if rest else F.lit(None).cast("int")
    return df.withColumn("failed", failed).withColumn("remaining", tightest).drop(*[f"_{p}_{n}" for p in "wu" for n in limits])


def retention(df: DataFrame, touched: str, live: Column, now: Column, idle_days: int, drop_days: int) -> DataFrame:
    """``fate``: keep, soft_delete (idle and without live children) or drop."""
    age = F.timestamp_diff("DAY", F.col(touched), now)
    return df.withColumn("fate", F.when(age >= drop_days, "drop").when((age >= idle_days) & ~live, "soft_delete").otherwise("keep"))
