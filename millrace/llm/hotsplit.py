"""Splitting hot groups of an all-pairs comparison into bounded blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_blocks(rows: DataFrame, keys: list[str], member: Column, block: int) -> DataFrame:
    """Deal the rows of every group over tasks of about two blocks, so that any two rows of a group meet.

    A group of up to ``block`` rows stays whole (``i`` = ``j`` = 0). A larger one is cut
    into chunks by a hash of ``member``; each pair of chunks (i, j) becomes a group of its own, where
    the rows of chunk i and of chunk j meet (column ``chunk`` tells which). Groups of one row are
    dropped: they have no pair. Pairs within chunk i belong to the group (i, i).
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    dealt = rows.join(counts, keys).withColumn("_g", F.ceil(F.col("_n") / block).cast("int"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64(member, F.lit(7)), F.col("_g")).cast("int"))
    return (
        dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
        .withColumn("i", F.least("chunk", "_other"))
        .withColumn("j", F.greatest("chunk", "_other"))
        .drop("_n", "_g", "_other")
    )
