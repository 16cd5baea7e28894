"""Short lists for people: featured rows, similar rows, fills from a pool, picks without repeats, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranking import numbered_top


def limit_then_filter(rows: DataFrame, order: list[Column], n: int, good: Column) -> DataFrame:
    """The first n rows, and only then those that are good: there can be fewer than n."""
    return rows.orderBy(*order).limit(n).filter(good)


def upcoming(rows: DataFrame, key: str, order: list[Column], n: int, today: Column) -> DataFrame:
    """Each key's first n rows with ``featured``: the first of today, else the first of all."""
    w = Window.partitionBy(key)
    top = rows.withColumn("_place", F.row_number().over(w.orderBy(*order))).filter(F.col("_place") <= n)
    chosen = F.coalesce(F.min(F.when(today, F.col("_place"))).over(w), F.min("_place").over(w))
    return top.withColumn("featured", F.col("_place") == chosen).withColumnRenamed("_place", "place")


def similar(rows: DataFrame, group: list[str], row_id: str, order: list[Column], k: int) -> DataFrame:
    """(row_id, other, place): for each row the first k others of its group, from a list of k + 1 a group."""
    w = Window.partitionBy(*group).orderBy(*order)
    few = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k + 1)
    lists = few.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_n", F.col(row_id).alias("other")))).alias("_list"))  # k + 1 items
    others = F.slice(F.filter("_list", lambda x: x["other"] != F.col(row_id)), 1, k)
    met = rows.join(lists, group).select(row_id, F.posexplode(others).alias("place", "x"))
    return met.select(row_id, F.col("x.other").alias("other"), (F.col("place") + 1).cast("long").alias("place"))


def filled(rows: DataFrame, wanted: Column, order: list[Column], n: int) -> DataFrame:
    """The first n wanted rows; where there are fewer, the first others fill up."""
    marked = rows.withColumn("filled", ~F.coalesce(wanted, F.lit(False)))
    return numbered_top(marked, [F.col("filled"), *order], n)


def pick(rows: DataFrame, key: str, row_id: str, category: str, order: Column, wanted: list[str]) -> DataFrame:
    """(key, turn, row_id): for each key and wanted category in turn its first row not yet picked, else any row not yet picked.

    Only the first ``len(wanted)`` rows of a category and of the key can ever be picked, so that many are gathered at most.
    """
    n = len(wanted)
    of_kind, of_all = (Window.partitionBy(*p).orderBy(order, row_id) for p in ((key, category), (key,)))
    few = rows.withColumn("_k", F.row_number().over(of_kind)).withColumn("_a", F.row_number().over(of_all))
    few = few.filter(((F.col("_k") <= n) & F.col(category).isin(*wanted)) | (F.col("_a") <= n))
    pools = few.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(row_id).alias("id"), F.col(category).alias("c")))).alias("pool"))
    id_type = rows.schema[row_id].dataType.simpleString()

    def step(picked: Column, c: Column) -> Column:
        left = F.filter("pool", lambda x: ~F.array_contains(picked, x["id"]))
        first = F.coalesce(F.get(F.filter(left, lambda x: x["c"] == c), F.lit(0)), F.get(left, F.lit(0)))
        return F.when(first.isNotNull(), F.array_append(picked, first["id"])).otherwise(picked)

    picked = F.aggregate(F.lit(wanted), F.lit([]).cast(f"array<{id_type}>"), step)
    return pools.select(key, F.posexplode(picked).alias("turn", row_id)).withColumn("turn", (F.col("turn") + 1).cast("long"))


def sections(rows: DataFrame, day: str, part: Column, order: list[str]) -> DataFrame:
    """(day, section, n, place): rows counted by day and section in display order; rows without a day come last as unscheduled."""
    named = rows.select(F.coalesce(F.col(day).cast("string"), F.lit("unscheduled")).alias("day"), F.when(F.col(day).isNull(), "unscheduled").otherwise(part).alias("section"))
    rank = F.array_position(F.lit([*order, "unscheduled"]), F.col("section"))
    counted = named.groupBy("day", "section").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(rank)).cast("long"))
