"""Interval, nearest, fallback and exclusion joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.temporal import epoch_seconds


def _slots(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(epoch_seconds(start) / width), F.floor(epoch_seconds(end) / width))


def overlap_pairs(df: DataFrame, keys: list[str], row_id: str, start: str, end: str, slot_seconds: int = 3600) -> DataFrame:
    """(keys, id_a, id_b, minutes) of intervals of a key that overlap, each pair once.

    Both sides are dealt to time slots and joined on (key, slot), so that a busy key spreads over its slots; a pair
    that shares several slots counts in the first, the slot of the later start.
    """
    side = df.select(*keys, F.col(row_id).alias("id"), F.col(start).alias("s"), F.col(end).alias("e"), F.explode(_slots(F.col(start), F.col(end), slot_seconds)).alias("slot"))
    a, b = (side.select(*keys, "slot", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "s", "e")]) for x in "ab")
    later, sooner = F.greatest("s_a", "s_b"), F.least("e_a", "e_b")
    met = a.join(b, [*keys, "slot"]).filter((F.col("id_a") < F.col("id_b")) & (F.col("s_a") < F.col("e_b")) & (F.col("s_b") < F.col("e_a")))
    met = met.filter(F.col("slot") == F.floor(epoch_seconds(later) / slot_seconds))
    return met.select(*keys, "id_a", "id_b", F.floor(F.timestamp_diff("SECOND", later, sooner) / 60.0 + 0.5).cast("long").alias("minutes"))


def worst_in_span(spans: DataFrame, span_id: str, start: str, end: str, hours: DataFrame, hour: str, severity: str, reach_hours: int = 2, slot_seconds: int = 86400) -> DataFrame:
    """For each span, the worst hour in it (ties: the earliest), else the nearest hour within reach, else null.

    A range join on day slots; reach bounds the slots each span is dealt to.
    """
    reach = F.lit(reach_hours * 3600)
    slots = F.sequence(F.floor((epoch_seconds(F.col(start)) - reach) / slot_seconds), F.floor((epoch_seconds(F.col(end)) + reach) / slot_seconds))
    left = spans.select(span_id, F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(slots).alias("_slot"))
    right = hours.select(F.col(hour).alias("_h"), F.col(severity).alias("_v"), F.floor(epoch_seconds(F.col(hour)) / slot_seconds).alias("_slot"))
    away = F.greatest(F.timestamp_diff("SECOND", F.col("_h"), F.col("_s")), F.timestamp_diff("SECOND", F.col("_e"), F.col("_h")), F.lit(0))
    met = left.join(right, "_slot").withColumn("_away", away).filter(F.col("_away") <= reach)
    inside = F.when(F.col("_away") == 0, -F.col("_v")).otherwise(F.lit(0))
    best = met.groupBy(span_id).agg(F.min_by(F.struct("_h", "_v", "_away"), F.struct("_away", inside, F.col("_h"))).alias("b"))
    return spans.select(span_id).join(best, span_id, "left").select(span_id, F.col("b._h").alias("hour"), F.col("b._v").alias("severity"), (F.col("b._away") == 0).alias("inside"))


def lookup(df: DataFrame, table: DataFrame, key: str, values: dict[str, object]) -> DataFrame:
    """Columns of a lookup table by key, with defaults where it has none."""
    joined = df.join(table.select(key, *values), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def exclude(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the other table lacks; rows with a null key stay."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def either_key(df: DataFrame, other: DataFrame, left: str, right: str, key: str) -> DataFrame:
    """Rows of ``df`` joined by ``left = key or right = key`` as two equality joins; a row that fits by both counts once."""
    one = df.join(other, df[left] == other[key])
    two = df.filter(~F.col(left).eqNullSafe(F.col(right))).join(other, df[right] == other[key])
    return one.union(two)


def mutually_unique(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose two sides are in no other pair."""
    n = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c))
    return pairs.withColumn("_a", n(a)).withColumn("_b", n(b)).filter("_a = 1 and _b = 1").drop("_a", "_b")


def in_range(spans: DataFrame, points: DataFrame, same: tuple[Column, Column], span: tuple[str, str], at: str, slot_seconds: int = 3600) -> DataFrame:
    """Spans joined with the points of the same key from start to end, both ends included; both sides are dealt to time slots."""
    left = spans.withColumn("_key", same[0]).withColumn("_slot", F.explode(_slots(F.col(span[0]), F.col(span[1]), slot_seconds)))
    right = points.withColumn("_key", same[1]).withColumn("_slot", F.floor(epoch_seconds(F.col(at)) / slot_seconds))
    return left.join(right, ["_key", "_slot"]).filter((F.col(at) >= F.col(span[0])) & (F.col(at) <= F.col(span[1]))).drop("_key", "_slot")


def equal_or_first(df: DataFrame, table: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows with the table's row of their key, else with its first row by key (none if the table is empty)."""
    first = table.agg(F.min_by(F.struct(key, *values), key).alias("_first"))  # one row
    met = df.join(table.select(F.col(key).alias("_key"), *values), F.col(key) == F.col("_key"), "left").join(F.broadcast(first), F.lit(True))
    took = lambda c, own: F.when(F.col("_key").isNotNull(), F.col(own)).otherwise(F.col("_first")[c]).alias(c)
    return met.select(*[c for c in df.columns if c != key], took(key, key), *[took(v, v) for v in values])


def best_snapshot(expected: DataFrame, snapshots: DataFrame, key: str, exact: list[str], optional: list[str], position: str, values: list[str]) -> DataFrame:
    """``expected`` with ``values`` of its key's best snapshot: the first by position that has its ``exact`` columns and the ``optional`` ones it names, else the first of all.

    Nulls of ``exact`` columns equal each other; a null optional column of ``expected`` asks for nothing, and rows that name no column at all take the first.
    ``fits`` tells whether the snapshot has what was asked for (null without a snapshot). Equal rows of ``expected`` count once. Snapshots are reduced to the first of each kind before the join, so a key with
    many snapshots meets each expected row once a kind; one aggregate then picks by (fits, position).
    """
    asked = [*exact, *optional]
    kinds = snapshots.groupBy(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in asked]).agg(F.min_by(F.struct(*values), position).alias("_v"), F.min(position).alias("_p"))
    rows = expected.withColumn("_row", F.struct(*[F.col(c) for c in expected.columns]))
    named = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(True)) for c in asked], F.lit(False))
    equal = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in exact] + [F.col(c).isNull() | F.col(c).eqNullSafe(F.col(f"_{c}")) for c in optional]
    fits = named
    for e in equal:
        fits = fits & e
    met = rows.join(kinds, F.col(key) == F.col("_k"), "left").withColumn("_fits", F.when(F.col("_k").isNotNull(), fits))
    best = F.min_by(F.struct(F.col("_v"), F.col("_fits")), F.struct(~F.col("_fits"), F.col("_p")))
    picked = met.groupBy("_row").agg(best.alias("_b"))
    return picked.select("_row.*", *[F.col(f"_b._v.{v}").alias(v) for v in values], F.col("_b._fits").alias("fits"))


def members(df: DataFrame, array: str, other: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` joined with the rows of ``other`` whose key their array holds, each pair once, however often the array holds it.

    The array is made an index of its different members and joined on equality, so no pair of rows is looked at in vain; adaptive execution splits the rows of a
    member that many arrays hold. Null and empty arrays and null members hold nothing.
    """
    index = df.withColumn("_member", F.explode(F.array_distinct(F.array_compact(array))))
    return index.join(other, F.col("_member") == other[key]).drop("_member")
