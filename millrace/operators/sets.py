"""Keyed comparison of two tables and set operations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, status, changed): added, removed, changed (with the names of differing fields) or same; nulls equal each other."""
    a = old.select(key, F.struct(*fields).alias("a"))
    b = new.select(key, F.struct(*fields).alias("b"))
    names = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]))
    met = a.join(b, key, "full")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(names) > 0, "changed").otherwise("same")
    return met.select(key, status.alias("status"), F.when(status == "changed", F.array_join(names, ",")).alias("changed"))


def tagged_union(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """UNION ALL of tables of one schema, each row with its table's name."""
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def merge_identical(df: DataFrame, keys: list[str], array: str, position: str) -> DataFrame:
    """One row per identity: the union of an array column in sorted order, the first position and how many rows merged."""
    return df.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(array)))).alias(array), F.min(position).alias(position), F.count(F.lit(1)).alias("merged")
    )


def equivalence_diff(old: DataFrame, new: DataFrame, key: str, relations: dict[str, list[tuple[str, Callable[[Column, Column], Column]]]], state: str | None = None, blocking: tuple[str, ...] = ()) -> DataFrame:
    """(key, kind, field, was, now, rule, blocks): what differs between two versions of a keyed table, given what counts as equal in each field.

    ``relations`` has for each field its equivalences (name, function of the old row and the new one), tried in turn; both rows are structs, so that an
    equivalence can look at other fields. A field whose values are equal or both null has no row; an ``equivalent`` one has the name of the first equivalence that
    holds as ``rule``; others are ``changed``. Keys of one side are ``missing`` or ``new``. ``state`` names a column whose change is a ``transition``
    and has a row of its own. Changes of ``blocking`` fields and missing keys block.
    """
    fields = [*relations] + ([state] if state else [])
    a, b = old.select(key, F.struct(*fields).alias("a")), new.select(key, F.struct(*fields).alias("b"))
    met = a.join(b, key, "full").withColumn("both", F.col("a").isNotNull() & F.col("b").isNotNull())

    def row(kind: Column | str, field: str | None, was: Column | None, now: Column | None, rule: Column | None, blocks: bool | Column) -> Column:
        text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.lit(field).cast("string").alias("field"), text(was).alias("was"), text(now).alias("now"), text(rule).alias("rule"), (F.lit(blocks) if isinstance(blocks, bool) else blocks).alias("blocks"))

    rows = [F.when(F.col("b").isNull(), row("missing", None, None, None, None, True)), F.when(F.col("a").isNull(), row("new", None, None, None, None, False))]
    for f, rules in relations.items():
        was, now = F.col("a")[f], F.col("b")[f]
        held = F.coalesce(*[F.when(holds(F.col("a"), F.col("b")), F.lit(name)) for name, holds in rules], F.lit(None).cast("string"))
        kind = F.when(held.isNull(), "changed").otherwise("equivalent")
        rows.append(F.when(F.col("both") & ~was.eqNullSafe(now), row(kind, f, was, now, held, F.lit(f in blocking) & held.isNull())))
    if state:
        was, now = F.col("a")[state], F.col("b")[state]
        rows.append(F.when(F.col("both") & ~was.eqNullSafe(now), row("transition", state, was, now, None, False)))
    return met.select(key, F.inline(F.array_compact(F.array(*rows))))
