"""Recurring rules expanded over a span of dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import schedules, zoned
from millrace.functions.temporal import day_number


def expand(rules: DataFrame, first: Column, days: int, weekday: str, valid_from: str | None = None, valid_until: str | None = None) -> DataFrame:
    """A row for each date of the span on which a rule holds, as column ``day``.

    A null weekday means every day; null bounds are open. Each rule makes its own dates, so nothing is shuffled.
    """
    span = F.sequence(first, F.date_add(first, days - 1))
    fits = lambda d: (
        (F.col(weekday).isNull() | (day_number(d) == F.col(weekday)))
        & (F.lit(True) if valid_from is None else F.coalesce(d >= F.col(valid_from), F.lit(True)))
        & (F.lit(True) if valid_until is None else F.coalesce(d <= F.col(valid_until), F.lit(True)))
    )
    return rules.withColumn("day", F.explode(F.filter(span, fits)))


def _dated(day: Column, zone: str) -> Column:
    """(day, number, begins, plain): a date with its day of the week, its first instant and whether its clocks don't change, so that its other instants follow by adding."""
    begins = zoned.day_start(day, zone)
    plain = zoned.day_start(F.date_add(day, 1), zone) == F.timestamp_add("HOUR", F.lit(24), begins)
    return F.struct(day.alias("day"), day_number(day).alias("number"), begins.alias("begins"), plain.alias("plain"))


def occurrences(items: DataFrame, rules: DataFrame, item: str, first: Column, days: int, zone: str, default_hours: int = 2) -> DataFrame:
    """The timed occurrences of items over a span of dates: ``item``, day, start, finish (instants in UTC), notes and whether they were synthesised.

    ``items`` has ``item``, evening (whether its category is one of the evening) and text; ``rules`` has ``item``, weekday (0 is Sunday, null any), daily, start and
    finish (h:mm texts) and notes. A rule holds on its weekday; its notes, or else the item's text, give the start and, if they name two times, the end; else the
    rule does. An end that equals the start is none. An item without any rule occurs on every day of the span if it has a text, at the
    text's time, for ``default_hours``; an item whose rules don't hold on a day doesn't occur that day.

    The outer join tells both cases apart by itself, so nothing is counted or collected; dates are made in place, row by row, and a rule is read before them. Wall clocks are read in ``zone``.
    """
    ruled = rules.select(F.col(item).alias("_item"), "weekday", F.coalesce("daily", F.lit(False)).alias("daily"), F.col("start").alias("_from"), F.col("finish").alias("_to"), F.col("notes").alias("_notes"), F.lit(True).alias("_ruled"))
    both = items.select(item, F.coalesce("evening", F.lit(False)).alias("evening"), "text").join(ruled, F.col(item) == F.col("_item"), "left")
    said = F.coalesce("_notes", "text")
    both = both.withColumn("made", F.col("_ruled").isNull()).withColumn("notes", said).filter(~F.col("made") | (F.coalesce("text", F.lit("")) != ""))
    span = F.array(*[_dated(F.date_add(first, k), zone) for k in range(days)])  # computed once, if the first date is a constant
    holds = lambda d: F.col("made") | F.col("daily") | F.col("weekday").isNull() | (d["number"] == F.col("weekday"))
    timed = both.withColumn("_at", schedules.rule_span(F.col("_from"), F.col("_to"), F.col("notes"), F.col("evening")))  # below the explosion: texts are read once a rule
    each = timed.withColumn("_d", F.explode(F.filter(span, holds))).withColumn("day", F.col("_d.day"))

    def instant(minutes: Column) -> Column:
        plain = F.timestamp_add("MINUTE", F.when(minutes.between(0, 1439), minutes), F.col("_d.begins"))
        return F.when(F.col("_d.plain"), plain).otherwise(zoned.at_minutes(F.col("day"), minutes, zone))

    begins = instant(F.col("_at.start"))
    ends = F.when(F.col("made"), F.timestamp_add("HOUR", F.lit(default_hours), begins)).otherwise(instant(F.col("_at.finish")))
    return each.select(item, "day", begins.alias("start"), ends.alias("finish"), "notes", "made")
