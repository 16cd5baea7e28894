"""Dates, clock times, dayparts and schedules as Column expressions.

Timestamps without zone are local wall-clock time; none of these depends on the session's time zone.
Minutes of day are integers from 0 to 1439; days of the week count from 0, Sunday.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The days' two-letter beginnings in the order of their numbers.
DAYS = ["su", "mo", "tu", "we", "th", "fr", "sa"]


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds of a wall-clock timestamp since 1970."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def seconds_apart(start: Column, end: Column) -> Column:
    """Seconds from start to end by the clock: parts of a second are cut from both, so what lies half a second before the start is a second away if the clock's second differs."""
    second = lambda ts: F.timestamp_diff("SECOND", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"), ts)
    return second(end) - second(start)


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes from start to end, rounded half up."""
    return F.floor(F.timestamp_diff("SECOND", start, end) / 60.0 + 0.5).cast("long")


def day_number(day: Column) -> Column:
    return F.dayofweek(day) - 1


def minutes_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def daypart(minutes: Column) -> Column:
    """morning before 11, afternoon before 17, evening before 21, then late; null is untimed."""
    return F.when(minutes.isNull(), "untimed").when(minutes < 660, "morning").when(minutes < 1020, "afternoon").when(minutes < 1260, "evening").otherwise("late")


def span_daypart(start: Column, end: Column) -> Column:
    """anytime if it begins by 9, ends at 20 or later and takes 10 hours or more (past midnight wraps); else the start's daypart."""
    wrapped = F.when(end < start, end + 1440).otherwise(end)
    return F.when((start <= 540) & (wrapped >= 1200) & (wrapped - start >= 600), "anytime").otherwise(daypart(start))


def with_default_end(start: Column, end: Column, minutes: int) -> Column:
    return F.coalesce(end, F.timestamp_add("MINUTE", F.lit(minutes), start))


def live_state(start: Column, end: Column, now: Column, soon_minutes: int = 90, default_minutes: int = 120) -> Column:
    """unknown, live, soon, later_today, upcoming or ended, by the first that fits."""
    until = with_default_end(start, end, default_minutes)
    return (
        F.when(start.isNull(), "unknown")
        .when((start <= now) & (now <= until), "live")
        .when((start > now) & (F.timestamp_diff("SECOND", now, start) <= soon_minutes * 60), "soon")
        .when((start > now) & (F.to_date(start) == F.to_date(now)), "later_today")
        .when(start > now, "upcoming")
        .otherwise("ended")
    )


def parse_clock(text: Column, evening: Column | bool = True) -> Column:
    """Minutes of day of the first h:mm or h am/pm; 1 to 11 without am or pm are pm if ``evening``; null if there is none or it is no time."""
    pattern = r"(?i)(?:^|[^0-9:])([0-9]{1,2})(?::([0-9]{2}))?\s*(am|pm)?(?![0-9:])"
    hour = F.regexp_extract(text, pattern, 1).try_cast("int")
    minute = F.coalesce(F.regexp_extract(text, pattern, 2).try_cast("int"), F.lit(0))
    half = F.lower(F.regexp_extract(text, pattern, 3))
    flag = F.lit(evening) if isinstance(evening, bool) else evening
    on24 = (
        F.when((half == "pm") & (hour < 12), hour + 12)
        .when((half == "am") & (hour == 12), F.lit(0))
        .when((half == "") & flag & hour.between(1, 11), hour + 12)
        .otherwise(hour)
    )
    good = hour.isNotNull() & (minute < 60) & F.when(half == "", hour < 24).otherwise(hour.between(1, 12))
    return F.when(good, on24 * 60 + minute)


def clock_label(minutes: Column) -> Column:
    """Minutes of day as 7:05 PM."""
    hour = F.floor(minutes / 60)
    on12 = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.concat(on12.cast("string"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"), F.when(hour < 12, " AM").otherwise(" PM"))


def day_range(first: Column, last: Column) -> Column:
    """Days from first to last, past Saturday on to Sunday."""
    return F.transform(F.sequence(F.lit(0), F.pmod(last - first, F.lit(7))), lambda k: F.pmod(first + k, F.lit(7)))


def parse_days(text: Column) -> Column:
    """The sorted days of a day list, as numbers.

    Understands days by their usual short and full names, ranges with a dash (wrapping), lists, weekdays and weekends. Null is
    every day: for daily, every day, and texts without a day.
    """
    flat = F.lower(F.coalesce(text, F.lit("")))
    word = "(?:sun|mon|tue|tues|wed|thu|thur|thurs|fri|sat)(?:days?|nesdays?|urdays?)?"
    number = lambda w: (F.array_position(F.lit(DAYS), F.substring(w, 1, 2)) - 1).cast("int")
    parts = F.regexp_extract_all(flat, F.lit(rf"\b{word}(?:\s*-\s*{word})?\b"), F.lit(0))
    ranges = F.transform(
        parts,
        lambda p: F.when(p.contains("-"), day_range(number(F.trim(F.split_part(p, F.lit("-"), F.lit(1)))), number(F.trim(F.split_part(p, F.lit("-"), F.lit(2)))))).otherwise(F.array(number(p))),
    )
    named = F.when(flat.contains("weekday"), F.lit([1, 2, 3, 4, 5])).when(flat.contains("weekend"), F.lit([0, 6])).otherwise(F.array_sort(F.array_distinct(F.flatten(ranges))))
    return F.when(flat.rlike(r"\b(daily|every ?day)\b") | (F.size(named) == 0), F.lit(None)).otherwise(named)


def next_day_on(day: Column, wanted: Column) -> Column:
    """The first date on or after ``day`` with that number."""
    return F.date_add(day, F.pmod(wanted - day_number(day), F.lit(7)).cast("int"))


def horizon(hours: Column) -> Column:
    """Which forecast serves a time so many hours away."""
    return F.when(hours < 0, "past").when(hours <= 72, "hourly").when(hours <= 168, "daily").when(hours <= 360, "outlook").otherwise("none")


def fiscal_quarter(day: Column, first_month: int = 10) -> Column:
    """FY24-Q1 and so on: the fiscal year of October 2023 is 2024."""
    shifted = F.add_months(day, 13 - first_month) if first_month > 1 else day
    return F.concat(F.lit("FY"), F.date_format(shifted, "yy"), F.lit("-Q"), F.quarter(shifted).cast("string"))


def window_start(ts: Column, seconds: int) -> Column:
    """The start of the fixed window, aligned to 1970, in epoch seconds."""
    at = epoch_seconds(ts)
    return at - F.pmod(at, F.lit(seconds))


def relative_status(minutes: Column, now: Column, near: int = 75) -> Column:
    """now within so many minutes of a time of day, else past or later."""
    return F.when(F.abs(minutes - now) <= near, "now").when(minutes < now, "past").otherwise("later")


def on_scale(value: Column, domain: tuple[int, int], to: tuple[int, int]) -> Column:
    """A value's place on a linear scale, rounded half up and kept between its ends."""
    (a, b), (lo, hi) = domain, to
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.floor(lo + (value - a) * (hi - lo) / float(b - a) + 0.5))).cast("long")


def proper_end(start: Column, end: Column, minutes: int) -> Column:
    """The end if it isn't before the start, else so many minutes after the start."""
    return F.when(end.isNull() | (end < start), F.timestamp_add("MINUTE", F.lit(minutes), start)).otherwise(end)


def display_time(start: Column, end: Column, text: Column, text_label: Column, text_range: Column, doubtful: Column) -> Column:
    """(label, uncertain) of local times and a schedule text: what its text says, unless that is doubtful or a default of a whole day.

    ``text_label`` is what the text was read as (null: it wasn't), ``text_range`` whether it names an end, ``doubtful`` whether it says that times are open. Ends before their
    start and whole days without an explicit range need confirmation. Long texts that can't be read are cut with an ellipsis, as labels are.
    """
    said = lambda label, uncertain: F.struct(label.cast("string").alias("label"), uncertain.alias("uncertain"))
    yes, no, none = F.lit(True), F.lit(False), F.lit(None)
    confirm = said(F.lit("Time needs confirmation"), yes)
    default = F.coalesce(span_daypart(minutes_of_day(start), minutes_of_day(end)) == "anytime", no)
    clock = lambda x: clock_label(minutes_of_day(x))
    spoken = F.coalesce(text, F.lit("")) != ""
    cut = F.when(F.length(text) > 80, F.concat(F.substring(text, 1, 77), F.lit("\u2026"))).otherwise(text)
    by_text = F.when(default & ~F.coalesce(text_range, no), confirm).when(text_label.isNotNull(), said(text_label, no)).when(start.isNull(), said(none, no)).otherwise(said(cut, no))
    both = F.when(clock(start) == clock(end), clock(start)).otherwise(F.concat_ws(" \u2013 ", clock(start), clock(end)))
    by_times = F.when(default, confirm).when(start.isNull(), said(none, no)).when(end.isNull(), said(clock(start), ~spoken)).otherwise(said(both, no))
    unsure = F.coalesce(doubtful, no)
    return F.when(end < start, confirm).when(spoken & ~unsure, by_text).when(spoken & start.isNull(), said(none, no)).when(spoken, confirm).otherwise(by_times)
