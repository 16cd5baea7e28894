"""Instants and wall clocks of a named time zone as Column expressions.

Instants are timestamps without zone that hold UTC, so nothing depends on the session's zone. Wall clocks that a change of offset skips
move on by the gap; those that come twice are the first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_wall(instant: Column, zone: str) -> Column:
    """The wall clock of an instant."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), instant)


def to_instant(wall: Column, zone: str) -> Column:
    """The instant of a wall clock."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)


def at_time(day: Column, clock: Column, zone: str) -> Column:
    """The instant of h:mm or h:mm:ss on a calendar day; null for null and for texts that are no time."""
    part = lambda k: F.lpad(F.coalesce(F.get(F.split(clock, ":"), F.lit(k)), F.lit("00")), 2, "0")
    wall = F.concat(day.cast("string"), F.lit(" "), part(0), F.lit(":"), part(1), F.lit(":"), part(2))
    return F.when(clock.isNotNull(), to_instant(wall.try_cast("timestamp_ntz"), zone))


def at_minutes(day: Column, minutes: Column, zone: str) -> Column:
    """The instant of a minute of a calendar day; null for null and for what is no minute of a day."""
    return F.when(minutes.between(0, 1439), to_instant(F.timestamp_add("MINUTE", minutes, day.cast("timestamp_ntz")), zone))


def local_date(instant: Column, zone: str) -> Column:
    return F.to_date(to_wall(instant, zone))


def offset_minutes(instant: Column, zone: str) -> Column:
    """Minutes that the wall clock is ahead of UTC."""
    return F.timestamp_diff("MINUTE", instant, to_wall(instant, zone))


def iso(instant: Column, zone: str) -> Column:
    """2024-07-01T08:00:00-04:00."""
    offset = offset_minutes(instant, zone)
    ahead = F.abs(offset)
    two = lambda n: F.lpad(F.floor(n).cast("string"), 2, "0")
    return F.concat(F.date_format(to_wall(instant, zone), "yyyy-MM-dd'T'HH:mm:ss"), F.when(offset < 0, "-").otherwise("+"), two(ahead / 60), F.lit(":"), two(ahead % 60))


def day_start(day: Column, zone: str) -> Column:
    return to_instant(day.cast("timestamp_ntz"), zone)


def day_end(day: Column, zone: str) -> Column:
    """23:59:59 on the wall clock."""
    return to_instant(F.timestamp_add("SECOND", F.lit(86399), day.cast("timestamp_ntz")), zone)


def add_days(day: Column, days: Column | int, zone: str) -> Column:
    """The calendar day so many days on, counted from noon so that changes of offset don't matter."""
    noon = to_instant(F.timestamp_add("HOUR", F.lit(12), day.cast("timestamp_ntz")), zone)
    return local_date(F.timestamp_add("DAY", F.lit(days) if isinstance(days, int) else days, noon), zone)


def time_window(wall: Column, dinner: int = 17, late: int = 19) -> Column:
    """daytime before the dinner hour, dinner until the late hour, then late; unknown without a time."""
    hour = F.hour(wall)
    return F.when(wall.isNull(), "unknown").when(hour >= late, "late").when(hour >= dinner, "dinner").otherwise("daytime")
