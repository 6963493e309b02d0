"""Clock and calendar columns on zone-less local time (TIMESTAMP_NTZ); none depends on the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Day and month names in order.
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def valid_clock(hhmm: Column) -> Column:
    """True for 0 to 2400 with minutes below 60; null stays null."""
    return hhmm.between(0, 2400) & (hhmm % 100 < 60)


def clock_timestamp(date: Column, hhmm: Column) -> Column:
    """Local time from a date and a clock number such as 856; 2400 is midnight of the next day, a bad number raises."""
    t = hhmm.cast("int")
    bad = F.raise_error(F.concat(F.lit("not a clock time: "), t.cast("string")))
    span = F.make_dt_interval(F.lit(0), F.floor(t / 100).cast("int"), (t % 100).cast("int"))
    return F.when(t.isNull(), F.lit(None)).when(valid_clock(t), date.cast("timestamp_ntz") + span).otherwise(bad.cast("timestamp_ntz"))


def floor_hour(ts: Column) -> Column:
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.minute(ts), F.date_part(F.lit("SECOND"), ts))


def minutes_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(6e7)


def to_zone(ts: Column, source: Column, target: Column) -> Column:
    """Local time at ``target`` of local time ``ts`` at ``source``.

    A time that the source clock skips counts as the first one after the gap; one that it shows twice
    is null, and so is an unknown zone.
    """
    hour = F.make_dt_interval(F.lit(0), F.lit(1))
    utc = F.convert_timezone(source, F.lit("UTC"), ts)
    back = F.convert_timezone(F.lit("UTC"), source, utc)
    skipped = F.convert_timezone(source, F.lit("UTC"), floor_hour(back))
    instant = F.when(back != ts, skipped).when(F.convert_timezone(F.lit("UTC"), source, utc + hour) == ts, F.lit(None)).otherwise(utc)
    return F.convert_timezone(F.lit("UTC"), target, instant)


def arrival_hour(departure: Column, elapsed_minutes: Column) -> Column:
    """Hour that contains departure plus scheduled minutes, on the clock of ``departure``."""
    return floor_hour(departure + F.make_dt_interval(F.lit(0), F.lit(0), elapsed_minutes.cast("int")))


def month_start(date: Column) -> Column:
    return F.trunc(date, "MM")


def period(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def days_in_month(date: Column) -> Column:
    return F.day(F.last_day(date))


def weekday_name(number: Column) -> Column:
    """Name of a weekday number, 1 for Monday."""
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), number.cast("int"))


def month_name(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), number.cast("int"))


def day_number(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date"))
