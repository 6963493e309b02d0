"""US holidays by rule, distances to the neighbouring ones, and windows around them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.operators.contracts import ContractError, forbid_columns, require_columns
from skyledger.operators.joins import days

#: Fixed values: (name, month, day) of fixed dates and (name, month, weekday from Monday = 0, which one,
#: -1 for the last) of moving ones.
FIXED = (("New Year's Day", 1, 1), ("Juneteenth National Independence Day", 6, 19), ("Independence Day", 7, 4), ("Veterans Day", 11, 11), ("Christmas Day", 12, 25))
MOVING = (
    ("Martin Luther King Jr. Day", 1, 0, 3), ("Washington's Birthday", 2, 0, 3), ("Memorial Day", 5, 0, -1),
    ("Labor Day", 9, 0, 1), ("Columbus Day", 10, 0, 2), ("Thanksgiving Day", 11, 3, 4),
)
COLUMNS = ("days_to_next_holiday", "days_since_prev_holiday", "next_holiday_name", "prev_holiday_name")


def us_holidays(years: range) -> list[tuple[dt.date, str]]:
    """Holidays of whole years in order. A fixed date on a weekend also has an observed day: the Friday
    before a Saturday, the Monday after a Sunday. Names that share a day are joined."""
    found: dict[dt.date, list[str]] = {}
    for y in years:
        for name, month, day in FIXED:
            date = dt.date(y, month, day)
            found.setdefault(date, []).append(name)
            if shift := {5: -1, 6: 1}.get(date.weekday()):
                found.setdefault(date + dt.timedelta(shift), []).append(f"{name} (observed)")
        for name, month, weekday, n in MOVING:
            first = dt.date(y, month, 1)
            date = first + dt.timedelta((weekday - first.weekday()) % 7)
            last = dt.date(y + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
            found.setdefault(date + dt.timedelta(7 * (n - 1)) if n > 0 else last - dt.timedelta((last.weekday() - weekday) % 7), []).append(name)
    return sorted((d, "; ".join(names)) for d, names in found.items())


def holiday_calendar(spark: SparkSession, start: dt.date | str, end: dt.date | str, date_col: str = "FlightDate") -> DataFrame:
    """One row for each day: distances and names of the next and the previous holiday, 0 on the day itself."""
    first, last = (dt.date.fromisoformat(x) if isinstance(x, str) else x for x in (start, end))
    if first > last:
        raise ContractError("start lies after end")
    rows = us_holidays(range(first.year - 1, last.year + 2))
    holidays = spark.createDataFrame(rows, "date date, name string")
    every = days(spark, rows[0][0], rows[-1][0]).join(F.broadcast(holidays), "date", "left")
    mark = F.when(F.col("name").isNotNull(), F.struct("date", "name"))
    w = Window.orderBy("date")  # some hundred days a year
    every = every.select("date", F.first(mark, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("n"), F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("p"))
    return every.filter(F.col("date").between(F.lit(first), F.lit(last))).select(
        F.col("date").alias(date_col), F.datediff("n.date", "date").cast("smallint").alias(COLUMNS[0]), F.datediff("date", "p.date").cast("smallint").alias(COLUMNS[1]),
        F.col("n.name").alias(COLUMNS[2]), F.col("p.name").alias(COLUMNS[3]),
    )


def add_holidays(df: DataFrame, date_col: str = "FlightDate") -> DataFrame:
    """``df`` with the calendar's four columns; a date that is none raises."""
    forbid_columns(require_columns(df, [date_col]), COLUMNS)
    dated = df.withColumn("__date", F.col(date_col).cast("string").substr(1, 10).try_cast("date"))
    ends = dated.agg(F.min("__date").alias("a"), F.max("__date").alias("z"), F.count_if(F.col("__date").isNull()).alias("bad")).first()
    if ends.bad:
        raise ContractError(f"date is missing or unreadable: {ends.bad} rows")
    day = dt.date(2024, 1, 1)  # of an empty table: any
    calendar = holiday_calendar(df.sparkSession, ends.a or day, ends.z or day, "__date")
    return dated.join(F.broadcast(calendar), "__date", "left").drop("__date")  # one row for each day


def event_name(holiday: Column) -> Column:
    """The four holidays whose windows are compared; others are null."""
    has = lambda text: F.lower(holiday).contains(text)
    return F.when(has("independence"), "Independence Day").when(has("new year"), "New Year's Day").when(has("christmas"), "Christmas").when(has("thanksgiving"), "Thanksgiving")


def event_windows(daily: DataFrame, date_col: str = "FlightDate", reach: int = 7) -> DataFrame:
    """``daily`` rows within ``reach`` days of a compared holiday with ``holiday`` and ``event_day``, once each."""
    side = lambda days_, name, sign: daily.filter(F.col(days_).between(0, reach)).withColumns({"holiday": event_name(F.col(name)), "event_day": sign * F.col(days_).cast("int")})
    both = side(COLUMNS[0], COLUMNS[2], -1).unionByName(side(COLUMNS[1], COLUMNS[3], 1))
    return both.filter("holiday is not null").dropDuplicates([date_col, "holiday", "event_day"])
