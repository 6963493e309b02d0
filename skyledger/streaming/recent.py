"""Streaming twin of the recent rates: daily counts as they arrive, then the same lagged windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.stats import ratio
from skyledger.functions.times import day_number


def daily_counts(stream: DataFrame, time: str, target: str, lateness: str = "1 day") -> DataFrame:
    """(date, p, n) of each day of a stream of outcomes; a day is final when the watermark has passed it."""
    instant = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(time).cast("timestamp_ntz")))
    days = stream.withColumn("__ts", instant).withWatermark("__ts", lateness).groupBy(F.window("__ts", "1 day"))  # local days, whatever the session's zone
    day = F.date_from_unix_date(F.floor(F.unix_seconds("window.start") / 86400).cast("int"))
    return days.agg(F.sum(F.col(target).cast("long")).alias("p"), F.count("*").alias("n")).select(day.alias("date"), "p", "n")


def lagged_rate(daily: DataFrame, days: int = 7, lag: int = 2, prior: float = 0.20) -> DataFrame:
    """(date, rate) over the days that end ``lag`` days before, from finished daily counts."""
    past = daily.select((day_number(F.col("date"))).alias("__past"), "p", "n")
    asked = daily.select("date", F.explode(F.sequence(day_number(F.col("date")) - (days + lag - 1), day_number(F.col("date")) - lag)).alias("__past"))
    sums = asked.join(past, "__past", "left").groupBy("date").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select("date", F.coalesce(ratio(F.col("p"), F.col("n")), F.lit(prior)).alias("rate"))
