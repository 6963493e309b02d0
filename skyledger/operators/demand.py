"""Scheduled demand: how many flights leave and arrive in the same hours, cancelled ones among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.times import arrival_hour
from skyledger.operators.contracts import ContractError, forbid_columns, require_columns

OUTPUTS = ("origin_sched_deps_this_hour", "origin_sched_arrivals_this_hour", "origin_sched_ops_this_hour", "dest_sched_arrivals_this_hour")


def add_schedule_demand(scheduled: DataFrame, rows: DataFrame, origin: str = "Origin", dest: str = "Dest", hour: str = "dep_hour_local", dest_hour: str = "dest_departure_hour_local", dest_time: str = "dest_departure_time_local", elapsed: str = "CRSElapsedTime") -> DataFrame:
    """``rows`` with counts over all ``scheduled`` flights: departures and arrivals at the origin in the
    departure hour, their sum, and arrivals at the destination in that hour on its own clock.

    Both counts are grouped before they are joined. A row whose departure is not among the scheduled
    flights raises.
    """
    require_columns(scheduled, [origin, dest, hour, dest_time, elapsed])
    forbid_columns(require_columns(rows, [origin, dest, hour, dest_hour]), OUTPUTS)
    deps = scheduled.groupBy(origin, hour).agg(F.count("*").alias("__deps"))
    at = arrival_hour(F.col(dest_time), F.col(elapsed))
    arrivals = scheduled.select(F.col(dest).alias("__port"), at.alias("__at")).filter("__at is not null").groupBy("__port", "__at").agg(F.count("*").alias("__arr"))
    out = rows.join(deps, [origin, hour], "left")
    here = arrivals.select(F.col("__port").alias(origin), F.col("__at").alias(hour), F.col("__arr").alias("__here"))
    there = arrivals.select(F.col("__port").alias(dest), F.col("__at").alias(dest_hour), F.col("__arr").alias("__there"))
    out = out.join(here, [origin, hour], "left").join(there, [dest, dest_hour], "left")
    known = F.coalesce(F.col("__deps").cast("int"), F.raise_error(F.lit("a row's departure is not scheduled")).cast("int"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    return out.select(*rows.columns, known.alias(OUTPUTS[0]), n("__here").alias(OUTPUTS[1]), (known + n("__here")).alias(OUTPUTS[2]), n("__there").alias(OUTPUTS[3]))


def require_demand(rows: DataFrame) -> DataFrame:
    """Every row counts itself at least."""
    if not rows.filter(F.col(OUTPUTS[0]) < 1).isEmpty():
        raise ContractError("a departure hour without its own flight")
    return rows
