"""Joins with a stated cardinality and the sets they are made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join where a null key meets a null key; ``right`` is unique by construction (a grouped table)."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        on = same if on is None else on & same
    return left.join(renamed, on, "left").drop(*(f"__r_{k}" for k in keys))


def dense(groups: DataFrame, axis: DataFrame) -> DataFrame:
    """Every group at every point of a small axis (a calendar): the product is the result that is asked for."""
    return groups.crossJoin(F.broadcast(axis))


def days(spark, first, last) -> DataFrame:
    """(date) for each day of a closed range."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))).alias("date"))


def calendar_of(df: DataFrame, date: str) -> DataFrame:
    """(date) for each day from the first to the last of ``df``."""
    ends = df.agg(F.min(date).alias("a"), F.max(date).alias("z")).filter("a is not null")
    return ends.select(F.explode(F.sequence("a", "z", F.expr("interval 1 day"))).alias(date))


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` by ``keys`` in twice as many tasks as the session has shuffle partitions, for rows that become many more.

    Adaptive execution puts rows into few tasks by the size that they have before, unless the number is given; a
    repartition to the same number as a grouping before it would be left out.
    """
    return df.repartition(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def hours_of(df: DataFrame, keys: Sequence[str], first: str, last: str, out: str = "hour") -> DataFrame:
    """(keys, hour) for each hour between two columns, without a product: each group explodes its own range."""
    return dealt(df, keys).select(*keys, F.explode(F.sequence(first, last, F.expr("interval 1 hour"))).alias(out))


def new_and_gone(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """(value, change): values of one table only, ``new`` or ``gone``; nulls are left out."""
    a, b = (t.select(F.col(column).alias("value")).filter("value is not null").distinct() for t in (before, after))
    return b.join(a, "value", "left_anti").withColumn("change", F.lit("new")).union(a.join(b, "value", "left_anti").withColumn("change", F.lit("gone")))
