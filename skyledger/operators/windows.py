"""Rolling, expanding and cumulative values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.operators.joins import null_safe_left
from skyledger.sources.scratch import written


def rolling(value: Column, size: int, by: Sequence[str], order: str, how: str = "sum", include_current: bool = True) -> Column:
    """Sum or maximum of the last ``size`` rows, nulls skipped; null where all are null."""
    if size < 1:
        raise ValueError("a window has at least one row")
    frame = (-(size - 1), 0) if include_current else (-size, -1)
    return {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg}[how](value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(*frame))


def lagged_sum(value: Column, size: int, lag: int, by: Sequence[str], order: str) -> Column:
    """Sum of the ``size`` rows that end ``lag`` rows back; null where there are none."""
    if size < 1 or lag < 1:
        raise ValueError("window and lag are positive")
    return F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-(size + lag - 1), -lag))


def prior_sum(value: Column, by: Sequence[str], order: str) -> Column:
    """Sum of all earlier rows, 0 for the first."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def step_minutes(time: str, by: Sequence[str]) -> Column:
    """Minutes since the row before; null for the first."""
    before = F.lag(time).over(Window.partitionBy(*by).orderBy(time))
    return F.timestamp_diff("MICROSECOND", before, F.col(time)) / F.lit(6e7)


def centred(value: Column, size: int, least: int, by: Sequence[str], order: str) -> Column:
    """Median of a centred window; an even one reaches one row further back. Null with fewer than ``least`` values."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(size // 2), size - size // 2 - 1)
    return F.when(F.count(value).over(w) >= least, F.percentile(value, 0.5).over(w))


def running_totals(df: DataFrame, order: str | Sequence[str], sums: Sequence[str], descending: bool = True, slices: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``cum_<name>`` for each of ``sums``, over all rows (of each group) in the order of columns without repeats.

    Rows are dealt into ranges of (group, order), as many as the session has shuffle partitions or ``slices``,
    and written once; sums within a range are added to the totals of the ranges before it, so no task sees
    all rows. Null groups are a group; null orders come last where descending, else first.
    """
    order = [order] if isinstance(order, str) else list(order)
    count = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(count, *by, *order).withColumn("__slice", F.spark_partition_id()), "slices")
    way = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    ends = dealt.groupBy(*by, "__slice").agg(*(F.sum(s).alias(f"__{s}") for s in sums))  # a row for each range and for each group that starts in it
    before = Window.partitionBy(*by).orderBy(F.col("__slice").desc() if descending else F.col("__slice").asc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "__slice", *(F.coalesce(F.sum(f"__{s}").over(before), F.lit(0)).alias(f"__{s}") for s in sums))
    own = Window.partitionBy(*by, "__slice").orderBy(*way).rowsBetween(Window.unboundedPreceding, 0)
    return null_safe_left(dealt, ends, [*by, "__slice"]).select(*df.columns, *((F.sum(s).over(own) + F.col(f"__{s}")).alias(f"cum_{s}") for s in sums))
