"""As-of join: each left row meets the last right row of its keys that is not later, within a tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Length of a time bucket where no tolerance sets it.
SLICE_MINUTES = 24 * 60

def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, tolerance_minutes: float | None = None, exact: bool = True) -> DataFrame:
    """All left rows with the right row's other columns, null where none fits.

    Both sides are put in one table and a window carries the last right row forward: one shuffle, no
    pairs. Time is cut into buckets and rows are dealt out by key and bucket, so that no key lands whole in
    one task. With a tolerance a bucket is as long as it, and a right row also stands in the next one;
    without, a bucket is ``SLICE_MINUTES`` long and starts with the last right row of those before it. Of
    right rows at the same time the greatest in the order of their other columns is taken. Rows with a
    null key or time match nothing. ``exact`` lets equal times match.
    """
    by = list(by)
    values = [c for c in right.columns if c not in by]
    clock = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))
    old = right.filter(F.col(right_time).isNotNull()).select(*by, F.struct(*values).alias("__right"), clock(F.col(right_time)).alias("__at"))
    new = left.select(*by, F.struct(*left.columns).alias("__left"), clock(F.col(left_time)).alias("__at"))
    span = None if tolerance_minutes is None else int(tolerance_minutes * 60_000_000)
    bucket = F.floor(F.col("__at") / max(SLICE_MINUTES * 60_000_000 if span is None else span, 1))
    new = new.withColumn("__bucket", bucket)
    keys = [*by, "__bucket"]
    if span is not None:
        old = old.withColumn("__bucket", F.explode(F.array(bucket, bucket + 1)))
    else:
        old = old.withColumn("__bucket", bucket)
        ends = old.groupBy(*keys).agg(F.max(F.struct("__at", "__right")).alias("__end")).unionByName(new.select(*keys).distinct(), allowMissingColumns=True)
        ends = ends.groupBy(*keys).agg(F.max("__end").alias("__end"))
        before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for each bucket
        carried = ends.withColumn("__end", F.last("__end", ignorenulls=True).over(before)).filter("__end is not null")
        old = old.unionByName(carried.select(*keys, "__end.__right", "__end.__at"))
    both = old.withColumn("__side", F.lit(0 if exact else 1)).unionByName(new.withColumn("__side", F.lit(1 if exact else 0)), allowMissingColumns=True)
    order = [F.col("__at"), F.col("__side"), F.col("__right")]
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__right").isNotNull(), F.struct("__right", "__at")), ignorenulls=True).over(window)
    found = both.withColumn("__last", last).filter(F.col("__left").isNotNull())
    fits = F.col("__at").isNotNull()
    for k in by:
        fits = fits & F.col(k).isNotNull()
    if span is not None:
        fits = fits & (F.col("__at") - F.col("__last.__at") <= span)
    return found.select("__left.*", *[F.when(fits, F.col(f"__last.__right.{v}")).alias(v) for v in values])
