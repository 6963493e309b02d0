"""Clock conversion by a table of transition intervals: (zone, from_utc, until_utc, offset_minutes), one row between two changes of a zone's clock."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators.contracts import forbid_columns

#: Before and after all times of a table.
ALWAYS = (dt.datetime(1, 1, 2), dt.datetime(9999, 12, 30))


def transition_rows(zones: Sequence[str], first_year: int, last_year: int) -> list[tuple[str, dt.datetime, dt.datetime, float]]:
    """The intervals of ``zones`` from Python's zone data; what lies before the first year or after the last keeps the offset of that end."""
    out = []
    for zone in dict.fromkeys(zones):
        info = ZoneInfo(zone)
        offset = lambda t: t.replace(tzinfo=dt.timezone.utc).astimezone(info).utcoffset()  # noqa: E731, B023
        at, end, since = dt.datetime(first_year, 1, 1), dt.datetime(last_year + 1, 1, 1), ALWAYS[0]
        while at < end:
            next_ = at + dt.timedelta(days=1)
            if offset(next_) != offset(at):
                low, high = at, next_
                while high - low > dt.timedelta(seconds=1):
                    middle = low + dt.timedelta(seconds=int((high - low).total_seconds()) // 2)
                    low, high = (middle, high) if offset(middle) == offset(at) else (low, middle)
                out.append((zone, since, high, offset(at).total_seconds() / 60))
                since = high
            at = next_
        out.append((zone, since, ALWAYS[1], offset(end).total_seconds() / 60))
    return out


def transitions(spark: SparkSession, zones: Sequence[str], first_year: int, last_year: int) -> DataFrame:
    """``transition_rows`` as a table."""
    return spark.createDataFrame(transition_rows(zones, first_year, last_year), "zone string, from_utc timestamp_ntz, until_utc timestamp_ntz, offset_minutes double")


def add_converted(df: DataFrame, ts: str, source: str, target: str, intervals: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out``: local time ``ts`` on the clock of zone ``source``, on the clock of zone ``target``.

    A time that the source clock skips counts as the first one after the gap, one that it shows twice is null, and so are
    unknown zones and null times. Each zone's intervals are one row with an array, which is looked into, so that rows stay as many as they are.
    """
    forbid_columns(df, [out])
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("offset_minutes") * 60)
    sorted_ = F.array_sort(F.collect_list(F.struct("from_utc", "until_utc", (F.col("from_utc") + span).alias("from_local"), (F.col("until_utc") + span).alias("until_local"), span.alias("span"))))
    table = intervals.groupBy("zone").agg(sorted_.alias("i"))  # one row a zone
    sides = [F.broadcast(table.select(F.col("zone").alias(f"__zone{k}"), F.col("i").alias(f"__i{k}"))) for k in (0, 1)]
    both = df.join(sides[0], F.col(source) == F.col("__zone0"), "left").join(sides[1], F.col(target) == F.col("__zone1"), "left")
    local = F.col(ts).cast("timestamp_ntz")
    shown: Column = F.filter("__i0", lambda i: (local >= i["from_local"]) & (local < i["until_local"]))
    after: Column = F.filter("__i0", lambda i: i["from_local"] > local)
    both = both.withColumns({"__shown": shown, "__after": after})
    utc = F.when(F.size("__shown") == 1, local - F.col("__shown")[0]["span"]).when(F.size("__shown") == 0, F.array_min(F.transform("__after", lambda i: i["from_utc"])))
    both = both.withColumn("__utc", utc)
    there = F.filter("__i1", lambda i: (F.col("__utc") >= i["from_utc"]) & (F.col("__utc") < i["until_utc"]))
    return both.withColumn(out, F.col("__utc") + F.get(there, F.lit(0))["span"]).select(*(F.col(f"`{c}`") for c in df.columns), out)
