"""Clock conversion by intervals against Python's zone data and against Spark's own conversion."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from skyledger.functions.times import to_zone
from skyledger.operators.clocks import ALWAYS, add_converted, transition_rows, transitions

ZONES = ("America/New_York", "America/Anchorage", "America/Phoenix", "Pacific/Pago_Pago", "Europe/Berlin", "Asia/Kolkata")


def python(ts, source, target):
    first, second = (ts.replace(tzinfo=ZoneInfo(source), fold=k) for k in (0, 1))
    back = first.astimezone(dt.timezone.utc).astimezone(ZoneInfo(source)).replace(tzinfo=None)
    if back != ts:  # skipped: the first instant after the gap
        low, high = (x.astimezone(dt.timezone.utc) for x in sorted((first, second), key=lambda x: x.astimezone(dt.timezone.utc)))
        while high - low > dt.timedelta(seconds=1):
            middle = low + (high - low) / 2
            low, high = (middle, high) if middle.astimezone(ZoneInfo(source)).utcoffset() == low.astimezone(ZoneInfo(source)).utcoffset() else (low, middle)
        return (high.replace(microsecond=0)).astimezone(ZoneInfo(target)).replace(tzinfo=None)
    if first.utcoffset() != second.utcoffset():
        return None
    return first.astimezone(ZoneInfo(target)).replace(tzinfo=None)


def test_equals_python_around_every_change(spark):
    times = [dt.datetime(2024, m, d, h, minute) for m, d in ((3, 10), (11, 3), (3, 31), (10, 27), (7, 1), (12, 31)) for h in range(0, 24) for minute in (0, 30, 59)]
    rows = [(i, t, s, z) for i, (t, s, z) in enumerate((t, s, z) for t in times for s in ZONES for z in ("America/New_York", "Asia/Kolkata"))]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz, s string, z string")
    both = add_converted(df, "ts", "s", "z", transitions(spark, ZONES, 2023, 2025), "there").withColumn("own", to_zone(F.col("ts"), F.col("s"), F.col("z"))).collect()
    assert len(both) == len(rows)
    for r in both:
        assert r.there == python(r.ts, r.s, r.z), (r.ts, r.s, r.z)
        assert r.own == r.there, (r.ts, r.s, r.z)


def test_intervals_follow_each_other():
    rows = [r for r in transition_rows(ZONES, 2023, 2025) if r[0] == "America/New_York"]
    assert rows[0][1] == ALWAYS[0] and rows[-1][2] == ALWAYS[1] and len(rows) == 7
    assert all(a[2] == b[1] and a[3] != b[3] for a, b in zip(rows, rows[1:]))
    assert len([r for r in transition_rows(["America/Phoenix"], 2023, 2025)]) == 1


def test_nulls_and_unknown_zones(spark):
    t = dt.datetime(2024, 7, 1, 12)
    rows = [(1, t, "America/New_York", "nowhere"), (2, t, "nowhere", "America/New_York"), (3, None, "America/New_York", "America/New_York"), (4, t, None, None), (5, dt.datetime(1990, 7, 1, 12), "America/Phoenix", "Asia/Kolkata")]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz, s string, z string").withColumn("zone", F.lit("x"))
    got = {r.id: r.there for r in add_converted(df, "ts", "s", "z", transitions(spark, ZONES, 2023, 2025), "there").collect()}
    assert got == {1: None, 2: None, 3: None, 4: None, 5: dt.datetime(1990, 7, 2, 0, 30)}
