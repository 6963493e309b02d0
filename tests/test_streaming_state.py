"""Streams with keyed state against the batch operators on the same rows, over late and repeated rows and a restart."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skyledger.operators import history, weather
from skyledger.operators.history import RateSpec
from skyledger.streaming.history import daily_group_counts, month_closings, with_closed_rates
from skyledger.streaming.snapshots import streaming_snapshots

START = dt.datetime(2024, 1, 1)


def run(stream, path, name):
    """Takes all files that are there and ends; goes on from its checkpoint."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}_state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/{name}")


def put(spark, rows, schema, path, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{name}")


def stream_of(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_snapshots_equal_the_batch_over_a_restart(spark, tmp_path):
    rng = random.Random(2)
    schema = "airport string, observation_time_local timestamp_ntz, v double, w string"
    rows = [(rng.choice(["A", "B", "C"]), START + dt.timedelta(minutes=rng.randrange(0, 2400, 5)), None if rng.random() < 0.1 else float(rng.randrange(9)), rng.choice(["x", None])) for _ in range(160)]
    rows = [r for r in rows if not (r[0] == "C" and r[1] < START + dt.timedelta(hours=20))]  # an airport that comes late
    rows.sort(key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(0, 100)))  # late within two hours
    files = [rows[i : i + 40] for i in range(0, len(rows), 40)]
    files[-1] = files[-1] + rows[-30:]  # repeated
    end = (START + dt.timedelta(hours=35)).isoformat(" ")
    last = [("Z", START + dt.timedelta(hours=60), 1.0, None), (None, START, 1.0, None), ("A", None, 1.0, None)]
    put(spark, files[0], schema, tmp_path, "in")
    put(spark, files[1], schema, tmp_path, "in")
    stream = streaming_snapshots(stream_of(spark, schema, f"{tmp_path}/in"), "2024-01-01 00:00:00", end)
    first = run(stream, tmp_path, "out").count()
    for f in (*files[2:], last):
        put(spark, f, schema, tmp_path, "in")
    found = run(stream, tmp_path, "out").filter("airport <> 'Z'")
    assert 0 < first < found.count() == 3 * 36
    want = weather.snapshots(spark.createDataFrame(rows, schema), "2024-01-01 00:00:00", end)
    assert sorted(map(str, found.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_expanding_rates_equal_the_batch_over_a_restart(spark, tmp_path):
    rng = random.Random(3)
    schema = "id int, FlightDate date, carrier string, origin string, late int"
    specs = (RateSpec("carrier", ("carrier",), 20), RateSpec("pair", ("carrier", "origin"), 5))
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(170)), rng.choice(["AA", "UA", None]), rng.choice("xyz"), int(rng.random() < 0.4)) for i in range(500)]
    rows = [r for r in rows if not (r[2] == "UA" and r[1].month in (3, 4))]  # a group without rows in some months
    rows.sort(key=lambda r: r[1] + dt.timedelta(days=rng.randrange(3)))
    half = len(rows) // 2
    end = [(10_000, dt.date(2024, 9, 1), "none", "none", 0)]  # moves the watermark past all months
    put(spark, rows[:half], schema, tmp_path, "in")
    daily = daily_group_counts(stream_of(spark, schema, f"{tmp_path}/in"), specs, target="late")
    counts = run(daily, tmp_path, "daily")
    closings = month_closings(stream_of(spark, counts.schema, f"{tmp_path}/daily"))
    before = run(closings, tmp_path, "closed").count()
    put(spark, rows[half:], schema, tmp_path, "in")
    put(spark, end, schema, tmp_path, "in")
    put(spark, [(10_001, dt.date(2024, 12, 1), "none", "none", 0)], schema, tmp_path, "in")
    run(daily, tmp_path, "daily")
    closed = run(closings, tmp_path, "closed")
    assert 0 < before < closed.count()
    df = spark.createDataFrame(rows, schema)
    want = history.add_expanding_rates(df, specs, target="late")
    got = with_closed_rates(df, closed, specs)
    names = [n for s in specs for n in s.outputs]
    assert got.columns == want.columns
    assert sorted((r.id, *(round(r[n], 5) for n in names)) for r in got.collect()) == sorted((r.id, *(round(r[n], 5) for n in names)) for r in want.collect())
