"""Plans and tasks that stay bounded where tables grow."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skyledger.plans import registry


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["e_e6_origin_and_destination_weather", "j6_d12_origin_weather_join"])
def test_hours_are_not_broadcast(spark, sf, name):
    plan = plan_of(registry.queries()[name](spark, sf))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_hours_are_made_in_many_tasks(spark):
    from skyledger.operators.joins import hours_of

    hour = lambda x: F.lit(x).cast("timestamp_ntz")
    groups = spark.range(400).select((F.col("id") % 200).alias("g")).distinct().withColumns({"a": hour("2024-01-01 00:00:00"), "z": hour("2024-01-02 23:00:00")})
    tasks = hours_of(groups, ["g"], "a", "z").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) == 8 and max(r["count"] for r in tasks) < 200 * 48 / 2


def test_snapshots_are_dealt_out_once_by_airport(spark):
    """One shuffle by airport serves the as-of window and the history behind it; ties, early, old, late and unkeyed observations stay right."""
    import datetime as dt

    from skyledger.operators import weather

    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    rows = [("A", at(0, 10), 1.0, "x"), ("A", at(0, 40), 2.0, "x"), ("A", at(2), 3.0, None), ("A", at(2), 3.0, "y"), ("A", at(9), 9.0, "z"), ("B", at(0, 30), 4.0, "b"), (None, at(1), 5.0, "n"), ("C", None, 6.0, "c")]
    seen = spark.createDataFrame(rows, "airport string, observation_time_local timestamp_ntz, v double, w string")
    got = weather.snapshots(seen, "2024-01-01 01:00:00", "2024-01-01 05:00:00")
    found = {(r.airport, r.hour.hour): (r.v, r.w, r.snapshot_age_minutes) for r in got.collect()}
    assert got.count() == len(found) == 20 and got.columns[:5] == ["airport", "hour", "observation_time_local", "v", "w"]
    want = {("A", 1): (2.0, "x", 20.0), ("A", 2): (3.0, "y", 0.0), ("A", 3): (3.0, "y", 60.0), ("B", 1): (4.0, "b", 30.0), ("B", 2): (4.0, "b", 90.0)}
    assert {k: v for k, v in found.items() if v != (None, None, None)} == want
    full = got.withColumns({"flight_category": F.lit("IFR"), "precip_mm": F.col("v"), "wind_gust_kt": F.col("v")})
    plan = plan_of(weather.add_history(full, checked=False))
    plan = plan[: plan.find("Initial Plan")]
    assert plan[: plan.find("Exchange")].count("Window") >= 2


def test_ages_have_no_single_state(spark, sf):
    assert "percentile" not in plan_of(registry.queries()["q15_q16_snapshot_audit"](spark, sf)).lower()


def test_a_part_of_a_stream_is_written_by_many_tasks(spark):
    from skyledger.plans import temporal

    table = spark.range(0, 4000, 1, 4).withColumn("v", F.col("id") % 7)
    out, path = temporal._streamed(spark, table, (F.col("id") < 2000, F.col("id") >= 2000), lambda stream: stream.filter("v = 3").withColumn("file", F.input_file_name()), "few")
    assert out.count() == table.filter("v = 3").count() and out.select("file").distinct().count() == 4


def test_few_rows_of_a_group_are_ranked(spark):
    from skyledger.operators import sampling

    df = spark.range(0, 40_000, 1, 8).withColumn("g", F.when(F.col("id") % 3 == 0, None).otherwise(F.lit("a")))
    got = sampling.per_group(df, ["g"], ["id"], 500)
    want = {g: {i for _, i in sorted((r.s, r.id) for r in df.filter(F.col("g").eqNullSafe(g)).select("id", sampling.spot(["id"]).alias("s")).collect())[:500]} for g in ("a", None)}
    assert {g: {r.id for r in got.filter(F.col("g").eqNullSafe(g)).collect()} for g in want} == want
    assert sampling.per_group(df, ["g"], ["id"], 100_000).count() == 40_000
    assert "__until" in plan_of(got)


def test_an_archive_is_made_of_pieces(spark, tmp_path):
    from skyledger.sources import archives

    rows = spark.range(0, 30_000, 1, 6).select(F.lit(1).alias("a"), F.when(F.col("id") % 2 == 0, None).otherwise(F.lit("m")).alias("m"), F.col("id").cast("string").alias("v"), F.when(F.col("id") % 5 > 0, 'q,"\n').alias("w"))
    made = archives.write_archives(rows, str(tmp_path / "zips"), "a", "m").collect()
    assert [(r.path, r.members) for r in made] == [(f"{tmp_path}/zips/1.zip", 2)]
    back = archives.read_members(spark, ["v", "w"], made[0].path)
    assert back.count() == 30_000 and back.exceptAll(rows.select("v", "w")).isEmpty()
