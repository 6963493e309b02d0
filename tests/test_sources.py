from __future__ import annotations

import time
import zipfile

import pytest
from pyspark.sql import functions as F

from skyledger import jobs
from skyledger.operators.contracts import ContractError
from skyledger.sources import flights, lookups, sinks
from skyledger.streaming.recent import daily_counts

LINE = {"Year": "2024", "Month": "1", "FlightDate": "2024-01-05", "Origin": "JFK", "Dest": "LAX", "ArrDelay": "20.00", "ArrDelayMinutes": "20.00", "ArrDel15": "1.00", "Cancelled": "0.00", "Diverted": "0.00", "Reporting_Airline": "AA"}


def write_csv(path, rows):
    path.write_text(",".join([*flights.KEEP, "Extra", ""]) + "\n" + "".join(",".join([*(r.get(c, "") for c in flights.KEEP), "e", ""]) + "\n" for r in rows))
    return path


def test_months_and_splits(spark, tmp_path):
    rows = [LINE, LINE | {"Month": "2", "ArrDel15": "", "Diverted": "1.00", "DivReachedDest": "1.00", "DivArrDelay": "3.00"}, LINE | {"Year": "2025", "FlightDate": "2025-01-05", "Cancelled": "1.00", "ArrDel15": ""}]
    csv = write_csv(tmp_path / "a.csv", rows)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(csv, "a.csv")
    plain, zipped = flights.typed(flights.read_csv(spark, str(csv))), flights.typed(flights.read_zips(spark, str(tmp_path / "a.zip")))
    assert plain.columns == zipped.columns == list(flights.KEEP) and len(flights.KEEP) == 51
    assert sorted(map(str, plain.collect())) == sorted(map(str, zipped.collect()))
    path = str(tmp_path / "months")
    flights.write_months(plain, path)
    train = flights.load_split(spark, path, "train")
    assert train.count() == 2 and train.filter("target_recovered_from_diversion").first().ArrDel15 == 0
    assert flights.load_split(spark, path, "val", ["Origin"], model_only=True).count() == 0
    assert flights.load_split(spark, path, "all", ["Origin"]).columns[0] == "Origin"
    flights.write_months(plain.filter("Month = 2").union(plain.filter("Month = 2")), path, overwrite=True)
    assert flights.load_split(spark, path, "all").count() == 4
    assert flights.inventory(spark, path).agg(F.sum("rows")).first()[0] == 4
    with pytest.raises(ValueError):
        flights.load_split(spark, path, "none")
    with pytest.raises(KeyError):
        flights.typed(plain.drop("Origin"))


def months(spark, path):
    return sorted(((r.Year, r.Month, r.n) for r in spark.read.parquet(path).groupBy("Year", "Month").agg(F.count("*").alias("n")).collect()), key=lambda r: r[1] or 0)


def test_new_months_are_added_and_old_ones_stay(spark, tmp_path):
    path = str(tmp_path / "months")
    of = lambda *rows: flights.typed(flights.read_csv(spark, str(write_csv(tmp_path / f"{len(list(tmp_path.iterdir()))}.csv", rows))))
    assert flights.months_present(spark, path) is None
    flights.write_months(of(LINE), path)
    flights.write_months(of(LINE | {"Month": "2"}, LINE | {"Month": "2"}), path)
    assert months(spark, path) == [(2024, 1, 1), (2024, 2, 2)]
    flights.write_months(of(LINE, LINE, LINE | {"Month": "3"}, LINE | {"Month": ""}), path)  # January is there, March is new
    flights.write_months(of(LINE | {"Month": ""}), path)  # so is the row without a month
    assert months(spark, path) == [(2024, None, 1), (2024, 1, 1), (2024, 2, 2), (2024, 3, 1)]
    flights.write_months(of(LINE, LINE, LINE), path, overwrite=True)
    assert months(spark, path)[1:] == [(2024, 1, 3), (2024, 2, 2), (2024, 3, 1)]
    assert sorted((r.part_year, r.part_month or 0) for r in flights.months_present(spark, path).collect()) == [(2024, 0), (2024, 1), (2024, 2), (2024, 3)]


def test_flights_job_takes_both_kinds_of_files(spark, tmp_path):
    first = write_csv(tmp_path / "one.csv", [LINE])
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.write(first, "one.csv")
    second = write_csv(tmp_path / "two.csv", [LINE | {"Month": "2"}, LINE])
    out = str(tmp_path / "out")
    jobs.main(["flights", "--raw", str(tmp_path / "one.zip"), str(second), "--out", out], spark)
    assert months(spark, out) == [(2024, 1, 1), (2024, 2, 1)]
    third = write_csv(tmp_path / "three.csv", [LINE | {"Month": "2"}, LINE | {"Month": "2"}])
    jobs.main(["flights", "--raw", str(third), "--out", out, "--force"], spark)
    assert months(spark, out) == [(2024, 1, 1), (2024, 2, 2)]


def test_metar(spark, tmp_path):
    (tmp_path / "jfk.csv").write_text("#DEBUG\nstation,valid,tmpf,vsby,sknt,gust,skyc1,skyl1,skyc2,skyl2,skyc3,skyl3,wxcodes,p01i\nJFK,2024-01-01 00:51,M,10,5,M,CLR,M,M,M,M,M,,T\n")
    r = lookups.read_metar(spark, str(tmp_path / "jfk.csv")).first()
    assert (r.airport, r.tmpf, r.vsby, r.wxcodes, r.p01i) == ("JFK", None, "10", None, "T")


def test_coordinates(spark, tmp_path):
    raw = spark.createDataFrame([("jfk", "40.6", "-73.8"), ("JFK", "40.7", "-73.8"), ("bad", "x", "1")], "iata string, lat string, lon string").coalesce(1)
    assert [tuple(r) for r in lookups.airport_coordinates(raw).collect()] == [("JFK", 40.7, -73.8)]
    (tmp_path / "b.csv").write_text("IATA,Latitude,lon\nJFK,9,9\nLAX,3,4\n")
    (tmp_path / "a.csv").write_text("IATA,Latitude,lon\nLAX,70,70\nJFK,1,2\nJFK,1,1\n")
    assert sorted(map(tuple, lookups.read_coordinates(spark, str(tmp_path)).collect())) == [("JFK", 9, 9), ("LAX", 3, 4)]
    assert sorted(map(tuple, lookups.read_coordinates(spark, str(tmp_path / "a.csv")).collect())) == [("JFK", 1, 1), ("LAX", 70, 70)]
    with pytest.raises(KeyError):
        lookups.airport_coordinates(raw.drop("lat"))
    with pytest.raises(ContractError):
        lookups.airport_coordinates(spark.createDataFrame([("AAA", "91", "0")], "iata string, lat string, lon string"))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, -5.0), (2, 3.0), (3, None)], "k int, v double")
    assert [r.k for r in sinks.largest_first(rows, "v", "k", 3).collect()] == [1, 2, 3]
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    sinks.write_json(spark, {"a": [1, 2]}, str(tmp_path / "json"))
    assert sinks.read_json(spark, str(tmp_path / "json")) == {"a": [1, 2]}
    assert lookups.read_tsv(spark, "a\tb\n1\t2\n3\t4", "a int, b int").collect()[1].b == 4


def test_stream_equals_batch(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", (F.col("event_type") == "error").cast("int").alias("late"))
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = daily_counts(stream, "ts", "late", "60 days").writeStream.format("memory").queryName("daily").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    time.sleep(0.1)
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, daily_counts(events, "ts", "late").collect()))
