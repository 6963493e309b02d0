"""Archives read member by member, and months that are committed as a whole or not at all."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skyledger.sources import flights
from skyledger.sources.archives import read_members, write_archives


def test_members_are_splits(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.csv", "a,b,c,\n1,x,,\n2,\"y, \n z\",7,\n")
        z.writestr("readme.txt", "no table")
        z.writestr("two.CSV", "﻿c,a\n5,3\n".encode())
        z.writestr("empty.csv", "a,c\n")
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("in/big.csv", "a,c\n" + "".join(f"{i},{i % 7}\n" for i in range(200_000)))
    df = read_members(spark, ["a", "c"], str(tmp_path / "a.zip"), f"file://{tmp_path}/b.zip")
    assert df.rdd.getNumPartitions() == 4
    assert sorted((r.a, r.c) for r in df.filter("int(a) < 4 and (c is null or int(c) > 3)").collect()) == [("1", None), ("2", "7"), ("3", "5")]
    assert df.count() == 200_003 and df.filter("c = 3").count() == 200_000 // 7


def test_what_is_missing_raises(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.csv", "a,b\n1,2\n")
    with pytest.raises(PySparkException, match="missing columns in one.csv: c"):
        read_members(spark, ["a", "c"], str(tmp_path / "a.zip")).collect()
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("one.txt", "a")
    with pytest.raises(PySparkException, match="no .csv"):
        read_members(spark, ["a"], str(tmp_path / "none.zip")).collect()


def test_written_archives_come_back(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 2).alias("file"), (F.col("id") % 3).alias("part"), F.col("id").cast("string").alias("v"), F.when(F.col("id") % 5 == 0, None).otherwise("q,\"").alias("w"))
    made = write_archives(rows, str(tmp_path / "zips"), "file", "part").collect()
    assert sorted(r.members for r in made) == [3, 3]
    back = read_members(spark, ["v", "w"], *(r.path for r in made))
    assert back.exceptAll(rows.select("v", "w")).isEmpty() and back.count() == 300


def months(spark, n=40):
    rows = spark.range(n).withColumns({"Year": F.lit(2024), "Month": (F.col("id") % 3 + 1).cast("int"), "Origin": F.col("id").cast("string"), "Dest": F.lit("X")})
    return rows.withColumns({"Year": F.when(F.col("id") == 5, F.lit(None)).otherwise(F.col("Year")).cast("int")})


def held(spark, path):
    return flights.read_months(spark, path).groupBy("part_year", "part_month").count().collect()


def test_a_writer_that_dies_leaves_no_month(spark, tmp_path):
    path, rows = str(tmp_path / "store"), months(spark)
    dying = rows.withColumn("Dest", F.when(F.col("id") == 38, F.raise_error(F.lit("lost"))).otherwise(F.col("Dest")))
    with pytest.raises(PySparkException, match="lost"):
        flights.write_months(dying, path)
    assert flights.months_present(spark, path) is None
    # one that was lost while it moved a month: a part of it is there, without an entry
    rows.filter("Month = 2 and id < 10").write.parquet(f"{path}/part_year=2024/part_month=2")
    flights.write_months(rows.filter("Month = 1"), path)
    assert {(r.part_year, r.part_month) for r in held(spark, path)} == {(2024, 1)}
    flights.write_months(rows, path)
    want = {(r.Year, r.Month): r["count"] for r in rows.groupBy("Year", "Month").count().collect()}
    assert {(r.part_year, r.part_month): r["count"] for r in held(spark, path)} == want and len(want) == 4
    assert {tuple(r) for r in flights.months_present(spark, path).collect()} == set(want)
    assert not [p for p in (tmp_path / "store").iterdir() if "staging" in p.name]


def test_finished_months_stay_and_overwritten_ones_are_replaced(spark, tmp_path):
    path, rows = str(tmp_path / "store"), months(spark).filter("Year is not null")
    flights.write_months(rows.filter("id < 20"), path)
    flights.write_months(rows, path)
    assert sum(r["count"] for r in held(spark, path)) == 19
    flights.write_months(rows.filter("Month = 1"), path, overwrite=True)
    got = {r.part_month: r["count"] for r in held(spark, path)}
    assert got[1] == rows.filter("Month = 1").count() and got[2] + got[3] == rows.filter("id < 20 and Month > 1").count()
