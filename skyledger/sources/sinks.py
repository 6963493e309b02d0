"""Sinks: ranked CSV exports and JSON metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def largest_first(df: DataFrame, value: str, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows of greatest absolute value, nulls last, ties by key."""
    return df.orderBy(F.abs(value).desc_nulls_last(), F.col(key)).limit(rows)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(spark: SparkSession, data: dict, path: str) -> None:
    """One JSON object in a text file of any store that Spark writes."""
    spark.createDataFrame([(json.dumps(data, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
