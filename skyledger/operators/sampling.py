"""Samples that come out the same on every run, from hashes of keys instead of a generator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.operators.joins import null_safe_left


def spot(columns: Sequence[str], seed: int = 42) -> Column:
    """A row's place in the order of a sample: 15 hexadecimal digits of the MD5 of its keys as text, null as empty, behind the seed; other engines can give it too."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.substring(F.md5(text.cast("binary")), 1, 15)


def stratified(df: DataFrame, by: Sequence[str], keys: Sequence[str], rows: int, seed: int = 42) -> DataFrame:
    """The share of each group that makes about ``rows`` rows in all: a row stays when its place, of 1,000,000, falls below the share."""
    share = df.agg(F.least(F.lit(1.0), F.try_divide(F.lit(float(rows)), F.count("*"))).alias("s")).first().s or 0.0
    place = F.conv(spot([*by, *keys], seed), 16, 10).cast("long") % 1_000_000
    return df.filter(place / 1_000_000.0 < share)


def per_group(df: DataFrame, by: Sequence[str], keys: Sequence[str], rows: int, seed: int = 42) -> DataFrame:
    """At most ``rows`` rows of each group, first places first.

    Rows are counted by the first four digits of their places, and only those up to the digits at which a group has its
    rows are ranked: however many tasks a group comes from, little more than ``rows`` of its rows meet in one.
    """
    digits = F.substring(spot(keys, seed), 1, 4)
    counts = df.groupBy(*by, digits.alias("__digits")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__digits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    until = counts.withColumn("__before", before).filter(F.col("__before") < rows).groupBy(*by).agg(F.max("__digits").alias("__until"))
    df = null_safe_left(df, F.broadcast(until), by).filter(digits <= F.col("__until")).drop("__until")  # one row for each group
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(spot(keys, seed), *keys))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= rows).drop("__rank")


def first_hashes(df: DataFrame, keys: Sequence[str], rows: int, seed: int = 42) -> DataFrame:
    """``rows`` rows of first places."""
    return df.orderBy(spot(keys, seed), *keys).limit(rows)
