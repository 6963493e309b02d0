"""Every query that SQL can express gives the rows of its SQL."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from skyledger.plans import registry

NAMES = sorted(registry.queries())
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "SMALLINT": "smallint"}


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return float(f"{value:.9g}") + 0.0 if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    df = registry.queries()[name](spark, sf)
    rows = [tuple(plain(x) for x in r) for r in df.select(*sorted(df.columns)).collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = con.execute(sql)
    kinds = {d[0]: KINDS.get(str(d[1])) for d in found.description}
    order = sorted(range(len(kinds)), key=lambda i: found.description[i][0])
    want = [tuple(plain(r[i]) for i in order) for r in found.fetchall()]
    assert {c: k for c, k in df.dtypes} == kinds
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_session_zone_does_not_matter(spark, sf):
    names = ("j1_d14_asof_snapshot", "f1_f2_clock_timestamps", "f4_f5_f6_calendar_columns", "d11_schedule_demand", "f3_destination_clock", "t1_streaming_daily_counts")
    read = lambda: {n: sorted(map(str, registry.queries()[n](spark, sf).collect())) for n in names}
    utc = read()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert read() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
