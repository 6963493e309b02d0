"""The whole way from raw flights and weather text to model rows, on a small made-up network."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from skyledger import jobs
from skyledger.operators import model, prepare, recent, weather
from skyledger.operators.target import build_target
from skyledger.sources.scratch import written

PORTS = {"JFK": "America/New_York", "ORD": "America/Chicago", "LAX": "America/Los_Angeles"}


@pytest.fixture(scope="module")
def lookup(spark):
    return spark.createDataFrame(list(PORTS.items()), "Airport string, timezone string")


@pytest.fixture(scope="module")
def hourly(spark):
    columns = "airport valid tmpf vsby sknt gust skyc1 skyl1 wxcodes p01i".split()
    rng = random.Random(2)
    rows = [(p, f"{d} {h:02d}:51", "50", rng.choice(["10", "2", "0.5"]), "5", "20", "BKN", rng.choice(["300", "900", "5000"]), rng.choice([None, "-SN", "TSRA"]), "0.1") for p in PORTS for d in ("2024-03-10", "2024-04-20", "2025-01-05") for h in range(24)]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    return written(weather.build_hourly(raw, "2024-03-09 00:00:00", "2025-01-07 00:00:00"), "hourly")


def flights(spark, days, n=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        o, d = rng.sample(list(PORTS), 2)
        day = rng.choice(days)
        late = int(rng.random() < 0.3)
        rows.append((dt.date.fromisoformat(day), rng.choice(["AA", "UA"]), i, o, d, rng.choice([5, 230, 859, 1401, 2359]), 1200, 180.0, 700.0, float(i % 10 == 0), 0.0, None, None, 20.0 * late, 20.0 * late, late if i % 10 else None))
    names = "FlightDate date, Reporting_Airline string, Flight int, Origin string, Dest string, CRSDepTime int, CRSArrTime int, CRSElapsedTime double, Distance double, Cancelled double, Diverted double, DivReachedDest double, DivArrDelay double, ArrDelay double, ArrDelayMinutes double, ArrDel15 int"
    df = spark.createDataFrame(rows, names).withColumns({"Month": F.month("FlightDate"), "DayofMonth": F.day("FlightDate"), "DayOfWeek": F.weekday("FlightDate") + 1})
    return build_target(df)


def test_pair(spark, hourly, lookup):
    train, later = flights(spark, ["2024-03-10", "2024-04-20"]), flights(spark, ["2025-01-05"], 30, 2)
    first, second = (written(x, "rows") for x in prepare.prepare_pair(train, later, hourly, lookup))
    assert not set(model.feature_list()) - set(first.columns) and not set(model.feature_list()) - set(second.columns)
    assert first.count() == train.filter("model_eligible").count() and second.count() == later.filter("model_eligible").count()
    recent.require_rates(second, recent.feature_names())
    assert first.filter("origin_sched_deps_this_hour < 1").isEmpty()
    noon = second.filter("Origin = 'JFK' and Dest = 'LAX'").first()
    assert noon.dest_departure_time_local == noon.dep_time_local - dt.timedelta(hours=3)
    april = first.filter("FlightDate = '2024-04-20'").first()
    march = train.filter("model_eligible and month(FlightDate) = 3").agg(F.count("*").alias("n")).first().n
    assert math.expm1(april.hist_carrier_log_count) < march + 1e-3
    fitted = model.fit_delay_model(first, "ArrDel15", ["Distance", "hist_carrier_delay_rate", "origin_visibility_sm"], ["Origin", "origin_flight_category"], rounds=2, depth=2, min_hessian=0.5)
    assert fitted.score(second).filter("p_delay between 0 and 1").count() == second.count()


def test_closed_test_period():
    with pytest.raises(ValueError):
        prepare.FrozenSpec(tuple(model.feature_list()), 258, 0.2).require_open()
    prepare.FrozenSpec((), 258, 0.2, allow_test=True).require_open()


def test_jobs(spark, tmp_path):
    from tests.test_sources import LINE, write_csv

    csv = write_csv(tmp_path / "m.csv", [LINE, LINE | {"Flight_Number_Reporting_Airline": "7"}])
    out = str(tmp_path / "months")
    jobs.main(["flights", "--raw", str(csv), "--out", out, "--sample", str(tmp_path / "sample"), "--sample-rows", "10"], spark)
    jobs.main(["split", "--months", out, "--split", "train", "--out", str(tmp_path / "train")], spark)
    assert spark.read.parquet(str(tmp_path / "train")).count() == spark.read.parquet(str(tmp_path / "sample")).count() == 2
    (tmp_path / "abc.csv").write_text("station,valid,tmpf,vsby,sknt,gust,skyc1,skyl1,skyc2,skyl2,skyc3,skyl3,wxcodes,p01i\nABC,2024-01-01 00:51,50,10,5,M,CLR,M,M,M,M,M,,T\n")
    jobs.main(["weather", "--raw", str(tmp_path / "abc.csv"), "--out", str(tmp_path / "hourly"), "--last", "2024-01-01 02:00:00"], spark)
    assert spark.read.parquet(str(tmp_path / "hourly")).count() == 3
