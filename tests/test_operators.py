"""Hand-made cases whose answers follow from the rules."""

from __future__ import annotations

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from skyledger.functions import stats as S
from skyledger.functions import times as T
from skyledger.functions import weather as W
from skyledger.operators import asof, contracts, demand, history, holidays, joins, metrics, model, recent, reports, sampling, stats, target, weather, windows, zones


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize("delay,want", [(-5.0, (0, 0, True)), (14.0, (0, 14, True)), (15.0, (1, 15, True)), (None, (None, None, False))])
def test_target_recovery(spark, delay, want):
    rows = spark.createDataFrame([(0.0, 1.0, 1.0, delay, None, None, None)], "Cancelled float, Diverted float, DivReachedDest float, DivArrDelay double, ArrDelay double, ArrDelayMinutes double, ArrDel15 int")
    r = target.build_target(rows).first()
    assert (r.ArrDel15, r.ArrDelayMinutes, r.model_eligible) == want and r.nonarrival_disruption is False


def test_diversion_of_unknown_end(spark):
    rows = spark.createDataFrame([(0, 1, None, 3.0, None, None, None), (1, 0, None, None, None, None, None)], "Cancelled int, Diverted int, DivReachedDest int, DivArrDelay double, ArrDelay double, ArrDelayMinutes double, ArrDel15 int")
    assert [r.nonarrival_disruption for r in target.build_target(rows).collect()] == [True, True]
    assert target.eligible_rows(target.build_target(rows)).count() == 0


@pytest.mark.parametrize("hhmm,want", [(0, "2024-03-10 00:00"), (5, "2024-03-10 00:05"), (230, "2024-03-10 02:30"), (856, "2024-03-10 08:56"), (2359, "2024-03-10 23:59"), (2400, "2024-03-11 00:00"), (None, None)])
def test_clock(spark, hhmm, want):
    got = one(spark, T.clock_timestamp(F.lit("2024-03-10").cast("date"), F.lit(hhmm)))
    assert got == (want and dt.datetime.fromisoformat(want))


@pytest.mark.parametrize("hhmm", [2401, 1260, -1])
def test_bad_clock(spark, hhmm):
    with pytest.raises(Exception, match="not a clock time"):
        one(spark, T.clock_timestamp(F.lit("2024-03-10").cast("date"), F.lit(hhmm)))


@pytest.mark.parametrize(
    "source,target_,local,want",
    [
        ("America/New_York", "America/Los_Angeles", "2024-03-10 02:30", "2024-03-09 23:00"), ("America/Anchorage", "America/Anchorage", "2024-03-10 02:30", "2024-03-10 03:00"),
        ("America/New_York", "America/Los_Angeles", "2024-11-03 01:30", None), ("America/New_York", "America/Phoenix", "2024-07-01 12:00", "2024-07-01 09:00"), (None, "America/Phoenix", "2024-07-01 12:00", None),
    ],
)
def test_zones(spark, source, target_, local, want):
    rows = spark.createDataFrame([(source, target_)], "s string, t string")
    got = rows.select(T.to_zone(ts(local), F.col("s"), F.col("t")).alias("x")).first().x
    assert got == (want and dt.datetime.fromisoformat(want))


def test_zones_against_zone_data(spark):
    rng = random.Random(4)
    names = ["America/New_York", "America/Chicago", "America/Phoenix", "Pacific/Honolulu", "America/Puerto_Rico"]
    rows = [(rng.choice(names), rng.choice(names), dt.datetime(2024, rng.choice([1, 5, 6, 7, 12]), rng.randrange(1, 28), rng.randrange(24), rng.randrange(60))) for _ in range(200)]
    df = spark.createDataFrame(rows, "s string, t string, x timestamp_ntz")
    for r in df.withColumn("y", T.to_zone(F.col("x"), F.col("s"), F.col("t"))).collect():
        assert r.y == r.x.replace(tzinfo=ZoneInfo(r.s)).astimezone(ZoneInfo(r.t)).replace(tzinfo=None)


def test_asof(spark):
    grid = spark.createDataFrame([("A", dt.datetime(2024, 1, 1, h, m)) for h, m in ((8, 0), (9, 0), (10, 0), (10, 30))] + [("B", dt.datetime(2024, 1, 1, 8))], "k string, hour timestamp_ntz")
    obs = spark.createDataFrame([("A", dt.datetime(2024, 1, 1, 7, 51), 1), ("A", dt.datetime(2024, 1, 1, 8, 51), 2), ("B", dt.datetime(2024, 1, 1, 6, 30), 3), (None, dt.datetime(2024, 1, 1, 7), 4)], "k string, t timestamp_ntz, v int")
    found = {(r.k, r.hour.strftime("%H:%M")): r.v for r in asof.asof_join(grid, obs, ["k"], "hour", "t", 90).collect()}
    assert found == {("A", "08:00"): 1, ("A", "09:00"): 2, ("A", "10:00"): 2, ("A", "10:30"): None, ("B", "08:00"): 3}
    late = obs.filter("k = 'B'").withColumn("t", F.col("t") - F.expr("interval 100 milliseconds"))
    assert {r.v for r in asof.asof_join(grid.filter("k = 'B'"), late, ["k"], "hour", "t", 90).collect()} == {None}
    same = grid.withColumnRenamed("hour", "t").withColumn("v", F.lit(9))
    assert {r.v for r in asof.asof_join(grid.filter("k = 'B'"), same, ["k"], "hour", "t", 90, exact=False).collect()} == {None}


def test_asof_against_all_pairs(spark):
    rng = random.Random(7)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(86400))
    left, right = [(rng.choice("ab"), at(), i) for i in range(120)], [(rng.choice("ab"), at(), i) for i in range(80)]
    a, b = spark.createDataFrame(left, "k string, x timestamp_ntz, i int"), spark.createDataFrame(right, "k string, y timestamp_ntz, v int")
    for limit in (None, 30, 0.5):
        found = {r.i: (r.y, r.v) for r in asof.asof_join(a, b, ["k"], "x", "y", limit).collect()}
        for k, x, i in left:
            past = [(y, v) for kk, y, v in right if kk == k and y <= x and (limit is None or x - y <= dt.timedelta(minutes=limit))]
            assert found[i] == max(past, default=(None, None))


@pytest.mark.parametrize("covers,heights,want", [((None, None), (None, None), None), (("FEW", None), (3000.0, None), 99999.0), (("BKN", "OVC"), (1200.0, 800.0), 800.0), (("OVC", None), (None, None), 99999.0)])
def test_ceiling(spark, covers, heights, want):
    assert one(spark, W.ceiling([F.lit(c).cast("string") for c in covers], [F.lit(h).cast("double") for h in heights])) == want


@pytest.mark.parametrize("c,v,want", [(3000, 10, "MVFR"), (3001, 5, "MVFR"), (999, 10, "IFR"), (500, 3, "IFR"), (499, 10, "LIFR"), (99999, 0.9, "LIFR"), (None, 10, None), (3001, 5.1, "VFR")])
def test_category(spark, c, v, want):
    assert one(spark, W.flight_category(F.lit(c).cast("double"), F.lit(v).cast("double"))) == want


@pytest.mark.parametrize("code,storm,frozen", [("-TSRA BR", True, False), ("VCTS", True, False), ("-SN", False, True), ("BLSN", False, True), ("RA", False, False), (None, False, False)])
def test_codes(spark, code, storm, frozen):
    c = F.lit(code).cast("string")
    assert (one(spark, W.has_thunderstorm(c)), one(spark, W.has_frozen(c))) == (storm, frozen)


def test_precipitation(spark):
    assert one(spark, W.precipitation(F.lit("T"))) == 0 and one(spark, W.precipitation(F.lit("0.5"))) == 12.7 and one(spark, W.precipitation(F.lit("x"))) is None


def _raw(spark):
    columns = "airport valid tmpf vsby sknt gust skyc1 skyl1 wxcodes p01i".split()
    rows = [("abc", "2024-01-01 00:51", "50", "10", "5", None, "BKN", "2500", None, "0.1"), ("ABC", "2024-01-01 01:51", "32", "0.5", "7", "20", "OVC", "300", "-SN", "T"), ("ABC", "bad", "1", "1", "1", "1", "CLR", None, None, None)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def test_hourly_weather(spark):
    rows = weather.build_hourly(_raw(spark), "2024-01-01 00:00:00", "2024-01-01 04:00:00").orderBy("hour").collect()
    assert [r.weather_observation_missing for r in rows] == [1, 0, 0, 0, 1] and [r.flight_category for r in rows] == [None, "MVFR", "LIFR", "LIFR", None]
    assert [r.snapshot_age_minutes for r in rows] == [None, 9.0, 9.0, 69.0, None] and [r.ifr_hours_past3 for r in rows] == [None, 0, 1, 2, 2]
    assert [r.precip_3h and round(r.precip_3h, 2) for r in rows] == [None, 2.54, 2.54, 2.54, 0.0] and rows[0].airport == "ABC" and rows[0].__fields__ == list(weather.HOURLY)
    weather.require_grid(spark.createDataFrame(rows, weather.build_hourly(_raw(spark), "2024-01-01 00:00:00", "2024-01-01 04:00:00").schema), 5)


def test_history_checks(spark):
    rows = weather.build_hourly(_raw(spark), "2024-01-01 00:00:00", "2024-01-01 04:00:00").drop("ifr_hours_past3", "precip_3h", "max_gust_3h")
    assert weather.add_history(rows, include_current=False).count() == 5
    with pytest.raises(contracts.ContractError):
        weather.add_history(rows.filter("hour(hour) <> 2"))
    with pytest.raises(contracts.ContractError):
        weather.add_history(rows.union(rows))
    with pytest.raises(contracts.ContractError):
        weather.add_history(rows, window=0)


def _flights(spark):
    rows = [("ABC", "XYZ", dt.datetime(2024, 1, 1, 2, 20), dt.datetime(2024, 1, 1, 1, 20), 60), ("ABC", "QQQ", dt.datetime(2024, 1, 1, 2, 40), None, 60)]
    df = spark.createDataFrame(rows, "Origin string, Dest string, dep_time_local timestamp_ntz, dest_departure_time_local timestamp_ntz, CRSElapsedTime int")
    return df.withColumns({"dep_hour_local": T.floor_hour(F.col("dep_time_local")), "dest_departure_hour_local": T.floor_hour(F.col("dest_departure_time_local"))})


def test_weather_join(spark):
    hourly = weather.build_hourly(_raw(spark), "2024-01-01 00:00:00", "2024-01-01 04:00:00")
    both = hourly.union(hourly.withColumn("airport", F.lit("XYZ")))
    rows = {r.Dest: r for r in weather.add_weather(_flights(spark), both).collect()}
    assert rows["XYZ"].origin_flight_category == "LIFR" and rows["XYZ"].origin_weather_age_minutes == 29 and rows["XYZ"].dest_weather_age_minutes == 29 and rows["QQQ"].dest_flight_category is None
    ahead = hourly.withColumn("observation_time_local", F.col("observation_time_local") + F.expr("interval 1 hour"))
    with pytest.raises(Exception, match="later than the departure"):
        weather.add_weather(_flights(spark), ahead, join_destination=False).collect()
    with pytest.raises(contracts.ContractError):
        weather.add_weather(_flights(spark), both, dest_hour=None)
    with pytest.warns(UserWarning):
        weather.add_weather(_flights(spark), both, dest_time=None)


def test_demand_counts_cancelled(spark):
    rows = _flights(spark)
    more = rows.union(rows.limit(1))
    found = {r.Dest: r for r in demand.add_schedule_demand(more, rows).collect()}
    assert found["XYZ"].origin_sched_deps_this_hour == 3 and found["XYZ"].dest_sched_arrivals_this_hour == 0
    with pytest.raises(Exception, match="not scheduled"):
        demand.add_schedule_demand(rows.filter("Dest = 'none'"), rows).collect()


def test_holidays(spark):
    days = {d: n for d, n in holidays.us_holidays(range(2024, 2027))}
    assert days[dt.date(2024, 11, 28)] == "Thanksgiving Day" and days[dt.date(2024, 5, 27)] == "Memorial Day" and days[dt.date(2026, 7, 3)] == "Independence Day (observed)" and days[dt.date(2025, 1, 20)].startswith("Martin")
    r = holidays.holiday_calendar(spark, "2024-12-27", "2024-12-27").first()
    assert (r.days_to_next_holiday, r.days_since_prev_holiday, r.next_holiday_name, r.prev_holiday_name) == (5, 2, "New Year's Day", "Christmas Day")
    with pytest.raises(contracts.ContractError):
        holidays.holiday_calendar(spark, "2024-02-01", "2024-01-01")
    rows = spark.createDataFrame([("2024-12-25",), ("2024-12-26",)], "FlightDate string")
    assert [r.days_since_prev_holiday for r in holidays.add_holidays(rows).orderBy("FlightDate").collect()] == [0, 1]
    with pytest.raises(contracts.ContractError):
        holidays.add_holidays(spark.createDataFrame([("no date",)], "FlightDate string"))


def _outcomes(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(rng.choice([d for d in range(90) if d != 40])), rng.choice("xyz"), int(rng.random() < 0.3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, d date, g string, late int")


def test_recent_rates_by_hand(spark):
    rows, df = _outcomes(spark)
    spec = recent.RecentSpec("g", ("g",), 7, 10)
    found = {r.id: r for r in recent.add_recent_rates(df, (7,), [spec], "d", "late").collect()}
    for i, d, g, _ in rows:
        past = [(gg, y) for _, dd, gg, y in rows if 2 <= (d - dd).days <= 8]
        nation = sum(y for _, y in past) / len(past) if past else 0.2
        own = [y for gg, y in past if gg == g]
        assert found[i].national_delay_rate_7d == pytest.approx(nation, abs=1e-6) and found[i].g_delay_rate_7d == pytest.approx((sum(own) + 10 * nation) / (len(own) + 10), abs=1e-6)
    recent.require_rates(recent.add_recent_rates(df, (7,), [spec], "d", "late"), recent.feature_names((7,), [spec]))


def test_future_outcomes_change_nothing(spark):
    _, df = _outcomes(spark)
    day = dt.date(2024, 2, 15)
    spec = recent.RecentSpec("g", ("g",), 7, 10)
    flipped = df.withColumn("late", F.when(F.col("d") > F.lit(day - dt.timedelta(2)), 1 - F.col("late")).otherwise(F.col("late")))
    get = lambda x: {r.id: (r.national_delay_rate_7d, r.g_delay_rate_7d) for r in recent.add_recent_rates(x, (7,), [spec], "d", "late").filter(F.col("d") <= F.lit(day)).collect()}
    assert get(df) == get(flipped)
    month = df.withColumn("late", F.when(F.month("d") == 3, 1 - F.col("late")).otherwise(F.col("late")))
    s = [history.RateSpec("g", ("g",), 5)]
    past = lambda x: {r.id: (r.hist_g_delay_rate, r.hist_g_log_count) for r in history.add_expanding_rates(x, s, "d", "late").collect()}
    assert past(df) == past(month)


def test_recent_checks(spark):
    _, df = _outcomes(spark, 20)
    for bad in ({"national": (7, 7)}, {"prior": 1.0}, {"lag": 0}, {"national": (3,)}):
        with pytest.raises(contracts.ContractError):
            recent.add_recent_rates(df, **({"national": (7,), "specs": [recent.RecentSpec("g", ("g",), 7, 1)], "date_col": "d", "target": "late"} | bad))
    with pytest.raises(contracts.ContractError):
        recent.add_recent_rates_to_splits(df, df, date_col="d", national=(7,), specs=[], target="late")


def test_history_by_hand(spark, tmp_path):
    rows = spark.createDataFrame([(dt.date(2024, 1, 5), None, 1), (dt.date(2024, 1, 6), "a", 0), (dt.date(2024, 2, 1), None, 0), (dt.date(2024, 2, 2), "b", 1)], "d date, k string, late int")
    spec = history.RateSpec("k", ("k",), 2)
    found = {(r.d.month, r.k): r for r in history.add_expanding_rates(rows, [spec], "d", "late").collect()}
    assert found[1, "a"].hist_k_delay_rate == pytest.approx(0.2) and found[1, "a"].hist_k_log_count == 0
    assert found[2, None].hist_k_delay_rate == pytest.approx((1 + 2 * 0.5) / 3) and found[2, "b"].hist_k_delay_rate == pytest.approx(0.5)
    state = history.fit_rates(rows, [spec], "late")
    state.save(str(tmp_path / "state"))
    again = history.RateState.load(spark, str(tmp_path / "state"))
    out = {r.k: r for r in history.apply_rates(spark.createDataFrame([(None,), ("new",)], "k string"), again).collect()}
    assert out[None].hist_k_delay_rate == pytest.approx((1 + 2 * 0.5) / 4) and out["new"].hist_k_delay_rate == pytest.approx(0.5) and out["new"].hist_k_log_count == 0


def test_statistics(spark):
    rows = spark.createDataFrame([(x,) for x in (1, 1, 1, 2, 3, 4, None)], "x int")
    assert sorted((r.x, r.bin) for r in stats.qcut(rows, "x", 4).collect() if r.x) == [(1, 0)] * 3 + [(2, 1), (3, 2), (4, 2)]
    assert [one(spark, S.cut(F.lit(v), *reports.GUST)) for v in (0.0, 9.9, 10.0, 40.0)] == ["0-10", "0-10", "10-20", "40+"]
    assert one(spark, S.wilson(F.lit(0), F.lit(0))[0]) is None
    z = stats.robust_z(spark.createDataFrame([("a", 1.0), ("a", 1.0), (None, 1.0), (None, 3.0), (None, 4.0)], "g string, v double"), "v", ["g"])
    assert sorted((r.g or "", r.v, r.robust_z and round(r.robust_z, 4)) for r in z.collect()) == [("", 1.0, -1.349), ("", 3.0, 0.0), ("", 4.0, 0.6745), ("a", 1.0, None), ("a", 1.0, None)]
    days = spark.createDataFrame([(i, float(i)) for i in range(40)], "i int, v double").withColumn("m", windows.centred(F.col("v"), 30, 10, [], "i"))
    assert {r.i: r.m for r in days.collect()}[20] == 19.5


def test_metrics_by_hand(spark):
    rng = random.Random(1)
    rows = [(i, rng.random() < 0.4, round(rng.random(), 1)) for i in range(300)]
    df = spark.createDataFrame([(i, int(y), p) for i, y, p in rows], "id int, y int, p double")
    auc = sum((a > b) + (a == b) / 2 for _, y, a in rows if y for _, z, b in rows if not z) / (sum(y for _, y, _ in rows) * sum(not y for _, y, _ in rows))
    assert metrics.roc_auc(df, "y", "p").first()[0] == pytest.approx(auc)
    ap, seen = 0.0, 0
    for t in sorted({p for *_, p in rows}, reverse=True):
        got = [y for _, y, p in rows if p >= t]
        ap += (sum(got) - seen) / sum(y for _, y, _ in rows) * sum(got) / len(got)
        seen = sum(got)
    assert metrics.average_precision(df, "y", "p").first()[0] == pytest.approx(ap)
    ranked = sorted(rows, key=lambda r: (-r[2], r[0]))[:30]
    r = metrics.alert_volume(df, "y", "p", "id", [0.1]).first()
    assert (r.flagged, r.cutoff) == (30, ranked[-1][2]) and r.precision == pytest.approx(sum(y for _, y, _ in ranked) / 30)
    s = metrics.summary(df, "y", "p", "id").first()
    assert s.roc_auc == pytest.approx(auc) and 0 < s.ece < 1


def test_tree_attributions_add_up(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(i, rng.random(), rng.choice(["a", "b", None]), None if i % 7 == 0 else rng.random()) for i in range(400)], "id int, x double, c string, z double").withColumn("y", ((F.col("x") > 0.5) | (F.col("c") == "b")).cast("int")).fillna(0, ["y"])
    fitted = model.fit_delay_model(rows, "y", ["x", "z"], ["c"], rounds=4, depth=3, rate=0.3, min_hessian=1.0)
    found = model.tree_attributions(fitted, rows.limit(25), "id").collect()
    keys = {r.key for r in found}
    for k in keys:
        own = {r.feature: r.contribution for r in found if r.key == k}
        assert sum(v for f, v in own.items() if f != "__margin") == pytest.approx(own["__margin"], abs=1e-6)
    assert {r.feature for r in model.mean_attributions(model.tree_attributions(fitted, rows.limit(25), "id")).filter("rank <= 2").collect()} == {"x", "c"}
    assert fitted.score(rows).filter("p_delay between 0 and 1").count() == 400
    new = fitted.score(rows.withColumn("c", F.lit("never seen")))
    assert new.count() == 400


def test_feature_lists():
    assert len(model.feature_list()) == 55 and len(model.feature_list("01")) == 37 and len(model.feature_list("02")) == 49 and len(model.feature_list("03")) == 54
    contracts.forbid_leakage(model.feature_list(), model.OUTCOMES)
    with pytest.raises(contracts.ContractError):
        contracts.forbid_leakage(["ArrDelay"], model.OUTCOMES)
    with pytest.raises(contracts.ContractError):
        contracts.require_same_features(["a"], ["b"])


def test_contracts_and_joins(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    with pytest.raises(contracts.ContractError):
        contracts.require_unique(df, ["a", "b"])
    with pytest.raises(KeyError):
        contracts.require_columns(df, ["zz"])
    with pytest.raises(contracts.ContractError):
        contracts.many_to_one(df, df, ["a"])
    right = spark.createDataFrame([(None, 7)], "b string, v int")
    assert sorted(str(r.v) for r in joins.null_safe_left(df, right, ["b"]).collect()) == ["7", "7", "None"]
    airports = spark.createDataFrame([("ELP", "TX"), ("DFW", "TX")], "Airport string, State string")
    assert {r.Airport: r.timezone for r in zones.airport_zones(airports).collect()} == {"ELP": "America/Denver", "DFW": "America/Chicago"}
    with pytest.raises(contracts.ContractError):
        zones.airport_zones(spark.createDataFrame([("AAA", "??")], "Airport string, State string"))


def test_samples_are_stable(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 5)
    a, b = (sampling.stratified(df, ["g"], ["id"], 200).collect() for _ in range(2))
    assert a == b and 120 < len(a) < 280
    assert {r["count"] for r in sampling.per_group(df, ["g"], ["id"], 7).groupBy("g").count().collect()} == {7}
