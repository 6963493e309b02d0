"""The whole preparation of model rows as one query, and what the model reads of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import weather as WX
from skyledger.operators import history, holidays, model, prepare, weather
from skyledger.operators.target import build_target
from skyledger.plans.registry import register
from skyledger.plans.tables import FLIGHTS, OBSERVATIONS, flights, read
from skyledger.plans.temporal import _FIRST, _LAST, _SNAP

#: Zones of the twelve made airports, by number modulo five, and their winter clocks in minutes from UTC.
_ZONES = ("America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "America/Phoenix")
_OFFSETS = (-300, -360, -420, -480, -420)
_OBSERVED = """ob AS (SELECT 'A' || user_id % 12 AS airport, ts AS observation_time_local, max(value) AS wind_gust_kt, max(value) / 4 AS precip_mm, max(value) * 40 AS ceiling_ft, max(value) / 12 AS visibility_sm FROM events GROUP BY ALL)"""
_HOLIDAYS = ", ".join(f"(DATE '{day}', '{name.replace(chr(39), chr(39) * 2)}')" for day, name in holidays.us_holidays(range(2023, 2026)))
_FRAME = "OVER (PARTITION BY airport ORDER BY hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
_PREPARED = f"""{_SNAP.replace(OBSERVATIONS, _OBSERVED)},
  k AS (SELECT *, CASE WHEN cat IS NOT NULL THEN CAST(cat IN ('IFR', 'LIFR') AS INTEGER) END AS low, CASE WHEN t IS NOT NULL AND t = lag(t) OVER (PARTITION BY airport ORDER BY hour) THEN NULL ELSE rain END AS fresh FROM h),
  wx AS (SELECT airport, hour, t, gust, cat, CAST(sum(low) {_FRAME} AS INTEGER) AS ifr, sum(fresh) {_FRAME} AS rain3, max(gust) {_FRAME} AS gust3 FROM k),
  hol(h, name) AS (VALUES {_HOLIDAYS}), cal AS (SELECT DISTINCT ts::DATE AS d FROM events), cc AS (SELECT d, min(h) FILTER (h >= d) AS nx, max(h) FILTER (h <= d) AS pv FROM cal, hol GROUP BY d),
  cn AS (SELECT d, CAST(nx - d AS INTEGER) AS to_next, CAST(d - pv AS INTEGER) AS since, a.name AS next_name, b.name AS prev_name FROM cc JOIN hol a ON a.h = nx JOIN hol b ON b.h = pv),
  fl AS (SELECT event_id AS id, ts::DATE AS d, date_trunc('minute', ts) AS dep, user_id % 12 AS o, (user_id + event_id) % 12 AS e, event_id % 240 AS mins, event_id % 17 = 0 AS gone, event_id % 17 <> 0 AND event_id % 19 = 0 AS away, event_id % 2 = 0 AS reached, event_id % 50 AS div_delay, event_id % 60 - 20 AS delay FROM events),
  fz AS (SELECT *, date_trunc('hour', dep) AS hour, dep + to_minutes(CAST({list(_OFFSETS)}[e % 5 + 1] - {list(_OFFSETS)}[o % 5 + 1] AS INTEGER)) AS there FROM fl),
  deps AS (SELECT o, hour, count(*) AS n FROM fz GROUP BY ALL), arr AS (SELECT e, date_trunc('hour', there + to_minutes(CAST(mins AS INTEGER))) AS hour, count(*) AS n FROM fz GROUP BY ALL),
  rows AS (SELECT fz.*, CASE WHEN away THEN div_delay >= 15 ELSE delay >= 15 END AS late FROM fz WHERE NOT gone AND (NOT away OR reached)),
  prepared AS (SELECT id, dep AS dep_time_local, there AS dest_departure_time_local, CAST(late AS INTEGER) AS late, to_next, since, next_name, prev_name, CAST(deps.n AS INTEGER) AS deps, CAST(coalesce(x.n, 0) AS INTEGER) AS arrivals, CAST(deps.n + coalesce(x.n, 0) AS INTEGER) AS ops, CAST(coalesce(y.n, 0) AS INTEGER) AS dest_arrivals,
    a.cat AS origin_category, round(a.gust, 4) AS origin_gust, a.ifr AS origin_ifr, round(a.rain3, 4) AS origin_rain, round(a.gust3, 3) AS origin_gust3, CAST(round(CAST((epoch_us(dep) - epoch_us(a.t)) / 6e7 AS FLOAT)::DOUBLE * 60) AS BIGINT) AS origin_age, CAST(a.t IS NULL AS INTEGER) AS origin_missing,
    b.cat AS dest_category, round(b.gust, 3) AS dest_gust, CAST(round(CAST((epoch_us(there) - epoch_us(b.t)) / 6e7 AS FLOAT)::DOUBLE * 60) AS BIGINT) AS dest_age, CASE WHEN b.hour IS NOT NULL THEN CAST(b.t IS NULL AS INTEGER) END AS dest_missing
  FROM rows JOIN cn USING (d) JOIN deps ON deps.o = rows.o AND deps.hour = rows.hour LEFT JOIN arr x ON x.e = rows.o AND x.hour = rows.hour LEFT JOIN arr y ON y.e = rows.e AND y.hour = date_trunc('hour', there)
    LEFT JOIN wx a ON a.airport = 'A' || rows.o AND a.hour = rows.hour LEFT JOIN wx b ON b.airport = 'A' || rows.e AND b.hour = date_trunc('hour', there))"""


def prepared(spark, d):
    """Events as a period of flights between twelve airports, with their own observations as weather, through ``prepare_period``."""
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    port = lambda c: F.concat(F.lit("A"), (c % 12).cast("string"))
    n = F.col("event_id")
    away = (n % 17 != 0) & (n % 19 == 0)
    rows = e.select(
        n.alias("id"), F.col("ts").cast("date").alias("FlightDate"), (F.hour("ts") * 100 + F.minute("ts")).alias("CRSDepTime"), port(F.col("user_id")).alias("Origin"), port(F.col("user_id") + n).alias("Dest"), (n % 240).cast("int").alias("CRSElapsedTime"),
        (n % 17 == 0).cast("float").alias("Cancelled"), away.cast("float").alias("Diverted"), F.when(away, (n % 2 == 0).cast("float")).alias("DivReachedDest"), F.when(away, (n % 50).cast("float")).alias("DivArrDelay"),
        F.when(~away & (n % 17 != 0), (n % 60 - 20).cast("float")).alias("ArrDelay"), F.when(~away & (n % 17 != 0), F.greatest(n % 60 - 20, F.lit(0)).cast("float")).alias("ArrDelayMinutes"), F.when(~away & (n % 17 != 0), (n % 60 - 20 >= 15).cast("int")).alias("ArrDel15"),
    )
    seen = e.groupBy(port(F.col("user_id")).alias("airport"), F.col("ts").alias("observation_time_local")).agg(F.max("value").alias("wind_gust_kt"))
    seen = seen.withColumns({"precip_mm": F.col("wind_gust_kt") / 4, "ceiling_ft": F.col("wind_gust_kt") * 40, "visibility_sm": F.col("wind_gust_kt") / 12, "wind_speed_kt": F.col("wind_gust_kt") / 2, "frozen_precip": F.lit(0), "thunderstorm": F.lit(0), "temp_c": F.lit(None).cast("double")})
    hourly = weather.snapshots(seen, _FIRST, _LAST)
    hourly = weather.add_history(hourly.withColumn("flight_category", WX.flight_category(F.col("ceiling_ft"), F.col("visibility_sm"))), checked=False)
    lookup = spark.createDataFrame([(f"A{i}", _ZONES[i % 5]) for i in range(12)], "Airport string, timezone string")
    return prepare.prepare_period(build_target(rows), hourly, lookup)


@register("d23_p11_prepared_period", f"WITH {_PREPARED} SELECT * FROM prepared")
def _(spark, d):
    r = lambda c, k=3: F.round(F.col(c).cast("double"), k)
    whole = lambda c: F.col(c).cast("int")
    seconds = lambda c: F.round(F.col(c).cast("double") * 60).cast("long")
    return prepared(spark, d).select(
        "id", "dep_time_local", "dest_departure_time_local", whole("ArrDel15").alias("late"), whole("days_to_next_holiday").alias("to_next"), whole("days_since_prev_holiday").alias("since"), F.col("next_holiday_name").alias("next_name"), F.col("prev_holiday_name").alias("prev_name"),
        F.col("origin_sched_deps_this_hour").alias("deps"), F.col("origin_sched_arrivals_this_hour").alias("arrivals"), F.col("origin_sched_ops_this_hour").alias("ops"), F.col("dest_sched_arrivals_this_hour").alias("dest_arrivals"),
        F.col("origin_flight_category").alias("origin_category"), r("origin_wind_gust_kt", 4).alias("origin_gust"), whole("origin_ifr_hours_past3").alias("origin_ifr"), r("origin_precip_3h", 4).alias("origin_rain"), r("origin_max_gust_3h").alias("origin_gust3"), seconds("origin_weather_age_minutes").alias("origin_age"), whole("origin_weather_observation_missing").alias("origin_missing"),
        F.col("dest_flight_category").alias("dest_category"), r("dest_wind_gust_kt").alias("dest_gust"), seconds("dest_weather_age_minutes").alias("dest_age"), whole("dest_weather_observation_missing").alias("dest_missing"),
    )


@register("m1_feature_lists", f"""WITH {_PREPARED} SELECT f.feature, f.known FROM (SELECT count(late) AS n, count(to_next) AS a, count(deps) AS b, count(origin_category) AS c, count(origin_ifr) AS x, count(origin_gust3) AS g, count(dest_category) AS e, count(dest_missing) AS m FROM prepared),
  LATERAL (SELECT * FROM (VALUES ('Origin', n), ('CRSDepTime', n), ('days_to_next_holiday', a), ('origin_sched_deps_this_hour', b), ('origin_flight_category', c), ('origin_ifr_hours_past3', x), ('origin_max_gust_3h', g), ('dest_flight_category', e), ('dest_weather_observation_missing', m)) v(feature, known)) f""")
def _(spark, d):
    """Features of the first experiment's list that the prepared rows have, and in how many rows each is known."""
    rows = prepared(spark, d)
    shown = ("Origin", "CRSDepTime", "days_to_next_holiday", "origin_sched_deps_this_hour", "origin_flight_category", "origin_ifr_hours_past3", "origin_max_gust_3h", "dest_flight_category", "dest_weather_observation_missing")
    asked = [c for c in model.feature_list("01") if c in rows.columns and c in shown]
    one = rows.agg(*(F.count(c).alias(c) for c in asked), F.lit(1).alias("one"))
    return one.unpivot("one", asked, "feature", "known").select("feature", "known")


_GROUPS = ("carrier", ("carrier",)), ("origin", ("origin",)), ("dest", ("dest",)), ("route", ("origin", "dest")), ("carrier_route", ("carrier", "origin", "dest")), ("origin_hour", ("origin", "dep_hour"))


@register("d19_d24_rate_groups", f"WITH {FLIGHTS}, x AS (SELECT *, CAST(flight % 24 AS INTEGER) AS dep_hour, avg(late) OVER () AS prior FROM f), " + ", ".join(
    f"g{i} AS (SELECT '{spec.name}' AS name, count(*) AS groups, CAST(sum(p) AS BIGINT) AS positives, round(avg((p + {spec.strength} * prior) / (n + {spec.strength})), 4) AS mean_rate FROM (SELECT sum(late) AS p, count(*) AS n, any_value(prior) AS prior FROM x GROUP BY {', '.join(cols)}))" for i, (spec, (_, cols)) in enumerate(zip(history.DEFAULT_SPECS, _GROUPS)))
    + " " + " UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(len(_GROUPS))))
def _(spark, d):
    """The groups whose rates are kept, fitted on a table: how many there are, their positives, and the mean smoothed rate."""
    rows = flights(spark, d).select(F.col("carrier").alias("Reporting_Airline"), F.col("origin").alias("Origin"), F.col("dest").alias("Dest"), (F.col("flight") % 24).cast("int").alias("dep_hour"), F.col("late").alias("ArrDel15"))
    state = history.fit_rates(rows)
    out = None
    for spec in state.specs:
        table = state.tables[spec.name]
        rate = (F.col("positives") + spec.strength * F.lit(state.global_rate)) / (F.col("count") + spec.strength)
        one = table.agg(F.lit(spec.name).alias("name"), F.count("*").alias("groups"), F.sum("positives").cast("long").alias("positives"), F.round(F.avg(rate), 4).alias("mean_rate"))
        out = one if out is None else out.unionByName(one)
    return out
