"""Queries of as-of snapshots, rolling and expanding values, calendars, demand and derived clock and weather columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyledger.functions import times as T
from skyledger.functions import weather as WX
from skyledger.operators import demand, history, holidays, joins, recent, reports, weather, windows
from skyledger.operators.asof import asof_join
from skyledger.operators.clocks import add_converted, transition_rows, transitions
from skyledger.operators.history import RateSpec
from skyledger.plans.registry import register
from skyledger.plans.tables import FLIGHTS, OBSERVATIONS, OUTCOME_DAYS, flights, observations, outcome_days, read, rounded
from skyledger.sources.scratch import new_path, written
from skyledger.streaming.history import daily_group_counts, month_closings, with_closed_rates
from skyledger.streaming.snapshots import streaming_snapshots

_FIRST, _LAST = "2024-01-01 00:00:00", "2024-01-30 23:00:00"
_GRID = f"g AS (SELECT airport, unnest(generate_series(TIMESTAMP '{_FIRST}', TIMESTAMP '{_LAST}', INTERVAL 1 HOUR)) AS hour FROM (SELECT DISTINCT airport FROM ob))"
_SNAP = f"""{OBSERVATIONS}, {_GRID}, j AS (SELECT g.airport, g.hour, ob.observation_time_local AS t, ob.wind_gust_kt AS gust, ob.precip_mm AS rain, ob.ceiling_ft AS c, ob.visibility_sm AS v FROM g ASOF LEFT JOIN ob ON g.airport = ob.airport AND g.hour >= ob.observation_time_local),
  n AS (SELECT airport, hour, CASE WHEN t >= hour - INTERVAL 90 MINUTE THEN t END AS t, CASE WHEN t >= hour - INTERVAL 90 MINUTE THEN gust END AS gust, CASE WHEN t >= hour - INTERVAL 90 MINUTE THEN rain END AS rain,
  CASE WHEN t >= hour - INTERVAL 90 MINUTE THEN c END AS c, CASE WHEN t >= hour - INTERVAL 90 MINUTE THEN v END AS v FROM j),
  h AS (SELECT *, CASE WHEN c IS NULL OR v IS NULL THEN NULL WHEN c < 500 OR v < 1 THEN 'LIFR' WHEN c < 1000 OR v < 3 THEN 'IFR' WHEN c <= 3000 OR v <= 5 THEN 'MVFR' ELSE 'VFR' END AS cat FROM n)"""


def _hourly(spark, d):
    rows = weather.snapshots(observations(spark, d), _FIRST, _LAST)
    return rows.withColumn("flight_category", WX.flight_category(F.col("ceiling_ft"), F.col("visibility_sm")))


@register("j1_d14_asof_snapshot", f"WITH {_SNAP} SELECT airport, hour, t AS observation_time_local, gust AS wind_gust_kt, round(epoch_us(hour - t) / 6e7, 4) AS age, CAST(t IS NULL AS INTEGER) AS missing FROM h".replace("epoch_us(hour - t)", "(epoch_us(hour) - epoch_us(t))"))
def _(spark, d):
    rows = _hourly(spark, d)
    return rows.select("airport", "hour", "observation_time_local", "wind_gust_kt", F.round("snapshot_age_minutes", 4).alias("age"), F.col("weather_observation_missing").cast("int").alias("missing"))


@register("j1_asof_without_tolerance", """WITH r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL), l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error')
  SELECT l.event_id, l.ts, r.ts AS last_ts, r.value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def _(spark, d):
    e = read(spark, d, "events")
    right = e.filter("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("last_ts")).agg(F.max("value").alias("value"))
    return asof_join(e.filter("event_type = 'error'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "last_ts").select("event_id", "ts", "last_ts", "value")


@register("q15_q16_snapshot_audit", f"""WITH {_SNAP} SELECT count(*) AS rows, count(t) AS matched, count(*) FILTER (t > hour) AS future, round(quantile_cont((epoch_us(hour) - epoch_us(t)) / 6e7, 0.5), 4) AS p50, round(quantile_cont((epoch_us(hour) - epoch_us(t)) / 6e7, 0.95), 4) AS p95,
  count(*) FILTER ((epoch_us(hour) - epoch_us(t)) / 6e7 > 60) AS over_60 FROM h""")
def _(spark, d):
    from skyledger.operators.stats import quantiles

    age = F.col("snapshot_age_minutes")
    ages = written(_hourly(spark, d).select(age), "ages")  # known where an observation is
    plain = ages.agg(F.count("*").alias("rows"), F.count(age).alias("matched"), F.count_if(age < 0).alias("future"), F.count_if(age > 60).alias("over_60"))
    exact = quantiles(ages, "snapshot_age_minutes", [0.5, 0.95]).toDF("p50", "p95")
    return plain.join(F.broadcast(exact)).select("rows", "matched", "future", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), "over_60")  # one row each


@register("q17_coverage", f"WITH {_SNAP} SELECT airport, count(*) AS hours, round(count(t) / count(*), 6) AS covered, count(t) / count(*) < 0.1 AS low FROM h GROUP BY airport")
def _(spark, d):
    from skyledger.operators.audits import coverage

    return rounded(coverage(_hourly(spark, d), 0.1))


@register("e_e2_rate_by_category", f"WITH {_SNAP} SELECT cat AS flight_category, count(*) AS hours, round(avg(gust), 4) AS gust FROM h WHERE cat IS NOT NULL GROUP BY cat")
def _(spark, d):
    return _hourly(spark, d).filter("flight_category is not null").groupBy("flight_category").agg(F.count("*").alias("hours"), F.round(F.avg("wind_gust_kt"), 4).alias("gust"))


def _history_sql(first: str, last: str) -> str:
    frame = f"OVER (PARTITION BY airport ORDER BY hour ROWS BETWEEN {first} AND {last})"
    return f"""WITH {_SNAP}, k AS (SELECT *, CASE WHEN cat IS NOT NULL THEN CAST(cat IN ('IFR', 'LIFR') AS INTEGER) END AS low, CASE WHEN t IS NOT NULL AND t = lag(t) OVER (PARTITION BY airport ORDER BY hour) THEN NULL ELSE rain END AS fresh FROM h),
  r AS (SELECT airport, hour, CAST(sum(low) {frame} AS INTEGER) AS ifr_hours, round(sum(fresh) {frame}, 4) AS precip_3h, max(gust) {frame} AS max_gust_3h FROM k) SELECT * FROM r"""


def _history(spark, d, include_current):
    rows = weather.add_history(_hourly(spark, d), include_current=include_current, checked=False)
    return rows.select("airport", "hour", F.col("ifr_hours_past3").cast("int").alias("ifr_hours"), F.round("precip_3h", 4).alias("precip_3h"), "max_gust_3h")


@register("w3_d7_rolling_history", _history_sql("2 PRECEDING", "CURRENT ROW"))
def _(spark, d):
    return _history(spark, d, True)


@register("w4_d7_rolling_history_exclusive", _history_sql("3 PRECEDING", "1 PRECEDING"))
def _(spark, d):
    return _history(spark, d, False)


@register("w2_hourly_steps", f"WITH {OBSERVATIONS}, {_GRID}, s AS (SELECT (epoch_us(hour) - epoch_us(lag(hour) OVER (PARTITION BY airport ORDER BY hour))) / 6e7 AS step FROM g) SELECT count(*) AS rows, count(step) AS steps, count(*) FILTER (step <> 60) AS bad FROM s")
def _(spark, d):
    grid = joins.hours_of(observations(spark, d).select("airport").distinct().withColumns({"a": F.lit(_FIRST).cast("timestamp_ntz"), "z": F.lit(_LAST).cast("timestamp_ntz")}), ["airport"], "a", "z")
    step = grid.withColumn("step", windows.step_minutes("hour", ["airport"]))
    return step.agg(F.count("*").alias("rows"), F.count("step").alias("steps"), F.count_if(F.col("step") != 60).alias("bad"))


@register("w1_lag_changes", f"WITH {OUTCOME_DAYS}, g AS (SELECT grp, d, count(*) AS n FROM e GROUP BY ALL) SELECT grp, d, n, lag(n) OVER (PARTITION BY grp ORDER BY d) AS before FROM g")
def _(spark, d):
    g = outcome_days(spark, d).groupBy("grp", "d").agg(F.count("*").alias("n"))
    return g.withColumn("before", F.lag("n").over(Window.partitionBy("grp").orderBy("d")))


@register("w8_e_g1_outlier_days", f"""WITH {FLIGHTS}, g AS (SELECT d, count(*)::DOUBLE AS n FROM f GROUP BY d), m AS (SELECT *, CASE WHEN count(n) OVER w >= 10 THEN median(n) OVER w END AS md FROM g WINDOW w AS (ORDER BY d ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)),
  a AS (SELECT *, CASE WHEN count(abs(n - md)) OVER w >= 10 THEN median(abs(n - md)) OVER w END AS mad FROM m WINDOW w AS (ORDER BY d ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING))
  SELECT d, n, md AS median, mad, round(md + 3.0 * 1.4826 * mad, 4) AS upper, coalesce(n > md + 3.0 * 1.4826 * mad, false) AS outlier FROM a""")
def _(spark, d):
    daily = flights(spark, d).groupBy("d").agg(F.count("*").cast("double").alias("n"))
    # rounded as a scaled number: the limit often ends in 5 at the fifth digit, where decimal and binary rounding differ
    return reports.outlier_days(daily, "d", "n").withColumn("upper", F.round(F.col("upper") * 10_000) / 10_000)


@register("w7_running_totals", "WITH g AS (SELECT round(value, 1) AS v, count(*) AS n FROM events GROUP BY ALL) SELECT v, n, CAST(sum(n) OVER (ORDER BY v DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_n FROM g")
def _(spark, d):
    g = read(spark, d, "events").groupBy(F.round("value", 1).alias("v")).agg(F.count("*").alias("n"))
    return windows.running_totals(g, "v", ["n"])


_NATION = """c AS (SELECT unnest(generate_series((SELECT min(d) FROM e)::TIMESTAMP, (SELECT max(d) FROM e)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d),
  dn AS (SELECT c.d, coalesce(sum(late), 0) AS p, count(id) AS n FROM c LEFT JOIN e USING (d) GROUP BY c.d),
  nat AS (SELECT d, coalesce(sum(p) OVER w7 / nullif(sum(n) OVER w7, 0), 0.2) AS n7, coalesce(sum(p) OVER w28 / nullif(sum(n) OVER w28, 0), 0.2) AS n28 FROM dn
    WINDOW w7 AS (ORDER BY d ROWS BETWEEN 8 PRECEDING AND 2 PRECEDING), w28 AS (ORDER BY d ROWS BETWEEN 29 PRECEDING AND 2 PRECEDING))"""
_GROUP = """gd AS (SELECT k.grp, c.d, coalesce(sum(late), 0) AS p, count(id) AS n FROM (SELECT DISTINCT grp FROM e) k CROSS JOIN c LEFT JOIN e ON e.grp = k.grp AND e.d = c.d GROUP BY ALL),
  gr AS (SELECT grp, d, (coalesce(sum(p) OVER w, 0) + 20 * n28) / (coalesce(sum(n) OVER w, 0) + 20) AS r FROM gd JOIN nat USING (d) WINDOW w AS (PARTITION BY grp ORDER BY d ROWS BETWEEN 29 PRECEDING AND 2 PRECEDING))"""
_SPEC = recent.RecentSpec("grp", ("grp",), 28, 20)


@register("d20_national_recent_rates", f"WITH {OUTCOME_DAYS}, {_NATION} SELECT d, round(n7, 6) AS national_delay_rate_7d, round(n28, 6) AS national_delay_rate_28d FROM nat")
def _(spark, d):
    return rounded(recent.national_rates(outcome_days(spark, d), date_col="d", target="late"))


@register("d20_d22_recent_rates_and_pressure", f"WITH {OUTCOME_DAYS}, {_NATION}, {_GROUP} SELECT id, round(n7::FLOAT::DOUBLE, 4) AS national_delay_rate_7d, round(n28::FLOAT::DOUBLE, 4) AS national_delay_rate_28d, round(r::FLOAT::DOUBLE, 4) AS grp_delay_rate_28d, round((n7::FLOAT - n28::FLOAT)::DOUBLE, 4) AS delay_pressure FROM e JOIN nat USING (d) JOIN gr USING (grp, d)")
def _(spark, d):
    rows = recent.add_recent_rates(outcome_days(spark, d), specs=[_SPEC], date_col="d", target="late")
    return recent.add_pressure(rows).select("id", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in ("national_delay_rate_7d", "national_delay_rate_28d", "grp_delay_rate_28d", "delay_pressure")))


@register("d21_recent_rates_of_later_split", f"WITH {OUTCOME_DAYS}, {_NATION}, {_GROUP} SELECT id, round(r::FLOAT::DOUBLE, 4) AS grp_delay_rate_28d FROM e JOIN gr USING (grp, d) WHERE d >= DATE '2024-01-20'")
def _(spark, d):
    rows = outcome_days(spark, d)
    later = recent.add_recent_rates_to_splits(rows.filter("d < date'2024-01-20'"), rows.filter("d >= date'2024-01-20'"), date_col="d", specs=[_SPEC], target="late")[1]
    return later.select("id", F.round(F.col("grp_delay_rate_28d").cast("double"), 4).alias("grp_delay_rate_28d"))


@register("e_h_monthly_recent_means", f"WITH {OUTCOME_DAYS}, {_NATION}, {_GROUP} SELECT grp, round(avg(r::FLOAT::DOUBLE), 4) AS recent, round(avg(late), 4) AS actual FROM e JOIN gr USING (grp, d) GROUP BY grp")
def _(spark, d):
    rows = recent.add_recent_rates(outcome_days(spark, d), specs=[_SPEC], date_col="d", target="late")
    return rows.groupBy("grp").agg(F.round(F.avg(F.col("grp_delay_rate_28d").cast("double")), 4).alias("recent"), F.round(F.avg("late"), 4).alias("actual"))


_SPECS = (history.RateSpec("carrier", ("carrier",), 2000), history.RateSpec("route", ("o2", "dest"), 200))


def _model_rows(spark, d):
    return flights(spark, d).withColumn("o2", F.nullif(F.col("origin"), F.lit(3)))


_ROWS = f"{FLIGHTS}, r AS (SELECT *, nullif(origin, 3) AS o2, date_trunc('month', d)::DATE AS m FROM f)"
_PRIOR = "mp AS (SELECT m, coalesce(sum(p) OVER w / nullif(sum(n) OVER w, 0), 0.2) AS g FROM (SELECT m, sum(late) AS p, count(*) AS n FROM r GROUP BY m) WINDOW w AS (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


def _expanding_sql(name: str, keys: str, strength: int, on: str) -> str:
    return f"""WITH {_ROWS}, {_PRIOR}, k AS (SELECT {keys}, m, coalesce(sum(p) OVER w, 0) AS p, coalesce(sum(n) OVER w, 0) AS n FROM (SELECT {keys}, m, sum(late) AS p, count(*) AS n FROM r GROUP BY ALL)
    WINDOW w AS (PARTITION BY {keys} ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT {', '.join('r.' + x for x in keys.split(', '))}, r.m AS month, count(*) AS rows, round(avg(((k.p + {strength} * g) / (k.n + {strength}))::FLOAT::DOUBLE), 4) AS rate, round(avg(ln(1 + k.n)::FLOAT::DOUBLE), 4) AS log_count FROM r JOIN mp USING (m) JOIN k ON r.m = k.m AND {on} GROUP BY ALL"""


def _expanding(spark, d, spec):
    rows = history.add_expanding_rates(_model_rows(spark, d), [spec], "d", "late")
    rate, count = spec.outputs
    return rows.groupBy(*spec.columns, T.month_start(F.col("d")).alias("month")).agg(F.count("*").alias("rows"), F.round(F.avg(F.col(rate).cast("double")), 4).alias("rate"), F.round(F.avg(F.col(count).cast("double")), 4).alias("log_count"))


@register("d16_w6_expanding_history_carrier", _expanding_sql("carrier", "carrier", 2000, "r.carrier = k.carrier"))
def _(spark, d):
    return _expanding(spark, d, _SPECS[0])


@register("d16_j9_expanding_history_route_null_keys", _expanding_sql("route", "o2, dest", 200, "r.o2 IS NOT DISTINCT FROM k.o2 AND r.dest = k.dest"))
def _(spark, d):
    return _expanding(spark, d, _SPECS[1])


@register("d17_d18_frozen_history", f"""WITH {_ROWS}, tr AS (SELECT * FROM r WHERE d < DATE '2000-01-01'), te AS (SELECT * FROM r WHERE d >= DATE '2000-01-01'), g AS (SELECT avg(late) AS g FROM tr), s AS (SELECT o2, dest, sum(late) AS p, count(*) AS n FROM tr GROUP BY ALL)
  SELECT te.o2, te.dest, count(*) AS rows, round(avg(((coalesce(p, 0) + 200 * g) / (coalesce(n, 0) + 200))::FLOAT::DOUBLE), 4) AS rate, round(avg(ln(1 + coalesce(n, 0))::FLOAT::DOUBLE), 4) AS log_count FROM te CROSS JOIN g LEFT JOIN s ON te.o2 IS NOT DISTINCT FROM s.o2 AND te.dest = s.dest GROUP BY ALL""")
def _(spark, d):
    rows, spec = _model_rows(spark, d), _SPECS[1]
    state = history.fit_rates(rows.filter("d < date'2000-01-01'"), [spec], "late")
    out = history.apply_rates(rows.filter("d >= date'2000-01-01'"), state)
    return out.groupBy("o2", "dest").agg(F.count("*").alias("rows"), F.round(F.avg(F.col(spec.outputs[0]).cast("double")), 4).alias("rate"), F.round(F.avg(F.col(spec.outputs[1]).cast("double")), 4).alias("log_count"))


@register("d11_schedule_demand", """WITH e AS (SELECT event_id AS id, CAST(user_id % 12 AS INTEGER) AS o, CAST((user_id + event_id) % 12 AS INTEGER) AS t, date_trunc('hour', ts) AS h, date_trunc('hour', ts - INTERVAL 1 HOUR) AS dh, ts - INTERVAL 1 HOUR AS dt, CAST(event_id % 240 AS INTEGER) AS mins FROM events),
  dep AS (SELECT o, h, count(*) AS n FROM e GROUP BY ALL), arr AS (SELECT t AS port, date_trunc('hour', dt + to_minutes(mins)) AS a, count(*) AS n FROM e GROUP BY ALL)
  SELECT id, CAST(dep.n AS INTEGER) AS origin_sched_deps_this_hour, CAST(coalesce(x.n, 0) AS INTEGER) AS origin_sched_arrivals_this_hour, CAST(dep.n + coalesce(x.n, 0) AS INTEGER) AS origin_sched_ops_this_hour, CAST(coalesce(y.n, 0) AS INTEGER) AS dest_sched_arrivals_this_hour
  FROM e JOIN dep ON e.o = dep.o AND e.h = dep.h LEFT JOIN arr x ON x.port = e.o AND x.a = e.h LEFT JOIN arr y ON y.port = e.t AND y.a = e.dh""")
def _(spark, d):
    hour = F.make_dt_interval(F.lit(0), F.lit(1))
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 12).cast("int").alias("Origin"), ((F.col("user_id") + F.col("event_id")) % 12).cast("int").alias("Dest"), T.floor_hour(F.col("ts")).alias("dep_hour_local"), T.floor_hour(F.col("ts") - hour).alias("dest_departure_hour_local"), (F.col("ts") - hour).alias("dest_departure_time_local"), (F.col("event_id") % 240).cast("int").alias("CRSElapsedTime"))
    return demand.add_schedule_demand(e, e).select("id", *demand.OUTPUTS)


@register("e_f2_demand_by_band", """WITH g AS (SELECT CAST(user_id % 12 AS INTEGER) AS o, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT e.event_type, CASE WHEN n <= 5 THEN '1-5' WHEN n <= 15 THEN '6-15' WHEN n <= 30 THEN '16-30' WHEN n <= 60 THEN '31-60' ELSE '61+' END AS band FROM events e JOIN g ON g.o = e.user_id % 12 AND g.h = date_trunc('hour', e.ts))
  SELECT band, count(*) AS rows, round(avg((event_type = 'error')::INT), 6) AS rate FROM b GROUP BY band""")
def _(spark, d):
    from skyledger.functions.stats import cut

    e = read(spark, d, "events").select((F.col("user_id") % 12).alias("o"), T.floor_hour(F.col("ts")).alias("h"), (F.col("event_type") == "error").cast("int").alias("late"))
    both = e.join(e.groupBy("o", "h").agg(F.count("*").alias("n")), ["o", "h"])
    return both.groupBy(cut(F.col("n"), *reports.DEMAND, right=True).alias("band")).agg(F.count("*").alias("rows"), F.round(F.avg("late"), 6).alias("rate"))


@register("f1_f2_clock_timestamps", """WITH e AS (SELECT event_id, CAST(ts AS DATE) AS d, CAST((event_id % 24) * 100 + event_id % 60 AS INTEGER) AS hhmm FROM events) SELECT event_id, d::TIMESTAMP + to_hours(hhmm // 100) + to_minutes(hhmm % 100) AS t, d::TIMESTAMP + to_hours(hhmm // 100) AS h FROM e""")
def _(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("ts").cast("date").alias("d"), ((F.col("event_id") % 24) * 100 + F.col("event_id") % 60).cast("int").alias("hhmm"))
    t = T.clock_timestamp(F.col("d"), F.col("hhmm"))
    return e.select("event_id", t.alias("t")).withColumn("h", T.floor_hour(F.col("t")))


@register("f4_f5_f6_calendar_columns", """SELECT event_id, strftime(ts, '%Y-%m') AS period, date_trunc('month', ts)::DATE AS month, CAST(day(last_day(ts::DATE)) AS INTEGER) AS days, round((epoch_us(ts) - epoch_us(ts::DATE::TIMESTAMP)) / 6e7, 4) AS minutes, date_trunc('hour', ts + to_minutes(CAST(event_id % 300 AS INTEGER))) AS arrival FROM events""")
def _(spark, d):
    day = F.col("ts").cast("date")
    return read(spark, d, "events").select("event_id", T.period(day).alias("period"), T.month_start(day).alias("month"), T.days_in_month(day).alias("days"), F.round(T.minutes_between(F.col("ts"), day.cast("timestamp_ntz")), 4).alias("minutes"), T.arrival_hour(F.col("ts"), F.col("event_id") % 300).alias("arrival"))


@register("f10_metar_flags", """WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '-TSRA BR' WHEN 1 THEN 'vcts' WHEN 2 THEN '-SN' WHEN 3 THEN 'BLSN FZFG' WHEN 4 THEN 'RA' END AS code FROM events) SELECT event_id, coalesce(upper(code) LIKE '%TS%', false) AS ts, coalesce(regexp_matches(upper(code), 'SN|FZRA|FZDZ|PL|PE|GS|IC|FZFG|BLSN'), false) AS frozen FROM e""")
def _(spark, d):
    k = F.col("event_id") % 6
    code = F.when(k == 0, "-TSRA BR").when(k == 1, "vcts").when(k == 2, "-SN").when(k == 3, "BLSN FZFG").when(k == 4, "RA")
    return read(spark, d, "events").select("event_id", WX.has_thunderstorm(code).alias("ts"), WX.has_frozen(code).alias("frozen"))


@register("f14_f15_ceiling_category", """WITH e AS (SELECT event_id, value, CASE event_id % 5 WHEN 0 THEN 'FEW' WHEN 1 THEN 'BKN' WHEN 2 THEN 'OVC' WHEN 3 THEN 'CLR' END AS c1, CASE event_id % 3 WHEN 0 THEN 'OVC' WHEN 1 THEN 'SCT' END AS c2, value * 40 AS h1, CASE WHEN event_id % 7 <> 0 THEN value * 25 END AS h2, value / 12 AS v FROM events),
  k AS (SELECT *, coalesce(least(CASE WHEN c1 IN ('BKN', 'OVC', 'VV') THEN h1 END, CASE WHEN c2 IN ('BKN', 'OVC', 'VV') THEN h2 END), CASE WHEN c1 IS NOT NULL OR c2 IS NOT NULL THEN 99999.0 END) AS c FROM e)
  SELECT event_id, round(c, 4) AS ceiling, CASE WHEN c IS NULL OR v IS NULL THEN NULL WHEN c < 500 OR v < 1 THEN 'LIFR' WHEN c < 1000 OR v < 3 THEN 'IFR' WHEN c <= 3000 OR v <= 5 THEN 'MVFR' ELSE 'VFR' END AS category FROM k""")
def _(spark, d):
    i, v = F.col("event_id"), F.col("value")
    c1 = F.when(i % 5 == 0, "FEW").when(i % 5 == 1, "BKN").when(i % 5 == 2, "OVC").when(i % 5 == 3, "CLR")
    c2 = F.when(i % 3 == 0, "OVC").when(i % 3 == 1, "SCT")
    rows = read(spark, d, "events").select("event_id", WX.ceiling([c1, c2], [v * 40, F.when(i % 7 != 0, v * 25)]).alias("c"), (v / 12).alias("v"))
    return rows.select("event_id", F.round("c", 4).alias("ceiling"), WX.flight_category(F.col("c"), F.col("v")).alias("category"))


_HOLIDAYS = ", ".join(f"(DATE '{day}', '{name.replace(chr(39), chr(39) * 2)}')" for day, name in holidays.us_holidays(range(1994, 2003)))
_CALENDAR = f"""hol(h, name) AS (VALUES {_HOLIDAYS}), cal AS (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-08-01', INTERVAL 1 DAY))::DATE AS d),
  cc AS (SELECT d, min(h) FILTER (h >= d) AS nx, max(h) FILTER (h <= d) AS pv FROM cal, hol GROUP BY d),
  cn AS (SELECT d, CAST(nx - d AS SMALLINT) AS days_to_next_holiday, CAST(d - pv AS SMALLINT) AS days_since_prev_holiday, a.name AS next_holiday_name, b.name AS prev_holiday_name FROM cc JOIN hol a ON a.h = nx JOIN hol b ON b.h = pv)"""


@register("d4_holiday_calendar", f"WITH {_CALENDAR} SELECT d AS \"FlightDate\", * EXCLUDE (d) FROM cn")
def _(spark, d):
    return holidays.holiday_calendar(spark, "1995-01-01", "2001-08-01")


@register("d5_e_d5_holiday_windows", f"""WITH {FLIGHTS}, {_CALENDAR}, dl AS (SELECT d, count(*) AS flights, sum(late) AS delayed FROM f GROUP BY d),
  w AS (SELECT d, flights, delayed, next_holiday_name AS nm, -days_to_next_holiday::INT AS event_day FROM dl JOIN cn USING (d) WHERE days_to_next_holiday BETWEEN 0 AND 7 UNION ALL SELECT d, flights, delayed, prev_holiday_name, days_since_prev_holiday::INT FROM dl JOIN cn USING (d) WHERE days_since_prev_holiday BETWEEN 0 AND 7),
  n AS (SELECT DISTINCT d, flights, delayed, event_day, CASE WHEN nm ILIKE '%independence%' THEN 'Independence Day' WHEN nm ILIKE '%new year%' THEN 'New Year''s Day' WHEN nm ILIKE '%christmas%' THEN 'Christmas' WHEN nm ILIKE '%thanksgiving%' THEN 'Thanksgiving' END AS holiday FROM w)
  SELECT holiday, event_day, CAST(sum(flights) AS BIGINT) AS flights, CAST(sum(delayed) AS BIGINT) AS delayed, count(DISTINCT d) AS dates, round(100.0 * sum(delayed)::DOUBLE / sum(flights), 6) AS delay_rate FROM n WHERE holiday IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    daily = flights(spark, d).groupBy(F.col("d").alias("FlightDate")).agg(F.count("*").alias("flights"), F.sum("late").alias("delayed"))
    out = holidays.event_windows(holidays.add_holidays(daily)).groupBy("holiday", "event_day").agg(F.sum("flights").alias("flights"), F.sum("delayed").alias("delayed"), F.count_distinct("FlightDate").alias("dates"))
    return out.withColumn("delay_rate", F.round(F.col("delayed") / F.col("flights") * 100, 6))


@register("s16_u6_dense_calendar", f"WITH {FLIGHTS}, c AS (SELECT unnest(generate_series((SELECT min(d) FROM f)::TIMESTAMP, (SELECT max(d) FROM f)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d) SELECT k.carrier, c.d, count(f.d) AS n FROM (SELECT DISTINCT carrier FROM f) k CROSS JOIN c LEFT JOIN f ON f.carrier = k.carrier AND f.d = c.d GROUP BY ALL")
def _(spark, d):
    rows = flights(spark, d)
    counts = rows.groupBy("carrier", "d").agg(F.count("*").alias("n"))
    return joins.dense(rows.select("carrier").distinct(), joins.calendar_of(rows, "d")).join(counts, ["carrier", "d"], "left").fillna(0, ["n"])


_ZONES = ("America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "America/Phoenix")
_CLOCKS = f"""WITH z AS (SELECT {list(_ZONES)} AS names), t(zone, a, b, off) AS (VALUES {", ".join(f"('{z}', TIMESTAMP '{a}', TIMESTAMP '{b}', to_minutes({int(o)}))" for z, a, b, o in transition_rows(_ZONES, 2023, 2025))}),
  e AS (SELECT event_id, ts + to_days(CAST(event_id % 400 AS INTEGER)) AS ts, names[event_id % 5 + 1] AS src, names[user_id % 5 + 1] AS dst FROM events, z),
  u AS (SELECT event_id, any_value(e.ts) AS ts, any_value(dst) AS dst, count(*) FILTER (ts >= a + off AND ts < b + off) AS shown, min(ts - off) FILTER (ts >= a + off AND ts < b + off) AS utc, min(a) FILTER (a + off > ts) AS gap_end FROM e JOIN t ON t.zone = e.src GROUP BY event_id),
  v AS (SELECT event_id, ts, dst, CASE shown WHEN 1 THEN utc WHEN 0 THEN gap_end END AS utc FROM u)
  SELECT event_id, v.ts, utc + off AS there FROM v LEFT JOIN t ON t.zone = dst AND utc >= a AND utc < b"""


def _clocks(spark, d):
    """Events moved over a year and more, so that both changes of the clock are among them."""
    zones, moved = F.array(*map(F.lit, _ZONES)), F.make_dt_interval((F.col("event_id") % 400).cast("int"))
    e = read(spark, d, "events")
    return e.select("event_id", (F.col("ts").cast("timestamp_ntz") + moved).alias("ts"), F.element_at(zones, (F.col("event_id") % 5 + 1).cast("int")).alias("src"), F.element_at(zones, (F.col("user_id") % 5 + 1).cast("int")).alias("dst"))


@register("f3_destination_clock", _CLOCKS)
def _(spark, d):
    """Spark's own zone rules against the table of intervals, which SQL can read."""
    return _clocks(spark, d).select("event_id", "ts", T.to_zone(F.col("ts"), F.col("src"), F.col("dst")).alias("there"))


@register("f3_x5_d10_clock_by_intervals", _CLOCKS)
def _(spark, d):
    rows = add_converted(_clocks(spark, d), "ts", "src", "dst", transitions(spark, _ZONES, 2023, 2025), "there")
    return rows.select("event_id", "ts", "there")


def _taken(made, path, state):
    """What a stream writes that takes all files that are there, goes on from its checkpoint and ends."""
    made.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return made.sparkSession.read.schema(made.schema).parquet(path)


def _streamed(spark, table, parts, make, name):
    """(what the stream ``make`` writes, its path) when ``table`` comes to it in ``parts``, one run for each; a part has as many files as tasks write."""
    incoming, path, state = new_path(spark, "incoming"), new_path(spark, name), new_path(spark, f"{name}_state")
    for part in parts:
        table.filter(part).write.mode("append").parquet(incoming)
        out = _taken(make(spark.readStream.schema(table.schema).parquet(incoming)), path, state)
    return out, path


@register("t3_streaming_snapshots", f"WITH {_SNAP} SELECT airport, hour, t AS observation_time_local, gust AS wind_gust_kt, round((epoch_us(hour) - epoch_us(t)) / 6e7, 4) AS age, CAST(t IS NULL AS INTEGER) AS missing FROM h WHERE hour <= TIMESTAMP '2024-01-28 00:00:00'")
def _(spark, d):
    """The grid of ``j1_d14_asof_snapshot`` from a stream, up to the last hour that its watermark is sure to pass."""
    rows = written(observations(spark, d), "observations")
    at = F.col("observation_time_local")
    parts = at < "2024-01-11", (at >= "2024-01-11") & (at < "2024-01-21"), at >= "2024-01-21"
    out, _ = _streamed(spark, rows, parts, lambda stream: streaming_snapshots(stream, _FIRST, "2024-01-28 00:00:00"), "snapshots")
    return out.select("airport", "hour", "observation_time_local", "wind_gust_kt", F.round("snapshot_age_minutes", 4).alias("age"), F.col("weather_observation_missing").cast("int").alias("missing"))


_CLOSED = RateSpec("pair", ("carrier", "origin"), 50)


@register("t2_streaming_expanding_rates", f"""WITH {FLIGHTS}, r AS (SELECT carrier, origin, date_trunc('month', d)::DATE AS m, sum(late) AS p, count(*) AS n FROM f GROUP BY ALL), a AS (SELECT m, sum(p) AS p, sum(n) AS n FROM r GROUP BY m),
  pr AS (SELECT x.m, coalesce(sum(y.p) / sum(y.n), 0.2) AS prior FROM a x LEFT JOIN a y ON y.m < x.m GROUP BY x.m), g AS (SELECT x.carrier, x.origin, x.m, coalesce(sum(y.p), 0) AS p, coalesce(sum(y.n), 0) AS n FROM r x LEFT JOIN r y ON y.carrier = x.carrier AND y.origin = x.origin AND y.m < x.m GROUP BY ALL)
  SELECT carrier, origin, m AS month, round(((p + 50 * prior) / (n + 50))::FLOAT::DOUBLE, 4) AS rate, CAST(n AS BIGINT) AS past FROM g JOIN pr USING (m)""")
def _(spark, d):
    """Rates of groups and months from two streams: counts by day, then closings of months. Two rows far ahead, one
    for each stream, end the input: the watermark passes all months."""
    rows = written(flights(spark, d).select(F.col("d").alias("FlightDate"), F.col("late").alias("ArrDel15"), "carrier", "origin"), "flights")
    last = rows.agg(F.lit("2100-01-01").cast("date").alias("FlightDate"), F.lit(0).alias("ArrDel15"), F.lit("").alias("carrier"), F.min("origin").alias("origin"))
    ended = rows.unionByName(last).unionByName(last.withColumn("FlightDate", F.lit("2200-01-01").cast("date")))
    day = F.col("FlightDate")
    parts = day < "1997-01-01", (day >= "1997-01-01") & (day < "2100-01-01"), day == "2100-01-01", day == "2200-01-01"
    daily, place = _streamed(spark, ended, parts, lambda stream: daily_group_counts(stream, [_CLOSED]), "daily")
    closed = _taken(month_closings(spark.readStream.schema(daily.schema).parquet(place)), new_path(spark, "closed"), new_path(spark, "closed_state"))
    months = rows.select("carrier", "origin", T.month_start(F.col("FlightDate")).cast("date").alias("FlightDate")).distinct()
    rate, log_count = _CLOSED.outputs
    out = with_closed_rates(months, closed, [_CLOSED])
    return out.select("carrier", "origin", F.col("FlightDate").alias("month"), F.round(F.col(rate).cast("double"), 4).alias("rate"), F.round(F.expm1(F.col(log_count).cast("double"))).cast("long").alias("past"))
