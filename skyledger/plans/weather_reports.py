"""Queries of delays against weather, demand and distance, and of feature sanity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyledger.functions import stats as S
from skyledger.functions import times as T
from skyledger.operators import history, reports, stats, weather
from skyledger.plans.registry import register
from skyledger.plans.tables import FLIGHTS, OBSERVATIONS, flights, observations, outcome_days, read, rounded
from skyledger.plans.temporal import _SNAP, _hourly

_WITH = f"WITH {FLIGHTS} "
_EVENTS = "ev AS (SELECT event_id AS id, user_id AS airport, date_trunc('hour', ts) AS hour, CAST(event_type = 'error' AS INTEGER) AS late, value AS minutes FROM events)"


def _events(spark, d):
    e = read(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("airport"), T.floor_hour(F.col("ts")).alias("hour"), (F.col("event_type") == "error").cast("int").alias("late"), F.col("value").alias("minutes"))


def _joined(spark, d):
    """The hours are many more than Spark takes them for by the airports that they are made of, so they are never broadcast."""
    return _events(spark, d).join(_hourly(spark, d).drop("precip_mm").hint("merge"), ["airport", "hour"], "left")


_JOINED = f"{_SNAP}, {_EVENTS}, x AS (SELECT ev.*, h.t, h.gust, h.cat FROM ev LEFT JOIN h ON h.airport = ev.airport AND h.hour = ev.hour)"


@register("j6_d12_origin_weather_join", f"WITH {_JOINED} SELECT id, t AS observation_time_local, gust AS wind_gust_kt, cat AS flight_category FROM x")
def _(spark, d):
    return _joined(spark, d).select("id", "observation_time_local", "wind_gust_kt", "flight_category")


@register("e_e1_weather_coverage", f"WITH {_JOINED}, a AS (SELECT airport, count(*) AS n, count(t) AS m FROM x GROUP BY airport), b AS (SELECT *, CASE WHEN n <= 60 THEN 'small' ELSE 'large' END AS size FROM a) SELECT size, count(*) AS airports, CAST(sum(n) AS BIGINT) AS flights, round(avg(1 - m / n), 6) AS mean_missing, round(sum((1 - m / n) * n) / sum(n), 6) AS weighted_missing FROM b GROUP BY size")
def _(spark, d):
    a = _joined(spark, d).groupBy("airport").agg(F.count("*").alias("n"), (1 - F.count("observation_time_local") / F.count("*")).alias("missing"))
    size = S.cut(F.col("n"), (0, 60, float("inf")), ("small", "large"), right=True)
    return rounded(a.groupBy(size.alias("size")).agg(F.count("*").alias("airports"), F.sum("n").alias("flights"), F.avg("missing").alias("mean_missing"), stats.weighted_mean(F.col("missing"), F.col("n")).alias("weighted_missing")))


@register("e_e3_severity_by_category", f"WITH {_JOINED} SELECT cat AS flight_category, count(minutes) AS rows, round(avg(minutes), 6) AS mean, round(median(minutes), 6) AS median, round(quantile_cont(minutes, 0.9), 6) AS p90 FROM x WHERE late = 1 AND cat IS NOT NULL GROUP BY cat")
def _(spark, d):
    return rounded(reports.severity(_joined(spark, d).filter("late = 1 and flight_category is not null"), ["flight_category"], "minutes"))


@register("e_e4_weather_intensity", f"""WITH {_JOINED} SELECT bin, count(*) AS flights, round(avg(late) * 100, 6) AS delay_rate, round(median(CASE WHEN late = 1 THEN minutes END), 6) AS median_delay FROM (SELECT *, CASE WHEN gust >= -0.01 AND gust < 10 THEN '0-10' WHEN gust >= 10 AND gust < 20 THEN '10-20' WHEN gust >= 20 AND gust < 30 THEN '20-30'
  WHEN gust >= 30 AND gust < 40 THEN '30-40' WHEN gust >= 40 THEN '40+' END AS bin FROM x) WHERE bin IS NOT NULL GROUP BY bin""")
def _(spark, d):
    return rounded(reports.binned_rate(_joined(spark, d), F.col("wind_gust_kt"), reports.GUST, F.col("late") == 1, "minutes"))


@register("e_e5_ifr_history_given_vfr", f"""WITH {_SNAP}, k AS (SELECT airport, hour, cat, sum(CASE WHEN cat IS NOT NULL THEN CAST(cat IN ('IFR', 'LIFR') AS INTEGER) END) OVER w AS low, count(cat) OVER w AS known FROM h WINDOW w AS (PARTITION BY airport ORDER BY hour ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
  SELECT known, CAST(low AS INTEGER) AS low, count(*) AS hours FROM k WHERE cat = 'VFR' GROUP BY ALL""")
def _(spark, d):
    rows = weather.add_history(_hourly(spark, d), include_current=False, checked=False)
    w = Window.partitionBy("airport").orderBy("hour").rowsBetween(-3, -1)
    return rows.withColumn("known", F.count("flight_category").over(w)).filter("flight_category = 'VFR'").groupBy("known", F.col("ifr_hours_past3").cast("int").alias("low")).agg(F.count("*").alias("hours"))


@register("e_e6_origin_and_destination_weather", f"""WITH {_SNAP}, {_EVENTS}, x AS (SELECT ev.late, a.cat AS o, b.cat AS t FROM ev LEFT JOIN h a ON a.airport = ev.airport AND a.hour = ev.hour LEFT JOIN h b ON b.airport = ev.airport + 1 AND b.hour = ev.hour)
  SELECT o AS origin_category, t AS dest_category, count(*) AS flights, round(avg(late), 6) AS rate FROM x GROUP BY ALL""")
def _(spark, d):
    hourly = _hourly(spark, d).select("airport", "hour", "flight_category")
    a = hourly.withColumnRenamed("flight_category", "origin_category")
    b = hourly.select((F.col("airport") - 1).alias("airport"), "hour", F.col("flight_category").alias("dest_category"))
    rows = _events(spark, d).join(a.hint("merge"), ["airport", "hour"], "left").join(b.hint("merge"), ["airport", "hour"], "left")  # as in ``_joined``
    return rounded(rows.groupBy("origin_category", "dest_category").agg(F.count("*").alias("flights"), F.avg("late").alias("rate")))


@register("e_c7_selected_airports", f"{_WITH} SELECT origin, count(*) AS flights, CAST(sum(late) AS BIGINT) AS delayed, round(avg(late) * 100, 6) AS delay_rate FROM f WHERE origin IN (3, 7, 24) GROUP BY origin")
def _(spark, d):
    return rounded(reports.delay_rate(flights(spark, d).filter(F.col("origin").isin(3, 7, 24)), ["origin"], F.col("late") == 1).drop("lower", "upper"))


@register("e_c8_cause_by_block", f"{_WITH} SELECT priority, round(avg(c1), 6) AS mean, round(median(c1), 6) AS median, count(c1) AS n FROM f WHERE late = 1 GROUP BY priority")
def _(spark, d):
    return rounded(flights(spark, d).filter("late = 1").groupBy("priority").agg(F.avg("c1").alias("mean"), F.percentile("c1", 0.5).alias("median"), F.count("c1").alias("n")))


@register("e_f1_distance_group", f"{_WITH} SELECT CAST(floor(price / 10000) AS BIGINT) AS distance_group, count(*) AS flights, round(avg(late) * 100, 6) AS delay_rate FROM f GROUP BY ALL")
def _(spark, d):
    return rounded(flights(spark, d).groupBy(F.floor(F.col("price") / 10000).alias("distance_group")).agg(F.count("*").alias("flights"), (F.avg("late") * 100).alias("delay_rate")))


@register("q18_feature_sanity", f"""{_WITH}, tr AS (SELECT * FROM f WHERE d < DATE '2000-01-01'), te AS (SELECT * FROM f WHERE d >= DATE '2000-01-01'), s AS (SELECT carrier, dest, flight % 50 AS b, sum(late) AS p, count(*) AS n FROM tr GROUP BY ALL), g AS (SELECT avg(late) AS g FROM tr),
  r AS (SELECT (coalesce(p, 0) + 100 * g) / (coalesce(n, 0) + 100) AS rate, n FROM te CROSS JOIN g LEFT JOIN s ON s.carrier = te.carrier AND s.dest = te.dest AND s.b = te.flight % 50)
  SELECT count(*) AS rows, count(*) FILTER (rate IS NULL) AS nulls, count(*) FILTER (rate NOT BETWEEN 0 AND 1) AS outside, round(count(*) FILTER (n IS NULL) / count(*), 6) AS unseen FROM r""")
def _(spark, d):
    rows = flights(spark, d).withColumn("b", F.col("flight") % 50)
    spec = history.RateSpec("cell", ("carrier", "dest", "b"), 100)
    out = history.apply_rates(rows.filter("d >= date'2000-01-01'"), history.fit_rates(rows.filter("d < date'2000-01-01'"), [spec], "late"))
    rate, count = (F.col(c) for c in spec.outputs)
    return rounded(out.agg(F.count("*").alias("rows"), F.count_if(rate.isNull()).alias("nulls"), F.count_if(~rate.between(0, 1)).alias("outside"), F.avg((count == 0).cast("double")).alias("unseen")))


@register("w9_group_transform", f"{_WITH} SELECT origin, carrier, count(*) AS n, round(median(m) , 6) AS typical FROM (SELECT *, median(minutes) OVER (PARTITION BY origin) AS m FROM f) GROUP BY ALL")
def _(spark, d):
    rows = flights(spark, d)
    middle = rows.groupBy("origin").agg(F.percentile("minutes", 0.5).alias("m"))
    return rounded(rows.join(middle, "origin").groupBy("origin", "carrier").agg(F.count("*").alias("n"), F.percentile("m", 0.5).alias("typical")))


@register("j20_value_map", "SELECT event_id, CASE event_type WHEN 'error' THEN 'bad' WHEN 'click' THEN 'good' ELSE 'other' END AS label FROM events")
def _(spark, d):
    labels = spark.createDataFrame([("error", "bad"), ("click", "good")], "event_type string, label string")
    return read(spark, d, "events").join(F.broadcast(labels), "event_type", "left").select("event_id", F.coalesce("label", F.lit("other")).alias("label"))


@register("j14_external_reconciliation", "WITH a AS (SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) AS ours FROM events GROUP BY 1), b AS (SELECT strftime(ts, '%Y-%m-%d') AS period, max(event_id) - min(event_id) AS official FROM events GROUP BY 1) SELECT period, ours, official, ours = official AS agrees FROM a JOIN b USING (period)")
def _(spark, d):
    e = read(spark, d, "events").withColumn("period", F.date_format("ts", "yyyy-MM-dd"))
    a, b = e.groupBy("period").agg(F.count("*").alias("ours")), e.groupBy("period").agg((F.max("event_id") - F.min("event_id")).alias("official"))
    return a.join(b, "period").withColumn("agrees", F.col("ours") == F.col("official"))


@register("s18_distinct_airports", "SELECT origin AS \"Airport\", min(p) AS \"State\" FROM (SELECT c_nationkey AS origin, substr(c_mktsegment, 1, 2) AS p FROM customer UNION ALL SELECT s_nationkey, substr(s_name, 1, 2) FROM supplier) GROUP BY origin")
def _(spark, d):
    from skyledger.operators.zones import distinct_airports

    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("Origin"), F.substring("c_mktsegment", 1, 2).alias("OriginState"))
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("Dest"), F.substring("s_name", 1, 2).alias("DestState"))
    return distinct_airports(c.withColumns({"Dest": F.col("Origin"), "DestState": F.col("OriginState")}).unionByName(s.withColumns({"Origin": F.col("Dest"), "OriginState": F.col("DestState")})))


@register("a19_keep_last", f"WITH {OBSERVATIONS} SELECT airport, max(observation_time_local) AS observation_time_local, arg_max(wind_gust_kt, observation_time_local) AS wind_gust_kt FROM ob GROUP BY airport")
def _(spark, d):
    rows = observations(spark, d).select("airport", "observation_time_local", "wind_gust_kt")
    return stats.keep_last(rows, ["airport"], ["observation_time_local"])


@register("u5_feature_guards", "SELECT count(*) FILTER (late NOT IN (0, 1)) AS bad, count(*) AS rows, count(DISTINCT grp) AS groups FROM (SELECT CAST(user_id % 10 AS INTEGER) AS grp, CAST(event_type = 'error' AS INTEGER) AS late FROM events)")
def _(spark, d):
    return outcome_days(spark, d).agg(F.count_if(~F.col("late").isin(0, 1)).alias("bad"), F.count("*").alias("rows"), F.count_distinct("grp").alias("groups"))
