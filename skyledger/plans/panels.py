"""Queries of the weather panels, of demand under weather, and of reports on a fitted model."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skyledger.functions import stats as S
from skyledger.functions import weather as W
from skyledger.operators import model, reports
from skyledger.plans.registry import register
from skyledger.plans.tables import read, rounded
from skyledger.sources.scratch import new_path

#: Events as flights with weather: value as gust, rain, visibility and ceiling, the rest by rule from the number.
_WX = """WITH wx AS (SELECT event_id AS id, value AS gust, value / 4 AS rain, value / 12 AS vis, CASE WHEN event_id % 13 <> 0 THEN value * 40 END AS ceiling, CAST(event_id % 3 = 0 AS INTEGER) AS frozen, CAST(event_id % 21 AS INTEGER) - 10 AS temp,
  CASE WHEN event_id % 5 <> 0 THEN CAST(event_type = 'error' AS INTEGER) END AS thunder, CAST(event_id % 7 < 3 AS INTEGER) AS late, value * 2 AS minutes, CAST(day(ts) AS INTEGER) AS month, CAST(user_id % 40 AS INTEGER) + 1 AS demand FROM events),
  w AS (SELECT *, CASE WHEN ceiling IS NULL THEN NULL WHEN ceiling < 500 OR vis < 1 THEN 'LIFR' WHEN ceiling < 1000 OR vis < 3 THEN 'IFR' WHEN ceiling <= 3000 OR vis <= 5 THEN 'MVFR' ELSE 'VFR' END AS cat FROM wx) """


def _wx(spark, d):
    n = F.col("event_id")
    rows = read(spark, d, "events").select(
        n.alias("id"), F.col("value").alias("gust"), (F.col("value") / 4).alias("rain"), (F.col("value") / 12).alias("vis"), F.when(n % 13 != 0, F.col("value") * 40).alias("ceiling"), (n % 3 == 0).cast("int").alias("frozen"),
        ((n % 21).cast("int") - 10).alias("temp"), F.when(n % 5 != 0, (F.col("event_type") == "error").cast("int")).alias("thunder"), (n % 7 < 3).cast("int").alias("late"), (F.col("value") * 2).alias("minutes"),
        F.day("ts").alias("month"), ((F.col("user_id") % 40).cast("int") + 1).alias("demand"),
    )
    return rows.withColumn("cat", W.flight_category(F.col("ceiling"), F.col("vis")))


@register("e_e2_weather_validation", _WX + "SELECT cat, count(late) AS flights, CAST(sum(late) AS BIGINT) AS delayed, round(sum(late) / count(late) * 100, 6) AS delay_rate, round(sum(coalesce(gust, 0) + coalesce(ceiling, 0)) / count(late), 6) AS weather_nas_per_flight FROM w WHERE cat IS NOT NULL GROUP BY cat")
def _(spark, d):
    return rounded(reports.weather_validation(_wx(spark, d), "cat", "late", "gust", "ceiling"))


@register("e_e2_weather_warning", _WX + ", r AS (SELECT avg(late) FILTER (cat = 'VFR') * 100 AS vfr_rate, avg(late) FILTER (cat IN ('IFR', 'LIFR')) * 100 AS low_rate FROM w) SELECT round(vfr_rate, 6) AS vfr_rate, round(low_rate, 6) AS low_rate, coalesce(low_rate <= vfr_rate, false) AS suspicious FROM r")
def _(spark, d):
    return rounded(reports.weather_warning(_wx(spark, d), "cat", "late"))


def _panel_sql(bin_: str) -> str:
    return _WX + f""", b AS (SELECT {bin_} AS bin, late, CASE WHEN late = 1 THEN minutes END AS m FROM w) SELECT bin, count(*) AS flights, count(m) AS delayed_flights, round(avg(late) * 100, 6) AS delay_rate, round(avg(m), 6) AS mean_delay,
  round(quantile_cont(m, 0.5), 6) AS median_delay, round(quantile_cont(m, 0.9), 6) AS p90_delay FROM b WHERE bin IS NOT NULL GROUP BY bin"""


def _bins() -> dict:
    return {
        "gust": S.cut(F.coalesce("gust", F.lit(0.0)), *reports.GUST), "precipitation": S.cut(F.col("rain"), *reports.PRECIPITATION), "visibility": S.cut(F.col("vis"), *reports.VISIBILITY),
        "phase": reports.precipitation_phase(F.col("frozen"), F.col("rain"), F.col("temp")), "thunderstorm": F.when(F.col("thunder") == 1, "Thunderstorm").when(F.col("thunder") == 0, "No thunderstorm"),
    }


for _name, _bin in {
    "gust": "CASE WHEN coalesce(gust, 0) < -0.01 THEN NULL WHEN coalesce(gust, 0) < 10 THEN '0-10' WHEN gust < 20 THEN '10-20' WHEN gust < 30 THEN '20-30' WHEN gust < 40 THEN '30-40' ELSE '40+' END",
    "precipitation": "CASE WHEN rain < -0.001 THEN NULL WHEN rain < 0.001 THEN 'none' WHEN rain < 1 THEN '0-1' WHEN rain < 3 THEN '1-3' WHEN rain < 6 THEN '3-6' ELSE '6+' END",
    "visibility": "CASE WHEN vis < 1 THEN '<1' WHEN vis < 3 THEN '1-3' WHEN vis < 5 THEN '3-5' WHEN vis < 10 THEN '5-10' ELSE '10+' END",
    "phase": "CASE WHEN temp BETWEEN -5 AND 5 THEN CASE WHEN frozen = 1 THEN 'Frozen' WHEN rain > 0 THEN 'Liquid' END END",
    "thunderstorm": "CASE thunder WHEN 1 THEN 'Thunderstorm' WHEN 0 THEN 'No thunderstorm' END",
}.items():

    @register(f"e_e4_panel_{_name}", _panel_sql(_bin))
    def _(spark, d, name=_name):
        return rounded(reports.weather_panel(_wx(spark, d), _bins()[name], "late", "minutes"))


@register("e_e4_thunderstorms_by_month", _WX + "SELECT month, count(late) AS flights, CAST(sum(thunder) AS BIGINT) AS thunderstorm_flights, round(100.0 * sum(thunder) / count(late), 6) AS share FROM w WHERE thunder IS NOT NULL GROUP BY month")
def _(spark, d):
    return rounded(reports.thunderstorms_by_month(_wx(spark, d), "month", "thunder", "late"))


_CELLS = _WX + """, c AS (SELECT CASE WHEN demand <= 5 THEN '1-5' WHEN demand <= 15 THEN '6-15' WHEN demand <= 30 THEN '16-30' WHEN demand <= 60 THEN '31-60' ELSE '61+' END AS demand,
  CASE WHEN cat IN ('IFR', 'LIFR') THEN 'IFR/LIFR' ELSE cat END AS band, late FROM w WHERE cat IS NOT NULL) """


@register("e_f2_demand_by_weather", _CELLS + "SELECT demand, band, count(late) AS flights, round(avg(late) * 100, 6) AS delay_rate FROM c GROUP BY ALL")
def _(spark, d):
    return rounded(reports.demand_by_weather(_wx(spark, d), "demand", "cat", "late"))


@register("e_f2_demand_matrix", _CELLS + 'SELECT demand, count(*) FILTER (band = \'VFR\') AS "VFR", count(*) FILTER (band = \'MVFR\') AS "MVFR", count(*) FILTER (band = \'IFR/LIFR\') AS "IFR/LIFR" FROM c GROUP BY demand')
def _(spark, d):
    return reports.demand_matrix(reports.demand_by_weather(_wx(spark, d), "demand", "cat", "late"))


#: Contributions of a feature by rule, so that SQL can give the same reports on them.
_SIGNED = "WITH c AS (SELECT event_id AS id, event_type AS level, value AS v, round(value / 100 - (event_id % 24) / 20.0, 6) AS c FROM events)"


def _contributions(spark, d):
    e = read(spark, d, "events")
    rows = e.select(F.col("event_id").cast("string").alias("key"), F.round(F.col("value") / 100 - (F.col("event_id") % 24) / 20.0, 6).alias("c"))
    return rows.select("key", F.explode(F.array(F.lit("value"), F.lit("event_type"))).alias("feature"), F.col("c").alias("contribution")), e


@register("m18_numeric_direction", f"""{_SIGNED}, q AS (SELECT list_sort(list_distinct(quantile_cont(v, [k / 12.0 FOR k IN range(13)]))) AS e FROM c), b AS (SELECT *, len(list_filter(e[2:len(e) - 1], lambda x: x < v)) AS bin FROM c, q),
  g AS (SELECT bin, count(*) AS n, avg(v) AS mv, median(v) AS dv, avg(c) AS mc, median(c) AS dc, avg(CAST(c > 0 AS INTEGER)) AS p FROM b GROUP BY bin)
  SELECT 'value' AS feature, CAST(row_number() OVER (ORDER BY mv) - 1 AS INTEGER) AS bin, n, round(mv, 6) AS mean_value, round(dv, 6) AS median_value, round(mc, 6) AS mean_contribution, round(dc, 6) AS median_contribution, round(p, 6) AS positive_share FROM g""")
def _(spark, d):
    found, e = _contributions(spark, d)
    return rounded(model.numeric_direction(found, e, "event_id", "value"))


@register("m18_category_direction", f"{_SIGNED} SELECT 'event_type' AS feature, level, count(*) AS n, round(avg(c), 6) AS mean_contribution, round(median(c), 6) AS median_contribution, round(avg(CAST(c > 0 AS INTEGER)), 6) AS positive_share FROM c GROUP BY level HAVING count(*) >= 100")
def _(spark, d):
    found, e = _contributions(spark, d)
    return rounded(model.category_direction(found, e, "event_id", "event_type"))


@register("m17_mean_attributions", f"""{_SIGNED}, l AS (SELECT event_id % 5 AS f, abs(c) AS a FROM c JOIN events ON id = event_id), m AS (SELECT 'f' || f AS feature, avg(a) AS a FROM l GROUP BY f)
  SELECT feature, round(a, 6) AS mean_abs, CAST(row_number() OVER w AS INTEGER) AS rank, round(a / sum(a) OVER (), 6) AS share, round(sum(a) OVER (w ROWS UNBOUNDED PRECEDING) / sum(a) OVER (), 6) AS cum_share FROM m WINDOW w AS (ORDER BY a DESC, feature)""")
def _(spark, d):
    found = _contributions(spark, d)[0].filter("feature = 'value'").withColumn("feature", F.concat(F.lit("f"), (F.col("key").cast("long") % 5).cast("string")))
    return rounded(model.mean_attributions(found))


@register("f21_finite_numbers", "SELECT event_id % 4 AS kind, count(*) AS rows, count(CASE WHEN event_id % 4 <> 0 THEN value END) AS known, max(event_id % 4 = 1) AS raised FROM events GROUP BY ALL")
def _(spark, d):
    """NaN counts as missing; a kind that holds an infinite value raises, and its rows are then counted without the guard."""
    inf = F.lit(float("inf"))
    e = read(spark, d, "events").withColumn("kind", F.col("event_id") % 4).withColumn("x", F.when(F.col("kind") == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    holds = e.join(F.broadcast(e.filter("kind = 1").agg(F.max("event_id").alias("last")))).withColumn("x", F.when(F.col("event_id") == F.col("last"), inf).otherwise(F.col("x"))).filter("kind = 1")
    try:
        holds.select(model.finite("x").alias("x")).agg(F.count("x")).collect()
        raised = False
    except PySparkException as error:
        raised = "infinite value in x" in str(error)
    return e.withColumn("x", model.finite("x")).groupBy("kind").agg(F.count("*").alias("rows"), F.count("x").alias("known")).withColumn("raised", (F.col("kind") == 1) & F.lit(raised))


@register("s14_m23_reloaded_model", "SELECT count(*) AS rows, count(*) AS same, 'hour,grp' AS features, 3 AS rounds FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-20'")
def _(spark, d):
    """A model is saved with its metadata, loaded again, and scores the same."""
    rows = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("date").alias("d"), (F.col("event_type") == "error").cast("int").alias("late"), F.hour("ts").alias("hour"), (F.col("user_id") % 10).cast("string").alias("grp"))
    fitted = model.fit_delay_model(rows.filter("d < date'2024-01-20'"), "late", ["hour"], ["grp"], rounds=3, depth=2, rate=0.1)
    fitted.metadata["rounds"] = 3
    path = new_path(spark, "bundle")
    model.save_bundle(path, fitted, levels=spark.createDataFrame([(k, v) for k, v in fitted.levels.items()], "name string, levels array<string>"))
    again, _tables = model.load_bundle(spark, path, "levels")
    both = again.score(fitted.score(rows.filter("d >= date'2024-01-20'"), "first"), "second")
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("first") == F.col("second")).alias("same"), F.lit(",".join(again.features)).alias("features"), F.lit(again.metadata["rounds"]).alias("rounds"))
