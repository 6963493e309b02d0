"""Queries of rates, bins, shares, joins and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import stats as S
from skyledger.operators import audits, joins, reports, sampling, stats, target
from skyledger.plans.registry import register
from skyledger.plans.tables import FLIGHTS, OUTCOMES, flights, outcomes, read, rounded

_WITH = f"WITH {FLIGHTS} "
_FULL = f"WITH {FLIGHTS}, {OUTCOMES} "
def _late():
    return F.col("late") == 1


_WILSON = """round(((s / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt((s / n * (1 - s / n) + 3.8416 / (4 * n)) / n) / (1 + 3.8416 / n)) * 100, 6) AS lower,
  round(((s / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt((s / n * (1 - s / n) + 3.8416 / (4 * n)) / n) / (1 + 3.8416 / n)) * 100, 6) AS upper"""


def _rate_sql(key: str, extra: str = "") -> str:
    return f"{_WITH} SELECT {key}, flights, delayed, round(s / n * 100, 6) AS delay_rate, {_WILSON} FROM (SELECT {key}, count(*) AS flights, sum(late)::BIGINT AS delayed, count(*)::DOUBLE AS n, sum(late)::DOUBLE AS s FROM f {extra} GROUP BY ALL)"


@register("e_b2_wilson_rate_by_group", _rate_sql("carrier"))
def _(spark, d):
    return rounded(reports.delay_rate(flights(spark, d), ["carrier"], _late()))


@register("e_d1_rate_by_block", _rate_sql("priority"))
def _(spark, d):
    return rounded(reports.delay_rate(flights(spark, d), ["priority"], _late()))


@register("e_d2_rate_by_weekday", _rate_sql("weekday", "").replace("FROM f", "FROM (SELECT *, ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][isodow(d)] AS weekday FROM f)"))
def _(spark, d):
    from skyledger.functions.times import weekday_name

    return rounded(reports.delay_rate(flights(spark, d).withColumn("weekday", weekday_name(F.weekday("d") + 1)), ["weekday"], _late()))


@register("e_d4_monthly_rate_by_year", _rate_sql("y, m", "").replace("FROM f", "FROM (SELECT *, year(d)::INTEGER AS y, month(d)::INTEGER AS m FROM f)"))
def _(spark, d):
    return rounded(reports.delay_rate(flights(spark, d).withColumns({"y": F.year("d"), "m": F.month("d")}), ["y", "m"], _late()))


@register("e_d6_daily_series", _rate_sql("d"))
def _(spark, d):
    return rounded(reports.delay_rate(flights(spark, d), ["d"], _late()))


@register("p1_p2_target_recovery", f"{_FULL} SELECT recovered, nonarrival, eligible, ArrDel15, count(*) AS n, round(sum(ArrDelayMinutes), 4) AS mins FROM x GROUP BY ALL")
def _(spark, d):
    rows = target.build_target(outcomes(spark, d)).select(F.col("target_recovered_from_diversion").alias("recovered"), F.col("nonarrival_disruption").alias("nonarrival"), F.col("model_eligible").alias("eligible"), "ArrDel15", "ArrDelayMinutes")
    return rows.groupBy("recovered", "nonarrival", "eligible", "ArrDel15").agg(F.count("*").alias("n"), F.round(F.sum("ArrDelayMinutes"), 4).alias("mins"))


@register("p3_eligible_rows", f"{_FULL} SELECT carrier, count(*) AS n, CAST(sum(ArrDel15) AS BIGINT) AS late FROM x WHERE eligible AND ArrDelayMinutes IS NOT NULL GROUP BY carrier")
def _(spark, d):
    return target.eligible_rows(target.build_target(outcomes(spark, d)), require_minutes=True).groupBy("carrier").agg(F.count("*").alias("n"), F.sum("ArrDel15").alias("late"))


@register("p15_domain_checks", f"{_FULL} SELECT count(*) FILTER (ArrDel15 NOT IN (0, 1)) AS bad_target, count(*) FILTER (ArrDel15 IS NULL) AS null_target, count(*) FILTER (carrier IS NULL) AS null_key FROM x")
def _(spark, d):
    t = F.col("ArrDel15")
    return target.build_target(outcomes(spark, d)).agg(F.count_if(~t.isin(0, 1)).alias("bad_target"), F.count_if(t.isNull()).alias("null_target"), F.count_if(F.col("carrier").isNull()).alias("null_key"))


@register("e_b2_disruption_rates", f"""{_FULL} SELECT carrier, count(*) AS flights, count(*) FILTER (eligible) AS operated, count(*) FILTER (eligible AND ArrDel15 = 1) AS delayed, count(*) FILTER (Cancelled = 1) AS cancelled,
  count(*) FILTER (nonarrival) AS nonarrival, round(100.0 * count(*) FILTER (eligible AND ArrDel15 = 1)::DOUBLE / count(*) FILTER (eligible), 6) AS delay_rate,
  round(100.0 * count(*) FILTER (Cancelled = 1)::DOUBLE / count(*), 6) AS cancel_rate, round(100.0 * count(*) FILTER (nonarrival)::DOUBLE / count(*), 6) AS nonarrival_rate FROM x GROUP BY carrier""")
def _(spark, d):
    return rounded(reports.disruption_rates(target.build_target(outcomes(spark, d)), "carrier").drop("lower", "upper"))


@register("e_a1_minutes_shares", f"{_WITH} SELECT round(avg((minutes <= 10)::INT), 6) AS low, round(avg((minutes = 20)::INT), 6) AS exact, round(avg((minutes NOT BETWEEN 5 AND 45)::INT), 6) AS outside FROM f")
def _(spark, d):
    m = F.col("minutes")
    return rounded(flights(spark, d).agg(F.avg((m <= 10).cast("int")).alias("low"), F.avg((m == 20).cast("int")).alias("exact"), F.avg((~m.between(5, 45)).cast("int")).alias("outside")))


@register("a15_histogram", f"{_WITH} SELECT 1.0::DOUBLE + floor((minutes - 1) / 5) * 5 AS bin_start, count(*) AS rows FROM f WHERE minutes >= 1 AND minutes < 46 GROUP BY ALL")
def _(spark, d):
    return reports.histogram(flights(spark, d), F.col("minutes"), 1.0, 5.0, 46.0)


@register("e_a2_severity_by_group", f"""{_WITH} SELECT carrier, count(minutes) AS rows, round(avg(minutes), 6) AS mean, round(quantile_cont(minutes, 0.5), 6) AS median, round(quantile_cont(minutes, 0.9), 6) AS p90
  FROM f WHERE late = 1 GROUP BY carrier""")
def _(spark, d):
    return rounded(reports.severity(flights(spark, d).filter(_late()), ["carrier"], "minutes"))


@register("a22_summary", f"""{_WITH} SELECT count(price) AS count, round(avg(price), 4) AS mean, round(stddev(price), 4) AS std, round(min(price), 4) AS min, round(quantile_cont(price, 0.5), 4) AS p50, round(quantile_cont(price, 0.9), 4) AS p90,
  round(quantile_cont(price, 0.99), 4) AS p99, round(max(price), 4) AS max FROM f""")
def _(spark, d):
    return rounded(stats.summary(flights(spark, d), "price"), 4)


@register("e_a3_boundary_mass", f"""{_WITH} SELECT count(*) FILTER (minutes BETWEEN 10 AND 20) AS near_10_20, count(*) FILTER (minutes BETWEEN 13 AND 17) AS near_13_17,
  count(*) FILTER (minutes >= 13 AND minutes < 15) AS moved_at_13, count(*) FILTER (minutes >= 15 AND minutes < 17) AS moved_at_17 FROM f""")
def _(spark, d):
    m = F.col("minutes")
    inside = lambda a, z: F.count_if((m >= a) & (m < z))
    return flights(spark, d).agg(F.count_if(m.between(10, 20)).alias("near_10_20"), F.count_if(m.between(13, 17)).alias("near_13_17"), inside(13, 15).alias("moved_at_13"), inside(15, 17).alias("moved_at_17"))


@register("e_b1_concentration", f"""{_WITH}, g AS (SELECT origin, count(*) AS flights FROM f GROUP BY origin) SELECT origin, flights, row_number() OVER w AS rank, round(flights / sum(flights) OVER (), 6) AS share,
  round(sum(flights) OVER (w ROWS UNBOUNDED PRECEDING) / sum(flights) OVER (), 6) AS cum_share FROM g WINDOW w AS (ORDER BY flights DESC, origin)""".replace("row_number() OVER w AS rank", "CAST(row_number() OVER w AS INTEGER) AS rank"))
def _(spark, d):
    groups = flights(spark, d).groupBy("origin").agg(F.count("*").alias("flights"))
    return rounded(stats.concentration(groups, "origin", "flights"))


@register("e_b4_cause_mix", f"{_WITH} SELECT carrier, round(100 * sum(c1) / (sum(c1) + sum(c2)), 6) AS c1_pct, round(100 * sum(c2) / (sum(c1) + sum(c2)), 6) AS c2_pct FROM f GROUP BY carrier")
def _(spark, d):
    return rounded(stats.shares(flights(spark, d), ["carrier"], ["c1", "c2"]))


@register("e_c4_cause_mix_top_airports", f"""{_WITH}, top AS (SELECT origin FROM f GROUP BY origin ORDER BY count(*) DESC, origin LIMIT 10)
  SELECT origin, round(100 * sum(c1) / (sum(c1) + sum(c2)), 6) AS c1_pct, round(100 * sum(c2) / (sum(c1) + sum(c2)), 6) AS c2_pct FROM f SEMI JOIN top USING (origin) GROUP BY origin""")
def _(spark, d):
    rows = flights(spark, d)
    top = rows.groupBy("origin").count().orderBy(F.col("count").desc(), "origin").limit(10)
    return rounded(stats.shares(rows.join(F.broadcast(top), "origin", "left_semi"), ["origin"], ["c1", "c2"]))


@register("e_b5_spearman", f"""{_WITH}, g AS (SELECT origin, avg(late) AS a, avg(CAST(status = 'P' AS INT)) AS b FROM f GROUP BY origin),
  r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM g) SELECT round(corr(ra, rb), 6) AS rho FROM r""")
def _(spark, d):
    groups = flights(spark, d).groupBy("origin").agg(F.avg("late").alias("a"), F.avg((F.col("status") == "P").cast("int")).alias("b"))
    return rounded(stats.spearman(groups, "a", "b"))


@register("e_b6_schedule_padding", f"""{_WITH}, r AS (SELECT *, origin || '-' || dest AS route FROM f WHERE minutes > 0), top AS (SELECT route FROM r GROUP BY route ORDER BY count(*) DESC, route LIMIT 100),
  c AS (SELECT route, carrier, median(minutes) AS m, count(*) AS n FROM r SEMI JOIN top USING (route) GROUP BY route, carrier HAVING count(*) >= 10),
  s AS (SELECT *, count(*) OVER (PARTITION BY route) AS k, median(m) OVER (PARTITION BY route) AS peer FROM c)
  SELECT carrier, round(median(m), 6) AS median_scheduled, round(median(m - peer), 6) AS difference, CAST(sum(n) AS BIGINT) AS flights, count(*) AS routes FROM s WHERE k >= 2 GROUP BY carrier HAVING count(*) >= 5""")
def _(spark, d):
    rows = flights(spark, d).withColumn("route", F.concat_ws("-", "origin", "dest"))
    return rounded(reports.schedule_padding(rows, "carrier", "route", "minutes", least_rows=10))


@register("e_c3_asymmetry", f"""{_WITH}, o AS (SELECT origin AS airport, count(*) AS origin_flights, avg(late) * 100 AS origin_rate FROM f GROUP BY origin), e AS (SELECT dest AS airport, count(*) AS dest_flights, avg(late) * 100 AS dest_rate FROM f GROUP BY dest)
  SELECT airport, origin_flights, dest_flights, round(origin_rate, 6) AS origin_rate, round(dest_rate, 6) AS dest_rate, round(origin_rate - dest_rate, 6) AS asymmetry FROM o JOIN e USING (airport)""")
def _(spark, d):
    return rounded(reports.side_asymmetry(flights(spark, d), "origin", "dest", _late()))


@register("e_c2_top_airports", f"{_WITH} SELECT origin, count(*) AS flights, round(avg(late) * 100, 6) AS delay_rate FROM f GROUP BY origin ORDER BY count(*) DESC, origin LIMIT 10")
def _(spark, d):
    rows = flights(spark, d).groupBy("origin").agg(F.count("*").alias("flights"), (F.avg("late") * 100).alias("delay_rate"))
    return rounded(rows.orderBy(F.col("flights").desc(), "origin").limit(10))


@register("e_c5_taxi_by_airport", f"{_WITH} SELECT origin, round(avg(price), 4) AS mean, round(median(price), 4) AS median, count(*) AS n FROM f GROUP BY origin")
def _(spark, d):
    return rounded(flights(spark, d).groupBy("origin").agg(F.avg("price").alias("mean"), F.percentile("price", 0.5).alias("median"), F.count("*").alias("n")), 4)


@register("e_c6_geo_join", f"""{_WITH}, g AS (SELECT origin AS airport, count(*) AS flights FROM f GROUP BY origin), c AS (SELECT n_nationkey AS airport, n_nationkey * 3.0 AS lat, n_nationkey * -6.0 AS lon FROM nation)
  SELECT airport, flights, CAST(lat AS DOUBLE) AS "Latitude", CAST(lon AS DOUBLE) AS "Longitude" FROM g JOIN c USING (airport) WHERE lat BETWEEN 24 AND 50 AND lon BETWEEN -125 AND -66""")
def _(spark, d):
    groups = flights(spark, d).groupBy(F.col("origin").alias("airport")).agg(F.count("*").alias("flights"))
    places = read(spark, d, "nation").select(F.col("n_nationkey").alias("airport"), (F.col("n_nationkey") * 3.0).alias("Latitude"), (F.col("n_nationkey") * -6.0).alias("Longitude"))
    return reports.geo(groups, places)


@register("e_d3_pivot_matrix", f"""{_WITH} SELECT priority, round(avg(late) FILTER (flag_day = 0) * 100, 6) AS "0", round(avg(late) FILTER (flag_day = 1) * 100, 6) AS "1", round(avg(late) FILTER (flag_day = 2) * 100, 6) AS "2"
  FROM (SELECT *, isodow(d) % 3 AS flag_day FROM f) GROUP BY priority""")
def _(spark, d):
    rows = flights(spark, d).withColumn("flag_day", ((F.weekday("d") + 1) % 3).cast("int"))
    return rounded(stats.matrix(rows, "priority", "flag_day", [0, 1, 2], F.avg("late") * 100))


@register("a16_row_percent_pivot", f"""{_WITH} SELECT carrier, round(100.0 * count(*) FILTER (flag = 'A')::DOUBLE / count(*), 6) AS "A", round(100.0 * count(*) FILTER (flag = 'N')::DOUBLE / count(*), 6) AS "N", round(100.0 * count(*) FILTER (flag = 'R')::DOUBLE / count(*), 6) AS "R"
  FROM f GROUP BY carrier""")
def _(spark, d):
    cells = flights(spark, d).groupBy("carrier").pivot("flag", ["A", "N", "R"]).count().fillna(0)
    total = F.col("A") + F.col("N") + F.col("R")
    return rounded(cells.select("carrier", *((S.ratio(F.col(c), total) * 100).alias(c) for c in ("A", "N", "R"))))


@register("a12_cut_left", f"""{_WITH} SELECT bin, count(*) AS flights, round(avg(late) * 100, 6) AS delay_rate, round(median(CASE WHEN late = 1 THEN minutes END), 6) AS median_delay FROM (SELECT *, CASE WHEN minutes >= -0.01 AND minutes < 10 THEN '0-10' WHEN minutes < 20 THEN '10-20' WHEN minutes < 30 THEN '20-30'
  WHEN minutes < 40 THEN '30-40' ELSE '40+' END AS bin FROM f) GROUP BY bin""")
def _(spark, d):
    return rounded(reports.binned_rate(flights(spark, d), F.col("minutes"), reports.GUST, _late(), "minutes"))


@register("a13_cut_right", f"""{_WITH} SELECT bin, count(*) AS flights, round(avg(late) * 100, 6) AS delay_rate FROM (SELECT *, CASE WHEN minutes > 0 AND minutes <= 5 THEN '1-5' WHEN minutes <= 15 THEN '6-15' WHEN minutes <= 30 THEN '16-30' WHEN minutes <= 60 THEN '31-60' ELSE '61+' END AS bin FROM f)
  GROUP BY bin""")
def _(spark, d):
    return rounded(reports.binned_rate(flights(spark, d), F.col("minutes"), reports.DEMAND, _late(), right=True))


@register("a14_qcut10", f"""{_WITH}, q AS (SELECT list_sort(list_distinct(quantile_cont(minutes, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e FROM f)
  SELECT CAST(len(list_filter(e[2:len(e) - 1], lambda b: b < minutes)) AS INTEGER) AS bin, count(*) AS n, round(avg(late), 6) AS rate FROM f, q GROUP BY ALL""")
def _(spark, d):
    return rounded(stats.qcut(flights(spark, d), "minutes", 10).groupBy("bin").agg(F.count("*").alias("n"), F.avg("late").alias("rate")))


@register("a3_quantiles", f"{_WITH} SELECT carrier, round(quantile_cont(price, 0.5), 4) AS p50, round(quantile_cont(price, 0.75), 4) AS p75, round(quantile_cont(price, 0.95), 4) AS p95 FROM f GROUP BY carrier")
def _(spark, d):
    return rounded(stats.quantiles(flights(spark, d), "price", [0.5, 0.75, 0.95], ["carrier"]).toDF("carrier", "p50", "p75", "p95"), 4)


@register("a4_a5_row_sums", f"{_WITH} SELECT carrier, round(sum(c1 + c2), 4) AS both, count(*) FILTER ((c1 > 0)::INT + (c2 > 0)::INT = 2) AS two_positive FROM f GROUP BY carrier")
def _(spark, d):
    parts = [F.col("c1"), F.col("c2")]
    return rounded(flights(spark, d).groupBy("carrier").agg(F.sum(S.sum_any(parts)).alias("both"), F.count_if(S.count_positive(parts) == 2).alias("two_positive")), 4)


@register("a8_weighted_mean", f"{_WITH}, g AS (SELECT carrier, origin, avg(minutes) AS m, count(*) AS n FROM f GROUP BY ALL) SELECT carrier, round(sum(m * n) / sum(n), 6) AS mean FROM g GROUP BY carrier")
def _(spark, d):
    g = flights(spark, d).groupBy("carrier", "origin").agg(F.avg("minutes").alias("m"), F.count("*").alias("n"))
    return rounded(g.groupBy("carrier").agg(stats.weighted_mean(F.col("m"), F.col("n")).alias("mean")))


@register("a9_min_max_argument", f"""{_WITH}, g AS (SELECT carrier, origin, count(*) AS n FROM f GROUP BY ALL) SELECT carrier, arg_max(origin, n * 1000 - origin) AS busiest, arg_min(origin, n * 1000 + origin) AS quietest FROM g GROUP BY carrier""")
def _(spark, d):
    g = flights(spark, d).groupBy("carrier", "origin").agg(F.count("*").alias("n"))
    return g.groupBy("carrier").agg(F.max_by("origin", F.struct("n", -F.col("origin"))).alias("busiest"), F.min_by("origin", F.struct("n", "origin")).alias("quietest"))


@register("a6_distinct_sets", f"{_WITH} SELECT origin, count(DISTINCT carrier) AS n, array_to_string(list_sort(list(DISTINCT carrier)), ',') AS carriers FROM f GROUP BY origin")
def _(spark, d):
    return flights(spark, d).groupBy("origin").agg(F.count_distinct("carrier").alias("n"), F.array_join(F.array_sort(F.collect_set("carrier")), ",").alias("carriers"))


@register("a7_value_counts", f"{_WITH} SELECT priority, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM f GROUP BY priority")
def _(spark, d):
    from pyspark.sql import Window

    g = flights(spark, d).groupBy("priority").agg(F.count("*").alias("rows"))
    return rounded(g.withColumn("share", S.ratio(F.col("rows"), F.sum("rows").over(Window.partitionBy()))))


@register("a20_q11_duplicate_keys", "WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT count(*) FILTER (n > 1) AS repeated_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows FROM g")
def _(spark, d):
    return stats.duplicate_keys(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("a21_robust_z", f"""{_WITH}, g AS (SELECT carrier, origin, avg(minutes) AS v FROM f GROUP BY ALL), m AS (SELECT *, median(v) OVER (PARTITION BY carrier) AS md FROM g), a AS (SELECT *, median(abs(v - md)) OVER (PARTITION BY carrier) AS mad FROM m)
  SELECT carrier, origin, round(v, 6) AS v, round(0.6745 * (v - md) / nullif(mad, 0), 4) AS z FROM a""")
def _(spark, d):
    g = flights(spark, d).groupBy("carrier", "origin").agg(F.avg("minutes").alias("v"))
    return stats.robust_z(g, "v", ["carrier"], "z").select("carrier", "origin", F.round("v", 6).alias("v"), F.round("z", 4).alias("z"))


@register("a23_q2_null_audit", "WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, CASE WHEN user_id % 7 = 0 THEN NULL ELSE props END AS props FROM events), "
          "n AS (SELECT count(*) AS r, count(*) - count(event_id) AS a, count(*) - count(value) AS b, count(*) - count(props) AS c FROM e) "
          "SELECT 'event_id' AS \"column\", r AS rows, a AS nulls, round(a / r, 6) AS share, NULL::VARCHAR AS explanation, 'complete' AS status FROM n UNION ALL SELECT 'value', r, b, round(b / r, 6), 'errors have no value', 'explained' FROM n UNION ALL SELECT 'props', r, c, round(c / r, 6), NULL, 'unexplained' FROM n")
def _(spark, d):
    e = read(spark, d, "events")
    e = e.select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"), F.when(F.col("user_id") % 7 != 0, F.col("props")).alias("props"))
    return rounded(stats.null_audit(e, {"value": "errors have no value"}))


@register("u1_u2_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(read(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()


@register("q14_coverage_new_gone", f"""{_WITH}, a AS (SELECT DISTINCT flight % 997 AS value FROM f WHERE d < DATE '1995-03-01'), b AS (SELECT DISTINCT flight % 997 AS value FROM f WHERE d >= DATE '2001-06-01')
  SELECT value, 'new' AS change FROM b ANTI JOIN a USING (value) UNION ALL SELECT value, 'gone' FROM a ANTI JOIN b USING (value)""")
def _(spark, d):
    rows = flights(spark, d).withColumn("v", F.col("flight") % 997)
    return joins.new_and_gone(rows.filter("d < date'1995-03-01'"), rows.filter("d >= date'2001-06-01'"), "v")


@register("q3_cause_population", f"""{_FULL} SELECT 'c1' AS cause, round(count(*) FILTER (ArrDel15 = 1 AND c1 > 0.03)::DOUBLE / count(*) FILTER (ArrDel15 = 1), 6) AS late_share, round(count(*) FILTER (ArrDel15 = 0 AND c1 > 0.03)::DOUBLE / count(*) FILTER (ArrDel15 = 0), 6) AS other_share FROM x
  UNION ALL SELECT 'c2', round(count(*) FILTER (ArrDel15 = 1 AND c2 > 0.03)::DOUBLE / count(*) FILTER (ArrDel15 = 1), 6), round(count(*) FILTER (ArrDel15 = 0 AND c2 > 0.03)::DOUBLE / count(*) FILTER (ArrDel15 = 0), 6) FROM x""")
def _(spark, d):
    rows = target.build_target(outcomes(spark, d)).filter("ArrDel15 is not null")
    rows = rows.withColumns({c: F.when(F.col(c) > 0.03, F.col(c)) for c in ("c1", "c2")})
    return rounded(audits.cause_population(rows, ["c1", "c2"]))


@register("q4_positive_counts", f"{_WITH}, c AS (SELECT (c1 > 0)::INT + (c2 > 0)::INT AS positives, count(*) AS rows FROM f GROUP BY ALL) SELECT CAST(g.i AS INTEGER) AS positives, coalesce(rows, 0) AS rows, round(coalesce(rows, 0) / (SELECT sum(rows) FROM c), 6) AS share FROM range(3) g(i) LEFT JOIN c ON g.i = positives")
def _(spark, d):
    return rounded(audits.positive_counts(flights(spark, d), ["c1", "c2"]))


_GAP = "round(c1 * 100 + c2 * 100, 6) - minutes"


@register("q5_q9_reconciliation", f"""{_WITH}, g AS (SELECT {_GAP} AS gap FROM f) SELECT count(*) AS rows, count(gap) AS compared, count(*) FILTER (abs(gap) <= 1e-6) AS exact, count(*) FILTER (abs(gap) <= 1) AS within_1, count(*) FILTER (abs(gap) <= 5) AS within_5,
  count(*) FILTER (gap < -1e-6) AS below, count(*) FILTER (gap > 1e-6) AS above, round(avg(abs(gap)), 4) AS mean_gap, round(max(abs(gap)), 4) AS max_gap FROM g""")
def _(spark, d):
    return rounded(audits.reconciliation(flights(spark, d), [F.round(F.col("c1") * 100 + F.col("c2") * 100, 6)], F.col("minutes")), 4)


@register("q6_o2_mismatch_topk", f"""{_WITH}, g AS (SELECT flight, minutes, price, {_GAP} AS gap FROM f) SELECT price, round(gap, 4) AS gap, CASE WHEN gap > 0 THEN 'above' ELSE 'below' END AS mismatch FROM g WHERE abs(gap) > 1e-6 ORDER BY abs(gap) DESC, price LIMIT 100""")
def _(spark, d):
    found = audits.mismatches(flights(spark, d), [F.round(F.col("c1") * 100 + F.col("c2") * 100, 6)], F.col("minutes"), "price", 100)
    return rounded(found.select("price", "gap", "mismatch"), 4)


@register("q7_disruptions", f"""{_FULL} SELECT count(*) AS flights, count(*) FILTER (Cancelled = 1) AS cancelled, count(*) FILTER (Diverted = 1) AS diverted, count(*) FILTER (Diverted = 1 AND coalesce(DivReachedDest = 1, false)) AS reached,
  count(*) FILTER (Diverted = 1 AND NOT coalesce(DivReachedDest = 1, false)) AS not_reached FROM x""")
def _(spark, d):
    return audits.disruptions(outcomes(spark, d))


_CODE = "CASE CancellationCode WHEN '1' THEN 'Carrier' WHEN '2' THEN 'Weather' WHEN '3' THEN 'National Air System' WHEN '4' THEN 'Security' ELSE 'Unknown' END"


@register("q8_cancellation_mix", f"{_FULL}, c AS (SELECT {_CODE} AS reason, count(*) AS rows FROM x WHERE Cancelled = 1 GROUP BY ALL) SELECT reason, rows, round(rows / sum(rows) OVER (), 6) AS share FROM c")
def _(spark, d):
    return rounded(audits.cancellation_mix(outcomes(spark, d).withColumn("CancellationCode", F.translate("CancellationCode", "1234", "ABCD"))))


@register("q8_cancellation_mix_by_group", f"""{_FULL}, c AS (SELECT carrier AS segment, {_CODE} AS reason FROM x WHERE Cancelled = 1), top AS (SELECT segment FROM c GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 3)
  SELECT segment, round(100.0 * count(*) FILTER (reason = 'Carrier')::DOUBLE / count(*), 6) AS "Carrier", round(100.0 * count(*) FILTER (reason = 'Weather')::DOUBLE / count(*), 6) AS "Weather", round(100.0 * count(*) FILTER (reason = 'National Air System')::DOUBLE / count(*), 6) AS "National Air System",
  round(100.0 * count(*) FILTER (reason = 'Security')::DOUBLE / count(*), 6) AS "Security", round(100.0 * count(*) FILTER (reason = 'Unknown')::DOUBLE / count(*), 6) AS "Unknown" FROM c SEMI JOIN top USING (segment) GROUP BY segment""")
def _(spark, d):
    return rounded(audits.cancellation_mix(outcomes(spark, d).withColumnRenamed("carrier", "segment").withColumn("CancellationCode", F.translate("CancellationCode", "1234", "ABCD")), "segment", 3))


@register("q10_implausible", f"{_WITH} SELECT count(*) FILTER (c1 <= 0) AS taxi_out, count(*) FILTER (c2 <= 0) AS taxi_in, count(*) FILTER (abs(minutes - (c1 + c2 + 20)) > 1) AS elapsed, count(*) FILTER (minutes = 0) AS distance FROM f")
def _(spark, d):
    rows = flights(spark, d).select(F.col("c1").alias("TaxiOut"), F.col("c2").alias("TaxiIn"), F.lit(20.0).alias("AirTime"), F.col("minutes").alias("ActualElapsedTime"), F.col("minutes").alias("Distance"))
    return audits.implausible(rows)


@register("q12_unstable_keys", f"{_WITH} SELECT origin, CAST(count(DISTINCT carrier) AS INTEGER) AS n, array_to_string(list_sort(list(DISTINCT carrier)), ',') AS \"values\" FROM f GROUP BY origin HAVING count(DISTINCT carrier) > 1")
def _(spark, d):
    return audits.unstable_keys(flights(spark, d), "origin", "carrier").withColumn("values", F.array_join("values", ","))


@register("q13_monthly_reconciliation", f"""{_FULL}, m AS (SELECT strftime(d, '%Y-%m') AS period, count(*) FILTER (Cancelled = 0 AND Diverted = 0 AND ArrDel15 = 0) AS ontime, count(*) FILTER (Cancelled = 0 AND Diverted = 0 AND ArrDel15 = 1) AS delayed, count(*) FILTER (Cancelled = 1) AS cancelled,
  count(*) FILTER (Diverted = 1) AS diverted, count(*) AS total FROM x GROUP BY ALL) SELECT period, ontime, delayed, cancelled, diverted, total, period <> '1996-05' AS agrees, round(ontime / total, 6) AS ontime_of_all, round(ontime / (ontime + delayed), 6) AS ontime_of_arrived FROM m""")
def _(spark, d):
    rows = target.build_target(outcomes(spark, d))
    one = lambda c: F.col(c) == 1
    arrived = ~one("Cancelled") & ~one("Diverted")
    official = rows.groupBy(F.date_format("d", "yyyy-MM").alias("period")).agg(F.count_if(arrived & (F.col("ArrDel15") == 0)).alias("ontime"), F.count_if(arrived & (F.col("ArrDel15") == 1)).alias("delayed"), F.count_if(one("Cancelled")).alias("cancelled"), F.count_if(one("Diverted")).alias("diverted"), F.count("*").alias("total"))
    official = official.withColumn("total", F.when(F.col("period") == "1996-05", F.col("total") + 1).otherwise(F.col("total")))
    counts = audits.monthly_reconciliation(rows, official, "d")
    return rounded(counts.select("period", "ontime", "delayed", "cancelled", "diverted", "total", "agrees", "ontime_of_all", "ontime_of_arrived"))


@register("o5_top3_text", f"""{_WITH}, g AS (SELECT carrier, 'N' || lpad(origin::VARCHAR, 2, '0') AS airport, sum(late)::BIGINT AS n FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY carrier ORDER BY n DESC, airport) AS k FROM g)
  SELECT carrier, string_agg(airport || ':' || n || ' delayed', ', ' ORDER BY k) AS top FROM r WHERE k <= 3 GROUP BY carrier""")
def _(spark, d):
    g = flights(spark, d).groupBy("carrier", F.concat(F.lit("N"), F.lpad(F.col("origin").cast("string"), 2, "0")).alias("airport")).agg(F.sum("late").alias("n"))
    return stats.top_k_text(g, ["carrier"], "airport", "n")


@register("e_g2_dominant_cause", f"""{_WITH}, s AS (SELECT carrier, sum(c1) AS a, sum(c2) AS b FROM f GROUP BY carrier) SELECT carrier, CASE WHEN a >= b THEN 'c1' ELSE 'c2' END AS part, round(greatest(a, b) / (a + b), 6) AS share FROM s""")
def _(spark, d):
    return rounded(reports.dominant_part(flights(spark, d), ["carrier"], ["c1", "c2"]))


@register("e_g4_structural_events", f"""{_WITH}, c AS (SELECT carrier, date_trunc('month', d)::DATE AS month, count(*) AS flights FROM f WHERE NOT (carrier = 'BUILDING' AND d BETWEEN DATE '1997-02-01' AND DATE '1997-04-30') GROUP BY ALL),
  g AS (SELECT k.carrier, m.month FROM (SELECT DISTINCT carrier FROM c) k, (SELECT unnest(generate_series((SELECT min(month) FROM c), (SELECT max(month) FROM c), INTERVAL 1 MONTH))::DATE AS month) m),
  r AS (SELECT carrier, month, coalesce(flights, 0) AS flights, coalesce(flights, 0) / day(last_day(month)) AS per_day FROM g LEFT JOIN c USING (carrier, month)),
  p AS (SELECT *, lag(flights) OVER w AS previous, lag(per_day) OVER w AS pp FROM r WINDOW w AS (PARTITION BY carrier ORDER BY month)),
  q AS (SELECT *, CASE WHEN flights > 0 AND previous > 0 THEN 100 * (per_day / pp - 1) END AS pct, CASE WHEN flights > 0 AND previous > 0 THEN ln(1 + per_day) - ln(1 + pp) END AS lc FROM p),
  z1 AS (SELECT *, median(lc) OVER (PARTITION BY carrier) AS md FROM q), z2 AS (SELECT *, median(abs(lc - md)) OVER (PARTITION BY carrier) AS mad FROM z1),
  z3 AS (SELECT *, 0.6745 * (lc - md) / nullif(mad, 0) AS z, median(CASE WHEN flights > 0 THEN per_day END) OVER (PARTITION BY carrier) AS typical FROM z2)
  SELECT carrier, month, flights, previous, round(per_day, 6) AS per_day, round(pct, 4) AS pct_change, round(z, 4) AS shift_z, CASE WHEN previous = 0 AND flights > 0 THEN 'appearance' WHEN previous > 0 AND flights = 0 THEN 'disappearance' WHEN abs(z) >= 3.5 THEN 'robust shift'
  WHEN abs(pct) >= 20 THEN 'large percentage shift' ELSE '' END AS event, round(per_day / typical, 6) AS volume_index FROM z3""")
def _(spark, d):
    rows = flights(spark, d).filter("not (carrier = 'BUILDING' and d between date'1997-02-01' and date'1997-04-30')")
    out = reports.structural_events(rows, "carrier", "d")
    return out.select("carrier", "month", "flights", "previous", F.round("per_day", 6).alias("per_day"), F.round("pct_change", 4).alias("pct_change"), F.round("shift_z", 4).alias("shift_z"), "event", F.round("volume_index", 6).alias("volume_index"))


@register("o7_stratified_hash_sample", """WITH p AS (SELECT *, CAST('0x' || substr(md5('42|' || o_orderpriority || '|' || o_orderkey), 1, 15) AS BIGINT) % 1000000 AS place FROM orders)
  SELECT * EXCLUDE (place) FROM p WHERE place / 1000000.0 < (SELECT least(1.0, 2000.0 / count(*)) FROM orders)""")
def _(spark, d):
    return sampling.stratified(read(spark, d, "orders"), ["o_orderpriority"], ["o_orderkey"], 2000)


@register("e_b3_magnitude_box", f"""{_WITH}, k AS (SELECT *, row_number() OVER (PARTITION BY carrier ORDER BY substr(md5('42|' || flight || ':' || price || ':' || minutes || ':' || c1 || ':' || c2), 1, 15)) AS n FROM f WHERE minutes <= 300)
  SELECT carrier, round(quantile_cont(minutes, 0.25), 6) AS q1, round(quantile_cont(minutes, 0.5), 6) AS median, round(quantile_cont(minutes, 0.75), 6) AS q3 FROM k WHERE n <= 50000 GROUP BY carrier""")
def _(spark, d):
    rows = flights(spark, d).withColumn("key", F.concat_ws(":", "flight", "price", "minutes", "c1", "c2"))
    return rounded(reports.magnitude_box(rows, "carrier", "minutes", "key"))


@register("o8_first_hashes", "SELECT * FROM orders ORDER BY substr(md5('42|' || o_orderkey), 1, 15), o_orderkey LIMIT 500")
def _(spark, d):
    return sampling.first_hashes(read(spark, d, "orders"), ["o_orderkey"], 500)
