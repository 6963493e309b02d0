"""Queries of metrics over scored rows, and of the boosted trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import metrics, model
from skyledger.plans.registry import register
from skyledger.plans.tables import SCORED, outcome_days, read, rounded, scored

_CURVE = f"""WITH {SCORED}, g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM s GROUP BY p),
  c AS (SELECT p, pos, n, sum(pos) OVER w AS tp, sum(n) OVER w AS upto, sum(pos) OVER () AS tot, sum(n) OVER () AS rows FROM g WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) """


@register("m6_average_precision", _CURVE + "SELECT round(sum(pos * tp / upto) / sum(pos), 6) AS average_precision FROM c")
def _(spark, d):
    return rounded(metrics.average_precision(scored(spark, d), "y", "p"))


@register("m7_roc_auc", _CURVE + "SELECT round(sum((n - pos) * (tp - pos / 2)) / (sum(pos) * sum(n - pos)), 6) AS roc_auc FROM c")
def _(spark, d):
    return rounded(metrics.roc_auc(scored(spark, d), "y", "p"))


@register("m12_curves", _CURVE + "SELECT p AS score, CAST(pos AS BIGINT) AS pos, n, CAST(tp AS BIGINT) AS tp, CAST(upto - tp AS BIGINT) AS fp, round(tp / upto, 6) AS precision, round(tp / tot, 6) AS recall, round((upto - tp) / (rows - tot), 6) AS fpr FROM c")
def _(spark, d):
    return rounded(metrics.curve(scored(spark, d), "y", "p"))


@register("m8_logloss_brier", f"WITH {SCORED} SELECT round(-avg(CASE WHEN y = 1 THEN ln(greatest(least(p, 1 - 1e-15), 1e-15)) ELSE ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)) END), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier FROM s")
def _(spark, d):
    y, p = F.col("y"), F.col("p")
    return rounded(scored(spark, d).agg(metrics.log_loss(y, p).alias("log_loss"), metrics.brier(y, p).alias("brier")))


_BINS = f"""WITH {SCORED}, q AS (SELECT list_sort(list_distinct(quantile_cont(p, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e FROM s),
  b AS (SELECT CAST(len(list_filter(e[2:len(e) - 1], lambda x: x < p)) AS INTEGER) AS bin, y, p FROM s, q), k AS (SELECT bin, count(*) AS n, avg(p) AS m, avg(y) AS r FROM b GROUP BY bin) """


@register("m9_ece10", _BINS + "SELECT round(sum(n * abs(r - m)) / sum(n), 6) AS ece FROM k")
def _(spark, d):
    return rounded(metrics.ece(scored(spark, d), "y", "p"))


@register("m12_calibration_curve", _BINS + "SELECT bin, n, round(m, 6) AS mean_score, round(r, 6) AS rate FROM k")
def _(spark, d):
    return rounded(metrics.calibration(scored(spark, d), "y", "p"))


@register("m10_m21_alert_volume", f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY p DESC, id) AS k, count(*) OVER () AS n, sum(y) OVER () AS pos FROM s), f AS (SELECT unnest([0.05, 0.1, 0.2, 0.3])::DOUBLE AS fraction)
  SELECT fraction, CAST(ceil(max(n) * fraction) AS BIGINT) AS flagged, min(p) AS cutoff, round(avg(y), 6) AS precision, round(sum(y) / max(pos), 6) AS capture FROM r JOIN f ON k <= ceil(n * fraction) GROUP BY fraction""")
def _(spark, d):
    return rounded(metrics.alert_volume(scored(spark, d), "y", "p", "id"))


@register("m13_m20_threshold_table", f"""WITH {SCORED}, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5])::DOUBLE AS threshold), k AS (SELECT threshold, count(*) FILTER (p >= threshold AND y = 1) AS tp, count(*) FILTER (p >= threshold AND y = 0) AS fp, count(*) FILTER (p < threshold AND y = 1) AS fn,
  count(*) FILTER (p < threshold AND y = 0) AS tn FROM s, t GROUP BY threshold) SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round((tp + fp) / (tp + fp + fn + tn), 6) AS alert_rate FROM k""")
def _(spark, d):
    return rounded(metrics.threshold_table(scored(spark, d), "y", "p", [0.1, 0.2, 0.3, 0.4, 0.5]))


@register("m13_max_f1", _CURVE + ", x AS (SELECT p, tp / upto AS pr, tp / tot AS rc FROM c), z AS (SELECT *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0) AS f1 FROM x) SELECT p AS threshold, round(f1, 6) AS f1, round(pr, 6) AS precision, round(rc, 6) AS recall FROM z ORDER BY z.f1 DESC, p DESC LIMIT 1")
def _(spark, d):
    return rounded(metrics.max_f1(scored(spark, d), "y", "p"))


@register("m14_m15_m22_monthly_skill", f"""WITH {SCORED}, g AS (SELECT period, p, sum(y) AS pos, count(*) AS n FROM s GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS upto FROM g WINDOW w AS (PARTITION BY period ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
  a AS (SELECT period, sum(pos * tp / upto) / sum(pos) AS ap, sum((n - pos) * (tp - pos / 2)) / (sum(pos) * sum(n - pos)) AS auc FROM c GROUP BY period),
  b AS (SELECT period, count(*) AS rows, avg(y) AS actual, avg(p) AS predicted, avg((p - y) * (p - y)) AS brier, count(*) FILTER (p >= 0.5 AND y = 1) / nullif(count(*) FILTER (p >= 0.5), 0) AS precision, count(*) FILTER (p >= 0.5 AND y = 1) / sum(y) AS recall, count(*) FILTER (p >= 0.5) / count(*) AS alert_rate FROM s GROUP BY period)
  SELECT period, rows, round(actual, 6) AS actual, round(predicted, 6) AS predicted, round(brier, 6) AS brier, round(precision, 6) AS precision, round(recall, 6) AS recall, round(alert_rate, 6) AS alert_rate, round(ap, 6) AS average_precision, round(auc, 6) AS roc_auc,
  round(predicted - actual, 6) AS calibration_gap, round(ap / actual, 6) AS pr_lift, round(1 - brier / (actual * (1 - actual)), 6) AS brier_skill FROM a JOIN b USING (period)""")
def _(spark, d):
    return rounded(metrics.monthly(scored(spark, d), "y", "p", "period", 0.5).drop("log_loss"))


@register("m11_prevalence_baseline", f"WITH {SCORED} SELECT round(-avg(CASE WHEN y = 1 THEN ln(0.21) ELSE ln(0.79) END), 6) AS log_loss, round(avg((0.21 - y) * (0.21 - y)), 6) AS brier, round(abs(avg(y) - 0.21), 6) AS ece, round(avg(y), 6) AS average_precision, 0.5::DOUBLE AS roc_auc FROM s")
def _(spark, d):
    return rounded(metrics.prevalence_baseline(scored(spark, d), "y", 0.21))


@register("m19_experiment_comparison", f"""WITH {SCORED}, e AS (SELECT 'a' AS experiment, avg(y) AS hit, avg((p - y) * (p - y)) AS brier FROM s UNION ALL SELECT 'b', avg((p >= 0.5)::INT), avg(abs(p - y)) FROM s), l AS (SELECT experiment, 'hit' AS metric, hit AS value FROM e UNION ALL SELECT experiment, 'brier', brier FROM e)
  SELECT l.experiment, l.metric, round(l.value, 6) AS value, round(l.value - b.value, 6) AS delta, round(CASE WHEN l.metric = 'hit' THEN 1 ELSE -1 END * (l.value - b.value), 6) AS improvement FROM l JOIN l b ON b.metric = l.metric AND b.experiment = 'a'""")
def _(spark, d):
    y, p = F.col("y"), F.col("p")
    s = scored(spark, d)
    a = s.agg(F.lit("a").alias("name"), F.avg(y.cast("double")).alias("hit"), metrics.brier(y, p).alias("brier"))
    b = s.agg(F.lit("b").alias("name"), F.avg((p >= 0.5).cast("double")).alias("hit"), F.avg(F.abs(p - y)).alias("brier"))
    return rounded(metrics.compare(a.union(b), "name", "a", ["hit"], ["brier"]))


@register("f20_category_alignment", """WITH e AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS c, ts FROM events), l AS (SELECT DISTINCT coalesce(c, '__MISSING__') AS v FROM e WHERE ts < TIMESTAMP '2024-01-15' AND coalesce(c, '') <> 'click')
  SELECT CASE WHEN v IS NULL THEN '__UNSEEN__' ELSE v END AS c, count(*) AS n FROM e LEFT JOIN l ON l.v = coalesce(c, '__MISSING__') WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY ALL""")
def _(spark, d):
    e = read(spark, d, "events").withColumn("c", F.when(F.col("event_id") % 11 != 0, F.col("event_type")))
    levels = model.category_levels(e.filter("ts < timestamp_ntz'2024-01-15 00:00:00' and coalesce(c, '') <> 'click'"), ["c"])
    return model.align_categories(e.filter("ts >= timestamp_ntz'2024-01-15 00:00:00'"), levels).groupBy("c").agg(F.count("*").alias("n"))


def _frame(spark, d):
    e = read(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("date").alias("d"), (F.col("event_type") == "error").cast("int").alias("late"), "value", F.hour("ts").alias("hour"), (F.col("user_id") % 10).cast("string").alias("grp"))


def _fitted(spark, d):
    rows = _frame(spark, d)
    return rows, model.fit_delay_model(rows.filter("d < date'2024-01-20'"), "late", ["value", "hour"], ["grp"], rounds=5, depth=3, rate=0.1)


#: Bins of the stumps: minutes in steps of 5, hours each for itself. A value is missing in every eleventh event.
_EDGES = [[float(x) for x in range(5, 100, 5)], [float(x) for x in range(23)]]
_ALPHA, _LAMBDA, _LEAST, _RATE = 0.05, 5.0, 2.0, 0.3


def _stumps(spark, d, rounds):
    """Trees of one split on fixed bins, from all rows and features, which SQL can state."""
    rows = _frame(spark, d).withColumn("late", F.greatest("late", ((F.col("value") > 40) & (F.col("hour") < 9)).cast("int")))
    rows = rows.withColumn("value", F.when(F.col("id") % 11 != 0, F.col("value")))
    fitted = model.fit_delay_model(rows.filter("d < date'2024-01-20'"), "late", ["value", "hour"], [], rounds=rounds, depth=1, rate=_RATE, min_hessian=_LEAST, alpha=_ALPHA, lambda_=_LAMBDA, subsample=1.0, columns=1.0, edges=_EDGES, base=0.0)
    return rows, fitted


def _stumps_sql(rounds):
    worth = "power(greatest(abs({0}) - %s, 0), 2) / ({1} + %s)" % (_ALPHA, _LAMBDA)
    step = "-%s * sign({0}) * greatest(abs({0}) - %s, 0) / ({1} + %s)" % (_RATE, _ALPHA, _LAMBDA)
    parts = [f"""m0 AS (SELECT event_id AS id, CAST(ts AS DATE) < DATE '2024-01-20' AS train, CAST(event_type = 'error' OR (value > 40 AND hour(ts) < 9) AS INTEGER) AS y, 0.0::DOUBLE AS margin,
      [CASE WHEN event_id % 11 = 0 OR value IS NULL THEN 0 ELSE 1 + len(list_filter({_EDGES[0]}, lambda e: e < value)) END, 1 + hour(ts)] AS x FROM events)"""]
    for k in range(1, rounds + 1):
        parts.append(f"""c{k} AS (SELECT f, x[f] AS b, sum(1 / (1 + exp(-margin)) - y) AS g, sum(1 / (1 + exp(-margin)) * (1 - 1 / (1 + exp(-margin)))) AS h, count(*) AS n FROM m{k - 1}, (SELECT unnest([1, 2]) AS f) WHERE train GROUP BY ALL),
      t{k} AS (SELECT sum(g) AS g, sum(h) AS h, CAST(sum(n) AS BIGINT) AS n FROM c{k} WHERE f = 1),
      o{k} AS (SELECT f, cut, side, coalesce(sum(c.g), 0) AS gl, coalesce(sum(c.h), 0) AS hl, coalesce(sum(c.n), 0) AS nl FROM (SELECT 1 AS f, unnest(range(1, {len(_EDGES[0]) + 2})) AS cut UNION ALL SELECT 2, unnest(range(1, {len(_EDGES[1]) + 2}))) p,
        (SELECT unnest([0, 1]) AS side) s LEFT JOIN c{k} c ON c.f = p.f AND (c.b BETWEEN 1 AND p.cut OR c.b = 0 AND s.side = 1) GROUP BY p.f, cut, side),
      s{k} AS (SELECT * FROM (SELECT o.*, t.g - gl AS gr, t.h - hl AS hr, {worth.format('gl', 'hl')} + {worth.format('(t.g - gl)', '(t.h - hl)')} - {worth.format('t.g', 't.h')} AS gain FROM o{k} o, t{k} t
        WHERE hl >= {_LEAST} AND t.h - hl >= {_LEAST} AND nl > 0 AND t.n - nl > 0) WHERE gain > 1e-6 ORDER BY round(gain, 9) DESC, f, cut, side LIMIT 1),
      m{k} AS (SELECT m.* EXCLUDE (margin), margin + CASE WHEN f IS NULL THEN {step.format('t.g', 't.h')} WHEN x[f] BETWEEN 1 AND cut OR x[f] = 0 AND side = 1 THEN {step.format('gl', 'hl')} ELSE {step.format('gr', 'hr')} END AS margin FROM m{k - 1} m CROSS JOIN t{k} t LEFT JOIN s{k} ON true)""".replace("SELECT f, cut, side, coalesce", "SELECT p.f, cut, side, coalesce"))
    return "WITH " + ", ".join(parts)


@register("m3_first_split", _stumps_sql(1) + f" SELECT CASE f WHEN 1 THEN 'value' ELSE 'hour' END AS feature, CAST(cut - 1 AS INTEGER) AS bin, side = 1 AS missing_left, round(gain, 4) AS gain, CAST(nl AS BIGINT) AS rows_left, round(-{_RATE} * sign(gl) * greatest(abs(gl) - {_ALPHA}, 0) / (hl + {_LAMBDA}), 6) AS left_value, round(-{_RATE} * sign(gr) * greatest(abs(gr) - {_ALPHA}, 0) / (hr + {_LAMBDA}), 6) AS right_value FROM s1")
def _(spark, d):
    """The split of greatest gain under L1 and L2 terms, with the direction of missing values."""
    fitted = _stumps(spark, d, 1)[1]
    t = fitted.trees[0]
    row = (fitted.features[t.feature[0]], t.bin[0], t.missing_left[0], round(t.gain[0], 4), t.rows[t.left[0]], round(t.value[t.left[0]], 6), round(t.value[t.right[0]], 6))
    return spark.createDataFrame([row], "feature string, bin int, missing_left boolean, gain double, rows_left long, left_value double, right_value double")


@register("m3_m4_stump_scores", _stumps_sql(4) + " SELECT id, y AS late, round(1 / (1 + exp(-margin)), 5) AS p_delay FROM m4 WHERE NOT train")
def _(spark, d):
    """Four rounds, frozen: every later row's probability."""
    rows, fitted = _stumps(spark, d, 4)
    return rounded(fitted.score(rows.filter("d >= date'2024-01-20'")).select("id", "late", "p_delay"), 5)


@register("m16_total_gain", _stumps_sql(3) + """, g AS (SELECT f, gain FROM s1 UNION ALL SELECT f, gain FROM s2 UNION ALL SELECT f, gain FROM s3), i AS (SELECT CASE f WHEN 1 THEN 'value' ELSE 'hour' END AS feature, sum(gain) AS gain FROM g GROUP BY f)
  SELECT feature, round(gain, 4) AS gain, CAST(row_number() OVER w AS INTEGER) AS rank, round(gain / sum(gain) OVER (), 4) AS share, round(sum(gain) OVER (w ROWS UNBOUNDED PRECEDING) / sum(gain) OVER (), 4) AS cum_share FROM i WINDOW w AS (ORDER BY gain DESC, feature)""")
def _(spark, d):
    return rounded(model.importance_table(spark, _stumps(spark, d, 3)[1], "total_gain"), 4)


@register("m3_m4_gbt_scores")
def _(spark, d):
    rows, fitted = _fitted(spark, d)
    return fitted.score(rows.filter("d >= date'2024-01-20'")).select("id", "late", "p_delay")


@register("m16_importances")
def _(spark, d):
    return model.importance_table(spark, _fitted(spark, d)[1])


@register("m17_tree_attributions")
def _(spark, d):
    rows, fitted = _fitted(spark, d)
    return model.tree_attributions(fitted, rows, "id")


@register("m17_additivity", "SELECT count(*) AS rows, 0::BIGINT AS off FROM events")
def _(spark, d):
    """Contributions and base of every row add up to its margin."""
    rows, fitted = _fitted(spark, d)
    return model.additivity(model.tree_attributions(fitted, rows, "id"))


@register("t1_streaming_daily_counts", "SELECT CAST(ts AS DATE) AS date, CAST(sum((event_type = 'error')::INT) AS BIGINT) AS p, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    from skyledger.streaming.recent import daily_counts

    return daily_counts(read(spark, d, "events").withColumn("late", (F.col("event_type") == "error").cast("int")), "ts", "late")


@register("t1_lagged_rate", "WITH g AS (SELECT CAST(ts AS DATE) AS d, sum((event_type = 'error')::INT) AS p, count(*) AS n FROM events GROUP BY ALL) SELECT a.d AS date, round(coalesce(sum(b.p) / sum(b.n), 0.2), 6) AS rate FROM g a LEFT JOIN g b ON b.d BETWEEN a.d - 8 AND a.d - 2 GROUP BY a.d")
def _(spark, d):
    from skyledger.streaming.recent import lagged_rate

    daily = outcome_days(spark, d).groupBy(F.col("d").alias("date")).agg(F.sum("late").alias("p"), F.count("*").alias("n"))
    return rounded(lagged_rate(daily))
