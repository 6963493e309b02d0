"""Metrics of scored rows (label 0 or 1, score), exact with ties: rows are summed by score first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.stats import ratio
from skyledger.operators.stats import qcut
from skyledger.operators.windows import running_totals


def by_score(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, pos, n): one row for each distinct score."""
    return df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))


def curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, tp, fp, precision, recall, fpr) at each threshold "score or more", without one task for all scores."""
    counts = by_score(df, label, score)
    total = counts.agg(F.sum("pos").alias("__p"), F.sum("n").alias("__n"))
    run = running_totals(counts, "score", ["pos", "n"]).join(F.broadcast(total))  # one row
    tp, n = F.col("cum_pos"), F.col("cum_n")
    return run.select("score", "pos", "n", tp.alias("tp"), (n - tp).alias("fp"), ratio(tp, n).alias("precision"), ratio(tp, F.col("__p")).alias("recall"), ratio(n - tp, F.col("__n") - F.col("__p")).alias("fpr"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Sum over thresholds of the step in recall times precision."""
    return curve(df, label, score).agg(F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.sum("pos")).alias("average_precision"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Chance that a positive scores above a negative, ties counting half; null with one label only."""
    c = curve(df, label, score)
    beaten = (F.col("n") - F.col("pos")) * (F.col("tp") - F.col("pos") / 2)
    return c.agg(F.try_divide(F.sum(beaten), (F.sum("pos") * F.sum(F.col("n") - F.col("pos"))).cast("double")).alias("roc_auc"))


def ranking_by_group(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """AP and AUC of each group, from running totals over its distinct scores; no task holds all scores of a group."""
    c = running_totals(by_score(df, label, score, by), "score", ["pos", "n"], by=by)
    neg, tp = F.col("n") - F.col("pos"), F.col("cum_pos")
    return c.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("pos") * tp / F.col("cum_n")), F.sum("pos")).alias("average_precision"),
        F.try_divide(F.sum(neg * (tp - F.col("pos") / 2)), (F.sum("pos") * F.sum(neg)).cast("double")).alias("roc_auc"),
    )


def log_loss(y: Column, p: Column, clip: float = 1e-15) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - clip)), F.lit(clip))
    return -F.avg(F.when(y == 1, F.log(q)).otherwise(F.log(1 - q)))


def brier(y: Column, p: Column) -> Column:
    return F.avg((p - y) * (p - y))


def calibration(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, rate) over quantile bins of the score."""
    return qcut(df, score, bins).groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate"))


def ece(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Mean gap of rate and score over quantile bins, by size of bins."""
    c = calibration(df, label, score, bins)
    return c.agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("rate") - F.col("mean_score"))), F.sum("n")).alias("ece"))


def alert_volume(df: DataFrame, label: str, score: str, key: str, fractions: Sequence[float] = (0.05, 0.1, 0.2, 0.3)) -> DataFrame:
    """(fraction, flagged, cutoff, precision, capture) when the best-scored share of rows is flagged, ties by key.

    The cutoff comes from sums by score; only rows that tie at a cutoff are ranked, in ranges of the key.
    """
    c = curve(df, label, score).select("score", "pos", "n", (F.col("tp") + F.col("fp")).alias("upto"), "tp")
    total = c.agg(F.sum("n").alias("rows"), F.sum("pos").alias("positives"))
    wanted = total.select("rows", "positives", F.explode(F.array(*map(F.lit, fractions))).alias("fraction")).withColumn("flagged", F.ceil(F.col("rows") * F.col("fraction")).cast("long"))
    at = c.join(F.broadcast(wanted), (F.col("upto") >= F.col("flagged")) & (F.col("upto") - F.col("n") < F.col("flagged")))
    at = at.select("fraction", "flagged", "positives", F.col("score").alias("cutoff"), (F.col("tp") - F.col("pos")).alias("above"), (F.col("flagged") - F.col("upto") + F.col("n")).alias("need"))
    tied = df.join(F.broadcast(at.select("cutoff").distinct()), F.col(score) == F.col("cutoff"), "left_semi")  # a cutoff for each fraction
    tied = tied.select(F.col(score).alias("cutoff"), F.col(key).alias("key"), F.col(label).cast("long").alias("hit"), F.lit(1).cast("long").alias("one"))
    tied = running_totals(tied, "key", ["hit", "one"], descending=False, by=["cutoff"]).select("cutoff", F.col("cum_one").alias("need"), F.col("cum_hit").alias("tied"))
    out = at.join(tied, ["cutoff", "need"])
    caught = F.col("above") + F.col("tied")
    return out.select("fraction", "flagged", "cutoff", ratio(caught, F.col("flagged")).alias("precision"), ratio(caught, F.col("positives")).alias("capture"))


def threshold_table(df: DataFrame, label: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Confusion counts and rates at each threshold "score or more", from one pass."""
    rows = df.select(F.col(label).cast("int").alias("y"), F.col(score).alias("s"))
    cells = [F.count_if((F.col("s") >= t) & (F.col("y") == 1)).alias(f"tp{i}") for i, t in enumerate(thresholds)] + [F.count_if((F.col("s") >= t) & (F.col("y") == 0)).alias(f"fp{i}") for i, t in enumerate(thresholds)]
    one = rows.agg(*cells, F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("m"))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), (F.col("p") - F.col(f"tp{i}")).alias("fn"), (F.col("m") - F.col(f"fp{i}")).alias("tn")) for i, t in enumerate(thresholds)))).alias("r")).select("r.*")
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return rows.select("threshold", "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tn, tn + fp).alias("specificity"), ratio(tp + fp, tp + fp + fn + tn).alias("alert_rate"))


def max_f1(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, f1, precision, recall) of greatest F1, the highest threshold of equals."""
    c = curve(df, label, score)
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    best = c.select("score", F.coalesce(f1, F.lit(0.0)).alias("f1"), "precision", "recall").agg(F.max_by(F.struct("score", "f1", "precision", "recall"), F.struct("f1", "score")).alias("b"))
    return best.select(F.col("b.score").alias("threshold"), "b.f1", "b.precision", "b.recall")


def summary(df: DataFrame, label: str, score: str, key: str, fraction: float = 0.1) -> DataFrame:
    """One row: ranking, loss, calibration and capture."""
    y, p = F.col(label).cast("double"), F.col(score)
    out = df.agg(log_loss(y, p).alias("log_loss"), brier(y, p).alias("brier"), F.avg(y).alias("prevalence"))
    capture = alert_volume(df, label, score, key, [fraction]).select(F.col("capture").alias("capture_at_fraction"))
    for more in (average_precision(df, label, score), roc_auc(df, label, score), ece(df, label, score), capture):
        out = out.join(F.broadcast(more))  # one row each
    return out


def monthly(df: DataFrame, label: str, score: str, period: str, threshold: float | None = None) -> DataFrame:
    """Stability by month: rates, ranking, Brier score and its skill over prevalence; at a threshold also alerts."""
    y, p = F.col(label).cast("double"), F.col(score)
    cells = [F.count("*").alias("rows"), F.avg(y).alias("actual"), F.avg(p).alias("predicted"), brier(y, p).alias("brier"), log_loss(y, p).alias("log_loss")]
    if threshold is not None:
        hit, alert = F.count_if((p >= threshold) & (y == 1)), F.count_if(p >= threshold)
        cells += [ratio(hit, alert).alias("precision"), ratio(hit, F.sum(y)).alias("recall"), ratio(alert, F.count("*")).alias("alert_rate")]
    out = df.groupBy(period).agg(*cells).join(ranking_by_group(df, label, score, [period]), period)
    base = F.col("actual") * (1 - F.col("actual"))
    return out.withColumns({"calibration_gap": F.col("predicted") - F.col("actual"), "pr_lift": ratio(F.col("average_precision"), F.col("actual")), "brier_skill": 1 - ratio(F.col("brier"), base)})


def prevalence_baseline(df: DataFrame, label: str, rate: float) -> DataFrame:
    """Losses of a constant score."""
    y, p = F.col(label).cast("double"), F.lit(float(rate))
    return df.agg(log_loss(y, p).alias("log_loss"), brier(y, p).alias("brier"), F.abs(F.avg(y) - p).alias("ece"), F.avg(y).alias("average_precision"), F.lit(0.5).alias("roc_auc"))


def compare(experiments: DataFrame, name: str, base: str, higher_is_better: Sequence[str], lower_is_better: Sequence[str]) -> DataFrame:
    """(experiment, metric, value, delta, improvement) of one-row-per-experiment metrics against ``base``."""
    metrics = [*higher_is_better, *lower_is_better]
    long = experiments.unpivot(name, metrics, "metric", "value")
    ref = long.filter(F.col(name) == base).select("metric", F.col("value").alias("__base"))
    sign = F.when(F.col("metric").isin(*higher_is_better), 1).otherwise(-1)
    delta = F.col("value") - F.col("__base")
    return long.join(F.broadcast(ref), "metric").select(F.col(name).alias("experiment"), "metric", "value", delta.alias("delta"), (sign * delta).alias("improvement"))
