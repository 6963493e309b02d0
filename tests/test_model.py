"""The delay model: attributions by brute force, directions against pandas, rounds by average precision, saved models, finite numbers."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skyledger.operators import metrics, model
from skyledger.operators.stats import quantiles
from skyledger.operators.windows import running_totals
from skyledger.sources import scratch


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    made = [(i, rng.gauss(0, 1), rng.choice([0.0, 1.0, 2.0, None]), rng.choice("abcd"), i % 4 == 0) for i in range(600)]
    made = [(i, x, z, c, v, int(x + (c == "a") + rng.gauss(0, 0.7) > 0.4)) for i, x, z, c, v in made]
    return scratch.written(spark.createDataFrame(made, "id long, x double, z double, c string, later boolean, y int"), "rows")


@pytest.fixture(scope="module")
def fitted(rows):
    return model.fit_delay_model(rows, "y", ["x", "z"], ["c"], rounds=3, depth=3, rate=0.3, min_hessian=1.0, lambda_=1.0)


def _worth(tree, row, coalition, node=0):
    """Expected value of a tree when only the coalition's features are known, by walking it."""
    if tree.left[node] < 0:
        return tree.value[node]
    if tree.feature[node] in coalition:
        return _worth(tree, row, coalition, tree.left[node] if tree.goes_left(node, row[None])[0] else tree.right[node])
    share = tree.hessian[tree.left[node]] / tree.hessian[node]
    return share * _worth(tree, row, coalition, tree.left[node]) + (1 - share) * _worth(tree, row, coalition, tree.right[node])


def test_attributions_are_shapley_values(rows):
    """Every tree and feature against the mean over all orders of joining a coalition, at depth 4."""
    wide = rows.withColumns({"w": F.col("x") * F.col("x"), "v": F.col("id") % 7})
    fitted = model.fit_delay_model(wide, "y", ["x", "z", "w", "v"], ["c"], rounds=4, depth=4, rate=0.3, min_hessian=0.5, lambda_=0.5, alpha=0.0)
    x = np.array([r.x for r in fitted.binned(wide.limit(12)).collect()])
    features = x.shape[1]
    assert max(len(t.left) for t in fitted.trees) > 20
    for tree in fitted.trees:
        found, expected = model.attributions(tree, x, features)
        for row, mine in zip(x, found):
            assert _worth(tree, row, ()) == pytest.approx(expected)
            for f in range(features):
                others = [g for g in range(features) if g != f]
                want = sum(
                    math.factorial(n) * math.factorial(features - n - 1) / math.factorial(features) * (_worth(tree, row, (*some, f)) - _worth(tree, row, some)) for n in range(features) for some in itertools.combinations(others, n)
                )
                assert mine[f] == pytest.approx(want, abs=1e-9)
        assert found.sum(axis=1) + expected == pytest.approx(tree.predict(x))


def test_directions(fitted, rows):
    found = model.tree_attributions(fitted, rows, "id")
    table = found.toPandas().pivot(index="key", columns="feature", values="contribution")
    plain = rows.toPandas().set_index(rows.toPandas()["id"].astype(str)).join(table["x"].rename("gx")).join(table["c"].rename("gc"))
    plain["bin"] = pd.qcut(plain["x"], 12, duplicates="drop")
    want = plain.groupby("bin", observed=True).agg(n=("gx", "size"), v=("x", "mean"), dv=("x", "median"), m=("gx", "mean"), d=("gx", "median"), p=("gx", lambda s: (s > 0).mean()))
    got = model.numeric_direction(found, rows, "id", "x").orderBy("bin").toPandas()
    assert got["n"].tolist() == want["n"].tolist() and got["bin"].tolist() == list(range(12))
    assert np.allclose(got[["mean_value", "median_value", "mean_contribution", "median_contribution", "positive_share"]].to_numpy(), want[["v", "dv", "m", "d", "p"]].to_numpy())
    by_level = plain.groupby("c").agg(n=("gc", "size"), m=("gc", "mean"))
    levels = {r.level: (r.n, r.mean_contribution) for r in model.category_direction(found, rows, "id", "c", least_rows=140).collect()}
    assert set(levels) == set(by_level[by_level["n"] >= 140].index) and all(levels[k] == (by_level.loc[k, "n"], pytest.approx(by_level.loc[k, "m"])) for k in levels)
    few = model.numeric_direction(found, rows, "id", "z").orderBy("bin").collect()
    assert [r.mean_value for r in few] == [0.0, 1.0, 2.0]


def test_rounds_stop_at_the_best_average_precision(rows):
    fit = model.fit_delay_model(rows, "y", ["x", "z"], ["c"], rounds=30, depth=3, rate=0.5, min_hessian=1.0, lambda_=0.1, validation="later", patience=2)
    values, best = fit.metadata["average_precision_by_round"], fit.metadata["best_rounds"]
    assert len(values) == best + 2 < 30  # no round behind the end was fitted
    assert len(fit.trees) == best and values[best - 1] == max(values)
    later = fit.score(rows.filter("later"), "p")
    assert metrics.average_precision(later, "y", "p").first()[0] == pytest.approx(values[best - 1])
    by_round = [r.average_precision for r in model.round_precision(fit, rows.filter("later"), "y").orderBy("round").collect()]
    assert by_round == pytest.approx(values[:best])


def test_saved_models_score_the_same(spark, fitted, rows, tmp_path):
    fitted.metadata["threshold"] = 0.3
    model.save_bundle(str(tmp_path / "m"), fitted, monthly=rows.groupBy("y").count())
    again, tables = model.load_bundle(spark, str(tmp_path / "m"), "monthly")
    assert (again.numeric, again.categorical, again.levels, again.metadata) == (fitted.numeric, fitted.categorical, fitted.levels, fitted.metadata)
    both = again.score(fitted.score(rows, "p"), "q")
    assert both.filter("p <> q").isEmpty() and tables["monthly"].count() == 2


def test_infinite_numbers_raise_and_nan_is_missing(fitted, rows):
    odd = rows.withColumn("x", F.when(F.col("id") == 3, F.lit(float("inf"))).otherwise(F.col("x")))
    with pytest.raises(PySparkException, match="infinite value in x"):
        fitted.score(odd).collect()
    nan = fitted.score(rows.withColumn("x", F.lit(float("nan")))).select("id", "p_delay")
    null = fitted.score(rows.withColumn("x", F.lit(None).cast("double"))).select("id", F.col("p_delay").alias("q"))
    assert nan.join(null, "id").filter("p_delay <> q").isEmpty()


def test_quantiles_by_group(spark):
    rng = random.Random(3)
    made = [(g, None if rng.random() < 0.1 else float(rng.randrange(20))) for g in ["a", "b", None] for _ in range(rng.randrange(1, 300))] + [("none", None)]
    df = spark.createDataFrame(made, "g string, v double")
    found = {r.g: (r.q0, r.q1, r.q2) for r in quantiles(df, "v", [0.0, 0.37, 1.0], ["g"]).collect()}
    want = {g: tuple(np.quantile([v for h, v in made if h == g and v is not None], [0, 0.37, 1])) for g in ("a", "b", None)}
    assert set(found) == set(want) and all(found[g] == pytest.approx(want[g]) for g in want)
    assert tuple(quantiles(df.limit(0), "v", [0.5]).first()) == (None,)
    plan = quantiles(df, "v", [0.5])._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower()


@pytest.mark.parametrize("slices", [1, 7])
def test_running_totals_of_groups(spark, slices):
    rng = random.Random(1)
    made = [(rng.choice(["a", "b", None]), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(made, "g string, k int, n int")
    for descending in (False, True):
        want, sums = {}, {}
        for g, k, n in sorted(made, key=lambda r: -r[1] if descending else r[1]):
            sums[g] = sums.get(g, 0) + n
            want[k] = sums[g]
        assert {r.k: r.cum_n for r in running_totals(df, "k", ["n"], descending, slices, ["g"]).collect()} == want


def test_rows_tied_at_the_cutoff_are_taken_by_key(spark):
    made = [(i, i % 3 == 0, round((i % 4) / 4, 2)) for i in range(200)]
    df = spark.createDataFrame(made, "id int, y boolean, p double").withColumn("y", F.col("y").cast("int"))
    got = {r.fraction: (r.flagged, r.cutoff, r.precision) for r in metrics.alert_volume(df, "y", "p", "id").collect()}
    for f in (0.05, 0.1, 0.2, 0.3):
        first = sorted(made, key=lambda r: (-r[2], r[0]))[: math.ceil(200 * f)]
        assert got[f] == (len(first), first[-1][2], pytest.approx(sum(r[1] for r in first) / len(first)))


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        scratch.shared_folder(Session())
    table = scratch.written(spark.range(3), "t")
    assert table.count() == 3
    path = scratch._PATH_OF[table]
    scratch.discard(table)
    with pytest.raises(PySparkException):
        spark.read.parquet(path)


@pytest.mark.parametrize("minutes", [1, 7, 1440])
@pytest.mark.parametrize("exact", [True, False])
def test_asof_without_tolerance_in_slices(spark, monkeypatch, minutes, exact):
    from skyledger.operators import asof

    monkeypatch.setattr(asof, "SLICE_MINUTES", minutes)
    rng, start = random.Random(6), dt.datetime(2024, 1, 1)
    at = lambda: None if rng.random() < 0.05 else start + dt.timedelta(minutes=rng.randrange(120))
    left = [(i, rng.choice(["a", "b", None]), at()) for i in range(150)]
    right = [(rng.choice(["a", "b", "c", None]), at(), i) for i in range(60)]
    a, b = spark.createDataFrame(left, "i int, k string, x timestamp_ntz"), spark.createDataFrame(right, "k string, y timestamp_ntz, v int")
    found = {r.i: (r.y, r.v) for r in asof.asof_join(a, b, ["k"], "x", "y", None, exact).collect()}
    for i, k, x in left:
        fit = [(y, v) for kk, y, v in right if k is not None and kk == k and x is not None and y is not None and (y < x or exact and y == x)]
        assert found[i] == max(fit, default=(None, None))
