"""Boosting on histograms against a plain version that tries every split on the rows themselves."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.operators import boosting, model
from skyledger.operators.boosting import Settings

EDGES = [[-1.0, -0.3, 0.0, 0.4, 1.1], [0.5, 1.5]]


def plain_fit(rows, levels, settings, base, one_hot):
    """rows: (x, z, c, y). Margins after all rounds; every split is tried on lists of rows."""
    soft = lambda g: math.copysign(max(abs(g) - settings.alpha, 0), g)
    worth = lambda g, h: soft(g) ** 2 / (h + settings.lambda_)
    margin = [base] * len(rows)
    for _ in range(settings.rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - r[3] for a, r in zip(p, rows)], [a * (1 - a) for a in p]

        def grow(ids, depth):
            sg, sh = sum(g[i] for i in ids), sum(h[i] for i in ids)
            best, chosen = boosting.LEAST_GAIN, None
            for f in range(3) if depth < settings.depth else ():
                known = [i for i in ids if rows[i][f] is not None]
                tests = [(lambda v, e=e: v <= e) for e in EDGES[f]] + [lambda v: True] if f < 2 else []
                if f == 2:
                    present = sorted({rows[i][2] for i in known}, key=levels.index)
                    if len(levels) > one_hot:
                        weight = {c: sum(g[i] for i in known if rows[i][2] == c) / (sum(h[i] for i in known if rows[i][2] == c) + settings.lambda_) for c in present}
                        order = sorted(present, key=lambda c: weight[c])
                        tests = [(lambda v, some=frozenset(order[: k + 1]): v in some) for k in range(len(order))]
                    else:
                        tests = [(lambda v, c=c: v == c) for c in present]
                for test in tests:
                    for missing_left in (False, True):
                        left = [i for i in ids if (missing_left if rows[i][f] is None else test(rows[i][f]))]
                        lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                        if not left or len(left) == len(ids) or min(lh, sh - lh) < settings.min_hessian:
                            continue
                        gain = worth(lg, lh) + worth(sg - lg, sh - lh) - worth(sg, sh)
                        if gain > best + 1e-9:
                            best, chosen = gain, left
            if chosen is None:
                for i in ids:
                    margin[i] += -settings.rate * soft(sg) / (sh + settings.lambda_)
                return
            own = set(chosen)
            grow(chosen, depth + 1)
            grow([i for i in ids if i not in own], depth + 1)

        grow(list(range(len(rows))), 0)
    return margin


@pytest.mark.parametrize("one_hot,alpha,lambda_", [(16, 0.05, 5.0), (2, 0.0, 1.0), (2, 0.4, 0.5)])
def test_equals_a_plain_version(spark, one_hot, alpha, lambda_):
    rng = random.Random(one_hot + int(10 * alpha))
    rows = [(None if rng.random() < 0.15 else rng.gauss(0, 1), rng.choice([0.0, 1.0, 2.0, None]), rng.choice("abcdef")) for _ in range(300)]
    rows = [(*r, int((r[0] or 0.7) + (r[2] in "ad") + (r[1] is None) + rng.gauss(0, 0.8) > 0.9)) for r in rows]
    settings = Settings(rounds=4, depth=3, rate=0.4, min_hessian=1.5, alpha=alpha, lambda_=lambda_, one_hot=one_hot, subsample=1.0, columns=1.0)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, x double, z double, c string, y int").repartition(3)
    levels = list("abcdef")
    fitted, values = boosting.fit(df, "y", ["x", "z"], ["c"], {"c": levels}, EDGES, settings, base=0.2, block=2)
    made = {r.id: r.x for r in boosting.binned(df, ["x", "z"], ["c"], EDGES, {"c": levels}, "id").collect()}
    margin = fitted.margin(np.array([made[i] for i in range(len(rows))]))
    assert margin == pytest.approx(plain_fit(rows, levels, settings, 0.2, one_hot), abs=1e-5)
    assert values == [] and len(fitted.trees) == 4 and sum(f >= 0 for t in fitted.trees for f in t.feature) > 12
    assert any(t.levels[n] for t in fitted.trees for n in range(len(t.left)))


@pytest.mark.parametrize("side", [True, False])
def test_the_direction_of_missing_values_is_learned(spark, side):
    rows = [(float(i % 10), int(i % 10 > 4)) for i in range(200)] + [(None, 1 - side)] * 50
    fitted = model.fit_delay_model(spark.createDataFrame(rows, "a double, y int"), "y", ["a"], [], rounds=1, depth=1, min_hessian=1.0)
    assert fitted.trees[0].missing_left[0] is side and fitted.trees[0].bin[0] == 4


def test_rows_dealt_out_otherwise_give_the_same_trees(spark):
    df = spark.range(500).select("id", F.randn(1).alias("x"), (F.randn(2) > 0.3).cast("int").alias("y"))
    df = spark.createDataFrame(df.withColumn("z", F.col("x") * F.col("y")).toPandas())
    settings = Settings(rounds=3, depth=4, min_hessian=1.0, subsample=1.0)
    found = [boosting.fit(df.repartition(n), "y", ["x", "z"], [], {}, EDGES, settings, block=b)[0].as_dict() for n, b in ((1, 10), (7, 1))]
    assert found[0] == found[1]


def test_bins_samples_and_empty_tables(spark):
    df = spark.createDataFrame([(float(i % 10), float("nan") if i % 3 else 1.0, None, i % 2) for i in range(100)], "a double, b double, c double, y int")
    edges = boosting.bin_edges(df, ["a", "b", "c"], 256)
    assert edges == [[float(i) for i in range(9)], [], []]
    assert all(len(e) < 8 for e in boosting.bin_edges(spark.range(1000).select(F.col("id").alias("a")), ["a"], 8))
    row = np.arange(100_000)
    share = boosting._sampled(row, 0.85, 42, 3)
    assert abs(share.mean() - 0.85) < 0.01 and boosting._sampled(row, 1.0, 42, 3).all() and (share != boosting._sampled(row, 0.85, 42, 4)).any()
    empty = model.fit_delay_model(df.limit(0), "y", ["a"], [], rounds=2)
    assert empty.trees == [] and empty.score(df).filter("p_delay = 0.5").count() == 100
    one = model.fit_delay_model(df.withColumn("y", F.lit(None).cast("int")), "y", ["a"], [], rounds=2)
    assert one.trees == []
    nothing = model.fit_delay_model(df, "y", [], [], rounds=2)
    assert nothing.trees == [] and nothing.score(df, "a").filter("abs(a - 0.5) < 1e-9").count() == 100


def test_unknown_levels_take_the_way_of_missing_values(spark):
    rows = [(c, int(c == "a" or i % 5 == 0)) for i in range(200) for c in "ab"] + [(None, 1)] * 50
    fitted = model.fit_delay_model(spark.createDataFrame(rows, "c string, y int"), "y", [], ["c"], rounds=3, depth=2, min_hessian=0.1, rate=0.5)
    got = {r.c: r.p_delay for r in fitted.score(spark.createDataFrame([("a",), ("b",), (None,), ("zz",)], "c string")).collect()}
    assert got["a"] > 0.7 > got["b"] and got[None] > 0.7 and 0 < got["zz"] < 1


def test_gain_importances_count_every_split(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    df = spark.createDataFrame([(float(a), float(b), int(a + 0.2 * b > 0)) for a, b in x], "a double, b double, y int")
    fitted = model.fit_delay_model(df, "y", ["a", "b"], [], rounds=3, depth=3, min_hessian=1.0)
    total, mean, n = (dict(fitted.importances(k)) for k in ("total_gain", "gain", "weight"))
    assert sum(n.values()) == sum(f >= 0 for t in fitted.trees for f in t.feature)
    assert all(total[f] == pytest.approx(mean[f] * n[f]) for f in total) and total["a"] > total["b"]
    table = model.importance_table(spark, fitted, "total_gain").orderBy("rank").collect()
    assert table[0].feature == "a" and table[-1].cum_share == pytest.approx(1)
