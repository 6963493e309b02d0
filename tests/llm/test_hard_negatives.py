"""The dual-tree search against all pairs, its bounds, and awkward rows."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyledger.llm import hard_negatives
from skyledger.llm.hard_negatives import ANCHOR_LEAF, Search, Tree, interval
from skyledger.llm.queries import op12_hard_negatives, oracle_sql

NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def plain(rows, is_anchor, scale=256, k=5, m=5):
    """rows: (id, label, vector), clean. All pairs."""
    q = {i: (label, [int(np.floor(x * scale)) for x in v]) for i, label, v in rows}
    out = []
    for i, (label, x) in q.items():
        if not is_anchor(i):
            continue
        score = {j: sum(a * b for a, b in zip(x, y)) for j, (_, y) in q.items() if j != i}
        order = sorted(score, key=lambda j: (-score[j], j))
        for p in [j for j in order if q[j][0] == label][:k]:
            fits = [j for j in order if q[j][0] != label and 80 * score[p] <= 100 * score[j] <= 100 * score[p]][:m]
            out += [(i, p, r, j, score[p], score[j]) for r, j in enumerate(fits, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in NAMES) for r in df.collect())


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT {', '.join(NAMES)} FROM ({oracle_sql()['op12_hard_negatives']})").fetchall())
    assert rows_of(op12_hard_negatives(spark, sf)) == want and want


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 6), st.integers(1, 5), st.booleans())
def test_search_equals_all_pairs(seed, width, labels, copies):
    rng = np.random.default_rng(seed)
    n = 700
    vectors = rng.integers(-4, 5, (n, width)).astype(float)  # many ties
    if copies:
        vectors[: n // 2] = vectors[0]
    ids, label = rng.permutation(10 * n)[:n].astype(np.int64), rng.integers(0, labels, n)
    rows = list(zip(ids.tolist(), label.tolist(), vectors.tolist()))
    chosen = set(ids[:40].tolist())
    search = Search(Tree(ids[:40], label[:40], vectors[:40], ANCHOR_LEAF), 5, 5, 80, 100)
    parts = [slice(0, 300), slice(300, 310), slice(310, n)]
    trees = [Tree(ids[p], label[p], vectors[p]) for p in parts]
    for second in (False, True):
        if second:
            search.start_negatives()
        for tree in trees:
            search.walk(tree, second)
    found = search.found()
    assert sorted(zip(*(found[c].tolist() for c in NAMES))) == plain(rows, chosen.__contains__, 1)


def test_intervals_hold_and_prune():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 300, (40, 16))
    vectors = np.floor(centres[rng.integers(0, 40, 6000)] + rng.normal(0, 12, (6000, 16)))
    ids, label = np.arange(6000), rng.integers(0, 4, 6000)
    tree, anchors = Tree(ids, label, vectors), Tree(ids[::5], label[::5], vectors[::5], ANCHOR_LEAF)
    for a in anchors.nodes[::7]:
        for b in tree.nodes[::11]:
            exact = anchors.vectors[a[3] : a[4]] @ tree.vectors[b[3] : b[4]].T
            low, high = interval(a, b)
            assert low <= exact.min() and exact.max() <= high
    search = Search(anchors, 5, 5, 80, 100)
    search.walk(tree, False)
    leaves = [sum(n[7] < 0 for n in t.nodes) for t in (anchors, tree)]
    assert search.pairs < leaves[0] * leaves[1] / 8  # groups of anchors are left out together


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, 0.5]), (0, 1, [0.9, 0.5]), (1, 1, [0.5, 0.4]), (1, 1, [0.5, 0.4]), (2, 2, [0.5, 0.3]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, [nan, 1.0]), (6, 2, [None, 1.0]), (7, 2, [inf, 1.0]),
            (None, 2, [1.0, 1.0]), (8, 2, [0.45]), (9, 2, []), (100, 3, [0.1, 0.1]), (10, 2, [-inf, 0.0]), (11, 1, [1e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "cell", "chunk", "part", "vector", "row", "raw", "n")})
    clean = [(0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.4]), (2, 2, [0.5, 0.3]), (8, 2, [0.45, 0.0]), (9, 2, [0.0, 0.0]), (100, 3, [0.1, 0.1])]
    assert rows_of(hard_negatives.mine(df, F.col("id") % 100 == 0)) == plain(clean, lambda i: i % 100 == 0)
    assert hard_negatives.mine(df.limit(0), F.col("id") % 100 == 0).count() == 0
    assert hard_negatives.mine(df.filter("vec_id = 9"), F.col("id") >= 0).count() == 0
    nothing = df.select(*(F.lit(None).cast(k).alias(c) for c, k in df.dtypes)).limit(3)
    assert hard_negatives.mine(nothing, F.col("id") >= 0).count() == 0


@pytest.mark.parametrize("chunk_rows,group_anchors", [(8192, 256), (50, 3)])
def test_many_chunks_and_groups_with_a_hot_copy(spark, chunk_rows, group_anchors):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(0, 0.4, (400, 6)), 3)
    vectors[100:300] = vectors[100]
    rows = [(i, int(rng.integers(0, 3)), v) for i, v in enumerate(vectors.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert rows_of(hard_negatives.mine(df, F.col("id") % 10 == 0, chunk_rows=chunk_rows, group_anchors=group_anchors)) == plain(rows, lambda i: i % 10 == 0)
