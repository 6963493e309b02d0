"""Connected components of a large edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import discard, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def star(edges: DataFrame, large: bool, step: int) -> tuple[DataFrame, DataFrame]:
    """One contraction, and the table it reads: every node's least neighbour is aggregated first and written,
    so that the join back has two plain shuffled sides and a hub's rows can be split."""
    near = _both(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), f"least{step}")
    joined = near.join(least, "a")
    if large:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), least
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct(), least


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is its least node.

    Self-loops and repeated edges change nothing; no edges, no rows. Rounds grow with the logarithm
    of a component's size; each writes its edges to the shared folder and removes those of the one before.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges0")
    step, before = 0, None
    while True:
        count, total = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if not count or (count, total) == before:
            break
        before, step, old = (count, total), step + 2, edges
        large, least = star(edges, True, step)
        middle = written(large, f"large{step}")
        small, lower = star(middle, False, step + 1)
        edges = written(small, f"small{step}")
        discard(old, least, middle, lower)  # what is written since reads none of them
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
