"""Statistical columns: rates, intervals, bins and shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; null where the whole is 0 or null."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def wilson(successes: Column, totals: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper Wilson limits in percent; null without trials."""
    n = F.nullif(totals.cast("double"), F.lit(0.0))
    p = successes / n
    centre = p + z * z / (2 * n)
    margin = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    whole = 1 + z * z / n
    return (centre - margin) / whole * 100, (centre + margin) / whole * 100


def cut(value: Column, edges: Sequence[float], labels: Sequence[str], right: bool = False) -> Column:
    """Label of the bin of ``value``: bins are closed left, or right if ``right``; outside: null. ``edges`` has one more than ``labels``."""
    if len(edges) != len(labels) + 1:
        raise ValueError("a bin has two edges")
    inside = (lambda a, b: (value > a) & (value <= b)) if right else (lambda a, b: (value >= a) & (value < b))
    out = None
    for a, b, label in zip(edges, edges[1:], labels):
        out = F.when(inside(a, b), label) if out is None else out.when(inside(a, b), label)
    return out


def bin_of(value: Column, low: float, width: float) -> Column:
    """Number of a fixed-width bin counted from ``low``."""
    return F.floor((value - low) / width)


def smoothed(positives: Column, count: Column, prior: Column, strength: float) -> Column:
    """Rate pulled towards ``prior`` by ``strength`` imagined trials."""
    return (positives + prior * strength) / (count + strength)


def sum_any(columns: Sequence[Column]) -> Column:
    """Sum across columns that skips nulls; null if all are."""
    return F.when(F.coalesce(*columns).isNotNull(), sum((F.coalesce(c, F.lit(0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0))))


def count_positive(columns: Sequence[Column]) -> Column:
    return sum((F.coalesce((c > 0).cast("int"), F.lit(0)) for c in columns[1:]), F.coalesce((columns[0] > 0).cast("int"), F.lit(0)))
