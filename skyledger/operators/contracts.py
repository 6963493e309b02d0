"""Checks that a table is what an operator expects: at plan time where the schema tells, else by one aggregate."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks a contract."""


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df


def forbid_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Outputs must not replace columns that are there already."""
    taken = [n for n in names if n in df.columns]
    if taken:
        raise ContractError(f"columns exist already: {', '.join(taken)}")
    return df


def require_none(df: DataFrame, **bad: Column) -> DataFrame:
    """Raises when any row meets one of ``bad``; all conditions are counted in one pass."""
    counts = df.agg(*(F.count_if(c).alias(n) for n, c in bad.items())).first().asDict()
    if found := {n: k for n, k in counts.items() if k}:
        raise ContractError("; ".join(f"{n}: {k} rows" for n, k in found.items()))
    return df


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raises when two rows share ``keys``; null keys count as equal."""
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ContractError(f"rows repeat {', '.join(keys)}")
    return df


def many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], checked: bool = True) -> DataFrame:
    """Left join that keeps each left row once: ``right`` is checked for unique keys unless it is unique by construction."""
    if checked:
        require_unique(right, keys)
    return left.join(right, list(keys), "left")


def require_binary(df: DataFrame, target: str, *keys: str) -> DataFrame:
    """The target is 0 or 1 and neither it nor a key is null."""
    t = F.col(target)
    return require_none(df, **{f"{target} is not 0 or 1": t.isNull() | ~t.isin(0, 1)}, **{f"{k} is null": F.col(k).isNull() for k in keys})


def forbid_leakage(features: Iterable[str], outcomes: Iterable[str]) -> None:
    """No feature may be a column that is known only after departure."""
    if both := sorted(set(features) & set(outcomes)):
        raise ContractError(f"features leak the outcome: {', '.join(both)}")


def require_same_features(features: Sequence[str], frozen: Sequence[str]) -> None:
    """Same names in the same order as the frozen list."""
    if list(features) != list(frozen):
        raise ContractError(f"features differ: missing {sorted(set(frozen) - set(features))}, new {sorted(set(features) - set(frozen))}, or their order")
