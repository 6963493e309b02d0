"""Statistics over tables: exact quantile bins, robust scores, rank correlation, concentration, audits of nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.stats import ratio
from skyledger.operators.joins import null_safe_left
from skyledger.operators.windows import running_totals
from skyledger.sources.scratch import written


def quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, q0, q1, ...): exact quantiles with linear interpolation, one column for each of ``shares``, one row (for each group).

    Rows are counted by value and the counts are summed along the values in ranges, so that no task holds
    all values. Nulls count nothing; groups without values have no row, a whole table without one has nulls.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    run = running_totals(counts, "__v", ["__n"], descending=False, by=by)
    total = run.groupBy(*by).agg(F.max("cum___n").alias("__all"))
    run = null_safe_left(run, total, by) if by else run.join(F.broadcast(total))  # one row
    place = [F.lit(q) * (F.col("__all") - 1) for q in shares]
    at = lambda k: F.max(F.when((F.col("cum___n") - F.col("__n") <= k) & (k < F.col("cum___n")), F.col("__v").cast("double")))
    cells = [c for i, p in enumerate(place) for c in (at(F.floor(p)).alias(f"__lo{i}"), at(F.ceil(p)).alias(f"__hi{i}"), F.max(p - F.floor(p)).alias(f"__f{i}"))]
    found = run.groupBy(*by).agg(*cells)
    mixed = lambda i: F.when(F.col(f"__lo{i}") == F.col(f"__hi{i}"), F.col(f"__lo{i}")).otherwise((1 - F.col(f"__f{i}")) * F.col(f"__lo{i}") + F.col(f"__f{i}") * F.col(f"__hi{i}"))
    return found.select(*by, *(mixed(i).alias(f"q{i}") for i in range(len(shares))))


def quantile_edges(df: DataFrame, value: str, bins: int) -> list[float]:
    """Distinct exact quantiles 0, 1/bins, ..., 1 with linear interpolation; only these reach the driver."""
    row = quantiles(df, value, [i / bins for i in range(bins + 1)]).first()
    return sorted({e for e in row if e is not None}) if row else []


def qcut(df: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """``df`` with the number, from 0, of each row's quantile bin: closed right, equal edges merged. Null stays null."""
    inner = quantile_edges(df, value, bins)[1:-1]
    number = F.size(F.filter(F.array(*map(F.lit, inner)), lambda e: e < F.col(value))) if inner else F.lit(0)
    return df.withColumn(out, F.when(F.col(value).isNotNull(), number))


def robust_z(df: DataFrame, value: str, by: Sequence[str], out: str = "robust_z") -> DataFrame:
    """0.6745 (x - median) / MAD within groups; null where the MAD is 0 or missing.

    Medians of all groups are selected at once in ranges of (group, value), first those of the values, then those of the
    distances from them, and joined back: no task holds a group's values.
    """
    known = written(df, "values")
    middle = quantiles(known, value, [0.5], by).toDF(*by, "__median")
    apart = written(null_safe_left(known, middle, by).withColumn("__apart", F.abs(F.col(value) - F.col("__median"))), "apart")
    spread = quantiles(apart, "__apart", [0.5], by).toDF(*by, "__mad")
    score = 0.6745 * (F.col(value) - F.col("__median")) / F.nullif(F.col("__mad"), F.lit(0.0))
    return null_safe_left(apart, spread, by).withColumn(out, score).drop("__median", "__mad", "__apart")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row, ``rho``: correlation of average ranks over rows where both are known; for tables of groups."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    for c in (x, y):
        w = Window.orderBy(c)
        known = known.withColumn(f"__{c}", F.rank().over(w) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2)
    return known.agg(F.corr(f"__{x}", f"__{y}").alias("rho"))


def concentration(groups: DataFrame, key: str, count: str) -> DataFrame:
    """(key, count, rank, share, cumulative share), largest first, ties by key; ``groups`` has one row for each key."""
    w = Window.orderBy(F.col(count).desc(), F.col(key))
    total = F.sum(count).over(Window.partitionBy())
    return groups.select(
        key, count, F.row_number().over(w).alias("rank"), ratio(F.col(count), total).alias("share"),
        ratio(F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, 0)), total).alias("cum_share"),
    )


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: mean over rows whose value is known."""
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def summary(df: DataFrame, value: str, quantile_shares: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """One row: count, mean, std, min, exact quantiles and max."""
    plain = df.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    exact = quantiles(df, value, quantile_shares).toDF(*(f"p{round(q * 100):02d}" for q in quantile_shares))
    return plain.join(F.broadcast(exact)).select("count", "mean", "std", "min", *exact.columns, "max")  # one row each


def null_audit(df: DataFrame, explained: dict[str, str] | None = None) -> DataFrame:
    """(column, rows, nulls, share, explanation, status) of every column, from one pass over ``df``."""
    one = df.agg(F.count("*").alias("__rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    long = one.unpivot("__rows", df.columns, "column", "nulls")
    why = F.create_map(*(F.lit(x) for kv in explained.items() for x in kv))[F.col("column")] if explained else F.lit(None).cast("string")
    status = F.when(F.col("nulls") == 0, "complete").when(F.col("explanation").isNotNull(), "explained").otherwise("unexplained")
    return long.select("column", F.col("__rows").alias("rows"), "nulls", ratio(F.col("nulls"), F.col("__rows")).alias("share"), why.alias("explanation")).withColumn("status", status)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many keys repeat and how many rows are beyond the first of theirs; null keys are equal."""
    counts = df.groupBy(*keys).count()
    return counts.agg(F.count_if(F.col("count") > 1).alias("repeated_keys"), F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count") - 1)), F.lit(0)).alias("extra_rows"))


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the last by ``order``, chosen while aggregating."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def shares(df: DataFrame, by: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Each part's percentage of the parts' total within groups; null where the total is 0."""
    sums = df.groupBy(*by).agg(*(F.sum(p).alias(p) for p in parts))
    total = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts[1:]), F.coalesce(F.col(parts[0]), F.lit(0)))
    return sums.select(*by, *(ratio(F.col(p), total).alias(p) for p in parts)).select(*by, *((F.col(p) * 100).alias(f"{p}_pct") for p in parts))


def matrix(df: DataFrame, row: str, column: str, values: Sequence, value: Column) -> DataFrame:
    """One row for each ``row``, one column for each of ``values``; missing cells are null."""
    return df.groupBy(row).pivot(column, list(values)).agg(value)


def top_k_text(df: DataFrame, by: Sequence[str], name: str, count: str, k: int = 3, unit: str = "delayed") -> DataFrame:
    """The ``k`` largest members of each group as one text, ties by name: ``A:12 delayed, B:7 delayed``."""
    w = Window.partitionBy(*by).orderBy(F.col(count).desc(), F.col(name))
    top = df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k)
    item = F.concat(F.col(name).cast("string"), F.lit(":"), F.col(count).cast("string"), F.lit(f" {unit}"))
    return top.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", item.alias("t")))), lambda x: x["t"]), ", ").alias("top"))
