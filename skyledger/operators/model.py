"""The delay model: feature lists, category alignment, boosted trees, importances and exact tree attributions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.operators import history, recent
from skyledger.operators.boosting import Boosted, Settings, Tree, bin_edges, bin_rules, binned, fit, matrix, to_bins
from skyledger.operators.demand import OUTPUTS as DEMAND
from skyledger.operators.holidays import COLUMNS as HOLIDAY
from skyledger.operators.joins import null_safe_left
from skyledger.operators.metrics import average_precision, ranking_by_group
from skyledger.operators.stats import concentration, qcut, quantiles
from skyledger.operators.weather import DEST_COLUMNS, ORIGIN_COLUMNS
from skyledger.sources.scratch import written
from skyledger.sources.sinks import read_json, write_json

#: Features of the schedule, categorical ones, and outcome columns that no model may see.
SCHEDULE = ("Month", "DayofMonth", "DayOfWeek", "Reporting_Airline", "Origin", "Dest", "CRSDepTime", "CRSArrTime", "CRSElapsedTime", "Distance")
CATEGORICAL = ("Reporting_Airline", "Origin", "Dest", "next_holiday_name", "prev_holiday_name", "origin_flight_category", "dest_flight_category")
OUTCOMES = (
    "DepTime", "DepDelay", "DepDelayMinutes", "DepDel15", "TaxiOut", "WheelsOff", "WheelsOn", "TaxiIn", "ArrTime", "ArrDelay", "ArrDelayMinutes", "ArrDel15", "Cancelled", "CancellationCode", "Diverted",
    "DivReachedDest", "DivArrDelay", "ActualElapsedTime", "AirTime", "CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay",
)
MISSING, UNSEEN = "__MISSING__", "__UNSEEN__"


def feature_list(experiment: str = "03b") -> list[str]:
    """Features of an experiment: 01 schedule, holidays, weather and demand; 02 adds history; 03 recent rates; 03b pressure."""
    sides = [f"origin_{c}" for c in (*ORIGIN_COLUMNS, "weather_age_minutes", "weather_observation_missing")] + [f"dest_{c}" for c in (*DEST_COLUMNS, "weather_age_minutes", "weather_observation_missing")]
    out = [*SCHEDULE, *HOLIDAY, *sides, *(d for d in DEMAND if d != "origin_sched_arrivals_this_hour")]
    for name, more in (("02", history.feature_names()), ("03", recent.feature_names()), ("03b", ["delay_pressure"])):
        if name <= experiment:
            out += more
    return out


def category_levels(train: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Distinct values of each column in training, the mark for missing ones among them if any is null; one pass."""
    row = train.agg(*(F.array_sort(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)))).alias(c) for c in columns)).first()
    return {c: list(row[c]) for c in columns}


def aligned(c: str, levels: Sequence[str]) -> Column:
    """Null becomes the missing mark, and a value that training never had the unseen mark."""
    value = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
    return F.when(value.isin(*levels), value).otherwise(UNSEEN) if levels else F.lit(UNSEEN)


def align_categories(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """``df`` with each column of ``levels`` aligned to them."""
    return df.withColumns({c: aligned(c, levels[c]) for c in levels})


@dataclass
class DelayModel:
    """A fitted ensemble and what is needed to use it again; ``metadata`` is anything JSON can hold (metrics, thresholds, years)."""

    numeric: list[str]
    categorical: list[str]
    levels: dict[str, list[str]]
    boosted: Boosted = field(repr=False)
    metadata: dict = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    @property
    def trees(self) -> list[Tree]:
        return self.boosted.trees

    def binned(self, df: DataFrame, *keep: str) -> DataFrame:
        """``keep`` and x, the bins of each row's features."""
        return binned(_prepared(align_categories(df, self.levels), self.numeric), self.numeric, self.categorical, self.boosted.edges, self.levels, *keep)

    def score(self, df: DataFrame, out: str = "p_delay") -> DataFrame:
        """``df`` with the probability of a delay."""
        boosted, numbers = self.boosted, len(self.numeric)
        rules = bin_rules(self.categorical, boosted.edges, self.levels)

        @F.arrow_udf("double")
        def probability(*columns: pa.Array) -> pa.Array:
            return pa.array(1 / (1 + np.exp(-boosted.margin(to_bins(columns[:numbers], columns[numbers:], *rules)))))

        own = {c: finite(c) for c in self.numeric} | {c: aligned(c, self.levels[c]) for c in self.categorical}
        return df.withColumn(out, probability(*own.values()) if own else F.lit(1 / (1 + np.exp(-boosted.base))))

    def importances(self, kind: str = "gain") -> list[tuple[str, float]]:
        """Of each feature that splits: mean gain of its splits, their ``total_gain`` or number (``weight``)."""
        return list(self.boosted.importances(kind).items())

    def save(self, path: str) -> None:
        """One JSON object of the ensemble, feature lists, category levels and metadata."""
        write_json(SparkSession.active(), {"numeric": self.numeric, "categorical": self.categorical, "levels": self.levels, "metadata": self.metadata, "boosted": self.boosted.as_dict()}, f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> DelayModel:
        """The model as it was saved: same scores, features, levels and metadata."""
        kept = read_json(spark, f"{path}/model")
        return cls(kept["numeric"], kept["categorical"], kept["levels"], Boosted.of_dict(kept["boosted"]), kept["metadata"])


def save_bundle(path: str, model: DelayModel, history_state: DataFrame | None = None, **tables: DataFrame) -> None:
    """What an experiment leaves: the model with its metadata, the frozen history it was built with, and result tables by name."""
    model.save(path)
    for name, table in (tables | ({"history": history_state} if history_state is not None else {})).items():
        table.write.mode("overwrite").parquet(f"{path}/tables/{name}")


def load_bundle(spark: SparkSession, path: str, *tables: str) -> tuple[DelayModel, dict[str, DataFrame]]:
    """The model of a bundle and the asked tables."""
    return DelayModel.load(spark, path), {name: spark.read.parquet(f"{path}/tables/{name}") for name in tables}


def finite(c: str) -> Column:
    """A number as double: NaN counts as missing, an infinite value raises when its row is computed."""
    x = F.col(c).cast("double")
    return F.when(F.isnan(x), F.lit(None)).when(F.abs(x) == float("inf"), F.raise_error(F.lit(f"infinite value in {c}")).cast("double")).otherwise(x)


def _prepared(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Finite numbers as doubles; NaN is missing, an infinite value raises."""
    return df.withColumns({c: finite(c) for c in numeric})


def fit_delay_model(train: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], rounds: int = 50, depth: int = 8, rate: float = 0.05, min_hessian: float = 20.0, alpha: float = 0.05, lambda_: float = 5.0, bins: int = 256, one_hot: int = 16,
                    subsample: float = 0.85, columns: float = 0.85, validation: str | None = None, patience: int = 100, seed: int = 42, edges: Sequence[Sequence[float]] | None = None, base: float | None = None) -> DelayModel:
    """Boosted trees on gradient histograms; what the terms mean is in ``boosting``.

    With ``validation`` (a boolean column) only the other rows are trained on, and rounds end ``patience`` rounds
    after the first of greatest average precision on the marked rows; the trees up to that round stay, no
    round behind the end is fitted, and the metadata hold the number of rounds and the values. Without, all ``rounds`` are built, as in a final fit with a
    frozen number of rounds. ``edges`` gives the bins of numbers, by default about equal numbers of rows.
    """
    fit_on = train if validation is None else train.filter(~F.col(validation))
    levels = category_levels(fit_on, categorical) if categorical else {}

    def ready(rows: DataFrame) -> DataFrame:
        return _prepared(align_categories(rows, levels), numeric)

    own = ready(fit_on)
    edges = bin_edges(own, numeric, bins) if edges is None else edges
    settings = Settings(rounds, depth, rate, min_hessian, alpha, lambda_, one_hot, subsample, columns, seed)
    later = None if validation is None else ready(train.filter(F.col(validation)))
    boosted, values = fit(own, target, numeric, categorical, levels, edges, settings, base, later, patience, lambda scored: average_precision(scored, "y", "margin").first()[0] or 0.0)
    metadata = {} if validation is None else {"best_rounds": len(boosted.trees), "average_precision_by_round": values}
    return DelayModel(list(numeric), list(categorical), levels, boosted, metadata)


def round_precision(model: DelayModel, rows: DataFrame, target: str) -> DataFrame:
    """(round, average_precision) of the first 1, 2, ... trees on ``rows``. Rows are summed by round and score before they are ranked."""
    boosted, width = model.boosted, len(model.features)
    made = model.binned(rows.withColumn("__label", F.col(target).cast("int")), "__label")

    def staged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, margin = matrix(b.column("x"), width), np.full(b.num_rows, boosted.base)
            for i, tree in enumerate(boosted.trees):
                margin = margin + tree.predict(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i, np.int32)), pa.array(margin), b.column("__label")], names=["round", "score", "label"])

    scored = made.mapInArrow(staged, "round int, score double, label int")
    return ranking_by_group(scored, "label", "score", ["round"]).select("round", "average_precision")


def importance_table(spark, model: DelayModel, kind: str = "gain") -> DataFrame:
    """(feature, gain, rank, share, cum_share): the importances of the features that split, largest first."""
    return concentration(spark.createDataFrame(model.importances(kind), "feature string, gain double"), "feature", "gain")


def player_weights(share: np.ndarray, passes: np.ndarray) -> np.ndarray:
    """(patterns, players): what each player adds to a leaf of value 1. ``share`` of the training weight passes a player's
    splits, ``passes`` (patterns x players) says who passes.

    The product of (share + pass t) over all players is made once; a player's own factor is divided out of it, from
    the highest power down where it passes and from the lowest up where it does not: squares of the number of players.
    """
    n = len(share)
    product = np.zeros((len(passes), n + 1))
    product[:, 0] = 1.0
    for j in range(n):
        grown = product * share[j]
        grown[:, 1:] += product[:, :-1] * passes[:, j, None]
        product = grown
    size = np.array([factorial(k) * factorial(n - 1 - k) / factorial(n) for k in range(n)])
    out = np.empty((len(passes), n))
    for i in range(n):
        top, total = np.zeros(len(passes)), np.zeros(len(passes))
        for k in range(n - 1, -1, -1):
            top = np.where(passes[:, i], product[:, k + 1] - share[i] * top, product[:, k] / share[i])
            total += size[k] * top
        out[:, i] = (passes[:, i] - share[i]) * total
    return out


def attributions(tree: Tree, x: np.ndarray, features: int) -> tuple[np.ndarray, float]:
    """Exact path-dependent Shapley values of one tree for all rows of binned ``x``, and the tree's expected value.

    The features on a leaf's path are its players: one in the coalition passes its splits or not, one that is not passes them by
    the share of training weight (hessians). Which players a row passes is a number; the weights are made once
    for each such number and looked up.
    """
    out, expected = np.zeros((len(x), features)), 0.0
    stack: list[tuple[int, dict[int, tuple[float, np.ndarray]], float]] = [(0, {}, 1.0)]
    while stack:
        node, path, cover = stack.pop()
        if tree.left[node] < 0:
            value = tree.value[node]
            expected += value * cover
            if not path or not value:
                continue
            share = np.array([s for s, _ in path.values()])
            code = np.zeros(len(x), np.int64)
            for j, (_, passed) in enumerate(path.values()):
                code |= passed.astype(np.int64) << j
            known, at = (np.arange(1 << len(path)), code) if 1 << len(path) <= len(x) else np.unique(code, return_inverse=True)
            table = value * player_weights(share, (known[:, None] >> np.arange(len(path)) & 1).astype(bool))
            out[:, list(path)] += table[at]
            continue
        left, f = tree.goes_left(node, x), tree.feature[node]
        for child, passed in ((tree.left[node], left), (tree.right[node], ~left)):
            share = tree.hessian[child] / tree.hessian[node]
            before = path.get(f)
            mine = (share, passed) if before is None else (before[0] * share, before[1] & passed)
            stack.append((child, path | {f: mine}, cover * share))
    return out, expected


def tree_attributions(model: DelayModel, sample: DataFrame, key: str) -> DataFrame:
    """(key, feature, contribution) of each row of ``sample``, with feature ``__base`` for the expected
    score and ``__margin`` for the model's own raw score: contributions and base add up to the margin."""
    boosted, names = model.boosted, model.features
    rows = model.binned(sample.withColumn("__key", F.col(key).cast("string")), "__key")

    def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"), len(names))
            sums, base = np.zeros((len(x), len(names))), boosted.base
            for tree in boosted.trees:
                one, expected = attributions(tree, x, len(names))
                sums += one
                base += expected
            every = np.column_stack((sums, np.full(len(x), base), boosted.margin(x)))
            label = pa.DictionaryArray.from_arrays(pa.array(np.tile(np.arange(len(names) + 2, dtype=np.int32), len(x))), pa.array([*names, "__base", "__margin"])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("__key").take(pa.array(np.repeat(np.arange(len(x)), len(names) + 2))), label, pa.array(every.ravel())], names=["key", "feature", "contribution"])

    return rows.mapInArrow(explained, "key string, feature string, contribution double")


def additivity(found: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row (rows, off): the rows of ``tree_attributions``, and those whose contributions and base miss the margin by over ``tolerance``."""
    part = F.when(F.col("feature") == "__margin", -F.col("contribution")).otherwise(F.col("contribution"))
    return found.groupBy("key").agg(F.sum(part).alias("gap")).agg(F.count("*").alias("rows"), F.count_if(F.abs("gap") > tolerance).alias("off"))


def numeric_direction(found: DataFrame, values: DataFrame, key: str, feature: str, bins: int = 12, discrete: bool = False) -> DataFrame:
    """Signed attributions of a numeric feature along its values, in quantile bins.

    (feature, bin, n, mean_value, median_value, mean_contribution, median_contribution, positive_share), one row
    a bin in ascending order. With ``discrete``, or no more than ``bins`` values, each value is a bin. Missing
    values are left out. ``found`` comes from ``tree_attributions`` of the rows ``values``.
    """
    rows = _signed(found, values, key, feature).withColumn("value", F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))).filter("value is not null")
    rows = written(rows, "signed")
    few = discrete or rows.select("value").distinct().limit(bins + 1).count() <= bins
    rows = rows.withColumn("bin", F.col("value")) if few else qcut(rows, "value", bins)
    out = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), *_spread())
    out = null_safe_left(out, quantiles(rows, "value", [0.5], ["bin"]).toDF("bin", "median_value"), ["bin"])
    out = null_safe_left(out, quantiles(rows, "contribution", [0.5], ["bin"]).toDF("bin", "median_contribution"), ["bin"])
    number = F.row_number().over(Window.orderBy("mean_value")) - 1  # one row a bin
    return out.select(F.lit(feature).alias("feature"), number.alias("bin"), "n", "mean_value", "median_value", "mean_contribution", "median_contribution", "positive_share")


def category_direction(found: DataFrame, values: DataFrame, key: str, feature: str, least_rows: int = 100) -> DataFrame:
    """(feature, level, n, mean_contribution, median_contribution, positive_share) of each level with at least ``least_rows`` rows; null is a level of its own."""
    rows = written(_signed(found, values, key, feature).select(F.coalesce(F.col("value").cast("string"), F.lit(MISSING)).alias("level"), "contribution"), "signed")
    out = rows.groupBy("level").agg(F.count("*").alias("n"), *_spread()).filter(F.col("n") >= least_rows)
    out = null_safe_left(out, quantiles(rows, "contribution", [0.5], ["level"]).toDF("level", "median_contribution"), ["level"])
    return out.select(F.lit(feature).alias("feature"), "level", "n", "mean_contribution", "median_contribution", "positive_share")


def _spread() -> list[Column]:
    return [F.avg("contribution").alias("mean_contribution"), F.avg((F.col("contribution") > 0).cast("double")).alias("positive_share")]


def _signed(found: DataFrame, values: DataFrame, key: str, feature: str) -> DataFrame:
    own = found.filter(F.col("feature") == feature).select("key", "contribution")
    return own.join(values.select(F.col(key).cast("string").alias("key"), F.col(feature).alias("value")), "key")


def mean_attributions(found: DataFrame) -> DataFrame:
    """(feature, mean absolute contribution, rank, share, cum_share)."""
    means = found.filter(~F.col("feature").isin("__base", "__margin")).groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    return concentration(means, "feature", "mean_abs")
