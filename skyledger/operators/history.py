"""Smoothed historical rates that use completed months only, and their frozen state for later periods."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.stats import ratio, smoothed
from skyledger.functions.times import month_start
from skyledger.operators.contracts import ContractError, forbid_columns, require_binary, require_columns
from skyledger.operators.joins import null_safe_left
from skyledger.operators.windows import prior_sum


@dataclass(frozen=True)
class RateSpec:
    """A group whose rate is kept: a name, its columns and the strength of the prior."""

    name: str
    columns: tuple[str, ...]
    strength: float

    def __post_init__(self) -> None:
        if not self.columns or self.strength <= 0:
            raise ValueError("a group has columns and a positive strength")

    @property
    def outputs(self) -> tuple[str, str]:
        return f"hist_{self.name}_delay_rate", f"hist_{self.name}_log_count"


#: The groups of the delay model.
DEFAULT_SPECS = (
    RateSpec("carrier", ("Reporting_Airline",), 2000), RateSpec("origin", ("Origin",), 1000), RateSpec("dest", ("Dest",), 1000),
    RateSpec("route", ("Origin", "Dest"), 200), RateSpec("carrier_route", ("Reporting_Airline", "Origin", "Dest"), 100), RateSpec("origin_hour", ("Origin", "dep_hour"), 250),
)


def feature_names(specs: Sequence[RateSpec] = DEFAULT_SPECS) -> list[str]:
    return [n for s in specs for n in s.outputs]


def _rate(frame: DataFrame, spec: RateSpec, prior) -> DataFrame:
    rate, log_count = spec.outputs
    n, p = (F.coalesce(F.col(c), F.lit(0)) for c in ("__n", "__p"))
    return frame.withColumns({rate: smoothed(p, n, prior, spec.strength).cast("float"), log_count: F.log1p(n).cast("float")}).drop("__n", "__p")


def add_expanding_rates(frame: DataFrame, specs: Sequence[RateSpec] = DEFAULT_SPECS, date_col: str = "FlightDate", target: str = "ArrDel15", initial_prior: float = 0.20) -> DataFrame:
    """Each row gets the rates of its groups over all months before its own.

    Rows are summed to months first, so windows run over (group, month) and never over rows. A null key
    is a group of its own. In the first month the prior stands for the missing past.
    """
    if not 0 < initial_prior < 1:
        raise ContractError("the prior lies between 0 and 1")
    require_columns(frame, [date_col, target, *{c for s in specs for c in s.columns}])
    forbid_columns(require_binary(frame, target, date_col), feature_names(specs))
    frame = frame.withColumn("__month", month_start(F.col(date_col)))
    whole = frame.groupBy("__month").agg(F.sum(target).alias("p"), F.count("*").alias("n"))
    whole = whole.select("__month", F.coalesce(ratio(prior_sum(F.col("p"), [], "__month"), prior_sum(F.col("n"), [], "__month")), F.lit(initial_prior)).alias("__prior"))  # one row a month
    out = frame.join(F.broadcast(whole), "__month", "left")
    for s in specs:
        keys = list(s.columns)
        monthly = frame.groupBy(*keys, "__month").agg(F.sum(target).alias("p"), F.count("*").alias("n"))
        past = monthly.select(*keys, "__month", prior_sum(F.col("p"), keys, "__month").alias("__p"), prior_sum(F.col("n"), keys, "__month").alias("__n"))
        out = _rate(null_safe_left(out, past, [*keys, "__month"]), s, F.col("__prior"))
    return out.drop("__month", "__prior")


@dataclass
class RateState:
    """Rates as they stood at the end of a fitting period."""

    global_rate: float
    specs: tuple[RateSpec, ...]
    tables: dict[str, DataFrame]

    def save(self, path: str) -> None:
        """Tables as Parquet, the rest as one line of JSON."""
        for name, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        spark = next(iter(self.tables.values())).sparkSession
        meta = json.dumps({"global_rate": self.global_rate, "specs": [[s.name, list(s.columns), s.strength] for s in self.specs]})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> RateState:
        meta = json.loads(spark.read.text(f"{path}/_meta").first().value)
        specs = tuple(RateSpec(n, tuple(c), k) for n, c, k in meta["specs"])
        return RateState(meta["global_rate"], specs, {s.name: spark.read.parquet(f"{path}/{s.name}") for s in specs})


def fit_rates(frame: DataFrame, specs: Sequence[RateSpec] = DEFAULT_SPECS, target: str = "ArrDel15") -> RateState:
    """Global rate and, for each spec, positives and counts of its groups."""
    require_binary(frame, target)
    rate = frame.agg(F.avg(F.col(target).cast("double"))).first()[0]
    if rate is None:
        raise ContractError("no rows to fit")
    return RateState(rate, tuple(specs), {s.name: frame.groupBy(*s.columns).agg(F.sum(target).alias("positives"), F.count("*").alias("count")) for s in specs})


def apply_rates(frame: DataFrame, state: RateState) -> DataFrame:
    """Rows of a later period with the frozen rates; an unseen group has the global rate and count 0."""
    forbid_columns(frame, feature_names(state.specs))
    for s in state.specs:
        table = state.tables[s.name].select(*s.columns, F.col("positives").alias("__p"), F.col("count").alias("__n"))
        frame = _rate(null_safe_left(frame, table, s.columns), s, F.lit(state.global_rate))
    return frame
