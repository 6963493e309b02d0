"""Recent rates over past days that were known in time: national and by group, on a dense calendar."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.stats import ratio, smoothed
from skyledger.functions.times import day_number
from skyledger.operators.contracts import ContractError, forbid_columns, require_binary, require_columns, require_none
from skyledger.operators.joins import calendar_of
from skyledger.operators.windows import lagged_sum


@dataclass(frozen=True)
class RecentSpec:
    """A group with a rate over a number of days, pulled to the national rate of the same days."""

    name: str
    columns: tuple[str, ...]
    window_days: int
    strength: float

    def __post_init__(self) -> None:
        if not self.name or not self.columns or self.window_days < 1 or self.strength <= 0:
            raise ValueError("a group has a name, columns, days and a positive strength")

    @property
    def output(self) -> str:
        return f"{self.name}_delay_rate_{self.window_days}d"


#: The groups and windows of the delay model.
DEFAULT_SPECS = (RecentSpec("carrier", ("Reporting_Airline",), 28, 500), RecentSpec("origin", ("Origin",), 28, 250), RecentSpec("dest", ("Dest",), 28, 250))
NATIONAL_DAYS = (7, 28)


def feature_names(national: Sequence[int] = NATIONAL_DAYS, specs: Sequence[RecentSpec] = DEFAULT_SPECS) -> list[str]:
    return [f"national_delay_rate_{d}d" for d in national] + [s.output for s in specs]


def _checked(frame: DataFrame, national: Sequence[int], specs: Sequence[RecentSpec], prior: float, lag: int, date_col: str, target: str) -> None:
    if not 0 < prior < 1 or lag < 1 or not national or min(national) < 1 or len(set(national)) != len(national):
        raise ContractError("prior in (0, 1), lag and windows positive, windows distinct")
    if missing := sorted({s.window_days for s in specs} - set(national)):
        raise ContractError(f"no national rate over {missing} days to pull to")
    names = feature_names(national, specs)
    if len(set(names)) != len(names):
        raise ContractError("two outputs share a name")
    keys = {c for s in specs for c in s.columns}
    forbid_columns(require_columns(frame, [date_col, target, *keys]), names)
    require_binary(frame, target, date_col, *keys)


def national_rates(frame: DataFrame, national: Sequence[int] = NATIONAL_DAYS, date_col: str = "FlightDate", target: str = "ArrDel15", prior: float = 0.20, lag: int = 2) -> DataFrame:
    """(date, national_delay_rate_<n>d): one row for each day between the first and the last."""
    daily = frame.groupBy(date_col).agg(F.sum(target).alias("p"), F.count("*").alias("n"))
    dense = calendar_of(frame, date_col).join(daily, date_col, "left").fillna(0, ["p", "n"])  # one row a day
    rate = lambda d: F.coalesce(ratio(lagged_sum(F.col("p"), d, lag, [], date_col), lagged_sum(F.col("n"), d, lag, [], date_col)), F.lit(prior))
    return dense.select(date_col, *(rate(d).alias(f"national_delay_rate_{d}d") for d in national))


def group_rates(frame: DataFrame, spec: RecentSpec, nation: DataFrame, date_col: str = "FlightDate", target: str = "ArrDel15", lag: int = 2) -> DataFrame:
    """(columns, date, rate) for the group's own days: daily sums in a range frame over day numbers, so that
    days without rows count as empty without being made."""
    keys, d = list(spec.columns), spec.window_days
    daily = frame.groupBy(*keys, date_col).agg(F.sum(target).alias("p"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("__day").rangeBetween(-(d + lag - 1), -lag)
    daily = daily.withColumn("__day", day_number(F.col(date_col)))
    past = daily.select(*keys, date_col, *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"__{c}") for c in ("p", "n")))
    past = past.join(F.broadcast(nation.select(date_col, F.col(f"national_delay_rate_{d}d").alias("__prior"))), date_col, "left")
    return past.select(*keys, date_col, smoothed(F.col("__p"), F.col("__n"), F.col("__prior"), spec.strength).alias(spec.output))


def add_recent_rates(frame: DataFrame, national: Sequence[int] = NATIONAL_DAYS, specs: Sequence[RecentSpec] = DEFAULT_SPECS, date_col: str = "FlightDate", target: str = "ArrDel15", prior: float = 0.20, lag: int = 2) -> DataFrame:
    """Each row gets the rates of the days that end ``lag`` days before its own; without such days the prior."""
    _checked(frame, national, specs, prior, lag, date_col, target)
    nation = national_rates(frame, national, date_col, target, prior, lag)
    out = frame.join(F.broadcast(nation), date_col, "left")
    for s in specs:
        out = out.join(group_rates(frame, s, nation, date_col, target, lag), [*s.columns, date_col], "left")
    names = feature_names(national, specs)
    return out.select(*frame.columns, *(F.col(n).cast("float").alias(n) for n in names))


def add_recent_rates_to_splits(train: DataFrame, later: DataFrame, date_col: str = "FlightDate", **options) -> tuple[DataFrame, DataFrame]:
    """Rates for a training period and a later one, which may use its own earlier days; periods must not overlap."""
    end, start = train.agg(F.max(date_col)).first()[0], later.agg(F.min(date_col)).first()[0]
    if end is not None and start is not None and end >= start:
        raise ContractError("the later period starts before the first one ends")
    both = train.withColumn("__later", F.lit(False)).unionByName(later.withColumn("__later", F.lit(True)))
    both = add_recent_rates(both, date_col=date_col, **options)
    return both.filter("not __later").drop("__later"), both.filter("__later").drop("__later")


def add_pressure(frame: DataFrame, short: str = "national_delay_rate_7d", long: str = "national_delay_rate_28d", out: str = "delay_pressure") -> DataFrame:
    """Short rate minus long rate, between -1 and 1."""
    return frame.withColumn(out, F.col(short) - F.col(long))


def require_rates(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every rate is known and lies between 0 and 1."""
    return require_none(frame, **{n: F.col(n).isNull() | ~F.col(n).between(0, 1) for n in names})
