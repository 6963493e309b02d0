"""From raw flights and hourly weather to model rows, for one period or for a pair of periods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.times import clock_timestamp, floor_hour
from skyledger.operators import demand, history, holidays, recent, weather, zones
from skyledger.operators.contracts import ContractError
from skyledger.operators.target import eligible_rows
from skyledger.sources.scratch import written


def prepare_period(flights: DataFrame, hourly: DataFrame, lookup: DataFrame) -> DataFrame:
    """Eligible rows of ``flights`` (target built) with clock, holiday, demand and weather columns.

    Demand counts all scheduled flights, so departure keys are made before rows are left out.
    """
    keyed = flights.withColumn("dep_time_local", clock_timestamp(F.col("FlightDate"), F.col("CRSDepTime")))
    keyed = keyed.withColumn("dep_hour_local", floor_hour(F.col("dep_time_local"))).withColumn("dep_hour", F.hour("dep_hour_local"))
    keyed = written(zones.add_destination_clock(keyed, lookup), "keyed")
    rows = demand.add_schedule_demand(keyed, holidays.add_holidays(eligible_rows(keyed)))
    return weather.add_weather(rows, hourly)


def prepare_pair(train: DataFrame, later: DataFrame, hourly: DataFrame, lookup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model rows of a training period and a later one with history, recent rates and pressure.

    The training rows see completed months before their own; later rows see the state frozen at the end
    of training, and recent days of their own period as far as these were known in time. The rows are
    written between the steps, since checks and fits read them several times.
    """
    first, second = (written(prepare_period(x, hourly, lookup), "prepared") for x in (train, later))
    state = history.fit_rates(first)
    first, second = written(history.add_expanding_rates(first), "expanding"), written(history.apply_rates(second, state), "frozen")
    first, second = recent.add_recent_rates_to_splits(first, second)
    return recent.add_pressure(first), recent.add_pressure(second)


@dataclass(frozen=True)
class FrozenSpec:
    """What a final test may not change: features, rounds and threshold; ``allow_test`` opens the test period."""

    features: tuple[str, ...]
    rounds: int
    threshold: float
    allow_test: bool = False

    def require_open(self) -> None:
        if not self.allow_test:
            raise ContractError("the test period is closed: set allow_test to use it once")
