"""The delay target: recovery from diversions, eligibility and the rows a model may use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.operators.contracts import require_columns

#: The outcome columns of a flight.
TARGET_COLUMNS = ("Cancelled", "Diverted", "DivReachedDest", "DivArrDelay", "ArrDelay", "ArrDelayMinutes", "ArrDel15")


def build_target(flights: DataFrame, late_minutes: int = 15) -> DataFrame:
    """Adds ``target_recovered_from_diversion``, ``nonarrival_disruption`` and ``model_eligible``.

    A diverted flight that reached its destination takes the arrival delay of the diversion. A cancelled
    flight, or a diverted one not known to have arrived, is a disruption without arrival.
    """
    require_columns(flights, TARGET_COLUMNS)
    one = lambda c: F.col(c).eqNullSafe(F.lit(1))
    delay = F.col("DivArrDelay")
    recovered = one("Diverted") & one("DivReachedDest") & delay.isNotNull()
    kind = {f.name: f.dataType for f in flights.schema}
    pick = lambda value, c: F.when(recovered, value).otherwise(F.col(c)).cast(kind[c])
    rows = flights.withColumns({
        "target_recovered_from_diversion": recovered,
        "ArrDelay": pick(delay, "ArrDelay"),
        "ArrDelayMinutes": pick(F.greatest(delay, F.lit(0)), "ArrDelayMinutes"),
        "ArrDel15": pick((delay >= late_minutes).cast("int"), "ArrDel15"),
        "nonarrival_disruption": one("Cancelled") | (one("Diverted") & ~one("DivReachedDest")),
    })
    return rows.withColumn("model_eligible", ~F.col("nonarrival_disruption") & F.col("ArrDel15").isNotNull())


def eligible_rows(flights: DataFrame, require_minutes: bool = False) -> DataFrame:
    """Rows whose target may be learned, the target as a small integer."""
    require_columns(flights, ["model_eligible", "ArrDel15", *(["ArrDelayMinutes"] if require_minutes else [])])
    keep = F.coalesce("model_eligible", F.lit(False))
    if require_minutes:
        keep = keep & F.col("ArrDelayMinutes").isNotNull()
    return flights.filter(keep).withColumn("ArrDel15", F.col("ArrDel15").cast("tinyint"))
