"""Data-quality audits of flights; each is one aggregate or one small join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.stats import count_positive, ratio, sum_any
from skyledger.operators.stats import quantiles
from skyledger.sources.scratch import written
from skyledger.sources.sinks import largest_first

#: The minutes that explain a delay, and the meanings of cancellation codes.
CAUSES = ("CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay")
CANCELLATION = {"A": "Carrier", "B": "Weather", "C": "National Air System", "D": "Security"}


def cause_population(flights: DataFrame, causes: Sequence[str] = CAUSES, late: str = "ArrDel15") -> DataFrame:
    """(cause, share filled on late rows, on other rows)."""
    yes = F.col(late) == 1
    filled = lambda c, cond: ratio(F.count_if(cond & F.col(c).isNotNull()), F.count_if(cond))
    one = flights.agg(*(f for c in causes for f in (filled(c, yes).alias(f"{c}__late"), filled(c, ~yes).alias(f"{c}__other"))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("cause"), F.col(f"{c}__late").alias("late_share"), F.col(f"{c}__other").alias("other_share")) for c in causes))).alias("r")).select("r.*")


def positive_counts(flights: DataFrame, causes: Sequence[str] = CAUSES) -> DataFrame:
    """(positives, rows, share) for 0 to all causes, empty counts too."""
    counts = flights.select(count_positive([F.col(c) for c in causes]).alias("positives")).groupBy("positives").agg(F.count("*").alias("rows"))
    every = flights.sparkSession.range(len(causes) + 1).select(F.col("id").cast("int").alias("positives"))
    out = every.join(F.broadcast(counts), "positives", "left").fillna(0, ["rows"])
    total = counts.agg(F.sum("rows").alias("__t"))
    return out.join(F.broadcast(total)).select("positives", "rows", ratio(F.col("rows"), F.col("__t")).alias("share"))


def reconciliation(flights: DataFrame, parts: Sequence[Column], whole: Column, exact: float = 1e-6) -> DataFrame:
    """How far the sum of ``parts`` lies from ``whole``: counts within tolerances, below, above, mean and greatest gap."""
    rows = flights.select((sum_any(parts) - whole).alias("gap"))
    gap, size = F.col("gap"), F.abs(F.col("gap"))
    return rows.agg(
        F.count("*").alias("rows"), F.count("gap").alias("compared"), F.count_if(size <= exact).alias("exact"), F.count_if(size <= 1).alias("within_1"), F.count_if(size <= 5).alias("within_5"),
        F.count_if(gap < -exact).alias("below"), F.count_if(gap > exact).alias("above"), F.avg(size).alias("mean_gap"), F.max(size).alias("max_gap"),
    )


def mismatches(flights: DataFrame, parts: Sequence[Column], whole: Column, key: str, rows: int = 200_000, exact: float = 1e-6) -> DataFrame:
    """Rows that do not reconcile, typed, greatest gap first."""
    gap = sum_any(parts) - whole
    kind = F.when(F.col("gap").isNull(), "no_decomposition").when(F.col("gap") > 0, "above").otherwise("below")
    typed = flights.withColumn("gap", gap).filter(F.col("gap").isNull() | (F.abs("gap") > exact)).withColumn("mismatch", kind)
    return largest_first(typed, "gap", key, rows)


def disruptions(flights: DataFrame) -> DataFrame:
    """Totals of cancelled and diverted flights and of diversions that arrived or did not."""
    one = lambda c: F.col(c).eqNullSafe(F.lit(1))
    return flights.agg(F.count("*").alias("flights"), F.count_if(one("Cancelled")).alias("cancelled"), F.count_if(one("Diverted")).alias("diverted"), F.count_if(one("Diverted") & one("DivReachedDest")).alias("reached"), F.count_if(one("Diverted") & ~one("DivReachedDest")).alias("not_reached"))


def cancellation_mix(flights: DataFrame, by: str | None = None, top: int = 10) -> DataFrame:
    """Share of each cancellation reason, overall or in percent for the ``top`` groups of most cancellations."""
    names = F.create_map(*(F.lit(x) for kv in CANCELLATION.items() for x in kv))
    gone = flights.filter(F.col("Cancelled") == 1).withColumn("reason", F.coalesce(names[F.col("CancellationCode")], F.lit("Unknown")))
    if by is None:
        counts = gone.groupBy("reason").agg(F.count("*").alias("rows"))
        return counts.join(F.broadcast(counts.agg(F.sum("rows").alias("__t")))).select("reason", "rows", ratio(F.col("rows"), F.col("__t")).alias("share"))
    leaders = gone.groupBy(by).count().orderBy(F.col("count").desc(), F.col(by)).limit(top).select(by)
    table = gone.join(F.broadcast(leaders), by, "left_semi").groupBy(by).pivot("reason", [*CANCELLATION.values(), "Unknown"]).count().fillna(0)
    cells = [F.col(f"`{r}`") for r in (*CANCELLATION.values(), "Unknown")]
    return table.select(by, *((ratio(c, sum(cells[1:], cells[0])) * 100).alias(r) for c, r in zip(cells, (*CANCELLATION.values(), "Unknown"))))


def implausible(flights: DataFrame) -> DataFrame:
    """Counts of values that cannot be: taxi times of 0 or less, elapsed apart from its parts, distance 0."""
    parts = F.col("TaxiOut") + F.col("AirTime") + F.col("TaxiIn")
    return flights.agg(F.count_if(F.col("TaxiOut") <= 0).alias("taxi_out"), F.count_if(F.col("TaxiIn") <= 0).alias("taxi_in"), F.count_if(F.abs(F.col("ActualElapsedTime") - parts) > 1).alias("elapsed"), F.count_if(F.col("Distance") == 0).alias("distance"))


def unstable_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, values) of keys with more than one value."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values")).filter(F.size("values") > 1).select(key, F.size("values").alias("n"), "values")


def monthly_reconciliation(flights: DataFrame, official: DataFrame, date: str = "FlightDate") -> DataFrame:
    """Our five monthly counts beside official ones (period, ontime, delayed, cancelled, diverted, total), whether
    they agree, and on-time shares of all and of arrived flights."""
    one = lambda c: F.col(c).eqNullSafe(F.lit(1))
    arrived = ~one("Cancelled") & ~one("Diverted")
    ours = flights.groupBy(F.date_format(date, "yyyy-MM").alias("period")).agg(F.count_if(arrived & (F.col("ArrDel15") == 0)).alias("ontime"), F.count_if(arrived & (F.col("ArrDel15") == 1)).alias("delayed"), F.count_if(one("Cancelled")).alias("cancelled"), F.count_if(one("Diverted")).alias("diverted"), F.count("*").alias("total"))
    names = ("ontime", "delayed", "cancelled", "diverted", "total")
    both = ours.join(F.broadcast(official.select("period", *(F.col(n).alias(f"official_{n}") for n in names))), "period")
    agree = F.lit(True)
    for n in names:
        agree = agree & (F.col(n) == F.col(f"official_{n}"))
    return both.withColumns({"agrees": agree, "ontime_of_all": ratio(F.col("ontime"), F.col("total")), "ontime_of_arrived": ratio(F.col("ontime"), F.col("ontime") + F.col("delayed"))})


def freshness(hourly: DataFrame, by: str | None = None, stale: float = 60) -> DataFrame:
    """Ages of snapshots: percentiles and shares over limits, or median, 95th percentile and stale share of each group."""
    age = F.col("snapshot_age_minutes").cast("double")
    over = lambda m: F.avg((age > m).cast("double"))
    if by:
        return hourly.groupBy(by).agg(F.percentile(age, 0.5).alias("median"), F.percentile(age, 0.95).alias("p95"), over(stale).alias("stale_share"))
    shares = (0.5, 0.75, 0.9, 0.95, 0.99)
    ages = written(hourly.select(age.alias("snapshot_age_minutes")), "ages")
    exact = quantiles(ages, "snapshot_age_minutes", shares).toDF(*(f"p{round(100 * q)}" for q in shares))
    return exact.join(F.broadcast(ages.agg(*(over(m).alias(f"over_{m}") for m in (15, 30, 60)))))  # one row each


def coverage(hourly: DataFrame, least: float = 0.8) -> DataFrame:
    """(airport, hours, covered share, low): share of hours with an observation."""
    return hourly.groupBy("airport").agg(F.count("*").alias("hours"), F.avg(1 - F.col("weather_observation_missing").cast("double")).alias("covered")).withColumn("low", F.col("covered") < least)
