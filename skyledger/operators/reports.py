"""Exploratory reports over flights with a built target; each gives the table behind a figure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.stats import bin_of, cut, ratio, wilson
from skyledger.functions.times import days_in_month, month_start
from skyledger.operators.joins import null_safe_left
from skyledger.operators.sampling import per_group
from skyledger.operators.stats import keep_last, matrix, quantiles, robust_z
from skyledger.operators.windows import centred

#: Bins of gusts in knots, precipitation in millimetres, visibility in miles (closed left) and
#: of hourly departures and airport sizes (closed right).
_INF = float("inf")
GUST = ((-0.01, 10, 20, 30, 40, _INF), ("0-10", "10-20", "20-30", "30-40", "40+"))
PRECIPITATION = ((-0.001, 0.001, 1, 3, 6, _INF), ("none", "0-1", "1-3", "3-6", "6+"))
VISIBILITY = ((-_INF, 1, 3, 5, 10, _INF), ("<1", "1-3", "3-5", "5-10", "10+"))
DEMAND = ((0, 5, 15, 30, 60, _INF), ("1-5", "6-15", "16-30", "31-60", "61+"))
AIRPORT_SIZE = ((-1, 499, 4999, 49999, _INF), ("<500", "500-5k", "5k-50k", "50k+"))


def operated(flights: DataFrame) -> DataFrame:
    """Flights without disruption whose target and minutes are known."""
    return flights.filter(~F.col("nonarrival_disruption") & F.col("ArrDel15").isNotNull() & F.col("ArrDelayMinutes").isNotNull())


def delay_rate(df: DataFrame, by: Sequence[str], late: Column, z: float = 1.96) -> DataFrame:
    """(by, flights, delayed, delay_rate, lower, upper) in percent with Wilson limits."""
    counts = df.groupBy(*by).agg(F.count("*").alias("flights"), F.count_if(late).alias("delayed"))
    low, high = wilson(F.col("delayed"), F.col("flights"), z)
    return counts.select(*by, "flights", "delayed", (ratio(F.col("delayed"), F.col("flights")) * 100).alias("delay_rate"), low.alias("lower"), high.alias("upper"))


def disruption_rates(flights: DataFrame, by: str) -> DataFrame:
    """All and operated flights of each group in one pass, with rates of delay, cancellation and non-arrival."""
    ok = ~F.col("nonarrival_disruption") & F.col("ArrDel15").isNotNull()
    counts = flights.groupBy(by).agg(F.count("*").alias("flights"), F.count_if(ok).alias("operated"), F.count_if(ok & (F.col("ArrDel15") == 1)).alias("delayed"), F.count_if(F.col("Cancelled") == 1).alias("cancelled"), F.count_if("nonarrival_disruption").alias("nonarrival"))
    low, high = wilson(F.col("delayed"), F.col("operated"))
    pct = lambda a, b: ratio(F.col(a), F.col(b)) * 100
    return counts.withColumns({"delay_rate": pct("delayed", "operated"), "lower": low, "upper": high, "cancel_rate": pct("cancelled", "flights"), "nonarrival_rate": pct("nonarrival", "flights")})


def histogram(df: DataFrame, value: Column, low: float, width: float, high: float | None = None) -> DataFrame:
    """(bin_start, rows) of fixed-width bins."""
    rows = df.select(value.alias("v")).filter(F.col("v") >= low)
    if high is not None:
        rows = rows.filter(F.col("v") < high)
    return rows.groupBy((low + bin_of(F.col("v"), low, width) * width).alias("bin_start")).agg(F.count("*").alias("rows"))


def severity(df: DataFrame, by: Sequence[str], minutes: str) -> DataFrame:
    """(by, rows, mean, median, p90) of minutes."""
    plain = df.groupBy(*by).agg(F.count(minutes).alias("rows"), F.avg(minutes).alias("mean"))
    return null_safe_left(plain, quantiles(df, minutes, [0.5, 0.9], by).toDF(*by, "median", "p90"), by)


def magnitude_box(df: DataFrame, by: str, minutes: str, key: str, cap: float = 300, rows: int = 50_000) -> DataFrame:
    """Quartiles of minutes up to ``cap`` over at most ``rows`` rows of each group (the report's own sample)."""
    some = per_group(df.filter(F.col(minutes) <= cap), [by], [key], rows)
    return some.groupBy(by).agg(*(F.percentile(minutes, q).alias(n) for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))))


def schedule_padding(flights: DataFrame, carrier: str, route: str, minutes: str, top: int = 100, least_rows: int = 100, least_routes: int = 5) -> DataFrame:
    """How a carrier's scheduled minutes differ from its peers on routes that several carriers serve.

    Medians per carrier and route, over the busiest routes and cells of enough rows; each carrier weighs
    the same in a route's peer median; carriers with enough shared routes are reported.
    """
    known = flights.filter(F.col(minutes) > 0)
    busiest = known.groupBy(route).count().orderBy(F.col("count").desc(), F.col(route)).limit(top).select(route)
    cells = known.join(F.broadcast(busiest), route, "left_semi").groupBy(route, carrier).agg(F.percentile(minutes, 0.5).alias("m"), F.count("*").alias("n")).filter(F.col("n") >= least_rows)
    w = Window.partitionBy(route)
    cells = cells.withColumns({"carriers": F.count("*").over(w), "peer": F.percentile("m", 0.5).over(w)}).filter("carriers >= 2")
    out = cells.groupBy(carrier).agg(F.percentile("m", 0.5).alias("median_scheduled"), F.percentile(F.col("m") - F.col("peer"), 0.5).alias("difference"), F.sum("n").alias("flights"), F.count("*").alias("routes"))
    return out.filter(F.col("routes") >= least_routes)


def side_asymmetry(df: DataFrame, origin: str, dest: str, late: Column, least: int = 1) -> DataFrame:
    """(airport, origin_rate, dest_rate, asymmetry) in percentage points for airports with enough flights both ways."""
    side = lambda c, p: df.groupBy(F.col(c).alias("airport")).agg(F.count("*").alias(f"{p}_flights"), F.count_if(late).alias(f"{p}_delayed"))
    both = side(origin, "origin").join(side(dest, "dest"), "airport").filter((F.col("origin_flights") >= least) & (F.col("dest_flights") >= least))
    o, d = (ratio(F.col(f"{p}_delayed"), F.col(f"{p}_flights")) * 100 for p in ("origin", "dest"))
    return both.select("airport", "origin_flights", "dest_flights", o.alias("origin_rate"), d.alias("dest_rate"), (o - d).alias("asymmetry"))


def geo(stats: DataFrame, coordinates: DataFrame, box: tuple[float, float, float, float] = (24.0, 50.0, -125.0, -66.0)) -> DataFrame:
    """Airport statistics with coordinates inside a box (south, north, west, east)."""
    s, n, w, e = box
    joined = stats.join(F.broadcast(coordinates.withColumnRenamed("Airport", "airport")), "airport")
    return joined.filter(F.col("Latitude").between(s, n) & F.col("Longitude").between(w, e))


def binned_rate(df: DataFrame, value: Column, bins: tuple, late: Column, minutes: str | None = None, right: bool = False) -> DataFrame:
    """(bin, flights, delay_rate[, median minutes of delayed]) over fixed bins."""
    cells = [F.count("*").alias("flights"), (F.avg(late.cast("double")) * 100).alias("delay_rate")]
    if minutes:
        cells.append(F.percentile(F.when(late, F.col(minutes)), 0.5).alias("median_delay"))
    return df.withColumn("bin", cut(value, *bins, right=right)).filter("bin is not null").groupBy("bin").agg(*cells)


def outlier_days(daily: DataFrame, date: str, value: str, size: int = 30, least: int = 10, k: float = 3.0) -> DataFrame:
    """Days whose value exceeds the centred median by k robust deviations: (date, value, median, mad, upper, outlier)."""
    rows = daily.select(date, value).withColumn("median", centred(F.col(value), size, least, [], date))  # one row a day
    rows = rows.withColumn("mad", centred(F.abs(F.col(value) - F.col("median")), size, least, [], date))
    upper = F.col("median") + k * 1.4826 * F.col("mad")
    return rows.withColumns({"upper": upper, "outlier": F.coalesce(F.col(value) > upper, F.lit(False))})


def structural_events(flights: DataFrame, group: str, date: str, z_limit: float = 3.5, change_limit: float = 20) -> DataFrame:
    """Month by month for each group, absent months as 0: volume a day, changes, their robust score and the kind of event."""
    counts = flights.filter(F.col(group).isNotNull()).groupBy(group, month_start(F.col(date)).alias("month")).agg(F.count("*").alias("flights"))
    ends = counts.agg(F.min("month").alias("a"), F.max("month").alias("z"))
    months = ends.filter("a is not null").select(F.explode(F.sequence("a", "z", F.expr("interval 1 month"))).alias("month"))
    grid = counts.select(group).distinct().crossJoin(F.broadcast(months))
    w = Window.partitionBy(group).orderBy("month")
    rows = grid.join(counts, [group, "month"], "left").fillna(0, ["flights"]).withColumn("per_day", F.col("flights") / days_in_month(F.col("month")))
    rows = rows.withColumns({"previous": F.lag("flights").over(w), "previous_per_day": F.lag("per_day").over(w)})
    valid = (F.col("flights") > 0) & (F.col("previous") > 0)
    rows = rows.withColumns({"pct_change": F.when(valid, 100 * (F.try_divide("per_day", "previous_per_day") - 1)), "log_change": F.when(valid, F.log1p("per_day") - F.log1p("previous_per_day"))})
    rows = robust_z(rows, "log_change", [group], "shift_z")
    event = F.when((F.col("previous") == 0) & (F.col("flights") > 0), "appearance").when((F.col("previous") > 0) & (F.col("flights") == 0), "disappearance")
    event = event.when(F.abs("shift_z") >= z_limit, "robust shift").when(F.abs("pct_change") >= change_limit, "large percentage shift").otherwise("")
    typical = rows.filter("flights > 0").groupBy(group).agg(F.percentile("per_day", 0.5).alias("__typical"))
    out = rows.withColumn("event", event).join(typical, group, "left")
    return out.select(group, "month", "flights", "previous", "per_day", "pct_change", "log_change", "shift_z", "event", ratio(F.col("per_day"), F.col("__typical")).alias("volume_index"))


def dominant_part(df: DataFrame, by: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """(by, part, share): the part of greatest sum in each group, ties by name."""
    sums = df.groupBy(*by).agg(*(F.coalesce(F.sum(p), F.lit(0)).cast("double").alias(p) for p in parts))
    long = sums.unpivot(list(by), list(parts), "part", "total").join(sums.select(*by, sum((F.col(p) for p in parts[1:]), F.col(parts[0])).alias("__all")), list(by))
    best = keep_last(long.withColumn("__order", -F.ascii(F.col("part"))), list(by), ["total", "__order"])
    return best.select(*by, "part", ratio(F.col("total"), F.col("__all")).alias("share"))


def weather_validation(df: DataFrame, category: str, late: str, weather_minutes: str, nas_minutes: str) -> DataFrame:
    """(category, flights, delayed, delay_rate, weather_nas_per_flight) of rows whose category is known; flights are those with a known outcome, missing minutes count 0."""
    minutes = F.coalesce(F.col(weather_minutes), F.lit(0)) + F.coalesce(F.col(nas_minutes), F.lit(0))
    sums = df.filter(F.col(category).isNotNull()).groupBy(category).agg(F.count(late).alias("flights"), F.sum(late).alias("delayed"), F.sum(minutes).alias("minutes"))
    return sums.select(category, "flights", "delayed", (ratio(F.col("delayed"), F.col("flights")) * 100).alias("delay_rate"), ratio(F.col("minutes"), F.col("flights")).alias("weather_nas_per_flight"))


def weather_warning(df: DataFrame, category: str, late: str) -> DataFrame:
    """One row (vfr_rate, low_rate, suspicious): a join of weather is suspicious where the delay rate under IFR or LIFR is not above that under VFR."""
    rate = lambda *names: F.avg(F.when(F.col(category).isin(*names), F.col(late).cast("double"))) * 100
    return df.agg(rate("VFR").alias("vfr_rate"), rate("IFR", "LIFR").alias("low_rate")).withColumn("suspicious", F.coalesce(F.col("low_rate") <= F.col("vfr_rate"), F.lit(False)))


def precipitation_phase(frozen: Column, precip_mm: Column, temp_c: Column) -> Column:
    """Frozen or Liquid near freezing (5 degrees either way); null elsewhere and without precipitation."""
    return F.when(temp_c.between(-5, 5), F.when(frozen == 1, "Frozen").when((frozen == 0) & (precip_mm > 0), "Liquid"))


def weather_panel(df: DataFrame, bin_: Column, late: str, minutes: str) -> DataFrame:
    """(bin, flights, delayed_flights, delay_rate, mean_delay, median_delay, p90_delay) of rows whose bin and outcome are known; severity is of delayed flights."""
    rows = df.select(bin_.alias("bin"), F.col(late).alias("late"), F.when(F.col(late) == 1, F.col(minutes)).alias("minutes")).filter("bin is not null and late is not null")
    plain = rows.groupBy("bin").agg(F.count("*").alias("flights"), F.count("minutes").alias("delayed_flights"), (F.avg(F.col("late").cast("double")) * 100).alias("delay_rate"), F.avg("minutes").alias("mean_delay"))
    return null_safe_left(plain, quantiles(rows, "minutes", [0.5, 0.9], ["bin"]).toDF("bin", "median_delay", "p90_delay"), ["bin"])


def thunderstorms_by_month(df: DataFrame, month: str, thunderstorm: str, late: str) -> DataFrame:
    """(month, flights, thunderstorm_flights, share) of rows whose report is known."""
    sums = df.filter(F.col(thunderstorm).isNotNull()).groupBy(month).agg(F.count(late).alias("flights"), F.sum(thunderstorm).alias("thunderstorm_flights"))
    return sums.withColumn("share", ratio(F.col("thunderstorm_flights"), F.col("flights")) * 100)


def weather_band(category: Column) -> Column:
    """VFR, MVFR or IFR/LIFR; null for an unknown category."""
    return F.when(category.isin("VFR", "MVFR"), category).when(category.isin("IFR", "LIFR"), "IFR/LIFR")


def demand_by_weather(df: DataFrame, demand: str, category: str, late: str) -> DataFrame:
    """(demand, band, flights, delay_rate) of hourly demand against weather; rows without either are left out."""
    rows = df.select(cut(F.col(demand), *DEMAND, right=True).alias("demand"), weather_band(F.col(category)).alias("band"), F.col(late).alias("late")).filter("demand is not null and band is not null")
    return rows.groupBy("demand", "band").agg(F.count("late").alias("flights"), (F.avg(F.col("late").cast("double")) * 100).alias("delay_rate"))


def demand_matrix(cells: DataFrame) -> DataFrame:
    """The flights of ``demand_by_weather`` as one row for each demand and one column for each band, empty cells 0."""
    bands = ("VFR", "MVFR", "IFR/LIFR")
    return matrix(cells, "demand", "band", bands, F.sum("flights")).fillna(0, list(bands))
