"""Hourly airport weather: cleaning, snapshots on an hourly grid, short history, and the join to flights."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import weather as W
from skyledger.functions.times import floor_hour, minutes_between
from skyledger.operators.contracts import ContractError, forbid_columns, require_columns, require_none, require_unique
from skyledger.operators.joins import dealt
from skyledger.operators.stats import keep_last
from skyledger.operators.windows import rolling, step_minutes

MAX_AGE_MINUTES = 90
#: Columns of the hourly table and of its joins to flights, in order.
HOURLY = (
    "airport", "hour", "observation_time_local", "snapshot_age_minutes", "weather_observation_missing", "visibility_sm", "ceiling_ft", "ceiling_unlimited", "flight_category",
    "wind_speed_kt", "wind_gust_kt", "precip_mm", "frozen_precip", "thunderstorm", "temp_c", "ifr_hours_past3", "precip_3h", "max_gust_3h",
)
ORIGIN_COLUMNS = ("visibility_sm", "ceiling_ft", "flight_category", "wind_speed_kt", "wind_gust_kt", "precip_mm", "frozen_precip", "thunderstorm", "temp_c", "ifr_hours_past3", "precip_3h", "max_gust_3h")
DEST_COLUMNS = ("flight_category", "wind_gust_kt", "frozen_precip", "thunderstorm")
META_COLUMNS = ("observation_time_local", "weather_observation_missing")


def clean_observations(raw: DataFrame) -> DataFrame:
    """Observations from all-text METAR rows with ``airport``; unreadable times go, of equal times the fullest stays last.

    Fewer than four sky layers are allowed; missing ones count as not reported.
    """
    require_columns(raw, ["airport", "valid", "tmpf", "vsby", "sknt", "gust", "p01i", "wxcodes"])
    layers = [i for i in (1, 2, 3, 4) if f"skyc{i}" in raw.columns and f"skyl{i}" in raw.columns]
    top = W.ceiling([F.col(f"skyc{i}") for i in layers], [W.number(F.col(f"skyl{i}")) for i in layers]) if layers else F.lit(None).cast("double")
    rows = raw.select(
        F.upper(F.trim("airport")).alias("airport"), F.trim("valid").try_cast("timestamp_ntz").alias("observation_time_local"), W.number(F.col("vsby")).alias("visibility_sm"), top.alias("ceiling_ft"),
        W.number(F.col("sknt")).alias("wind_speed_kt"), W.number(F.col("gust")).alias("wind_gust_kt"), W.precipitation(F.col("p01i")).alias("precip_mm"), W.has_frozen(F.col("wxcodes")).alias("frozen_precip"),
        W.has_thunderstorm(F.col("wxcodes")).alias("thunderstorm"), W.celsius(W.number(F.col("tmpf"))).alias("temp_c"),
    ).filter("observation_time_local is not null")
    rows = rows.withColumn("ceiling_unlimited", (F.col("ceiling_ft") == W.UNLIMITED).cast("tinyint"))
    return keep_last(rows, ["airport", "observation_time_local"], [c for c in rows.columns if c not in ("airport", "observation_time_local")])


def snapshots(observations: DataFrame, first: str, last: str, max_age_minutes: float = MAX_AGE_MINUTES) -> DataFrame:
    """One row for each airport and hour with the last observation not older than the limit; older: nulls, the row stays.

    An observation goes to the first hour that it can serve, and of each hour only the last one goes on (of equal times the
    greatest in the order of its columns), so that no airport has more rows than hours. Those and the airports are dealt
    out by airport once; hours are made behind that shuffle, and a window carries the last observation forward.
    """
    if max_age_minutes <= 0:
        raise ContractError("the age limit is positive")
    begin, end = (F.lit(x).cast("timestamp_ntz") for x in (first, last))
    step, values = F.lit(3_600_000_000), [c for c in observations.columns if c != "airport"]
    at = F.timestamp_diff("MICROSECOND", begin, F.col("observation_time_local").cast("timestamp_ntz"))  # since the first hour
    served = F.timestamp_add("MICROSECOND", F.greatest(at + F.pmod(-at, step), F.lit(0)), begin)
    known = observations.filter("airport is not null and observation_time_local is not null").select("airport", served.alias("hour"), F.struct(at.alias("at"), F.struct(*values).alias("row")).alias("__last"))
    latest = known.filter(F.col("hour") <= end).groupBy("airport", "hour").agg(F.max("__last").alias("__last"))
    both = dealt(latest.unionByName(observations.select("airport").distinct(), allowMissingColumns=True), ["airport"])
    hours = F.when(F.col("hour").isNotNull(), F.array("hour")).otherwise(F.sequence(begin, end, F.expr("interval 1 hour")))
    rows = both.select("airport", F.explode(hours).alias("hour"), "__last", F.col("hour").isNull().alias("__grid"))
    before = Window.partitionBy("airport").orderBy("hour", "__grid").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("__last", F.last("__last", ignorenulls=True).over(before)).filter("__grid")
    fits = F.timestamp_diff("MICROSECOND", begin, F.col("hour")) - F.col("__last.at") <= int(max_age_minutes * 60_000_000)
    out = found.select("airport", "hour", *(F.when(fits, F.col("__last.row")[v]).alias(v) for v in values))
    age = minutes_between(F.col("hour"), F.col("observation_time_local"))
    return out.withColumns({"snapshot_age_minutes": age, "weather_observation_missing": F.col("observation_time_local").isNull().cast("tinyint")})


def require_grid(hourly: DataFrame, hours: int, max_age_minutes: float = MAX_AGE_MINUTES) -> DataFrame:
    """Every airport has ``hours`` distinct hours and no observation from the future or too old."""
    age = F.col("snapshot_age_minutes")
    require_none(hourly, **{"key is null": F.col("airport").isNull() | F.col("hour").isNull(), "age out of range": (age < 0) | (age > max_age_minutes)})
    bad = hourly.groupBy("airport").agg(F.count("*").alias("n"), F.count_distinct("hour").alias("d")).filter((F.col("n") != hours) | (F.col("d") != hours))
    if not bad.isEmpty():
        raise ContractError("an airport has missing or repeated hours")
    return hourly


def add_history(hourly: DataFrame, window: int = 3, airport: str = "airport", hour: str = "hour", include_current: bool = True, checked: bool = True) -> DataFrame:
    """Adds IFR hours, precipitation and greatest gust of the last hours.

    Unknown categories count neither way; precipitation of an observation that an hour repeats counts once.
    """
    if window < 1:
        raise ContractError("a window has at least one hour")
    out = ("ifr_hours_past3", "precip_3h", "max_gust_3h")
    forbid_columns(require_columns(hourly, [airport, hour, "flight_category", "precip_mm", "wind_gust_kt", "observation_time_local"]), out)
    if checked:
        require_unique(require_none(hourly, **{"hour is null": F.col(hour).isNull()}), [airport, hour])
        require_none(hourly.withColumn("__step", step_minutes(hour, [airport])), **{"hours are not one apart": F.col("__step") != 60})
    key = ([airport], hour)
    low = F.when(F.col("flight_category").isNotNull(), F.col("flight_category").isin("IFR", "LIFR").cast("int"))
    again = F.col("observation_time_local").eqNullSafe(rolling(F.col("observation_time_local"), 1, *key, how="max", include_current=False)) & F.col("observation_time_local").isNotNull()
    fresh = hourly.withColumns({"__ifr": low, "__rain": F.when(~again, F.col("precip_mm"))})
    return fresh.withColumns({
        out[0]: rolling(F.col("__ifr"), window, *key, include_current=include_current).cast("tinyint"),
        out[1]: rolling(F.col("__rain"), window, *key, include_current=include_current),
        out[2]: rolling(F.col("wind_gust_kt"), window, *key, how="max", include_current=include_current),
    }).drop("__ifr", "__rain")


def build_hourly(raw: DataFrame, first: str, last: str, max_age_minutes: float = MAX_AGE_MINUTES) -> DataFrame:
    """Raw observations to the hourly table: cleaning, snapshots, categories, history, storage types, column order."""
    rows = snapshots(clean_observations(raw), first, last, max_age_minutes)
    rows = rows.withColumn("flight_category", W.flight_category(F.col("ceiling_ft"), F.col("visibility_sm")))
    rows = add_history(rows, checked=False)
    flag = ("frozen_precip", "thunderstorm")
    kinds = {c: "tinyint" for c in flag} | {c: "float" for c in ("snapshot_age_minutes", "visibility_sm", "ceiling_ft", "wind_speed_kt", "wind_gust_kt", "precip_mm", "temp_c", "precip_3h", "max_gust_3h")}
    return rows.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()}).select(*HOURLY)


def add_weather(flights: DataFrame, hourly: DataFrame, departure: str = "dep_time_local", join_destination: bool = True, dest_hour: str | None = "dest_departure_hour_local", dest_time: str | None = "dest_departure_time_local") -> DataFrame:
    """Weather at the origin in the departure hour and, on its own clock, at the destination.

    Each side also gets the time and age of its observation. The hourly table is dealt out, not broadcast: Spark
    takes its size from the airports that it is made of. An observation later than the departure
    raises. A destination join without a key on the destination's clock is refused; without its exact
    time the age counts to the end of the hour, with a warning.
    """
    if join_destination and not dest_hour:
        raise ContractError("the destination's weather needs its own clock")
    sides = [("origin", "Origin", ORIGIN_COLUMNS, "__hour", F.col(departure))]
    if join_destination:
        if dest_time is None:
            warnings.warn("without the destination's time its weather's age counts to the end of the hour", stacklevel=2)
        last_minute = F.col(dest_hour) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(59)) if dest_time is None else F.col(dest_time)
        sides.append(("dest", "Dest", DEST_COLUMNS, dest_hour, last_minute))
    require_columns(flights, ["Origin", departure, *(["Dest", dest_hour] if join_destination else [])])
    names = [n for p, _, cols, _, _ in sides for n in (*(f"{p}_{c}" for c in (*cols, *META_COLUMNS)), f"{p}_weather_age_minutes")]
    forbid_columns(flights, names)
    out = flights.withColumn("__hour", floor_hour(F.col(departure)))
    for p, port, cols, key, reference in sides:
        side = hourly.select(F.col("airport").alias("__port"), F.col("hour").alias("__at"), *(F.col(c).alias(f"{p}_{c}") for c in (*cols, *META_COLUMNS)))
        out = out.join(side.hint("merge"), (F.col(port) == F.col("__port")) & (F.col(key) == F.col("__at")), "left").drop("__port", "__at")
        age = minutes_between(reference, F.col(f"{p}_{META_COLUMNS[0]}"))
        safe = F.when(age < 0, F.raise_error(F.lit(f"{p} weather is later than the departure")).cast("double")).otherwise(age)
        out = out.withColumn(f"{p}_weather_age_minutes", safe.cast("float"))
    return out.select(*flights.columns, *names)


def null_rates(hourly: DataFrame, columns: Sequence[str] = HOURLY) -> DataFrame:
    """Share of nulls of each column, in one row."""
    return hourly.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
