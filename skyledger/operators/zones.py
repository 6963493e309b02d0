"""Airport time zones and departure times on the destination's clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.times import floor_hour, to_zone
from skyledger.operators.contracts import ContractError, forbid_columns, require_columns

#: Zone of most of a state, then the airports that keep another.
STATE_ZONES = {
    "AK": "America/Anchorage", "AL": "America/Chicago", "AR": "America/Chicago", "AS": "Pacific/Pago_Pago", "AZ": "America/Phoenix", "CA": "America/Los_Angeles", "CO": "America/Denver",
    "CT": "America/New_York", "DC": "America/New_York", "DE": "America/New_York", "FL": "America/New_York", "GA": "America/New_York", "GU": "Pacific/Guam", "HI": "Pacific/Honolulu",
    "IA": "America/Chicago", "ID": "America/Denver", "IL": "America/Chicago", "IN": "America/New_York", "KS": "America/Chicago", "KY": "America/New_York", "LA": "America/Chicago",
    "MA": "America/New_York", "MD": "America/New_York", "ME": "America/New_York", "MI": "America/New_York", "MN": "America/Chicago", "MO": "America/Chicago", "MP": "Pacific/Saipan",
    "MS": "America/Chicago", "MT": "America/Denver", "NC": "America/New_York", "ND": "America/Chicago", "NE": "America/Chicago", "NH": "America/New_York", "NJ": "America/New_York",
    "NM": "America/Denver", "NV": "America/Los_Angeles", "NY": "America/New_York", "OH": "America/New_York", "OK": "America/Chicago", "OR": "America/Los_Angeles", "PA": "America/New_York",
    "PR": "America/Puerto_Rico", "RI": "America/New_York", "SC": "America/New_York", "SD": "America/Chicago", "TN": "America/Chicago", "TT": "America/New_York", "TX": "America/Chicago",
    "UT": "America/Denver", "VA": "America/New_York", "VI": "America/St_Thomas", "VT": "America/New_York", "WA": "America/Los_Angeles", "WI": "America/Chicago", "WV": "America/New_York",
    "WY": "America/Denver",
}
AIRPORT_ZONES = {
    "BFF": "America/Denver", "CHA": "America/New_York", "DIK": "America/Denver", "ELP": "America/Denver", "LWS": "America/Los_Angeles", "PAH": "America/Chicago", "RAP": "America/Denver",
    "TRI": "America/New_York", "TYS": "America/New_York", "XWA": "America/Denver",
}


def _table(spark: SparkSession, zones: dict[str, str], key: str) -> DataFrame:
    return spark.createDataFrame(list(zones.items()), f"{key} string, __{key}_zone string")


def airport_zones(airports: DataFrame, airport: str = "Airport", state: str = "State") -> DataFrame:
    """``airports`` with ``timezone``; an airport's own entry goes before its state's, and an unknown state raises."""
    require_columns(airports, [airport, state])
    spark = airports.sparkSession
    own = _table(spark, AIRPORT_ZONES, "airport_").withColumnRenamed("airport_", airport)
    of_state = _table(spark, STATE_ZONES, "state_").withColumnRenamed("state_", state)
    out = airports.join(F.broadcast(own), airport, "left").join(F.broadcast(of_state), state, "left")
    out = out.select(*airports.columns, F.coalesce("__airport__zone", "__state__zone").alias("timezone"))
    if bad := out.filter("timezone is null").select(state).distinct().limit(5).collect():
        raise ContractError(f"no time zone for state {', '.join(str(r[0]) for r in bad)}")
    return out


def distinct_airports(flights: DataFrame) -> DataFrame:
    """(Airport, State) of all origins and destinations, one state each, the least."""
    sides = flights.select(F.col("Origin").alias("Airport"), F.col("OriginState").alias("State")).union(flights.select("Dest", "DestState"))
    return sides.groupBy("Airport").agg(F.min("State").alias("State"))


def add_destination_clock(flights: DataFrame, lookup: DataFrame, departure: str = "dep_time_local") -> DataFrame:
    """Adds departure time and hour on the destination's clock; ``lookup`` has (Airport, timezone), unique.

    Unknown zones and times shown twice by the origin's clock give null, and the row stays.
    """
    out = ("dest_departure_time_local", "dest_departure_hour_local")
    forbid_columns(require_columns(flights, ["Origin", "Dest", departure]), out)
    side = lambda key, name: F.broadcast(lookup.select(F.col("Airport").alias(key), F.col("timezone").alias(name)))  # noqa: E731  some hundred airports
    both = flights.join(side("Origin", "__o"), "Origin", "left").join(side("Dest", "__d"), "Dest", "left")
    there = F.when(F.col("__o").isNotNull() & F.col("__d").isNotNull(), to_zone(F.col(departure), F.col("__o"), F.col("__d")))
    return both.withColumn(out[0], there).withColumn(out[1], floor_hour(F.col(out[0]))).select(*flights.columns, *out)
