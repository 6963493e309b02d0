"""Streaming twin of the hourly snapshots: keyed state with event-time timers."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skyledger.operators.contracts import ContractError, forbid_columns, require_columns
from skyledger.operators.weather import MAX_AGE_MINUTES

_HOUR = 3_600_000_000


def micros(c) -> F.Column:
    """A local time as microseconds since 1970, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def streaming_snapshots(stream: DataFrame, first: str, last: str | None = None, max_age_minutes: float = MAX_AGE_MINUTES, lateness: str = "2 hours", airport: str = "airport", time: str = "observation_time_local") -> DataFrame:
    """As ``weather.snapshots``: for each airport and hour from ``first`` on the last observation not older than the limit.

    An hour is emitted, once, when the watermark (the latest observation less ``lateness``) has passed it; then no
    row can change it. The state of an airport is the next hour and the observations that a coming hour can still need: the
    last one before it and those after. Rows may come late within ``lateness`` and repeated; of rows at the same
    time the greatest counts, in whatever order they come. Rows with a null airport or time are left out. Hours after the final watermark come when the
    stream goes on; ``last`` ends the grid. Append mode.
    """
    if max_age_minutes <= 0:
        raise ContractError("the age limit is positive")
    forbid_columns(require_columns(stream, [airport, time]), ["hour", "snapshot_age_minutes", "weather_observation_missing"])
    values = [c for c in stream.columns if c not in (airport, time)]
    start, end, span = _micros_of(first), None if last is None else _micros_of(last), int(max_age_minutes * 60_000_000)
    rows = stream.filter(F.col(airport).isNotNull() & F.col(time).isNotNull())
    rows = rows.select(F.col(airport).alias("airport"), micros(F.col(time)).alias("__at"), F.timestamp_micros(micros(F.col(time))).alias("__ts"), *values).withWatermark("__ts", lateness)
    kinds = [stream.schema[c] for c in values]
    out = T.StructType([T.StructField("airport", stream.schema[airport].dataType), T.StructField("__hour", T.LongType()), T.StructField("__at", T.LongType()), *(T.StructField(k.name, k.dataType) for k in kinds)])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hour, held = pickle.loads(state.get[0]) if state.exists else (start, [])
        for pdf in batches:
            made = pdf[["__at", *values]].astype(object)
            held += list(made.where(made.notna(), None).itertuples(index=False, name=None))
        passed = state.getCurrentWatermarkMs() * 1000  # rows before it are late and dropped
        held = sorted(set(held), key=lambda r: (r[0], tuple((v is not None, v if v is not None else 0) for v in r[1:])))
        found, at = [], 0
        while hour < passed and (end is None or hour <= end):
            while at < len(held) and held[at][0] <= hour:
                at += 1
            row = held[at - 1] if at and hour - held[at - 1][0] <= span else (None,) * (len(values) + 1)
            found.append((*key, hour, *row))
            hour += _HOUR
        held = held[max(at - 1, 0) :]
        if end is not None and hour > end:
            held = []
        state.update((pickle.dumps((hour, held)),))
        if end is None or hour <= end:
            state.setTimeoutTimestamp(max(hour // 1000 + 1, passed // 1000 + 1))
        if found:
            yield pd.DataFrame(found, columns=[f.name for f in out]).astype({"__hour": "Int64", "__at": "Int64"})

    made = rows.groupBy("airport").applyInPandasWithState(step, out, "state binary", "append", GroupStateTimeout.EventTimeTimeout)
    local = lambda c: F.timestamp_add("MICROSECOND", F.col(c), F.lit("1970-01-01").cast("timestamp_ntz"))
    age = (F.col("__hour") - F.col("__at")) / 60_000_000.0
    return made.select(
        F.col("airport").alias(airport), local("__hour").alias("hour"), local("__at").alias(time), *values,
        age.alias("snapshot_age_minutes"), F.col("__at").isNull().cast("tinyint").alias("weather_observation_missing"),
    )


def _micros_of(hour: str) -> int:
    at = pd.Timestamp(hour)
    if at != at.floor("h"):
        raise ContractError(f"no full hour: {hour}")
    return at.value // 1000
