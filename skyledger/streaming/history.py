"""Streaming twin of the expanding rates: counts by day from the rows, a state by group that closes months, rates from the closings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skyledger.functions.stats import ratio, smoothed
from skyledger.functions.times import month_start
from skyledger.operators.history import DEFAULT_SPECS, RateSpec
from skyledger.streaming.snapshots import micros

#: The group of all rows.
ALL = "*"


def _key(spec: RateSpec) -> F.Column:
    """The group's columns as one text; null is a value of its own."""
    return F.to_json(F.array(*(F.col(c).cast("string") for c in spec.columns)))


def daily_group_counts(stream: DataFrame, specs: Sequence[RateSpec] = DEFAULT_SPECS, date_col: str = "FlightDate", target: str = "ArrDel15", lateness: str = "3 days") -> DataFrame:
    """(spec, key, date, p, n): positives and rows of every group and day, and of all rows under ``ALL``, when the watermark has passed
    the day. Sums are made before the shuffle, so that a group with a third of all rows is no task's own. Append mode."""
    groups = F.array(F.struct(F.lit(ALL).alias("spec"), F.lit("").alias("key")), *(F.struct(F.lit(s.name).alias("spec"), _key(s).alias("key")) for s in specs))
    rows = stream.filter(F.col(date_col).isNotNull()).select(F.timestamp_micros(micros(F.col(date_col))).alias("__ts"), F.col(target).cast("long").alias("p"), F.explode(groups).alias("g"))
    days = rows.withWatermark("__ts", lateness).groupBy("g.spec", "g.key", F.window("__ts", "1 day")).agg(F.sum("p").alias("p"), F.count("*").alias("n"))
    return days.select("spec", "key", F.date_from_unix_date(F.floor(F.unix_seconds("window.start") / 86400).cast("int")).alias("date"), "p", "n")


def month_closings(daily: DataFrame, lateness: str = "0 days") -> DataFrame:
    """(spec, key, month, p, n): how a group stands from ``month`` on, the sums of all months before it; a row whenever a month with rows ends.

    ``daily`` is a stream of ``daily_group_counts``. A group's state is what is closed and the sums of its open months; a timer at the
    end of the first open month closes it once the watermark is there. Append mode.
    """
    rows = daily.select("spec", "key", F.unix_date(month_start(F.col("date"))).alias("month"), F.unix_date(F.add_months(month_start(F.col("date")), 1).cast("date")).alias("next"), "p", "n", F.timestamp_micros(micros(F.col("date"))).alias("__ts"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p, n, months, nexts, ps, ns = state.get if state.exists else (0, 0, [], [], [], [])
        open_ = {m: [e, a, b] for m, e, a, b in zip(months, nexts, ps, ns)}
        for pdf in batches:
            for m, e, a, b in pdf.groupby(["month", "next"])[["p", "n"]].sum().reset_index().itertuples(index=False):
                row = open_.setdefault(int(m), [int(e), 0, 0])
                row[1] += int(a)
                row[2] += int(b)
        passed, out = state.getCurrentWatermarkMs() / 86_400_000, []
        for m in sorted(open_):
            if open_[m][0] > passed:
                break
            end, a, b = open_.pop(m)
            p, n = p + a, n + b
            out.append((*key, end, p, n))
        rest = sorted(open_)
        state.update((p, n, rest, *([open_[m][i] for m in rest] for i in range(3))))
        if rest:
            state.setTimeoutTimestamp(max(open_[rest[0]][0] * 86_400_000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["spec", "key", "day", "p", "n"])

    kept = "p long, n long, months array<long>, nexts array<long>, ps array<long>, ns array<long>"
    made = rows.withWatermark("__ts", lateness).groupBy("spec", "key").applyInPandasWithState(step, "spec string, key string, day long, p long, n long", kept, "append", GroupStateTimeout.EventTimeTimeout)
    return made.select("spec", "key", F.date_from_unix_date(F.col("day").cast("int")).alias("month"), "p", "n")


def with_closed_rates(rows: DataFrame, closings: DataFrame, specs: Sequence[RateSpec] = DEFAULT_SPECS, date_col: str = "FlightDate", initial_prior: float = 0.20) -> DataFrame:
    """``rows`` with the rates and counts that ``history.add_expanding_rates`` gives, from finished ``closings`` (a table).

    A closing holds from its month to the group's next one, so rows are joined on group and month by the span that it holds.
    """
    until = F.lead("month").over(Window.partitionBy("spec", "key").orderBy("month"))  # a row a month
    spans = closings.withColumn("until", F.coalesce(until, F.lit("9999-12-31").cast("date")))
    month = month_start(F.col(date_col)).cast("date")
    out = rows.withColumn("__month", month)
    months = out.select("__month").distinct()
    whole = months.join(spans.filter(F.col("spec") == ALL), (F.col("__month") >= F.col("month")) & (F.col("__month") < F.col("until")), "left")
    prior = whole.select("__month", F.coalesce(ratio(F.col("p"), F.col("n")), F.lit(initial_prior)).alias("__prior"))
    out = out.join(F.broadcast(prior), out["__month"].eqNullSafe(prior["__month"]), "left").drop(prior["__month"])  # one row a month
    for s in specs:
        own = spans.filter(F.col("spec") == s.name).select(F.col("key").alias("__key"), F.col("month").alias("__from"), F.col("until").alias("__until"), F.col("p").alias("__p"), F.col("n").alias("__n"))
        out = out.withColumn("__own", _key(s)).join(own, (F.col("__own") == F.col("__key")) & (F.col("__month") >= F.col("__from")) & (F.col("__month") < F.col("__until")), "left")
        rate, log_count = s.outputs
        p, n = (F.coalesce(F.col(c), F.lit(0)) for c in ("__p", "__n"))
        out = out.withColumns({rate: smoothed(p, n, F.col("__prior"), s.strength).cast("float"), log_count: F.log1p(n).cast("float")}).drop("__own", "__key", "__from", "__until", "__p", "__n")
    return out.drop("__month", "__prior")
