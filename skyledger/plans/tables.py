"""The test tables in the roles of flights and weather, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as flights: order date, market segment as carrier, nations as airports, returned as late, quantity as minutes."""
    line, orders, customer, supplier = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    rows = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
    return rows.select(
        F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderkey").alias("flight"), F.col("c_mktsegment").alias("carrier"), F.col("c_nationkey").alias("origin"), F.col("s_nationkey").alias("dest"),
        (F.col("l_returnflag") == "R").cast("int").alias("late"), F.col("l_quantity").alias("minutes"), F.col("l_discount").alias("c1"), F.col("l_tax").alias("c2"), F.col("o_orderstatus").alias("status"),
        F.col("l_linestatus").alias("line"), F.col("l_returnflag").alias("flag"), F.col("o_orderpriority").alias("priority"), F.col("l_extendedprice").alias("price"),
    )


#: ``flights`` as a common table expression ``f``.
FLIGHTS = """f AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey AS flight, c_mktsegment AS carrier, c_nationkey AS origin, s_nationkey AS dest,
  CAST(l_returnflag = 'R' AS INTEGER) AS late, l_quantity AS minutes, l_discount AS c1, l_tax AS c2, o_orderstatus AS status, l_linestatus AS line,
  l_returnflag AS flag, o_orderpriority AS priority, l_extendedprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``flights`` with the raw outcome columns of a flight, diversions among them."""
    rows = flights(spark, sf_dir)
    gone, away = F.col("status") == "P", (F.col("line") == "F") & (F.col("flag") == "A")
    normal = ~gone & ~away
    return rows.withColumns({
        "Cancelled": gone.cast("int"), "Diverted": away.cast("int"), "DivReachedDest": F.when(away & (F.col("c1") >= 0.05), 1).when(away & (F.col("c1") >= 0.02), 0),
        "DivArrDelay": F.when(away & (F.col("c2") > 0.01), F.col("minutes") - 20), "ArrDelay": F.when(normal, F.col("minutes") - 30), "ArrDelayMinutes": F.when(normal, F.greatest(F.col("minutes") - 30, F.lit(0.0))),
        "ArrDel15": F.when(normal, (F.col("minutes") - 30 >= 15).cast("int")), "CancellationCode": F.when(gone, F.substring("priority", 1, 1)), "key": F.concat_ws(":", "flight", "price", "minutes"),
    })


OUTCOMES = """o AS (SELECT *, CAST(gone AS INTEGER) AS Cancelled, CAST(away AS INTEGER) AS Diverted, CASE WHEN away AND c1 >= 0.05 THEN 1 WHEN away AND c1 >= 0.02 THEN 0 END AS DivReachedDest,
  CASE WHEN away AND c2 > 0.01 THEN minutes - 20 END AS DivArrDelay, CASE WHEN NOT gone AND NOT away THEN minutes - 30 END AS ArrDelay0,
  CASE WHEN gone THEN substr(priority, 1, 1) END AS CancellationCode FROM (SELECT *, status = 'P' AS gone, line = 'F' AND flag = 'A' AS away FROM f)),
t AS (SELECT *, recovered OR (NOT gone AND NOT away) AS known, CASE WHEN recovered THEN DivArrDelay ELSE ArrDelay0 END AS ArrDelay,
  greatest(CASE WHEN recovered THEN DivArrDelay ELSE ArrDelay0 END, 0.0) AS mins0,
  gone OR (away AND (DivReachedDest IS NULL OR DivReachedDest <> 1)) AS nonarrival
  FROM (SELECT *, away AND coalesce(DivReachedDest = 1, false) AND DivArrDelay IS NOT NULL AS recovered FROM o)),
tt AS (SELECT *, CASE WHEN known THEN mins0 END AS ArrDelayMinutes, CASE WHEN known THEN CAST(ArrDelay >= 15 AS INTEGER) END AS ArrDel15 FROM t),
x AS (SELECT *, NOT nonarrival AND ArrDel15 IS NOT NULL AS eligible FROM tt)"""


def outcome_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outcomes of a short period: date, type group, error or not."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("date").alias("d"), (F.col("user_id") % 10).cast("int").alias("grp"), (F.col("event_type") == "error").cast("int").alias("late"))


OUTCOME_DAYS = "e AS (SELECT event_id AS id, CAST(ts AS DATE) AS d, CAST(user_id % 10 AS INTEGER) AS grp, CAST(event_type = 'error' AS INTEGER) AS late FROM events)"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as weather: user as airport, one observation a time, value as gust and rain, ceiling and visibility by rule."""
    e = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("airport"), F.col("ts").alias("observation_time_local")).agg(F.max("value").alias("wind_gust_kt"), F.max("event_type").alias("code"))
    return e.withColumns({"precip_mm": F.col("wind_gust_kt") / 4, "ceiling_ft": F.col("wind_gust_kt") * 40, "visibility_sm": F.col("wind_gust_kt") / 12})


OBSERVATIONS = """ob AS (SELECT user_id AS airport, ts AS observation_time_local, max(value) AS wind_gust_kt, max(event_type) AS code, max(value) / 4 AS precip_mm,
  max(value) * 40 AS ceiling_ft, max(value) / 12 AS visibility_sm FROM events GROUP BY user_id, ts)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored rows: error as label, value / (value + 50) as score."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("period"), (F.col("event_type") == "error").cast("int").alias("y"), F.round(F.col("value") / (F.col("value") + 50), 3).alias("p"))


SCORED = "s AS (SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS period, CAST(event_type = 'error' AS INTEGER) AS y, round(value / (value + 50), 3) AS p FROM events)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since sums of doubles depend on order."""
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.round(F.col(c).cast("double"), 4).alias(c) if k == "float" else F.col(c) for c, k in df.dtypes))
