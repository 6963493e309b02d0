"""Queries of sources and sinks: test tables are written as the files that a source reads, and read back through it."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import contracts, model, prepare, weather, zones
from skyledger.plans.registry import register
from skyledger.plans.tables import read, rounded
from skyledger.sources import flights, lookups, sinks
from skyledger.sources.archives import write_archives
from skyledger.sources.scratch import new_path, written

#: Orders as raw flights, 29 years later, so that some years are those of the splits.
_RAW = """WITH r AS (SELECT o_orderkey AS k, CAST(year(o_orderdate) + 29 AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, substr(o_orderpriority, 1, 1) AS origin, CAST(o_orderkey % 40 AS INTEGER) - 10 AS late,
  o_orderkey % 9 = 0 AS gone, o_orderkey % 11 = 0 AND o_orderkey % 9 <> 0 AS away FROM orders) """


def _text_rows(spark, d):
    """All-text rows with the kept columns, a foreign one and blanks for missing values."""
    k = F.col("o_orderkey")
    gone, away = k % 9 == 0, (k % 11 == 0) & (k % 9 != 0)
    late = (k % 40) - 10
    made = {
        "Year": F.year("o_orderdate") + 29, "Month": F.month("o_orderdate"), "FlightDate": F.date_format(F.add_months("o_orderdate", 29 * 12), "yyyy-MM-dd"), "Origin": F.substring("o_orderpriority", 1, 1), "Dest": F.col("o_orderstatus"),
        "Reporting_Airline": F.lit("AA"), "Cancelled": F.when(gone, "1.00").otherwise("0.00"), "Diverted": F.when(away, "1.00").otherwise("0.00"), "ArrDelay": F.when(~gone & ~away, F.concat(late.cast("string"), F.lit(".00"))),
        "ArrDelayMinutes": F.when(~gone & ~away, F.greatest(late, F.lit(0)).cast("string")), "ArrDel15": F.when(~gone & ~away, (late >= 15).cast("int").cast("string")), "DivReachedDest": F.when(away, "1.00"), "DivArrDelay": F.when(away, late.cast("string")),
    }
    return read(spark, d, "orders").select(*(F.coalesce(made[c].cast("string"), F.lit("")).alias(c) if c in made else F.lit("").alias(c) for c in flights.KEEP), F.lit("x").alias("Extra"))


def _typed(spark, d):
    path = new_path(spark, "raw")
    _text_rows(spark, d).write.option("header", True).option("emptyValue", "").csv(path)
    return flights.typed(flights.read_csv(spark, path))


def _months(spark, d):
    path = new_path(spark, "months")
    flights.write_months(_typed(spark, d), path)
    return path


@register("s3_s4_typed_csv", _RAW + "SELECT y AS \"Year\", m AS \"Month\", count(*) AS rows, count(CASE WHEN NOT gone AND NOT away THEN late END) AS known, CAST(sum(CASE WHEN NOT gone AND NOT away THEN late END) AS DOUBLE) AS minutes, CAST(51 AS INTEGER) AS columns FROM r GROUP BY ALL")
def _(spark, d):
    rows = _typed(spark, d)
    return rows.groupBy("Year", "Month").agg(F.count("*").alias("rows"), F.count("ArrDelay").alias("known"), F.sum("ArrDelay").cast("double").alias("minutes"), F.lit(len(rows.columns)).alias("columns"))


@register("s2_zip_members", _RAW + "SELECT y AS \"Year\", m AS \"Month\", count(*) AS rows, count(CASE WHEN NOT gone AND NOT away THEN late END) AS known, CAST(sum(CASE WHEN NOT gone AND NOT away THEN late END) AS DOUBLE) AS minutes FROM r GROUP BY ALL")
def _(spark, d):
    """Archives of a year with a member for each month are written from the table and read member by member."""
    rows = _text_rows(spark, d)
    made = written(write_archives(rows.withColumns({"archive": F.col("Year"), "member": F.concat_ws("-", "Year", "Month")}), new_path(spark, "zips"), "archive", "member"), "archives")
    back = flights.typed(flights.read_zips(spark, *(r.path for r in made.collect())))
    return back.groupBy("Year", "Month").agg(F.count("*").alias("rows"), F.count("ArrDelay").alias("known"), F.sum("ArrDelay").cast("double").alias("minutes"))


@register("s5_s15_months_added", _RAW + "SELECT y AS part_year, m AS part_month, count(*) AS rows FROM r GROUP BY ALL")
def _(spark, d):
    """The second write brings all months: those of the first stay as they are, others are added."""
    path, rows = new_path(spark, "months"), _typed(spark, d)
    flights.write_months(rows.filter("Month <= 6 or Year = 2025"), path)
    flights.write_months(rows, path)
    return spark.read.parquet(path).groupBy("part_year", "part_month").agg(F.count("*").alias("rows"))


_SPLIT = _RAW + """, t AS (SELECT *, away AS recovered, gone AS nonarrival, CASE WHEN NOT gone THEN CAST(late >= 15 AS INTEGER) END AS hit FROM r WHERE {months})
  SELECT origin AS "Origin", count(*) AS rows, count(*) FILTER (recovered) AS recovered, count(*) FILTER (nonarrival) AS nonarrival, CAST(sum(hit) AS BIGINT) AS late FROM t {where} GROUP BY origin"""


def _split(spark, d, split, model_only):
    rows = flights.load_split(spark, _months(spark, d), split, ["Origin", "ArrDel15"], model_only)
    return rows.groupBy("Origin").agg(F.count("*").alias("rows"), F.count_if("target_recovered_from_diversion").alias("recovered"), F.count_if("nonarrival_disruption").alias("nonarrival"), F.sum("ArrDel15").cast("long").alias("late"))


@register("s6_s7_p12_d3_split_all", _SPLIT.format(months="y IN (2024, 2025) OR (y = 2026 AND m <= 5)", where=""))
def _(spark, d):
    return _split(spark, d, "all", False)


@register("s7_d3_split_train_eligible", _SPLIT.format(months="y = 2024", where="WHERE NOT nonarrival"))
def _(spark, d):
    return _split(spark, d, "train", True)


@register("s17_q1_inventory", _RAW + "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(min(y * 12 + m) AS INTEGER) AS first_month, CAST(max(y * 12 + m) AS INTEGER) AS last_month, true AS sizes_known FROM r")
def _(spark, d):
    path = _months(spark, d)
    files = flights.inventory(spark, path).agg(F.sum("rows").alias("rows"), F.min(F.col("bytes") > 0).alias("sizes_known"))
    month = F.col("part_year") * 12 + F.col("part_month")
    ends = flights.months_present(spark, path).agg(F.min(month).alias("first_month"), F.max(month).alias("last_month"))
    return files.join(F.broadcast(ends)).select("rows", "first_month", "last_month", "sizes_known")  # one row each


@register("s8_f9_f11_f12_metar_text", """WITH r AS (SELECT DISTINCT ON (user_id % 50, ts) CAST(user_id % 50 AS INTEGER) AS a, ts, event_id AS n FROM events ORDER BY user_id % 50, ts, event_id DESC)
  SELECT 'K' || a AS airport, count(*) AS rows, count(CASE WHEN n % 3 <> 0 THEN n END) AS warm, round(sum(CASE WHEN n % 3 <> 0 THEN (n % 90 - 32) * 5 / 9.0 END), 4) AS celsius, round(sum(CASE WHEN n % 4 = 0 THEN 0 WHEN n % 4 = 1 THEN (n % 7) / 10.0 * 25.4 END), 4) AS rain_mm,
  count(*) FILTER (n % 5 = 0) AS thunder, count(*) FILTER (n % 5 = 1) AS frozen FROM r GROUP BY a""")
def _(spark, d):
    n = F.col("event_id")
    e = read(spark, d, "events").groupBy((F.col("user_id") % 50).alias("a"), "ts").agg(F.max("event_id").alias("event_id"))
    text = e.select(
        F.concat(F.lit(" k"), F.col("a").cast("string")).alias("station"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("valid"), F.when(n % 3 == 0, "M").otherwise((n % 90).cast("string")).alias("tmpf"), F.lit("10").alias("vsby"), F.lit("abc").alias("sknt"),
        F.lit("M").alias("gust"), F.lit("CLR").alias("skyc1"), *(F.lit("M").alias(c) for c in ("skyl1", "skyc2", "skyl2", "skyc3", "skyl3")), F.when(n % 5 == 0, "+tsra").when(n % 5 == 1, "-SN").otherwise("M").alias("wxcodes"),
        F.when(n % 4 == 0, " t").when(n % 4 == 1, F.concat(F.lit("0."), (n % 7).cast("string"))).otherwise("M").alias("p01i"),
    )
    path = new_path(spark, "metar")
    text.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    rows = weather.clean_observations(lookups.read_metar(spark, path).withColumn("airport", F.col("station")))
    out = rows.groupBy("airport").agg(F.count("*").alias("rows"), F.count("temp_c").alias("warm"), F.sum("temp_c").alias("celsius"), F.sum("precip_mm").alias("rain_mm"), F.count_if("thunderstorm").alias("thunder"), F.count_if("frozen_precip").alias("frozen"))
    return rounded(out, 4)


@register("s10_read_coordinates", 'SELECT upper(n_name) AS "Airport", CAST(n_nationkey + CASE WHEN n_nationkey % 3 = 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS "Latitude", CAST(n_regionkey * 10 AS DOUBLE) AS "Longitude" FROM nation')
def _(spark, d):
    path = new_path(spark, "coordinates")
    rows = read(spark, d, "nation").select(F.lower("n_name").alias("iata"), F.col("n_nationkey").cast("double").alias("latitude_deg"), (F.col("n_regionkey") * 10).alias("lng"))
    again = rows.filter("latitude_deg % 3 = 0").withColumn("latitude_deg", F.col("latitude_deg") + 0.5)  # every third airport has another row behind its first
    rows.unionByName(again).coalesce(1).write.option("header", True).csv(path)
    return lookups.read_coordinates(spark, path)


@register("s11_literal_rows", "SELECT r_name, v.code, CAST(v.n AS DOUBLE) AS n FROM region JOIN (VALUES (0, 'AF', 1.5), (1, 'AM', 2.0), (3, 'EU', NULL)) v(k, code, n) ON r_regionkey = v.k")
def _(spark, d):
    rows = lookups.read_tsv(spark, "k\tcode\tn\n0\tAF\t1.5\n1\tAM\t2\n3\tEU\t", "k int, code string, n double")
    return read(spark, d, "region").join(rows, F.col("r_regionkey") == F.col("k")).select("r_name", "code", "n")


@register("s12_s13_written_and_read", "WITH t AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders ORDER BY abs(o_totalprice) DESC, o_orderkey LIMIT 20) SELECT CAST(k AS VARCHAR) AS k, round(v, 4) AS v, (SELECT count(*) FROM orders) AS rows FROM t")
def _(spark, d):
    orders, path = read(spark, d, "orders"), new_path(spark, "report")
    sinks.write_csv(sinks.largest_first(orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")), "v", "k", 20), f"{path}/csv")
    sinks.write_json(spark, {"rows": orders.count()}, f"{path}/json")
    kept = sinks.read_json(spark, f"{path}/json")
    return spark.read.option("header", True).csv(f"{path}/csv").select("k", F.round(F.col("v").cast("double"), 4).alias("v"), F.lit(kept["rows"]).cast("long").alias("rows"))


@register("f16_x1_airport_zones", """WITH a AS (SELECT DISTINCT CASE WHEN c_custkey % 7 = 0 THEN 'ELP' ELSE 'X' || c_nationkey END AS port, CASE WHEN c_custkey % 7 = 0 THEN 'TX' ELSE (['NY', 'TX', 'AZ', 'TT', 'HI', 'PR', 'AK'])[c_nationkey % 7 + 1] END AS state FROM customer)
  SELECT port AS "Airport", state AS "State", CASE WHEN port = 'ELP' THEN 'America/Denver' ELSE CASE state WHEN 'NY' THEN 'America/New_York' WHEN 'TT' THEN 'America/New_York' WHEN 'TX' THEN 'America/Chicago' WHEN 'AZ' THEN 'America/Phoenix' WHEN 'HI' THEN 'Pacific/Honolulu'
  WHEN 'PR' THEN 'America/Puerto_Rico' WHEN 'AK' THEN 'America/Anchorage' END END AS timezone FROM a""")
def _(spark, d):
    own = F.col("c_custkey") % 7 == 0
    states = F.array(*map(F.lit, ("NY", "TX", "AZ", "TT", "HI", "PR", "AK")))
    ports = read(spark, d, "customer").select(F.when(own, "ELP").otherwise(F.concat(F.lit("X"), F.col("c_nationkey").cast("string"))).alias("Airport"), F.when(own, "TX").otherwise(F.element_at(states, (F.col("c_nationkey") % 7 + 1).cast("int"))).alias("State"))
    return zones.airport_zones(ports.distinct())


@register("p5_p13_p14_j23_m5_guards", "SELECT * FROM (VALUES ('output exists', true), ('output is new', false), ('leak', true), ('no leak', false), ('features differ', true), ('features agree', false), ('right side repeats', true), ('right side is unique', false), ('test period closed', true), ('test period open', false)) t(guard, raised)")
def _(spark, d):
    """Which guards raise: each is met once where it has to and once where it must not."""
    nation, customer = read(spark, d, "nation"), read(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    tries = {
        "output exists": lambda: contracts.forbid_columns(nation, ["n_name"]), "output is new": lambda: contracts.forbid_columns(nation, ["new"]), "leak": lambda: contracts.forbid_leakage(["Origin", "ArrDelay"], model.OUTCOMES),
        "no leak": lambda: contracts.forbid_leakage(model.feature_list(), model.OUTCOMES), "features differ": lambda: contracts.require_same_features(["b", "a"], ["a", "b"]), "features agree": lambda: contracts.require_same_features(["a", "b"], ["a", "b"]),
        "right side repeats": lambda: contracts.many_to_one(nation, customer, ["n_nationkey"]), "right side is unique": lambda: contracts.many_to_one(customer, nation, ["n_nationkey"]),
        "test period closed": lambda: prepare.FrozenSpec((), 1, 0.2).require_open(), "test period open": lambda: prepare.FrozenSpec((), 1, 0.2, allow_test=True).require_open(),
    }

    def raised(check) -> bool:
        try:
            check()
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(name, raised(check)) for name, check in tries.items()], "guard string, raised boolean")
