"""Flight tables: monthly CSV in ZIP files to partitioned Parquet, and splits that read only their months."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators.contracts import require_columns
from skyledger.operators.target import TARGET_COLUMNS, build_target, eligible_rows
from skyledger.sources.archives import read_members

#: The columns that are kept, and the months (year, month) of each split.
KEEP = (
    "Year", "Quarter", "Month", "DayofMonth", "DayOfWeek", "FlightDate", "Reporting_Airline", "DOT_ID_Reporting_Airline", "Tail_Number", "Flight_Number_Reporting_Airline", "Origin",
    "OriginAirportSeqID", "OriginCityName", "OriginState", "Dest", "DestAirportSeqID", "DestCityName", "DestState", "CRSDepTime", "DepTime", "DepDelay", "DepDelayMinutes", "DepDel15",
    "DepTimeBlk", "TaxiOut", "WheelsOff", "WheelsOn", "TaxiIn", "CRSArrTime", "ArrTime", "ArrDelay", "ArrDelayMinutes", "ArrDel15", "ArrTimeBlk", "Cancelled", "CancellationCode", "Diverted",
    "DivAirportLandings", "DivReachedDest", "DivArrDelay", "CRSElapsedTime", "ActualElapsedTime", "AirTime", "Flights", "Distance", "DistanceGroup", "CarrierDelay", "WeatherDelay", "NASDelay",
    "SecurityDelay", "LateAircraftDelay",
)
SPLITS = {"train": ((2024, 1), (2024, 12)), "val": ((2025, 1), (2025, 12)), "test": ((2026, 1), (2026, 5)), "all": ((2024, 1), (2026, 5))}
_TEXT = {"Reporting_Airline", "Tail_Number", "Origin", "OriginCityName", "OriginState", "Dest", "DestCityName", "DestState", "DepTimeBlk", "ArrTimeBlk", "CancellationCode"}
_INT = {"Year", "Quarter", "Month", "DayofMonth", "DayOfWeek", "CRSDepTime", "CRSArrTime", "DistanceGroup"}
MONTH_KEYS = ("part_year", "part_month")
#: The folder of the finished months in a store; readers of Parquet pass over it.
MANIFEST = "_finished"
_LONG = {"DOT_ID_Reporting_Airline", "OriginAirportSeqID", "DestAirportSeqID"}


def typed(raw: DataFrame) -> DataFrame:
    """The kept columns of all-text rows with storage types; blank trailing columns go, missing ones raise. Text that is no number becomes null."""
    raw = require_columns(raw.select(*[F.col(f"`{c}`") for c in raw.columns if c.strip() and not c.startswith("_c")]), KEEP)
    kind = lambda c: "string" if c in _TEXT else "int" if c in _INT else "bigint" if c in _LONG else "date" if c == "FlightDate" else "float"
    cast = lambda c: F.nullif(F.trim(c), F.lit("")) if c in _TEXT else F.substring(F.trim(c), 1, 10).try_cast("date") if c == "FlightDate" else F.trim(c).try_cast("double").try_cast(kind(c)) if kind(c) in ("int", "bigint") else F.trim(c).try_cast(kind(c))
    return raw.select(*(cast(c).alias(c) for c in KEEP))


def read_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Plain CSV files with a header, every column as text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(list(paths))


def read_zips(spark: SparkSession, *paths: str) -> DataFrame:
    """Every CSV in the ZIP files, the kept columns as text; each is streamed from the store by a task of its own."""
    return read_members(spark, KEEP, *paths)


def _file_system(spark: SparkSession, path: str):
    """Hadoop's view of the store of ``path``, and how it makes paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _month_folders(spark: SparkSession, path: str) -> list[str]:
    """``part_year=.../part_month=...`` of the folders below ``path``; a few for each year, so the driver lists them."""
    files, make = _file_system(spark, path)
    if not files.exists(make(path)):
        return []
    years = [f.getPath().getName() for f in files.listStatus(make(path)) if f.getPath().getName().startswith(f"{MONTH_KEYS[0]}=")]
    return [f"{y}/{f.getPath().getName()}" for y in years for f in files.listStatus(make(f"{path}/{y}")) if f.getPath().getName().startswith(f"{MONTH_KEYS[1]}=")]


def finished_months(spark: SparkSession, path: str) -> list[str]:
    """Names of the months that were committed as a whole: those that the manifest, a folder of one empty file a month, holds."""
    return sorted(_month_folders(spark, f"{path}/{MANIFEST}"))


def months_present(spark: SparkSession, path: str) -> DataFrame | None:
    """(part_year, part_month) of the finished months below ``path``; None where there is none."""
    value = lambda part: None if part.endswith("__HIVE_DEFAULT_PARTITION__") else int(part.split("=")[1])
    rows = [tuple(map(value, name.split("/"))) for name in finished_months(spark, path)]
    return spark.createDataFrame(rows, "part_year int, part_month int") if rows else None


def write_months(flights: DataFrame, path: str, overwrite: bool = False) -> None:
    """Snappy Parquet by year and month. Months that are finished stay as they are and their incoming rows
    are left out; all other months are added. With ``overwrite`` the incoming months are replaced, and no others.

    All rows are written to a staging folder first. Then each month is moved into its place as a whole and entered in the
    manifest. A writer that is lost on the way leaves months out of the manifest: they are no part of the store,
    and the next writer puts whole ones in their place.
    """
    spark = flights.sparkSession
    rows = flights.withColumns({"part_year": F.col("Year"), "part_month": F.col("Month")})
    known = None if overwrite else months_present(spark, path)
    if known is not None:
        known = F.broadcast(known.toDF("known_year", "known_month"))  # one row a month
        rows = rows.join(known, F.col("part_year").eqNullSafe(F.col("known_year")) & F.col("part_month").eqNullSafe(F.col("known_month")), "left_anti")
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    files, make = _file_system(spark, path)
    try:
        rows.repartition(*MONTH_KEYS, F.pmod(F.xxhash64("Origin", "Dest"), F.lit(4))).write.partitionBy(*MONTH_KEYS).option("compression", "snappy").parquet(staging)
        for name in sorted(_month_folders(spark, staging)):
            files.delete(make(f"{path}/{MANIFEST}/{name}"), True)
            files.delete(make(f"{path}/{name}"), True)  # what an overwritten month or a lost writer has left
            files.mkdirs(make(f"{path}/{name}").getParent())
            if not files.rename(make(f"{staging}/{name}"), make(f"{path}/{name}")):
                raise OSError(f"could not move {name} into {path}")
            files.mkdirs(make(f"{path}/{MANIFEST}/{name}"))
    finally:
        files.delete(make(staging), True)


def read_months(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the finished months; what a lost writer has left is no part of them. A store without a manifest is read as it is."""
    done = finished_months(spark, path)
    rows = spark.read.parquet(path)
    if not done and not _month_folders(spark, path):
        return rows
    left = set(_month_folders(spark, path)) - set(done)
    if not left or not done:
        return rows
    value = lambda part: F.lit(None) if part.endswith("__HIVE_DEFAULT_PARTITION__") else F.lit(int(part.split("=")[1]))
    for name in sorted(left):
        y, m = map(value, name.split("/"))
        rows = rows.filter(~(F.col(MONTH_KEYS[0]).eqNullSafe(y) & F.col(MONTH_KEYS[1]).eqNullSafe(m)))
    return rows


def load_split(spark: SparkSession, path: str, split: str = "train", columns: Sequence[str] | None = None, model_only: bool = False) -> DataFrame:
    """Rows of a split with the target built; only its months and the asked columns are read."""
    if split not in SPLITS:
        raise ValueError(f"split is one of {', '.join(SPLITS)}")
    (y0, m0), (y1, m1) = SPLITS[split]
    month = F.col("part_year") * 12 + F.col("part_month")
    rows = read_months(spark, path)
    rows = rows.filter(F.col("part_year").between(y0, y1) & month.between(y0 * 12 + m0, y1 * 12 + m1))
    wanted = list(columns or [c for c in rows.columns if not c.startswith("part_")])
    read = list(dict.fromkeys([*wanted, *TARGET_COLUMNS]))
    out = build_target(require_columns(rows, read).select(*read))
    if model_only:
        out = eligible_rows(out)
    return out.select(*wanted, "target_recovered_from_diversion", "nonarrival_disruption", "model_eligible") if columns else out


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, bytes) of each Parquet file."""
    return read_months(spark, path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")).groupBy("file").agg(F.count("*").alias("rows"), F.max("bytes").alias("bytes"))
