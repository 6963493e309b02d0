"""Small sources: weather observations as text, airport coordinates, literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators.contracts import require_none
from skyledger.operators.stats import keep_last

#: Header names of coordinates that are understood, and texts that mean missing.
ALIASES = {
    "Airport": ("Airport", "airport", "iata_code", "IATA", "iata"),
    "Latitude": ("Latitude", "latitude", "latitude_deg", "lat"),
    "Longitude": ("Longitude", "longitude", "longitude_deg", "lon", "lng"),
}
MISSING = ("M", "", "NA", "N/A", "NaN", "nan", "null", "NULL", "None")
_METAR = "station valid tmpf vsby sknt gust skyc1 skyl1 skyc2 skyl2 skyc3 skyl3 wxcodes p01i".split()


def read_metar(spark: SparkSession, *paths: str) -> DataFrame:
    """All-text observations of CSV files named after their airport; comment lines and missing marks are understood."""
    schema = ", ".join(f"{c} string" for c in _METAR)
    rows = spark.read.schema(schema).option("header", True).option("comment", "#").option("enforceSchema", False).csv(list(paths))
    known = [F.when(~F.trim(c).isin(*MISSING), F.col(c)).alias(c) for c in _METAR]
    return rows.select(F.upper(F.regexp_extract("_metadata.file_name", r"([^/]+)\.csv$", 1)).alias("airport"), *known)


def read_coordinates(spark: SparkSession, *paths: str) -> DataFrame:
    """``airport_coordinates`` of CSV files with a header; of several rows of an airport the last one of the last file by name counts."""
    rows = spark.read.option("header", True).csv(list(paths))
    return airport_coordinates(rows, F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())


def airport_coordinates(raw: DataFrame, *order: Column) -> DataFrame:
    """(Airport, Latitude, Longitude) from text rows with any of the known headers; out-of-range values raise.

    Of several rows of an airport the last by ``order`` counts, equal ones by their values; without an order
    that of the greatest values.
    """
    standard = {alias.lower(): name for name, aliases in ALIASES.items() for alias in aliases}
    headers: dict[str, list[str]] = {name: [] for name in ALIASES}
    for header in raw.columns:
        if (name := standard.get(header.lower())) is not None:
            headers[name].append(header)
    if absent := [name for name, found in headers.items() if not found]:
        raise KeyError(f"no column for {', '.join(absent)}")
    rank = {name: [a.lower() for a in aliases] for name, aliases in ALIASES.items()}  # of several headers for one name the first known counts
    text = lambda name: F.col(f"`{min(headers[name], key=lambda h: rank[name].index(h.lower()))}`").cast("string")
    place = F.struct(*order) if order else F.lit(None)
    rows = raw.select(F.upper(F.trim(text("Airport"))).alias("Airport"), *(text(c).try_cast("double").alias(c) for c in ("Latitude", "Longitude")), place.alias("__place"))
    rows = rows.filter("Airport <> '' and Latitude is not null and Longitude is not null")
    rows = keep_last(rows, ["Airport"], ["__place", "Latitude", "Longitude"]).drop("__place")
    return require_none(rows, **{"coordinates out of range": (F.abs("Latitude") > 90) | (F.abs("Longitude") > 180)})


def read_tsv(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """A literal tab-separated table with a header line."""
    lines = spark.createDataFrame([(line,) for line in text.strip().splitlines()[1:]], "value string")
    return lines.select(F.from_csv("value", F.lit(schema), {"sep": "\t"}).alias("r")).select("r.*")
