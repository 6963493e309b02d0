"""Which polygon a point lies in: polygons are covered with grid cells, points are joined by cell, and only cells that a border
touches need the polygon's edges.

A polygon is a row (zone, rings), rings an array of closed or open lines of (lon, lat); a point is inside where a ray to the east
crosses the rings an odd number of times, so that holes are rings too and a border that two polygons share belongs to
one of them. Polygons do not cross the 180th meridian; cut them there, with a row for each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.sources.scratch import written

#: Degrees by which an edge reaches further than it is, lest rounding lose a cell that it touches.
SLACK = 1e-9


def edges(polygons: DataFrame, zone: str = "timezone", rings: str = "rings") -> DataFrame:
    """(polygon, zone, x1, y1, x2, y2): each ring's edges, the one that closes it too. Null rings, and those of fewer than three points, have none."""
    numbered = polygons.select(F.monotonically_increasing_id().alias("polygon"), F.col(zone).alias("zone"), F.col(rings).alias("rings"))
    named = numbered.select("polygon", "zone", F.explode("rings").alias("ring")).filter(F.size("ring") >= 3)
    pairs = F.transform("ring", lambda p, i: F.struct(p["lon"].alias("x1"), p["lat"].alias("y1"), F.col("ring")[(i + 1) % F.size("ring")]["lon"].alias("x2"), F.col("ring")[(i + 1) % F.size("ring")]["lat"].alias("y2")))
    out = named.select("polygon", "zone", F.explode(pairs).alias("e")).select("polygon", "zone", "e.*")
    return out.filter("x1 <> x2 or y1 <> y2")


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size)


def cover(lines: DataFrame, size: float) -> DataFrame:
    """(ix, iy, found): for each cell that a polygon of ``lines`` (as ``edges`` gives them) reaches, an array of (zone, inside, edges): all of the cell is inside,
    or the edges that a ray from the cell can cross.

    A row of cells is found from the edges in it: the cells that they touch, and from where they cross its middle the cells between.
    """
    low, high = F.least("y1", "y2") - SLACK, F.greatest("y1", "y2") + SLACK
    by_row = lines.withColumn("iy", F.explode(F.sequence(_cell(low, size), _cell(high, size))))
    at = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")))
    bottom, top = (F.least(F.greatest(y, F.least("y1", "y2")), F.greatest("y1", "y2")) for y in (F.col("iy") * size, (F.col("iy") + 1) * size))
    flat = F.col("y1") == F.col("y2")
    reach = [F.when(flat, F.col("x1")).otherwise(at(bottom)), F.when(flat, F.col("x2")).otherwise(at(top))]
    touched = by_row.withColumn("ix", F.explode(F.sequence(_cell(F.least(*reach) - SLACK, size), _cell(F.greatest(*reach) + SLACK, size))))
    border = touched.select("polygon", "zone", "ix", "iy").distinct()
    east = by_row.select("polygon", "iy", F.struct("x1", "y1", "x2", "y2").alias("edge"), F.greatest("x1", "x2").alias("far"))
    tested = border.join(east, ["polygon", "iy"]).filter(F.col("far") + SLACK >= F.col("ix") * size)
    tested = tested.groupBy("polygon", "zone", "ix", "iy").agg(F.collect_list("edge").alias("edges")).withColumn("inside", F.lit(False))
    middle = (F.col("iy") + 0.5) * size
    crossed = by_row.filter((F.col("y1") > middle) != (F.col("y2") > middle)).groupBy("polygon", "zone", "iy").agg(F.array_sort(F.collect_list(at(middle))).alias("xs"))
    spans = F.transform(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)), lambda i: F.struct(F.col("xs")[i].alias("a"), F.col("xs")[i + 1].alias("b")))
    spans = crossed.select("polygon", "zone", "iy", F.explode(spans).alias("s"))
    first, last = F.ceil(F.col("s.a") / size - 0.5), F.floor(F.col("s.b") / size - 0.5)
    whole = spans.filter(first <= last).select("polygon", "zone", "iy", F.explode(F.sequence(first, last)).alias("ix"))
    whole = whole.join(border.select("polygon", "ix", "iy"), ["polygon", "ix", "iy"], "left_anti")
    nothing = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    every = whole.select("ix", "iy", "zone", F.lit(True).alias("inside"), nothing.alias("edges")).unionByName(tested.select("ix", "iy", "zone", "inside", "edges"))
    return every.groupBy("ix", "iy").agg(F.collect_list(F.struct("zone", "inside", "edges")).alias("found"))


def inside(lon: Column, lat: Column, lines: Column) -> Column:
    """Whether a ray to the east crosses an odd number of ``lines`` (x1, y1, x2, y2)."""
    crosses = lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    return F.aggregate(lines, F.lit(0), lambda n, e: n + F.when(crosses(e), 1).otherwise(0)) % 2 == 1


def add_zone(points: DataFrame, polygons: DataFrame, lon: str = "Longitude", lat: str = "Latitude", zone: str = "timezone", rings: str = "rings", size: float = 1.0) -> DataFrame:
    """``points`` with ``zone``: of the polygons that hold the point, the least zone; null if none does or a coordinate is null or NaN.

    Points stay as many as they are. ``size`` is a cell's side in degrees: cells, and the edges kept for each border cell,
    grow with the polygons, not with the points.
    """
    if zone in points.columns:
        raise ValueError(f"column exists already: {zone}")
    x, y = (F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in (lon, lat))
    known = points.select("*", _cell(x, size).alias("__ix"), _cell(y, size).alias("__iy"))
    cells = cover(written(edges(polygons, zone, rings), "edges"), size).toDF("__ix", "__iy", "__found")
    holding = F.filter("__found", lambda c: c["inside"] | inside(x, y, c["edges"]))
    out = known.join(cells, ["__ix", "__iy"], "left").withColumn("__zone", F.array_min(F.transform(holding, lambda c: c["zone"])))
    return out.select(*(F.col(f"`{c}`") for c in points.columns), F.col("__zone").alias(zone))
