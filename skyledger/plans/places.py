"""Queries of points in polygons and of clocks by transition intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import polygons
from skyledger.plans.registry import register
from skyledger.plans.tables import read

#: A concave polygon with a hole, a neighbour that shares its eastern border, a triangle over both, and a zone in two parts.
_POLYGONS = [
    ("Test/Concave", [[(-8, -6), (2, -6), (2, 5), (-1, 5), (-1, -2), (-5, -2), (-5, 5), (-8, 5)], [(-7, -5), (-6, -5), (-6, -4), (-7, -3.5)]]),
    ("Test/East", [[(2, -6), (7.5, -6), (6.25, 0.5), (7.5, 5), (2, 5)]]),
    ("Test/Above", [[(0, 3), (5, 3), (2.5, 7.25)]]),
    ("Test/Parts", [[(-9.5, 6), (-8.5, 6), (-8.5, 7), (-9.5, 7)]]),
    ("Test/Parts", [[(8, -7), (9.75, -7), (9.75, -5.5), (8, -5.5)], [(8.5, -6.5), (9, -6.5), (9, -6), (8.5, -6)]]),
]
_EDGES = ", ".join(f"({i}, '{zone}', {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for i, (zone, rings) in enumerate(_POLYGONS) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]]))


@register("f17_d9_zones_of_points", f"""WITH g(pid, zone, x1, y1, x2, y2) AS (VALUES {_EDGES}), p AS (SELECT event_id AS id, (event_id * 37 % 2001) / 100.0::DOUBLE - 10 AS lon, (event_id * 53 % 1501) / 100.0::DOUBLE - 7.5 AS lat FROM events),
  h AS (SELECT id, zone FROM p, g WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY id, pid, zone HAVING count(*) % 2 = 1)
  SELECT id, lon, lat, min(zone) AS timezone FROM p LEFT JOIN h USING (id) GROUP BY ALL""")
def _(spark, d):
    """Every event as a point; SQL tests all pairs of points and edges."""
    made = spark.createDataFrame([(zone, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for zone, rings in _POLYGONS], "timezone string, rings array<array<struct<lon: double, lat: double>>>")
    at = lambda factor, wide, shift: (F.col("event_id") * factor % wide).cast("double") / F.lit(100.0) - shift
    points = read(spark, d, "events").select(F.col("event_id").alias("id"), at(37, 2001, 10).alias("lon"), at(53, 1501, 7.5).alias("lat"))
    return polygons.add_zone(points, made, "lon", "lat", size=0.75)
