"""Points in polygons by cells against a ray through every edge."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from skyledger.operators import polygons

SCHEMA = "timezone string, rings array<array<struct<lon: double, lat: double>>>"


def plain(lon, lat, rings):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
            n += (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
    return n % 2 == 1


def star(rng, x, y, points, size):
    return [(x + size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / points), y + size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / points)) for i in range(points)]


@pytest.mark.parametrize("size", [0.3, 1.0, 50.0])
def test_equals_every_edge(spark, size):
    rng = random.Random(7)
    zones = [(f"z{i}", [star(rng, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice([3, 7, 40]), rng.choice([0.2, 3, 9]))]) for i in range(12)]
    zones += [("square", [[(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0), (0.0, 0.0)], [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0)]]), ("right", [[(6.0, 0.0), (12.0, 0.0), (12.0, 6.0), (6.0, 6.0)]])]
    points = [(i, rng.uniform(-25, 25), rng.uniform(-25, 25)) for i in range(1500)] + [(2000 + 100 * i + j, float(i), float(j)) for i in range(-1, 14) for j in range(-1, 8)]  # corners and borders
    found = polygons.add_zone(spark.createDataFrame(points, "id int, lon double, lat double"), spark.createDataFrame(zones, SCHEMA), "lon", "lat", size=size)
    got = {r.id: r.timezone for r in found.collect()}
    assert len(got) == len(points)
    for i, lon, lat in points:
        assert got[i] == min((z for z, rings in zones if plain(lon, lat, rings)), default=None), (lon, lat)
    shared = [got[2000 + 600 + j] for j in range(0, 6)]  # on the border of square and right: exactly one, the eastern
    assert all(z is not None for z in shared)


def test_awkward_points_and_polygons(spark):
    zones = spark.createDataFrame([("a", [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)]]), ("b", None), ("c", [[(0.0, 0.0), (1.0, 1.0)]]), ("d", [])], SCHEMA)
    points = spark.createDataFrame([(1, 1.5, 0.5), (1, 1.5, 0.5), (2, None, 0.5), (3, float("nan"), 0.5), (4, 200.0, -95.0)], "id int, Longitude double, Latitude double").withColumns({"zone": F.lit("x"), "ix": F.lit(1)})
    got = sorted((r.id, r.timezone) for r in polygons.add_zone(points, zones).collect())
    assert got == [(1, "a"), (1, "a"), (2, None), (3, None), (4, None)]
    assert polygons.add_zone(points, zones.limit(0)).filter("timezone is null").count() == 5
    assert polygons.add_zone(points.limit(0), zones).count() == 0
    with pytest.raises(ValueError):
        polygons.add_zone(points.withColumn("timezone", F.lit("x")), zones)


def test_inner_cells_keep_no_edges(spark):
    square = spark.createDataFrame([("a", [[(0.5, 0.5), (20.5, 0.5), (20.5, 20.5), (0.5, 20.5)]])], SCHEMA)
    cells = polygons.cover(polygons.edges(square), 1.0).select("ix", "iy", F.explode("found").alias("f")).select("ix", "iy", "f.*").collect()
    inner = [c for c in cells if c.inside]
    assert len(inner) == 19 * 19 and all(not c.edges for c in inner) and len(cells) == 21 * 21
