"""Queries that give every row of their table."""

from __future__ import annotations

from skyledger.plans import registry


def test_tree_attributions_of_every_row(spark, sf):
    found = registry.queries()["m17_tree_attributions"](spark, sf)
    assert found.select("key").distinct().count() == spark.read.parquet(f"{sf}/events.parquet").count() > 200


def test_demand_of_every_event(spark, sf):
    found = registry.queries()["d11_schedule_demand"](spark, sf)
    assert found.select("id").distinct().count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_every_hour_of_the_grid(spark, sf):
    found = [registry.queries()[n](spark, sf) for n in ("j1_d14_asof_snapshot", "w3_d7_rolling_history", "w4_d7_rolling_history_exclusive")]
    hours = [f.groupBy("airport").count().select("count").distinct().collect() for f in found]
    assert all([r[0] for r in h] == [30 * 24] for h in hours)
