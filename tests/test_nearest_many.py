"""Nearest points for many targets against all pairs."""

import math
import random

import pytest
from gridloom.operators import nearest, points
from pyspark.sql import functions as F


def vector(lat, lon, metric):
    if metric == "degrees":
        return lon / 360, lat / 360, 0.0
    a, b = math.radians(lat), math.radians(lon)
    return math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)


def brute(rows, targets, metric):
    out = {}
    known = [(i, vector(lat, lon, metric)) for i, lat, lon in rows if lat is not None and lon is not None and not math.isnan(lat)]
    for q, lat, lon in targets:
        t = vector(lat, lon, metric) if lat is not None and lon is not None else None
        out[q] = min(((round(sum((x - y) ** 2 for x, y in zip(t, p, strict=True)), 12), i) for i, p in known), default=(None, None))[1] if t else None
    return out


def frames(spark, rows, targets):
    return spark.createDataFrame(rows, "event_id long, lat double, lon double").repartition(3), spark.createDataFrame(targets, "query long, lat double, lon double").repartition(2)


@pytest.mark.parametrize("metric", ["sphere", "degrees"])
def test_against_all_pairs(spark, metric):
    rng = random.Random(8)
    rows = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(700)]
    rows += [(1000 + k, 51.5 + rng.gauss(0, 1e-3), -0.1 + rng.gauss(0, 1e-3)) for k in range(1500)]  # a third or more in one cell of most levels
    rows += [(3000 + k, 10.0, 179.99) for k in range(200)] + [(4000, 90.0, 12.0), (4001, -90.0, 0.0), (4002, None, 1.0), (4003, float("nan"), 1.0), (-5, 10.0, 179.99)]
    targets = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(300)] + [(1000 + k, 51.5 + rng.gauss(0, 1e-2), -0.1 + rng.gauss(0, 1e-2)) for k in range(300)]
    targets += [(2000, 90.0, -100.0), (2001, -90.0, 77.0), (2002, 10.0, -179.99), (2003, 10.0, 180.0), (2004, None, 3.0), (2005, 89.999, 170.0), (2006, 51.5, -0.1)]
    p, t = frames(spark, rows, targets)
    got = {r.query: r.event_id for r in nearest.nearest_many(p, t, metric=metric).select("query", "point.event_id").collect()}
    assert got == brute(rows, targets, metric)
    if metric == "sphere":
        far = {r["query"]: r.distance for r in nearest.nearest_many(p, t).collect()}
        assert far[2000] < 1e-6 and abs(far[2002] - math.radians(0.02) * math.cos(math.radians(10)) * nearest.RADIUS) < 10


def test_deepest_cells(spark):
    """More positions in a deepest cell than a leaf may have."""
    rng = random.Random(2)
    rows = [(k, 45 + rng.random() * 1e-6, 7 + rng.random() * 1e-6) for k in range(150)]
    targets = [(k, 45 + rng.random() * 1e-6, 7 + rng.random() * 1e-6) for k in range(20)]
    p, t = frames(spark, rows, targets)
    # Squared distances of centimetres are below 12 decimals: all are equal, and the smallest id answers.
    assert {r.event_id for r in nearest.nearest_many(p, t).select("point.event_id").collect()} == set(brute(rows, targets, "sphere").values()) == {0}


def test_empty_and_clashes(spark):
    p, t = frames(spark, [(1, 2.0, 3.0)], [(1, 0.0, 0.0)])
    none = p.where("event_id > 5")
    assert [tuple(r) for r in nearest.nearest_many(none, t).collect()] == [(1, None, None)]
    assert nearest.nearest_many(p, t.where("query > 5")).count() == 0
    odd = p.select("event_id", "lat", "lon", *(F.lit(k).alias(n) for k, n in enumerate(("x", "cell", "query", "distance", "point", "level", "d"))))
    row = nearest.nearest_many(odd, t).first()
    assert row.point.asDict() == {"event_id": 1, "lat": 2.0, "lon": 3.0, "x": 0, "cell": 1, "query": 2, "distance": 3, "point": 4, "level": 5, "d": 6}


def test_many_literal_targets(spark):
    rng = random.Random(4)
    rows = [(k, float(rng.randrange(-90, 91)), float(rng.randrange(-180, 181))) for k in range(400)]
    targets = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(points.MANY + 5)]
    p, _ = frames(spark, rows, targets)
    got = points.nearest(p, [t[1:] for t in targets])
    assert got.columns == ["query", "at_lat", "at_lon", "event_id", "lat", "lon"]
    assert {r["query"]: r.event_id for r in got.collect()} == brute(rows, targets, "degrees")


def joined_rows(plan):
    """Rows that each join of an executed plan gave."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return joined_rows(plan.executedPlan())
    if plan.nodeName().endswith("QueryStage"):
        return joined_rows(plan.plan())
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in plan.nodeName() else []
    return own + [n for k in range(plan.children().size()) for n in joined_rows(plan.children().apply(k))]


def test_few_positions_reach_the_sort(spark):
    """A target meets the positions that may be its nearest, not all of its leaves: rows for the last aggregate are sorted."""
    rng = random.Random(5)
    rows = [(k, rng.uniform(-9, 9), rng.uniform(-9, 9)) for k in range(3000)]
    targets = [(k, rng.uniform(-9, 9), rng.uniform(-9, 9)) for k in range(200)]
    for metric in nearest.METRICS:
        found = nearest.nearest_many(*frames(spark, rows, targets), metric=metric)
        assert {r["query"]: r.point.event_id for r in found.collect()} == brute(rows, targets, metric)
        joined = joined_rows(found._jdf.queryExecution().executedPlan())
        assert max(joined) <= 10 * len(targets), joined
