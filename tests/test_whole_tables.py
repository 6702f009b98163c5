"""Queries that were registered only on a subset, over every row."""

from gridloom.operators import catalog
from gridloom.plans import catalogue


def test_rows_outside_the_subsets_count(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").collect()
    run = {name: catalogue.QUERIES[f"{name}_all"](spark, sf).collect() for name in ("auto_range", "bbox_intersection", "concatenated_sources", "overview_pick")}
    assert sorted(r.event_id for r in run["concatenated_sources"]) == sorted(r.event_id for r in events)
    ranges = {}
    for r in events:
        ranges.setdefault(r.event_type, []).append(r.value)
    assert {r.event_type: (r.vmin, r.vmax) for r in run["auto_range"]} == {k: (min(v), max(v)) for k, v in ranges.items()}
    assert len(run["bbox_intersection"]) > catalogue.QUERIES["bbox_intersection"](spark, sf).count()
    sizes = [(r.o_custkey % 40 + 1, r.o_orderkey % 30 + 1, r.o_orderkey) for r in spark.read.parquet(f"{sf}/orders.parquet").collect()]
    enough = [(w * h, k) for w, h, k in sizes if w >= 20 and h >= 11]
    assert [r.k for r in run["overview_pick"]] == [min(enough)[1]]


def test_ties(spark):
    rows = spark.createDataFrame([(2, 24, 11), (1, 22, 12)], "k long, width long, height long")
    assert [r.k for r in catalog.pick_overview(rows, 20, 11, ties=("k",)).collect()] == [1]
