"""Forms of operators for long inputs against the plain ones."""

import random

from gridloom.operators import axes, points, sequences


def test_many_targets(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(k, rng.uniform(-80, 80), rng.uniform(-170, 170)) for k in range(500)], "event_id long, lat double, lon double")
    targets = [(rng.uniform(-80, 80), rng.uniform(-170, 170)) for _ in range(points.MANY + 8)]
    for distance in (points.squared_degrees, points.by_haversine):
        many = {(r.query, r.at_lat, r.event_id) for r in points.nearest(rows, targets, distance).collect()}
        few = {(r.query + at, r.at_lat, r.event_id) for at in range(0, len(targets), 8) for r in points.nearest(rows, targets[at : at + 8], distance).collect()}
        assert many == few and len(many) == len(targets)
    assert points.nearest(rows.where("event_id < 0"), targets).count() == 0


def test_unique_coordinates(spark):
    rng = random.Random(2)
    values = [round(rng.uniform(0, 50), 3) for _ in range(4000)] + [7.0, 7.0 + 1e-12, None, float("nan")]
    frame = spark.createDataFrame([(v,) for v in values], "c double")
    for tolerance in (0.0, 1e-9, 0.5):
        wanted = []
        for v in sorted({v for v in values if v is not None and v == v}):
            if not wanted or v - wanted[-1] > tolerance:
                wanted.append(v)
        assert [(r.i, r.c) for r in axes.unique_coordinates(frame, "c", tolerance).orderBy("i").collect()] == list(enumerate(wanted))


def test_unique_coordinates_across_ranges(spark):
    """Chains that cross ranges, and a tolerance wider than a range."""
    rng = random.Random(4)
    values = sorted({round(rng.uniform(-30, 50), 2) for _ in range(1500)} | {60 + k * 0.3 for k in range(200)})
    frame = spark.createDataFrame([(v,) for v in values], "c double").repartition(4)
    for tolerance, most in ((0.3, 60), (1.7, 90), (25.0, 50), (0.0, 400), (1e6, 100)):
        wanted = []
        for v in values:
            if not wanted or v - wanted[-1] > tolerance:
                wanted.append(v)
        assert [(r.i, r.c) for r in axes.unique_coordinates(frame, "c", tolerance, most).orderBy("i").collect()] == list(enumerate(wanted))
    assert axes.unique_coordinates(frame.where("c > 1e9"), "c").count() == 0


def test_ranked_subset(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab") if k % 7 else None, rng.randrange(5) * 86400 + rng.randrange(3), k) for k in range(300)]
    frame = spark.createDataFrame(rows, "variable string, seconds long, start long")
    wanted = {}
    for name in ("a", "b", None):
        own = sorted((s, p) for v, s, p in rows if v == name)
        wanted |= {p: k for k, (_, p) in enumerate(own) if 3 <= k <= 60}
    for time, f in (("seconds", frame), ("at", frame.selectExpr("variable", "timestamp_seconds(seconds) AS at", "start"))):
        assert {r.start: r.time_index for r in sequences.ranked_subset(f, 3, 60, time=time).collect()} == wanted


def test_parameter_files(spark, tmp_path):
    """The columns of the published table; ranges, reserved numbers and other tables' lines are left out."""
    from gridloom.operators import catalog

    lines = [
        "Title_en,SubTitle_en,CodeFlag,Value,MeaningParameterDescription_en,Note_en,UnitComments_en,Status",
        '"Code table 4.2","Product discipline 0 - Meteorological products, parameter category 191: miscellaneous",0,,"Seconds prior to initial reference time",,s,Operational',
        '"Code table 4.2","Product discipline 3 - Space products, parameter category 0: image format",2,,"Cloud mask, with ""quotes""",,,Operational',
        '"Code table 4.2","Product discipline 3 - Space products, parameter category 0: image format",10-191,,Reserved,,,Operational',
        '"Code table 4.1","Product discipline 0 - Meteorological products",3,,Mass,,,Operational',
    ]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    table = catalog.read_parameters(spark, str(tmp_path / "t.csv"))
    assert sorted(map(tuple, table.collect())) == [(0, 191, 0, "Seconds prior to initial reference time", "s"), (3, 0, 2, 'Cloud mask, with "quotes"', "")]
    messages = spark.createDataFrame([(0, 191, 0), (3, 0, 2), (3, 0, 5)], "discipline int, category int, number int")
    named = {(r.discipline, r.number): r.name for r in catalog.name_parameters(messages, table).collect()}
    assert named == {(0, 0): "Seconds prior to initial reference time", (3, 2): 'Cloud mask, with "quotes"', (3, 5): "Unknown (discipline=3, category=0, number=5)"}
    assert len(catalog.PARAMETERS) == len({p[:3] for p in catalog.PARAMETERS}) and list(catalog.PARAMETERS) == sorted(catalog.PARAMETERS, key=lambda p: p[:3])
