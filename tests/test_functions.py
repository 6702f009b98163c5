"""Functions and planning helpers against closed forms and their own inverses."""

import math

import pytest
from gridloom.errors import ExtractError, GridloomError, TrimError, UnsupportedCRSError, VariableNotFoundError
from gridloom.functions import color, geo, projections, text, times, units
from gridloom.operators import axes, catalog, cubes, sequences, subset
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SYSTEMS = {
    "utm-north": (projections.utm(33), (0, 80), (12, 18)), "utm-south": (projections.utm(33, False), (-80, 0), (12, 18)),
    "lcc": (projections.CRS("lcc", lat0=39, lon0=-96, sp1=33, sp2=45), (10, 70), (-150, -50)), "lcc-one": (projections.CRS("lcc", lat0=25, lon0=-95, sp1=25), (10, 70), (-150, -50)),
    "north": (projections.from_epsg(3413), (40, 89.9), (-179, 179)), "south": (projections.from_epsg(3031), (-89.9, -40), (-179, 179)),
    "albers": (projections.CRS("albers", lat0=23, lon0=-96, sp1=29.5, sp2=45.5), (5, 75), (-150, -50)), "sphere": (projections.CRS("albers", lat0=23, lon0=-96, sp1=29.5, sp2=45.5, e2=0.0), (5, 75), (-150, -50)),
    "sinusoidal": (projections.CRS("sinusoidal", a=6371007.181, e2=0.0), (-85, 85), (-179, 179)), "mercator": (projections.CRS("mercator", e2=0.0), (-85, 85), (-179, 179)), "geographic": (projections.CRS(), (-90, 90), (-180, 180)),
}


@pytest.mark.parametrize("name", list(SYSTEMS))
def test_projection_inverse(name):
    crs, (south, north), (west, east) = SYSTEMS[name]

    @settings(max_examples=200, deadline=None, database=None)
    @given(st.floats(south, north), st.floats(west, east))
    def back(lat, lon):
        got = crs.inverse(*crs.forward(lat, lon))
        turn = (got[1] - lon + 180) % 360 - 180
        assert abs(got[0] - lat) < 1e-8 and abs(turn) * math.cos(math.radians(lat)) < 1e-7

    back()


def test_projection_known_points():
    """Published worked examples: UTM of the CN Tower, the pole of EPSG:3413."""
    x, y = projections.utm(17).forward(43.642567, -79.387139)
    assert (round(x), round(y)) == (630084, 4833439)
    assert projections.from_epsg(3413).forward(90.0, 0.0) == pytest.approx((0, 0), abs=1e-6)
    with pytest.raises(UnsupportedCRSError) as e:
        projections.from_epsg(27700)
    assert e.value.epsg == 27700
    with pytest.raises(UnsupportedCRSError):
        projections.CRS("robinson").forward(0.0, 0.0)


def test_columns_and_numbers_agree(spark):
    for crs, (south, north), (west, east) in SYSTEMS.values():
        lat, lon = (south + north) / 2 + 1.25, (west + east) / 2 + 2.5
        x, y = crs.forward(F.col("lat"), F.col("lon"))
        r = spark.createDataFrame([(float(lat), float(lon))], "lat double, lon double").select(x.alias("x"), y.alias("y")).first()
        assert (r.x, r.y) == pytest.approx(crs.forward(lat, lon))


def test_display_box():
    m = projections.MERCATOR_MAX_LAT
    assert projections.display_box((0, -90, 359.75, 90)) == (-180, -m, 179.75, m)
    assert projections.display_box((200, 0, 220, 10)) == (-160, 0, -140, 10) and projections.display_box((170, 0, 190, 10)) == (-180, 0, -170, 10)
    assert projections.display_box((-10, 0, 10, 10)) == (-10, 0, 10, 10)


def test_outline_of_polar_box():
    west, south, east, north = projections.from_epsg(3413).bounds_wgs84((-1e6, -2e6, 1e6, -1e6))
    assert -100 < west < east < 20 and 60 < south < north < 90


@settings(max_examples=200, deadline=None, database=None)
@given(st.lists(st.integers(-4000, 4000).map(lambda k: k / 4), min_size=1, max_size=30), st.integers(-8800, 8800).map(lambda k: k / 8))
def test_nearest(coordinates, value):
    best = min(range(len(coordinates)), key=lambda k: (abs(coordinates[k] - value), k))
    assert axes.Axis(coordinates).nearest(value) == best


def test_axes():
    a = axes.Axis([33.0, 32.0, 31.0, 30.0])
    assert a.window(30.5, 32.5) == (1, 2) and a.window(50, 60) is None and a.covers(29.6) and not a.covers(29.4)
    lon = axes.Axis([-95.0, -94.0, -93.0])
    assert lon.nearest_lon(267.0) == 2 and axes.Axis([0.0, 90.0, 180.0, 270.0]).nearest_lon(-93.0) == 3
    assert axes.clamp_range(None, None, 5) == (0, 4) and axes.clamp_range(3, 1, 5) == (3, 3) and axes.clamp_range(-4, 99, 5) == (0, 4)
    with pytest.raises(ExtractError):
        axes.Axis([])


def test_time_units():
    u = times.TimeUnits.parse("hours since 2020-01-01 06:30:00 +02:00")
    assert (u.scale, u.origin()) == (3600, 1577853000.0)
    assert times.TimeUnits.parse("days since 1970-1-1").origin() == 0 and times.calendar_of("365_day") == "noleap"
    for bad in ("hours", "fortnights since 2020-01-01", "hours since yesterday"):
        with pytest.raises(ExtractError):
            times.TimeUnits.parse(bad)
    with pytest.raises(ExtractError):
        times.calendar_of("julian")
    assert times.date_bounds("2020-02-01", "2020-01-01") == ("2020-01-01T00:00:00+00:00", "2020-02-01T23:59:59.999000+00:00")


def test_decoding_edges(spark):
    frame = spark.createDataFrame([(0.0,), (59.0,), (-1.0,), (365.0,)], "v double")
    got = lambda units_text, cal: [r[0] for r in frame.select(times.decode_iso(F.col("v"), units_text, cal)).collect()]
    assert got("days since 2020-01-01", "standard") == ["2020-01-01T00:00:00Z", "2020-02-29T00:00:00Z", "2019-12-31T00:00:00Z", "2020-12-31T00:00:00Z"]
    assert got("days since 2020-01-01", "noleap") == ["2020-01-01T00:00:00Z", "2020-03-01T00:00:00Z", "2019-12-31T00:00:00Z", "2021-01-01T00:00:00Z"]
    assert got("days since 2020-01-01", "360_day") == ["2020-01-01T00:00:00Z", "2020-02-30T00:00:00Z", "2019-12-30T00:00:00Z", "2021-01-06T00:00:00Z"]


def test_values(spark):
    frame = spark.createDataFrame([(float("nan"),), (1e38,), (2.0,), (None,)], "v double")
    assert [r[0] for r in frame.select(units.finite(F.col("v"))).collect()] == [None, None, 2.0, None]
    assert [r[0] for r in frame.select(units.unpack(F.col("v"), 2.0, 1.0, 2.0)).collect()][2:] == [None, None]
    lon = spark.createDataFrame([(180.0,), (181.0,), (-180.0,), (-541.0,), (720.0,)], "v double").select(geo.normalize_lon(F.col("v")))
    assert [r[0] for r in lon.collect()] == [180.0, -179.0, -180.0, 179.0, 0.0]
    r = spark.range(1).select(color.sample_ramp("viridis", F.lit(0.5)).alias("s"), color.normalize(F.lit(5.0), 5.0, 5.0).alias("n"), color.sample_ramp([(0, (0, 0, 0)), (1, (255, 0, 0))], F.lit(0.5)).alias("own")).first()
    assert tuple(r.s) == (38, 130, 142) and r.n == 0 and tuple(r.own) == (128, 0, 0)
    with pytest.raises(GridloomError):
        color.resolve_ramp("jet")
    names = spark.createDataFrame([('<GDALMetadata><Item name="DESCRIPTION" sample="0" role="description">red</Item><Item name="X">1</Item><Item name="DESCRIPTION" sample="1">nir</Item></GDALMetadata>',)], "m string")
    assert names.select(text.band_names(F.col("m"))).first()[0] == ["red", "nir"]


def test_catalog_helpers():
    assert catalog.require_variables(["a", "b"], None, ["b"]) == ["b"] and catalog.require_variables(["a", "b"], ["b", "a"], ["b"]) == ["b"]
    with pytest.raises(VariableNotFoundError):
        catalog.require_variables(["a"], ["c"])
    assert catalog.clamp_box((0, 0, 10 + 1e-10, 5), (0, 0, 10, 10)) == (0, 0, 10, 5)
    for bad in ((0, 0, 0, 5), (0, 0, float("nan"), 5), (0, 0, 11, 5)):
        with pytest.raises(ExtractError):
            catalog.clamp_box(bad, (0, 0, 10, 10))
    assert catalog.native_size((1, 721, 1440), (-180, -90, 180, 90), (0, 0, 90, 45)) == (360, 180)
    assert sequences.evenly_chosen(5, 9) == [0, 1, 2, 3, 4] and sequences.evenly_chosen(30, 4) == [0, 10, 19, 29] and sequences.frame_budget(1024, 1024) == 64
    assert subset.widen({"t": (7, 12)}, {"t": 5}) == {"t": (5, 14)}
    with pytest.raises(TrimError):
        subset.hyperslab(None, {"t": (3, 1)})
    assert cubes.mercator_rows((-180, -90, 180, 90), 4)[0] == 0 and cubes.round_index(0.5, 4) == 2


def test_streaming_is_batch(spark, sf, tmp_path):
    from gridloom.operators.points import rasterize_mean
    from gridloom.plans.catalogue import WORLD, read_points
    from gridloom.streaming.rasters import rasterize_windows, stream_points

    points = read_points(spark, sf).select("ts", "lat", "lon", "value")
    points.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = rasterize_windows(stream_points(spark, str(tmp_path / "in"), points.schema, 1), WORLD, 12, 6, "1 day", "40 days")
    query = stream.writeStream.format("memory").queryName("rasters").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = {(str(r.start)[:10], r.r, r.c): (round(r.value, 6), r.n) for r in spark.sql("select * from rasters").collect()}
    batch = rasterize_mean(points.withColumn("day", F.to_date("ts")), WORLD, 12, 6, by=("day",))
    assert got == {(str(r.day), r.r, r.c): (round(r.value, 6), r.n) for r in batch.collect()}


def test_streamed_files(spark, tmp_path):
    import numpy as np
    from gridloom.sources import netcdf3
    from gridloom.streaming.rasters import stream_cells

    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.nc").write_bytes(netcdf3.write({"lat": 2, "lon": 2}, {"v": (["lat", "lon"], np.full((2, 2), k, np.float32), {})}))
    query = stream_cells(spark, str(tmp_path / "in"), "*.nc").writeStream.format("memory").queryName("cells_in").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.value for r in spark.sql("select value from cells_in").collect()) == [0.0] * 4 + [1.0] * 4


def test_entry_without_training_operators():
    """The rest imports where the training-data operators are gone."""
    import subprocess
    import sys

    code = "import sys, importlib.util as u; real = u.find_spec; u.find_spec = lambda n, *a: None if n == 'gridloom.llm' else real(n, *a); import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) > 80; assert not any('llm' in m for m in sys.modules)"
    root = __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_fractions_of_seconds(spark):
    frame = spark.createDataFrame([(0.0,), (0.5,), (1.25,), (59.9996,), (2.001,), (-0.25,)], "v double")
    for calendar in ("standard", "noleap", "360_day"):
        got = [r[0] for r in frame.select(times.decode_iso(F.col("v"), "seconds since 2001-01-01 00:00:00", calendar)).collect()]
        last = {"standard": "2000-12-31", "noleap": "2000-12-31", "360_day": "2000-12-30"}[calendar]
        assert got == ["2001-01-01T00:00:00Z", "2001-01-01T00:00:00.5Z", "2001-01-01T00:00:01.25Z", "2001-01-01T00:01:00Z", "2001-01-01T00:00:02.001Z", f"{last}T23:59:59.75Z"]
