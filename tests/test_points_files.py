"""Point tables in Parquet, projected grids by their grid mapping, chunk maps and reductions of one's own."""

import json
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from gridloom.errors import ExtractError, UnsupportedCRSError
from gridloom.functions.projections import CRS, utm
from gridloom.plans import engine
from gridloom.sources import cf, grids, hdf5, netcdf3
from gridloom.sources.parquet_points import PointTable


def test_stations(spark, tmp_path):
    rows = [(10**9 + 3600 * t, 10.0 + s, 20.0 + 2 * s, float(100 * s + t)) for t in range(3) for s in range(4)] + [(10**9, 10.0, 20.0, -1.0)]
    spark.createDataFrame(rows, "Time long, Latitude double, LON double, temp double").coalesce(1).write.parquet(str(tmp_path / "p"))
    table = PointTable(spark, str(tmp_path / "p"))
    assert (table.roles.lat, table.roles.lon, table.roles.time, table.roles.values) == ("Latitude", "LON", "Time", ("temp",))
    assert table.bbox() == (20, 10, 26, 13)
    assert table.grid_type().first().grid_type == "point"
    got = sorted((r.time_s, r.value) for r in table.extract("temp", 10.2, 20.3).collect())
    assert got == [(10**9, -1.0), (10**9 + 3600, 1.0), (10**9 + 7200, 2.0)]
    assert len(table.select(("2001-09-09", "2001-09-09T02:00:00Z")).collect()) == 5
    raster = {(r.r, r.c): r.value for r in table.extract_grid("temp", (20, 10, 28, 14), 4, 4).collect()}
    assert raster == {(3, 0): -0.5, (3, 1): 100.0, (2, 2): 200.0, (1, 3): 300.0}  # a point on a row boundary belongs to the row below
    with pytest.raises(ExtractError):
        PointTable(spark, str(tmp_path / "p"), lat="nowhere")


def test_mesh(spark, tmp_path):
    rows = [("2020-01-01T00:00:00Z", float(y), float(x), float(10 * y + x)) for y in range(3) for x in range(4)]
    spark.createDataFrame(rows, "time string, y double, x double, v double").write.parquet(str(tmp_path / "m"))
    table = PointTable(spark, str(tmp_path / "m"))
    assert table.grid_type().first().grid_type == "mesh"
    got = {(r.r, r.c): r.value for r in table.extract_grid("v", (-0.5, -0.5, 3.5, 2.5), 8, 6).collect()}
    assert len(got) == 48 and got[0, 0] == 20.0 and got[5, 7] == 3.0
    assert [r.value for r in table.extract("v", 1.9, 2.2).collect()] == [22.0]


@pytest.mark.parametrize("order", ["<", ">"])
def test_geoparquet(spark, tmp_path, order):
    crs = utm(33)
    places = [(50.0, 15.0), (51.5, 14.0), (-0.0, 16.25)]
    wkb = [struct.pack(f"{order}BIdd", order == "<", 1, *crs.forward(*p)) for p in places] + [struct.pack("<BI", 1, 3) + b"\0" * 20, None]
    geo = {"primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "crs": {"id": {"authority": "EPSG", "code": 32633}}}}}
    table = pa.table({"geometry": pa.array(wkb, pa.binary()), "lat": [1, 2, 3, 4, 5], "v": [1.0, 2.0, 3.0, 4.0, 5.0]}).replace_schema_metadata({"geo": json.dumps(geo)})
    pq.write_table(table, tmp_path / "g.parquet")
    got = PointTable(spark, str(tmp_path / "g.parquet"))
    assert got.roles.geometry == "geometry" and got.roles.values == ("v",)
    found = [(r.lat, r.lon) for r in got.points.orderBy("v").collect()]
    assert np.allclose(found[:3], places, atol=1e-7) and found[3:] == [(None, None)] * 2


def test_wkb_doubles(spark):
    from gridloom.sources.parquet_points import wkb_point
    from pyspark.sql import functions as F

    values = [0.0, -0.0, 1.5, -1e-310, 5e-324, 1.7976931348623157e308, 3.141592653589793, -123456.789]
    frame = spark.createDataFrame([(bytearray(struct.pack("<BIdd", 1, 1, v, -v)),) for v in values], "g binary")
    assert [tuple(r) for r in frame.select(*wkb_point(F.col("g"))).collect()] == [(v, -v) for v in values]


def test_projected_file(spark, tmp_path):
    crs = {"grid_mapping_name": "lambert_conformal_conic", "standard_parallel": np.array([33.0, 45.0]), "latitude_of_projection_origin": 39.0, "longitude_of_central_meridian": -96.0, "earth_radius": 6371229.0}
    y, x = np.arange(-3, 4) * 100.0, np.arange(-4, 5) * 100.0
    data = np.arange(63, dtype=np.float32).reshape(7, 9)
    parts = {"y": (["y"], y, {"units": "km", "standard_name": "projection_y_coordinate"}), "x": (["x"], x, {"units": "km", "standard_name": "projection_x_coordinate"}), "crs": ([], np.int32(0), crs), "v": (["y", "x"], data, {"grid_mapping": "crs"})}
    (tmp_path / "p.nc").write_bytes(netcdf3.write({"y": 7, "x": 9}, parts))
    source = engine.Dataset(spark, str(tmp_path / "p.nc"))
    v = source.variable("v")
    assert v.crs["kind"] == "lcc" and v.x[0] == -400_000 and v.supported
    own = CRS("lcc", lat0=39, lon0=-96, sp1=33, sp2=45, a=6371229.0, e2=0.0)
    lat, lon = own.inverse(210_000.0, -95_000.0)
    r = source.extract("v", lat, lon).first()
    assert r.value == data[2, 6] and own.forward(r.lat, r.lon) == pytest.approx((200_000, -100_000))
    box = v.bbox()
    grid = source.extract_grid("v", box, 20, 20)
    got = grid.to_array()
    lats, lons = grid.centres()
    for k, la in enumerate(lats):
        for j, lo in enumerate(lons):
            px, py = own.forward(la, lo)
            i, c = np.floor((py + 350_000) / 1e5), np.floor((px + 450_000) / 1e5)
            wanted = data[int(i), int(c)] if 0 <= i < 7 and 0 <= c < 9 else np.nan
            assert np.array_equal(got[k, j], np.float32(wanted), equal_nan=True)


def test_mappings():
    assert cf.crs_from_mapping({"grid_mapping_name": "latitude_longitude"}) == {}
    north = cf.crs_from_mapping({"grid_mapping_name": "polar_stereographic", "standard_parallel": [70.0], "straight_vertical_longitude_from_pole": -45.0, "semi_major_axis": 6378137.0, "inverse_flattening": 298.257223563})
    assert CRS(**north).forward(75.0, -45.0) == pytest.approx(CRS("polar-stereo", lon0=-45, true_scale_lat=70).forward(75.0, -45.0), abs=1e-3)
    assert cf.crs_from_mapping({"grid_mapping_name": "transverse_mercator"})["scale"] == 1.0
    for bad in ({}, {"grid_mapping_name": "geostationary"}, {"grid_mapping_name": "polar_stereographic"}):
        with pytest.raises(UnsupportedCRSError):
            cf.crs_from_mapping(bad)
    assert cf.projected_because({}, {}, [0.0, 89.0], [359.0]) == "" and "degrees" in cf.projected_because({}, {}, [5e5], [0.0])
    assert cf.describe_axes(None, {"standard_name": "grid_latitude"}, {}, [0.0], [0.0])[4] is False


def test_chunk_map_and_reduction(spark, tmp_path):
    data = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    path = str(tmp_path / "c.h5")
    (tmp_path / "c.h5").write_bytes(hdf5.write({"lat": (np.arange(3.0), ["lat"], {}), "lon": (np.arange(4.0), ["lon"], {}), "v": (data, ["time", "lat", "lon"], {})}))
    assert grids.chunk_index(spark, path, "v").count() == 0  # contiguous
    sums = grids.reduce_blocks(grids.blocks(spark, [path]), lambda v, b, a: [(v.name, b.t, float(a.sum()))], "name string, t int, total double")
    assert sorted((r.t, r.total) for r in sums.collect()) == [(0, 66.0), (1, 210.0)]
    grids.normalize(spark, [path], str(tmp_path / "cells"))
    got = spark.read.parquet(str(tmp_path / "cells"))
    assert got.where("variable = 'v' and t = 1 and iy = 2 and ix = 3").first().value == 23.0 and got.count() == 24


def test_hdf5_chunked(tmp_path):
    """Chunks with shuffle and deflate behind a version 1 tree, made by hand; one chunk missing, one with a filter left out."""
    import zlib

    file = hdf5.Hdf5File.__new__(hdf5.Hdf5File)
    a = np.arange(24, dtype="<i2").reshape(4, 6)
    body, refs = b"\0" * 512, []
    for i in range(2):
        for j in range(2):
            part = a[2 * i : 2 * i + 2, 4 * j : 4 * j + 4]
            full = np.zeros((2, 4), "<i2")
            full[:, : part.shape[1]] = part
            raw = full.tobytes() if (i, j) == (0, 1) else full.view(np.uint8).reshape(-1, 2).T.tobytes()
            packed = zlib.compress(raw)
            if (i, j) != (1, 1):
                refs.append(((2 * i, 4 * j), len(body), len(packed), 1 if (i, j) == (0, 1) else 0))
                body += packed
    tree = struct.pack("<4sBBHQQ", b"TREE", 1, 0, len(refs), 2**64 - 1, 2**64 - 1) + b"".join(struct.pack("<IIQQQQ", size, mask, *coords, 0, at) for coords, at, size, mask in refs)
    file.source = __import__("gridloom.sources.files", fromlist=["ByteSource"]).ByteSource(tree.ljust(512, b"\0") + body[512:])
    layout = struct.pack("<BBBQIII", 3, 2, 3, 0, 2, 4, 2)
    filters = struct.pack("<BBHI", 1, 2, 0, 0) + struct.pack("<HHHHII", 2, 0, 1, 1, 2, 0) + struct.pack("<HHHHII", 1, 0, 1, 1, 6, 0)
    found = [(hdf5.DATASPACE, struct.pack("<BBBBI", 1, 2, 0, 0, 0) + struct.pack("<QQ", 4, 6)), (hdf5.DATATYPE, struct.pack("<BBBBIHH", 0x10, 8, 0, 0, 2, 0, 16)), (hdf5.FILTERS, filters), (hdf5.LAYOUT, layout)]
    d = hdf5.Dataset(file, found)
    wanted = a.copy()
    wanted[2:, 4:] = 0
    assert d.chunks == (2, 4) and np.array_equal(d.whole(), wanted)
