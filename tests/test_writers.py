"""Rasters written by tasks, read back; failures leave nothing; overviews chosen by the request."""

import os
import random

import numpy as np
import pytest
from gridloom.plans import engine
from gridloom.sources import assembly, geotiff, grids, writers
from gridloom.sources.files import ByteSource
from pyspark.sql import functions as F

BOX = (-30.0, 10.0, 60.0, 70.0)


def raster(height, width, holes=True, seed=3):
    a = np.random.default_rng(seed).normal(size=(height, width)).astype("f4")
    if holes:
        a[np.random.default_rng(seed + 1).random(a.shape) < 0.2] = np.nan
        a[: height // 3, : width // 3] = np.nan
    return a


def cells_of(spark, a):
    rows = [(int(r), int(c), float(a[r, c])) for r, c in zip(*np.nonzero(~np.isnan(a)), strict=True)]
    return spark.createDataFrame(rows, "iy int, ix int, value double").repartition(7)


def whole(path, overview=0):
    _, reader = grids.open_reader(f"{path}#overview={overview}" if overview else path)
    v = reader.variables()[0]
    out = np.full(v.shape[1:], -9e9, "f4")
    for b in reader.blocks(v):
        out[b.y : b.y + b.ny, b.x : b.x + b.nx] = reader.read(v, b)[0]
    return out


def means(a, k):
    h, w = (-(-n // k) * k for n in a.shape)
    p = np.full((h, w), np.nan)
    p[: a.shape[0], : a.shape[1]] = a
    parts = p.reshape(h // k, k, w // k, k)
    n = (~np.isnan(parts)).sum(axis=(1, 3))
    return np.where(n > 0, np.nansum(parts, axis=(1, 3)) / np.maximum(n, 1), np.nan).astype("f4")


@pytest.mark.parametrize(("shape", "tile", "big", "positional"), [((100, 150), 16, False, True), ((100, 150), 32, True, True), ((16, 16), 16, False, True), ((1, 1), 16, True, True), ((70, 33), 16, False, False)])
def test_geotiff(spark, tmp_path, shape, tile, big, positional, monkeypatch):
    a, out = raster(*shape, holes=shape != (1, 1)), str(tmp_path / "out.tif")
    real = assembly.assemble
    monkeypatch.setattr(assembly, "assemble", lambda pieces, size, to: real(pieces, size, to, positional))
    writers.write_geotiff(cells_of(spark, a), out, *shape, BOX, "v", tile, big=big)
    assert os.listdir(tmp_path) == ["out.tif"]
    reader = geotiff.GeoTiffReader(ByteSource(out))
    assert reader.big is big and reader.names() == ["v"] and np.allclose(reader.variables()[0].bbox(), (BOX[0] + 45 / shape[1], BOX[1] + 30 / shape[0], BOX[2] - 45 / shape[1], BOX[3] - 30 / shape[0]))
    np.testing.assert_array_equal(whole(out), a)
    levels = 0
    while max(shape) / 2**levels > tile:
        levels += 1
        got = whole(out, levels)
        np.testing.assert_allclose(got, means(a, 2**levels), rtol=1e-6)
    assert len(reader.overviews) == levels


def test_geotiff_tables_in_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(assembly, "GROUP", 5)
    a, out = raster(90, 200), str(tmp_path / "out.tif")
    writers.write_geotiff(cells_of(spark, a), out, 90, 200, BOX, tile=16)
    np.testing.assert_array_equal(whole(out), a)


def test_zarr(spark, tmp_path):
    out = str(tmp_path / "s" / "out.zarr")
    a = np.stack([raster(20, 33, seed=k) for k in range(5)])
    rows = [(int(t), int(y), int(x), float(a[t, y, x])) for t, y, x in zip(*np.nonzero(~np.isnan(a)), strict=True)]
    rows += [(9, 0, 0, 1.0), (0, 40, 0, 1.0), rows[0][:3] + (-99.0,)]  # outside; a lesser value of a cell
    cells = spark.createDataFrame(rows, "t int, iy int, ix int, value double").repartition(5)
    axes = {"time": (range(5), {"units": "days since 2024-01-01"}), "lat": (np.linspace(60, -60, 20), {}), "lon": (np.linspace(0, 320, 33), {})}
    writers.write_zarr(cells, out, axes, ["t", "iy", "ix"], [2, 8, 16], "v", {"units": "K"})
    assert sorted(os.listdir(tmp_path / "s")) == ["out.zarr"] and not [n for n in os.listdir(out) if n.startswith(".v")]
    _, reader = grids.open_reader(out)
    v = reader.variables()[0]
    assert v.units == "K" and v.shape == (5, 20, 33) and v.times[1] - v.times[0] == 86400
    got = np.full(v.shape, -9e9, "f4")
    for b in reader.blocks(v):
        got[b.t : b.t + b.nt, b.y : b.y + b.ny, b.x : b.x + b.nx] = reader.read(v, b)
    np.testing.assert_array_equal(got, a)


def test_netcdf3(spark, tmp_path):
    """The same bytes as the writer of whole arrays, in stretches that don't divide the rows."""
    from gridloom.sources import netcdf3

    a = np.stack([raster(20, 33, seed=k) for k in range(3)])
    a[1] = np.nan
    rows = [(int(t), int(y), int(x), float(a[t, y, x])) for t, y, x in zip(*np.nonzero(~np.isnan(a)), strict=True)]
    cells = spark.createDataFrame([*rows, (0, 20, 0, 5.0)], "t int, iy int, ix int, value double").repartition(5)
    axes = {"time": (np.arange(3.0), {"units": "days since 2024-01-01"}), "lat": (np.linspace(60, -60, 20), {"units": "degrees_north"}), "lon": (np.linspace(0, 320, 33), {"units": "degrees_east"})}
    out = writers.write_netcdf3(cells, str(tmp_path / "out.nc"), axes, ["t", "iy", "ix"], "v", {"units": "K"}, {"title": "t"}, stretch=97)
    own = {"units": "K", "_FillValue": np.float32("nan")}
    wanted = netcdf3.write({"time": 3, "lat": 20, "lon": 33}, {n: ([n], np.array(v), at) for n, (v, at) in axes.items()} | {"v": (list(axes), a, own)}, {"title": "t"})
    assert open(out, "rb").read() == wanted and os.listdir(tmp_path) == ["out.nc"]


@pytest.mark.parametrize("fmt", ["zarr", "geotiff", "netcdf3"])
def test_failed_task_leaves_nothing(spark, tmp_path, fmt):
    cells = spark.range(4000).select((F.col("id") / 100).cast("int").alias("r"), (F.col("id") % 100).cast("int").alias("c"), F.when(F.col("id") == 3999, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("double").alias("value"))
    grid = engine.Grid(cells.repartition(5), BOX, 100, 40)
    with pytest.raises(Exception, match="broken"):
        writers.write_grid(grid, fmt, str(tmp_path / "out"), tile=16)
    assert os.listdir(tmp_path) == []


def test_assembly_failures(spark, tmp_path):
    out = str(tmp_path / "f")
    rows = assembly.inline(spark, [(0, b"abc"), (2, b"de")])
    with pytest.raises(Exception, match="overlap"):
        assembly.assemble(rows.repartition(2), 4, out)
    lost = spark.createDataFrame([(0, 5, str(tmp_path / "none"), 0, None)], assembly.PIECES)
    with pytest.raises(Exception, match="none"):
        assembly.assemble(lost, 5, out)
    assert os.listdir(tmp_path) == []
    assembly.assemble(assembly.inline(spark, [(6, b"xyz"), (1, b"abc")]), 10, out)
    assert open(out, "rb").read() == b"\0abc\0\0xyz\0"


def test_places(spark, monkeypatch):
    monkeypatch.setattr(assembly, "GROUP", 4)
    rng = random.Random(1)
    rows = [(k * 3, rng.randrange(9)) for k in range(50)]
    got = {r.seq: r.target for r in assembly.placed(spark.createDataFrame(rows, "seq long, length long").repartition(3), 100).collect()}
    at = 100
    for seq, n in rows:
        assert got[seq] == at
        at += n


def test_empty_raster(spark, tmp_path):
    none = spark.createDataFrame([], "iy int, ix int, value double")
    out = writers.write_geotiff(none, str(tmp_path / "none.tif"), 40, 50, BOX, tile=16)
    assert np.isnan(whole(out)).all() and np.isnan(whole(out, 1)).all()


def test_overviews_are_chosen(spark, tmp_path):
    a, out = raster(256, 512, holes=False), str(tmp_path / "o.tif")
    writers.write_geotiff(cells_of(spark, a), out, 256, 512, (-180.0, -90.0, 180.0, 90.0), tile=32)
    data = engine.Dataset(spark, out)
    v = data.variable(None)
    for (width, height), level in {(512, 256): 0, (511, 256): 0, (256, 128): 1, (200, 100): 1, (128, 64): 2, (64, 32): 3, (10, 5): 4, (512, 20): 0}.items():
        chosen = data.at_pixels(v, (-180.0, -90.0, 180.0, 90.0), width, height)
        assert chosen.path.partition("#overview=")[2] == (str(level) if level else ""), (width, height)
    grid = data.extract_grid(None, (-180.0, -90.0, 180.0, 90.0), 128, 64)
    np.testing.assert_allclose(grid.to_array(), means(a, 4), rtol=1e-6)
    # A window of the same pixels as the file's reads the file's own image.
    near = data.extract_grid(None, (-180.0, 45.0, -90.0, 90.0), 128, 64).to_array()
    np.testing.assert_array_equal(near, a[:64, :128])
