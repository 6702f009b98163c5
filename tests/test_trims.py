"""Trims by tasks give the bytes of trims on the driver."""

import os

import numpy as np
import pytest
from gridloom.errors import TrimError
from gridloom.plans import engine, file_queries
from gridloom.sources import assembly, geotiff, grids, zarr
from gridloom.sources.files import put

NT, NY, NX = file_queries.DAYS, file_queries.NY, file_queries.NX


@pytest.fixture(scope="module")
def array():
    a = np.random.default_rng(5).normal(size=(NT, NY, NX)).astype("f4").round(1)
    a[3:5, 2:4] = np.nan
    return a


@pytest.mark.parametrize("fmt", ["grib2", "netcdf3", "netcdf3_records", "netcdf3_packed"])
@pytest.mark.parametrize("positional", [True, False])
def test_same_bytes(spark, tmp_path, array, fmt, positional, monkeypatch):
    make, whole, _ = file_queries.FORMATS[fmt]
    path = put(str(tmp_path / "in"), make(np.floor(array) if whole else array))
    real = assembly.assemble
    monkeypatch.setattr(assembly, "assemble", lambda pieces, size, out: real(pieces, size, out, positional))
    name = file_queries.first_variable(path)
    for options in ({"t1": 2, "t2": 7}, {"variables": [name]}, {"variables": [name], "t1": 30}, {}):
        made = engine.trim_to(spark, path, str(tmp_path / "out"), **options)
        assert (tmp_path / "out").read_bytes() == engine.trim(path, **options).data and made.stats["variables_after"] >= 1
    assert sorted(os.listdir(tmp_path)) == ["in", "out"]


@pytest.mark.parametrize(("compress", "predictor", "dtype"), [(True, 3, "f4"), (True, 2, "u2"), (False, 1, "i2")])
def test_geotiff(spark, tmp_path, array, compress, predictor, dtype):
    a = np.nan_to_num(array[:2], nan=-1).astype(dtype)
    path = put(str(tmp_path / "in.tif"), geotiff.write(a, file_queries.BOX, ["one", "two & 2"], compress, predictor, nodata=-1, rows_per_strip=3))
    for options in ({"variables": ["two & 2"]}, {"box": (-60.0, -30.0, 60.0, 60.0)}, {"variables": ["one"], "box": (100.0, -80.0, 170.0, -70.0)}, {}):
        engine.trim_to(spark, path, str(tmp_path / "out.tif"), **options)
        assert (tmp_path / "out.tif").read_bytes() == engine.trim(path, **options).data
    assert sorted(os.listdir(tmp_path)) == ["in.tif", "out.tif"]


def test_zarr(spark, tmp_path, array):
    path = put(str(tmp_path / "in.zip"), file_queries.FORMATS["zarr_chunked"][0](array))
    for options in ({"t1": 6, "t2": 9}, {"variables": ["v"], "t1": 5, "t2": 9, "box": (-50.0, -20.0, 50.0, 20.0)}, {}):
        made = engine.trim_to(spark, path, str(tmp_path / "out"), **options)
        small = put(str(tmp_path / "small.zip"), (wanted := engine.trim(path, **options)).data)
        assert made.warnings == wanted.warnings
        results = []
        for where in (str(tmp_path / "out"), small):
            _, reader = grids.open_reader(where)
            v = reader.variables()[0]
            out = np.full(v.shape, -9e9, "f4")
            for b in reader.blocks(v):
                out[b.t : b.t + b.nt, b.y : b.y + b.ny, b.x : b.x + b.nx] = reader.read(v, b)
            results.append((v.name, v.units, v.y, v.x, v.times, out))
        assert results[0][:5] == results[1][:5]
        np.testing.assert_array_equal(results[0][5], results[1][5])
    assert isinstance(zarr.FolderStore(str(tmp_path / "out")).get("v/.zarray"), bytes)


def test_only_kept_ranges_are_read(spark, tmp_path, array, monkeypatch):
    """The source is cut off behind what is kept: reading more would fail."""
    path = put(str(tmp_path / "in"), file_queries.FORMATS["grib2"][0](np.floor(array)))
    from gridloom.sources import grib2
    from gridloom.sources.files import ByteSource

    kept = grib2.kept_ranges(ByteSource(path), None, 0, 2)
    assert len(kept) == 1 and kept[0][1] < os.path.getsize(path) / 5
    wanted = engine.trim(path, t1=0, t2=2).data
    plan = monkeypatch.setattr(grib2, "kept_ranges", lambda *_: kept)
    assert plan is None
    short = put(str(tmp_path / "short"), open(path, "rb").read()[: sum(kept[-1])])
    engine.trim_to(spark, short, str(tmp_path / "out"), t1=0, t2=2)
    assert (tmp_path / "out").read_bytes() == wanted


def test_refused(spark, tmp_path, array):
    path = put(str(tmp_path / "in"), file_queries.FORMATS["grib2"][0](np.floor(array)))
    for options in ({"box": (0, 0, 1, 1)}, {"t1": 3, "t2": 2}):
        with pytest.raises(TrimError):
            engine.trim_to(spark, path, str(tmp_path / "out"), **options)
    assert os.listdir(tmp_path) == ["in"]
