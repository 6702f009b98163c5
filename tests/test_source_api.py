"""The data source, the command line and job tags."""

import numpy as np
import pytest
from gridloom.__main__ import main
from gridloom.plans import engine
from gridloom.sources import datasource, netcdf3, zarr


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    path = tmp_path_factory.mktemp("api") / "s.zip"
    a = np.arange(96, dtype=np.float32).reshape(4, 4, 6)
    axes = {"time": (np.arange(4.0), ["time"], {"units": "days since 2020-01-01"}), "lat": (np.arange(4.0), ["lat"], {}), "lon": (np.arange(6.0), ["lon"], {})}
    path.write_bytes(zarr.write_zip(axes | {"v": (a, ["time", "lat", "lon"], {}), "w": (a * 2, ["time", "lat", "lon"], {})}, chunks={"v": [2, 2, 3], "w": [4, 4, 6]}))
    return str(path), a


def test_data_source(spark, store):
    path, a = store
    datasource.register(spark)
    every = spark.read.format("grid").load(path)
    assert every.count() == 192
    few = spark.read.format("grid").option("variable", "v").load(path).where("t >= 2 and iy = 3 and ix < 2")
    assert few.rdd.getNumPartitions() == 1  # of eight blocks
    assert sorted((r.t, r.ix, r.value) for r in few.collect()) == [(t, x, float(a[t, 3, x])) for t in (2, 3) for x in (0, 1)]
    assert spark.read.format("grid").option("variable", "v").load(path).where("t > 10").count() == 0
    assert every.where("variable = 'w' and t = 1").agg({"value": "sum"}).first()[0] == float(a[1].sum() * 2)


def test_command_line(spark, store, tmp_path, capsys):
    path, a = store
    assert main(["detect", path]) == 0 and capsys.readouterr().out.strip() == "zarr"
    assert main(["point", path, "--variable", "v", "--lat", "1.2", "--lon", "2.1", "--t1", "1", "--t2", "2", "--out", str(tmp_path / "p.csv")]) == 0
    assert (tmp_path / "p.csv").read_text().splitlines()[1:] == [f"v,2020-01-0{t + 1}T00:00:00Z,{float(a[t, 1, 2])},1.0,2.0" for t in (1, 2)]
    assert main(["grid", path, "--variable", "v", "--box", "-0.5", "-0.5", "5.5", "3.5", "--size", "6", "4", "--format", "nc", "--date", "2020-01-04", "--out", str(tmp_path / "g.nc")]) == 0
    reader = netcdf3.NetCDF3Reader(__import__("gridloom.sources.files", fromlist=["x"]).ByteSource(str(tmp_path / "g.nc")))
    v = reader.variables()[0]
    assert np.array_equal(reader.read(v, reader.blocks(v)[0])[0], a[3][::-1])
    assert main(["trim", path, "--variable", "w", "--out", str(tmp_path / "t.zip")]) == 0 and engine.Dataset(spark, str(tmp_path / "t.zip")).names() == ["w"]


def test_tags_and_image(spark, store):
    path, _ = store
    with engine.cancellable(spark, "some-query"):
        assert "some-query" in spark.getTags()
        image = engine.grid_to_image(engine.Dataset(spark, path).extract_grid("v", (-0.5, -0.5, 5.5, 3.5), 6, 4))
    data = engine.Dataset(spark, path)
    assert engine.extract_grid_output(data, "png", variable="v", box=(-0.5, -0.5, 5.5, 3.5), width=6, height=4) == image
    assert engine.extract_output(data, "csv", variable="v", lat=1, lon=2).count(b"\n") == 5
    assert image.startswith(b"\x89PNG") and "some-query" not in spark.getTags()
