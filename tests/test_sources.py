"""Formats by round trip and by closed-form content: t, y, x -> 280 + 5 t + y + 0.5 x."""

import json
import struct
import zlib

import numpy as np
import pytest
from gridloom.errors import TrimError, UnsupportedExportError, UnsupportedFormatError, VariableNotFoundError
from gridloom.plans import engine
from gridloom.sources import codecs, encoders, geotiff, grib2, grids, hdf5, netcdf3, references, zarr
from gridloom.sources.detect import detect_files, detect_format
from gridloom.sources.files import ByteSource
from gridloom.sources.model import Variable, find
from pyspark.sql import functions as F

LATS, LONS = [30.0, 31.0, 32.0, 33.0], [-95.0, -94.0, -93.0, -92.0, -91.0]
CUBE = (280 + 5 * np.arange(3)[:, None, None] + np.arange(4)[None, :, None] + 0.5 * np.arange(5)[None, None, :]).astype(np.float32)
TIME = {"units": "hours since 2020-01-01 00:00:00", "axis": "T"}
AXES = {"time": (["time"], np.array([0, 6, 12], np.float32), TIME), "lat": (["lat"], np.array(LATS, np.float32), {"units": "degrees_north"}), "lon": (["lon"], np.array(LONS, np.float32), {"units": "degrees_east"})}
OWN = {"units": "K", "long_name": "Air Temperature"}


def nc3(record=None):
    return netcdf3.write({"time": 3, "lat": 4, "lon": 5}, AXES | {"temperature": (["time", "lat", "lon"], CUBE, OWN)}, {"Conventions": "CF-1.6"}, record)


def zarr_zip(**options):
    return zarr.write_zip({n: (a, d, at) for n, (d, a, at) in AXES.items()} | {"temperature": (CUBE, ["time", "lat", "lon"], OWN)}, **options)


def h5():
    return hdf5.write({n: (a, d, at) for n, (d, a, at) in AXES.items()} | {"temperature": (CUBE, ["time", "lat", "lon"], OWN)}, {"title": "test"})


FILES = {
    "netcdf3": nc3, "netcdf3-records": lambda: nc3("time"), "netcdf4": h5, "zarr": zarr_zip,
    "zarr-chunked": lambda: zarr_zip(chunks={"temperature": [2, 3, 2]}, level=3),
    "refs": lambda: references.write_refs_v1(Variable("temperature", (3, 4, 5), LATS, LONS, [1577836800 + 21600 * k for k in range(3)], "K"), CUBE),
    "grib2": lambda: b"".join(grib2.encode(CUBE[t], LATS, LONS, (0, 0, 0), 1577836800 + 21600 * t) for t in range(3)),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("grids")
    for name, make in FILES.items():
        (root / name).write_bytes(make())
    return root


@pytest.mark.parametrize("name", list(FILES))
def test_reader(name):
    _, reader = grids.open_reader(FILES[name]())
    v = next(v for v in reader.variables() if v.name.lower() == "temperature")
    assert v.shape == (3, 4, 5) and v.units == "K"
    assert np.allclose(v.y, LATS) and np.allclose(np.mod(v.x, 360), np.mod(LONS, 360))
    assert v.times == [1577836800 + 21600 * k for k in range(3)]
    got = np.full((3, 4, 5), np.nan)
    for b in reader.blocks(v):
        got[b.t : b.t + b.nt, b.y : b.y + b.ny, b.x : b.x + b.nx] = reader.read(v, b)
    assert np.allclose(got, CUBE, rtol=1e-5)
    assert v.bbox() == pytest.approx((-95, 30, -91, 33))


@pytest.mark.parametrize("name", list(FILES))
def test_engine(spark, folder, name):
    data = engine.Dataset(spark, str(folder / name))
    variable = next(n for n in data.names() if n.lower() == "temperature")
    rows = sorted((r.t, r.time.isoformat(), r.lat, r.lon % 360, r.value) for r in data.extract(variable, 31.4, 266.8).collect())
    assert [r[4] for r in rows] == pytest.approx([282, 287, 292], rel=1e-5) and rows[1][1].startswith("2020-01-01T06") and rows[0][2:4] == pytest.approx((31, 267))
    one = data.extract(variable, 31.5, -93.0, date="2020-01-01T03:00Z").collect()  # ties: the lower index
    assert [(r.t, r.value) for r in one] == [(0, pytest.approx(282, rel=1e-5))]
    assert {r.t for r in data.extract(variable, 31, -93, dates=("2020-01-01", "2020-01-01")).collect()} == {0, 1, 2}
    assert {r.t for r in data.extract(variable, 31, -93, dates=("2019-01-01", "2019-01-02")).collect()} == {0}
    grid = data.extract_grid(variable, (-95.5, 29.5, -90.5, 33.5), 5, 4, t=2)
    assert np.allclose(grid.to_array(), CUBE[2][::-1], rtol=1e-5)
    with pytest.raises(VariableNotFoundError):
        data.variable("nothing")


def test_scan_and_stats(spark, folder):
    rows = engine.Dataset(spark, str(folder / "netcdf3")).scan().collect()
    assert [(r.format, r.variable, r["shape"], r.min_lon, r.max_lat, len(r.times)) for r in rows] == [("netcdf3", "temperature", [3, 4, 5], -95.0, 33.0, 3)]
    from gridloom.operators.statistics import summarize

    s = summarize(grids.decode(grids.blocks(spark, [str(folder / "netcdf3")]))).first()
    assert (s.n, s.min, s.max, s.mean) == (60, 280, 295, 287.5) and s["std"] == pytest.approx(4.291464, abs=1e-6)


def test_pruning(spark, folder):
    every = grids.blocks(spark, [str(folder / "zarr-chunked")])
    few = grids.overlapping(every, ["temperature"], (2, 2), (0, 0), (4, 4))
    assert (every.count(), few.count()) == (12, 1)
    assert sorted(r.value for r in grids.decode(few).where("t = 2 and iy = 0 and ix = 4").collect()) == [292.0]


def test_detect(spark, folder):
    found = {r.path.rsplit("/", 1)[1]: r.format for r in detect_files(spark, str(folder)).collect()}
    assert found == {n: None if n == "refs" else n.split("-")[0] for n in FILES}
    assert detect_format(b"PAR1....") is None and detect_format(b"PAR1PAR1") == "parquet" and detect_format(b"") is None


@pytest.mark.parametrize("fmt", ["json", "csv", "parquet", "geotiff", "netcdf3", "netcdf4", "zarr", "grib2"])
def test_export_grid(spark, folder, fmt):
    grid = engine.Dataset(spark, str(folder / "netcdf3")).extract_grid("temperature", (-95.5, 29.5, -90.5, 33.5), 5, 4, t=1)
    data = engine.encode_grid(grid, fmt)
    wanted = CUBE[1][::-1]
    if fmt == "json":
        assert np.allclose(json.loads(data)["data"], wanted.ravel())
    elif fmt == "csv":
        assert data.decode().splitlines()[:2] == ["variable,lat,lon,value", "temperature,33.0,-95.0,288.0"]
    elif fmt == "parquet":
        import io

        import pyarrow.parquet as pq

        assert np.allclose(pq.read_table(io.BytesIO(data))["value"].to_numpy(), wanted.ravel())
    else:
        _, reader = grids.open_reader(data)
        v = reader.variables()[0]
        got = np.concatenate([reader.read(v, b).reshape(-1, 5) for b in reader.blocks(v)])
        assert np.allclose(got, wanted, rtol=1e-5) and np.allclose(v.y, LATS[::-1])


@pytest.mark.parametrize("fmt", ["json", "csv", "parquet", "netcdf3", "netcdf4", "zarr"])
def test_export_series(spark, folder, fmt):
    rows = engine.Dataset(spark, str(folder / "netcdf3")).extract("temperature", 31, -93)
    data = engine.encode_series(rows, fmt)
    if fmt == "json":
        assert [p["value"] for p in json.loads(data)["timeseries"]] == [282, 287, 292]
    elif fmt == "csv":
        assert data.decode().splitlines()[1] == "temperature,2020-01-01T00:00:00Z,282.0,31.0,-93.0"
    elif fmt in ("netcdf3", "netcdf4", "zarr"):
        _, reader = grids.open_reader(data)
        v = find(reader.variables(), "temperature")
        assert [float(reader.read(v, b).ravel()[0]) for b in reader.blocks(v)] == [282, 287, 292] or reader.read(v, reader.blocks(v)[0]).ravel().tolist() == [282, 287, 292]
    with pytest.raises(UnsupportedExportError):
        engine.encode_series(rows, "geotiff")
    with pytest.raises(UnsupportedExportError):
        engine.encode_series(rows, "pdf")


@pytest.mark.parametrize("name", ["netcdf3", "netcdf3-records", "netcdf4", "zarr-chunked", "grib2"])
def test_trim(folder, name):
    cut = engine.trim(str(folder / name), t1=1, t2=1)
    _, reader = grids.open_reader(cut.data)
    v = reader.variables()[0]
    got = np.concatenate([reader.read(v, b).ravel() for b in reader.blocks(v)])
    assert v.shape[0] == (2 if name == "zarr-chunked" else 1) and (cut.stats["bytes_after"] < cut.stats["bytes_before"] or name == "zarr-chunked")
    assert np.isin(np.round(CUBE[1], 2), np.round(got, 2)).all()
    if name == "zarr-chunked":
        assert cut.warnings
    if name in ("grib2", "netcdf3"):
        with pytest.raises(TrimError):
            engine.trim(str(folder / name), box=(-95, 30, -94, 31))


@pytest.mark.parametrize("dtype", ["u1", "u2", "i2", "f4"])
@pytest.mark.parametrize(("compress", "predictor"), [(False, 1), (True, 1), (True, 2), (True, 3)])
def test_geotiff(dtype, compress, predictor):
    if predictor == 3 and dtype != "f4" or predictor == 2 and dtype == "f4":
        pytest.skip("no such predictor for the type")
    bands = np.stack([np.arange(12).reshape(3, 4), np.arange(12)[::-1].reshape(3, 4)]).astype(dtype)
    data = geotiff.write(bands, (-10, 40, 30, 70), ["one", "two & three"], compress, predictor, rows_per_strip=2)
    _, reader = grids.open_reader(data)
    one, two = reader.variables()
    assert (one.name, two.shape, one.y, one.x) == ("one", (1, 3, 4), [65, 55, 45], [-5, 5, 15, 25])
    for v, band in ((one, bands[0]), (two, bands[1])):
        assert np.array_equal(np.concatenate([reader.read(v, b)[0] for b in reader.blocks(v)]), band.astype("f4"))
    small, _ = geotiff.trim(ByteSource(data), ["two & three"], (-10, 52, 5, 70))
    assert np.array_equal(grids.open_reader(small)[1].main.block(0, 0, 0), bands[1][:2])


def lzw_encode(data):
    """Literal codes only, cleared before the codes grow: enough to test a decoder."""
    bits = ""
    for k in range(0, len(data), 200):
        bits += f"{256:09b}" + "".join(f"{b:09b}" for b in data[k : k + 200])
    bits += f"{257:09b}"
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_codecs():
    data = bytes(range(256)) * 3
    assert codecs.lzw(lzw_encode(data)) == data
    assert codecs.packbits(b"\x02abc\xfed\x80\x00e") == b"abcddde"
    a = np.arange(100, dtype="<f4")
    shuffled = a.view(np.uint8).reshape(-1, 4).T.tobytes()
    assert codecs.unshuffle(shuffled, 4) == a.tobytes()
    for codec, pack in ((3, zlib.compress), (1, lambda b: __import__("pyarrow").compress(b, "lz4_raw", asbytes=True)), (4, lambda b: __import__("zstandard").compress(b))):
        packed = pack(shuffled)
        frame = struct.pack("<BBBBIII", 2, 1, 1 | 0x10 | codec << 5, 4, 400, 400, 0) + struct.pack("<Ii", 20, len(packed)) + packed
        assert codecs.Blosc(frame).decode() == a.tobytes()
    assert codecs.blosclz(bytes([2]) + b"abc" + bytes([(3 << 5) | 0, 2]), 8) == b"abcabcab"


def spatially_packed(values, order):
    """Template 5.3 by hand: one group an element run of 4."""
    x = np.array(values, np.int64)
    diffs = np.diff(x, order)
    low = int(diffs.min())
    stored = np.concatenate([np.zeros(order, np.int64), diffs - low])
    groups = [stored[k : k + 4] for k in range(0, len(stored), 4)]
    put = lambda vals, width: np.packbits(np.array([[v >> b & 1 for b in range(width - 1, -1, -1)] for v in vals], np.uint8)).tobytes() if width else b""
    magnitude = lambda v: ((abs(v) | 1 << 15) if v < 0 else v).to_bytes(2, "big")
    refs = [int(g.min()) for g in groups]
    widths = [int(g.max() - g.min()).bit_length() for g in groups]
    bits = "".join(f"{v - r:0{w}b}" for g, r, w in zip(groups, refs, widths, strict=True) if w for v in g.tolist())
    bits += "0" * (-len(bits) % 8)
    data = b"".join(magnitude(int(v)) for v in [*x[:order], low]) + put(refs, 10) + put(widths, 5) + put([0] * len(groups), 3)
    data += int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""
    s5 = struct.pack(">IBIHfHHBB", 49, 5, len(x), 3, 10.0, 0, 0x8001, 10, 0) + struct.pack(">BBIIIBBIBIBBB", 1, 0, 0, 0, len(groups), 0, 5, 4, 1, len(groups[-1]), 3, order, 2)
    return s5, data


@pytest.mark.parametrize("order", [1, 2])
def test_grib_complex(order):
    values = [50, 52, 57, 55, 40, 43, 44, 70, 71, 75, 3]
    s5, data = spatially_packed(values, order)
    assert grib2.complex_integers(data, s5, len(values), 10).tolist() == values


@pytest.mark.parametrize("order", [1, 2])
def test_grib_differences_round_trip(order):
    """Smooth and rough fields, gaps, one value, two values; smaller than simple packing where the field is smooth."""
    rng = np.random.default_rng(3)
    y, x = np.mgrid[:40, :60]
    lats, lons = np.linspace(60, 20, 40).tolist(), np.linspace(0, 59, 60).tolist()
    smooth = np.round(900 + 50 * np.sin(x / 9) + 40 * np.cos(y / 7))
    rough, holes = rng.integers(-500, 70_000, (40, 60)).astype(float), smooth.copy()
    holes[rng.random(holes.shape) < 0.3] = np.nan
    two = np.full((40, 60), np.nan)
    two[3, 4], two[9, 9] = 5, 700
    for field in (smooth, rough, holes, two, two * 0 + 4):
        data = grib2.encode(field, lats, lons, order=order)
        _, reader = grids.open_reader(data)
        v = reader.variables()[0]
        np.testing.assert_array_equal(reader.read(v, reader.blocks(v)[0])[0], field.astype("f4"))
    noise = smooth + rng.random(smooth.shape)
    _, reader = grids.open_reader(grib2.encode(noise, lats, lons, order=order))
    v = reader.variables()[0]
    np.testing.assert_allclose(reader.read(v, reader.blocks(v)[0])[0], noise, atol=1e-4)
    assert len(grib2.encode(smooth, lats, lons, bits=12, order=order)) < len(grib2.encode(smooth, lats, lons, bits=12))


def test_grib_bitmap_and_levels():
    data = CUBE[0].copy()
    data[1, 2] = np.nan
    _, reader = grids.open_reader(grib2.encode(data, LATS, LONS, (0, 0, 0)) + grib2.encode(CUBE[0] * 0 + 7, LATS, LONS, (2, 0, 0)))
    first, second = reader.variables()
    assert {first.name, second.name} == {"Temperature", "Land cover (0 = sea, 1 = land)"}  # the discipline tells them apart
    got = reader.read(first, reader.blocks(first)[0])[0]
    assert np.isnan(got[1, 2]) and np.allclose(got[~np.isnan(data)], data[~np.isnan(data)], rtol=1e-6)
    assert (reader.read(second, reader.blocks(second)[0]) == 7).all()


def test_zarr_v3_sharded(tmp_path):
    """Shards of 4 x 4 with inner chunks of 2 x 2, the index at the end with a checksum's bytes."""
    a = np.arange(32, dtype="<f4").reshape(4, 8)
    root = tmp_path / "s.zarr"
    (root / "v/c/0").mkdir(parents=True)
    codecs_in = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip", "configuration": {"level": 1}}]
    meta = {"zarr_format": 3, "node_type": "array", "shape": [4, 8], "data_type": "float32", "fill_value": "NaN", "attributes": {"units": "K"}, "dimension_names": ["lat", "lon"], "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}}
    meta |= {"chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [4, 4]}}, "codecs": [{"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 2], "codecs": codecs_in, "index_codecs": [{"name": "bytes"}, {"name": "crc32c"}]}}]}
    (root / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group"}))
    (root / "v/zarr.json").write_text(json.dumps(meta))
    import gzip

    for c in range(2):
        body, index = b"", b""
        for i in range(2):
            for j in range(2):
                part = gzip.compress(a[2 * i : 2 * i + 2, 4 * c + 2 * j : 4 * c + 2 * j + 2].tobytes())
                index += struct.pack("<QQ", len(body), len(part)) if (c, i, j) != (1, 1, 1) else struct.pack("<QQ", 2**64 - 1, 2**64 - 1)
                body += part if (c, i, j) != (1, 1, 1) else b""
        (root / f"v/c/0/{c}").write_bytes(body + index + b"\0\0\0\0")
    reader = zarr.ZarrReader(zarr.FolderStore(str(root)))
    v = reader.variables()[0]
    got = np.concatenate([reader.read(v, b)[0] for b in reader.blocks(v)], axis=1)
    assert np.isnan(got[2:, 6:]).all() and np.array_equal(got[:, :6], a[:, :6])


def test_references(spark, tmp_path):
    import io
    import zipfile

    store = zipfile.ZipFile(io.BytesIO(zarr_zip(chunks={"temperature": [1, 4, 5]})))
    data = store.read("temperature/1.0.0")
    (tmp_path / "far.bin").write_bytes(b"junk" + data)
    rows = [(n, None if n == "temperature/1.0.0" else bytearray(store.read(n)), str(tmp_path / "far.bin") if n == "temperature/1.0.0" else None, 4, len(data)) for n in store.namelist()]
    spark.createDataFrame(rows, references.REFERENCE).write.parquet(str(tmp_path / "refs"))
    reader = references.open_references(references.read_references(spark, str(tmp_path / "refs")))
    v = find(reader.variables(), "temperature")
    assert np.array_equal(np.concatenate([reader.read(v, b) for b in reader.blocks(v)]), CUBE)
    text = {"refs": {n: store.read(n).decode() if n.rsplit("/", 1)[-1].startswith(".z") else "base64:" + __import__("base64").b64encode(store.read(n)).decode() for n in store.namelist()}}
    text["refs"]["temperature/1.0.0"] = [str(tmp_path / "far.bin"), 4, len(data)]
    (tmp_path / "refs.json").write_text(json.dumps(text))
    reader = references.open_references(references.references_from_json(spark, str(tmp_path / "refs.json")))
    assert np.array_equal(np.concatenate([reader.read(v, b) for b in reader.blocks(v)]), CUBE)


def test_packed_and_missing():
    raw = np.array([[[1, 2], [-99, 4]]], np.int16)
    data = netcdf3.write({"time": 1, "lat": 2, "lon": 2}, {"v": (["time", "lat", "lon"], raw, {"scale_factor": 0.5, "add_offset": 10.0, "_FillValue": np.int16(-99)})})
    _, reader = grids.open_reader(data)
    v = reader.variables()[0]
    assert np.array_equal(reader.read(v, reader.blocks(v)[0]), [[[10.5, 11], [np.nan, 12]]], equal_nan=True)


def test_png_and_errors(tmp_path):
    pixels = encoders.rgba(np.array([[0, 0.5], [1, np.nan]], np.float32), "viridis")
    assert pixels[0, 1].tolist() == [38, 130, 142, 255] and pixels[1, 1].tolist() == [0, 0, 0, 0]
    assert encoders.rgba(np.array([[0.5]]), [(0, (0, 0, 0)), (1, (255, 0, 0))], 0, 1)[0, 0].tolist() == [128, 0, 0, 255]
    data = encoders.png(pixels)
    assert data.startswith(b"\x89PNG") and data.endswith(b"IEND\xaeB`\x82")
    with pytest.raises(UnsupportedFormatError):
        grids.open_reader(b"nonsense bytes")


def test_text_sinks(spark, folder, tmp_path):
    from gridloom.sources import sinks

    rows = engine.Dataset(spark, str(folder / "netcdf3")).extract("temperature", 31, -93).select("variable", "t", "value")
    sinks.write_csv(rows, str(tmp_path / "csv"), ("t",))
    assert [r.value for r in spark.read.csv(str(tmp_path / "csv"), header=True, inferSchema=True).orderBy("t").collect()] == [282.0, 287.0, 292.0]
    sinks.write_parquet(rows, str(tmp_path / "pq"), {"value": "K"})
    assert spark.read.parquet(str(tmp_path / "pq")).schema["value"].metadata == {"units": "K"}
    sinks.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    features = rows.select(sinks.feature(F.lit(-93.0), F.lit(31.0), F.struct("t", "value")).alias("feature"))
    assert len(json.loads(sinks.feature_collection(features))["features"]) == 3


def section3(template, body):
    return struct.pack(">IBBIBBH", 0, 3, 0, 0, 0, 0, template) + body


def test_grib_projected_grids():
    """A known Lambert grid (3 km, North America) and a polar one, by their published corners."""
    micro = lambda v: int(round(v * 1e6))
    sphere = struct.pack(">BBIBIBI", 6, 0, 0, 0, 0, 0, 0)
    body = sphere + struct.pack(">IIIIBIIIIBB", 1799, 1059, micro(21.138123), micro(237.280472), 8, micro(38.5), micro(262.5), 3_000_000, 3_000_000, 0, 64)
    y, x, crs = grib2.grid(grib2.Message(0, 0, 0, {3: section3(30, body + struct.pack(">IIII", micro(38.5), micro(38.5), 0, 0))}))
    assert (x[0], y[0], x[-1], y[-1]) == pytest.approx((-2697520.14, -1587306.15, 2696479.86, 1586693.85), abs=1)
    from gridloom.functions.projections import CRS

    assert CRS(**crs).inverse(x[0], y[0]) == pytest.approx((21.138123, 237.280472))
    body = sphere + struct.pack(">IIIIBIIIIBB", 135, 95, micro(30.0), micro(187.0), 8, micro(60.0), micro(225.0), 45_000_000, 45_000_000, 0, 64)
    y, x, crs = grib2.grid(grib2.Message(0, 0, 0, {3: section3(20, body)}))
    lat, lon = CRS(**crs).inverse(x[0], y[0])
    assert crs["north"] and (lat, lon % 360) == pytest.approx((30.0, 187.0)) and len(x) == 135 and y[1] - y[0] == 45_000
    values = np.arange(6.0)
    message = grib2.Message(0, 0, 0, {3: section3(0, sphere + struct.pack(">IIIIIIBIIIIB", 3, 2, 0, 0, micro(10), micro(0), 48, micro(0), micro(20), micro(10), micro(10), 16))})
    assert grib2.ordered(values, message).tolist() == [[0, 1, 2], [5, 4, 3]]  # every other row runs back
    assert grib2.grid(message)[:2] == ([10.0, 0.0], [0.0, 10.0, 20.0])
