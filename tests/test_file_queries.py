"""Every query over files against its SQL, http(s) sources, and indices read by tasks."""

import http.server
import threading

import numpy as np
import oracle
import pytest
from gridloom.errors import SourceError
from gridloom.plans import catalogue, engine, file_queries
from gridloom.sources import files, grids, hdf5, netcdf3
from gridloom.sources.files import ByteSource

NAMES = [n for n in file_queries.QUERIES if n.startswith(("file_", "export_", "codec_"))]


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    assert not oracle.differences(file_queries.QUERIES[name](spark, sf), con, file_queries.SQL[name])


def test_entry_registers_whole_tables():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert names >= set(NAMES) and not names & set(__spark_entry__.SUBSETS) and {f"{n}_all" for n in __spark_entry__.SUBSETS} <= names
    assert {n for n in names if n in catalogue.QUERIES} <= set(__spark_entry__.oracle_sql())


class Server(http.server.BaseHTTPRequestHandler):
    data, ranges, failures = b"", True, 0
    asked: list[str] = []

    def do_GET(self):
        if Server.failures:
            Server.failures -= 1
            self.send_error(503)
            return
        if self.path == "/missing":
            self.send_error(404)
            return
        wanted = self.headers.get("Range")
        Server.asked.append(wanted or "")
        body, data = Server.data, Server.data
        if wanted and Server.ranges:
            low, high = wanted.removeprefix("bytes=").split("-")
            body = data[int(low) : int(high) + 1]
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {low}-{int(low) + len(body) - 1}/{len(data)}")
        else:
            self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    own = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    Server.data, Server.ranges, Server.failures, Server.asked = bytes(range(256)) * 8, True, 0, []
    yield f"http://127.0.0.1:{own.server_address[1]}"
    own.shutdown()


@pytest.mark.parametrize("ranges", [True, False])
def test_http_ranges(server, ranges, monkeypatch):
    Server.ranges = ranges
    monkeypatch.setattr(files.CACHE, "capacity", 0)
    source = ByteSource(f"{server}/a")
    assert source.size == 2048 and source.read(1000, 9) == Server.data[1000:1009] and source.tail(4) == Server.data[-4:] and source.all() == Server.data
    assert ("bytes=1000-1008" in Server.asked) == ranges
    with pytest.raises(SourceError):
        source.read(2040, 9)


def test_http_failures(server):
    Server.failures = 2
    assert ByteSource(f"{server}/a").size == 2048  # tried again
    with pytest.raises(SourceError):
        ByteSource(f"{server}/missing")


def test_grid_file_over_http(spark, sf, server):
    """Only what a query needs of a file goes over the wire."""
    a = file_queries.cube(spark, sf)
    Server.data = netcdf3.write(file_queries.SIZES | {"far": 500_000}, file_queries.AXES | {"v": (file_queries.DIMS, a, {}), "other": (["far"], np.zeros(500_000, "f4"), {})})
    rows = grids.decode(grids.blocks(spark, [f"{server}/a.nc"], ["v"], (4, 4)), 1).where("value is not null").collect()
    assert {(r.iy, r.ix, r.value) for r in rows} == {(y, x, float(a[4, y, x])) for y in range(12) for x in range(24) if a[4, y, x] == a[4, y, x]}
    moved = sum(int(w.split("-")[1]) - int(w.removeprefix("bytes=").split("-")[0]) + 1 for w in Server.asked if w)
    assert moved < len(Server.data) / 4


def test_cache_saves_requests(server, monkeypatch):
    """An HDF5 file's many short reads, and its data read twice, with and without pages."""
    a = np.random.default_rng(1).normal(size=(40, 60, 50)).astype("f4")
    axes = {"time": (np.arange(40.0), ["time"], file_queries.TIME), "lat": (np.linspace(50, -50, 60), ["lat"], {"units": "degrees_north"}), "lon": (np.arange(50.0), ["lon"], {"units": "degrees_east"})}
    Server.data = hdf5.write(axes | {"v": (a, ["time", "lat", "lon"], {})})
    asked, moved = {}, {}
    for capacity in (0, 1 << 20):
        monkeypatch.setattr(files, "CACHE", files.PageCache(capacity))
        Server.asked.clear()
        before = files.TALLY.bytes
        for _ in range(2):
            _, reader = grids.open_reader(f"{server}/a.nc")
            v = reader.variables()[0]
            for b in reader.blocks(v)[:3]:
                np.testing.assert_array_equal(reader.read(v, b), a[b.t : b.t + b.nt, b.y : b.y + b.ny, b.x : b.x + b.nx])
        asked[capacity], moved[capacity] = len(Server.asked), files.TALLY.bytes - before
    assert asked[1 << 20] * 4 < asked[0] and files.CACHE.held <= 1 << 20


def test_pages():
    cache, data, asked = files.PageCache(1000, 100), bytes(k % 251 for k in range(2345)), []

    def fetch(offset, length):
        asked.append((offset, length))
        return data[offset : offset + length]

    read = lambda offset, length: cache.read(("f", len(data), ""), offset, length, fetch)
    assert read(250, 10) == data[250:260] and read(210, 60) == data[210:270] and asked == [(200, 100)]
    assert read(150, 249) == data[150:399] and asked[1:] == [(100, 100), (300, 100)]
    assert read(2340, 5) == data[2340:] and asked[-1] == (2300, 45)
    assert read(1000, 900) == data[1000:1900] and asked[-1] == (1000, 900) and cache.held == 345  # passes by
    for k in range(20):
        assert read(100 * k, 7) == data[100 * k : 100 * k + 7]
    assert cache.held <= 1000 and read(0, 0) == b""
    before = len(asked)
    assert cache.read(("f", len(data), "new"), 1900, 5, fetch) == data[1900:1905] and len(asked) == before + 1


def test_progress_and_stop(spark):
    seen = []
    with engine.watched(spark, lambda done, known: seen.append((done, known)), every=0.05):
        assert spark.range(0, 1000, 1, 8).repartition(5).count() == 1000
    assert seen[-1][1] >= seen[-1][0] >= 13 and seen == sorted(seen)
    slow = spark.range(0, 8, 1, 8).mapInArrow(lambda batches: (__import__("time").sleep(2) or b for b in batches), "id long")
    with pytest.raises(Exception, match="(?i)cancel"):  # noqa: SIM117
        with engine.watched(spark, lambda done, known: known == 0, every=0.05):
            slow.collect()
    assert spark.range(5).count() == 5
