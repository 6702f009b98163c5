"""Files of any grid format as DataFrames: a catalogue of variables, a table of blocks, and the blocks' cells.

Blocks are rows; choosing variables, steps and areas is filtering rows, which Spark does before a byte of data is read.
What is left is dealt to tasks, each of which opens the files of its rows and streams their cells as Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import UnsupportedFormatError
from gridloom.sources import files
from gridloom.sources.detect import detect_format
from gridloom.sources.files import ByteSource, is_folder
from gridloom.sources.model import Block, Reader, Variable

BLOCKS = "path string, variable string, t int, nt int, y int, ny int, x int, nx int, token string"
CELLS = "path string, variable string, t int, iy int, ix int, value float"
CATALOG = (
    "path string, format string, variable string, units string, long_name string, dims array<string>, shape array<long>, times array<timestamp>, "
    "min_lon double, min_lat double, max_lon double, max_lat double, crs string, supported boolean, warnings array<string>, attrs map<string,string>"
)
#: Rows in a batch of cells.
BATCH = 1 << 18


def overview_of(path: str) -> tuple[str, int]:
    """A path without its overview, and that."""
    plain, mark, level = path.rpartition("#overview=")
    return (plain, int(level)) if mark and level.isdigit() else (path, 0)


def open_reader(source: ByteSource | str | bytes) -> tuple[str, Reader]:
    """(format, reader) of a grid file; ``path#overview=k`` is the k-th overview of a GeoTIFF."""
    from gridloom.sources import geotiff, grib2, hdf5, netcdf3, references, zarr

    overview = 0
    if isinstance(source, str):
        source, overview = overview_of(source)

    if isinstance(source, str) and is_folder(source):  # a store of many files, or an index
        folder = source.rstrip("/")
        return ("references", references.open_index(folder)) if folder.endswith(".refs") else ("zarr", zarr.ZarrReader(zarr.FolderStore(folder)))
    source = source if isinstance(source, ByteSource) else ByteSource(source)
    kind = detect_format(source)
    if kind is None and source.head(1) == b"{":
        if (found := json.loads(source.all())).get("refs") is not None:
            return "references", references.open_json(found, source.uri.rpartition("/")[0] + "/")
        return "refs", references.RefsV1Reader(source, source.uri.rpartition("/")[0] + "/")
    makers = {"grib2": grib2.Grib2Reader, "netcdf3": netcdf3.NetCDF3Reader, "tiff": lambda s: geotiff.GeoTiffReader(s, overview), "zarr": lambda s: zarr.ZarrReader(zarr.ZipStore(s)), "netcdf4": hdf5.Hdf5Reader}
    if kind not in makers:
        raise UnsupportedFormatError(f"{source.uri}: {kind or 'unknown format'} isn't a grid format")
    return kind, makers[kind](source)


@lru_cache(maxsize=8)
def _opened(path: str, size: int) -> tuple[Reader, dict[str, Variable]]:
    _, reader = open_reader(path)
    return reader, {v.name: v for v in reader.variables()}


def cached(path: str) -> tuple[Reader, dict[str, Variable]]:
    """A file's reader and variables, kept for the next blocks of the same task or worker."""
    plain, _ = overview_of(path)
    return _opened(path, 0 if is_folder(plain) else ByteSource(plain).size)


def _paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism)), "path")


def scan(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """One row for each variable of each file; files are opened in parallel where their rows are."""
    frame = paths if isinstance(paths, DataFrame) else _paths(spark, paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            *((n, pa.string()) for n in ("path", "format", "variable", "units", "long_name")), ("dims", pa.list_(pa.string())), ("shape", pa.list_(pa.int64())),
            ("times", pa.list_(pa.timestamp("us", "UTC"))), *((n, pa.float64()) for n in ("min_lon", "min_lat", "max_lon", "max_lat")), ("crs", pa.string()),
            ("supported", pa.bool_()), ("warnings", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())),
        ])
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                kind, reader = open_reader(path)
                for v in reader.variables():
                    west, south, east, north = v.bbox() or (None,) * 4
                    rows.append({
                        "path": path, "format": kind, "variable": v.name, "units": v.units, "long_name": v.long_name, "dims": list(v.dims), "shape": list(v.shape), "times": [round(t * 1e6) for t in v.times],
                        "min_lon": west, "min_lat": south, "max_lon": east, "max_lat": north, "crs": json.dumps(v.crs), "supported": v.supported, "warnings": v.warnings, "attrs": list(v.attrs.items()),
                    })
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return frame.select("path").mapInArrow(run, CATALOG)


Range = tuple[int, int] | None


def meets(first: int, n: int, chosen: Range) -> bool:
    return chosen is None or (first <= chosen[1] and first + n > chosen[0])


def blocks(spark: SparkSession, paths: list[str] | DataFrame, variables: list[str] | None = None, t: Range = None, y: Range = None, x: Range = None) -> DataFrame:
    """One row for each block of the supported variables, or of those named, that holds any of the index ranges. What is
    left out never becomes a row."""
    frame = paths if isinstance(paths, DataFrame) else _paths(spark, paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        types = [pa.string(), pa.string(), *[pa.int32()] * 6, pa.string()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                reader, found = cached(path)
                for v in found.values():
                    if not v.supported or (variables is not None and v.name not in variables):
                        continue
                    rows = [(path, v.name, *asdict(b).values()) for b in reader.blocks(v) if meets(b.t, b.nt, t) and meets(b.y, b.ny, y) and meets(b.x, b.nx, x)]
                    for at in range(0, len(rows), BATCH):
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows[at : at + BATCH], strict=True), types, strict=True)], names=names)

    return frame.select("path").mapInArrow(run, BLOCKS)


#: Cells that a task decodes at most, if blocks are smaller: 128 MB of values.
CELLS_PER_TASK = 1 << 25


def decode(chosen: DataFrame, partitions: int | None = None) -> DataFrame:
    """Cells of blocks: path, variable, t, iy, ix, value (null where missing). Blocks are dealt evenly first, to as many
    tasks as their cells need and no fewer than twice the cores."""
    spread = _spread(chosen, partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader, variables = cached(row["path"])
                variable = variables[row["variable"]]
                block = Block(*(row[k] for k in ("t", "nt", "y", "ny", "x", "nx", "token")))
                yield from cells(row["path"], variable.name, block, reader.read(variable, block))

    return spread.mapInArrow(run, CELLS)


def costs(chosen: DataFrame) -> DataFrame:
    """(path, variable, t, y, x, cells, requests, bytes) of every block: what reading it fetches, counted where it is read. Tallies
    are rows of a result, so that a task that runs twice counts once. What a worker's cache has, or a header that it holds, is free."""
    types = dict(zip(("path", "variable", "t", "y", "x", "cells", "requests", "bytes"), (pa.string(), pa.string(), *[pa.int32()] * 3, *[pa.int64()] * 3), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                reader, variables = cached(row["path"])
                block = Block(*(row[k] for k in ("t", "nt", "y", "ny", "x", "nx", "token")))
                requests, n = files.TALLY.requests, files.TALLY.bytes
                values = reader.read(variables[row["variable"]], block)
                out.append((row["path"], row["variable"], block.t, block.y, block.x, values.size, files.TALLY.requests - requests, files.TALLY.bytes - n))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.values(), strict=True)], names=list(types))

    spread = chosen.repartition(chosen.sparkSession.sparkContext.defaultParallelism * 2, "path", "variable", "t", "y", "x")
    return spread.mapInArrow(run, "path string, variable string, t int, y int, x int, cells long, requests long, bytes long")


def decode_files(frame: DataFrame) -> DataFrame:
    """Cells of whole files (path): for small files, or a stream of them; each file is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                _, reader = open_reader(path)
                for v in reader.variables():
                    if v.supported:
                        for block in reader.blocks(v):
                            yield from cells(path, v.name, block, reader.read(v, block))

    return frame.select("path").mapInArrow(run, CELLS)


def cells(path: str, name: str, block: Block, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    t, y, x = np.meshgrid(*(np.arange(a, a + n, dtype=np.int32) for a, n in zip((block.t, block.y, block.x), values.shape, strict=True)), indexing="ij")
    flat = np.ascontiguousarray(values, np.float32).ravel()
    for at in range(0, len(flat), BATCH):
        part = slice(at, at + BATCH)
        v, n = flat[part], len(flat[part])
        out = pa.array(v, pa.float32(), mask=~(np.abs(v) <= 1e37))
        yield pa.record_batch([pa.array([path] * n, pa.string()), pa.array([name] * n, pa.string()), *(pa.array(a.ravel()[part]) for a in (t, y, x)), out], names=[c.split()[0] for c in CELLS.split(", ")])


def overlapping(frame: DataFrame, variables: list[str] | None = None, t: tuple[int, int] | None = None, y: tuple[int, int] | None = None, x: tuple[int, int] | None = None) -> DataFrame:
    """Blocks that hold any of the index ranges."""
    if variables is not None:
        frame = frame.where(F.col("variable").isin(variables))
    for name, chosen in (("t", t), ("y", y), ("x", x)):
        if chosen is not None:
            frame = frame.where((F.col(name) <= chosen[1]) & (F.col(name) + F.col("n" + name) > chosen[0]))
    return frame


def normalize(spark: SparkSession, paths: list[str], out: str, variables: list[str] | None = None) -> None:
    """Any grid files as Parquet cells, one folder for each variable: later queries prune by Parquet statistics alone."""
    chosen = overlapping(blocks(spark, paths), variables)
    decode(chosen).sortWithinPartitions("t", "iy", "ix").write.mode("overwrite").partitionBy("variable").parquet(out)


def chunk_index(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """Where an HDF5 variable's chunks are stored: coords, address, size, filter_mask."""
    from gridloom.sources.hdf5 import Hdf5Reader

    _, refs = Hdf5Reader(ByteSource(path)).chunk_map(variable)
    rows = [(path, variable, list(map(int, r.coords)), r.address, r.size, r.filter_mask) for r in refs.values()]
    return spark.createDataFrame(rows, "path string, variable string, coords array<long>, address long, size long, filter_mask int")


def reduce_blocks(chosen: DataFrame, reducer, schema: str) -> DataFrame:
    """Bring your own reduction: ``reducer(variable, block, values)`` gives rows of ``schema`` for each block, and
    no cell leaves its task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader, variables = cached(row["path"])
                variable = variables[row["variable"]]
                block = Block(*(row[k] for k in ("t", "nt", "y", "ny", "x", "nx", "token")))
                if rows := list(reducer(variable, block, reader.read(variable, block))):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), wanted.types, strict=True)], names=wanted.names)

    return _spread(chosen, None).mapInArrow(run, schema)


def _spread(chosen: DataFrame, partitions: int | None) -> DataFrame:
    """Blocks dealt evenly, to as many tasks as their cells need and no fewer than twice the cores."""
    if partitions is None:
        cells_of = F.col("nt").cast("long") * F.col("ny") * F.col("nx")
        total = chosen.agg(F.sum(cells_of)).first()[0] or 0
        partitions = max(chosen.sparkSession.sparkContext.defaultParallelism * 2, -(-total // CELLS_PER_TASK))
    return chosen.repartition(partitions, "path", "variable", "t", "y", "x")
