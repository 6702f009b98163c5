"""Rasters and cubes of any size as Zarr stores, tiled GeoTIFF and NetCDF classic files, written by tasks.

Cells are dealt by chunk or tile; a task puts one together at a time, encodes and writes it, so that it holds one, whatever the
size of the whole. Nothing is seen under the final name before all of it is there. A cell without a row is missing; of rows for
one cell the greatest value counts.

Zarr: a data source (``df.write.format("grid")``). Tasks write chunks below a staging folder; the commit writes the metadata and
renames the folder, an abort removes it. Chunks without values aren't written.

GeoTIFF: tasks append encoded tiles to part files and give back where each is. Prefix sums of their lengths are their places in
the file, groups of them its tables of offsets, and ``assembly`` puts it together. Overviews, each half as fine as the last, hold
means of the cells that are there and come before the image, so that a coarse request reads the file's beginning.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from gridloom.sources import assembly, codecs, geotiff, grids, netcdf3
from gridloom.sources.files import put


def dealt(cells: DataFrame, names: list[str], shape: list[int], chunks: list[int]) -> DataFrame:
    """(key, at, value): the chunk of each cell, its place in it, chunk after chunk within evenly filled partitions."""
    key, at = F.lit(0).cast("long"), F.lit(0)
    inside = F.lit(True)
    for name, n, c in zip(names, shape, chunks, strict=True):
        key = key * -(-n // c) + F.floor(F.col(name) / c)
        at = at * c + F.col(name) % c
        inside &= F.col(name).between(0, n - 1)
    rows = cells.where(inside & F.col("value").isNotNull()).select(key.cast("long").alias("key"), at.cast("int").alias("at"), F.col("value").cast("float").alias("value"))
    return spread(rows, shape, ["key"])


def spread(rows: DataFrame, shape: list[int], keys: list[str]) -> DataFrame:
    """Rows by key, in as many partitions as the whole raster needs tasks."""
    context = rows.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, -(-int(np.prod([float(n) for n in shape])) // grids.CELLS_PER_TASK))
    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "at", "value")


def whole(batches: Iterator[pa.RecordBatch], size: int, kind: str = "<f4") -> Iterator[tuple[tuple, np.ndarray]]:
    """Of sorted rows (keys..., at, value) each key with its flat array of ``size`` values; NaN where there is none."""
    key, out = None, None
    for batch in batches:
        *keys, at, value = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(at):
            continue
        changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for x, y in zip([0, *changes.tolist()], [*changes.tolist(), len(at)], strict=True):
            own = tuple(int(k[x]) for k in keys)
            if own != key:
                if key is not None:
                    yield key, out
                key, out = own, np.full(size, np.nan, kind)
            out[at[x:y]] = value[x:y]
    if key is not None:
        yield key, out


# -- Zarr


class ZarrWriter(DataSourceArrowWriter):
    """``layout``: name, shape, chunks, dims, level, attrs, and axes {name: (values, attrs)}, as JSON."""

    def __init__(self, options: dict):
        self.out, self.layout = options["path"], json.loads(options["layout"])
        self.there = f"{self.out.rstrip('/')}.part-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        own, attempt = self.layout, TaskContext.get().taskAttemptId()
        counts = [-(-n // c) for n, c in zip(own["shape"], own["chunks"], strict=True)]
        for (key,), values in whole(iterator, int(np.prod(own["chunks"]))):
            raw = values.tobytes()
            name = ".".join(map(str, np.unravel_index(key, counts)))
            part = put(f"{self.there}/.{name}-{attempt}", zlib.compress(raw, own["level"]) if own["level"] else raw)
            assembly.move(part, f"{self.there}/{own['name']}/{name}")  # a second attempt writes the same
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        own = self.layout
        meta = {".zgroup": {"zarr_format": 2}, ".zattrs": own["attrs"]}

        def describe(name: str, shape: list[int], chunks: list[int], dtype: str, level: int, dims: list[str], attrs: dict) -> None:
            meta[f"{name}/.zarray"] = {
                "zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": dtype, "compressor": {"id": "zlib", "level": level} if level else None, "fill_value": "NaN", "order": "C", "filters": None, "dimension_separator": ".",
            }
            meta[f"{name}/.zattrs"] = {"_ARRAY_DIMENSIONS": dims, **attrs}

        describe(own["name"], own["shape"], own["chunks"], "<f4", own["level"], own["dims"], own["own"])
        for name, (values, attrs) in own["axes"].items():
            describe(name, [len(values)], [max(1, len(values))], "<f8", 0, [name], attrs)
            put(f"{self.there}/{name}/0", np.array(values, "<f8").tobytes())
        for key, value in meta.items():
            put(f"{self.there}/{key}", json.dumps(value).encode())
        put(f"{self.there}/.zmetadata", json.dumps({"zarr_consolidated_format": 1, "metadata": meta}).encode())
        assembly.move(self.there, self.out)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        assembly.remove(self.there)


def write_zarr(cells: DataFrame, out: str, axes: dict[str, tuple], columns: list[str], chunks: list[int], name: str = "value", own: dict | None = None, attrs: dict | None = None, level: int = 1) -> str:
    """``cells`` (``columns``, value) as a Zarr store in the folder ``out``; ``axes``: of each dimension in order the values and
    attributes."""
    from gridloom.sources import datasource

    datasource.register(cells.sparkSession)
    shape = [len(values) for values, _ in axes.values()]
    layout = {
        "name": name, "shape": shape, "chunks": chunks, "dims": list(axes), "level": level, "own": own or {}, "attrs": attrs or {"Conventions": "CF-1.8"},
        "axes": {n: ([float(v) for v in values], at) for n, (values, at) in axes.items()},
    }
    dealt(cells, columns, shape, chunks).write.format("grid").mode("append").option("layout", json.dumps(layout)).save(out)
    return out


# -- GeoTIFF


def _halved(cells: DataFrame) -> DataFrame:
    return cells.groupBy((F.col("iy") / 2).cast("int").alias("iy"), (F.col("ix") / 2).cast("int").alias("ix")).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _tiles(cells: DataFrame, shapes: list[tuple[int, int]], tile: int) -> DataFrame:
    """(level, key, at, value) of the image and its overviews."""
    level = cells.where("value is not null").groupBy("iy", "ix").agg(F.max(F.col("value").cast("float")).cast("double").alias("total")).withColumn("n", F.lit(1).cast("long"))
    level = level.where(F.col("iy").between(0, shapes[0][0] - 1) & F.col("ix").between(0, shapes[0][1] - 1))
    out = None
    for k, (_, width) in enumerate(shapes):
        level = _halved(level) if k else level
        across = -(-width // tile)
        key: Column = F.floor(F.col("iy") / tile) * across + F.floor(F.col("ix") / tile)
        rows = level.select(F.lit(k).alias("level"), key.cast("long").alias("key"), ((F.col("iy") % tile) * tile + F.col("ix") % tile).cast("int").alias("at"), (F.col("total") / F.col("n")).cast("float").alias("value"))
        out = rows if out is None else out.unionAll(rows)
    return out


def _encoded(rows: DataFrame, folder: str, size: int, encode: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(level, key, source, offset, length): tiles of ``size`` values as they are in the file, in part files below ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = f"{folder}/tiles-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        system, path = assembly.system_of(part)
        rows, at, stream = [], 0, None
        for (level, key), values in whole(batches, size):
            if stream is None:
                system.create_dir(path.rpartition("/")[0], recursive=True)
                stream = system.open_output_stream(path)
            data = encode(values)
            stream.write(data)
            rows.append((level, key, part, at, len(data)))
            at += len(data)
        if stream is not None:
            stream.close()
            types = (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["level", "key", "source", "offset", "length"])

    return rows.mapInArrow(run, "level int, key long, source string, offset long, length long")


def compressed(tile: int, predictor: int) -> Callable[[np.ndarray], bytes]:
    return lambda values: zlib.compress(codecs.apply_predictor(values.reshape(tile, tile, 1), predictor).tobytes())


def write_geotiff(cells: DataFrame, out: str, height: int, width: int, box: tuple[float, float, float, float], name: str = "value", tile: int = 256, overviews: bool = True, predictor: int = 3, epsg: int = 4326, big: bool | None = None) -> str:
    """``cells`` (iy, ix, value) as a tiled GeoTIFF of float32; row 0 is the north, NaN is no value. ``tile``: a multiple of 16.

    Beyond 4 GB, or with ``big``, it is a BigTIFF.
    """
    spark, shapes = cells.sparkSession, [(height, width)]
    while overviews and max(shapes[-1]) > tile:
        shapes.append((-(-shapes[-1][0] // 2), -(-shapes[-1][1] // 2)))
    counts = [-(-h // tile) * -(-w // tile) for h, w in shapes]
    folder = f"{out}.tiles-{uuid.uuid4().hex}"
    try:
        _encoded(spread(_tiles(cells, shapes, tile), list(shapes[0]), ["level", "key"]), folder, tile * tile, compressed(tile, predictor)).write.parquet(f"{folder}/index")
        index = spark.read.parquet(f"{folder}/index")
        # Overviews, coarsest first, then the image; tiles row by row.
        starts = [sum(counts[k + 1 :]) for k in range(len(counts))]
        seq = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("level") + 1) + F.col("key")
        index = index.withColumn("seq", seq)
        stored = index.agg(F.sum("length")).first()[0] or 0
        big = stored + 16 * sum(counts) + (1 << 20) > 0xFFFFFFFF if big is None else big
        header, tables, begin = geotiff.tiled_header(shapes, counts, box, name, tile, predictor, epsg, big)
        pieces = assembly.placed(index, begin)
        word = "<u8" if big else "<u4"
        ones = {r.level: (r.target, r.length) for r in pieces.join(F.broadcast(spark.createDataFrame([(k,) for k, n in enumerate(counts) if n == 1] or [(-1,)], "level int")), "level").collect()}  # one tile a level
        every = assembly.inline(spark, geotiff.filled(header, ones, tables, big)).unionByName(pieces.select("target", "length", "source", "offset", F.lit(None).cast("binary").alias("inline")))
        size, several = np.dtype(word).itemsize, assembly.GROUP
        grouped = pieces.groupBy("level", F.floor(F.col("key") / several).alias("group")).agg(F.collect_list(F.struct("key", "target", "length")).alias("tiles"))
        places = {k: t for k, t in tables.items() if counts[k] > 1}

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Stretches of the tables of offsets and lengths; zero where there is no tile."""
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    if row["level"] not in places:
                        continue
                    first = row["group"] * several
                    n = min(several, counts[row["level"]] - first)
                    for field, table in zip(("target", "length"), places[row["level"]], strict=True):
                        part = np.zeros(n, word)
                        part[[t["key"] - first for t in row["tiles"]]] = [t[field] for t in row["tiles"]]
                        rows.append((table + first * size, n * size, None, 0, part.tobytes()))
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=[c.split()[0] for c in assembly.PIECES.split(", ")])

        every = every.unionByName(grouped.mapInArrow(pack, assembly.PIECES))
        return assembly.assemble(every, begin + stored, out)
    finally:
        assembly.remove(folder)


# -- NetCDF classic

#: Values of a stretch that a task puts together.
STRETCH = 1 << 20


def write_netcdf3(cells: DataFrame, out: str, axes: dict[str, tuple], columns: list[str], name: str = "value", own: dict | None = None, attrs: dict | None = None, stretch: int = STRETCH) -> str:
    """``cells`` (``columns``, value) as a CDF-2 file of one float32 variable; ``axes`` as in ``write_zarr``.

    The variable is one run of values in the order of its dimensions; stretches of it are dealt like tiles.
    """
    spark, shape = cells.sparkSession, [len(values) for values, _ in axes.values()]
    arrays = {n: np.array(values, np.float64) for n, (values, _) in axes.items()}
    described = {n: ([n], "f8", at) for n, (_, at) in axes.items()} | {name: (list(axes), "f4", (own or {}) | {"_FillValue": np.float32("nan")})}
    plan = netcdf3.layout(dict(zip(axes, shape, strict=True)), described, attrs or {"Conventions": "CF-1.8"})
    n, place, inside = int(np.prod(shape, dtype=np.int64)), F.lit(0).cast("long"), F.lit(True)
    for column, size in zip(columns, shape, strict=True):
        place = place * size + F.col(column)
        inside &= F.col(column).between(0, size - 1)
    rows = cells.where(inside & F.col("value").isNotNull()).select(place.alias("place"), F.col("value").cast("float").alias("value"))
    rows = rows.select(F.lit(0).alias("level"), F.floor(F.col("place") / stretch).alias("key"), (F.col("place") % stretch).cast("int").alias("at"), "value")
    count = -(-n // stretch)
    marks = spark.range(count).select(F.lit(0).alias("level"), F.col("id").alias("key"), F.lit(stretch).alias("at"), F.lit(0.0).cast("float").alias("value"))  # stretches without values are written too
    folder = f"{out}.stretches-{uuid.uuid4().hex}"
    try:
        _encoded(spread(rows.unionAll(marks), shape, ["level", "key"]), folder, stretch + 1, lambda values: values[:-1].astype(">f4").tobytes()).write.parquet(f"{folder}/index")
        index = spark.read.parquet(f"{folder}/index")
        target = F.lit(plan.begins[name]).cast("long") + F.col("key") * (4 * stretch)
        pieces = index.select(target.alias("target"), F.least("length", F.lit(plan.begins[name] + 4 * n).cast("long") - target).alias("length"), "source", "offset", F.lit(None).cast("binary").alias("inline"))
        heads = [(0, plan.header), *((plan.begins[k], a.astype(">f8").tobytes()) for k, a in arrays.items())]
        return assembly.assemble(pieces.unionByName(assembly.inline(spark, heads)), plan.size, out)
    finally:
        assembly.remove(folder)


def write_grid(grid, fmt: str, out: str, tile: int = 256) -> str:
    """A ``Grid`` of any size as ``zarr``, ``geotiff`` or ``netcdf3``, by tasks."""
    if fmt == "geotiff":
        return write_geotiff(grid.cells.select(F.col("r").alias("iy"), F.col("c").alias("ix"), "value"), out, grid.height, grid.width, grid.box, grid.variable, tile)
    lats, lons = grid.centres()
    axes = {"lat": (lats, {"units": "degrees_north", "standard_name": "latitude"}), "lon": (lons, {"units": "degrees_east", "standard_name": "longitude"})}
    if fmt == "netcdf3":
        dated = {"time_coverage_start": grid.time.strftime("%Y-%m-%dT%H:%M:%SZ")} if grid.time else {}
        return write_netcdf3(grid.cells.select("r", "c", "value"), out, axes, ["r", "c"], grid.variable, {"units": grid.units, "long_name": grid.variable}, {"Conventions": "CF-1.8", **dated})
    if fmt == "zarr":
        return write_zarr(grid.cells.select("r", "c", "value"), out, axes, ["r", "c"], [min(tile, grid.height), min(tile, grid.width)], grid.variable, {"units": grid.units, "long_name": grid.variable})
    raise ValueError(f"{fmt} isn't written by tasks")

