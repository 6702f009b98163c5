"""Smaller files of the same format, cut by tasks: a plan of byte ranges from the headers, then copies.

The driver reads headers alone. GRIB2 and NetCDF classic trims are ranges of the source, put at the sums of the lengths before them;
GeoTIFF strips are cut and encoded where tasks run and put together like ranges; a Zarr store's chunks are copied as they are under
their new keys. Tasks read what is kept and nothing else, and no task holds more than ``assembly.BUFFER``, a strip or a chunk.
Nothing is seen under the final name before it is whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import UnsupportedFormatError
from gridloom.sources import assembly, geotiff, grib2, grids, netcdf3, zarr
from gridloom.sources.files import ByteSource, put

Box = tuple[float, float, float, float]


def ranges(spark: SparkSession, path: str, found: list[tuple[int, int]]) -> DataFrame:
    """Pieces of ranges (offset, length) of one file, one after the other."""
    rows = spark.createDataFrame([(k, o, n) for k, (o, n) in enumerate(found)], "seq long, offset long, length long")
    return assembly.placed(rows).select("target", "length", F.lit(path).alias("source"), "offset", F.lit(None).cast("binary").alias("inline"))


def grib2_to(spark: SparkSession, path: str, out: str, names: list[str] | None, t1: int | None, t2: int | None) -> list[str]:
    found = grib2.kept_ranges(ByteSource(path), names, t1, t2)
    assembly.assemble(ranges(spark, path, found), sum(n for _, n in found), out)
    return []


def netcdf3_to(spark: SparkSession, path: str, out: str, names: list[str] | None, t1: int | None, t2: int | None) -> list[str]:
    plan = netcdf3.cut(ByteSource(path), names, t1, t2)
    runs = spark.createDataFrame(plan.runs, "begin long, apart long, first long, wide long, length long, n long")
    each = runs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")) if plan.runs else runs.withColumn("k", F.lit(0))
    pieces = each.where("n > 0").select((F.col("first") + F.col("k") * F.col("wide")).alias("target"), "length", F.lit(path).alias("source"), (F.col("begin") + F.col("k") * F.col("apart")).alias("offset"), F.lit(None).cast("binary").alias("inline"))
    assembly.assemble(pieces.unionByName(assembly.inline(spark, [(0, plan.layout.header)])), plan.layout.size, out)
    return []


def geotiff_to(spark: SparkSession, path: str, out: str, names: list[str] | None, box: Box | None) -> list[str]:
    reader = geotiff.GeoTiffReader(ByteSource(path))
    plan = geotiff.cut(reader, names, box)
    folder = f"{out}.strips-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Strips are appended to a part file of the task."""
        own, part = geotiff.GeoTiffReader(ByteSource(path)), f"{folder}/{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        system, at, rows, stream = assembly.system_of(part)[0], 0, [], None
        for batch in batches:
            for k in batch.column(0).to_pylist():
                if stream is None:
                    system.create_dir(assembly.system_of(folder)[1], recursive=True)
                    stream = system.open_output_stream(assembly.system_of(part)[1])
                data = plan.strip(own, k)
                stream.write(data)
                rows.append((k, part, at, len(data)))
                at += len(data)
        if stream is not None:
            stream.close()
            yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["seq", "source", "offset", "length"])

    try:
        tasks = max(1, min(plan.strips, 4 * spark.sparkContext.defaultParallelism))
        spark.range(0, plan.strips, 1, tasks).mapInArrow(run, "seq long, source string, offset long, length long").write.parquet(f"{folder}/index")
        index = spark.read.parquet(f"{folder}/index")
        lengths = [r.length for r in index.select("seq", "length").orderBy("seq").toLocalIterator()]  # the tables of the new header
        header = plan.header(lengths)
        pieces = assembly.placed(index, len(header)).select("target", "length", "source", "offset", F.lit(None).cast("binary").alias("inline"))
        assembly.assemble(pieces.unionByName(assembly.inline(spark, [(0, header)])), len(header) + sum(lengths), out)
    finally:
        assembly.remove(folder)
    return plan.warnings


def zarr_to(spark: SparkSession, path: str, out: str, names: list[str] | None, t1: int | None, t2: int | None, box: Box | None) -> list[str]:
    """A folder store, cut to whole chunks."""
    _, reader = grids.open_reader(path)
    kept, own, warnings = zarr.cut(reader, names, t1, t2, box)
    copied = [(a.name, [lo for lo, _ in chunks], [hi for _, hi in chunks]) for a, chunks, _ in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = grids.open_reader(path)[1].arrays
        done = 0
        for batch in batches:
            for name, lows, highs, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = arrays[name]
                at = np.unravel_index(k, [hi - lo + 1 for lo, hi in zip(lows, highs, strict=True)]) if lows else ()
                data = a.store.get(a.key(tuple(int(i) + lo for i, lo in zip(at, lows, strict=True))))
                if data is not None:  # a chunk of fill values may be missing
                    key = a.key(tuple(map(int, at)))
                    part = put(f"{there}/.{uuid.uuid4().hex}", data)
                    assembly.move(part, f"{there}/{key}")
                    done += 1
        yield pa.record_batch([pa.array([done])], names=["n"])

    with assembly.staged(out) as there:
        rows = spark.createDataFrame(copied, "name string, lows array<long>, highs array<long>")
        n = F.aggregate(F.transform(F.arrays_zip("lows", "highs"), lambda p: p["highs"] - p["lows"] + 1), F.lit(1).cast("long"), lambda x, y: x * y)
        each = rows.select("name", "lows", "highs", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
        each.repartition(4 * spark.sparkContext.defaultParallelism, "name", "k").mapInArrow(run, "n long").agg(F.sum("n")).first()
        meta = {}
        for a, _, shape in kept:
            described = json.loads(a.store.get(f"{a.name}/zarr.json" if a.v3 else f"{a.name}/.zarray"))
            described["shape"] = shape
            meta[f"{a.name}/zarr.json" if a.v3 else f"{a.name}/.zarray"] = described
            if not a.v3:
                meta[f"{a.name}/.zattrs"] = a.attrs | ({"_ARRAY_DIMENSIONS": a.dims} if a.dims else {})
        for name, (values, dims, attrs) in own.items():  # axes, whole in one chunk
            meta[f"{name}/.zarray"] = {"zarr_format": 2, "shape": list(values.shape), "chunks": [max(1, len(values))], "dtype": values.dtype.str, "compressor": None, "fill_value": None, "order": "C", "filters": None}
            meta[f"{name}/.zattrs"] = {k: v for k, v in attrs.items() if k != "_ARRAY_DIMENSIONS"} | {"_ARRAY_DIMENSIONS": dims}
            put(f"{there}/{name}/0", values.tobytes())
        for key, value in meta.items():
            put(f"{there}/{key}", json.dumps(value, default=lambda x: x.tolist()).encode())
        put(f"{there}/.zgroup", b'{"zarr_format": 2}')
        put(f"{there}/.zmetadata", json.dumps({"zarr_consolidated_format": 1, "metadata": {".zgroup": {"zarr_format": 2}} | meta}, default=lambda x: x.tolist()).encode())
    return warnings


def trim_to(spark: SparkSession, path: str, kind: str, out: str, names: list[str] | None = None, t1: int | None = None, t2: int | None = None, box: Box | None = None) -> list[str]:
    """``path`` cut to ``out``; warnings."""
    if kind == "grib2":
        return grib2_to(spark, path, out, names, t1, t2)
    if kind == "netcdf3":
        return netcdf3_to(spark, path, out, names, t1, t2)
    if kind == "tiff":
        return geotiff_to(spark, path, out, names, box)
    if kind == "zarr":
        return zarr_to(spark, path, out, names, t1, t2, box)
    raise UnsupportedFormatError(f"{path}: {kind} isn't cut by tasks")

