"""Queries over files of every format: written from the driver's tables to the shared folder, read back where tasks run.

The cube of ``cells`` (see ``catalogue``; 31 days of 12 x 24 cells at most, whatever the number of events) becomes one
file of a format; the query returns what the format's reader makes of it, and its SQL the same numbers from the table.
Values are float32 in files, so the SQL casts to FLOAT; formats that pack integers hold ``floor(value)``.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import statistics
from gridloom.plans import catalogue, engine
from gridloom.plans.catalogue import CELLS, LATS, LONS, NX, NY, QUERIES, SQL
from gridloom.sources import codecs, datasource, detect, geotiff, grib2, grids, hdf5, netcdf3, parquet_points, references, writers, zarr
from gridloom.sources.files import ByteSource, put, scratch
from gridloom.sources.model import Variable

DAYS = 31
BEGIN = 1704067200
FLOAT, WHOLE = "CAST(CAST(value AS FLOAT) AS DOUBLE)", "floor(value)"
SOME = f"WITH {CELLS}, c AS (SELECT * FROM cells WHERE value IS NOT NULL AND t BETWEEN 0 AND {DAYS - 1})"


def add(name: str, sql: str, f) -> None:
    f.__name__ = name
    QUERIES[name], SQL[name] = f, sql


def cube(spark: SparkSession, sf_dir: str, whole: bool = False) -> np.ndarray:
    """The cells as an array; NaN where there is none. Its size is that of the grid."""
    out = np.full((DAYS, NY, NX), np.nan, np.float32)
    for r in catalogue.read_cells(spark, sf_dir).where(F.col("value").isNotNull() & F.col("t").between(0, DAYS - 1)).collect():
        out[r["t"], r["iy"], r["ix"]] = np.floor(r["value"]) if whole else r["value"]
    return out


TIME = {"units": "days since 2024-01-01 00:00:00", "axis": "T"}
AXES = {"time": (["time"], np.arange(float(DAYS)), TIME), "lat": (["lat"], np.array(LATS), {"units": "degrees_north"}), "lon": (["lon"], np.array(LONS), {"units": "degrees_east"})}
FLIPPED = {n: (a, d, at) for n, (d, a, at) in AXES.items()}
SIZES = {"time": DAYS, "lat": NY, "lon": NX}
DIMS = ["time", "lat", "lon"]
OWN = {"units": "K", "long_name": "Mean value"}


def packed_netcdf3(a: np.ndarray) -> bytes:
    raw = np.where(np.isnan(a), -999, a).astype(np.int16)
    return netcdf3.write(SIZES, AXES | {"v": (DIMS, raw, OWN | {"scale_factor": 0.5, "add_offset": 10.0, "_FillValue": np.int16(-999)})}, {"Conventions": "CF-1.6"})


def grib_messages(a: np.ndarray, order: int = 0) -> bytes:
    return b"".join(grib2.encode(a[t], LATS, LONS, (0, 0, 0), BEGIN + 86400 * t, order=order) for t in range(DAYS))


BOX = (-180.0, -90.0, 180.0, 90.0)

#: name: (bytes of the cube, whether it holds whole numbers, the value in SQL)
FORMATS = {
    "netcdf3": (lambda a: netcdf3.write(SIZES, AXES | {"v": (DIMS, a, OWN)}, {"Conventions": "CF-1.6"}), False, FLOAT),
    "netcdf3_records": (lambda a: netcdf3.write(SIZES, AXES | {"v": (DIMS, a, OWN), "w": (DIMS, a + 1, OWN)}, {}, "time"), True, WHOLE),
    "netcdf3_packed": (packed_netcdf3, True, "floor(value) * 0.5 + 10"),
    "netcdf4": (lambda a: hdf5.write(FLIPPED | {"v": (a, DIMS, OWN)}, {"title": "cells"}), False, FLOAT),
    "zarr": (lambda a: zarr.write_zip(FLIPPED | {"v": (a, DIMS, OWN)}), False, FLOAT),
    "zarr_chunked": (lambda a: zarr.write_zip(FLIPPED | {"v": (a, DIMS, OWN)}, chunks={"v": [5, 4, 8]}, level=3), False, FLOAT),
    "grib2": (grib_messages, True, WHOLE),
    "grib2_first_differences": (lambda a: grib_messages(a, 1), True, WHOLE),
    "grib2_second_differences": (lambda a: grib_messages(a, 2), True, WHOLE),
    "refs_v1": (lambda a: references.write_refs_v1(Variable("v", (DAYS, NY, NX), LATS, LONS, [float(BEGIN + 86400 * t) for t in range(DAYS)], "K"), np.where(np.isnan(a), 9.9e37, a)), False, FLOAT),
}


def written(spark: SparkSession, sf_dir: str, fmt: str) -> str:
    """The cube as a file of the format; its path."""
    make, whole, _ = FORMATS[fmt]
    if fmt == "zarr_chunked":  # by tasks
        axes = {n: (list(values), at) for n, (_, values, at) in AXES.items()}
        return writers.write_zarr(catalogue.read_cells(spark, sf_dir), f"{scratch(spark)}/{fmt}", axes, ["t", "iy", "ix"], [5, 4, 8], "v", OWN, level=3)
    return put(f"{scratch(spark)}/{fmt}", make(cube(spark, sf_dir, whole)))


def cells_of(chosen: DataFrame) -> DataFrame:
    return grids.decode(chosen).where("value is not null").select("t", "iy", "ix", F.col("value").cast("double").alias("value"))


def first_variable(path: str) -> str:
    return grids.open_reader(path)[1].variables()[0].name


def read_format(fmt: str):
    def run(spark, sf_dir):
        path = written(spark, sf_dir, fmt)
        return cells_of(grids.blocks(spark, [path], [first_variable(path)]))

    return run


for _fmt, (_, _, _value) in FORMATS.items():
    add(f"file_{_fmt}", f"{SOME} SELECT t, iy, ix, {_value} AS value FROM c", read_format(_fmt))


# -- rasters of one step


def tiff(options: dict, whole: bool, missing: float):
    def run(spark, sf_dir):
        a = cube(spark, sf_dir, whole)[3]
        band = np.where(np.isnan(a), missing, a).astype(options.get("dtype", "f4"))
        data = geotiff.write(np.stack([band, band]), BOX, ["v", "again"], compress=options["predictor"] > 0, predictor=max(1, options["predictor"]), nodata=missing, rows_per_strip=5)
        path = put(f"{scratch(spark)}/tiff", data)
        return cells_of(grids.blocks(spark, [path], ["v"])).drop("t")

    return run


for _name, _options, _whole, _missing in (("plain", {"predictor": 0}, False, -1e9), ("predictor_2", {"predictor": 2, "dtype": "u2"}, True, 65535), ("predictor_3", {"predictor": 3}, False, float("nan"))):
    add(f"file_geotiff_{_name}", f"{SOME} SELECT iy, ix, {WHOLE if _whole else FLOAT} AS value FROM c WHERE t = 3", tiff(_options, _whole, _missing))


# -- stores of many files


def sharded_zarr(spark: SparkSession, sf_dir: str) -> str:
    """Version 3: shards of 31 x 6 x 12 cells, inner chunks of 8 x 3 x 4 compressed by themselves, an index at the end."""
    a, root = cube(spark, sf_dir), f"{scratch(spark)}/sharded.zarr"
    shard, inner, none = (32, 6, 12), (8, 3, 4), (1 << 64) - 1
    little, squeeze = {"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip", "configuration": {"level": 1}}
    sharding = {"name": "sharding_indexed", "configuration": {"chunk_shape": list(inner), "codecs": [little, squeeze], "index_codecs": [little, {"name": "crc32c"}], "index_location": "end"}}

    def meta(shape, chunks, dims, attrs, chain, dtype):
        return json.dumps({
            "zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": dtype, "fill_value": "NaN", "attributes": attrs, "dimension_names": dims,
            "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunks)}}, "codecs": chain,
        }).encode()

    put(f"{root}/zarr.json", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {}}).encode())
    for name, (values, dims, attrs) in FLIPPED.items():
        put(f"{root}/{name}/zarr.json", meta(values.shape, values.shape, dims, attrs, [little], "float64"))
        put(f"{root}/{name}/c/0", values.astype("<f8").tobytes())
    put(f"{root}/v/zarr.json", meta(a.shape, shard, DIMS, OWN, [sharding], "float32"))
    padded = np.full((32, NY, NX), np.nan, "<f4")
    padded[:DAYS] = a
    import gzip

    for sy in range(NY // shard[1]):
        for sx in range(NX // shard[2]):
            part = padded[:, sy * shard[1] : (sy + 1) * shard[1], sx * shard[2] : (sx + 1) * shard[2]]
            body, index = b"", b""
            for at in np.ndindex(*(s // i for s, i in zip(shard, inner, strict=True))):
                chunk = part[tuple(slice(k * i, (k + 1) * i) for k, i in zip(at, inner, strict=True))]
                data = b"" if np.isnan(chunk).all() else gzip.compress(chunk.tobytes())
                index += struct.pack("<QQ", len(body), len(data)) if data else struct.pack("<QQ", none, none)
                body += data
            put(f"{root}/v/c/0/{sy}/{sx}", body + index + b"\0\0\0\0")
    return root


def file_zarr_v3_sharded(spark, sf_dir):
    return cells_of(grids.blocks(spark, [sharded_zarr(spark, sf_dir)], ["v"]))


add("file_zarr_v3_sharded", f"{SOME} SELECT t, iy, ix, {FLOAT} AS value FROM c", file_zarr_v3_sharded)


def reference_index(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """An index whose chunks lie in one far file; the small arrays are inline. As JSON or Parquet."""
    data = zarr.write_zip(FLIPPED | {"v": (cube(spark, sf_dir), DIMS, OWN)}, chunks={"v": [5, 4, 8]}, level=1)
    root, store, body, rows = scratch(spark), zipfile.ZipFile(io.BytesIO(data)), b"junk", []
    for key in store.namelist():
        own = store.read(key)
        far = key.startswith("v/") and not key.rsplit("/", 1)[1].startswith(".")
        rows.append((key, None if far else own, "far.bin" if far else None, len(body) if far else 0, len(own) if far else 0))
        body += own if far else b""
    put(f"{root}/far.bin", body)
    if kind == "json":
        import base64

        refs = {k: [p, o, n] if p else "base64:" + base64.b64encode(raw).decode() for k, raw, p, o, n in rows}
        return put(f"{root}/index.json", json.dumps({"version": 1, "refs": refs}).encode())
    spark.createDataFrame([(k, bytearray(raw) if raw is not None else None, p and f"{root}/{p}", o, n) for k, raw, p, o, n in rows], references.REFERENCE).repartition(3).write.parquet(f"{root}/index.refs")
    return f"{root}/index.refs"


for _kind in ("json", "parquet"):
    add(
        f"file_references_{_kind}", f"{SOME} SELECT t, iy, ix, {FLOAT} AS value FROM c",
        lambda spark, sf_dir, kind=_kind: cells_of(grids.blocks(spark, [reference_index(spark, sf_dir, kind)], ["v"])),
    )


# -- what files say about themselves

_CATALOG = ("netcdf3", "netcdf4", "zarr_chunked", "grib2", "refs_v1")
_KINDS = {"netcdf3": "netcdf3", "netcdf4": "netcdf4", "zarr_chunked": "zarr", "grib2": "grib2", "refs_v1": "refs"}


def file_catalog(spark, sf_dir):
    frame = grids.scan(spark, [written(spark, sf_dir, f) for f in _CATALOG])
    shape = [F.get("shape", F.lit(k)).cast("int").alias(n) for k, n in enumerate(("nt", "ny", "nx"))]
    corners = [F.round(c, 6).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")]
    return frame.select("format", "units", *shape, *corners, F.unix_seconds(F.array_min("times")).alias("begin"), F.unix_seconds(F.array_max("times")).alias("end"), F.col("supported"))


add("file_catalog", " UNION ALL ".join(
    f"SELECT '{_KINDS[f]}' AS format, 'K' AS units, {DAYS} AS nt, {NY} AS ny, {NX} AS nx, CAST({min(LONS)} AS DOUBLE) AS min_lon, CAST({min(LATS)} AS DOUBLE) AS min_lat, "
    f"CAST({max(LONS)} AS DOUBLE) AS max_lon, CAST({max(LATS)} AS DOUBLE) AS max_lat, CAST({BEGIN} AS BIGINT) AS begin, CAST({BEGIN + 86400 * (DAYS - 1)} AS BIGINT) AS \"end\", true AS supported" for f in _CATALOG
), file_catalog)


def file_formats(spark, sf_dir):
    root = scratch(spark)
    a = cube(spark, sf_dir, True)
    for name in _CATALOG:
        put(f"{root}/{name}", FORMATS[name][0](a))
    put(f"{root}/geotiff", geotiff.write(a[:1], BOX))
    catalogue.read(spark, sf_dir, "region").coalesce(1).write.parquet(f"{root}/table")
    found = detect.detect_files(spark, root)
    return found.where(~F.col("path").rlike("/_|crc$")).select(F.when(F.col("path").contains("/table/"), "table").otherwise(F.substring_index("path", "/", -1)).alias("name"), "format")


add("file_formats", "SELECT * FROM (VALUES ('netcdf3', 'netcdf3'), ('netcdf4', 'netcdf4'), ('zarr_chunked', 'zarr'), ('grib2', 'grib2'), ('refs_v1', NULL), ('geotiff', 'tiff'), ('table', 'parquet')) AS f(name, format)", file_formats)


def file_attributes(spark, sf_dir):
    rows = grids.scan(spark, [written(spark, sf_dir, "netcdf4"), written(spark, sf_dir, "netcdf3_packed")])
    return rows.select("format", F.explode("attrs").alias("attribute", "text")).where("attribute in ('units', 'long_name')")


add("file_attributes", "SELECT f.format, a.attribute, a.text FROM (VALUES ('netcdf4'), ('netcdf3')) AS f(format), (VALUES ('units', 'K'), ('long_name', 'Mean value')) AS a(attribute, text)", file_attributes)


# -- reading parts


def file_pruned(spark, sf_dir):
    """Only blocks of the ranges: 2 of 7 x 2 of 3 x 2 of 3."""
    return cells_of(grids.blocks(spark, [written(spark, sf_dir, "zarr_chunked")], ["v"], (7, 12), (2, 5), (3, 9)))


add("file_pruned", f"{SOME} SELECT t, iy, ix, {FLOAT} AS value FROM c WHERE t // 5 BETWEEN 1 AND 2 AND iy // 4 BETWEEN 0 AND 1 AND ix // 8 BETWEEN 0 AND 1", file_pruned)


def file_block_reduction(spark, sf_dir):
    """A reduction of one's own over blocks: no cell leaves its task."""

    def reducer(variable, block, values):
        good = values[np.isfinite(values)].astype(np.float64)
        if len(good):
            yield block.t // 5, block.y // 4, block.x // 8, len(good), float(good.min()), float(good.max())

    chosen = grids.blocks(spark, [written(spark, sf_dir, "zarr_chunked")], ["v"])
    return grids.reduce_blocks(chosen, reducer, "bt int, by int, bx int, n long, low double, high double")


add("file_block_reduction", f"{SOME} SELECT t // 5 AS bt, iy // 4 AS \"by\", ix // 8 AS bx, count(*) AS n, min({FLOAT}) AS low, max({FLOAT}) AS high FROM c GROUP BY 1, 2, 3", file_block_reduction)


def file_statistics(spark, sf_dir):
    path = written(spark, sf_dir, "grib2")
    rows = grids.decode(grids.blocks(spark, [path], [first_variable(path)])).withColumn("value", F.col("value").cast("double"))
    return statistics.summarize(rows, by=("t",)).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6)).where("n > 0")


add("file_statistics", f"{SOME} SELECT t, count(*) AS n, min(floor(value)) AS min, max(floor(value)) AS max, round(avg(floor(value)), 6) AS mean, round(stddev_pop(floor(value)), 6) AS std FROM c GROUP BY t", file_statistics)


def file_normalized(spark, sf_dir):
    """Files as Parquet cells, read back as a table."""
    out = f"{scratch(spark)}/cells"
    grids.normalize(spark, [written(spark, sf_dir, "zarr_chunked")], out, ["v"])
    return spark.read.parquet(out).where("value is not null and t between 4 and 8").select("t", "iy", "ix", F.col("value").cast("double").alias("value"))


add("file_normalized", f"{SOME} SELECT t, iy, ix, {FLOAT} AS value FROM c WHERE t BETWEEN 4 AND 8", file_normalized)


def file_data_source(spark, sf_dir):
    datasource.register(spark)
    rows = spark.read.format("grid").option("variable", "v").load(written(spark, sf_dir, "zarr_chunked"))
    return rows.where("t >= 20 and iy < 4 and ix = 9 and value is not null").select("t", "iy", "ix", F.col("value").cast("double").alias("value"))


add("file_data_source", f"{SOME} SELECT t, iy, ix, {FLOAT} AS value FROM c WHERE t >= 20 AND iy < 4 AND ix = 9", file_data_source)


# -- the verbs


def series_of(fmt: str):
    def run(spark, sf_dir):
        path = written(spark, sf_dir, fmt)
        rows = engine.Dataset(spark, path).extract(first_variable(path), 36.0, 23.0)
        return rows.where("value is not null").select("t", F.round("lat", 6).alias("lat"), F.round(F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon")), 6).alias("lon"), "value", F.unix_seconds("time").alias("seconds"))

    return run


for _fmt in ("netcdf3", "netcdf4", "zarr_chunked", "grib2", "refs_v1"):
    add(f"file_series_{_fmt}", f"{SOME} SELECT t, CAST(37.5 AS DOUBLE) AS lat, CAST(22.5 AS DOUBLE) AS lon, {FORMATS[_fmt][2]} AS value, {BEGIN} + 86400 * CAST(t AS BIGINT) AS seconds FROM c WHERE iy = 3 AND ix = 13", series_of(_fmt))


def file_series_dates(spark, sf_dir):
    """A line of one longitude in a date range."""
    rows = engine.Dataset(spark, written(spark, sf_dir, "zarr_chunked")).extract("v", lon=-38.0, dates=("2024-01-05", "2024-01-09"))
    return rows.where("value is not null").select("t", F.round("lat", 6).alias("lat"), "value")


add("file_series_dates", f"{SOME} SELECT t, 82.5 - 15.0 * CAST(iy AS DOUBLE) AS lat, {FLOAT} AS value FROM c WHERE ix = 9 AND t BETWEEN 4 AND 8", file_series_dates)


def file_series_of_two(spark, sf_dir):
    """All variables of a file at one cell and date."""
    rows = engine.Dataset(spark, written(spark, sf_dir, "netcdf3_records")).extract(None, lat=-8.0, lon=100.0, t1=2, t2=6)
    return rows.where("value is not null").select("variable", "t", "value")


add("file_series_of_two", f"{SOME} SELECT x.variable, t, floor(value) + x.more AS value FROM c, (VALUES ('v', 0), ('w', 1)) AS x(variable, more) WHERE iy = 6 AND ix = 18 AND t BETWEEN 2 AND 6", file_series_of_two)


def raster(spark, sf_dir, fmt: str = "netcdf4") -> engine.Grid:
    """A window of the fourth day, pixel by cell."""
    path = written(spark, sf_dir, fmt)
    return engine.Dataset(spark, path).extract_grid(first_variable(path), (-60.0, -30.0, 60.0, 60.0), 8, 6, date="2024-01-04")


_WINDOW = f"{SOME}, w AS (SELECT iy - 2 AS r, ix - 8 AS c, {FLOAT} AS value FROM c WHERE t = 3 AND iy BETWEEN 2 AND 7 AND ix BETWEEN 8 AND 15)"


def file_grid(spark, sf_dir):
    return raster(spark, sf_dir).cells.where("value is not null").select("r", "c", F.col("value").cast("double").alias("value"))


add("file_grid", f"{_WINDOW} SELECT r, c, value FROM w", file_grid)


# -- cutting files


def trim_of(fmt: str, **cut):
    def run(spark, sf_dir):
        make, rounded, _ = FORMATS[fmt]
        whole = put(f"{scratch(spark)}/{fmt}", make(cube(spark, sf_dir, rounded)))
        name = first_variable(whole)
        small = f"{scratch(spark)}/trimmed"
        if fmt == "netcdf4":
            put(small, engine.trim(whole, variables=[name], **cut).data)
        else:
            engine.trim_to(spark, whole, small, variables=[name], **cut)
        v = grids.open_reader(small)[1].variables()[0]
        days = np.round((np.array(v.times) - BEGIN) / 86400).astype(int).tolist()
        rows = cells_of(grids.blocks(spark, [small], [v.name]))
        at = spark.createDataFrame(list(enumerate(days)), "t int, day int")
        rows = rows.join(F.broadcast(at), "t").withColumn("iy", F.col("iy") + round((82.5 - v.y[0]) / 15)).withColumn("ix", F.col("ix") + round((v.x[0] + 172.5) / 15))
        return rows.select(F.col("day").alias("t"), "iy", "ix", "value")

    return run


for _fmt, _days in (("netcdf3", "5 AND 9"), ("netcdf3_records", "5 AND 9"), ("netcdf4", "5 AND 9"), ("zarr_chunked", "5 AND 9"), ("grib2", "5 AND 9")):
    add(f"file_trim_{_fmt}", f"{SOME} SELECT t, iy, ix, {FORMATS[_fmt][2]} AS value FROM c WHERE t BETWEEN {_days}", trim_of(_fmt, t1=5, t2=9))
# A Zarr store is cut to whole chunks.
add("file_trim_zarr_box", f"{SOME} SELECT t, iy, ix, {FLOAT} AS value FROM c WHERE t BETWEEN 5 AND 9 AND iy BETWEEN 4 AND 7 AND ix BETWEEN 8 AND 15", trim_of("zarr_chunked", t1=5, t2=9, box=(-50.0, -20.0, 50.0, 20.0)))


def file_trim_geotiff(spark, sf_dir):
    """One band of two, cut to a box that is widened to whole strips."""
    a = cube(spark, sf_dir, True)
    whole = put(f"{scratch(spark)}/two.tif", geotiff.write(np.nan_to_num(a[3:5], nan=-9999).astype("f4"), BOX, ["three", "four"], compress=True, predictor=3, nodata=-9999, rows_per_strip=2))
    small = f"{scratch(spark)}/one.tif"
    engine.trim_to(spark, whole, small, variables=["four"], box=(-60.0, -30.0, 60.0, 60.0))
    return cells_of(grids.blocks(spark, [small])).select("iy", "ix", "value")


add("file_trim_geotiff", f"{SOME} SELECT iy - 2 AS iy, ix, floor(value) AS value FROM c WHERE t = 4 AND iy BETWEEN 2 AND 7", file_trim_geotiff)


# -- writing results


def read_raster(spark: SparkSession, data: bytes, fmt: str) -> DataFrame:
    """(r, c, value) of an encoded raster: binary formats through their readers, texts and tables through Spark's."""
    path = put(f"{scratch(spark)}/out.{fmt}", data)
    row, column = F.round((60 - F.col("lat")) / 15 - 0.5).cast("int").alias("r"), F.round((F.col("lon") + 60) / 15 - 0.5).cast("int").alias("c")
    if fmt == "json":
        values = spark.read.schema("data array<double>").json(path).select(F.posexplode("data").alias("k", "value"))
        return values.select(F.floor(F.col("k") / 8).cast("int").alias("r"), (F.col("k") % 8).cast("int").alias("c"), "value").where("value is not null")
    if fmt in ("csv", "parquet"):
        rows = spark.read.schema("variable string, lat double, lon double, value double").csv(path, header=True) if fmt == "csv" else spark.read.parquet(path)
        return rows.where("value is not null and not isnan(value)").select(row, column, F.col("value").cast("double").alias("value"))
    return cells_of(grids.blocks(spark, [path])).select(F.col("iy").alias("r"), F.col("ix").alias("c"), "value")


for _fmt in ("json", "csv", "parquet", "netcdf4"):
    add(f"export_grid_{_fmt}", f"{_WINDOW} SELECT r, c, value FROM w", lambda spark, sf_dir, fmt=_fmt: read_raster(spark, engine.encode_grid(raster(spark, sf_dir), fmt), fmt))


def by_tasks(fmt: str):
    """A raster from a store that tasks wrote, written by tasks."""

    def run(spark, sf_dir):
        out = engine.write_grid(raster(spark, sf_dir, "zarr_chunked"), fmt, f"{scratch(spark)}/out.{fmt}", tile=16)
        return cells_of(grids.blocks(spark, [out])).select(F.col("iy").alias("r"), F.col("ix").alias("c"), "value")

    return run


for _fmt in ("zarr", "geotiff", "netcdf3"):
    add(f"export_grid_{_fmt}", f"{_WINDOW} SELECT r, c, value FROM w", by_tasks(_fmt))
add("export_grid_grib2", f"{_WINDOW} SELECT r, c, floor(value) AS value FROM w", lambda spark, sf_dir: read_raster(spark, engine.encode_grid(raster(spark, sf_dir, "netcdf3_records"), "grib2"), "grib2"))


def export_grid_png(spark, sf_dir):
    """Pixels that are not transparent, with the ramp's ends at the least and the greatest value."""
    data = engine.grid_to_image(raster(spark, sf_dir))
    length = struct.unpack(">I", data[33:37])[0]
    pixels = np.frombuffer(zlib.decompress(data[41 : 41 + length]), np.uint8).reshape(6, 1 + 8 * 4)[:, 1:].reshape(6, 8, 4)
    r, c = np.nonzero(pixels[..., 3])
    ends = {(68, 1, 84): -1, (253, 231, 37): 1}
    return spark.createDataFrame([(int(a), int(b), ends.get(tuple(pixels[a, b, :3].tolist()), 0)) for a, b in zip(r, c, strict=True)], "r int, c int, which int").where("which <> 0")


add("export_grid_png", f"{_WINDOW}, e AS (SELECT min(value) AS low, max(value) AS high FROM w) SELECT r, c, CASE WHEN value = low THEN -1 ELSE 1 END AS which FROM w, e WHERE value IN (low, high)", export_grid_png)


def export_series_of(fmt: str):
    def run(spark, sf_dir):
        rows = engine.Dataset(spark, written(spark, sf_dir, "netcdf4")).extract("v", 36.0, 23.0).where("value is not null")
        data = engine.encode_series(rows, fmt)
        path = put(f"{scratch(spark)}/series.{fmt}", data)
        if fmt == "json":
            found = spark.read.json(path).select(F.explode("timeseries").alias("p")).select(F.to_timestamp("p.time").alias("time"), "p.value")
        elif fmt == "csv":
            found = spark.read.schema("variable string, time string, value double, lat double, lon double").csv(path, header=True).select(F.to_timestamp("time").alias("time"), "value")
        elif fmt == "parquet":
            found = spark.read.parquet(path).select(F.timestamp_seconds("time").alias("time"), F.col("value").cast("double").alias("value"))
        else:
            found = engine.Dataset(spark, path).extract("v").select("time", "value")
        return found.select(F.unix_seconds("time").alias("seconds"), "value")

    return run


for _fmt in ("json", "csv", "parquet", "netcdf3", "netcdf4", "zarr"):
    add(f"export_series_{_fmt}", f"{SOME} SELECT {BEGIN} + 86400 * CAST(t AS BIGINT) AS seconds, {FLOAT} AS value FROM c WHERE iy = 3 AND ix = 13", export_series_of(_fmt))


# -- rasters that grow with the table, written by tasks

WIDE = 128
#: A row of pixels for each ``WIDE`` events, up to a multiple of 16.
_RASTER = f"""h AS (SELECT CAST(ceil((max(event_id) + 1) / {16 * WIDE}) AS BIGINT) * 16 AS height FROM events),
  px AS (SELECT CAST(event_id // {WIDE} AS INTEGER) AS iy, CAST(event_id % {WIDE} AS INTEGER) AS ix, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM events WHERE value IS NOT NULL)"""


def event_raster(spark: SparkSession, sf_dir: str) -> engine.Grid:
    """A pixel for each event, over the whole world."""
    e = catalogue.read(spark, sf_dir, "events")
    last = e.agg(F.max("event_id")).first()[0] or 0
    cells = e.select(F.floor(F.col("event_id") / WIDE).cast("int").alias("r"), (F.col("event_id") % WIDE).cast("int").alias("c"), "value")
    return engine.Grid(cells, BOX, WIDE, -(-(last + 1) // (16 * WIDE)) * 16, "value", "K")


def raster_written(fmt: str):
    def run(spark, sf_dir):
        out = writers.write_grid(event_raster(spark, sf_dir), fmt, f"{scratch(spark)}/raster.{fmt}", tile=32)
        return cells_of(grids.blocks(spark, [out])).drop("t")

    return run


for _fmt in ("zarr", "geotiff", "netcdf3"):
    add(f"export_raster_{_fmt}", f"WITH {_RASTER} SELECT iy, ix, value FROM px", raster_written(_fmt))


def trim_raster_zarr(spark, sf_dir):
    """The store of the whole raster cut to the tiles that a box meets, chunks copied as they are."""
    whole = writers.write_grid(event_raster(spark, sf_dir), "zarr", f"{scratch(spark)}/whole.zarr", tile=32)
    small = f"{scratch(spark)}/small.zarr"
    engine.trim_to(spark, whole, small, box=(-80.0, -90.0, 80.0, 90.0))
    return cells_of(grids.blocks(spark, [small])).drop("t")


# Columns 35 to 92 lie in the box; whole tiles are 32 to 95.
add("trim_raster_zarr", f"WITH {_RASTER} SELECT iy, CAST(ix - 32 AS INTEGER) AS ix, value FROM px WHERE ix BETWEEN 32 AND 95", trim_raster_zarr)


def file_costs(spark, sf_dir):
    """What reading each chunk of the raster's store fetches: one request of its uncompressed bytes, none where it is missing."""
    grid = event_raster(spark, sf_dir)
    lats, lons = grid.centres()
    out = writers.write_zarr(grid.cells, f"{scratch(spark)}/raw.zarr", {"lat": (lats, {"units": "degrees_north"}), "lon": (lons, {"units": "degrees_east"})}, ["r", "c"], [16, 32], level=0)
    return grids.costs(grids.blocks(spark, [out])).select("y", "x", "cells", "requests", "bytes")


add("file_costs", f"""WITH {_RASTER}, had AS (SELECT DISTINCT iy // 16 AS r, ix // 32 AS c FROM px), every AS (SELECT r, c FROM h, unnest(range(height // 16)) AS y(r), unnest(range({WIDE // 32})) AS x(c))
  SELECT CAST(e.r * 16 AS INTEGER) AS y, CAST(e.c * 32 AS INTEGER) AS x, CAST(512 AS BIGINT) AS cells, CAST(CASE WHEN had.r IS NULL THEN 0 ELSE 1 END AS BIGINT) AS requests, CAST(CASE WHEN had.r IS NULL THEN 0 ELSE 2048 END AS BIGINT) AS bytes
  FROM every e LEFT JOIN had ON had.r = e.r AND had.c = e.c""", file_costs)  # fmt: skip


def overview_request(name: str, box: tuple, width: int, parts: int, sql: str):
    """A request coarser than the file, of ``width`` pixels and a ``parts``-th of the file's rows, with the number of blocks
    that it reads."""

    def run(spark, sf_dir):
        grid = event_raster(spark, sf_dir)
        data = engine.Dataset(spark, writers.write_grid(grid, "geotiff", f"{scratch(spark)}/raster.tif", tile=32))
        size = (width, grid.height // parts)
        n = data.blocks_of_grid(None, box, *size).count()
        cells = data.extract_grid(None, box, *size).cells
        return cells.where("value is not null").select("r", "c", F.round("value", 4).alias("value"), F.lit(n).alias("n_blocks"))

    add(name, sql, run)


_MEANS = "SELECT CAST(iy // 4 AS INTEGER) AS r, CAST(ix // 4 AS INTEGER) AS c, round(CAST(CAST(avg(value) AS FLOAT) AS DOUBLE), 4) AS value FROM px GROUP BY 1, 2"
overview_request("file_overview", BOX, WIDE // 4, 4, f"WITH {_RASTER}, m AS ({_MEANS}) SELECT r, c, value, CAST(ceil(height / 4 / 32) AS BIGINT) AS n_blocks FROM m, h")
# The north-west quarter: tiles that hold its half of the rows, of the half as fine image.
overview_request(
    "file_overview_window", (-180.0, 0.0, 0.0, 90.0), WIDE // 4, 4,
    f"""WITH {_RASTER}, m AS (SELECT CAST(iy // 2 AS INTEGER) AS r, CAST(ix // 2 AS INTEGER) AS c, round(CAST(CAST(avg(value) AS FLOAT) AS DOUBLE), 4) AS value FROM px GROUP BY 1, 2)
    SELECT r, c, value, CAST(ceil(height / 4 / 32) AS BIGINT) AS n_blocks FROM m, h WHERE r < height / 4 AND c < {WIDE // 4}""",
)


# -- tables of points as files


def file_points_bbox(spark, sf_dir):
    """A Parquet table with roles found by its columns' names; its extent and times."""
    out = f"{scratch(spark)}/points"
    catalogue.read_points(spark, sf_dir).select("lat", "lon", F.col("ts").alias("time"), "value").write.parquet(out)
    table = parquet_points.PointTable(spark, out)
    rows = table.select(("2024-01-03", "2024-01-05"))
    return rows.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for f, n in ((F.min, "min"), (F.max, "max"))))


add("file_points_bbox", f"WITH {catalogue.POINTS} SELECT count(*) AS n, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM points WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-05'", file_points_bbox)


def file_points_wkb(spark, sf_dir):
    """Point geometries in well-known binary, decoded by expressions."""
    p = catalogue.read_points(spark, sf_dir).select("event_id", "lat", "lon")

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            geometry = [struct.pack("<BIdd", 1, 1, x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(geometry, pa.binary())], names=["event_id", "geometry"])

    lon, lat = parquet_points.wkb_point(F.col("geometry"))
    return p.mapInArrow(pack, "event_id long, geometry binary").select("event_id", lat.alias("lat"), lon.alias("lon"))


add("file_points_wkb", f"WITH {catalogue.POINTS} SELECT event_id, lat, lon FROM points", file_points_wkb)


# -- codecs on the cells of every event


def coded(name: str, encode, decode):
    """Events' numbers, 1000 to a run, packed and unpacked by a codec."""

    def run(spark, sf_dir):
        def code(batches):
            import pyarrow as pa

            for batch in batches:
                ids, values = batch.column(0), batch.column(1).to_numpy().astype("<i4")
                out = [np.frombuffer(decode(encode(values[k : k + 1000].tobytes())), "<i4") for k in range(0, len(values), 1000)]
                yield pa.record_batch([ids, pa.array(np.concatenate(out) if out else np.empty(0, "<i4"))], names=["event_id", "value"])

        rows = catalogue.read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 1000 * 7).cast("int").alias("value"))
        return rows.mapInArrow(code, "event_id long, value int")

    add(f"codec_{name}", "SELECT event_id, CAST(event_id % 1000 * 7 AS INTEGER) AS value FROM events", run)


def shuffled(data: bytes) -> bytes:
    return np.frombuffer(data, np.uint8).reshape(-1, 4).T.tobytes()


def blosc_frame(data: bytes, codec: int, pack) -> bytes:
    packed = pack(shuffled(data))
    return struct.pack("<BBBBIII", 2, 1, 1 | 0x10 | codec << 5, 4, len(data), len(data), 0) + struct.pack("<Ii", 20, len(packed)) + packed


def literal_lzw(data: bytes) -> bytes:
    """Literal codes alone, cleared before codes grow: what any decoder reads."""
    bits = "".join(f"{256:09b}" + "".join(f"{b:09b}" for b in data[k : k + 200]) for k in range(0, len(data), 200)) + f"{257:09b}"
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def literal_packbits(data: bytes) -> bytes:
    return b"".join(bytes([len(part) - 1]) + part for part in (data[k : k + 128] for k in range(0, len(data), 128)))


coded("shuffle", shuffled, lambda b: codecs.unshuffle(b, 4))
coded("blosc_zlib", lambda b: blosc_frame(b, 3, zlib.compress), lambda b: codecs.Blosc(b).decode())
coded("blosc_lz4", lambda b: blosc_frame(b, 1, lambda x: __import__("pyarrow").compress(x, "lz4_raw", asbytes=True)), lambda b: codecs.Blosc(b).decode())
coded("blosc_zstd", lambda b: blosc_frame(b, 4, lambda x: __import__("zstandard").compress(x)), lambda b: codecs.Blosc(b).decode())
coded("lzw", literal_lzw, codecs.lzw)
coded("packbits", literal_packbits, codecs.packbits)


def file_ranges(spark, sf_dir):
    """Byte ranges of one file, read by many tasks."""
    path = put(f"{scratch(spark)}/bytes", bytes(k * k % 251 for k in range(4096)))

    def read(batches):
        import pyarrow as pa

        source = ByteSource(path)
        for batch in batches:
            ids = batch.column(0)
            yield pa.record_batch([ids, pa.array([source.read(k % 4096, 1)[0] for k in ids.to_pylist()], pa.int32())], names=["event_id", "byte"])

    return catalogue.read(spark, sf_dir, "events").select("event_id").mapInArrow(read, "event_id long, byte int")


add("file_ranges", "SELECT event_id, CAST((event_id % 4096) * (event_id % 4096) % 251 AS INTEGER) AS byte FROM events", file_ranges)
