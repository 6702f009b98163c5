"""Parquet tables of points: which columns are place, time and values; geometries; mesh or scattered; queries.

Reading, column pruning and row-group pruning are Spark's own.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.errors import ExtractError, UnsupportedFormatError
from gridloom.functions.projections import CRS, from_epsg
from gridloom.functions.text import epsg_code
from gridloom.functions.times import date_bounds, guess_seconds
from gridloom.operators import axes, points
from gridloom.operators.cubes import Cube

#: Names of columns by role, in order of preference.
ALIASES = {"lat": ("lat", "latitude", "y"), "lon": ("lon", "longitude", "x"), "time": ("time", "datetime", "date", "timestamp", "valid_time")}
NUMBERS = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Roles:
    """Columns of a point table: lat and lon, or a geometry; perhaps a time; the rest that is numeric are values."""

    lat: str | None
    lon: str | None
    time: str | None
    geometry: str | None
    values: tuple[str, ...]


def geo_metadata(spark: SparkSession, path: str) -> dict | None:
    """The file's ``geo`` entry. A footer's key-value pairs aren't in Spark's schema, so one footer is read here."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from gridloom.sources.files import ByteSource

    first = next((f for f in spark.read.parquet(path).inputFiles()), None)
    if first is None:
        return None
    source = ByteSource(first)
    size = int.from_bytes(source.tail(8)[:4], "little") + 8
    # Only the footer's bytes, behind as many zeros as the file has before it.
    found = pq.read_metadata(pa.BufferReader(b"PAR1" + source.tail(size))).metadata or {}
    try:
        return json.loads(found[b"geo"])
    except (KeyError, ValueError):
        return None


def find_roles(frame: DataFrame, geo: dict | None = None, **chosen: str) -> Roles:
    """Roles by explicit choice, else geometry metadata, else well-known names in any case."""
    names = {c.lower(): c for c in reversed(frame.columns)}
    for role, name in chosen.items():
        if name not in frame.columns:
            raise ExtractError(f"no column {name!r} for {role}; there are {', '.join(frame.columns)}")
    pick = lambda role: chosen.get(role) or next((names[a] for a in ALIASES[role] if a in names), None)
    lat, lon, time = pick("lat"), pick("lon"), pick("time")
    geometry = chosen.get("geometry") or ((geo or {}).get("primary_column") if not {"lat", "lon"} & set(chosen) else None)
    if geometry not in frame.columns:
        geometry = None
    if geometry is None and (lat is None or lon is None):
        raise ExtractError(f"no place among {', '.join(frame.columns)}")
    taken = {time, geometry} | (set() if geometry else {lat, lon})
    values = tuple(f.name for f in frame.schema if isinstance(f.dataType, NUMBERS) and f.name not in taken and not (geometry and f.name in (lat, lon)))
    return Roles(None if geometry else lat, None if geometry else lon, time, geometry, values)


def _double(digits: Column) -> Column:
    """The IEEE double of 16 hexadecimal digits, most significant first, by exact arithmetic."""
    high, low = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
    power = F.shiftright(high, 20).bitwiseAND(2047)
    fraction = (high.bitwiseAND((1 << 20) - 1).cast("double") * 2.0**32 + low.cast("double")) / 2.0**52
    size = F.when(power == 0, fraction * 2.0**-1022).when(power == 2047, None).otherwise((fraction + 1) * F.pow(F.lit(2.0), power - 1023))
    return F.when(high >= 1 << 31, -size).otherwise(size)


def wkb_point(geometry: Column) -> tuple[Column, Column]:
    """(x, y) of a WKB point in either byte order; null for other geometries."""
    digits = F.hex(geometry)
    little = F.substring(digits, 1, 2) == "01"

    def number(at: int, n: int) -> Column:
        forward = F.substring(digits, 2 * at + 1, 2 * n)
        backward = F.concat(*(F.substring(digits, 2 * (at + k) + 1, 2) for k in range(n - 1, -1, -1)))
        return F.when(little, backward).otherwise(forward)

    is_point = F.substring(number(1, 4), 7, 2) == "01"
    return tuple(F.when(is_point & (F.length(geometry) >= 21), _double(number(at, 8))) for at in (5, 13))


def place(frame: DataFrame, roles: Roles, crs: CRS = CRS(), keep: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """``lat`` and ``lon`` in degrees, ``time_s`` where there is a time, the value columns, and those to ``keep``."""
    if roles.geometry is None:
        x, y = F.col(roles.lon).cast("double"), F.col(roles.lat).cast("double")
    else:
        kind, g = frame.schema[roles.geometry].dataType, F.col(roles.geometry)
        if isinstance(kind, T.BinaryType):
            x, y = wkb_point(g)
        elif isinstance(kind, T.ArrayType):
            x, y = F.get(g, F.lit(0)), F.get(g, F.lit(1))
        elif isinstance(kind, T.StructType):
            fields = set(kind.names)
            pair = next((p for p in (("x", "y"), ("lon", "lat")) if set(p) <= fields), None)
            if pair is None and "coordinates" in fields:
                x, y = F.get(g["coordinates"], F.lit(0)), F.get(g["coordinates"], F.lit(1))
            elif pair is None:
                raise UnsupportedFormatError(f"geometry of {kind.simpleString()}")
            else:
                x, y = g[pair[0]], g[pair[1]]
        else:
            raise UnsupportedFormatError(f"geometry of {kind.simpleString()}")
    lat, lon = crs.inverse(x, y)
    extra = [] if roles.time is None else [time_seconds(frame, roles.time).alias("time_s")]
    return frame.select(lat.alias("lat"), lon.alias("lon"), *extra, *roles.values, *keep)


def time_seconds(frame: DataFrame, name: str) -> Column:
    """Unix seconds of a time column: timestamps, dates, ISO texts, or numbers of a guessed unit; null if it is none."""
    kind = frame.schema[name].dataType
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return F.unix_seconds(F.col(name).cast("timestamp"))
    if isinstance(kind, T.StringType):
        return F.coalesce(guess_seconds(F.expr(f"try_cast(`{name}` as double)")), F.unix_seconds(F.try_to_timestamp(F.col(name))))
    return guess_seconds(F.col(name))


class PointTable:
    """A Parquet table of points, opened once and queried many times."""

    def __init__(self, spark: SparkSession, path: str, **chosen: str):
        self.frame = spark.read.parquet(path)
        geo = geo_metadata(spark, path)
        self.roles = find_roles(self.frame, geo, **chosen)
        crs = (geo or {}).get("columns", {}).get(self.roles.geometry or "", {}).get("crs")
        code = None if crs is None else spark.range(1).select(epsg_code(F.lit(crs if isinstance(crs, str) else json.dumps(crs)))).first()[0]
        self.crs = CRS() if code is None else from_epsg(code)
        self.points = place(self.frame, self.roles, self.crs)
        self.path = path

    def bbox(self) -> tuple[float, float, float, float]:
        r = self.points.agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first()
        return tuple(r)

    def grid_type(self) -> DataFrame:
        """One row: mesh or point, with the figures that decide."""
        time = "time_s" if self.roles.time else "_none"
        frame = self.points if self.roles.time else self.points.withColumn("_none", F.lit(0))
        return points.classify(frame, time)

    def select(self, dates: tuple[str, str] | None = None, points: DataFrame | None = None) -> DataFrame:
        """Points in a date range (bounds as ISO dates or instants)."""
        points = self.points if points is None else points
        if dates is None:
            return points
        if self.roles.time is None:
            raise ExtractError("the table has no time")
        low, high = (F.to_timestamp(F.lit(d)) for d in date_bounds(*dates))
        return points.where(F.timestamp_seconds("time_s").between(low, high))

    def extract(self, value: str, lat: float, lon: float, dates: tuple[str, str] | None = None) -> DataFrame:
        """time_s, lat, lon, value at the nearest station; on a mesh that is the nearest cell. The last row of a time wins."""
        # A row's place is its file and number there, whatever tasks the files are split into.
        numbered = self.frame.sparkSession.read.parquet(self.path).withColumn("_at", F.struct("_metadata.file_path", "_metadata.row_index"))
        rows = self.select(dates, place(numbered, self.roles, self.crs, ("_at",)))
        if self.roles.time is None:
            rows = rows.withColumn("time_s", F.lit(0).cast("long"))
        rows = rows.select("_at", F.col("time_s").alias("ts"), "lat", "lon", F.col(value).cast("double").alias("value"))
        return points.station_series(rows, (lat, lon), id_col="_at").withColumnRenamed("ts", "time_s")

    def extract_grid(self, value: str, box: tuple[float, float, float, float] | None = None, width: int = 256, height: int = 256, time_s: int | None = None) -> DataFrame:
        """A raster (r, c, value) of one time (the first unless given): nearest cells of a mesh, means of scattered points."""
        rows = self.points.withColumn("value", F.col(value).cast("double"))
        if self.roles.time is not None:
            at = rows.agg(F.min("time_s")).first()[0] if time_s is None else time_s
            rows = rows.where(F.col("time_s") == at)
        box = box or self.bbox()
        if self.grid_type().first().grid_type == "mesh":
            lats = sorted((r[0] for r in rows.select("lat").distinct().collect()), reverse=True)
            lons = sorted(r[0] for r in rows.select("lon").distinct().collect())
            spark = self.frame.sparkSession
            ymap, xmap = (spark.createDataFrame(list(enumerate(a)), f"{i} int, {c} double") for a, i, c in ((lats, "iy", "lat"), (lons, "ix", "lon")))
            cells = rows.join(F.broadcast(ymap), "lat").join(F.broadcast(xmap), "lon").select(F.lit(0).alias("t"), "iy", "ix", "value")
            return Cube(cells, axes.Axis(lats), axes.Axis(lons), [0]).raster(box, width, height, 0)
        return points.rasterize_mean(rows, box, width, height).select("r", "c", "value")
