"""Text and table sinks: CSV, JSON, GeoJSON and Parquet written by Spark itself, in parallel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.errors import UnsupportedExportError
from gridloom.functions.units import finite

Box = tuple[float, float, float, float]


@dataclass(frozen=True)
class Export:
    """What a format can hold."""

    name: str
    grid: bool
    series: bool
    binary: bool


#: The formats that results can be written to.
EXPORT_FORMATS = {
    e.name: e
    for e in (
        Export("json", True, True, False), Export("csv", True, True, False), Export("parquet", True, True, True), Export("geotiff", True, False, True),
        Export("netcdf3", True, True, True), Export("netcdf4", True, True, True), Export("zarr", True, True, True), Export("grib2", True, False, True),
    )
}
#: Other names of the formats.
ALIASES = {"tif": "geotiff", "tiff": "geotiff", "cog": "geotiff", "nc": "netcdf3", "netcdf": "netcdf3", "nc3": "netcdf3", "nc4": "netcdf4", "hdf5": "netcdf4", "grb2": "grib2", "grib": "grib2", "geoparquet": "parquet"}


def resolve_format(name: str, kind: str) -> Export:
    """The export format of that name, which must hold ``kind`` (grid or series)."""
    found = EXPORT_FORMATS.get(ALIASES.get(name.lower(), name.lower()))
    if found is None:
        raise UnsupportedExportError(f"no export format {name!r}; there are {', '.join(EXPORT_FORMATS)}")
    if not getattr(found, kind):
        raise UnsupportedExportError(f"{found.name} can't hold a {kind}")
    return found


def grid_rows(raster: DataFrame, variable: str, box: Box, width: int, height: int) -> DataFrame:
    """variable, lat, lon (of pixel centres), value (null where there is none)."""
    west, south, east, north = box
    lat = F.lit(north) - (F.col("r") + 0.5) * ((north - south) / height)
    lon = F.lit(west) + (F.col("c") + 0.5) * ((east - west) / width)
    return raster.select(F.lit(variable).alias("variable"), lat.alias("lat"), lon.alias("lon"), finite(F.col("value").cast("double")).alias("value"))


def series_rows(series: DataFrame, variable: str, time: Column, lat: float, lon: float) -> DataFrame:
    """variable, time, value, lat, lon."""
    return series.select(F.lit(variable).alias("variable"), time.alias("time"), finite(F.col("value").cast("double")).alias("value"), F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))


def write_csv(rows: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """CSV with a header; ranges of the order go to consecutive files, each in order."""
    (rows.orderBy(*[F.col(c[1:]).desc() if c[0] == "-" else F.col(c) for c in order]) if order else rows).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_parquet(rows: DataFrame, path: str, units: dict[str, str] | None = None) -> None:
    """Parquet; units go to the fields' metadata, which Spark keeps in the file."""
    for name, unit in (units or {}).items():
        rows = rows.withMetadata(name, {"units": unit})
    rows.write.mode("overwrite").parquet(path)


def feature(lon: Column, lat: Column, properties: Column) -> Column:
    """A GeoJSON point feature as text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"})


def write_geojson_lines(features: DataFrame, path: str) -> None:
    """One feature a line (newline-delimited GeoJSON), so that the sink stays parallel."""
    features.select(F.col("feature").alias("value")).write.mode("overwrite").text(path)


def feature_collection(features: DataFrame) -> str:
    """A small result as one FeatureCollection; meant for results that go to a screen."""
    return '{"type":"FeatureCollection","features":[' + ",".join(r[0] for r in features.select("feature").toLocalIterator()) + "]}"
