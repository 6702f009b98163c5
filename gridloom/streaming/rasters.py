"""Streams of points and of arriving grid files. An extension: the batch operators, fed by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.functions.geo import bin_index
from gridloom.functions.units import finite
from gridloom.sources import grids

Box = tuple[float, float, float, float]


def stream_points(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 16) -> DataFrame:
    """Rows of Parquet files as they arrive below a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def rasterize_windows(points: DataFrame, box: Box, width: int, height: int, window: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Mean and count of each raster cell in each time window; rows later than the watermark are dropped.

    State is one (sum, count) pair for each open window and cell, whatever the number of points.
    """
    west, south, east, north = box
    lat, lon, v = F.col("lat"), F.col("lon"), finite(F.col("value").cast("double"))
    inside = points.withWatermark(time, late).where(lat.between(south, north) & lon.between(west, east) & v.isNotNull())
    cell = (F.window(time, window), bin_index(-lat, -north, -south, height).alias("r"), bin_index(lon, west, east, width).alias("c"))
    out = inside.groupBy(*cell).agg(F.avg(v).alias("value"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "r", "c", "value", "n")


def stream_cells(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Cells (path, variable, t, iy, ix, value) of grid files as they arrive below a folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(path)
    return grids.decode_files(files.select("path"))
