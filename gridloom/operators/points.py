"""Operators on point tables: selection by box, nearest station, frames, mesh detection, mean-bin rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.geo import bin_index, haversine
from gridloom.functions.units import finite

Box = tuple[float, float, float, float]
#: Targets of ``nearest`` that are columns of one aggregate.
MANY = 32


def in_box(lat: Column, lon: Column, box: Box) -> Column:
    """Inside (minLon, minLat, maxLon, maxLat), bounds included; a box with minLon > maxLon crosses the antimeridian."""
    west, south, east, north = box
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & across


def rasterize_mean(points: DataFrame, box: Box, width: int, height: int, value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and count of the finite values in each cell of a ``height`` x ``width`` raster, row 0 in the north.

    One partial aggregation before the only shuffle, whose size is bounded by the raster, not by the points.
    """
    west, south, east, north = box
    lat, lon, v = F.col("lat"), F.col("lon"), finite(F.col(value).cast("double"))
    inside = points.where(lat.between(south, north) & lon.between(west, east) & v.isNotNull())
    row = bin_index(-lat, -north, -south, height).alias("r")
    return inside.groupBy(*by, row, bin_index(lon, west, east, width).alias("c")).agg(F.avg(v).alias("value"), F.count(F.lit(1)).alias("n"))


def densify(raster: DataFrame, width: int, height: int) -> DataFrame:
    """Every cell of the raster, null where it was empty."""
    spark = raster.sparkSession
    pixels = spark.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("r"), (F.col("id") % width).cast("int").alias("c"))
    return pixels.join(raster, ["r", "c"], "left")


def squared_degrees(lat: Column, lon: Column, at: tuple[float, float]) -> Column:
    return (lat - at[0]) * (lat - at[0]) + (lon - at[1]) * (lon - at[1])


def nearest(points: DataFrame, targets: list[tuple[float, float]], distance=squared_degrees, id_col: str = "event_id") -> DataFrame:
    """For each (lat, lon) target the nearest point, the smaller id at equal distance: query, distance, and all columns.

    All targets share one pass and one partial aggregate; nothing is joined. Beyond ``MANY`` targets, and for a table of any
    number of them, ``nearest.nearest_many`` goes down a tree of cells; distances of one's own meet every row then. All columns
    are carried along: select the needed ones first.
    """
    metric = {squared_degrees: "degrees", by_haversine: "sphere"}.get(distance)
    if len(targets) > MANY and metric:
        from gridloom.operators.nearest import nearest_many

        asked = points.sparkSession.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(targets)], "query int, lat double, lon double")
        found = nearest_many(points, asked, id_col, metric=metric).where("point is not null")
        return found.join(asked.select("query", F.col("lat").alias("at_lat"), F.col("lon").alias("at_lon")), "query").select("query", "at_lat", "at_lon", "point.*")
    if len(targets) > MANY:
        known = F.array(*(F.struct(F.lit(k).alias("query"), F.lit(float(at[0])).alias("at_lat"), F.lit(float(at[1])).alias("at_lon")) for k, at in enumerate(targets)))
        pairs = points.select(F.struct("*").alias("p"), F.explode(known).alias("q"))
        d = distance(F.col("p.lat"), F.col("p.lon"), (F.col("q.at_lat"), F.col("q.at_lon")))
        best = pairs.groupBy("q").agg(F.min_by("p", F.struct(d.alias("d"), F.col(f"p.{id_col}"))).alias("p"))
        return best.select("q.query", "q.at_lat", "q.at_lon", "p.*")
    found = points.agg(*(F.min_by(F.struct("*"), F.struct(distance(F.col("lat"), F.col("lon"), at).alias("d"), id_col)).alias(f"q{k}") for k, at in enumerate(targets)))
    each = F.array(*(F.struct(F.lit(k).alias("query"), F.lit(at[0]).alias("at_lat"), F.lit(at[1]).alias("at_lon"), F.col(f"q{k}").alias("p")) for k, at in enumerate(targets)))
    return found.select(F.explode(each).alias("q")).select("q.query", "q.at_lat", "q.at_lon", "q.p.*")


def by_haversine(lat: Column, lon: Column, at: tuple) -> Column:
    return haversine(lat, lon, *(x if isinstance(x, Column) else F.lit(x) for x in at))


def station_series(points: DataFrame, at: tuple[float, float], value: str = "value", id_col: str = "event_id", tolerance: float = 1e-9) -> DataFrame:
    """Values over time at the station nearest to ``at``; at equal times the last row by id wins.

    The station is found first (one row to the driver), so that its rows are a pushed-down range filter.
    """
    best = nearest(points.where("lat is not null and lon is not null").select(id_col, "lat", "lon"), [at], id_col=id_col).select("lat", "lon").first()
    if best is None or best.lat is None:
        return points.where(F.lit(False)).select("ts", "lat", "lon", value)
    near = points.where(F.col("lat").between(best.lat - tolerance, best.lat + tolerance) & F.col("lon").between(best.lon - tolerance, best.lon + tolerance))
    return near.groupBy("ts").agg(*(F.max_by(c, id_col).alias(c) for c in ("lat", "lon", value)))


def frames(points: DataFrame, time: str = "ts") -> DataFrame:
    """``points`` with ``frame``: the position of the row's time among all distinct times, from 0.

    Ranks are taken within a day and shifted by the distinct times of the days before: no task orders all times.
    """
    times = points.select(F.col(time).alias("_t")).where("_t is not null").distinct().withColumn("_day", F.to_date("_t"))
    days = times.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    before = days.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = times.withColumn("_k", F.row_number().over(W.partitionBy("_day").orderBy("_t")) - 1).join(before, "_day")
    index = numbered.select("_t", (F.col("_before") + F.col("_k")).cast("int").alias("frame"))
    return points.join(index, F.col(time) == F.col("_t"), "left").drop("_t")


def classify(points: DataFrame, time: str = "frame", threshold: float = 0.5) -> DataFrame:
    """One row: nx, ny, pairs, occupancy, has_duplicates, grid_type ('mesh' if no cell repeats in a frame and enough
    cells of the lat x lon grid occur, else 'point'). Two aggregations, the first by cell and frame."""
    cells = points.where("lat is not null and lon is not null").groupBy("lat", "lon", time).agg(F.count(F.lit(1)).alias("n"))
    out = cells.agg(
        F.countDistinct("lon").alias("nx"), F.countDistinct("lat").alias("ny"), F.countDistinct("lat", "lon").alias("pairs"),
        F.coalesce(F.max(F.col("n") > 1), F.lit(False)).alias("has_duplicates"),
    )
    out = out.withColumn("occupancy", F.coalesce(F.try_divide(F.col("pairs").cast("double"), F.col("nx") * F.col("ny")), F.lit(0.0)))
    return out.withColumn("grid_type", F.when(~F.col("has_duplicates") & (F.col("occupancy") >= threshold), "mesh").otherwise("point"))


def pivot_mesh(points: DataFrame, keys: tuple[str, ...] = ("t", "iy", "ix"), value: str = "value", order: str = "event_id") -> DataFrame:
    """One value a cell: the last row by ``order`` wins."""
    return points.groupBy(*keys).agg(F.max_by(value, order).alias(value))
