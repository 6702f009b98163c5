"""Operators on cubes: tables of cells (t, iy, ix, value) with small axes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.errors import ExtractError
from gridloom.functions.geo import shift_lon
from gridloom.functions.projections import CRS, MERCATOR_MAX_LAT, inverse_mercator_y, mercator_y
from gridloom.operators.axes import Axis, clamp_range, pixel_map

Box = tuple[float, float, float, float]


@dataclass
class Cube:
    """Cells with their axes; axis coordinates are native (degrees, or metres of ``crs``). ``times`` are Unix seconds."""

    cells: DataFrame
    y: Axis
    x: Axis
    times: list[int]
    crs: CRS = CRS()

    def locate(self, lat: float, lon: float) -> tuple[int, int]:
        """(iy, ix) of the nearest cell."""
        if self.crs.kind == "geographic":
            return self.y.nearest(lat), self.x.nearest_lon(lon)
        x, y = self.crs.forward(lat, lon)
        return self.y.nearest(y), self.x.nearest(x)

    def coordinates(self, iy: int, ix: int) -> tuple[float, float]:
        """(lat, lon) of a cell."""
        return self.crs.inverse(self.x.coordinates[ix], self.y.coordinates[iy])

    def series(self, lat: float | None = None, lon: float | None = None, t1: int | None = None, t2: int | None = None) -> DataFrame:
        """Cells at a point (lat and lon), along a line (one of them) or everywhere, for steps t1..t2: t, iy, ix, value.

        Equality and range predicates only: a Parquet scan prunes files and row groups by them.
        """
        out = self.cells
        if lat is not None and lon is not None:
            iy, ix = self.locate(lat, lon)
            out = out.where((F.col("iy") == iy) & (F.col("ix") == ix))
        elif lat is not None:
            out = out.where(F.col("iy") == self.y.nearest(lat))
        elif lon is not None:
            out = out.where(F.col("ix") == self.x.nearest_lon(lon))
        if t1 is not None or t2 is not None:
            low, high = clamp_range(t1, t2, len(self.times))
            out = out.where(F.col("t").between(low, high))
        return out

    def pixel_indices(self, box: Box, width: int, height: int, clamp: bool = False) -> tuple[list[int | None], list[int | None]]:
        """Cell indices of a raster's rows (from the north) and columns; None outside the axes unless ``clamp``."""
        west, south, east, north = box
        if not (east > west and north > south and width > 0 and height > 0):
            raise ExtractError("a box needs maxLon > minLon, maxLat > minLat and a size of one pixel at least")
        lats = [north - (k + 0.5) * (north - south) / height for k in range(height)]
        lons = [west + (k + 0.5) * (east - west) / width for k in range(width)]
        lons = [shift_lon(v, self.x.sorted[0], self.x.sorted[-1]) for v in lons]
        return tuple([a.nearest(v) if clamp or a.covers(v) else None for v in values] for a, values in ((self.y, lats), (self.x, lons)))

    def raster(self, box: Box, width: int, height: int, t: int = 0, clamp: bool = False) -> DataFrame:
        """Nearest-neighbour raster (r, c, value) of one step over a geographic box.

        Rows and columns are resolved separately: height + width lookups, then two joins with maps of that many rows,
        broadcast by their known size. Cells are multiplied to their pixels where they are; nothing is shuffled.
        """
        if self.crs.kind != "geographic":
            return self.projected_raster(box, width, height, t)
        rows, columns = self.pixel_indices(box, width, height, clamp)
        return self._spread(rows, columns, t)

    def _spread(self, rows: list[int | None], columns: list[int | None], t: int) -> DataFrame:
        spark = self.cells.sparkSession
        inside = self.cells.where((F.col("t") == t) & F.col("iy").between(min(filter_none(rows), default=0), max(filter_none(rows), default=-1)) & F.col("ix").between(min(filter_none(columns), default=0), max(filter_none(columns), default=-1)))
        ymap, xmap = pixel_map(spark, ("r", "iy"), rows), pixel_map(spark, ("c", "ix"), columns)
        return inside.join(F.broadcast(ymap), "iy").join(F.broadcast(xmap), "ix").select("r", "c", "value")

    def mercator_raster(self, box: Box, width: int, height: int, t: int = 0) -> DataFrame:
        """The raster with rows evenly spaced in Mercator's y: row r takes a row of the even raster."""
        rows, columns = self.pixel_indices(box, width, height, clamp=True)
        return self._spread([rows[k] for k in mercator_rows(box, height)], columns, t)

    def projected_raster(self, box: Box, width: int, height: int, t: int = 0) -> DataFrame:
        """Pixels are projected one by one, by column expressions; outside the native axes there is no value.

        On regular axes a pixel's cell is arithmetic, so pixels meet cells in one equi-join.
        """
        west, south, east, north = box
        spark = self.cells.sparkSession
        pixels = spark.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("r"), (F.col("id") % width).cast("int").alias("c"))
        lat = F.lit(north) - (F.col("r") + 0.5) * ((north - south) / height)
        lon = F.lit(west) + (F.col("c") + 0.5) * ((east - west) / width)
        x, y = self.crs.forward(lat, lon)
        found = pixels.select("r", "c", *(regular_index(v, a).alias(n) for v, a, n in ((y, self.y, "iy"), (x, self.x, "ix"))))
        return found.where("iy is not null and ix is not null").join(self.cells.where(F.col("t") == t), ["iy", "ix"]).select("r", "c", "value")


def filter_none(values):
    return [v for v in values if v is not None]


def regular_index(value, axis: Axis):
    """Nearest index on an evenly spaced axis, halves up, null beyond half a step outside."""
    first, last, n = axis.coordinates[0], axis.coordinates[-1], len(axis.coordinates)
    step = (last - first) / (n - 1) if n > 1 else 1.0
    at = F.floor((value - first) / step + 0.5).cast("int")
    return F.when((at >= 0) & (at < n), at)


def mercator_rows(box: Box, height: int) -> list[int]:
    """For each row of a Mercator raster the row of the even raster that it shows."""
    _, south, _, north = box
    top, bottom = mercator_y(min(north, MERCATOR_MAX_LAT)), mercator_y(max(south, -MERCATOR_MAX_LAT))
    rows = []
    for k in range(height):
        lat = inverse_mercator_y(top + (k + 0.5) / height * (bottom - top))
        rows.append(min(height - 1, max(0, int((north - lat) / (north - south) * height // 1))))
    return rows


def transect(raster: DataFrame, box: Box, width: int, height: int, at: float, axis: str = "lon") -> DataFrame:
    """Values along a parallel (axis ``lon``) or meridian (``lat``) of a raster: x (coordinate), value.

    Coordinates run from edge to edge of the box, as the raster's outer rows and columns stand for its edges.
    """
    west, south, east, north = box
    if axis == "lon":
        row = round_index((north - at) / (north - south), height)
        x = F.lit(west) + (F.col("c") / (width - 1) if width > 1 else F.lit(0.0)) * (east - west)
        return raster.where(F.col("r") == row).select(x.alias("x"), "value")
    column = round_index((at - west) / (east - west), width)
    y = F.lit(north) - (F.col("r") / (height - 1) if height > 1 else F.lit(0.0)) * (north - south)
    return raster.where(F.col("c") == column).select(y.alias("x"), "value")


def round_index(fraction: float, n: int) -> int:
    """Position of a fraction among n, halves up, clamped."""
    return min(n - 1, max(0, int((fraction * (n - 1) + 0.5) // 1)))


def nearest_curvilinear(cells: DataFrame, lat: float, lon: float) -> DataFrame:
    """The cell of a grid with lat and lon for each cell that lies nearest on the sphere, first in row-major order at a tie."""
    from gridloom.functions.geo import cosine_of_angle

    near = F.struct(cosine_of_angle(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)), -F.col("iy"), -F.col("ix"))
    return cells.where("lat is not null and lon is not null").agg(F.max_by(F.struct("iy", "ix", "lat", "lon"), near).alias("n")).select("n.*")


def nearest_curvilinear_many(cells: DataFrame, targets: DataFrame, target_id: str = "query") -> DataFrame:
    """For each target (``target_id``, lat, lon) the cell of a grid with lat and lon for each cell that lies nearest on the sphere,
    first in row-major order at a tie: ``target_id``, iy, ix, near_lat, near_lon, metres."""
    from gridloom.operators.nearest import nearest_many

    found = nearest_many(cells.select(F.struct("iy", "ix").alias("id"), "lat", "lon"), targets, "id", target_id)
    return found.select(target_id, "point.id.iy", "point.id.ix", F.col("point.lat").alias("near_lat"), F.col("point.lon").alias("near_lon"), F.col("distance").alias("metres"))
