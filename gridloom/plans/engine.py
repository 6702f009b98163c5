"""The verbs over files: scan, extract a series, extract a grid, trim, encode, render.

Positions and dates become indices on the driver, from axes alone; the rest is a filter on the table of blocks, the
decoding of what is left, and DataFrame operators.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import ExtractError, TrimError, UnsupportedFormatError
from gridloom.functions.times import date_bounds, parse_instant
from gridloom.operators.axes import Axis, clamp_range
from gridloom.operators.catalog import require_variables
from gridloom.operators.cubes import Cube
from gridloom.sources import encoders, geotiff, grib2, grids, hdf5, netcdf3, sinks, trims, writers, zarr
from gridloom.sources.detect import detect_format
from gridloom.sources.files import ByteSource
from gridloom.sources.model import Variable, find

Box = tuple[float, float, float, float]
#: Rows of an axis up to which it is broadcast.
MANY = 50_000


@dataclass
class Dataset:
    """A file opened once and queried many times."""

    spark: SparkSession
    path: str
    format: str = ""
    _reader: object = None
    _variables: list[Variable] = field(default_factory=list)

    def __post_init__(self):
        self.format, self._reader = grids.open_reader(self.path)
        self._variables = self._reader.variables()

    def scan(self) -> DataFrame:
        return grids.scan(self.spark, [self.path])

    def names(self) -> list[str]:
        return [v.name for v in self._variables]

    def variable(self, name: str | None) -> Variable:
        return find(self._variables, name) if name is not None else next(v for v in self._variables if v.supported)

    def cube(self, name: str | None = None, t: tuple[int, int] | None = None, y: tuple[int, int] | None = None, x: tuple[int, int] | None = None) -> Cube:
        """The variable as a cube, of its blocks only those that hold the index ranges."""
        v = self.variable(name)
        chosen = grids.blocks(self.spark, [self.path], [v.name], t, y, x)
        return Cube(grids.decode(chosen).select("t", "iy", "ix", F.col("value").cast("double").alias("value")), Axis(v.y), Axis(v.x), list(map(int, v.times)) or list(range(v.shape[0])), v.projection())

    def steps(self, v: Variable, t1: int | None, t2: int | None, date: str | None, dates: tuple[str, str] | None) -> tuple[int, int]:
        """Index range of a query's time options, which exclude each other."""
        given = [name for name, there in (("t1/t2", t1 is not None or t2 is not None), ("date", date is not None), ("dates", dates is not None)) if there]
        if len(given) > 1:
            raise ExtractError(f"{' and '.join(given)} exclude each other")
        if not given or given == ["t1/t2"]:
            return clamp_range(t1, t2, v.shape[0])
        if not v.times:
            raise ExtractError(f"{v.name} has no dates")
        if date is not None:
            at = Axis(v.times).nearest(parse_instant(date).timestamp())
            return at, at
        low, high = (parse_instant(d).timestamp() for d in date_bounds(*dates))
        inside = [k for k, s in enumerate(v.times) if low <= s <= high]
        middle = Axis(v.times).nearest((low + high) / 2)
        return (min(inside), max(inside)) if inside else (middle, middle)

    def extract(self, variable: str | Sequence[str] | None = None, lat: float | None = None, lon: float | None = None, t1: int | None = None, t2: int | None = None, date: str | None = None, dates: tuple[str, str] | None = None) -> DataFrame:
        """variable, t, time, lat, lon, value: at the cell nearest to a point, along a line, or everywhere.

        Several variables give one long table; where a point lies off a variable's grid its nearest cell answers.
        """
        names = [variable] if isinstance(variable, str) else require_variables(self.names(), None if variable is None else list(variable), [v.name for v in self._variables if v.supported])
        out = None
        for name in names:
            v = self.variable(name)
            low, high = self.steps(v, t1, t2, date, dates)
            axes = Cube(None, Axis(v.y), Axis(v.x), [], v.projection())
            y = x = None
            if lat is not None and lon is not None:
                iy, ix = axes.locate(lat, lon)
                y, x = (iy, iy), (ix, ix)
            elif lat is not None:
                y = (axes.y.nearest(lat),) * 2
            elif lon is not None:
                x = (axes.x.nearest_lon(lon),) * 2
            cells = self.cube(name, (low, high), y, x).cells.where(F.col("t").between(low, high))
            for column, chosen in (("iy", y), ("ix", x)):
                if chosen:
                    cells = cells.where(F.col(column) == chosen[0])
            # An axis is a table of its own, joined where the cells are, as long as it may be.
            places = []
            for axis, c, chosen in ((v.y, "iy", y), (v.x, "ix", x)):
                if chosen is None:
                    table = self.spark.createDataFrame(list(enumerate(map(float, axis))), f"{c} int, _{c} double")
                    cells = cells.join(F.broadcast(table) if len(axis) <= MANY else table, c)
                places.append(F.col(f"_{c}") if chosen is None else F.lit(float(axis[chosen[0]])))
            py, px = places
            clat, clon = v.projection().inverse(px, py)
            # One row for each step of the axis, joined where the cells are.
            axis = self.spark.createDataFrame([(k, float(s)) for k, s in enumerate(v.times) if low <= k <= high], "t int, seconds double")
            cells = cells.join(F.broadcast(axis) if high - low < MANY else axis, "t", "left")
            rows = cells.select(F.lit(name).alias("variable"), "t", F.timestamp_seconds("seconds").alias("time"), clat.alias("lat"), clon.alias("lon"), "value")
            out = rows if out is None else out.unionByName(rows)
        return out

    def spans(self, v: Variable, box: Box, width: int, height: int, clamp: bool = False) -> tuple[tuple[int, int] | None, tuple[int, int] | None]:
        """Index ranges on y and x that a raster's pixels lie in (none: all); known from the axes alone on geographic grids."""
        if v.projection().kind != "geographic":
            return None, None
        found = Cube(None, Axis(v.y), Axis(v.x), [], v.projection()).pixel_indices(box, width, height, clamp)
        inside = [[k for k in axis if k is not None] for axis in found]
        return tuple((min(own, default=0), max(own, default=-1)) for own in inside)

    def blocks_of_grid(self, variable: str | None, box: Box, width: int, height: int, t: int = 0, clamp: bool = False) -> DataFrame:
        """The blocks that ``extract_grid`` reads."""
        v = self.variable(variable)
        coarse = self.at_pixels(v, box, width, height)
        return grids.blocks(self.spark, [coarse.path], [v.name], (t, t), *coarse.spans(coarse.variable(v.name), box, width, height, clamp))

    def at_pixels(self, v: Variable, box: Box, width: int, height: int) -> Dataset:
        """The dataset, or that of the overview which suits pixels of this size."""
        if not getattr(self._reader, "overviews", None) or "#overview=" in self.path:
            return self
        west, south, east, north = box
        pixels = ((east - west) / width, (north - south) / height)
        if v.projection().kind != "geographic":  # in metres: by the extent of the box's edges
            across, down = v.projection().extent(box)
            pixels = (across / width, down / height)
        level = self._reader.overview_for(*pixels)
        return Dataset(self.spark, f"{self.path}#overview={level}") if level else self

    def extract_grid(self, variable: str | None = None, box: Box | None = None, width: int = 256, height: int = 256, t: int | None = None, date: str | None = None, clamp: bool = False) -> Grid:
        """A nearest-neighbour raster of one step over a geographic box, by default the file's extent. Of a file with overviews the
        coarsest image answers whose pixels are no larger than the raster's, so that what is read follows the output."""
        v = self.variable(variable)
        box = box or v.bbox()
        coarse = self.at_pixels(v, box, width, height)
        if coarse is not self:
            return coarse.extract_grid(v.name, box, width, height, t, date, clamp)
        at, _ = self.steps(v, t, t, date, None)
        cube = self.cube(v.name, (at, at), *self.spans(v, box, width, height, clamp))
        time = datetime.fromtimestamp(v.times[at], UTC) if v.times else None
        return Grid(cube.raster(box, width, height, at, clamp), box, width, height, v.name, v.units, time)


@dataclass
class Grid:
    """A raster (r, c, value) with what describes it; row 0 is the north."""

    cells: DataFrame
    box: Box
    width: int
    height: int
    variable: str = "value"
    units: str = ""
    time: datetime | None = None

    def to_array(self) -> np.ndarray:
        """The raster as a float32 array on the driver: width x height values, NaN where there is none."""
        out = np.full((self.height, self.width), np.nan, np.float32)
        for r in self.cells.where("value is not null").toLocalIterator():
            out[r["r"], r["c"]] = r["value"]
        return out

    def centres(self) -> tuple[list[float], list[float]]:
        west, south, east, north = self.box
        return [north - (k + 0.5) * (north - south) / self.height for k in range(self.height)], [west + (k + 0.5) * (east - west) / self.width for k in range(self.width)]


def extract_output(source: Dataset, fmt: str, **options) -> bytes:
    """A point's series straight to a file format; the format is checked before anything is read."""
    sinks.resolve_format(fmt, "series")
    return encode_series(source.extract(**options), fmt)


def extract_grid_output(source: Dataset, fmt: str, **options) -> bytes:
    """A raster straight to a file format, ``png`` included."""
    if fmt.lower() == "png":
        return grid_to_image(source.extract_grid(**options))
    sinks.resolve_format(fmt, "grid")
    return encode_grid(source.extract_grid(**options), fmt)


def detect(path: str) -> str | None:
    return detect_format(path)


def encode_grid(grid: Grid, fmt: str) -> bytes:
    """A raster in a file format. JSON, CSV and Parquet of large rasters are better written by ``sinks``."""
    return encoders.grid(grid, sinks.resolve_format(fmt, "grid").name)


def encode_series(rows: DataFrame, fmt: str) -> bytes:
    """A series of one variable at one place in a file format."""
    return encoders.series(rows, sinks.resolve_format(fmt, "series").name)


def write_grid(grid: Grid, fmt: str, out: str, tile: int = 256) -> str:
    """A raster of any size written by tasks, as a ``zarr`` folder, a tiled ``geotiff`` with overviews or ``netcdf3``; ``out``."""
    return writers.write_grid(grid, fmt, out, tile)


def trim_to(spark: SparkSession, path: str, out: str, variables: list[str] | None = None, t1: int | None = None, t2: int | None = None, box: Box | None = None) -> Trimmed:
    """``trim`` for files of any size: tasks read and write only what is kept, and ``out`` appears when it is whole. A Zarr store
    becomes a folder. HDF5 files are cut by ``trim``."""
    _checked(box, t1, t2)
    kind, reader = grids.open_reader(path)
    if kind in ("grib2", "netcdf3") and box is not None:
        raise TrimError(f"{kind} files can't be cut to a box")
    warnings = trims.trim_to(spark, path, kind, out, variables, t1, t2, box)
    return Trimmed(None, kind, warnings, {"variables_before": len(reader.variables()), "variables_after": len(grids.open_reader(out)[1].variables())})


def _checked(box: Box | None, t1: int | None, t2: int | None) -> None:
    if box is not None and not (len(box) == 4 and box[2] > box[0] and box[3] > box[1]):
        raise TrimError("a box is (minLon, minLat, maxLon, maxLat)")
    if t1 is not None and t2 is not None and t2 < t1:
        raise TrimError("t2 is below t1")


def trim(path: str, variables: list[str] | None = None, t1: int | None = None, t2: int | None = None, box: Box | None = None) -> Trimmed:
    """A smaller file of the same format, as bytes on the driver."""
    _checked(box, t1, t2)
    source = ByteSource(path)
    kind = detect_format(source)
    if kind in ("grib2", "netcdf3") and box is not None:
        raise TrimError(f"{kind} files can't be cut to a box")
    if kind == "grib2":
        data, warnings = grib2.trim(source, variables, t1, t2), []
    elif kind == "netcdf3":
        data, warnings = netcdf3.trim(source, variables, t1, t2), []
    elif kind == "zarr":
        data, warnings = zarr.trim(source, variables, t1, t2, box)
    elif kind == "tiff":
        data, warnings = geotiff.trim(source, variables, box)
    elif kind == "netcdf4":
        data, warnings = hdf5.trim(source, variables, t1, t2, box)
    else:
        raise UnsupportedFormatError(f"{path}: {kind} can't be trimmed")
    had, has = (len(grids.open_reader(b)[1].variables()) if b is not None else 0 for b in (source, data or None))
    return Trimmed(data, kind, warnings, {"bytes_before": source.size, "bytes_after": len(data), "variables_before": had, "variables_after": has})


@dataclass
class Trimmed:
    data: bytes | None
    format: str
    warnings: list[str]
    stats: dict[str, int]


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Jobs started inside carry the tag; ``spark.sparkContext.cancelJobsWithTag(tag)``, from any thread, stops them."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


@contextmanager
def watched(spark: SparkSession, report: Callable[[int, int], bool | None], every: float = 0.2):
    """Calls ``report(tasks done, tasks known)`` while jobs started inside run, and once at their end; if it returns False they are
    stopped. Stages become known as they are planned, so that the second number grows; those that are skipped, as their output is
    there, stay undone."""
    tag, over = f"gridloom-{uuid.uuid4().hex}", threading.Event()
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    seen: dict[int, tuple[int, int]] = {}

    def look() -> bool:
        for stage in {s for job in context._jsc.sc().statusTracker().getJobIdsForTag(tag) if (info := tracker.getJobInfo(job)) for s in info.stageIds}:
            if info := tracker.getStageInfo(stage):
                seen[stage] = (info.numCompletedTasks, info.numTasks)
        stop = report(sum(d for d, _ in seen.values()), sum(n for _, n in seen.values())) is False
        if stop:
            context.cancelJobsWithTag(tag)
        return stop

    def run() -> None:
        while not over.wait(every):
            if look():
                return

    thread = threading.Thread(target=run, daemon=True)
    context.addJobTag(tag)
    thread.start()
    try:
        yield
    finally:
        context.removeJobTag(tag)
        over.set()
        thread.join()
        look()


def grid_to_image(grid: Grid, ramp="viridis", vmin: float | None = None, vmax: float | None = None) -> bytes:
    """A raster as a PNG, transparent where there is no value."""
    return encoders.png(encoders.rgba(grid.to_array(), ramp, vmin, vmax))
