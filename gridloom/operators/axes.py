"""Lookups on axes: small tables (one row an index), resolved where the query is planned.

An axis is known before a query runs, so a position, a date or all pixels of a raster become indices on the driver,
at the cost of the axis' and the raster's edge lengths. The big table then sees equality or range predicates only.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.errors import ExtractError
from gridloom.functions.geo import shift_lon
from gridloom.sources.files import scratch


def read_axis(axis: DataFrame, index: str, coordinate: str) -> list[float]:
    """Coordinates of an axis table in index order. An axis is as long as one edge of a grid."""
    return [r[0] for r in axis.orderBy(index).select(coordinate).collect()]


class Axis:
    """Coordinates of one dimension; nearest index by binary search, the lower index at equal distance."""

    def __init__(self, coordinates: list[float]):
        if not coordinates:
            raise ExtractError("an axis without coordinates")
        self.coordinates = coordinates
        self.order = sorted(range(len(coordinates)), key=lambda i: (coordinates[i], i))
        self.sorted = [coordinates[i] for i in self.order]

    def nearest(self, value: float) -> int:
        at = bisect_left(self.sorted, value)
        near = []
        if at < len(self.sorted):
            near.append(at)
        if at > 0:
            near.append(bisect_left(self.sorted, self.sorted[at - 1]))  # of equal coordinates the lower index
        return min((abs(self.sorted[k] - value), self.order[k]) for k in near)[1]

    def nearest_lon(self, lon: float) -> int:
        """The longitude may be given on 0..360 or -180..180, whatever the axis uses."""
        return self.nearest(shift_lon(lon, self.sorted[0], self.sorted[-1]))

    def window(self, low: float, high: float) -> tuple[int, int] | None:
        """First and last index whose coordinate lies in [low, high], whichever way the axis runs."""
        inside = [i for i, c in enumerate(self.coordinates) if low <= c <= high]
        return (min(inside), max(inside)) if inside else None

    def covers(self, value: float) -> bool:
        """Within half a step of the outer coordinates."""
        if len(self.sorted) < 2:
            return True
        return self.sorted[0] - abs(self.sorted[1] - self.sorted[0]) / 2 <= value <= self.sorted[-1] + abs(self.sorted[-1] - self.sorted[-2]) / 2


def clamp_range(t1: int | None, t2: int | None, size: int) -> tuple[int, int]:
    """An inclusive index range within 0..size-1; a reversed range is its first index alone."""
    low = min(max(t1 or 0, 0), size - 1)
    high = size - 1 if t2 is None else min(max(t2, 0), size - 1)
    return low, max(low, high)


def nearest_row(axis: DataFrame, coordinate: str, index: str, value: float) -> DataFrame:
    """The same lookup as a one-row table, for an axis that stays distributed."""
    return axis.agg(F.min_by(F.struct(index, coordinate), F.struct(F.abs(F.col(coordinate) - value), index)).alias("a")).select("a.*")


def select_dates(axis: DataFrame, low: str, high: str, time: str = "ts", index: str = "t") -> DataFrame:
    """Steps in [low, high]; if there is none, the step nearest to the middle of the range (the lower index at a tie).

    ``low`` and ``high`` are ISO instants. One pass: the fallback is an aggregate beside the selection.
    """
    a, b = F.to_timestamp(F.lit(low)), F.to_timestamp(F.lit(high))
    middle = (F.unix_micros(a) + F.unix_micros(b)) / 2
    inside = F.col(time).between(a, b)
    spare = axis.agg(F.max(inside).alias("_any"), F.min_by(index, F.struct(F.abs(F.unix_micros(time) - middle), index)).alias("_spare"))
    return axis.join(F.broadcast(spare), F.when(F.col("_any"), inside).otherwise(F.col(index) == F.col("_spare"))).drop("_any", "_spare")


def monotonic(axis: DataFrame, index: str, coordinate: str) -> DataFrame:
    """One row: ascending, descending, strictly in both cases. The axis' own window is as long as an edge."""
    step = F.col(coordinate) - F.lag(coordinate).over(W.orderBy(index))
    return axis.select(step.alias("d")).agg(F.coalesce(F.bool_and(F.col("d") > 0), F.lit(True)).alias("ascending"), F.coalesce(F.bool_and(F.col("d") < 0), F.lit(True)).alias("descending"))


#: Distinct coordinates of a range.
RANGE = 1 << 20


def following(values: np.ndarray, tolerance: float) -> np.ndarray:
    """For each of the sorted values the place of the first one that is more than the tolerance above it."""
    n = len(values)
    at = np.searchsorted(values, values + tolerance - 4 * np.spacing(np.abs(values) + tolerance), "left")
    at = np.maximum(at, np.arange(n) + 1)
    while (short := (at < n) & (values[np.minimum(at, n - 1)] - values <= tolerance)).any():  # sums round, differences decide
        at[short] += 1
    return at


def chains(values: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the sorted values that is the first to be kept of them: the value that follows it (place), the last one that is
    kept then (place), and how many are. By doubling the steps."""
    n = len(values)
    after = following(values, tolerance)
    to = np.where(after < n, after, np.arange(n))
    count = (after < n).astype(np.int64)
    while not np.array_equal(further := to[to], to):
        count, to = count + count[to], further
    return after, to, count + 1


def unique_coordinates(points: DataFrame, coordinate: str, tolerance: float = 1e-9, most: int = RANGE) -> DataFrame:
    """Distinct coordinates in order with their index, those within ``tolerance`` of the last kept one dropped.

    Whether a coordinate is kept depends on the one kept before. Distinct values are dealt in ranges; each range turns every
    value that it may keep first, those within the tolerance of its least and one more, into the last that it keeps then and
    a count. Going through these rows, not the values, gives every range the value kept before it and its first index, and
    the ranges are resolved at once. Rows are few where ranges are wider than the tolerance, and never more than the values.
    """
    spark = points.sparkSession
    folder = scratch(spark)
    distinct = points.where(F.col(coordinate).isNotNull() & ~F.isnan(coordinate)).select(F.col(coordinate).cast("double").alias("c")).distinct()
    distinct.write.parquet(f"{folder}/distinct")
    distinct = spark.read.parquet(f"{folder}/distinct")
    parts = max(1, -(-distinct.count() // most))
    distinct.repartitionByRange(parts, "c").withColumn("part", F.spark_partition_id()).write.parquet(f"{folder}/ranges")
    ranges = spark.read.parquet(f"{folder}/ranges").repartition(parts, "part").sortWithinPartitions("part", "c")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """Ranges, which are in order; one at a time is held."""
        part, held = None, []
        for batch in batches:
            values, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(own)) + 1
            for x, y in zip([0, *cuts], [*cuts, len(own)], strict=True):
                if y > x:
                    if own[x] != part and held:
                        yield part, np.concatenate(held)
                        held = []
                    part = int(own[x])
                    held.append(values[x:y])
        if held:
            yield part, np.concatenate(held)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in whole(batches):
            _, to, count = chains(values, tolerance)
            n = min(len(values), int(np.searchsorted(values, values[0] + tolerance + 4 * np.spacing(abs(values[0]) + tolerance), "right")) + 1)
            starts = np.flatnonzero(np.append(np.diff(to[:n]) != 0, True) | np.append(np.diff(count[:n]) != 0, True))  # the last of those that end alike
            yield pa.record_batch([pa.array([part] * len(starts), pa.int32()), pa.array(values[starts]), pa.array(values[to[starts]]), pa.array(count[starts])], names=["part", "start", "last", "n"])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, part = -np.inf, 0, None
        for batch in batches:
            out = []
            for own, start, end, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != part and start - last > tolerance:
                    out.append((own, last, n))
                    last, n, part = end, n + count, own
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.float64(), pa.int64()), strict=True)], names=["part", "last", "n"])

    rows = ranges.select("c", "part").mapInArrow(summarise, "part int, start double, last double, n long")
    begun = {r["part"]: (r["last"], r["n"]) for r in rows.repartition(1).sortWithinPartitions("part", "start").mapInArrow(compose, "part int, last double, n long").collect()}  # a row a range

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in whole(batches):
            if part not in begun:
                continue
            last, n = begun[part]
            after, kept = following(values, tolerance).tolist(), []
            at = int(np.flatnonzero(values - last > tolerance)[0])
            while at < len(values):
                kept.append(at)
                at = after[at]
            for k in range(0, len(kept), 1 << 18):
                own = kept[k : k + (1 << 18)]
                yield pa.record_batch([pa.array(range(n + k, n + k + len(own)), pa.int32()), pa.array(values[own], pa.float64())], names=["i", coordinate])

    return ranges.select("c", "part").mapInArrow(resolve, f"i int, `{coordinate}` double")


def pixel_map(spark: SparkSession, names: tuple[str, str], indices: list[int | None]) -> DataFrame:
    """(pixel, index) rows of one raster edge, pixels without an index left out."""
    return spark.createDataFrame([(k, i) for k, i in enumerate(indices) if i is not None], f"{names[0]} int, {names[1]} int")
