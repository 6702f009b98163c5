"""The nearest point for each of many targets, by a tree of cells that both sides meet in equi-joins.

Positions lie in a cube (the unit sphere inside it, or degrees as a plane), which is cut into cells, each cell of more than ``LEAF``
positions into smaller ones again. A cell knows how many positions it has and one of them. Targets go down the tree level by level,
joined by the cell that they look into: of the cells below, those are left whose nearest corner is no farther than the best
position known. Of the few leaves left at the end, the one with that position is searched first; leaves and positions farther than
what it holds are dropped before any row is sorted, so that a target meets a few positions, not ``LEAF`` of each leaf. On the sphere
there is no edge, so that poles and the 180th meridian are places like others.

No row meets every other: a level's join brings at most ``4 ** (2 * STEP)`` cells to a pair of target and cell, and bounds keep the
pairs of a target few. Positions that are equal are one before anything else. Each level is written to the shared folder, so that a
lost executor costs one level. Cells that many targets look into are one key with few rows on the other side, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.files import scratch

STEP, DEEPEST, LEAF = 2, 20, 64
RADIUS = 6371000.0
#: Squared distances that agree to so many decimals are equal, and the smaller id is taken.
DECIMALS = 12
SHIFT, MASK = 20, (1 << 20) - 1


def on_sphere(lat: Column, lon: Column) -> list[Column]:
    """Unit vectors of degrees."""
    phi, theta = F.radians(lat), F.radians(lon)
    return [F.cos(phi) * F.cos(theta), F.cos(phi) * F.sin(theta), F.sin(phi)]


def on_plane(lat: Column, lon: Column) -> list[Column]:
    """Degrees as plane coordinates below 1; 180 and -180 are far apart."""
    return [lon / 360.0, lat / 360.0, F.lit(0.0)]


METRICS = {"sphere": on_sphere, "degrees": on_plane}


def squared(a: list, b: list) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))


def cell(level: int) -> Column:
    """The number of the cell of (x, y, z) on a level."""
    most = (1 << level) - 1
    parts = [F.greatest(F.least(F.floor((F.col(v) + 1.0) * float(1 << level - 1)), F.lit(most)), F.lit(0)).cast("long") for v in "xyz"]
    return (F.shiftleft(parts[0], 2 * SHIFT) + F.shiftleft(parts[1], SHIFT) + parts[2]).alias("cell")


def parts_of(number: Column) -> list[Column]:
    return [F.shiftright(number, 2 * SHIFT), F.shiftright(number, SHIFT).bitwiseAND(F.lit(MASK)), number.bitwiseAND(F.lit(MASK))]


def parent(number: Column) -> Column:
    x, y, z = (F.shiftright(p, STEP) for p in parts_of(number))
    return F.shiftleft(x, 2 * SHIFT) + F.shiftleft(y, SHIFT) + z


def to_box(level: int, number: Column, at: list[Column]) -> Column:
    """Squared distance from a place to the nearest corner, edge or inside of a cell."""
    width = 2.0 / (1 << level)
    out = F.lit(0.0)
    for part, v in zip(parts_of(number), at, strict=True):
        low = part * width - 1.0
        gap = F.greatest(low - v, v - low - width, F.lit(0.0))
        out = out + gap * gap
    return out


def within(distance: Column, reach: Column) -> Column:
    """Whether a squared distance may agree with ``reach`` when both are rounded."""
    return distance <= reach * (1 + 1e-9) + 2 * 10.0**-DECIMALS


def tree(positions: DataFrame, folder: str) -> list[tuple[int, DataFrame]]:
    """(level, cells) from the coarsest on: parent, cell, leaf, and one position (x, y, z); on each level only below cells that are
    no leaves."""
    spark, out, large = positions.sparkSession, [], None
    for level in range(STEP, DEEPEST + 1, STEP):
        rows = positions.select(cell(level), "x", "y", "z")
        if large is not None:
            rows = rows.withColumn("parent", parent(F.col("cell"))).join(large, "parent", "left_semi")
        counts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("x", "y", "z")).alias("some"))
        leaf = F.lit(True) if level == DEEPEST else F.col("n") <= LEAF
        counts.select(parent(F.col("cell")).alias("parent"), "cell", leaf.alias("leaf"), "some").write.parquet(f"{folder}/cells-{level}")
        cells = spark.read.parquet(f"{folder}/cells-{level}")
        out.append((level, cells))
        large = cells.where("not leaf").select(F.col("cell").alias("parent"))
        if large.isEmpty():
            break
    return out


def nearest_many(points: DataFrame, targets: DataFrame, id_col: str = "event_id", target_id: str = "query", metric: str = "sphere") -> DataFrame:
    """(``target_id``, distance, point) for each row of ``targets`` (``target_id``, lat, lon): the nearest of ``points`` (lat, lon,
    ``id_col`` and more, as a struct), that of the smallest id among equally near ones.

    Distances are metres on the sphere, or degrees. A target or point without both coordinates has and is no neighbour; without
    points a target has none (nulls). Targets that share an id share a neighbour: ids are taken to be distinct. Ids may be structs.
    """
    spark, place = points.sparkSession, METRICS[metric]
    folder = scratch(spark)
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    there = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    known = points.where(there).select(*(c.alias(n) for c, n in zip(place(lat, lon), "xyz", strict=True)), F.struct("*").alias("point"))
    known = known.groupBy("x", "y", "z").agg(F.min_by("point", f"point.{id_col}").alias("point"))
    known.write.parquet(f"{folder}/positions")
    known = spark.read.parquet(f"{folder}/positions")
    levels = tree(known, folder)

    at, best = [F.col(n) for n in ("tx", "ty", "tz")], Window.partitionBy("target")
    asked = targets.where(there).select(F.col(target_id).alias("target"), *(c.alias(f"t{n}") for c, n in zip(place(lat, lon), "xyz", strict=True)))
    held = asked.select("*", F.lit(0).cast("long").alias("cell"), F.lit(0).alias("level"), F.lit(False).alias("leaf"), F.lit(float("inf")).alias("reach"), F.lit(0.0).alias("near"), F.lit(0.0).alias("own"))
    for level, cells in levels:
        below = held.where("not leaf").withColumnRenamed("cell", "parent").drop("leaf", "level", "near", "own").join(cells, "parent")
        own = squared(at, [F.col(f"some.{n}") for n in "xyz"])
        below = below.select("target", "tx", "ty", "tz", "cell", F.lit(level).alias("level"), "leaf", F.least("reach", own).alias("reach"), to_box(level, F.col("cell"), at).alias("near"), own.alias("own"))
        every = below.unionByName(held.where("leaf")).withColumn("reach", F.min("reach").over(best))
        every.where(within(F.col("near"), F.col("reach"))).write.parquet(f"{folder}/held-{level}")
        held = spark.read.parquet(f"{folder}/held-{level}")
        if held.where("not leaf").isEmpty():
            break
    used = [level for level, _ in levels]
    keyed = known.select("x", "y", "z", "point", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), cell(k)) for k in used))).alias("key")).select("x", "y", "z", "point", "key.*")
    here = squared(at, [F.col(n) for n in "xyz"])
    first = held.where("own <= reach").select("target", "tx", "ty", "tz", "level", "cell").join(keyed.drop("point"), ["level", "cell"])
    first.groupBy(F.col("target").alias("whose")).agg(F.min(here).alias("bound")).write.parquet(f"{folder}/bounds")
    bounds = spark.read.parquet(f"{folder}/bounds")
    near = held.select("target", "tx", "ty", "tz", "level", "cell", "near").join(bounds, F.col("target").eqNullSafe(F.col("whose"))).where(within(F.col("near"), F.col("bound")))
    pairs = near.drop("near", "whose").join(keyed, ["level", "cell"]).where(within(here, F.col("bound")))
    d = F.round(here, DECIMALS)
    found = pairs.groupBy("target").agg(F.min_by(F.struct(d.alias("d"), "point"), F.struct(d, F.col(f"point.{id_col}"))).alias("b"))
    chord = F.sqrt("b.d")
    length = F.when(chord.isNotNull(), 2 * RADIUS * F.asin(F.least(chord / 2, F.lit(1.0)))) if metric == "sphere" else chord * 360.0
    return targets.select(target_id).join(found, F.col(target_id).eqNullSafe(F.col("target")), "left").select(target_id, length.alias("distance"), F.col("b.point").alias("point"))
