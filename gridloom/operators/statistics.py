"""Statistics of values and of paired rasters: null and NaN never count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.color import auto_range as widen
from gridloom.functions.units import finite


def summarize(df: DataFrame, value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """n, min, max, mean and population deviation of the finite values; nulls where there is none."""
    v = finite(F.col(value).cast("double"))
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def auto_range(df: DataFrame, value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """vmin and vmax of a colour scale."""
    v = finite(F.col(value).cast("double"))
    low, high = widen(F.col("low"), F.col("high"))
    return df.groupBy(*by).agg(F.min(v).alias("low"), F.max(v).alias("high")).select(*by, low.alias("vmin"), high.alias("vmax"))


def pair(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("r", "c")) -> DataFrame:
    """Cells where both rasters have a finite value: keys, a, b. One equi-join on the cell."""
    sides = (df.select(*keys, finite(F.col("value").cast("double")).alias(name)).where(F.col(name).isNotNull()) for df, name in ((left, "a"), (right, "b")))
    return next(sides).join(next(sides), list(keys))


def thin(pairs: DataFrame, cap: int, keys: tuple[str, str] = ("r", "c")) -> DataFrame:
    """At most ``cap`` pairs, evenly strided in row-major order.

    Ranks are taken within a raster row and shifted by the counts of the rows before.
    """
    row, column = keys
    counts = pairs.groupBy(F.col(row).alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    line = W.orderBy("_r")
    before = counts.select("_r", F.coalesce(F.sum("_n").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_all"))
    rank = F.col("_before") + F.row_number().over(W.partitionBy(row).orderBy(column)) - 1
    ranked = pairs.join(before, F.col(row) == F.col("_r")).withColumn("_k", rank)
    return ranked.where(F.col("_k") % F.greatest(F.lit(1), F.ceil(F.col("_all") / cap)) == 0).select(pairs.columns)


def correlation(pairs: DataFrame, a: str = "a", b: str = "b", by: tuple[str, ...] = ()) -> DataFrame:
    """Pearson's r, null below two pairs or on a flat axis, with the number of pairs. Moments are merged, so one pass."""
    from pyspark.sql.functions import covar_pop, stddev_pop

    out = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), covar_pop(a, b).alias("_c"), stddev_pop(a).alias("_a"), stddev_pop(b).alias("_b"))
    flat = (F.col("n") < 2) | ~(F.col("_a") * F.col("_b") > 0)
    return out.select(*by, "n", F.when(~flat, F.try_divide("_c", F.col("_a") * F.col("_b"))).alias("pearson"))


def bias(pairs: DataFrame, a: str = "a", b: str = "b", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of b - a, null without pairs."""
    return pairs.groupBy(*by).agg(F.avg(F.col(b) - F.col(a)).alias("bias"))
