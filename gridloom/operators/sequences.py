"""Running sums and ranks along an order, each within its own group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Numbers of a piece of a sequence.
PIECE = 1 << 16


def undo_differences(df: DataFrame, order: int, by: tuple[str, ...], at: str = "i", value: str = "value", piece: int = PIECE) -> DataFrame:
    """Values from their first- or second-order differences along the numbers ``at`` within each group (a packed message, an image
    row). The first ``order`` rows hold values themselves.

    A scan in two levels: running sums, and sums of these, are taken in pieces of ``piece`` numbers. A piece is (rows, sum, sum of
    running sums); pieces before one another combine to (n + m, s + r, t + m * s + u), so that a window over a group's pieces, a
    row each, tells every piece where it begins. No group is one task's. With D the sum of running sums of all rows up to the
    n-th, first values included, the n-th value is D - 2 (n - 1) * first. Whole numbers stay whole (longs).
    """
    whole = dict(df.dtypes)[value] in ("tinyint", "smallint", "int", "bigint")
    own = W.partitionBy(*by, "_piece").orderBy(at)
    running = own.rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn(value, F.col(value).cast("long" if whole else "double")).withColumn("_piece", F.floor(F.col(at) / piece))
    rows = rows.withColumn("_m", F.row_number().over(own).cast("long")).withColumn("_s", F.sum(value).over(running)).withColumn("_t", F.sum("_s").over(running))
    before = W.partitionBy(*by).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long" if whole else "double")
    pieces = rows.groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_r"), F.sum("_s").alias("_u"), F.min_by(value, at).alias("_own"))
    pieces = pieces.withColumn("_n0", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_s0", F.coalesce(F.sum("_r").over(before), zero))
    pieces = pieces.withColumn("_t0", F.coalesce(F.sum(F.col("_u") + F.col("_n") * F.col("_s0")).over(before), zero)).withColumn("_first", F.first("_own").over(W.partitionBy(*by).orderBy("_piece")))
    pieces = pieces.select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate((*by, "_piece"))), "_n0", "_s0", "_t0", "_first")
    same = [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate((*by, "_piece"))]
    n = F.col("_n0") + F.col("_m")
    out = F.col("_s0") + F.col("_s") if order == 1 else F.col("_t0") + F.col("_m") * F.col("_s0") + F.col("_t") - 2 * (n - 1) * F.col("_first")
    return rows.join(pieces, same).select(*(out.alias(c) if c == value else F.col(c) for c in df.columns))


def evenly_chosen(n: int, count: int) -> list[int]:
    """Indices of at most ``count`` evenly spaced among n, both ends included."""
    return list(range(n)) if count >= n else [int(k * (n - 1) / max(1, count - 1) + 0.5) for k in range(count)]


def frame_budget(width: int, height: int, budget: int = 256 << 20) -> int:
    """Frames of RGBA pixels that fit a memory budget, two at least."""
    return max(2, budget // (width * height * 4))


def ranked_subset(messages: DataFrame, t1: int | None, t2: int | None, by: tuple[str, ...] = ("variable",), time: str = "valid_time", place: str = "start") -> DataFrame:
    """Messages whose time's rank within their variable (from 0) lies in t1..t2, in file order.

    Ranks count messages; a message that shares its time with another ranks by its place. They are taken within a day
    and shifted by the messages of the days before, so that no task orders a whole variable.
    """
    at = F.col(time)
    day = F.to_date(at) if dict(messages.dtypes)[time].startswith(("timestamp", "date")) else F.floor(at / 86400)
    dealt = messages.withColumn("_day", day)
    days = dealt.groupBy(*by, "_day").agg(F.count(F.lit(1)).alias("_n"))
    before = days.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    dealt = dealt.withColumn("_k", F.row_number().over(W.partitionBy(*by, "_day").orderBy(time, place)) - 1)
    same = [dealt[c].eqNullSafe(before[c]) for c in (*by, "_day")]
    ranked = dealt.join(before, same).select(*(dealt[c] for c in messages.columns), (F.col("_before") + F.col("_k")).cast("int").alias("time_index"))
    if t1 is not None:
        ranked = ranked.where(F.col("time_index") >= t1)
    if t2 is not None:
        ranked = ranked.where(F.col("time_index") <= t2)
    return ranked


def same_shape(messages: DataFrame, by: tuple[str, ...] = ("variable",), size: str = "npts", place: str = "start") -> DataFrame:
    """Messages with as many points as the first of their group. An aggregate and a join: no group in one task."""
    first = messages.groupBy(*by).agg(F.min_by(size, place).alias("_size"))
    return messages.join(first, list(by)).where(F.col(size) == F.col("_size")).drop("_size")
