"""Differences undone in pieces, against running sums in order."""

import itertools
import random

import pytest
from gridloom.operators import sequences
from pyspark.sql import functions as F


def undone(rows, order):
    out, held = {}, {}
    for g, at, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        held.setdefault(g, []).append((at, v))
    for g, own in held.items():
        values = [v for _, v in own]
        if order == 2 and len(values) > 1:
            values = [values[0], *itertools.accumulate([values[1] - values[0], *values[2:]])]
        out |= {(g, at): v for (at, _), v in zip(own, itertools.accumulate(values), strict=True)}
    return out


@pytest.mark.parametrize("order", [1, 2])
@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_pieces(spark, order, piece):
    rng = random.Random(6)
    rows = [(g, at, rng.randrange(-50, 50)) for g, n in ((1, 90), (2, 1), (None, 30), (3, 2), (4, 8)) for at in rng.sample(range(-40, 200), n)]
    frame = spark.createDataFrame(rows, "g int, i int, value int").repartition(5)
    got = {(r.g, r.i): r.value for r in sequences.undo_differences(frame, order, ("g",), piece=piece).collect()}
    assert got == undone(rows, order)
    real = frame.withColumn("value", F.col("value") / 4)
    got = {(r.g, r.i): r.value for r in sequences.undo_differences(real, order, ("g",), piece=piece).collect()}
    assert got == {k: v / 4 for k, v in undone(rows, order).items()}
    assert sequences.undo_differences(frame.where("i > 999"), order, ("g",)).count() == 0


def test_one_long_message(spark):
    """One group in many tasks: second differences of a square are 2."""
    n = 400_000
    frame = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("i"), F.when(F.col("id") < 2, F.col("id")).otherwise(2).alias("value"))
    out = sequences.undo_differences(frame, 2, ("g",), piece=4096)
    assert out.where("value <> i * i").count() == 0 and out.agg(F.max("value")).first()[0] == (n - 1) ** 2
    spread = out.select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread > 1
