"""Where intermediate tables and files go: the folder every executor shares."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Checkpoint folders of this process, each with a name of its own.
_KEPT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a folder below /tmp; a cluster session
    fails, since a machine-local folder would not be seen by other machines.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file:///tmp/checkpoints/gridloom"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(there)
    return there


def run_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder, for one run of one operator."""
    return f"{shared_dir(spark).rstrip('/')}/gridloom-{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that lost executors cost no recomputation.

    The session's own checkpoints go when its Python ends.
    """
    spark = df.sparkSession
    shared_dir(spark)
    if (there := spark.sparkContext.getCheckpointDir()) not in _KEPT:
        _KEPT.add(there)
        remove_at_exit(spark, there)
    return df.checkpoint()


def even(df: DataFrame) -> DataFrame:
    """``df`` in partitions of the advisory size, whatever they were: few and whole files for what is cut next."""
    return df.hint("rebalance")


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: like ``cut``, smaller for many rows.

    The files go when the session's Python ends.
    """
    spark, there = df.sparkSession, run_dir(df.sparkSession, label)
    df.write.parquet(there)
    remove_at_exit(spark, there)
    return spark.read.schema(df.schema).parquet(there)


def remove_at_exit(spark: SparkSession, there: str) -> None:
    atexit.register(_remove, spark, there)


def _remove(spark: SparkSession, there: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone first
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(there)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, the unit by which spreads are chosen."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def filesystem(uri: str):
    """An Arrow file system and a path in it; plain paths and ``file:`` are local."""
    from pyarrow import fs

    if match := re.match(r"file:/+", uri):
        return fs.LocalFileSystem(), "/" + uri[match.end() :]
    return (fs.LocalFileSystem(), os.path.abspath(uri)) if "://" not in uri else fs.FileSystem.from_uri(uri)


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``value`` (0 for null), by halving steps."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    known = F.array(*[F.lit(b) for b in bounds]).cast("array<long>")
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) <= value, at + step).otherwise(at))
