"""One file out of many byte ranges, put together by tasks.

A file is a table of pieces: where each goes, and where its bytes come from (a range of another file, or bytes in the row).
Lengths become places by prefix sums over the table. Where the file system takes writes at any offset (a mounted, shared one),
tasks write their pieces straight into a file of the final size; elsewhere they write parts, each of adjacent pieces, and one
task appends the parts in order. The file has a name of its own until all bytes are there, then it is renamed; if anything fails
it is removed.
"""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.errors import SourceError
from gridloom.sources.files import ByteSource

PIECES = "target long, length long, source string, offset long, inline binary"
#: Rows of a group of the prefix sums, bytes that a task writes, bytes held at once.
GROUP, TASK, BUFFER = 4096, 256 << 20, 16 << 20


def system_of(uri: str):
    """An Arrow file system and the path in it."""
    import os

    from pyarrow import fs

    public = re.sub(r"^file:/+", "/", uri)
    return (fs.LocalFileSystem(), os.path.abspath(public)) if "://" not in public else fs.FileSystem.from_uri(uri)


def remove(uri: str) -> None:
    """A file or folder, if it is there."""
    from pyarrow import fs

    system, path = system_of(uri)
    kind = system.get_file_info(path).type
    if kind == fs.FileType.Directory:
        system.delete_dir(path)
    elif kind != fs.FileType.NotFound:
        system.delete_file(path)


def move(source: str, target: str) -> None:
    """Rename over what may be there."""
    system, path = system_of(source)
    remove(target)
    system.create_dir(system_of(target)[1].rpartition("/")[0], recursive=True)
    system.move(path, system_of(target)[1])


@contextlib.contextmanager
def staged(out: str) -> Iterator[str]:
    """A new name beside ``out``; what is there afterwards becomes ``out``, or goes if anything fails."""
    there = f"{out.rstrip('/')}.part-{uuid.uuid4().hex}"
    try:
        yield there
        move(there, out)
    except BaseException:
        remove(there)
        raise


def placed(rows: DataFrame, begin: int = 0, order: str = "seq") -> DataFrame:
    """``rows`` (``order``: longs that differ, and length) with target, the sum of the lengths before, from ``begin``.

    Sums are taken in groups of ``GROUP`` numbers and over the groups, so that one task sees a row a group.
    """
    grouped = rows.withColumn("_group", F.floor(F.col(order) / GROUP))
    groups = grouped.groupBy("_group").agg(F.sum("length").alias("_n"))
    before = groups.select("_group", (F.sum("_n").over(Window.orderBy("_group")) - F.col("_n")).alias("_before"))
    own = F.sum("length").over(Window.partitionBy("_group").orderBy(order)) - F.col("length")
    return grouped.join(before, "_group").withColumn("target", own + F.col("_before") + begin).drop("_group", "_before")


def inline(spark: SparkSession, places: list[tuple[int, bytes]]) -> DataFrame:
    """Pieces whose bytes the driver has: headers."""
    return spark.createDataFrame([(at, len(b), None, 0, bytearray(b)) for at, b in places if b], PIECES)


@lru_cache(maxsize=16)
def _source(uri: str) -> ByteSource:
    return ByteSource(uri)


def _chunks(row: dict) -> Iterator[bytes]:
    if row["source"] is None:
        yield row["inline"]
        return
    for at in range(0, row["length"], BUFFER):
        yield _source(row["source"]).read(row["offset"] + at, min(BUFFER, row["length"] - at))


def assemble(pieces: DataFrame, size: int, out: str, positional: bool | None = None) -> str:
    """``out``, a file of ``size`` bytes, from pieces (``PIECES``) that cover it once; gaps are zeros. Returns ``out``.

    ``positional``: whether the file system takes writes at any offset; by default a local (or mounted) one does.
    """
    spark = pieces.sparkSession
    if positional is None:
        positional = "://" not in re.sub(r"^file:/+", "/", out)
    tasks = max(1, min(-(-size // TASK) + spark.sparkContext.defaultParallelism, 100_000))
    dealt = pieces.where("length > 0").repartitionByRange(tasks, "target").sortWithinPartitions("target")
    with staged(out) as there:
        system, path = system_of(there)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        if positional:
            with open(path, "wb") as f:
                f.truncate(size)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, end, written, name, stream = None, None, 0, None, None
            part = f"{there}.{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
            for batch in batches:
                for row in batch.to_pylist():
                    if stream is None:
                        first = row["target"]
                        stream, name = (open(path, "r+b"), None) if positional else (system_of(part)[0].open_output_stream(system_of(part)[1]), part)
                    if positional:
                        stream.seek(row["target"])
                    elif end is not None and row["target"] > end:
                        stream.write(b"\0" * (row["target"] - end))
                    for data in _chunks(row):
                        stream.write(data)
                        written += len(data)
                    end = row["target"] + row["length"]
            if stream is not None:
                stream.close()
                yield pa.record_batch([pa.array([first]), pa.array([end]), pa.array([written]), pa.array([name], pa.string())], names=["first", "stop", "written", "part"])

        parts = dealt.mapInArrow(run, "first long, stop long, written long, part string")
        done = sorted(tuple(r) for r in parts.collect())  # a row a task
        ends = [0, *(d[1] for d in done)]
        if any(d[0] < e for d, e in zip(done, ends, strict=False)) or ends[-1] > size:
            raise SourceError(f"{out}: pieces overlap or pass {size} bytes")
        if not positional:
            _append(spark, [(d[0], d[1], d[3]) for d in done], size, there)
    return out


def _append(spark: SparkSession, parts: list[tuple[int, int, str]], size: int, there: str) -> None:
    """One task streams the parts, in order, into a file."""

    def run(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = f"{there}.{TaskContext.get().taskAttemptId()}"
        at = 0
        with system_of(own)[0].open_output_stream(system_of(own)[1]) as f:
            for first, end, part in parts:
                f.write(b"\0" * (first - at))
                for data in _chunks({"source": part, "offset": 0, "length": end - first}):
                    f.write(data)
                at = end
            f.write(b"\0" * (size - at))
        yield pa.record_batch([pa.array([own])], names=["name"])

    try:
        move(spark.range(1).coalesce(1).mapInArrow(run, "name string").first()[0], there)
    finally:
        for *_, part in parts:
            remove(part)
