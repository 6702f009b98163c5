"""Formats by their first and last bytes, for one file or a table of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.files import ByteSource

#: Leading bytes in hexadecimal and the format they stand for; Parquet must end as it begins.
MAGIC = (
    ("47524942", "grib2"), ("43444601", "netcdf3"), ("43444602", "netcdf3"), ("894844460D0A1A0A", "netcdf4"), ("504B0304", "zarr"),
    ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("49492B00", "tiff"), ("4D4D002B", "tiff"), ("50415231", "parquet"),
)


def detect_format(source: ByteSource | str | bytes) -> str | None:
    """The format of one source, or None."""
    source = source if isinstance(source, ByteSource) else ByteSource(source)
    head = source.head(8)
    for magic, name in MAGIC:
        if head.startswith(bytes.fromhex(magic)):
            return name if name != "parquet" or source.tail(4) == b"PAR1" else None
    return None


def format_column(content: Column) -> Column:
    """The format of a binary column."""
    head, tail = F.hex(F.substring(content, 1, 8)), F.hex(F.right(content, F.lit(4)))
    out = None
    for magic, name in MAGIC:
        hit = head.startswith(magic) & ((tail == "50415231") if name == "parquet" else F.lit(True))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def detect_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, format of all files below a path. Spark lists and reads them in parallel."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", format_column(F.col("content")).alias("format"))
