"""Text helpers: cells of CSV, shapes, chunk keys, EPSG codes, band names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def csv_cell(value: Column) -> Column:
    """Quoted where a comma, quote or line end asks for it; null is empty."""
    text = value.cast("string")
    return F.when(text.isNull(), "").when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def parse_shape(text: Column) -> Column:
    """``365x73x144`` to an array of longs."""
    return F.transform(F.filter(F.split(text, r"[,\sx]+"), lambda p: p != ""), lambda p: p.cast("long"))


def format_shape(shape: Column) -> Column:
    return F.array_join(F.transform(shape, lambda n: n.cast("string")), "x")


def chunk_key(index: Column, separator: str = ".") -> Column:
    """Chunk position as a key; a chunk of a 0-d array is ``0``."""
    return F.when(F.size(index) == 0, "0").otherwise(F.array_join(F.transform(index, lambda n: n.cast("string")), separator))


def linear_index(index: Column, shape: Column) -> Column:
    """Row-major position of an index array in an array of the shape."""
    return F.aggregate(F.arrays_zip(index.alias("i"), shape.alias("n")), F.lit(0).cast("long"), lambda at, x: at * x["n"] + x["i"])


def epsg_code(text: Column) -> Column:
    """The EPSG number in a text such as ``EPSG:4326``, an OGC URN or a PROJJSON id; null if there is none."""
    plain = F.regexp_extract(text, r"(?i)epsg(?::|/|\D{1,20}?)(\d{4,6})", 1)
    code = F.coalesce(F.get_json_object(text, "$.id.code"), F.when(plain != "", plain))
    return code.cast("int")


def band_names(metadata: Column) -> Column:
    """Names of bands (item DESCRIPTION) in a GDAL metadata text, in order of appearance."""
    return F.regexp_extract_all(metadata, F.lit(r'<Item name="DESCRIPTION"[^>]*>([^<]*)</Item>'), F.lit(1))
