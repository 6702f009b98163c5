"""Reference indices: keys of a store that point into other files (inline bytes, a whole file, or a byte range), and the
one-file JSON description of a cube (refs v1)."""

from __future__ import annotations

import base64
import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import SourceError
from gridloom.sources.files import ByteSource
from gridloom.sources.model import Block, Variable
from gridloom.sources.zarr import MappingStore, ZarrReader

REFERENCE = "key string, raw binary, path string, offset long, size long"


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet index: key, raw (inline bytes), path, offset, size (0: the whole file)."""
    return spark.read.parquet(path).select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in REFERENCE.split(", ")))


def references_from_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON index of the same content: {"refs": {key: "text" | "base64:..." | [path] | [path, offset, size]}}."""
    text = spark.read.text(path, wholetext=True)
    refs = F.coalesce(F.from_json(F.get_json_object("value", "$.refs"), "map<string,string>"), F.from_json("value", "map<string,string>"))
    rows = text.select(F.explode(refs).alias("key", "ref"))
    place = F.from_json("ref", "array<string>")
    inline = ~F.col("ref").startswith("[")
    raw = F.when(inline & F.col("ref").startswith("base64:"), F.unbase64(F.substring("ref", 8, 1 << 30))).when(inline, F.encode("ref", "UTF-8"))
    at = lambda k: F.when(~inline, F.get(place, F.lit(k)))
    return rows.select("key", raw.alias("raw"), at(0).alias("path"), F.coalesce(at(1).cast("long"), F.lit(0)).alias("offset"), F.coalesce(at(2).cast("long"), F.lit(0)).alias("size"))


def reference_store(references: DataFrame, base: str = "") -> MappingStore:
    """A store over an index on the driver, for small ones. Tasks open indices of any size themselves: a path that ends in
    ``.refs`` (Parquet) or a JSON index is a grid file like others to ``grids``."""
    places = {r["key"]: r for r in references.collect()}

    def fetch(key: str) -> bytes:
        r = places[key]
        return fetch_reference(r["raw"], r["path"], r["offset"], r["size"], base, key)

    return MappingStore(set(places), fetch)


def open_references(references: DataFrame, base: str = "") -> ZarrReader:
    return ZarrReader(reference_store(references, base))


def fetch_reference(raw: bytes | None, path: str | None, offset: int, size: int, base: str = "", key: str = "") -> bytes:
    """The bytes that a reference stands for."""
    if raw is not None:
        return bytes(raw)
    if path is None:
        raise SourceError(f"reference {key} points nowhere")
    source = ByteSource(path if "://" in path or path.startswith(("/", "file:")) else f"{base}{path}")
    return source.read(offset, size) if size else source.all()


def open_json(found: dict, base: str = "") -> ZarrReader:
    """A reader over a JSON index that a task has at hand."""
    refs = found["refs"]

    def fetch(key: str) -> bytes:
        r = refs[key]
        if isinstance(r, dict):
            r = json.dumps(r)
        if isinstance(r, str):
            return base64.b64decode(r[7:]) if r.startswith("base64:") else r.encode()
        return fetch_reference(None, r[0], *(r[1:] or (0, 0)), base=base, key=key)

    return ZarrReader(MappingStore(set(refs), fetch))


def open_index(folder: str) -> ZarrReader:
    """A reader over a Parquet index, for use inside tasks: keys and places are Arrow columns, inline bytes are read only
    for the keys asked for."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    public = re.sub(r"^file:/+", "/", folder)
    table = ds.dataset(public, format="parquet")
    places = table.to_table(columns=["key", "path", "offset", "size"]).sort_by("key").combine_chunks()
    keys = places.column("key").combine_chunks() if isinstance(places.column("key"), pa.ChunkedArray) else places.column("key")
    names = keys.to_numpy(zero_copy_only=False)
    base = folder.rpartition("/")[0] + "/"

    def fetch(key: str) -> bytes:
        r = places.slice(int(np.searchsorted(names, key)), 1).to_pylist()[0]
        raw = None if r["path"] is not None else table.to_table(columns=["raw"], filter=pc.field("key") == key).column(0)[0].as_py()
        return fetch_reference(raw, r["path"], r["offset"] or 0, r["size"] or 0, base, key)

    return ZarrReader(MappingStore(set(names.tolist()), fetch))


class RefsV1Reader:
    """One variable as a JSON description beside a file (or text) of float32 steps, one chunk a step."""

    def __init__(self, source: ByteSource, folder: str = ""):
        meta = json.loads(source.all())
        for key in ("variable", "shape", "lat", "lon", "chunks"):
            if key not in meta:
                raise SourceError(f"the description lacks {key!r}")
        self.meta, self.shape = meta, tuple(int(n) for n in meta["shape"])
        if len(self.shape) != 3 or len(meta["lat"]) != self.shape[1] or len(meta["lon"]) != self.shape[2]:
            raise SourceError("shape and axes disagree")
        if len(meta["chunks"]) != self.shape[0]:
            raise SourceError("there must be a chunk for each step")
        size = self.shape[1] * self.shape[2] * 4
        if any(int(c["length"]) != size for c in meta["chunks"]):
            raise SourceError(f"a chunk must have {size} bytes")
        if "data" in meta:
            self.bin = ByteSource(base64.b64decode(meta["data"]))
        else:
            self.bin = ByteSource(f"{folder}{meta['file']}")
        if any(int(c["offset"]) + size > self.bin.size for c in meta["chunks"]):
            raise SourceError("a chunk lies beyond the data")

    def variables(self) -> list[Variable]:
        m = self.meta
        return [Variable(m["variable"], self.shape, list(map(float, m["lat"])), list(map(float, m["lon"])), list(map(float, m.get("time", []))), m.get("units", ""))]

    def blocks(self, variable: Variable) -> list[Block]:
        return [Block(t, 1, 0, self.shape[1], 0, self.shape[2]) for t in range(self.shape[0])]

    def read(self, variable: Variable, block: Block) -> np.ndarray:
        c = self.meta["chunks"][block.t]
        out = np.frombuffer(self.bin.read(int(c["offset"]), int(c["length"])), "<f4").reshape(1, *self.shape[1:]).copy()
        out[np.abs(out) > 1e37] = np.nan
        return out


def write_refs_v1(variable: Variable, cube: np.ndarray) -> bytes:
    """The description with its data inline."""
    a = np.ascontiguousarray(cube, "<f4")
    size = a[0].nbytes
    chunks = [{"offset": t * size, "length": size} for t in range(len(a))]
    return json.dumps({"version": 1, "variable": variable.name, "units": variable.units, "shape": list(a.shape), "lat": variable.y, "lon": variable.x, "time": variable.times, "chunks": chunks, "data": base64.b64encode(a.tobytes()).decode()}).encode()
