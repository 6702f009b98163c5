"""Zarr v2 and v3 stores, in a zip file, a folder or behind a reference index: reader and a v2 zip writer."""

from __future__ import annotations

import io
import itertools
import json
import struct
import zipfile
from collections.abc import Callable

import numpy as np

from gridloom.errors import SourceError, UnsupportedFormatError
from gridloom.functions.times import TimeUnits
from gridloom.sources import codecs
from gridloom.sources.cf import describe_axes
from gridloom.sources.files import TALLY, ByteSource
from gridloom.sources.model import Block, Variable

#: Names of axes.
ROLES = {"y": ("lat", "latitude", "y", "rlat", "projection_y_coordinate"), "x": ("lon", "longitude", "x", "rlon", "projection_x_coordinate"), "t": ("time", "valid_time", "t")}
#: Names of types in v3.
V3_TYPES = {"bool": "|b1", "int8": "|i1", "int16": "<i2", "int32": "<i4", "int64": "<i8", "uint8": "|u1", "uint16": "<u2", "uint32": "<u4", "uint64": "<u8", "float16": "<f2", "float32": "<f4", "float64": "<f8"}


class ZipStore:
    """Members of a zip, read by range: only the directory and what is asked for."""

    def __init__(self, source: ByteSource):
        self.zip = zipfile.ZipFile(_Seekable(source))
        names = [n for n in self.zip.namelist() if not n.endswith("/")]
        roots = [n.rsplit("/", 1)[0] + "/" if "/" in n else "" for n in names if n.rsplit("/", 1)[-1] in (".zgroup", ".zmetadata", "zarr.json")]
        self.root = min(roots, key=len, default="")
        self.names = {n[len(self.root) :] for n in names if n.startswith(self.root)}

    def keys(self) -> set[str]:
        return self.names

    def get(self, key: str, start: int = 0, size: int | None = None) -> bytes | None:
        if key not in self.names:
            return None
        data = self.zip.read(self.root + key)
        return data if size is None and not start else data[start:] if size is None else data[start : start + size]


class _Seekable(io.RawIOBase):
    def __init__(self, source: ByteSource):
        self.source, self.at = source, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.source.size)[whence]
        return self.at

    def readinto(self, buffer) -> int:
        n = max(0, min(len(buffer), self.source.size - self.at))
        buffer[:n] = self.source.read(self.at, n)
        self.at += n
        return n


class FolderStore:
    """A store below a path or URI; keys are known from consolidated metadata or listing."""

    def __init__(self, uri: str):
        import os

        from pyarrow import fs

        self.fs, self.path = (fs.LocalFileSystem(), os.path.abspath(uri.removeprefix("file://"))) if "://" not in uri or uri.startswith("file:") else fs.FileSystem.from_uri(uri)
        self._keys: set[str] | None = None

    def keys(self) -> set[str]:
        if self._keys is None:
            from pyarrow import fs

            found = self.fs.get_file_info(fs.FileSelector(self.path, recursive=True))
            self._keys = {f.path[len(self.path) :].lstrip("/") for f in found if f.type == fs.FileType.File}
        return self._keys

    def get(self, key: str, start: int = 0, size: int | None = None) -> bytes | None:
        from pyarrow import fs

        path = f"{self.path}/{key}"
        if self.fs.get_file_info(path).type != fs.FileType.File:
            return None
        with self.fs.open_input_file(path) as f:
            n = f.size() - start if size is None else size
            TALLY.requests, TALLY.bytes = TALLY.requests + 1, TALLY.bytes + n
            return f.read_at(n, start)


class MappingStore:
    """Keys given by a function, e.g. a reference index."""

    def __init__(self, keys: set[str], fetch: Callable[[str], bytes | None]):
        self._keys, self._fetch = keys, fetch

    def keys(self) -> set[str]:
        return self._keys

    def get(self, key: str, start: int = 0, size: int | None = None) -> bytes | None:
        data = self._fetch(key) if key in self._keys else None
        return data if data is None or (size is None and not start) else data[start:] if size is None else data[start : start + size]


class Array:
    """One array's metadata, in v2's terms, and its chunks."""

    def __init__(self, store, name: str, meta: dict, attrs: dict):
        self.store, self.name, self.attrs = store, name, attrs
        self.shape = [int(n) for n in meta["shape"]]
        self.v3 = meta.get("zarr_format") == 3
        self.inner: dict | None = None
        self.transpose: list[int] | None = None
        if self.v3:
            self._read_v3(meta)
        else:
            self.dtype, self.chunks, self.order = np.dtype(meta["dtype"]) if isinstance(meta["dtype"], str) else None, [int(n) for n in meta["chunks"]], meta.get("order", "C")
            self.compressors, self.filters = [meta.get("compressor")], meta.get("filters") or []
            self.separator, self.fill = meta.get("dimension_separator", "."), meta.get("fill_value")
            self.dims = attrs.get("_ARRAY_DIMENSIONS")

    def _read_v3(self, meta: dict) -> None:
        if meta["data_type"] not in V3_TYPES:
            raise UnsupportedFormatError(f"{self.name}: type {meta['data_type']}")
        self.dtype, self.fill, self.order = np.dtype(V3_TYPES[meta["data_type"]]), meta.get("fill_value"), "C"
        self.chunks = [int(n) for n in meta["chunk_grid"]["configuration"]["chunk_shape"]]
        encoding = meta.get("chunk_key_encoding", {})
        self.prefix = "c" if encoding.get("name", "default") == "default" else ""
        self.separator = encoding.get("configuration", {}).get("separator", "/" if self.prefix else ".")
        self.filters, self.dims = [], meta.get("dimension_names")
        chain = meta.get("codecs", [])
        if chain and chain[0]["name"] == "sharding_indexed":
            self.inner = chain[0]["configuration"]
            chain = self.inner["codecs"]
        self.compressors = self._chain(chain)

    def _chain(self, chain: list[dict]) -> list[dict]:
        out = []
        for c in chain:
            if c["name"] == "bytes":
                if c.get("configuration", {}).get("endian") == "big":
                    self.dtype = self.dtype.newbyteorder(">")
            elif c["name"] == "transpose":
                self.transpose = c["configuration"]["order"]
            else:
                out.append(c)
        return out

    def key(self, index: tuple[int, ...]) -> str:
        parts = self.separator.join(map(str, index)) or ("" if self.v3 else "0")
        if self.v3 and self.prefix:
            parts = f"c{self.separator}{parts}" if parts else "c"
        return f"{self.name}/{parts}"

    def fill_value(self) -> float:
        f = self.fill
        return float("nan") if f is None or f == "NaN" else {"Infinity": np.inf, "-Infinity": -np.inf}.get(f, f) if not isinstance(f, int | float) else f

    def _empty(self, shape: list[int]) -> np.ndarray:
        fill = self.fill_value()
        return np.full(shape, fill if self.dtype.kind == "f" or fill == fill else 0, self.dtype)

    def _decode(self, data: bytes, shape: list[int]) -> np.ndarray:
        size = int(np.prod(shape)) * self.dtype.itemsize
        for c in reversed(self.compressors):
            if isinstance(c, dict) and c.get("name") == "crc32c":
                data = data[:-4]
            else:
                data = codecs.decompress(data, c, size)
        for f in reversed(self.filters):
            if f.get("id") != "shuffle":
                raise UnsupportedFormatError(f"filter {f.get('id')!r}")
            data = codecs.unshuffle(data, int(f.get("elementsize", 4)))
        if self.transpose:
            stored = np.frombuffer(data, self.dtype).reshape([shape[k] for k in self.transpose])
            return stored.transpose(np.argsort(self.transpose))
        return np.frombuffer(data, self.dtype).reshape(shape, order=self.order)

    def chunk(self, index: tuple[int, ...]) -> np.ndarray:
        """A chunk clipped to the array; fill values where it is missing."""
        data = self.store.get(self.key(index))
        if data is None:
            full = self._empty(self.chunks)
        elif self.inner:
            full = self._shard(data)
        else:
            full = self._decode(data, self.chunks)
        return full[tuple(slice(0, min(c, n - i * c)) for i, c, n in zip(index, self.chunks, self.shape, strict=True))]

    def _shard(self, data: bytes) -> np.ndarray:
        """Inner chunks by the index of (offset, size) pairs at the shard's end or start."""
        inner = [int(n) for n in self.inner["chunk_shape"]]
        grid = [c // i for c, i in zip(self.chunks, inner, strict=True)]
        n = int(np.prod(grid))
        checked = any(c["name"] == "crc32c" for c in self.inner.get("index_codecs", []))
        size = 16 * n + 4 * checked
        index = data[:size] if self.inner.get("index_location", "end") == "start" else data[-size:]
        pairs = struct.unpack(f"<{2 * n}Q", index[: 16 * n])
        out = self._empty(self.chunks)
        for k, at in enumerate(itertools.product(*map(range, grid))):
            offset, length = pairs[2 * k : 2 * k + 2]
            if offset != 0xFFFFFFFFFFFFFFFF:
                out[tuple(slice(a * i, (a + 1) * i) for a, i in zip(at, inner, strict=True))] = self._decode(data[offset : offset + length], inner)
        return out

    def whole(self) -> np.ndarray:
        out = np.empty(self.shape, self.dtype)
        for index in itertools.product(*(range(-(-n // c)) for n, c in zip(self.shape, self.chunks, strict=True))):
            part = self.chunk(index)
            out[tuple(slice(i * c, i * c + m) for i, c, m in zip(index, self.chunks, part.shape, strict=True))] = part
        return out

    def values(self, raw: np.ndarray) -> np.ndarray:
        """Missing by fill value, then scale and offset."""
        out = raw.astype(np.float64)
        fills = [self.attrs.get(k) for k in ("_FillValue", "missing_value")] + ([self.fill_value()] if self.fill is not None and self.dtype.kind in "iuf" and self.fill != 0 else [])
        for f in fills:
            f = f[0] if isinstance(f, list) and f else f
            if isinstance(f, int | float) and f == f:
                out[raw == raw.dtype.type(f)] = np.nan
        return (out * float(self.attrs.get("scale_factor", 1)) + float(self.attrs.get("add_offset", 0))).astype(np.float32)


def open_arrays(store) -> dict[str, Array]:
    """All arrays with their attributes, from consolidated metadata where there is some."""
    raw = store.get(".zmetadata")
    found: dict[str, Array] = {}
    if raw is not None:
        meta = json.loads(raw)["metadata"]
        load = meta.get
        names = [k[: -len("/.zarray")] for k in meta if k.endswith("/.zarray")]
    elif (top := store.get("zarr.json")) is not None:
        group = json.loads(top)
        consolidated = (group.get("consolidated_metadata") or {}).get("metadata")
        inner = consolidated or {k[: -len("/zarr.json")]: json.loads(store.get(k)) for k in store.keys() if k.endswith("/zarr.json")}
        return {n: Array(store, n, m, m.get("attributes", {})) for n, m in inner.items() if m.get("node_type") == "array"}
    else:
        load = lambda k: json.loads(b) if (b := store.get(k)) is not None else None
        names = [k[: -len("/.zarray")] for k in store.keys() if k.endswith("/.zarray")]
    for name in sorted(names):
        found[name] = Array(store, name, load(f"{name}/.zarray"), load(f"{name}/.zattrs") or {})
    if not found:
        raise UnsupportedFormatError("no Zarr array in the store")
    return found


class ZarrReader:
    def __init__(self, store):
        self.arrays = open_arrays(store)

    def _role(self, name: str) -> str | None:
        attrs = self.arrays[name].attrs if name in self.arrays else {}
        return next((r for r, names in ROLES.items() if name.rsplit("/", 1)[-1].lower() in names or attrs.get("axis") == r.upper()), None)

    def variables(self) -> list[Variable]:
        out = []
        for name, a in self.arrays.items():
            if len(a.shape) < 2 or a.dtype is None or a.dtype.kind not in "iufb":
                continue
            folder = name.rpartition("/")[0] + "/" if "/" in name else ""
            dims, warnings = a.dims, []
            if not dims or len(dims) != len(a.shape):
                dims = self._guess(a.shape)
                warnings.append("dimensions are guessed from lengths")
            if len(a.shape) > 3:
                warnings.append(f"of dimensions {list(dims[1:-2])} only the first index is used")
            nt = a.shape[0] if len(a.shape) > 2 else 1
            y, x = (self._axis(folder + d, n) for d, n in zip(dims[-2:], a.shape[-2:], strict=True))
            times = self._times(folder + dims[0], nt) if len(a.shape) > 2 else []
            attrs = {k: str(v) for k, v in a.attrs.items()}
            own = [self.arrays[folder + d].attrs if folder + d in self.arrays else {} for d in dims[-2:]]
            mapping = folder + str(a.attrs.get("grid_mapping", ""))
            crs, y, x, more, supported = describe_axes(self.arrays[mapping].attrs if mapping in self.arrays else None, *own, y, x) if any(own) else ({}, y, x, [], True)
            out.append(Variable(name, (nt, *a.shape[-2:]), y, x, times, attrs.get("units", ""), attrs.get("long_name", ""), tuple(map(str, dims)), crs, attrs, warnings + more, supported))
        return out

    def _guess(self, shape: list[int]) -> list[str]:
        by_role = {self._role(n): n for n, a in self.arrays.items() if len(a.shape) == 1 and self._role(n)}
        wanted = [None] * (len(shape) - 3) + ["t", "y", "x"][-min(3, len(shape)) :]
        return [by_role[r] if r in by_role and self.arrays[by_role[r]].shape == [n] else f"dim{k}" for k, (r, n) in enumerate(zip(wanted, shape, strict=True))]

    def _axis(self, name: str, n: int) -> list[float]:
        a = self.arrays.get(name) or self.arrays.get(name.rsplit("/", 1)[-1])
        return a.whole().astype(float).tolist() if a is not None and a.shape == [n] and a.dtype.kind in "iuf" else [float(k) for k in range(n)]

    def _times(self, name: str, n: int) -> list[float]:
        a = self.arrays.get(name)
        if a is None or a.shape != [n] or " since " not in str(a.attrs.get("units", "")):
            return []
        u = TimeUnits.parse(a.attrs["units"])
        return [u.origin() + u.scale * float(v) for v in a.whole()]

    def blocks(self, variable: Variable) -> list[Block]:
        a = self.arrays[variable.name]
        (ct, cy, cx), (nt, ny, nx) = ([1] * 3 + a.chunks)[-3:] if len(a.chunks) < 4 else (a.chunks[0], *a.chunks[-2:]), variable.shape
        return [Block(t, min(ct, nt - t), y, min(cy, ny - y), x, min(cx, nx - x)) for t in range(0, nt, ct) for y in range(0, ny, cy) for x in range(0, nx, cx)]

    def read(self, variable: Variable, block: Block) -> np.ndarray:
        a = self.arrays[variable.name]
        lead = [block.t // a.chunks[0]] + [0] * (len(a.shape) - 3) if len(a.shape) > 2 else []
        part = a.chunk((*lead, block.y // a.chunks[-2], block.x // a.chunks[-1]))
        if len(a.shape) > 3:
            part = part[(slice(None), *[0] * (len(a.shape) - 3))]
        return a.values(part.reshape(-1, *part.shape[-2:]))


def write_zip(arrays: dict[str, tuple[np.ndarray, list[str], dict]], attrs: dict | None = None, chunks: dict[str, list[int]] | None = None, level: int | None = None) -> bytes:
    """A v2 store in a zip, one chunk an array unless ``chunks`` says otherwise; ``level`` compresses by zlib."""
    import zlib

    out, meta = io.BytesIO(), {".zgroup": {"zarr_format": 2}, ".zattrs": attrs or {}}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, (array, dims, own) in arrays.items():
            a = np.ascontiguousarray(array)
            size = (chunks or {}).get(name) or [max(1, n) for n in a.shape]
            fill = "NaN" if a.dtype.kind == "f" else None
            meta[f"{name}/.zarray"] = {"zarr_format": 2, "shape": list(a.shape), "chunks": size, "dtype": a.dtype.str, "compressor": None if level is None else {"id": "zlib", "level": level}, "fill_value": fill, "order": "C", "filters": None, "dimension_separator": "."}
            meta[f"{name}/.zattrs"] = {"_ARRAY_DIMENSIONS": dims, **own}
            for index in itertools.product(*(range(-(-n // c)) for n, c in zip(a.shape, size, strict=True))):
                part = a[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, size, strict=True))]
                full = np.full(size, np.nan if a.dtype.kind == "f" else 0, a.dtype)
                full[tuple(slice(0, n) for n in part.shape)] = part
                raw = full.tobytes()
                z.writestr(f"{name}/{'.'.join(map(str, index)) or '0'}", raw if level is None else zlib.compress(raw, level))
        for key, value in meta.items():
            z.writestr(key, json.dumps(value))
        z.writestr(".zmetadata", json.dumps({"zarr_consolidated_format": 1, "metadata": meta}))
    return out.getvalue()


Kept = list[tuple["Array", list[tuple[int, int]], list[int]]]


def cut(reader: ZarrReader, names: list[str] | None = None, t1: int | None = None, t2: int | None = None, box: tuple | None = None) -> tuple[Kept, dict[str, tuple], list[str]]:
    """Arrays with the ranges of chunks that are kept and their new shapes, the axes' values as they are cut, warnings: from
    metadata and axes alone."""
    kept, warnings, ranges = [], [], {}
    for v in reader.variables():
        if names is not None and v.name not in names:
            continue
        a = reader.arrays[v.name]
        own = [(0, n - 1) for n in a.shape]
        if len(a.shape) > 2:
            own[0] = (min(max(t1 or 0, 0), a.shape[0] - 1), a.shape[0] - 1 if t2 is None else min(t2, a.shape[0] - 1))
        if box:
            from gridloom.operators.axes import Axis

            for k, axis, low, high in ((-2, v.y, box[1], box[3]), (-1, v.x, box[0], box[2])):
                own[k] = Axis(axis).window(low, high) or own[k]
        wide = [(lo // c * c, min(n, (hi // c + 1) * c) - 1) for (lo, hi), c, n in zip(own, a.chunks, a.shape, strict=True)]
        if wide != own:
            warnings.append(f"{v.name}: widened to whole chunks, {own} to {wide}")
        kept.append((a, [(lo // c, hi // c) for (lo, hi), c in zip(wide, a.chunks, strict=True)], [hi - lo + 1 for lo, hi in wide]))
        ranges |= dict(zip(v.dims, wide, strict=True))
    axes = {}
    for name, a in reader.arrays.items():
        if len(a.shape) == 1 and name in ranges:
            lo, hi = ranges[name]
            axes[name] = (a.whole()[lo : hi + 1], [name], a.attrs)
    if not kept:
        raise SourceError("nothing is left")
    return kept, axes, warnings


def trim(source: ByteSource, names: list[str] | None = None, t1: int | None = None, t2: int | None = None, box: tuple | None = None) -> tuple[bytes, list[str]]:
    """Some variables, steps and area of a zipped store, widened to whole chunks; coordinates are cut alike."""
    reader = ZarrReader(ZipStore(source))
    kept, out, warnings = cut(reader, names, t1, t2, box)
    chunks = {}
    dims = {v.name: list(v.dims) for v in reader.variables()}
    for a, ranges, shape in kept:  # only the chunks inside are read
        data = np.empty(shape, a.dtype)
        for index in itertools.product(*(range(lo, hi + 1) for lo, hi in ranges)):
            part = a.chunk(index)
            data[tuple(slice((i - lo) * c, (i - lo) * c + m) for i, (lo, _), c, m in zip(index, ranges, a.chunks, part.shape, strict=True))] = part
        out[a.name], chunks[a.name] = (data, dims[a.name], a.attrs), a.chunks
    return write_zip({n: (x, d, {k: v for k, v in at.items() if k != "_ARRAY_DIMENSIONS"}) for n, (x, d, at) in out.items()}, chunks=chunks), warnings
