"""NetCDF classic (CDF-1, CDF-2): reader, writer, and a cut that keeps the file's own bytes."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from gridloom.errors import SourceError, UnsupportedFormatError
from gridloom.functions.times import TimeUnits
from gridloom.functions.units import DEFAULT_FILL
from gridloom.sources.cf import describe_axes
from gridloom.sources.files import ByteSource
from gridloom.sources.model import Block, Variable

#: Type codes of the format.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
CODES = {"i1": 1, "i2": 3, "i4": 4, "f4": 5, "f8": 6}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
LAT_NAMES = ("lat", "latitude", "y", "rlat", "grid_lat", "nav_lat")
LON_NAMES = ("lon", "longitude", "x", "rlon", "grid_lon", "nav_lon")
TIME_NAMES = ("time", "t", "valid_time")


class Cursor:
    """Big-endian fields in order, read ahead in growing pieces."""

    def __init__(self, source: ByteSource):
        self.source, self.at, self.held = source, 0, source.head(1 << 16)

    def take(self, n: int) -> bytes:
        while self.at + n > len(self.held):
            if len(self.held) >= self.source.size:
                raise SourceError("the header ends too early")
            self.held = self.source.head(len(self.held) * 4)
        out = self.held[self.at : self.at + n]
        self.at += n
        return out

    def integer(self, size: int = 4) -> int:
        return int.from_bytes(self.take(size), "big")

    def text(self) -> str:
        n = self.integer()
        return self.take(n + -n % 4)[:n].decode("utf-8", "replace")

    def many(self, tag: int, one) -> list:
        found, n = self.integer(), self.integer()
        if found not in (0, tag):
            raise UnsupportedFormatError(f"tag {found} where {tag} was due")
        return [one() for _ in range(n)]


def array_bytes(code: int, n: int) -> int:
    size = n * np.dtype(TYPES[code]).itemsize
    return size + -size % 4


class NetCDF3Reader:
    def __init__(self, source: ByteSource):
        self.source = source
        cursor = Cursor(source)
        magic = cursor.take(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2):
            raise UnsupportedFormatError("not NetCDF classic, or a version other than 1 and 2")
        self.offset_size = 4 if magic[3] == 1 else 8
        self.records = cursor.integer()
        self.dims = cursor.many(DIMENSION, lambda: (cursor.text(), cursor.integer()))
        attribute = lambda: (cursor.text(), self._value(cursor))
        self.attrs = dict(cursor.many(ATTRIBUTE, attribute))
        self.vars = {}
        for v in cursor.many(VARIABLE, lambda: self._variable(cursor, attribute)):
            self.vars[v["name"]] = v
        own = [v for v in self.vars.values() if v["record"]]
        # A lone record variable isn't padded to 4 bytes.
        self.record_size = sum(v["vsize"] for v in own) if len(own) != 1 else self._count(own[0], False) * np.dtype(TYPES[own[0]["code"]]).itemsize
        if self.records == 0xFFFFFFFF:  # streaming: as many as the file holds
            begin = min((v["begin"] for v in own), default=source.size)
            self.records = (source.size - begin) // self.record_size if self.record_size else 0

    def _value(self, cursor: Cursor):
        code, n = cursor.integer(), cursor.integer()
        data = cursor.take(array_bytes(code, n))
        if code == 2:
            return data[:n].decode("utf-8", "replace").rstrip("\0")
        return np.frombuffer(data, TYPES[code], n).tolist()

    def _variable(self, cursor: Cursor, attribute) -> dict:
        name = cursor.text()
        dims = [cursor.integer() for _ in range(cursor.integer())]
        attrs = dict(cursor.many(ATTRIBUTE, attribute))
        code, vsize, begin = cursor.integer(), cursor.integer(), cursor.integer(self.offset_size)
        return {"name": name, "dims": dims, "attrs": attrs, "code": code, "vsize": vsize, "begin": begin, "record": bool(dims) and self.dims[dims[0]][1] == 0}

    def _sizes(self, v: dict) -> list[int]:
        return [self.records if n == 0 else n for n in (self.dims[d][1] for d in v["dims"])]

    def _count(self, v: dict, with_records: bool = True) -> int:
        sizes = self._sizes(v)
        return int(np.prod(sizes if with_records or not v["record"] else sizes[1:]))

    def raw(self, v: dict, first: int = 0, n: int | None = None) -> np.ndarray:
        """Stored values of a variable, rows ``first`` .. of its leading dimension."""
        sizes, dtype = self._sizes(v), np.dtype(TYPES[v["code"]])
        if not sizes:
            return np.frombuffer(self.source.read(v["begin"], dtype.itemsize), dtype)[0]
        n = sizes[0] - first if n is None else n
        row = int(np.prod(sizes[1:])) * dtype.itemsize
        if v["record"]:
            parts = [self.source.read(v["begin"] + (first + k) * self.record_size, row) for k in range(n)]
            data = b"".join(parts)
        else:
            data = self.source.read(v["begin"] + first * row, n * row)
        return np.frombuffer(data, dtype).reshape([n, *sizes[1:]])

    def _role(self, name: str) -> str | None:
        v = self.vars.get(name)
        attrs = v["attrs"] if v else {}
        low, units = name.lower(), str(attrs.get("units", ""))
        if low in LAT_NAMES or attrs.get("axis") == "Y" or units.startswith("degrees_n") or attrs.get("standard_name") == "latitude":
            return "y"
        if low in LON_NAMES or attrs.get("axis") == "X" or units.startswith("degrees_e") or attrs.get("standard_name") == "longitude":
            return "x"
        return "t" if low in TIME_NAMES or attrs.get("axis") == "T" or " since " in units else None

    def variables(self) -> list[Variable]:
        out = []
        for v in self.vars.values():
            names = [self.dims[d][0] for d in v["dims"]]
            if v["code"] in (1, 2) or len(names) < 2 or v["name"] in names:
                continue
            if (self._role(names[-2]), self._role(names[-1])) != ("y", "x"):
                continue
            sizes, warnings = self._sizes(v), []
            nt = int(np.prod(sizes[:-2]))
            if len(sizes) > 3:
                warnings.append(f"dimensions {names[:-2]} are counted as steps")
            times = self._times(names[0]) if len(sizes) == 3 and self._role(names[0]) == "t" else []
            attrs = {k: str(a) for k, a in v["attrs"].items()}
            y, x = (self._axis(n, size) for n, size in zip(names[-2:], sizes[-2:], strict=True))
            own = [self.vars[n]["attrs"] if n in self.vars else {} for n in names[-2:]]
            mapping = self.vars.get(str(v["attrs"].get("grid_mapping", "")), {}).get("attrs")
            crs, y, x, more, supported = describe_axes(mapping, *own, y, x)
            out.append(Variable(v["name"], (nt, *sizes[-2:]), y, x, times, attrs.get("units", ""), attrs.get("long_name", ""), tuple(names), crs, attrs, warnings + more, supported))
        return out

    def _axis(self, name: str, size: int) -> list[float]:
        v = self.vars.get(name)
        return self.raw(v).astype(float).tolist() if v and self._sizes(v) == [size] else [float(k) for k in range(size)]

    def _times(self, name: str) -> list[float]:
        v = self.vars.get(name)
        if not v or " since " not in str(v["attrs"].get("units", "")):
            return []
        units = TimeUnits.parse(v["attrs"]["units"])
        return [units.origin() + units.scale * float(x) for x in self.raw(v)]

    def blocks(self, variable: Variable) -> list[Block]:
        nt, ny, nx = variable.shape
        return [Block(t, 1, 0, ny, 0, nx) for t in range(nt)]

    def read(self, variable: Variable, block: Block) -> np.ndarray:
        v = self.vars[variable.name]
        sizes = self._sizes(v)
        if len(sizes) == 2:
            data = self.raw(v)
        else:
            inner = int(np.prod(sizes[1:-2]))
            data = self.raw(v, block.t // inner, 1).reshape(-1, *sizes[-2:])[block.t % inner]
        return decode(data, v["attrs"])[None]


def decode(raw: np.ndarray, attrs: dict) -> np.ndarray:
    """Missing by the stored value, then scale and offset."""
    one = lambda k, d: float(np.ravel(attrs[k])[0]) if k in attrs and not isinstance(attrs[k], str) else d
    value = raw.astype(np.float64)
    missing = np.zeros(raw.shape, bool)
    for fill in (one("_FillValue", DEFAULT_FILL), one("missing_value", DEFAULT_FILL)):
        missing |= np.isclose(value, fill, rtol=1e-7, atol=0) if raw.dtype.kind == "f" else value == fill
    out = value * one("scale_factor", 1.0) + one("add_offset", 0.0)
    out[missing] = np.nan
    return out.astype(np.float32)


@dataclass
class Layout:
    """Where a file's variables lie: its header, of each variable the place of its first byte and the bytes of its rows (records, or
    all of it), what a row is padded to, and how far records are apart."""

    header: bytes
    begins: dict[str, int]
    rows: dict[str, int]
    padded: dict[str, int]
    stride: int
    size: int


def layout(dims: dict[str, int], variables: dict[str, tuple], attrs: dict[str, object] | None = None, record: str | None = None) -> Layout:
    """The layout of a CDF-2 file. ``variables``: name -> (dims, type such as "f4", attrs); ``record`` names the unlimited dimension."""

    def name(text: str) -> bytes:
        raw = text.encode()
        return struct.pack(">I", len(raw)) + raw + b"\0" * (-len(raw) % 4)

    def value(v) -> bytes:
        if isinstance(v, str):
            raw = v.encode()
            return struct.pack(">II", 2, len(raw)) + raw + b"\0" * (-len(raw) % 4)
        a = np.atleast_1d(np.asarray(v))
        kind = a.dtype.kind + str(a.dtype.itemsize) if a.dtype.kind + str(a.dtype.itemsize) in CODES else "f8" if a.dtype.kind == "f" else "i4"
        raw = a.astype(">" + kind).tobytes()
        return struct.pack(">II", CODES[kind], a.size) + raw + b"\0" * (-len(raw) % 4)

    def listed(tag: int, items: list[bytes]) -> bytes:
        return struct.pack(">II", tag if items else 0, len(items)) + b"".join(items)

    def attributes(found: dict | None) -> bytes:
        return listed(ATTRIBUTE, [name(k) + value(v) for k, v in (found or {}).items()])

    order = list(dims)
    front = b"CDF\x02" + struct.pack(">I", dims[record] if record else 0)
    front += listed(DIMENSION, [name(d) + struct.pack(">I", 0 if d == record else n) for d, n in dims.items()]) + attributes(attrs)
    rows = {}
    for key, (own, kind, _) in variables.items():
        if kind not in CODES:
            raise UnsupportedFormatError(f"{key}: type {kind}")
        rows[key] = int(np.prod([dims[d] for d in own if d != record or own[0] != record], dtype=np.int64)) * np.dtype(kind).itemsize
    in_records = [k for k, (own, _, _) in variables.items() if own and own[0] == record]
    lone = len(in_records) == 1 and bool(record)  # a lone record variable isn't padded
    padded = {k: n if lone and k in in_records else n + -n % 4 for k, n in rows.items()}

    def header(begins: dict[str, int]) -> bytes:
        items = []
        for key, (own, kind, more) in variables.items():
            size = rows[key] + -rows[key] % 4
            size = 0 if key in in_records and not dims[record] else min(size, 0xFFFFFFFF)  # larger ones don't fit the field and are known by their shape
            items.append(name(key) + struct.pack(f">I{len(own)}I", len(own), *(order.index(d) for d in own)) + attributes(more) + struct.pack(">IIQ", CODES[kind], size, begins[key]))
        return front + listed(VARIABLE, items)

    at = len(header(dict.fromkeys(variables, 0)))
    begins = {}
    for key in (k for k in variables if k not in in_records):
        begins[key] = at
        at += padded[key]
    for key in in_records:
        begins[key] = at
        at += padded[key] if dims[record] else 0
    stride = sum(padded[k] for k in in_records)
    return Layout(header(begins), begins, rows, padded, stride, at + stride * max(0, (dims[record] if record else 0) - 1))


def write(dims: dict[str, int], variables: dict[str, tuple], attrs: dict[str, object] | None = None, record: str | None = None) -> bytes:
    """A CDF-2 file. ``variables``: name -> (dims, array, attrs); ``record`` names the unlimited dimension."""
    arrays = {key: np.asarray(array) for key, (_, array, _) in variables.items()}
    kinds = {key: a.dtype.kind + str(a.dtype.itemsize) for key, a in arrays.items()}
    plan = layout(dims, {key: (own, kinds[key], more) for key, (own, _, more) in variables.items()}, attrs, record)
    out = bytearray(plan.size)
    out[: len(plan.header)] = plan.header
    for key, a in arrays.items():
        raw, own = a.astype(">" + kinds[key]).tobytes(), variables[key][0]
        apart = plan.stride if own and own[0] == record else 0
        for k in range(dims[record] if apart else 1):
            at = plan.begins[key] + k * apart
            out[at : at + plan.rows[key]] = raw[k * plan.rows[key] : (k + 1) * plan.rows[key]]
    return bytes(out)


@dataclass
class Cut:
    """A trim as ranges: of each kept variable where its rows lie in the source and in the new file, and how many there are."""

    layout: Layout
    #: (source place, source stride, target place, target stride, bytes, rows)
    runs: list[tuple[int, int, int, int, int, int]]


def cut(source: ByteSource, names: list[str] | None, t1: int | None, t2: int | None) -> Cut:
    """The file with some variables and steps only; every dimension stays, coordinates are kept."""
    reader = NetCDF3Reader(source)
    keep = set(names or [v.name for v in reader.variables()])
    dims = {n: (reader.records if size == 0 else size) for n, size in reader.dims}
    record = next((n for n, size in reader.dims if size == 0), None)
    steps = record or next((n for n in dims if reader._role(n) == "t"), None)
    low, high = (0, 0) if steps is None else (min(max(t1 or 0, 0), dims[steps] - 1), dims[steps] - 1 if t2 is None else min(max(t2, 0), dims[steps] - 1))
    kept = {}
    for v in reader.vars.values():
        if v["code"] != 2 and (v["name"] in keep or v["name"] in dims):
            attrs = {k: (np.array(a, TYPES[5].lstrip(">") if isinstance(a[0], float) else "i4") if isinstance(a, list) and a else a) for k, a in v["attrs"].items()}
            kept[v["name"]] = ([reader.dims[d][0] for d in v["dims"]], np.dtype(TYPES[v["code"]]).kind + str(np.dtype(TYPES[v["code"]]).itemsize), attrs)
    if steps is not None:
        dims[steps] = max(low, high) - low + 1
    plan, runs = layout(dims, kept, reader.attrs, record), []
    for name, (own, _, _) in kept.items():
        v, size = reader.vars[name], plan.rows[name]
        if v["record"]:
            runs.append((v["begin"] + low * reader.record_size, reader.record_size, plan.begins[name], plan.stride, size, dims[record]))
        else:
            first = low * (size // dims[steps]) if own and own[0] == steps else 0
            runs.append((v["begin"] + first, 0, plan.begins[name], 0, size, 1))
    return Cut(plan, runs)


def trim(source: ByteSource, names: list[str] | None, t1: int | None, t2: int | None) -> bytes:
    """``cut`` as bytes."""
    plan = cut(source, names, t1, t2)
    out = bytearray(plan.layout.size)
    out[: len(plan.layout.header)] = plan.layout.header
    for begin, apart, target, wide, size, n in plan.runs:
        for k in range(n):
            out[target + k * wide : target + k * wide + size] = source.read(begin + k * apart, size)
    return bytes(out)
