"""GRIB edition 2 after the WMO manual: message index, simple and complex packing, grids, and a one-message writer."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np

from gridloom.errors import SourceError, UnsupportedFormatError
from gridloom.operators.catalog import PARAMETERS
from gridloom.sources.files import ByteSource
from gridloom.sources.model import Block, Variable

#: Seconds in the units of forecast times (code table 4.4).
TIME_UNITS = {0: 60, 1: 3600, 2: 86400, 10: 10800, 11: 21600, 12: 43200, 13: 1}
EARTH = 6_371_229.0


def unsigned(b: bytes, at: int, size: int) -> int:
    """``size`` octets from octet ``at`` of a section (octets count from 1)."""
    return int.from_bytes(b[at - 1 : at - 1 + size], "big")


def signed(b: bytes, at: int, size: int) -> int:
    """Sign and magnitude."""
    value = unsigned(b, at, size)
    top = 1 << (8 * size - 1)
    return -(value - top) if value & top else value


def numbers(data: bytes, start_bit: int, width: int, n: int) -> np.ndarray:
    """``n`` packed unsigned integers of ``width`` bits."""
    if width == 0 or n == 0:
        return np.zeros(n, np.int64)
    first, last = start_bit // 8, -(-(start_bit + width * n) // 8)
    if last > len(data):
        raise SourceError("the packed data end too early")
    bits = np.unpackbits(np.frombuffer(data, np.uint8, last - first, first))[start_bit % 8 :][: width * n]
    return bits.reshape(n, width) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))


@dataclass
class Message:
    """One field: where it is, what it is, and its sections' bytes by number once read."""

    start: int
    length: int
    discipline: int
    sections: dict[int, bytes]

    @property
    def parameter(self) -> tuple[int, int, int]:
        return self.discipline, self.sections[4][9], self.sections[4][10]

    @property
    def centre(self) -> int:
        return unsigned(self.sections[1], 6, 2)

    @property
    def points(self) -> int:
        return unsigned(self.sections[3], 7, 4)

    @property
    def grid_template(self) -> int:
        return unsigned(self.sections[3], 13, 2)

    @property
    def packing(self) -> int:
        return unsigned(self.sections[5], 10, 2)

    @property
    def supported(self) -> bool:
        return self.packing in (0, 3) and self.grid_template in (0, 20, 30, 40, 101)

    def reference_time(self) -> float:
        s = self.sections[1]
        return datetime(unsigned(s, 13, 2), *s[14:19], tzinfo=UTC).timestamp()

    def valid_time(self) -> float:
        """End of the interval for statistics over time (template 4.8), else reference and forecast time."""
        s = self.sections[4]
        template = unsigned(s, 8, 2)
        if template == 8 and len(s) >= 41:
            return datetime(unsigned(s, 35, 2), *s[36:41], tzinfo=UTC).timestamp()
        if template > 15:
            return self.reference_time()
        return self.reference_time() + signed(s, 19, 4) * TIME_UNITS.get(s[17], 3600)


def messages(source: ByteSource, header_only: bool = True) -> Iterator[Message]:
    """Messages in file order. Only section headers and small sections are read unless ``header_only`` is off."""
    at = 0
    while at + 16 <= source.size:
        head = source.read(at, 16)
        if head[:4] != b"GRIB":
            window = source.read(at, min(1 << 16, source.size - at))
            skip = window.find(b"GRIB", 1)
            at += skip if skip > 0 else max(1, len(window) - 3)
            continue
        length = int.from_bytes(head[8:16], "big")
        if head[7] != 2 or length < 16:
            at += 4
            continue
        yield from fields(source, at, min(length, source.size - at), head[6], header_only)
        at += length


def fields(source: ByteSource, start: int, length: int, discipline: int, header_only: bool) -> Iterator[Message]:
    """The fields of a message: sections 3 to 7 may repeat, each 7 closing a field."""
    sections: dict[int, bytes] = {}
    at, end = start + 16, start + length
    while at + 5 <= end:
        head = source.read(at, 5)
        if head[:4] == b"7777":
            return
        size, number = int.from_bytes(head[:4], "big"), head[4]
        if size < 5 or at + size > end:
            raise SourceError(f"section {number} at {at} has {size} bytes")
        if number == 7 and header_only:
            sections[7] = struct.pack(">QQ", at, size)
        elif number == 6 and header_only and size > 6:
            sections[6] = source.read(at, 6) + struct.pack(">QQ", at, size)
        else:
            sections[number] = source.read(at, size)
        if number == 7 and {1, 3, 4, 5} <= set(sections):
            yield Message(start, length, discipline, dict(sections))
        at += size


def unpack(message: Message, source: ByteSource) -> np.ndarray:
    """All points in stored order, NaN where the bitmap says so. ``message`` comes from a header walk."""
    s5, n = message.sections[5], message.points
    at, size = struct.unpack(">QQ", message.sections[7][-16:])
    data = source.read(at + 5, size - 5)
    reference = struct.unpack(">f", s5[11:15])[0]
    binary, decimal, width = signed(s5, 16, 2), signed(s5, 18, 2), s5[19]
    stored = unsigned(s5, 6, 4)
    if message.packing == 0:
        raw = numbers(data, 0, width, stored)
    elif message.packing == 3:
        raw = complex_integers(data, s5, stored, width)
    else:
        raise UnsupportedFormatError(f"data template 5.{message.packing}")
    values = ((reference + raw * 2.0**binary) / 10.0**decimal).astype(np.float32)
    s6 = message.sections.get(6, b"\0\0\0\6\6\xff")
    if s6[5] == 255:
        return values
    if s6[5] != 0:
        raise UnsupportedFormatError(f"bitmap indicator {s6[5]}")
    at, size = struct.unpack(">QQ", s6[-16:])
    present = np.unpackbits(np.frombuffer(source.read(at + 6, size - 6), np.uint8))[:n].astype(bool)
    out = np.full(n, np.nan, np.float32)
    out[present] = values[: present.sum()]
    return out


def complex_integers(data: bytes, s5: bytes, n: int, width: int) -> np.ndarray:
    """Groups with their own reference, width and length, over first or second differences (template 5.3)."""
    groups, order, octets = unsigned(s5, 32, 4), s5[47], s5[48]
    if s5[22] != 0:
        raise UnsupportedFormatError("missing value management in complex packing")
    if order not in (1, 2) or octets == 0 or groups == 0:
        raise UnsupportedFormatError(f"spatial differences of order {order}")
    seeds = [signed(data, 1 + k * octets, octets) for k in range(order + 1)]
    bit = 8 * octets * (order + 1)
    parts = []
    for bits in (width, s5[36], s5[46]):  # references, widths, lengths; each ends on an octet
        parts.append(numbers(data, bit, bits, groups))
        bit += -(-bits * groups // 8) * 8
    references, widths, lengths = parts
    widths = widths + s5[35]
    lengths = lengths * s5[41] + unsigned(s5, 38, 4)
    lengths[-1] = unsigned(s5, 43, 4)
    if lengths.sum() != n:
        raise SourceError(f"groups have {lengths.sum()} of {n} points")
    out = np.repeat(references, lengths)
    starts = bit + np.concatenate([[0], np.cumsum(widths * lengths)])
    firsts = np.concatenate([[0], np.cumsum(lengths)])
    for g in np.flatnonzero(widths):
        out[firsts[g] : firsts[g + 1]] += numbers(data, int(starts[g]), int(widths[g]), int(lengths[g]))
    out += seeds[-1]
    out[:order] = seeds[:order]
    if order == 2 and n > 1:
        first = np.concatenate([[out[0]], [out[1] - out[0]], out[2:]])
        first[1:] = np.cumsum(first[1:])
        return np.cumsum(first)
    return np.cumsum(out)


def ordered(values: np.ndarray, message: Message) -> np.ndarray:
    """Points as rows and columns in axis order, for the scanning modes."""
    ny, nx, mode = layout(message)
    if mode & 0x20:  # columns are stored one after another
        grid = values.reshape(nx, ny).T
    else:
        grid = values.reshape(ny, nx).copy()
        if mode & 0x10:
            grid[1::2] = grid[1::2, ::-1]
    return grid


def layout(message: Message) -> tuple[int, int, int]:
    """Rows, columns, scanning mode."""
    s, template = message.sections[3], message.grid_template
    if template == 101:
        return 1, message.points, 0
    return unsigned(s, 35, 4), unsigned(s, 31, 4), s[71] if template in (0, 40) else s[64]


def grid(message: Message) -> tuple[list[float], list[float], dict]:
    """Coordinates of rows and columns, in degrees or metres of the CRS given by the third value."""
    s, template = message.sections[3], message.grid_template
    ny, nx, mode = layout(message)
    x_sign, y_sign = (-1 if mode & 0x80 else 1), (1 if mode & 0x40 else -1)
    if template == 101:
        return [0.0], [float(k) for k in range(nx)], {}
    if template in (0, 40):
        lat1, lon1, lat2, lon2 = signed(s, 47, 4) / 1e6, signed(s, 51, 4) / 1e6, signed(s, 56, 4) / 1e6, signed(s, 60, 4) / 1e6
        if template == 40:
            return gaussian(ny, lat1, lat2), [lon1 + x_sign * k * ((lon2 - lon1) % 360 or 360) / max(1, nx - 1) for k in range(nx)], {}
        di, dj = unsigned(s, 64, 4), unsigned(s, 68, 4)
        dx = di / 1e6 if di != 0xFFFFFFFF and di else ((lon2 - lon1) % 360) / max(1, nx - 1)
        dy = dj / 1e6 if dj != 0xFFFFFFFF and dj else abs(lat2 - lat1) / max(1, ny - 1)
        return [lat1 + y_sign * k * dy for k in range(ny)], [lon1 + x_sign * k * dx for k in range(nx)], {}
    lat1, lon1, true_lat, lon0 = signed(s, 39, 4) / 1e6, signed(s, 43, 4) / 1e6, signed(s, 48, 4) / 1e6, signed(s, 52, 4) / 1e6
    dx, dy = unsigned(s, 56, 4) / 1e3, unsigned(s, 60, 4) / 1e3
    a, e2 = ellipsoid(s)
    if template == 20:
        crs = {"kind": "polar-stereo", "lon0": lon0, "true_scale_lat": true_lat, "north": not s[63] & 0x80, "a": a, "e2": e2}
    else:
        sp1, sp2 = signed(s, 66, 4) / 1e6, signed(s, 70, 4) / 1e6
        crs = {"kind": "lcc", "lat0": true_lat, "lon0": lon0, "sp1": sp1, "sp2": sp2, "a": a, "e2": e2}
    from gridloom.functions.projections import CRS

    x0, y0 = CRS(**crs).forward(lat1, (lon1 - lon0 + 180) % 360 - 180 + lon0)
    return [y0 + y_sign * k * dy for k in range(ny)], [x0 + x_sign * k * dx for k in range(nx)], crs


def ellipsoid(s: bytes) -> tuple[float, float]:
    """Semi-major axis and squared eccentricity for the shape-of-the-earth codes."""
    code = s[14]
    scaled = lambda at: unsigned(s, at + 1, 4) / 10.0 ** s[at - 1]
    if code == 0:
        return 6_367_470.0, 0.0
    if code == 1:
        return scaled(16), 0.0
    if code in (3, 7):
        a, b = (scaled(at) * (1000.0 if code == 3 else 1.0) for at in (21, 26))
        return a, 1 - (b / a) ** 2
    if code in (2, 4, 5):
        a, b = {2: (6_378_160.0, 6_356_775.0), 4: (6_378_137.0, 6_356_752.314), 5: (6_378_137.0, 6_356_752.3142)}[code]
        return a, 1 - (b / a) ** 2
    return (6_371_200.0 if code == 8 else EARTH), 0.0


def gaussian(ny: int, lat1: float, lat2: float) -> list[float]:
    """Gaussian latitudes from pole to pole if that is what the ends say, else even ones."""
    nodes = np.degrees(np.arcsin(np.polynomial.legendre.leggauss(ny)[0])) if ny <= 4096 else np.empty(0)
    lats = nodes[::-1] if lat1 > lat2 else nodes
    return lats.tolist() if len(lats) and abs(lats[0] - lat1) < 0.05 else np.linspace(lat1, lat2, ny).tolist()


#: Names by (discipline, category, number).
NAMES = {(d, c, n): (name, units) for d, c, n, name, units in PARAMETERS}


class Grib2Reader:
    """Variables are (discipline, category, number, level); steps are messages in order of valid time."""

    def __init__(self, source: ByteSource):
        self.source = source
        self.groups: dict[tuple, list[Message]] = {}
        for m in messages(source):
            self.groups.setdefault((*m.parameter, m.sections[4][22:28] if len(m.sections[4]) >= 28 else b""), []).append(m)
        for found in self.groups.values():
            found.sort(key=lambda m: (m.valid_time(), m.start))

    def variables(self) -> list[Variable]:
        out, names = [], {}
        for key in self.groups:
            names.setdefault(key[:3], []).append(key)
        for key, found in self.groups.items():
            name, units = NAMES.get(key[:3], ("Unknown (discipline={}, category={}, number={})".format(*key[:3]), ""))
            if len(names[key[:3]]) > 1:  # told apart by level
                name = f"{name} [level {key[3][0]}:{unsigned(key[3], 3, 4) if len(key[3]) >= 6 else 0}]"
            first, warnings = found[0], []
            same = [m for m in found if m.points == first.points and m.grid_template == first.grid_template]
            if len(same) < len(found):
                warnings.append(f"{len(found) - len(same)} messages on another grid are left out")
            if not first.supported:
                warnings.append(f"grid template 3.{first.grid_template} with data template 5.{first.packing} isn't supported")
            y, x, crs = grid(first) if first.supported else ([], [], {})
            attrs = {"discipline": str(key[0]), "category": str(key[1]), "number": str(key[2]), "centre": str(first.centre)}
            out.append(Variable(name, (len(same), len(y), len(x)), y, x, [m.valid_time() for m in same], units, name, crs=crs, attrs=attrs, warnings=warnings, supported=first.supported))
            self.__dict__.setdefault("steps", {})[name] = same
        return out

    def blocks(self, variable: Variable) -> list[Block]:
        if "steps" not in self.__dict__:
            self.variables()
        return [Block(t, 1, 0, variable.shape[1], 0, variable.shape[2], str(m.start)) for t, m in enumerate(self.steps[variable.name])]

    def read(self, variable: Variable, block: Block) -> np.ndarray:
        if "steps" not in self.__dict__:
            self.variables()
        m = self.steps[variable.name][block.t]
        return ordered(unpack(m, self.source), m)[None]


def bit_string(numbers: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bits, filled up to whole bytes."""
    return np.packbits((np.asarray(numbers, np.int64)[:, None] >> np.arange(width - 1, -1, -1)) & 1).tobytes() if width else b""


def differenced(raw: np.ndarray, order: int, group: int = 32) -> tuple[bytes, bytes, int]:
    """Whole numbers by complex packing of their differences in groups of ``group``: the end of section 5, the body of section 7,
    and the width of the groups' references."""
    order = min(order, len(raw) - 1)
    changes = np.diff(raw, order)
    low = int(changes.min())
    stored = np.concatenate([np.zeros(order, np.int64), changes - low])
    parts = [stored[k : k + group] for k in range(0, len(stored), group)]
    refs = np.array([p.min() for p in parts])
    widths = [int(p.max() - p.min()).bit_length() for p in parts]
    wide, most = int(refs.max()).bit_length(), max(widths).bit_length()
    values = "".join(f"{v:0{w}b}" for p, ref, w in zip(parts, refs, widths, strict=True) if w for v in (p - ref).tolist())
    values += "0" * (-len(values) % 8)
    magnitude = lambda v: ((abs(v) | 1 << 31) if v < 0 else v).to_bytes(4, "big")
    body = b"".join(magnitude(int(v)) for v in [*raw[:order], low]) + bit_string(refs, wide) + bit_string(widths, most) + (int(values, 2).to_bytes(len(values) // 8, "big") if values else b"")
    return struct.pack(">BBIIIBBIBIBBB", 1, 0, 0, 0, len(parts), 0, most, group, 1, len(parts[-1]), 0, order, 4), body, wide


def encode(values: np.ndarray, lats: list[float], lons: list[float], parameter: tuple[int, int, int] = (0, 255, 255), time: float = 0.0, bits: int = 24, order: int = 0) -> bytes:
    """One message on a regular grid, NaN by bitmap; rows run from the first latitude on. Simple packing, or that of first or second
    differences (``order``)."""
    data = np.asarray(values, np.float64)
    present = np.isfinite(data)
    good = data[present]
    low = float(np.float32(good.min())) if good.size else 0.0
    if good.size and low > good.min():
        low = float(np.nextafter(np.float32(low), np.float32(-np.inf)))
    span = float(good.max() - low) if good.size else 0.0
    binary = math.ceil(math.log2(span / ((1 << bits) - 1))) if span > 0 else 0
    width = bits if span > 0 else 0
    raw = np.minimum(np.round((good - low) / 2.0**binary), (1 << bits) - 1).astype(np.int64)
    complex_ = order if width and len(raw) > order else 0
    more, packed, wide = differenced(raw, complex_) if complex_ else (b"", bit_string(raw, width), width)
    magnitude = lambda v, n: ((abs(int(v)) | (1 << (8 * n - 1))) if v < 0 else int(v)).to_bytes(n, "big")
    micro = lambda v: magnitude(round(v * 1e6), 4)
    at = datetime.fromtimestamp(time, UTC)
    ny, nx = data.shape
    step = lambda a: abs(a[1] - a[0]) if len(a) > 1 else 0.0
    mode = (0x80 if len(lons) > 1 and lons[1] < lons[0] else 0) | (0x40 if len(lats) > 1 and lats[1] > lats[0] else 0)
    section = lambda number, body: struct.pack(">IB", len(body) + 5, number) + body
    s1 = section(1, struct.pack(">HHBBBHBBBBBBB", 255, 0, 2, 1, 1, at.year, at.month, at.day, at.hour, at.minute, at.second, 0, 1))
    s3 = section(
        3, struct.pack(">BIBBH", 0, ny * nx, 0, 0, 0) + struct.pack(">BBIBIBI", 6, 0, 0, 0, 0, 0, 0) + struct.pack(">IIII", nx, ny, 0, 0xFFFFFFFF)
        + micro(lats[0]) + micro(lons[0]) + b"\x30" + micro(lats[-1]) + micro(lons[-1]) + struct.pack(">II", round(step(lons) * 1e6), round(step(lats) * 1e6)) + bytes([mode]),
    )
    s4 = section(4, struct.pack(">HHBBBBBHBBI", 0, 0, parameter[1], parameter[2], 2, 255, 255, 0, 0, 1, 0) + struct.pack(">BBIBBI", 1, 0, 0, 255, 255, 0xFFFFFFFF))
    s5 = section(5, struct.pack(">IHf", good.size, 3 if complex_ else 0, low) + magnitude(binary, 2) + magnitude(0, 2) + bytes([wide, 0]) + more)
    s6 = section(6, b"\xff") if present.all() else section(6, b"\0" + np.packbits(present.ravel()).tobytes())
    body = s1 + s3 + s4 + s5 + s6 + section(7, packed) + b"7777"
    return b"GRIB\0\0" + bytes([parameter[0], 2]) + struct.pack(">Q", len(body) + 16) + body


def kept_ranges(source: ByteSource, names: list[str] | None = None, t1: int | None = None, t2: int | None = None) -> list[tuple[int, int]]:
    """(offset, length) of the messages of some variables and steps (ranks by valid time within a variable), in file order;
    neighbours are one range."""
    reader = Grib2Reader(source)
    kept: set[tuple[int, int]] = set()
    for v in reader.variables():
        if names is None or v.name in names:
            last = v.shape[0] - 1 if t2 is None else t2
            kept |= {(m.start, m.length) for k, m in enumerate(reader.steps[v.name]) if (t1 or 0) <= k <= last}
    out: list[tuple[int, int]] = []
    for start, length in sorted(kept):
        if out and sum(out[-1]) == start:
            out[-1] = (out[-1][0], out[-1][1] + length)
        else:
            out.append((start, length))
    return out


def trim(source: ByteSource, names: list[str] | None = None, t1: int | None = None, t2: int | None = None) -> bytes:
    """The kept messages, byte for byte."""
    return b"".join(source.read(start, length) for start, length in kept_ranges(source, names, t1, t2))
