"""HDF5 (and so NetCDF-4) without a library: superblocks 0 to 3, both object headers, compact, contiguous and chunked
layouts, deflate, shuffle and checksum filters, attributes in headers and in fractal heaps; and a plain writer.

Chunk indices: version 1 B-trees, single chunks, implicit and fixed arrays. Extensible arrays and version 2 B-trees of
chunks raise an error.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from dataclasses import dataclass

import numpy as np

from gridloom.errors import SourceError, UnsupportedFormatError
from gridloom.functions.times import TimeUnits, calendar_of
from gridloom.sources import codecs
from gridloom.sources.cf import describe_axes
from gridloom.sources.files import ByteSource
from gridloom.sources.model import Block, Variable
from gridloom.sources.netcdf3 import LAT_NAMES, LON_NAMES, TIME_NAMES, decode

SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = 0xFFFFFFFFFFFFFFFF
DATASPACE, LINK_INFO, DATATYPE, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUE, SYMBOLS, ATTRIBUTE_INFO = 1, 2, 3, 6, 8, 11, 12, 16, 17, 21


def number(b: bytes, at: int, size: int = 8) -> int:
    return int.from_bytes(b[at : at + size], "little")


@dataclass
class ChunkRef:
    """Where a chunk is stored."""

    coords: tuple[int, ...]
    address: int
    size: int
    filter_mask: int = 0


class Dataset:
    """One dataset's description."""

    def __init__(self, file: Hdf5File, found: list[tuple[int, bytes]]):
        self.file = file
        self.shape, self.most, self.dtype, self.filters, self.layout = (), (), None, [], None
        for kind, body in found:
            if kind == DATASPACE:
                self.shape, self.most = dataspace(body), most_dims(body)
            elif kind == DATATYPE:
                self.dtype = datatype(body)
            elif kind == FILTERS:
                self.filters = filter_list(body)
            elif kind == LAYOUT:
                self.layout = body
        self.attrs = file.attributes(found)
        self._refs: dict[tuple, ChunkRef] | None = None
        self.chunks = self._chunk_shape()

    def _chunk_shape(self) -> tuple[int, ...] | None:
        b = self.layout
        if b is None or b[1] != 2:
            return None
        if b[0] == 3:
            return struct.unpack_from(f"<{b[2]}I", b, 11)[:-1]
        width = b[4]
        return tuple(number(b, 5 + k * width, width) for k in range(b[3] - 1))

    def refs(self) -> dict[tuple, ChunkRef]:
        """Chunks by the index of their position on the chunk grid."""
        if self._refs is None:
            self._refs = {tuple(c // n for c, n in zip(r.coords, self.chunks, strict=True)): r for r in self._walk()}
        return self._refs

    def _walk(self):
        b, rank = self.layout, len(self.shape)
        size = int(np.prod(self.chunks)) * self.dtype.itemsize
        if b[0] == 3:
            yield from self._tree(number(b, 3), rank)
            return
        at = 5 + b[3] * b[4]
        kind = b[at]
        if kind == 1:
            filtered = bool(b[2] & 2)
            address = number(b, at + 1 + 12 * filtered)
            if address != NOWHERE:
                yield ChunkRef((0,) * rank, address, number(b, at + 1) if filtered else size, number(b, at + 9, 4) if filtered else 0)
        elif kind == 2:
            base = number(b, at + 1)
            grid = [-(-n // c) for n, c in zip(self.shape, self.chunks, strict=True)]
            yield from (ChunkRef(tuple(i * c for i, c in zip(index, self.chunks, strict=True)), base + k * size, size) for k, index in enumerate(itertools.product(*map(range, grid))))
        elif kind == 3:
            yield from self._fixed_array(number(b, at + 2), size)
        elif kind == 4:
            yield from self._extensible_array(number(b, at + 6), size)
        elif kind == 5:
            for r in self.file._records(number(b, at + 7)):
                index = struct.unpack_from(f"<{rank}Q", r, len(r) - 8 * rank)
                filtered = len(r) > 8 + 8 * rank
                yield ChunkRef(tuple(i * c for i, c in zip(index, self.chunks, strict=True)), number(r, 0), number(r, 8, len(r) - 12 - 8 * rank) if filtered else size, number(r, len(r) - 8 * rank - 4, 4) if filtered else 0)
        else:
            raise UnsupportedFormatError(f"chunk index of type {kind}")

    def _tree(self, address: int, rank: int):
        if address == NOWHERE:
            return
        read = self.file.source.read
        head = read(address, 24)
        if head[:4] != b"TREE" or head[4] != 1:
            raise UnsupportedFormatError("a chunk tree was due")
        level, n, key = head[5], number(head, 6, 2), 8 + 8 * (rank + 1)
        body = read(address + 24, n * (key + 8))
        for k in range(n):
            at = k * (key + 8)
            child = number(body, at + key)
            if level:
                yield from self._tree(child, rank)
            else:
                yield ChunkRef(struct.unpack_from(f"<{rank}Q", body, at + 8), child, number(body, at, 4), number(body, at + 4, 4))

    def _place(self, k: int) -> tuple[int, ...] | None:
        """Coordinates of an array index's ``k``-th chunk: row by row over the largest extents, an unlimited dimension
        slowest. None where the dataset hasn't grown to."""
        free = [d for d, n in enumerate(self.most) if n == NOWHERE][:1]
        order = free + [d for d in range(len(self.shape)) if d not in free]
        index = [0] * len(order)
        for d in reversed(order[1:]):
            k, index[d] = divmod(k, -(-self.most[d] // self.chunks[d]))
        index[order[0]] = k
        coords = tuple(i * c for i, c in zip(index, self.chunks, strict=True))
        return coords if all(c < n for c, n in zip(coords, self.shape, strict=True)) else None

    def _elements(self, first: int, data: bytes, entry: int, filtered: bool, size: int):
        """Chunks of consecutive elements from the ``first``-th on."""
        for k in range(len(data) // entry):
            b = data[k * entry : (k + 1) * entry]
            if number(b, 0) != NOWHERE and (coords := self._place(first + k)) is not None:
                yield ChunkRef(coords, number(b, 0), number(b, 8, entry - 12) if filtered else size, number(b, entry - 4, 4) if filtered else 0)

    def _paged(self, address: int, n: int, page: int, entry: int, there: bytes):
        """(first element, bytes) of the pages that ``there``, a bit for each from the highest on, says were written."""
        for k in range(-(-n // page)):
            if there[k // 8] & 0x80 >> k % 8:
                yield k * page, self.file.source.read(address + k * (page * entry + 4), min(page, n - k * page) * entry)

    def _fixed_array(self, address: int, size: int):
        read = self.file.source.read
        head = read(address, 28)
        if head[:4] != b"FAHD":
            raise UnsupportedFormatError("a fixed array was due")
        filtered, entry, page, n, block = head[5] == 1, head[6], 1 << head[7], number(head, 8), number(head, 16)
        if block == NOWHERE:
            return
        if n <= page:
            yield from self._elements(0, read(block + 14, n * entry), entry, filtered, size)
            return
        there = read(block + 14, -(-(-(-n // page)) // 8))
        for first, data in self._paged(block + 14 + len(there) + 4, n, page, entry, there):
            yield from self._elements(first, data, entry, filtered, size)

    def _extensible_array(self, address: int, size: int):
        """An index block with the first elements, then data blocks that grow, the later ones behind secondary blocks."""
        read = self.file.source.read
        head = read(address, 68)
        if head[:4] != b"EAHD":
            raise UnsupportedFormatError("an extensible array was due")
        filtered, (entry, bits, own, least, pointers, page_bits) = head[5] == 1, head[6:12]
        n, block, page, offset_size = number(head, 44), number(head, 60), 1 << page_bits, -(-bits // 8)
        if block == NOWHERE:
            return
        direct, first_behind = 2 * (pointers - 1), 2 * (pointers.bit_length() - 1)
        n_behind = 1 + bits - (least.bit_length() - 1) - first_behind
        index = read(block, 14 + own * entry + 8 * (direct + n_behind))
        yield from self._elements(0, index[14 : 14 + min(own, n) * entry], entry, filtered, size)
        addresses = [number(index, 14 + own * entry + 8 * k) for k in range(direct + n_behind)]
        done, used = own, 0
        for level in range(first_behind + n_behind):
            if done >= n:
                return
            count, each = 1 << level // 2, least << (level + 1) // 2
            n_pages = each // page if each > page else 0
            map_size, maps = -(-n_pages // 8), b""
            if level < first_behind:
                blocks, used = addresses[used : used + count], used + count
            elif (second := addresses[direct + level - first_behind]) == NOWHERE:
                blocks = [NOWHERE] * count
            else:
                body = read(second, 14 + offset_size + count * (map_size + 8))
                maps = body[14 + offset_size : 14 + offset_size + count * map_size]
                blocks = [number(body, 14 + offset_size + count * map_size + 8 * k) for k in range(count)]
            for k, at in enumerate(blocks):
                if at != NOWHERE and done < n:
                    at += 14 + offset_size
                    if n_pages:
                        there = maps[k * map_size : (k + 1) * map_size]
                        parts = self._paged(at + 4, each, page, entry, there)
                    else:
                        parts = [(0, read(at, each * entry))]
                    for first, data in parts:
                        yield from self._elements(done + first, data[: max(0, n - done - first) * entry], entry, filtered, size)
                done += each

    def decode_chunk(self, raw: bytes, mask: int = 0) -> np.ndarray:
        """A stored chunk through its filters in reverse; a set bit of the mask leaves one out."""
        for k in range(len(self.filters) - 1, -1, -1):
            code, values = self.filters[k]
            if mask >> k & 1:
                continue
            if code == 1:
                raw = zlib.decompress(raw)
            elif code == 2:
                raw = codecs.unshuffle(raw, values[0] if values else self.dtype.itemsize)
            elif code == 3:
                raw = raw[:-4]
            elif code == 32015:
                raw = codecs.unzstd(raw)
            elif code == 32001:
                raw = codecs.Blosc(raw).decode()
            else:
                raise UnsupportedFormatError(f"HDF5 filter {code}")
        return np.frombuffer(raw, self.dtype, int(np.prod(self.chunks))).reshape(self.chunks)

    def chunk(self, index: tuple[int, ...]) -> np.ndarray:
        """Clipped to the dataset; zeros (or the fill attribute) where it isn't stored."""
        ref = self.refs().get(index)
        if ref is None:
            fill = self.attrs.get("_FillValue", 0)
            full = np.full(self.chunks, fill[0] if isinstance(fill, list) else fill, self.dtype)
        else:
            full = self.decode_chunk(self.file.source.read(ref.address, ref.size), ref.filter_mask)
        return full[tuple(slice(0, min(c, n - i * c)) for i, c, n in zip(index, self.chunks, self.shape, strict=True))]

    def whole(self) -> np.ndarray:
        b = self.layout
        n = int(np.prod(self.shape)) if self.shape else 1
        if self.chunks is None:
            if b[1] == 0:
                return np.frombuffer(b[4 : 4 + number(b, 2, 2)], self.dtype, n).reshape(self.shape)
            address = number(b, 2)
            return np.zeros(self.shape, self.dtype) if address == NOWHERE else np.frombuffer(self.file.source.read(address, n * self.dtype.itemsize), self.dtype).reshape(self.shape)
        out = np.empty(self.shape, self.dtype)
        for index in itertools.product(*(range(-(-m // c)) for m, c in zip(self.shape, self.chunks, strict=True))):
            part = self.chunk(index)
            out[tuple(slice(i * c, i * c + m) for i, c, m in zip(index, self.chunks, part.shape, strict=True))] = part
        return out


def dataspace(b: bytes) -> tuple[int, ...]:
    if b[0] == 1:
        return struct.unpack_from(f"<{b[1]}Q", b, 8)
    return struct.unpack_from(f"<{b[1]}Q", b, 4) if b[3] != 2 else (0,)


def most_dims(b: bytes) -> tuple[int, ...]:
    """The largest extents, ``NOWHERE`` for an unlimited one; the extents themselves if no others are stored."""
    rank, at = b[1], 8 if b[0] == 1 else 4
    return tuple(number(b, at + 8 * k) for k in (range(rank, 2 * rank) if b[2] & 1 else range(rank)))


def datatype(b: bytes) -> np.dtype | str | None:
    """A numpy type; 'vlen' for variable-length text; None for what isn't read."""
    kind, flags, size = b[0] & 15, b[1], number(b, 4, 4)
    order = ">" if flags & 1 else "<"
    if kind == 0:
        return np.dtype(f"{order}{'i' if flags & 8 else 'u'}{size}")
    if kind == 1 and size in (2, 4, 8):
        return np.dtype(f"{order}f{size}")
    if kind == 3:
        return np.dtype(f"S{size}")
    return "vlen" if kind == 9 and flags & 15 == 1 else None


def filter_list(b: bytes) -> list[tuple[int, list[int]]]:
    out, at = [], 8 if b[0] == 1 else 2
    for _ in range(b[1]):
        code, name = number(b, at, 2), number(b, at + 2, 2) if b[0] == 1 or number(b, at, 2) >= 256 else 0
        head = 8 if b[0] == 1 or code >= 256 else 6
        n = number(b, at + head - 2, 2)
        at += head + (name + -name % 8 if b[0] == 1 else name)
        out.append((code, list(struct.unpack_from(f"<{n}I", b, at))))
        at += 4 * n + (4 if b[0] == 1 and n % 2 else 0)
    return out


class Hdf5File:
    def __init__(self, source: ByteSource):
        self.source = source
        head = source.head(96)
        if head[:8] != SIGNATURE:
            raise UnsupportedFormatError("not HDF5")
        if head[8] in (0, 1):
            shift = 4 * head[8]
            if (head[13], head[14]) != (8, 8):
                raise UnsupportedFormatError("offsets and lengths other than 8 bytes")
            self.root = number(head, 64 + shift)
        elif head[8] in (2, 3):
            self.root = number(head, 36)
        else:
            raise UnsupportedFormatError(f"superblock version {head[8]}")

    def messages(self, address: int) -> list[tuple[int, bytes]]:
        """(type, body) of an object header's messages, continuations followed."""
        read, out = self.source.read, []
        head = read(address, 16)
        if head[:4] == b"OHDR":
            flags = head[5]
            at = 6 + 16 * bool(flags & 0x20) + 4 * bool(flags & 0x10)
            width = 1 << (flags & 3)
            size = number(read(address + at, width), 0, width)
            todo, extra, gap = [(address + at + width, size)], 2 * bool(flags & 4), 0
            step = 4 + extra
        else:
            todo, step, extra, gap = [(address + 16, number(head, 8, 4))], 8, None, 0
        while todo:
            start, size = todo.pop(0)
            data, at = read(start, size), gap
            while at + step <= len(data):
                if extra is None:
                    kind, n = number(data, at, 2), number(data, at + 2, 2)
                else:
                    kind, n = data[at], number(data, at + 1, 2)
                body = data[at + step : at + step + n]
                at += step + n
                if kind == CONTINUE:
                    where, length = number(body, 0), number(body, 8)
                    todo.append((where, length) if extra is None else (where + 4, length - 8))
                elif kind:
                    out.append((kind, body))
        return out

    def attributes(self, found: list[tuple[int, bytes]]) -> dict:
        bodies = [b for k, b in found if k == ATTRIBUTE]
        for kind, b in found:
            if kind == ATTRIBUTE_INFO:
                at = 2 + 2 * bool(b[1] & 1)
                if number(b, at) != NOWHERE:
                    bodies += self._heap_objects(number(b, at), number(b, at + 8), 0)
        return dict(a for a in map(self._attribute, bodies) if a)

    def _attribute(self, b: bytes):
        version, sizes = b[0], [number(b, 2 + 2 * k, 2) for k in range(3)]
        at = 9 if version == 3 else 8
        parts = []
        for n in sizes:
            parts.append(b[at : at + n])
            at += n + (-n % 8 if version == 1 else 0)
        name = parts[0].split(b"\0")[0].decode("utf-8", "replace")
        kind, shape = datatype(parts[1]), dataspace(parts[2])
        n = int(np.prod(shape)) if shape else 1
        if kind is None:
            return None
        if isinstance(kind, str):
            texts = [self._global(b[at + 16 * k + 4 : at + 16 * k + 16], number(b, at + 16 * k, 4)) for k in range(n)]
            return name, texts[0] if len(texts) == 1 else texts
        values = np.frombuffer(b, kind, n, at)
        if kind.kind == "S":
            texts = [v.split(b"\0")[0].decode("utf-8", "replace") for v in values.tolist()]
            return name, texts[0] if len(texts) == 1 else texts
        return name, values.tolist()

    def _global(self, ref: bytes, length: int) -> str:
        """A text in the global heap."""
        if not length:
            return ""
        address, index = number(ref, 0), number(ref, 8, 4)
        data = self.source.read(address, number(self.source.read(address, 16), 8))
        at = 16
        while at + 16 <= len(data):
            found, size = number(data, at, 2), number(data, at + 8)
            if found == index:
                return data[at + 16 : at + 16 + length].split(b"\0")[0].decode("utf-8", "replace")
            if not found:
                break
            at += 16 + size + -size % 8
        return ""

    def _heap_objects(self, heap: int, tree: int, id_at: int) -> list[bytes]:
        """Objects of a fractal heap, by the heap ids in a version 2 B-tree's records."""
        h = self.source.read(heap, 142)
        if h[:4] != b"FRHP":
            raise UnsupportedFormatError("a fractal heap was due")
        id_size = number(h, 5, 2)
        width, start, largest, bits = number(h, 110, 2), number(h, 112), number(h, 120), number(h, 128, 2)
        root, rows = number(h, 132), number(h, 140, 2)
        offset_size, length_size = -(-bits // 8), -(-min(largest, number(h, 10, 4)).bit_length() // 8)
        direct_rows = largest.bit_length() - start.bit_length() + 2
        blocks: list[tuple[int, int, int]] = []

        def size_of(row: int) -> int:
            return start << max(0, row - 1)

        def walk(address: int, n_rows: int, base: int) -> None:
            head = 13 + offset_size
            n = width * n_rows
            children = self.source.read(address + head, 8 * n)
            at = base
            for k in range(n):
                row, child = k // width, number(children, 8 * k)
                if child != NOWHERE:
                    if row < direct_rows:
                        blocks.append((at, size_of(row), child))
                    else:
                        walk(child, (size_of(row) // (start * width)).bit_length(), at)
                at += size_of(row)

        if root == NOWHERE:
            return []
        if number(h, 7, 2):
            raise UnsupportedFormatError("a filtered fractal heap")
        if rows == 0:
            blocks.append((0, start, root))
        else:
            walk(root, rows, 0)
        out = []
        for record in self._records(tree):
            key = record[id_at : id_at + id_size]
            if key[0] >> 4 & 3:
                continue  # huge and tiny objects
            offset, length = number(key, 1, offset_size), number(key, 1 + offset_size, length_size)
            base, _, address = next(b for b in blocks if b[0] <= offset < b[0] + b[1])
            out.append(self.source.read(address + offset - base, length))
        return out

    def _records(self, tree: int) -> list[bytes]:
        h = self.source.read(tree, 38)
        if h[:4] != b"BTHD":
            raise UnsupportedFormatError("a version 2 B-tree was due")
        node, size, depth = number(h, 6, 4), number(h, 10, 2), number(h, 12, 2)
        width = lambda most: -(-most.bit_length() // 8)
        # Most records of a node, and of a whole subtree, by level; both decide how wide the counts beside a pointer are.
        most, below = [(node - 10) // size], [0]
        count = width(most[0])
        for level in range(1, depth + 1):
            pointer = 8 + count + (width(below[-1]) if level > 1 else 0)
            most.append((node - 10 - pointer) // (size + pointer))
            below.append((most[-1] + 1) * (below[-1] or most[0]) + most[-1])

        def walk(address: int, n: int, level: int):
            data = self.source.read(address, node)
            own = [data[6 + k * size : 6 + (k + 1) * size] for k in range(n)]
            if level == 0:
                yield from own
                return
            at, step = 6 + n * size, 8 + count + (width(below[level - 1]) if level > 1 else 0)
            for k in range(n + 1):
                yield from walk(number(data, at), number(data, at + 8, count), level - 1)
                yield from own[k : k + 1]
                at += step

        root, n = number(h, 16), number(h, 24, 2)
        return list(walk(root, n, depth)) if root != NOWHERE else []

    def links(self, address: int, prefix: str = "") -> dict[str, int]:
        """Object header addresses of all datasets, by path."""
        found, out = self.messages(address), {}
        for kind, b in found:
            if kind == SYMBOLS:
                out |= dict(self._symbols(number(b, 0), number(b, 8)))
            elif kind == LINK:
                out |= dict(filter(None, [self._link(b)]))
            elif kind == LINK_INFO:
                at = 2 + 8 * bool(b[1] & 1)
                if number(b, at) != NOWHERE:
                    out |= dict(filter(None, map(self._link, self._heap_objects(number(b, at), number(b, at + 8), 4))))
        datasets = {}
        for name, where in out.items():
            kinds = {k for k, _ in self.messages(where)}
            if LAYOUT in kinds:
                datasets[prefix + name] = where
            elif kinds & {SYMBOLS, LINK, LINK_INFO}:
                datasets |= self.links(where, f"{prefix}{name}/")
        return datasets

    def _link(self, b: bytes):
        flags, at = b[1], 2
        kind = b[at] if flags & 8 else 0
        at += bool(flags & 8) + 8 * bool(flags & 4) + bool(flags & 16)
        width = 1 << (flags & 3)
        n = number(b, at, width)
        name = b[at + width : at + width + n].decode("utf-8", "replace")
        return (name, number(b, at + width + n)) if kind == 0 else None

    def _symbols(self, tree: int, heap: int):
        read = self.source.read
        h = read(heap, 32)
        names = read(number(h, 24), number(h, 8))
        todo = [tree]
        while todo:
            address = todo.pop()
            head = read(address, 8)
            if head[:4] == b"TREE":
                n = number(head, 6, 2)
                body = read(address + 24, 8 + 16 * n)
                todo += [number(body, 8 + 16 * k) for k in range(n)]
            elif head[:4] == b"SNOD":
                body = read(address + 8, 40 * number(head, 6, 2))
                for k in range(0, len(body), 40):
                    at = number(body, k)
                    yield names[at : names.index(b"\0", at)].decode("utf-8", "replace"), number(body, k + 8)
            else:
                raise SourceError("a group's tree is broken")


class Hdf5Reader:
    """Grid variables of a file; roles of dimensions by name and attributes, matched to axes by length."""

    def __init__(self, source: ByteSource):
        self.file = Hdf5File(source)
        self.datasets = {n: Dataset(self.file, self.file.messages(a)) for n, a in sorted(self.file.links(self.file.root).items())}
        self.axes: dict[str, list[str]] = {"y": [], "x": [], "t": []}
        for name, d in self.datasets.items():
            if len(d.shape) <= 1 and isinstance(d.dtype, np.dtype) and d.dtype.kind in "iuf" and (role := self._role(name)):
                self.axes[role].append(name)

    def _role(self, name: str) -> str | None:
        low, attrs = name.rsplit("/", 1)[-1].lower(), self.datasets[name].attrs
        units, standard = str(attrs.get("units", "")), str(attrs.get("standard_name", ""))
        if low in LAT_NAMES or attrs.get("axis") == "Y" or units.startswith("degrees_n") or standard in ("latitude", "projection_y_coordinate"):
            return "y"
        if low in LON_NAMES or attrs.get("axis") == "X" or units.startswith("degrees_e") or standard in ("longitude", "projection_x_coordinate"):
            return "x"
        return "t" if low in TIME_NAMES or " since " in units else None

    def _axis(self, role: str, n: int) -> tuple[str, list[float]]:
        name = next((a for a in self.axes[role] if self.datasets[a].shape == (n,)), None)
        return (name, self.datasets[name].whole().astype(float).tolist()) if name else (role, [float(k) for k in range(n)])

    def variables(self) -> list[Variable]:
        out, known = [], {a for names in self.axes.values() for a in names}
        for name, d in self.datasets.items():
            if name in known or len(d.shape) < 2 or not isinstance(d.dtype, np.dtype) or d.dtype.kind not in "iuf":
                continue
            (ny, nx), warnings = d.shape[-2:], []
            nt = d.shape[0] if len(d.shape) > 2 else 1
            if len(d.shape) > 3:
                warnings.append("of the middle dimensions only the first index is used")
            (yn, y), (xn, x) = self._axis("y", ny), self._axis("x", nx)
            tn, _ = self._axis("t", nt)
            times = self._times(tn) if len(d.shape) > 2 and tn in self.datasets else []
            attrs = {k: str(v) for k, v in d.attrs.items()}
            own = [self.datasets[n].attrs if n in self.datasets else {} for n in (yn, xn)]
            mapping = str(d.attrs.get("grid_mapping", ""))
            crs, y, x, more, supported = describe_axes(self.datasets[mapping].attrs if mapping in self.datasets else None, *own, y, x)
            dims = ((tn,) if len(d.shape) > 2 else ()) + (yn, xn)
            out.append(Variable(name, (nt, ny, nx), y, x, times, attrs.get("units", ""), attrs.get("long_name", ""), dims, crs, attrs, warnings + more, supported))
        return out

    def _times(self, name: str) -> list[float]:
        d = self.datasets[name]
        if " since " not in str(d.attrs.get("units", "")) or calendar_of(d.attrs.get("calendar", "standard")) != "standard":
            return []
        u = TimeUnits.parse(d.attrs["units"])
        return [u.origin() + u.scale * float(v) for v in np.ravel(d.whole())]

    def blocks(self, variable: Variable) -> list[Block]:
        d, (nt, ny, nx) = self.datasets[variable.name], variable.shape
        ct, cy, cx = (1, ny, nx) if d.chunks is None else (d.chunks[0] if len(d.chunks) > 2 else 1, *d.chunks[-2:])
        return [Block(t, min(ct, nt - t), y, min(cy, ny - y), x, min(cx, nx - x)) for t in range(0, nt, ct) for y in range(0, ny, cy) for x in range(0, nx, cx)]

    def read(self, variable: Variable, block: Block) -> np.ndarray:
        d = self.datasets[variable.name]
        if d.chunks is None:
            raw = self._rows(d, block.t)
        else:
            lead = [block.t // d.chunks[0]] + [0] * (len(d.shape) - 3) if len(d.shape) > 2 else []
            raw = d.chunk((*lead, block.y // d.chunks[-2], block.x // d.chunks[-1]))
        if len(d.shape) > 3:
            raw = raw[(slice(None), *[0] * (len(d.shape) - 3))]
        return decode(raw.reshape(-1, *raw.shape[-2:]), d.attrs)

    def _rows(self, d: Dataset, t: int) -> np.ndarray:
        """One step of a contiguous dataset."""
        if len(d.shape) < 3 or d.layout[1] == 0 or number(d.layout, 2) == NOWHERE:
            whole = d.whole()
            return whole if len(d.shape) < 3 else whole[t : t + 1]
        size = int(np.prod(d.shape[1:])) * d.dtype.itemsize
        return np.frombuffer(self.file.source.read(number(d.layout, 2) + t * size, size), d.dtype).reshape(1, *d.shape[1:])

    def chunk_map(self, name: str) -> tuple[dict, dict[tuple, ChunkRef]]:
        """A variable's description and the places of its chunks, for readers that bring their own reduction."""
        d = self.datasets[name]
        return {"shape": d.shape, "chunks": d.chunks, "dtype": d.dtype.str, "filters": d.filters}, d.refs() if d.chunks else {}


def write(arrays: dict[str, tuple[np.ndarray, list[str], dict]], attrs: dict | None = None) -> bytes:
    """A file with contiguous datasets in one group: superblock 0, version 1 headers. Dimension scales are marked by class."""

    def type_message(dtype: np.dtype) -> bytes:
        size = dtype.itemsize
        if dtype.kind == "S":
            return struct.pack("<BBBBI", 0x13, 0, 0, 0, size)
        if dtype.kind == "f":
            shape = {4: (0, 31, 23, 8, 0, 23, 127), 8: (0, 63, 52, 11, 0, 52, 1023)}[size]
            return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, shape[1], 0, size, 0, 8 * size, shape[2], shape[3], 0, shape[5], shape[6])
        return struct.pack("<BBBBIHH", 0x10, 8 if dtype.kind == "i" else 0, 0, 0, size, 0, 8 * size)

    def space_message(shape: tuple[int, ...]) -> bytes:
        return struct.pack("<BBBBI", 1, len(shape), 0, 0, 0) + struct.pack(f"<{len(shape)}Q", *shape)

    padded = lambda b: b + b"\0" * (-len(b) % 8)

    def attribute(name: str, value) -> bytes:
        a = np.array(value.encode() or b"\0") if isinstance(value, str) else np.atleast_1d(np.asarray(value))
        a = a.astype(a.dtype.newbyteorder("<")) if a.dtype.kind != "S" else a
        key, kind, space = name.encode() + b"\0", type_message(a.dtype), space_message(a.shape)
        return struct.pack("<BBHHH", 1, 0, len(key), len(kind), len(space)) + padded(key) + padded(kind) + padded(space) + a.tobytes()

    def header(items: list[tuple[int, bytes]]) -> bytes:
        body = b"".join(struct.pack("<HHBBBB", kind, len(padded(b)), 0, 0, 0, 0) + padded(b) for kind, b in items)
        return struct.pack("<BBHII", 1, 0, len(items), 1, len(body)) + b"\0" * 4 + body

    names = sorted(arrays)
    leaf = max(4, -(-len(names) // 2))
    heap_data, places = b"\0" * 8, {}
    for n in names:
        places[n] = len(heap_data)
        heap_data += padded(n.encode() + b"\0")
    root = header([(SYMBOLS, b"\0" * 16)] + [(ATTRIBUTE, attribute(k, v)) for k, v in (attrs or {}).items()])
    tree_size, node_size = 24 + 33 * 8 + 32 * 8, 8 + 2 * leaf * 40
    root_at = 96
    tree_at = root_at + len(root)
    heap_at = tree_at + tree_size
    data_at = heap_at + 32
    node_at = data_at + len(heap_data)
    at = node_at + node_size
    headers, bodies, where = [], [], {}
    for n in names:
        a, dims, own = arrays[n]
        a = np.ascontiguousarray(a)
        a = a.astype(a.dtype.newbyteorder("<"))
        extra = {"CLASS": "DIMENSION_SCALE", "NAME": n} if dims == [n] else {}
        items = lambda address, a=a, own=own, extra=extra: header(
            [(DATASPACE, space_message(a.shape)), (DATATYPE, type_message(a.dtype)), (LAYOUT, struct.pack("<BBQQ", 3, 1, address, a.nbytes))] + [(ATTRIBUTE, attribute(k, v)) for k, v in (own | extra).items()]
        )
        size = len(items(0))
        where[n] = at
        headers.append(items(at + size))
        bodies.append(a.tobytes() + b"\0" * (-a.nbytes % 8))
        at += size + len(bodies[-1])
    root = header([(SYMBOLS, struct.pack("<QQ", tree_at, heap_at))] + [(ATTRIBUTE, attribute(k, v)) for k, v in (attrs or {}).items()])
    tree = struct.pack("<4sBBHQQ", b"TREE", 0, 0, 1, NOWHERE, NOWHERE) + struct.pack("<QQQ", 0, node_at, places[names[-1]] if names else 0)
    node = struct.pack("<4sBBH", b"SNOD", 1, 0, len(names)) + b"".join(struct.pack("<QQII16x", places[n], where[n], 0, 0) for n in names)
    heap = struct.pack("<4sB3xQQQ", b"HEAP", 0, len(heap_data), 1, data_at)
    front = SIGNATURE + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, leaf, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, at, NOWHERE) + struct.pack("<QQII16x", 0, root_at, 0, 0)
    out = front.ljust(96, b"\0") + root + tree.ljust(tree_size, b"\0") + heap + heap_data + node.ljust(node_size, b"\0")
    return out + b"".join(h + b for h, b in zip(headers, bodies, strict=True))


def trim(source: ByteSource, names: list[str] | None = None, t1: int | None = None, t2: int | None = None, box: tuple | None = None) -> tuple[bytes, list[str]]:
    """Some variables, steps and area; each dimension is cut by its name, wherever it stands."""
    from gridloom.operators.axes import Axis

    reader = Hdf5Reader(source)
    kept = [v for v in reader.variables() if names is None or v.name in names]
    if not kept:
        raise SourceError("no variable is left")
    cuts: dict[str, slice] = {}
    for v in kept:
        y, x = v.dims[-2:]
        if len(v.dims) > 2:
            cuts[v.dims[0]] = slice(t1 or 0, None if t2 is None else t2 + 1)
        for dim, axis, span in ((y, v.y, box and (box[1], box[3])), (x, v.x, box and (box[0], box[2]))):
            if span and (inside := Axis(axis).window(*span)):
                cuts[dim] = slice(inside[0], inside[1] + 1)
    out = {}
    for v in kept:
        d = reader.datasets[v.name]
        lead = [cuts.get(v.dims[0], slice(None))] + [slice(None)] * (len(d.shape) - 3) if len(d.shape) > 2 else []
        data = d.whole()[tuple([*lead, *(cuts.get(n, slice(None)) for n in v.dims[-2:])])]
        out[v.name] = (data, list(v.dims), d.attrs)
        for n in v.dims:
            if n in reader.datasets:
                out[n] = (reader.datasets[n].whole()[cuts.get(n, slice(None))], [n], {k: a for k, a in reader.datasets[n].attrs.items() if k not in ("CLASS", "NAME")})
    drop = ("DIMENSION_LIST", "REFERENCE_LIST", "CLASS", "NAME", "_Netcdf4Dimid", "_NCProperties")
    clean = lambda at: {k: (np.asarray(a) if isinstance(a, list) and a and not isinstance(a[0], str) else a if isinstance(a, str) else ",".join(map(str, a))) for k, a in at.items() if k not in drop}
    return write({n: (a, d, clean(at)) for n, (a, d, at) in out.items()}), []
