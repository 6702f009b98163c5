"""Chunk indices of the newer HDF5 layouts, made by hand from the published layout."""

import struct

import numpy as np
import pytest
from gridloom.sources import hdf5
from gridloom.sources.files import ByteSource

NOWHERE = 2**64 - 1


class Image:
    """A file under construction."""

    def __init__(self):
        self.data = bytearray(64)

    def add(self, body: bytes) -> int:
        at = len(self.data)
        self.data += body
        return at


def dataset(image: Image, shape, most, chunks, kind: int, info: bytes) -> hdf5.Dataset:
    file = hdf5.Hdf5File.__new__(hdf5.Hdf5File)
    file.source = ByteSource(bytes(image.data) + bytes(4096))
    rank = len(shape)
    layout = struct.pack("<BBBBB", 4, 2, 0, rank + 1, 4) + struct.pack(f"<{rank + 1}I", *chunks, 4) + bytes([kind]) + info
    space = struct.pack("<BBBB", 2, rank, 1, 1) + struct.pack(f"<{2 * rank}Q", *shape, *most)
    return hdf5.Dataset(file, [(hdf5.DATASPACE, space), (hdf5.DATATYPE, struct.pack("<BBBBI", 0x11, 0x20, 31, 0, 4) + struct.pack("<HHBBBBI", 0, 32, 23, 8, 0, 23, 127)), (hdf5.LAYOUT, layout)])


def chunked(image: Image, values: np.ndarray, chunks) -> dict:
    """Addresses of all chunks by their index on the chunk grid."""
    out = {}
    for index in np.ndindex(*(-(-n // c) for n, c in zip(values.shape, chunks, strict=True))):
        part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, chunks, strict=True))]
        full = np.zeros(chunks, "<f4")
        full[tuple(map(slice, part.shape))] = part
        out[index] = image.add(full.tobytes())
    return out


@pytest.mark.parametrize("n", [40, 2600])
def test_fixed_array(n):
    """With and without pages of 1024 elements; one page was never written."""
    image, values = Image(), np.arange(3 * n, dtype="<f4").reshape(n, 3) + 1
    at = chunked(image, values, (1, 3))
    elements = [at[k, 0] for k in range(n)]
    head_at = len(image.data) + (1 << 16)
    if n <= 1024:
        block = image.add(b"FADB" + struct.pack("<BBQ", 0, 0, head_at) + struct.pack(f"<{n}Q", *elements) + b"sum.")
    else:
        pages = [elements[k : k + 1024] for k in range(0, n, 1024)]
        block = image.add(b"FADB" + struct.pack("<BBQ", 0, 0, head_at) + bytes([0b10100000]) + b"sum." + b"".join(struct.pack(f"<{len(p)}Q", *p) + b"sum." for p in pages))
        values[1024:2048] = 0
    head = image.add(b"FAHD" + struct.pack("<BBBBQQ", 0, 0, 8, 10, n, block) + b"sum.")
    assert np.array_equal(dataset(image, (n, 3), (n, 3), (1, 3), 3, struct.pack("<BQ", 10, head)).whole(), values)


@pytest.mark.parametrize("n", [3, 200, 700, 9000])
def test_extensible_array(n):
    """Elements in the index block, in direct data blocks, behind secondary blocks, and in pages of 64 elements."""
    image, values = Image(), np.arange(2 * n, dtype="<f4").reshape(n, 2) + 1
    at = chunked(image, values, (1, 2))
    elements = [at[k, 0] for k in range(n)]
    own, least, pointers, bits, page = 4, 16, 4, 32, 64
    take = iter(elements)
    some = lambda m: [next(take, NOWHERE) for _ in range(m)]
    packed = lambda x: struct.pack(f"<{len(x)}Q", *x)

    def data_block(each):
        mine = some(each)
        if mine[0] == NOWHERE:
            return NOWHERE, b"\0" * -(-(each // page) // 8)
        prefix = b"EADB" + struct.pack("<BBQI", 0, 0, 0, 0)
        if each <= page:
            return image.add(prefix + packed(mine) + b"sum."), b""
        parts = [mine[k : k + page] for k in range(0, each, page)]
        there = "".join("1" if p[0] != NOWHERE else "0" for p in parts)
        there += "0" * (-len(there) % 8)
        return image.add(prefix + b"sum." + b"".join(packed(p) + b"sum." for p in parts)), int(there, 2).to_bytes(len(there) // 8, "big")

    index, direct, behind = some(own), [], []
    for level in range(29):
        count, each = 1 << level // 2, least << (level + 1) // 2
        if level < 4:
            direct += [data_block(each)[0] for _ in range(count)]
        elif sum(map(len, (index,))) and level < 14:
            blocks = [data_block(each) for _ in range(count)]
            if all(a == NOWHERE for a, _ in blocks):
                behind.append(NOWHERE)
            else:
                maps = b"".join(m for _, m in blocks) if each > page else b""
                behind.append(image.add(b"EASB" + struct.pack("<BBQI", 0, 0, 0, 0) + maps + packed([a for a, _ in blocks]) + b"sum."))
        else:
            behind.append(NOWHERE)
    assert len(direct) == 6 and len(behind) == 25
    block = image.add(b"EAIB" + struct.pack("<BBQ", 0, 0, 0) + packed(index) + packed(direct) + packed(behind) + b"sum.")
    head = image.add(b"EAHD" + bytes([0, 0, 8, bits, own, least, pointers, 6]) + struct.pack("<6Q", 0, 0, 0, 0, n, n) + struct.pack("<Q", block) + b"sum.")
    d = dataset(image, (n, 2), (NOWHERE, 2), (1, 2), 4, struct.pack("<BBBBBQ", bits, own, pointers, least, 6, head))
    assert np.array_equal(d.whole(), values)


def test_extensible_along_columns():
    """The unlimited dimension is the slowest, and the other one's largest extent counts."""
    image, values = Image(), np.arange(12, dtype="<f4").reshape(3, 4) + 1
    at = chunked(image, values, (1, 2))
    most_rows = 5
    elements = [at.get((row, column), NOWHERE) for column in range(2) for row in range(most_rows)]
    block = image.add(b"EAIB" + struct.pack("<BBQ", 0, 0, 0) + struct.pack("<16Q", *elements, *[NOWHERE] * 6) + struct.pack("<31Q", *[NOWHERE] * 31))
    head = image.add(b"EAHD" + bytes([0, 0, 8, 32, 16, 16, 4, 10]) + struct.pack("<6Q", 0, 0, 0, 0, 10, 10) + struct.pack("<Q", block) + b"sum.")
    assert np.array_equal(dataset(image, (3, 4), (most_rows, NOWHERE), (1, 2), 4, struct.pack("<BBBBBQ", 32, 16, 4, 16, 10, head)).whole(), values)


def test_version_2_tree():
    """Three levels of nodes of 128 bytes; two unlimited dimensions."""
    image, values = Image(), np.arange(400, dtype="<f4").reshape(10, 40) + 1
    at = chunked(image, values, (2, 2))
    records = [struct.pack("<QQQ", a, *index) for index, a in sorted(at.items())]
    node, size = 128, 24
    leaf = (node - 10) // size
    inner = (node - 10 - 9) // (size + 9)
    below = (inner + 1) * leaf + inner
    upper = (node - 10 - 10) // (size + 10)
    assert (leaf, inner, below < 256, upper) == (4, 3, True, 3)

    def build(own, level):
        """(address, records in the node, records below it)."""
        if level == 0:
            return image.add((b"BTLF" + bytes([0, 10]) + b"".join(own)).ljust(node, b"\0")), len(own), len(own)
        each = (leaf, below)[level - 1]
        parts, between = [], []
        while len(own) > each:
            take = min(each, len(own) - 2)
            parts.append(own[:take])
            between.append(own[take])
            own = own[take + 1 :]
        parts.append(own)
        children = [build(p, level - 1) for p in parts]
        pointers = b"".join(struct.pack("<QB", a, n) + (bytes([t]) if level > 1 else b"") for a, n, t in children)
        return image.add((b"BTIN" + bytes([0, 10]) + b"".join(between) + pointers).ljust(node, b"\0")), len(between), sum(t for _, _, t in children) + len(between)

    some = records[:60]
    root, n, total = build(some, 2)
    assert total == 60 and n <= upper
    head = image.add(b"BTHD" + bytes([0, 10]) + struct.pack("<IHHBBQHQ", node, size, 2, 100, 40, root, n, total) + b"sum.")
    d = dataset(image, (10, 40), (NOWHERE, NOWHERE), (2, 2), 5, struct.pack("<IBBQ", node, 100, 40, head))
    wanted = np.zeros_like(values)
    for (i, j), _ in sorted(at.items())[:60]:
        wanted[2 * i : 2 * i + 2, 2 * j : 2 * j + 2] = values[2 * i : 2 * i + 2, 2 * j : 2 * j + 2]
    assert np.array_equal(d.whole(), wanted)
