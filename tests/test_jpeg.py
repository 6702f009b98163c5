"""JPEG blocks in TIFF: encoded here by the plainest codes that the format allows, read back."""

import struct

import numpy as np
import pytest
from gridloom.errors import UnsupportedFormatError
from gridloom.sources import geotiff, grids, jpeg
from gridloom.sources.files import put

QUANTISER = np.ones(64, int)
#: Categories in 4 bits, (run, category) pairs in 9.
DC = list(range(12))
AC = [0, 0xF0, *(run << 4 | width for run in range(16) for width in range(1, 11))]


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def tables():
    out = segment(0xDB, bytes([0]) + bytes(QUANTISER.tolist()))
    out += segment(0xC4, bytes([0x00, 0, 0, 0, len(DC), *[0] * 12, *DC]))
    return out + segment(0xC4, bytes([0x10, *[0] * 8, len(AC), *[0] * 7, *AC]))


def signed(v):
    width = int(abs(v)).bit_length()
    return width, format(v if v >= 0 else v + (1 << width) - 1, f"0{width}b") if width else ""


def coded(blocks, before):
    bits = ""
    for k, block in blocks:
        c = np.round(np.einsum("ux,xy,vy->uv", jpeg.COSINES, block.astype(float) - 128, jpeg.COSINES)).astype(int).ravel()[jpeg.ZIGZAG]
        width, raw = signed(int(c[0]) - before[k])
        before[k] = int(c[0])
        bits += format(DC.index(width), "04b") + raw
        run = 0
        last = max(np.flatnonzero(c), default=0)
        for v in c[1 : last + 1].tolist():
            if v == 0:
                run += 1
                continue
            while run > 15:
                bits, run = bits + format(AC.index(0xF0), "09b"), run - 16
            width, raw = signed(v)
            bits, run = bits + format(AC.index(run << 4 | width), "09b") + raw, 0
        if last < 63:
            bits += format(AC.index(0), "09b")
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8).replace(b"\xff", b"\xff\0")


def encode(samples, with_tables=True, restart=0, halved=False):
    h, w, n = samples.shape
    step = 16 if halved else 8
    padded = np.pad(samples, ((0, -h % step), (0, -w % step), (0, 0)), mode="edge")
    units = []
    for y in range(0, padded.shape[0], step):
        for x in range(0, padded.shape[1], step):
            own = []
            for k in range(n):
                part = padded[y : y + step, x : x + step, k]
                if halved and k:
                    own.append((k, part[::2, ::2]))
                else:
                    own += [(k, part[b : b + 8, a : a + 8]) for b in range(0, step, 8) for a in range(0, step, 8)]
            units.append(own)
    out = b"\xff\xd8" + (tables() if with_tables else b"")
    out += segment(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([k + 1, 0x22 if halved and not k else 0x11, 0]) for k in range(n)))
    out += segment(0xDD, struct.pack(">H", restart)) if restart else b""
    out += segment(0xDA, bytes([n]) + b"".join(bytes([k + 1, 0]) for k in range(n)) + bytes([0, 63, 0]))
    every = restart or len(units)
    for k in range(0, len(units), every):
        out += coded([b for u in units[k : k + every] for b in u], [0] * n)
        out += bytes([0xFF, 0xD0 + k // every % 8]) if k + every < len(units) else b""
    return out + b"\xff\xd9"


def picture(h, w, n, seed=1):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    return np.clip(np.stack([128 + 90 * np.sin(x / (5 + k)) * np.cos(y / (7 - k)) for k in range(n)], axis=-1) + rng.normal(0, 9, (h, w, n)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize(("h", "w", "n", "restart"), [(8, 8, 1, 0), (37, 21, 1, 0), (40, 48, 3, 0), (33, 65, 3, 4), (16, 16, 4, 1)])
def test_decode(h, w, n, restart):
    a = picture(h, w, n)
    got = jpeg.decode(encode(a, restart=restart))
    assert got.shape == a.shape and np.abs(got.astype(int) - a).max() <= 1
    lone = jpeg.decode(encode(a, False, restart), b"\xff\xd8" + tables() + b"\xff\xd9")
    np.testing.assert_array_equal(lone, got)


def test_halved_chroma():
    a = picture(32, 48, 3)
    a[..., 1:] = a[::2, ::2, 1:].repeat(2, axis=0).repeat(2, axis=1)
    assert np.abs(jpeg.decode(encode(a, halved=True)).astype(int) - a).max() <= 1


def test_refused():
    data = encode(picture(8, 8, 1))
    with pytest.raises(UnsupportedFormatError):
        jpeg.decode(data.replace(b"\xff\xc0", b"\xff\xc2"))


def tiff(a, photometric, tile=16):
    """Tiles of JPEG with shared tables."""
    h, w, n = a.shape
    shared = b"\xff\xd8" + tables() + b"\xff\xd9"
    padded = np.pad(a, ((0, -h % tile), (0, -w % tile), (0, 0)), mode="edge")
    tiles = [encode(padded[y : y + tile, x : x + tile], False) for y in range(0, h, tile) for x in range(0, w, tile)]
    tags = [
        (256, 4, [w]), (257, 4, [h]), (258, 3, [8] * n), (259, 3, [7]), (262, 3, [photometric]), (277, 3, [n]), (284, 3, [1]), (322, 4, [tile]), (323, 4, [tile]), (324, 4, [0] * len(tiles)), (325, 4, [len(t) for t in tiles]),
        (347, 7, list(shared)), *geotiff.geo_tags(h, w, (-180.0, -90.0, 180.0, 90.0), 4326),
    ]
    codes = {3: "H", 4: "I", 7: "B", 12: "d"}
    extra_at, extra, entries = 8 + 2 + 12 * len(tags) + 4, b"", []
    body_at = extra_at + sum(len(v) * struct.calcsize(codes[k]) + 8 for _, k, v in tags)
    for tag, kind, values in tags:
        values = [body_at + sum(map(len, tiles[:k])) for k in range(len(tiles))] if tag == 324 else values
        raw = struct.pack(f"<{len(values)}{codes[kind]}", *values)
        entries.append(struct.pack("<HHI", tag, kind, len(values)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", extra_at + len(extra))))
        extra += raw if len(raw) > 4 else b""
    out = struct.pack("<2sHIH", b"II", 42, 8, len(tags)) + b"".join(entries) + b"\0" * 4 + extra
    return out.ljust(body_at, b"\0") + b"".join(tiles)


@pytest.mark.parametrize("photometric", [1, 2, 6])
def test_tiff(spark, tmp_path, photometric):
    n = 1 if photometric == 1 else 3
    a = picture(40, 56, n)
    path = put(str(tmp_path / "a.tif"), tiff(a, photometric))
    wanted = jpeg.to_rgb(a) if photometric == 6 else a
    rows = grids.decode(grids.blocks(spark, [path])).collect()
    assert len(rows) == a.size
    got = np.zeros(a.shape, int)
    for r in rows:
        got[r.iy, r.ix, int(r.variable.rsplit("_", 1)[1]) - 1] = r.value
    assert np.abs(got - wanted).max() <= (3 if photometric == 6 else 1)
    webp = put(str(tmp_path / "b.tif"), tiff(a, photometric).replace(struct.pack("<HHI", 259, 3, 1) + b"\x07\0", struct.pack("<HHI", 259, 3, 1) + struct.pack("<H", 50001)))
    _, reader = grids.open_reader(webp)
    with pytest.raises(UnsupportedFormatError, match="WebP"):
        reader.read(reader.variables()[0], reader.blocks(reader.variables()[0])[0])


