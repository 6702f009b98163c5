"""GeoTIFF and BigTIFF: strips and tiles, both byte orders, common codecs and predictors; a writer; band and area cuts."""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np

from gridloom.errors import SourceError, UnsupportedCRSError, UnsupportedFormatError
from gridloom.functions.projections import CRS, from_epsg
from gridloom.sources import codecs, jpeg
from gridloom.sources.files import ByteSource
from gridloom.sources.model import Block, Variable

#: Field types, as struct codes and sizes.
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "2I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
#: Tags.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT, PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, GEO_DOUBLES, GEO_ASCII, GDAL_METADATA, GDAL_NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 34736, 34737, 42112, 42113
PHOTOMETRIC, JPEG_TABLES = 262, 347
KINDS = {(1, 8): "u1", (1, 16): "u2", (2, 16): "i2", (3, 32): "f4"}


class Image:
    """One directory's tags."""

    def __init__(self, reader: GeoTiffReader, tags: dict[int, list | str]):
        self.reader, self.tags = reader, tags
        self.width, self.height = tags[WIDTH][0], tags[HEIGHT][0]
        self.bands = tags.get(SAMPLES, [1])[0]
        kind = KINDS.get((tags.get(SAMPLE_FORMAT, [1])[0], tags.get(BITS, [8])[0]))
        if kind is None:
            raise UnsupportedFormatError(f"samples of format {tags.get(SAMPLE_FORMAT)} with {tags.get(BITS)} bits")
        self.dtype = np.dtype(reader.order + kind)
        self.tiled = TILE_OFFSETS in tags
        self.block_w = tags[TILE_WIDTH][0] if self.tiled else self.width
        self.block_h = tags[TILE_HEIGHT][0] if self.tiled else min(self.height, tags.get(ROWS_PER_STRIP, [self.height])[0])
        self.across, self.down = -(-self.width // self.block_w), -(-self.height // self.block_h)
        self.separate = tags.get(PLANAR, [1])[0] == 2
        self.offsets, self.counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if self.tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])

    def block(self, row: int, column: int, band: int) -> np.ndarray:
        """A block of one band, clipped to the image."""
        k = row * self.across + column + (band * self.across * self.down if self.separate else 0)
        h, w = min(self.block_h, self.height - row * self.block_h), min(self.block_w, self.width - column * self.block_w)
        samples = 1 if self.separate else self.bands
        stored_h = self.block_h if self.tiled else h
        if not self.counts[k]:  # a sparse file
            return np.full((h, w), self.nodata() or 0, self.dtype)
        data = self.reader.source.read(self.offsets[k], self.counts[k])
        codec = self.tags.get(COMPRESSION, [1])[0]
        if codec == 7:
            found = jpeg.decode(data, bytes(self.tags.get(JPEG_TABLES, [])) or None)
            found = jpeg.to_rgb(found) if self.tags.get(PHOTOMETRIC, [1])[0] == 6 and found.shape[2] == 3 else found
            return found[:h, :w, 0 if self.separate else band]
        if codec == 5:
            data = codecs.lzw(data)
        elif codec in (8, 32946):
            data = zlib.decompress(data)
        elif codec == 32773:
            data = codecs.packbits(data)
        elif codec == 50000:
            data = codecs.unzstd(data)
        elif codec != 1:
            raise UnsupportedFormatError("WebP in TIFF" if codec == 50001 else f"TIFF compression {codec}")
        need = stored_h * self.block_w * samples
        full = np.frombuffer(data, self.dtype, need).reshape(stored_h, self.block_w, samples)
        full = codecs.undo_predictor(full, self.tags.get(PREDICTOR, [1])[0], self.reader.order)
        return full[:h, :w, 0 if self.separate else band]

    def nodata(self) -> float | None:
        text = self.tags.get(GDAL_NODATA)
        return float(text.strip("\0 ")) if isinstance(text, str) and text.strip("\0 ") else None


class GeoTiffReader:
    def __init__(self, source: ByteSource, overview: int = 0):
        """``overview``: which image answers; 0 is the file's own, others are its overviews, finest first."""
        self.source = source
        head = source.head(16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack(f"{self.order}H", head[2:4])[0] if self.order else 0
        if version not in (42, 43):
            raise UnsupportedFormatError("not a TIFF")
        self.big = version == 43
        at = struct.unpack(f"{self.order}Q", head[8:16])[0] if self.big else struct.unpack(f"{self.order}I", head[4:8])[0]
        self.images: list[Image] = []
        seen = set()
        while at and at not in seen:
            seen.add(at)
            tags, at = self._directory(at)
            self.images.append(Image(self, tags))
        if not self.images:
            raise SourceError("a TIFF without images")
        self.main = self.images[0]
        self.overviews = sorted((i for i in self.images[1:] if i.width < self.main.width and i.bands == self.main.bands), key=lambda i: -i.width)
        self.image = [self.main, *self.overviews][overview]

    def _directory(self, at: int) -> tuple[dict, int]:
        count_code, entry, word = ("Q", 20, "Q") if self.big else ("H", 12, "I")
        head = struct.calcsize(count_code)
        n = struct.unpack(self.order + count_code, self.source.read(at, head))[0]
        size = struct.calcsize(word)
        table = self.source.read(at + head, n * entry + size)
        tags = {}
        for k in range(n):
            raw = table[k * entry : (k + 1) * entry]
            tag, kind, count = struct.unpack(f"{self.order}HH{word}", raw[: 4 + size])
            if kind not in FIELD:
                continue
            length = struct.calcsize("=" + FIELD[kind]) * count
            data = raw[4 + size : 4 + size + length] if length <= size else self.source.read(struct.unpack(self.order + word, raw[4 + size :])[0], length)
            tags[tag] = data.decode("latin-1").rstrip("\0") if kind == 2 else list(struct.unpack(f"{self.order}{count * 2}I" if kind == 5 else f"{self.order}{count}{FIELD[kind]}", data))
        return tags, struct.unpack(self.order + word, table[n * entry :])[0]

    def affine(self) -> tuple[float, float, float, float]:
        """x of the west edge, pixel width, y of the north edge, pixel height (negative to the south)."""
        t = self.main.tags
        if TRANSFORM in t:
            m = t[TRANSFORM]
            if m[1] or m[4]:
                raise UnsupportedFormatError("a rotated image")
            return m[3], m[0], m[7], m[5]
        if PIXEL_SCALE in t and TIEPOINT in t:
            (sx, sy), (i, j, _, x, y) = t[PIXEL_SCALE][:2], t[TIEPOINT][:5]
            shift = 0.5 if self._keys().get(1025) == 2 else 0.0  # the tie point is a pixel's centre
            return x - (i + shift) * sx, sx, y + (j + shift) * sy, -sy
        return 0.0, 1.0, float(self.main.height), -1.0

    def _keys(self) -> dict[int, object]:
        raw, out = self.main.tags.get(GEO_KEYS, []), {}
        for k in range(4, len(raw) - 3, 4):
            key, place, n, value = raw[k : k + 4]
            if place == 0:
                out[key] = value
            elif place == GEO_DOUBLES:
                out[key] = self.main.tags[GEO_DOUBLES][value]
            elif place == GEO_ASCII:
                out[key] = self.main.tags[GEO_ASCII][value : value + n].rstrip("|")
        return out

    def crs(self) -> dict:
        from dataclasses import asdict

        k = self._keys()
        if not k or k.get(1024) == 2 or k.get(1024) is None:
            return {}
        code = k.get(3072, 32767)
        if code != 32767:
            return asdict(from_epsg(code))
        g = lambda *names: next((float(k[n]) for n in names if n in k), 0.0)
        base = {"false_easting": g(3082, 3086), "false_northing": g(3083, 3087)}
        method = k.get(3075)
        if method == 8:
            return base | {"kind": "lcc", "lat0": g(3085, 3081), "lon0": g(3084, 3080), "sp1": g(3078), "sp2": g(3079)}
        if method == 11:
            return base | {"kind": "albers", "lat0": g(3081, 3085), "lon0": g(3080, 3084, 3088), "sp1": g(3078), "sp2": g(3079)}
        if method == 24:
            return base | {"kind": "sinusoidal", "lon0": g(3080, 3088), "a": g(2057) or 6371007.181, "e2": 0.0}
        raise UnsupportedCRSError(f"projection method {method}", name=str(method))

    def names(self) -> list[str]:
        text = self.main.tags.get(GDAL_METADATA, "")
        found = {int(m[1]): m[2] for m in re.finditer(r'<Item name="DESCRIPTION" sample="(\d+)"[^>]*>([^<]*)<', text if isinstance(text, str) else "")}
        return [found.get(b, f"band_{b + 1}") for b in range(self.main.bands)]

    def variables(self) -> list[Variable]:
        x0, dx, y0, dy = self.affine()
        i = self.image
        dx, dy = dx * self.main.width / i.width, dy * self.main.height / i.height
        y, x = [y0 + (k + 0.5) * dy for k in range(i.height)], [x0 + (k + 0.5) * dx for k in range(i.width)]
        return [Variable(n, (1, i.height, i.width), y, x, crs=self.crs(), dims=("band", "y", "x"), attrs={"band": str(b)}) for b, n in enumerate(self.names())]

    def blocks(self, variable: Variable) -> list[Block]:
        i = self.image
        return [
            Block(0, 1, r * i.block_h, min(i.block_h, i.height - r * i.block_h), c * i.block_w, min(i.block_w, i.width - c * i.block_w))
            for r in range(i.down) for c in range(i.across)
        ]

    def read(self, variable: Variable, block: Block) -> np.ndarray:
        i = self.image
        out = i.block(block.y // i.block_h, block.x // i.block_w, int(variable.attrs["band"])).astype(np.float32)
        if (missing := i.nodata()) is not None:
            out[out == np.float32(missing)] = np.nan
        return out[None]

    def overview_for(self, pixel_x: float, pixel_y: float) -> int:
        """The coarsest image whose pixels are no larger than those asked for, as ``overview`` of a reader."""
        _, dx, _, dy = self.affine()
        fine = [k for k, i in enumerate([self.main, *self.overviews]) if abs(dx) * self.main.width / i.width <= pixel_x * (1 + 1e-9) and abs(dy) * self.main.height / i.height <= pixel_y * (1 + 1e-9)]
        return max(fine, default=0)


def sample_kind(dtype: np.dtype) -> tuple[int, int]:
    """(sample format, bits)."""
    kinds = {np.dtype(v): k for k, v in KINDS.items()}
    if dtype.newbyteorder("=") not in kinds:
        raise UnsupportedFormatError(f"samples of type {dtype}")
    return kinds[dtype.newbyteorder("=")]


def encode_strip(bands: np.ndarray, compress: bool, predictor: int) -> bytes:
    """Rows of bands (n, rows, width) as they are stored."""
    block = np.ascontiguousarray(bands.transpose(1, 2, 0)).astype(bands.dtype.newbyteorder("<"))
    raw = codecs.apply_predictor(block, predictor).tobytes()
    return zlib.compress(raw) if compress else raw


def strip_header(lengths: list[int], shape: tuple[int, int, int], dtype: np.dtype, box: tuple, names: list[str] | None, compress: bool, predictor: int, epsg: int, nodata: float | None, rows_per_strip: int) -> bytes:
    """What comes before the strips of a little-endian file of (bands, height, width)."""
    sample_format, bits = sample_kind(dtype)
    n, height, width = shape
    items = "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{name}</Item>' for k, name in enumerate(names or []))
    tags = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [bits] * n), (COMPRESSION, 3, [8 if compress else 1]), (262, 3, [1]),
        (STRIP_OFFSETS, 4, [0] * len(lengths)), (SAMPLES, 3, [n]), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, 4, lengths),
        (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor]), (SAMPLE_FORMAT, 3, [sample_format] * n), *geo_tags(height, width, box, epsg),
    ]
    tags += [(GDAL_METADATA, 2, f"<GDALMetadata>{items}</GDALMetadata>\0")] if items else []
    tags += [(GDAL_NODATA, 2, f"{nodata}\0")] if nodata is not None else []
    packed = lambda kind, v: v.encode() if kind == 2 else struct.pack(f"<{len(v)}{FIELD[kind]}", *v)
    directory = 8
    at = directory + 2 + 12 * len(tags) + 4
    places = {}
    for tag, kind, value in tags:
        raw = packed(kind, value)
        if len(raw) > 4:
            places[tag] = at
            at += len(raw) + len(raw) % 2
    offsets = (at + np.cumsum([0, *lengths[:-1]])).tolist() if lengths else []
    if lengths and offsets[-1] + lengths[-1] > 0xFFFFFFFF:
        raise UnsupportedFormatError("over 4 GB: write it with tiles, as a BigTIFF")
    out, extra = struct.pack("<2sHIH", b"II", 42, directory, len(tags)), b""
    for tag, kind, value in tags:
        raw = packed(kind, offsets if tag == STRIP_OFFSETS else value)
        out += struct.pack("<HHI", tag, kind, len(value))
        out += struct.pack("<I", places[tag]) if tag in places else raw.ljust(4, b"\0")
        extra += (raw + b"\0" * (len(raw) % 2)) if tag in places else b""
    return out + struct.pack("<I", 0) + extra


def write(bands: np.ndarray, box: tuple[float, float, float, float], names: list[str] | None = None, compress: bool = False, predictor: int = 1, epsg: int = 4326, nodata: float | None = None, rows_per_strip: int = 64) -> bytes:
    """A little-endian GeoTIFF of bands (n, height, width); row 0 is the north. uint8, uint16, int16 or float32."""
    a = np.asarray(bands)
    a = a[None] if a.ndim == 2 else a
    sample_kind(a.dtype)
    strips = [encode_strip(a[:, top : top + rows_per_strip], compress, predictor) for top in range(0, a.shape[1], rows_per_strip)]
    return strip_header([len(s) for s in strips], a.shape, a.dtype, box, names, compress, predictor, epsg, nodata, rows_per_strip) + b"".join(strips)


Tables = dict[int, tuple[int, int]]


def geo_tags(height: int, width: int, box: tuple[float, float, float, float], epsg: int) -> list[tuple[int, int, list]]:
    west, south, east, north = box
    model = [1024, 0, 1, 2] if epsg == 4326 else [1024, 0, 1, 1]
    keys = [1, 1, 0, 3, *model, 1025, 0, 1, 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg]
    return [(PIXEL_SCALE, 12, [(east - west) / width, (north - south) / height, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, west, north, 0.0]), (GEO_KEYS, 3, keys)]


def tiled_header(shapes: list[tuple[int, int]], counts: list[int], box: tuple, name: str, tile: int, predictor: int, epsg: int, big: bool) -> tuple[list[tuple[int, bytes]], Tables, int]:
    """Pieces (place, bytes) of a one-band float32 file of an image and its overviews, of each image the places of its tables of
    offsets and lengths, and where data begins. A table of one entry is the entry's own place in the directory."""
    word, kind, entry, head, count = ("Q", 16, 20, 8, "Q") if big else ("I", 4, 12, 2, "H")
    size = struct.calcsize("<" + word)
    pieces = [(0, struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8))]
    at, tables, directories = len(pieces[0][1]), {}, []
    for k, ((height, width), n) in enumerate(zip(shapes, counts, strict=True)):
        tags = [
            (254, 4, [int(k > 0)]), (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [32]), (COMPRESSION, 3, [8]), (262, 3, [1]), (SAMPLES, 3, [1]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor]), (TILE_WIDTH, 4, [tile]),
            (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, kind, n), (TILE_COUNTS, kind, n), (SAMPLE_FORMAT, 3, [3]), *(geo_tags(height, width, box, epsg) if k == 0 else []),
            *([(GDAL_METADATA, 2, f'<GDALMetadata><Item name="DESCRIPTION" sample="0" role="description">{name}</Item></GDALMetadata>\0')] if k == 0 else []), (GDAL_NODATA, 2, "nan\0"),
        ]
        directories.append((at, tags))
        at += head + entry * len(tags) + size
    for k, (begin, tags) in enumerate(directories):
        out, places = struct.pack("<" + count, len(tags)), []
        for j, (tag, field, value) in enumerate(tags):
            n = value if isinstance(value, int) else len(value)
            own = begin + head + entry * j + 4 + size
            if isinstance(value, int):
                places.append(own if n == 1 else at)
                raw, at = struct.pack("<" + word, 0 if n == 1 else at), at if n == 1 else at + n * size
            else:
                raw = value.encode() if field == 2 else struct.pack(f"<{n}{FIELD[field]}", *value)
                if len(raw) > size:
                    pieces.append((at, raw))
                    raw, at = struct.pack("<" + word, at), at + len(raw) + len(raw) % 2
            out += struct.pack(f"<HH{word}", tag, field, n) + raw.ljust(size, b"\0")
        pieces.append((begin, out + struct.pack("<" + word, directories[k + 1][0] if k + 1 < len(directories) else 0)))
        tables[k] = (places[0], places[1])
    return pieces, tables, at


def filled(pieces: list[tuple[int, bytes]], ones: dict[int, tuple[int, int]], tables: Tables, big: bool) -> list[tuple[int, bytes]]:
    """``pieces`` with the entries of tables that are in a directory."""
    out = [(at, bytearray(raw)) for at, raw in pieces]
    for k, values in ones.items():
        for place, value in zip(tables[k], values, strict=True):
            raw = struct.pack("<Q" if big else "<I", value)
            for at, own in out:
                if at <= place < at + len(own):
                    own[place - at : place - at + len(raw)] = raw
    return [(at, bytes(own)) for at, own in out]


@dataclass
class Cut:
    """Some bands of a box widened to whole blocks, strip by strip; a strip is a row of blocks."""

    bands: list[tuple[str, int]]
    columns: tuple[int, int]
    rows: tuple[int, int]
    box: tuple[float, float, float, float]
    rows_per_strip: int
    compress: bool
    predictor: int
    epsg: int
    nodata: float | None
    dtype: np.dtype
    warnings: list[str]

    @property
    def strips(self) -> int:
        return -(-(self.rows[1] - self.rows[0]) // self.rows_per_strip)

    def strip(self, reader: GeoTiffReader, k: int) -> bytes:
        """Encoded rows of the source's blocks that a strip is made of."""
        i, top = reader.main, self.rows[0] + k * self.rows_per_strip
        data = np.empty((len(self.bands), min(self.rows_per_strip, self.rows[1] - top), self.columns[1] - self.columns[0]), self.dtype)
        for n, (_, band) in enumerate(self.bands):
            for column in range(self.columns[0] // i.block_w, -(-self.columns[1] // i.block_w)):
                block = i.block(top // i.block_h, column, band)
                data[n, :, column * i.block_w - self.columns[0] : column * i.block_w - self.columns[0] + block.shape[1]] = block
        return encode_strip(data, self.compress, self.predictor)

    def header(self, lengths: list[int]) -> bytes:
        shape = (len(self.bands), self.rows[1] - self.rows[0], self.columns[1] - self.columns[0])
        return strip_header(lengths, shape, self.dtype, self.box, [n for n, _ in self.bands], self.compress, self.predictor, self.epsg, self.nodata, self.rows_per_strip)


def cut(reader: GeoTiffReader, names: list[str] | None = None, box: tuple | None = None) -> Cut:
    """The plan of a trim, from the header alone."""
    if reader.big or reader.order == ">" or reader.overviews:
        raise UnsupportedFormatError("BigTIFF, big-endian files and files with overviews can't be cut")
    own, image, warnings = reader.variables(), reader.main, []
    kept = [v for v in own if names is None or v.name in names]
    if not kept:
        raise SourceError("no band is left")
    x0, dx, y0, dy = reader.affine()
    c0, c1, r0, r1 = 0, image.width, 0, image.height
    if box:
        west, south, east, north = box
        c0, c1 = int(max(0, (west - x0) / dx // image.block_w * image.block_w)), int(min(image.width, -(-((east - x0) / dx) // image.block_w) * image.block_w))
        r0, r1 = int(max(0, (y0 - north) / -dy // image.block_h * image.block_h)), int(min(image.height, -(-((y0 - south) / -dy) // image.block_h) * image.block_h))
        warnings.append(f"widened to whole blocks: columns {c0} to {c1}, rows {r0} to {r1}")
    code = int(reader._keys().get(3072, 4326))
    return Cut(
        [(v.name, int(v.attrs["band"])) for v in kept], (c0, c1), (r0, r1), (x0 + c0 * dx, y0 + r1 * dy, x0 + c1 * dx, y0 + r0 * dy), image.block_h,
        image.tags.get(COMPRESSION, [1])[0] != 1, image.tags.get(PREDICTOR, [1])[0], code, image.nodata(), image.dtype.newbyteorder("="), warnings,
    )


def trim(source: ByteSource, names: list[str] | None = None, box: tuple | None = None) -> tuple[bytes, list[str]]:
    """``cut`` as bytes."""
    reader = GeoTiffReader(source)
    plan = cut(reader, names, box)
    strips = [plan.strip(reader, k) for k in range(plan.strips)]
    return plan.header([len(s) for s in strips]) + b"".join(strips), plan.warnings
