"""Chunk codecs: gzip, zlib, zstd, lz4, blosc; shuffle; LZW and PackBits of TIFF; and its predictors."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from gridloom.errors import UnsupportedFormatError


def inflate(data: bytes) -> bytes:
    """zlib or gzip."""
    return zlib.decompress(data, 15 + 32)


def unzstd(data: bytes, size: int = 0) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def lz4_block(data: bytes, size: int) -> bytes:
    import pyarrow as pa

    return pa.decompress(data, decompressed_size=size, codec="lz4_raw", asbytes=True)


def unshuffle(data: bytes, width: int) -> bytes:
    """Bytes grouped by significance back to elements; what doesn't fill an element stays at the end."""
    if width <= 1:
        return data
    n = len(data) // width
    return np.frombuffer(data, np.uint8, n * width).reshape(width, n).T.tobytes() + data[n * width :]


def bit_unshuffle(data: bytes, width: int) -> bytes:
    n = len(data) // width // 8 * 8
    planes = np.unpackbits(np.frombuffer(data, np.uint8, n * width).reshape(width * 8, n // 8), axis=1, bitorder="little")
    return np.packbits(planes.T.reshape(n, width, 8), axis=2, bitorder="little").tobytes() + data[n * width :]


class Blosc:
    """A blosc 1 frame: header, block offsets, and blocks that can be opened one by one."""

    CODECS = {0: "blosclz", 1: "lz4", 2: "snappy", 3: "zlib", 4: "zstd"}

    def __init__(self, frame: bytes):
        if len(frame) < 16:
            raise UnsupportedFormatError("a blosc frame has 16 bytes at least")
        _, _, self.flags, self.width = frame[:4]
        self.size, self.block, self.stored = struct.unpack("<III", frame[4:16])
        self.frame, self.codec = frame, self.CODECS.get(self.flags >> 5, "?")
        self.n_blocks = -(-self.size // self.block) if self.block else 0
        self.plain = bool(self.flags & 2)
        self.offsets = () if self.plain else struct.unpack(f"<{self.n_blocks}I", frame[16 : 16 + 4 * self.n_blocks])

    def blocks_for(self, start: int, length: int) -> range:
        """Blocks that hold the bytes."""
        return range(start // self.block, -(-(start + length) // self.block))

    def open_block(self, k: int) -> bytes:
        size = min(self.block, self.size - k * self.block)
        if self.plain:
            raw = self.frame[16 + k * self.block : 16 + k * self.block + size]
            return raw
        # Whole blocks are split in one stream for each byte of an element, unless flagged otherwise.
        split = not self.flags & 0x10 and size == self.block and 1 < self.width <= 16 and size % self.width == 0 and size // self.width >= 128
        streams, at, parts = self.width if split else 1, self.offsets[k], []
        for _ in range(streams):
            n = struct.unpack("<i", self.frame[at : at + 4])[0]
            part = self.frame[at + 4 : at + 4 + n]
            parts.append(part if n == size // streams else self._expand(part, size // streams))
            at += 4 + n
        raw = b"".join(parts)
        if self.flags & 1:
            return unshuffle(raw, self.width)
        return bit_unshuffle(raw, self.width) if self.flags & 4 else raw

    def _expand(self, data: bytes, size: int) -> bytes:
        if self.codec == "lz4":
            return lz4_block(data, size)
        if self.codec == "zlib":
            return zlib.decompress(data)
        if self.codec == "zstd":
            return unzstd(data)
        if self.codec == "snappy":
            import pyarrow as pa

            return pa.decompress(data, decompressed_size=size, codec="snappy", asbytes=True)
        if self.codec == "blosclz":
            return blosclz(data, size)
        raise UnsupportedFormatError(f"blosc codec {self.codec}")

    def decode(self) -> bytes:
        return b"".join(self.open_block(k) for k in range(self.n_blocks))


def blosclz(data: bytes, size: int) -> bytes:
    """The FastLZ-like codec: a control byte below 32 starts a literal run, others a match with a 13-bit or far distance."""
    out, at, n = bytearray(), 0, len(data)
    control = data[0] & 31
    at = 1
    while True:
        if control >= 32:
            length, distance = (control >> 5) - 1, (control & 31) << 8
            if length == 6:
                while data[at] == 255:
                    length, at = length + 255, at + 1
                length, at = length + data[at], at + 1
            low, at = data[at], at + 1
            if low == 255 and distance == 31 << 8:
                distance, at = (data[at] << 8 | data[at + 1]) + 8191, at + 2
            else:
                distance += low
            distance, length = distance + 1, length + 3
            for _ in range(length):
                out.append(out[-distance])
        else:
            out += data[at : at + control + 1]
            at += control + 1
        if at >= n:
            break
        control, at = data[at], at + 1
    if len(out) != size:
        raise UnsupportedFormatError(f"blosclz gave {len(out)} of {size} bytes")
    return bytes(out)


def decompress(data: bytes, codec: dict | str | None, size: int) -> bytes:
    """By a Zarr compressor description (v2) or codec name."""
    name = codec.get("id", codec.get("name")) if isinstance(codec, dict) else codec
    if name in (None, "null"):
        return data
    if name in ("zlib", "gzip"):
        return inflate(data)
    if name == "zstd":
        return unzstd(data)
    if name == "lz4":
        return lz4_block(data[4:], struct.unpack("<I", data[:4])[0])
    if name == "blosc":
        return Blosc(data).decode()
    raise UnsupportedFormatError(f"compressor {name!r}")


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes from the high bit down, 9 to 12 bits wide, growing one code early."""
    table: list[bytes] = []
    out, width, held, bits, last = [], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise UnsupportedFormatError("an LZW code that isn't in the table")
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def undo_predictor(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """``block`` (rows, columns, samples) of stored samples; 2: running sums along rows, 3: bytes by significance first."""
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if predictor == 3:
        rows, columns, samples = block.shape
        width = block.dtype.itemsize
        flat = block.reshape(rows, -1).view(np.uint8).reshape(rows, -1, samples)
        summed = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(rows, width, columns * samples)
        return np.ascontiguousarray(summed.transpose(0, 2, 1)).view(f">f{width}").reshape(rows, columns, samples).astype(order + f"f{width}")
    if predictor != 1:
        raise UnsupportedFormatError(f"predictor {predictor}")
    return block


def apply_predictor(block: np.ndarray, predictor: int) -> np.ndarray:
    """The inverse, for writing; gives bytes for 3."""
    if predictor == 2:
        out = block.copy()
        out[:, 1:] -= block[:, :-1]
        return out
    if predictor == 3:
        rows, columns, samples = block.shape
        width = block.dtype.itemsize
        raw = block.astype(f">f{width}").view(np.uint8).reshape(rows, columns * samples, width).transpose(0, 2, 1).reshape(rows, -1, samples)
        out = raw.copy()
        out[:, 1:] -= raw[:, :-1]
        return out
    return block
