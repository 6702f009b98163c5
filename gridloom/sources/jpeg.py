"""Baseline JPEG blocks of TIFF files: Huffman codes, inverse cosine transform over all blocks at once, chroma repeated."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from gridloom.errors import SourceError, UnsupportedFormatError

#: The order of an 8 x 8 block's coefficients, as row * 8 + column, diagonal by diagonal, turning at each.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


@dataclass
class Component:
    h: int
    v: int
    quantiser: int
    dc: int = 0
    ac: int = 0


@dataclass
class Tables:
    """What a TIFF's blocks share: quantisers, and Huffman codes as (length, symbol) of every 16 bits."""

    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[tuple[int, int], tuple[list[int], list[int]]] = field(default_factory=dict)


def lookup(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    lengths, values, at, k = [0] * 65536, [0] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[k : k + n]:
            wide = 1 << 16 - length
            lengths[at : at + wide], values[at : at + wide] = [length] * wide, [symbol] * wide
            at += wide
        k += n
    return lengths, values


def decode(data: bytes, tables: bytes | None = None) -> np.ndarray:
    """Samples (height, width, components) as they are stored; ``tables``: a stream of tables alone, read first."""
    known = Tables()
    if tables:
        _segments(tables, known)
    found = _segments(data, known)
    if found is None:
        raise SourceError("a JPEG without an image")
    return found


def _segments(data: bytes, known: Tables) -> np.ndarray | None:
    at, restart, size, components = 2, 0, (0, 0), {}
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise SourceError("no JPEG marker where one should be")
        marker = data[at + 1]
        if marker == 0xD9:
            return None
        if marker == 0xFF:  # padding
            at += 1
            continue
        n = int.from_bytes(data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide, size_ = body[0] >> 4, 64 << (body[0] >> 4)
                own = np.zeros(64)
                own[ZIGZAG] = np.frombuffer(body[1 : 1 + size_], ">u2" if wide else "u1")
                known.quantisers[body[0] & 15], body = own, body[1 + size_ :]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                known.codes[body[0] >> 4, body[0] & 15], body = lookup(body[1:17], body[17 : 17 + total]), body[17 + total :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise UnsupportedFormatError(f"JPEG samples of {body[0]} bits")
            size = int.from_bytes(body[1:3]), int.from_bytes(body[3:5])
            components = {body[k]: Component(body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)}
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
            raise UnsupportedFormatError("JPEG other than baseline")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2])
        elif marker == 0xDA:
            if body[0] != len(components):
                raise UnsupportedFormatError("JPEG with several scans")
            for k in range(1, 1 + 2 * body[0], 2):
                components[body[k]].dc, components[body[k]].ac = body[k + 1] >> 4, body[k + 1] & 15
            return _scan(data[at:], known, list(components.values()), size, restart)
    return None


def _scan(data: bytes, known: Tables, components: list[Component], size: tuple[int, int], restart: int) -> np.ndarray:
    height, width = size
    if len(components) == 1:
        components[0].h = components[0].v = 1
    most_h, most_v = max(c.h for c in components), max(c.v for c in components)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    units, blocks = across * down, [[] for _ in components]
    plan = [(k, *known.codes[0, c.dc], *known.codes[1, c.ac]) for k, c in enumerate(components) for _ in range(c.h * c.v)]
    at, done = 0, 0
    while done < units:
        end = at  # up to the next marker that is no stuffed byte
        while (end := data.find(b"\xff", end)) >= 0 and data[end + 1 : end + 2] == b"\0":
            end += 2
        end = len(data) if end < 0 else end
        stream = data[at:end].replace(b"\xff\0", b"\xff") + b"\0" * 16
        n = min(restart or units, units - done)
        _units(stream, plan, n, blocks)
        done, at = done + n, end + 2
        if done < units and not restart:
            raise SourceError("a JPEG cut short")
    out = np.empty((height, width, len(components)), np.uint8)
    order = np.argsort(ZIGZAG)
    for k, c in enumerate(components):
        found = np.array(blocks[k], np.float64)[:, order] * known.quantisers[c.quantiser]
        pixels = np.einsum("ux,nuv,vy->nxy", COSINES, found.reshape(-1, 8, 8), COSINES)
        plane = pixels.reshape(down, across, c.v, c.h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * c.v * 8, across * c.h * 8)
        plane = np.clip(np.floor(plane + 128.5), 0, 255).astype(np.uint8)
        out[..., k] = plane.repeat(most_v // c.v, axis=0).repeat(most_h // c.h, axis=1)[:height, :width]
    return out


def _units(stream: bytes, plan: list[tuple], n: int, blocks: list[list[list[int]]]) -> None:
    """The coefficients of ``n`` units, appended to each component's blocks, in zigzag order."""
    held, bits, at, before = 0, 0, 0, [0] * len(blocks)
    for _ in range(n):
        for k, dc_lengths, dc_values, ac_lengths, ac_values in plan:
            block, place, lengths, values = [0] * 64, 0, dc_lengths, dc_values
            while place < 64:
                if bits < 32:
                    held = (held & (1 << bits) - 1) << 64 | int.from_bytes(stream[at : at + 8].ljust(8, b"\0"))
                    bits, at = bits + 64, at + 8
                peek = held >> bits - 16 & 0xFFFF
                length, value = lengths[peek], values[peek]
                if not length:
                    raise SourceError("no such JPEG code")
                bits -= length
                run, width = value >> 4, value & 15
                if place == 0:
                    run, width = 0, value
                elif not width and run < 15:  # the rest is zero
                    break
                place += run
                if width:
                    bits -= width
                    raw = held >> bits & (1 << width) - 1
                    if place > 63:
                        raise SourceError("a JPEG block with too many coefficients")
                    block[place] = raw if raw >> width - 1 else raw - (1 << width) + 1
                if place == 0:
                    before[k] += block[0]
                    block[0], lengths, values = before[k], ac_lengths, ac_values
                place += 1
            blocks[k].append(block)


def to_rgb(samples: np.ndarray) -> np.ndarray:
    """Y, Cb, Cr as red, green, blue."""
    y, b, r = (samples[..., k].astype(np.float64) - (128 if k else 0) for k in range(3))
    rgb = np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], axis=-1)
    return np.clip(np.floor(rgb + 0.5), 0, 255).astype(np.uint8)
