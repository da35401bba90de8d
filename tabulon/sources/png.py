"""PNG images to arrays, without an image library, and areas of images to arrays of one size."""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np

# Fixed values of the format: samples of a pixel by the colour type, and where the seven passes of interlacing begin and step.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
MARK = b"\x89PNG\r\n\x1a\n"
#: Pixels of an image, at most: what one row may ask of a worker's memory.
MOST = 1 << 26


def _chunks(data: bytes):
    at = len(MARK)
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data) or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("a chunk is cut off or damaged")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise ValueError("the image has no end")


def unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Scanlines (a filter's number, then bytes) without their filters; `step` bytes lie between a byte and the one left of it."""
    out = np.zeros((len(rows), rows.shape[1] - 1), dtype=np.uint8)
    above = np.zeros(out.shape[1], dtype=np.uint8)
    width = -(-out.shape[1] // step) * step
    for k, (kind, line) in enumerate(zip(rows[:, 0].tolist(), rows[:, 1:])):
        if kind == 0:
            out[k] = line
        elif kind == 1:  # each byte adds the one left of it: running sums
            padded = np.zeros(width, dtype=np.uint8)
            padded[: len(line)] = line
            out[k] = np.add.accumulate(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(line)]
        elif kind == 2:
            out[k] = line + above
        elif kind in (3, 4):
            now, up, got = line.tolist(), above.tolist(), [0] * len(line)
            for i, x in enumerate(now):
                a, b = (got[i - step], up[i]) if i >= step else (0, up[i])
                if kind == 3:
                    got[i] = (x + (a + b >> 1)) & 255
                else:  # of left, above and both the nearest to left + above - both
                    c = up[i - step] if i >= step else 0
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    got[i] = (x + (a if da <= db and da <= dc else b if db <= dc else c)) & 255
            out[k] = got
        else:
            raise ValueError(f"there is no filter {kind}")
        above = out[k]
    return out


def _samples(lines: np.ndarray, width: int, depth: int, samples: int) -> np.ndarray:
    """Rows by columns by samples, of packed bytes."""
    if depth == 16:
        return lines.reshape(len(lines), width, samples, 2)[..., 0]  # the upper byte
    if depth == 8:
        return lines.reshape(len(lines), width, samples)
    bits = np.unpackbits(lines, axis=1)[:, : width * depth].reshape(len(lines), width, depth)
    return (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[..., None]


def decode(data: bytes) -> np.ndarray:
    """Rows by columns by RGB, as bytes; transparency is left out, as it is where an image library turns an image into RGB."""
    if not data.startswith(MARK):
        raise ValueError("no PNG image")
    head, palette, packed = None, None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None:
        raise ValueError("the image has no header")
    width, height, depth, colour, squeeze, filters, woven = head
    if depth not in _DEPTHS.get(colour, ()) or squeeze or filters or woven > 1 or not 0 < width * height <= MOST:
        raise ValueError("an image of an unknown kind, or too large")
    samples = _SAMPLES[colour]
    raw, at = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8), 0
    out = np.zeros((height, width, samples), dtype=np.uint8)
    for x, y, dx, dy in _PASSES if woven else ((0, 0, 1, 1),):
        w, h = -(-(width - x) // dx), -(-(height - y) // dy)
        if w <= 0 or h <= 0:
            continue
        line = 1 + -(-w * depth * samples // 8)
        if at + line * h > len(raw):
            raise ValueError("the image has too few bytes")
        lines = unfiltered(raw[at : at + line * h].reshape(h, line), max(1, depth * samples // 8))
        out[y::dy, x::dx] = _samples(lines, w, depth, samples)
        at += line * h
    if colour == 3:
        if palette is None or out.max() >= len(palette):
            raise ValueError("a colour isn't in the palette")
        return palette[out[..., 0]]
    if depth < 8:
        out = (out.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    return out[..., :3] if samples > 2 else np.repeat(out[..., :1], 3, axis=2)


def _weights(n: int, to: int) -> np.ndarray:
    """How much of each of `n` pixels lies in each of `to` equal parts of their row."""
    edges = np.linspace(0, n, to + 1)
    low, high = np.maximum(edges[:-1, None], np.arange(n)), np.minimum(edges[1:, None], np.arange(1, n + 1))
    return np.maximum(high - low, 0) * (to / n)


_kept = functools.lru_cache(256)(_weights)


def resized(rgb: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of the areas that the new pixels cover, as numbers from 0 to 255."""
    h, w, c = rgb.shape
    down, across = ((_kept if n * to <= 1 << 14 else _weights)(n, to) for n, to in ((h, height), (w, width)))  # small ones are kept, 128 KB each at most
    return across @ (down @ rgb.reshape(h, w * c).astype(float)).reshape(height, w, c)


def encode(rgb: np.ndarray, kind: int = 4) -> bytes:
    """A PNG image of RGB bytes, with one of the five filters (0 none, 1 left, 2 above, 3 their mean, 4 the nearest of left, above and both)."""
    height, width = rgb.shape[:2]
    now = rgb.reshape(height, width * 3).astype(np.int16)
    left, up, both = (np.zeros_like(now) for _ in range(3))
    left[:, 3:], up[1:], both[1:, 3:] = now[:, :-3], now[:-1], now[:-1, :-3]
    whole = left + up - both
    near = [np.abs(whole - v) for v in (left, up, both)]
    nearest = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, both))
    lines = (now - (0, left, up, left + up >> 1, nearest)[kind]).astype(np.uint8)
    raw = np.concatenate((np.full((height, 1), kind, dtype=np.uint8), lines), axis=1).tobytes()
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
