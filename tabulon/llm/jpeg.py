"""A decoder of baseline JPEG images, for the frames of motion-JPEG files whoever wrote them.

It reads quantisers (DQT), Huffman codes (DHT), frames (SOF0, SOF1), restart intervals (DRI) and scans (SOS), of one or
several components with any sampling. Progressive, lossless and arithmetic images are refused.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

# Fixed values of the format: the order in which a block's coefficients are stored.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])


def _dct() -> np.ndarray:
    """From 64 coefficients (by rows of frequencies) to 64 samples."""
    x, u = np.meshgrid(np.arange(8), np.arange(8))
    one = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    one[0] /= np.sqrt(2)
    return np.kron(one, one)


#: From a block's coefficients as they are stored to its samples.
INVERSE = _dct()[ZIGZAG]


def samples_of(levels: np.ndarray) -> np.ndarray:
    """Bytes of blocks (n x 64) from their coefficients, as they are stored and without quantisers."""
    return np.clip(np.rint(levels @ INVERSE + 128), 0, 255).astype(np.uint8)


def segments(data: bytes) -> Iterator[tuple[int, bytes, int]]:
    """(marker, body, place after it) of an image's segments up to its end; after a scan, its coded data are passed over."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    yield from tables(data, 2)


def tables(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes, int]]:
    while at + 1 < len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one should be")
        mark = data[at + 1]
        if mark == 0xFF or mark == 0x01 or 0xD0 <= mark <= 0xD7:  # filling, or markers without a body
            at += 1 if mark == 0xFF else 2
            continue
        if mark == 0xD9:
            return
        if at + 4 > len(data):
            break
        end = at + 2 + struct.unpack_from(">H", data, at + 2)[0]
        if end > len(data):
            break
        yield mark, data[at + 4 : end], end
        at = end
        if mark == 0xDA:
            at = _scan_end(data, at)
    if at and data[at : at + 2] != b"\xff\xd9" and at < len(data):
        raise ValueError("the image ends too early")


def _scan_end(data: bytes, at: int) -> int:
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("the scan has no end")
        if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 2


def _codes(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits that may come next, the length of the code that they begin with times 256, and its symbol; 0 where there is none."""
    out, code, k = np.zeros(1 << 16, dtype=np.int64), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[code << 16 - length : code + 1 << 16 - length] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out.tolist()


class _Bits:
    """Coded data of one restart interval, without stuffed bytes."""

    def __init__(self, data: bytes):
        self.size = 8 * (len(data) - data.count(b"\xff\x00"))
        self.data, self.at = data.replace(b"\xff\x00", b"\xff") + b"\xff" * 8, 0

    def ahead(self) -> int:
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 3]) >> 8 - (self.at & 7) & 0xFFFF

    def symbol(self, codes: list[int]) -> int:
        found = codes[self.ahead()]
        self.at += found >> 8
        if not found or self.at > self.size:
            raise ValueError("no code, or the data end too early")
        return found & 255

    def value(self, bits: int) -> int:
        if not bits:
            return 0
        v = self.ahead() >> 16 - bits
        self.at += bits
        return v if v >> bits - 1 else v - (1 << bits) + 1


def _block(bits: _Bits, out: list[int], before: int, dc: list[int], ac: list[int]) -> int:
    """Read a block's coefficients into `out` (64 zeros); the new direct one."""
    out[0] = before = before + bits.value(bits.symbol(dc))
    k = 1
    while k < 64:
        s = bits.symbol(ac)
        if not s & 15:
            if s != 0xF0:
                break
            k += 16
            continue
        k += s >> 4
        if k > 63:
            raise ValueError("a block has too many coefficients")
        out[k] = bits.value(s & 15)
        k += 1
    return before


#: Samples of an image, at most: a broken header may ask for any number.
MOST = 1 << 26


def decode(image: bytes, shared: bytes = b"") -> list[np.ndarray]:
    """The planes (rows x columns of bytes) of an image's components, each in its own size; a ValueError for whatever is broken.

    `shared` are segments (DHT, DQT) that count before the image's own, for frames that leave theirs out.
    """
    try:
        return _decode(image, shared)
    except (IndexError, KeyError, struct.error, OverflowError, TypeError, MemoryError) as error:
        raise ValueError(f"a broken image: {type(error).__name__}: {error}") from error


def _decode(image: bytes, shared: bytes) -> list[np.ndarray]:
    quantisers, codes, interval, frame, planes = {}, {}, 0, None, {}
    for mark, body, end in [*tables(shared), *segments(image)]:
        if mark == 0xDB:
            while body:
                wide, k = divmod(body[0], 16)
                n = 64 * (1 + wide)
                quantisers[k] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.float64)
                body = body[1 + n :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
            if depth != 8 or not height or not width or not parts or not all(0 < a < 5 and 0 < b < 5 for a, b, _ in parts.values()):
                raise ValueError("not an image of bytes")
            if (height + 64) * (width + 64) * len(parts) > MOST:
                raise ValueError("an image of too many samples")
            frame = (height, width, parts, max(a for a, _, _ in parts.values()), max(b for _, b, _ in parts.values()))
        elif 0xC2 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif mark == 0xDD:
            interval = struct.unpack_from(">H", body)[0]
        elif mark == 0xDA:
            if frame is None:
                raise ValueError("a scan before its frame")
            scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            try:
                planes |= _scan(image[end : _scan_end(image, end)], scan, frame, quantisers, codes, interval)
            except KeyError as error:
                raise ValueError(f"no table or component {error}") from error
    if frame is None or set(planes) != set(frame[2]):
        raise ValueError("components are missing")
    return [planes[k] for k in frame[2]]


def _scan(data, scan, frame, quantisers, codes, interval):
    """The planes of a scan's components."""
    height, width, parts, most_h, most_v = frame
    size = {k: (-(-height * parts[k][1] // most_v), -(-width * parts[k][0] // most_h)) for k, _, _ in scan}
    if len(scan) == 1:  # its own blocks, row by row
        k = scan[0][0]
        down, across = -(-size[k][0] // 8), -(-size[k][1] // 8)
        shape, units = {k: (down, across)}, {k: (1, 1)}
    else:
        down, across = -(-height // (8 * most_v)), -(-width // (8 * most_h))
        units = {k: (parts[k][1], parts[k][0]) for k, _, _ in scan}
        shape = {k: (down * v, across * h) for k, (v, h) in units.items()}
    blocks = {k: [[0] * 64 for _ in range(a * b)] for k, (a, b) in shape.items()}
    # bytes of a restart interval end at a marker; stuffed bytes hide no marker
    pieces, at = [], 0
    for k in range(len(data) - 1):
        if data[k] == 0xFF and 0xD0 <= data[k + 1] <= 0xD7:
            pieces.append(data[at:k])
            at = k + 2
    pieces.append(data[at:])
    every = down * across
    step = interval or every
    if len(pieces) < -(-every // step):
        raise ValueError("restart intervals are missing")
    for n, piece in zip(range(0, every, step), pieces):
        bits, before = _Bits(piece), dict.fromkeys(shape, 0)
        for unit in range(n, min(n + step, every)):
            y, x = divmod(unit, across)
            for k, dc, ac in scan:
                v, h = units[k]
                for dy in range(v):
                    for dx in range(h):
                        before[k] = _block(bits, blocks[k][(y * v + dy) * shape[k][1] + x * h + dx], before[k], codes[dc], codes[16 + ac])
    out = {}
    for k, (a, b) in shape.items():
        found = samples_of(np.array(blocks[k], dtype=np.float64) * quantisers[parts[k][2]])
        out[k] = found.reshape(a, b, 8, 8).swapaxes(1, 2).reshape(8 * a, 8 * b)[: size[k][0], : size[k][1]]
    return out
