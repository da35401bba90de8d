"""Media columns: motion JPEG in AVI, its index, its frames and its shots.

`media_clips` reads a column of AVI files: their RIFF index (or, where there is none, their movie list), the video
stream's frames by the decoder in `jpeg`, and the clips between cuts.

`text_media` makes such files of texts. A payload is stored without loss in the unit of baseline JPEG, the quantised
coefficient: each block holds 63 payload bytes as its AC coefficients, and 0 as its DC difference. With one Huffman
code of one bit for the pair (no zeros before, 8 bits), a coefficient takes 9 bits, its 8 magnitude bits are the byte
itself, and a block takes 71 bytes, so that whole frames are coded and decoded by array operations. All quantisers are
1. Frames with exactly this header take that way; all others take the general decoder.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import jpeg
from tabulon.llm.common import release, ship

SIDE = 32  # pixels of a frame's side
BLOCKS = (SIDE // 8) ** 2
HELD = 63 * BLOCKS  # payload bytes of a frame
RATE = 25  # frames a second
AT_ONCE = 1024  # frames that are coded or decoded together


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def _huffman(kind: int, symbol: int) -> bytes:
    return _segment(0xC4, bytes([kind, 1, *[0] * 15, symbol]))


_HEAD = b"".join([
    b"\xff\xd8",
    _segment(0xDB, bytes([0, *[1] * 64])),
    _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + bytes([1, 0x11, 0])),
    _huffman(0x00, 0),
    _huffman(0x10, 8),
    _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
])


def encode_frames(payload: bytes) -> list[bytes]:
    """JPEG images of HELD payload bytes each, the last filled up with zeros."""
    out = []
    for at in range(0, max(len(payload), 1), HELD * AT_ONCE):
        part = payload[at : at + HELD * AT_ONCE]
        frames = -(-len(part) // HELD) or 1
        values = np.zeros(frames * HELD, dtype=np.uint8)
        values[: len(part)] = np.frombuffer(part, dtype=np.uint8)
        bits = np.zeros((frames * BLOCKS, 568), dtype=np.uint8)  # a 0 for the DC difference, then a 0 and 8 bits for each coefficient
        bits[:, 1:].reshape(-1, 63, 9)[:, :, 1:] = np.unpackbits(values).reshape(-1, 63, 8)
        for coded in np.packbits(bits, axis=1).reshape(frames, -1):
            out.append(b"".join((_HEAD, coded.tobytes().replace(b"\xff", b"\xff\x00"), b"\xff\xd9")))
    return out


def decode_frames(frames: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The payload bytes of frames of this kind, and their samples (frames x blocks x 64)."""
    scans = []
    for image in frames:
        if image[: len(_HEAD)] != _HEAD or image[-2:] != b"\xff\xd9":
            raise ValueError("not a frame of this kind")
        scans.append(image[len(_HEAD) : -2].replace(b"\xff\x00", b"\xff"))
    bits = np.unpackbits(np.frombuffer(b"".join(scans), dtype=np.uint8).reshape(-1, 71), axis=1)
    values = np.packbits(bits[:, 1:].reshape(-1, 63, 9)[:, :, 1:].reshape(-1, 8), axis=1).reshape(-1, 63)
    levels = values.astype(np.float64)
    levels[values < 128] -= 255  # a leading 0 marks a negative coefficient
    samples = np.clip(np.rint(levels @ jpeg.INVERSE[1:] + 128), 0, 255).astype(np.uint8)  # the direct ones are 0
    return values.tobytes(), samples.reshape(len(frames), -1)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """An AVI file whose video stream holds `payload`, with an index; a chunk `plen` has the payload's length."""
    frames = encode_frames(payload)
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    form = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    index, at, movie = [], 4, [b"movi"]
    for image in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(image)))
        movie.append(chunk := _chunk(b"00dc", image))
        at += len(chunk)
    return _chunk(b"RIFF", b"".join([b"AVI ", head, _chunk(b"plen", struct.pack("<Q", len(payload))), _chunk(b"LIST", b"".join(movie)), _chunk(b"idx1", b"".join(index))]))


def _listed(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes, int, int]]:
    """(name, kind of a list, place of the body, its size) of the chunks between two places; a list's body begins after its kind."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        inner = name in (b"LIST", b"RIFF")
        yield name, data[at + 8 : at + 12] if inner else b"", at + (12 if inner else 8), size - (4 if inner else 0)
        at += 8 + size + (size & 1)


def _movie(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, place of the body, size) of the chunks of a movie list, records inside included."""
    for name, kind, body, size in _listed(data, at, min(end, len(data))):
        if kind == b"rec ":
            yield from _movie(data, body, body + size)
        elif not kind:
            yield name, body, size


def read_avi(data: bytes) -> tuple[list[bytes], float, int | None]:
    """The video stream's frames by the index, frames a second, and the payload's length (None in files that aren't ours).

    Of several video streams the first counts; sound, text and palette chunks are passed over. Offsets of an index count
    from the movie list or from the file's start. A file without an index is read through its movie lists. An empty
    chunk repeats the frame before it.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movies, index, rate, length, stream, streams = [], None, 0.0, None, None, 0
    parts = [(name, kind, body, size) for _, form, at, n in _listed(data, 0, len(data)) if form in (b"AVI ", b"AVIX") for name, kind, body, size in _listed(data, at, min(at + n, len(data)))]
    for name, kind, body, size in parts:
        if kind == b"movi":
            movies.append((body - 4, body, body + size))
        elif name == b"idx1":
            index = data[body : body + size]
        elif name == b"plen":
            length = struct.unpack_from("<Q", data, body)[0]
        elif kind == b"hdrl":
            for inner, of, at, n in _listed(data, body, body + size):
                if inner == b"avih":
                    rate = rate or 1e6 / max(struct.unpack_from("<I", data, at)[0], 1)
                elif of == b"strl":
                    head = next((x for x in _listed(data, at, at + n) if x[0] == b"strh"), None)
                    if head and stream is None and data[head[2] : head[2] + 4] == b"vids":
                        stream, (scale, ticks) = streams, struct.unpack_from("<II", data, head[2] + 20)
                        rate = ticks / scale if scale and ticks else rate
                    streams += 1
    if stream is None or not movies or not rate:
        raise ValueError("no video stream")
    names, frames = (b"%02ddc" % stream, b"%02ddb" % stream), []
    if index:
        found, base = [], None
        for k in range(0, len(index) - 15, 16):
            name, _, place, size = struct.unpack_from("<4sIII", index, k)
            if name not in names:
                continue
            if base is None:
                base = movies[0][0] if data[movies[0][0] + place : movies[0][0] + place + 4] == name else 0
            if data[base + place : base + place + 4] != name:
                raise ValueError("the index doesn't fit the frames")
            found.append((base + place + 8, size))
    else:
        found = [(body, size) for _, at, end in movies for name, body, size in _movie(data, at, end) if name in names]
    for at, size in found:
        if size or frames:
            frames.append(data[at : at + size] if size else frames[-1])
    if not frames:
        raise ValueError("the video stream has no frames")
    return frames, rate, length


def histograms(samples: np.ndarray) -> np.ndarray:
    """Shares of 16 levels of light in the frames (rows of bytes)."""
    n = len(samples)
    rows = np.repeat(np.arange(n), samples.shape[1]) * 16 + (samples >> 4).ravel()
    return np.bincount(rows, minlength=16 * n).reshape(n, 16) / samples.shape[1]


def shots(shares: np.ndarray, times: float = 3.0, around: int = 8, least: float = 0.15) -> list[tuple[int, int]]:
    """(first frame, frames) of each shot: cuts where the difference of neighbouring histograms is over `least`, and over its neighbourhood's mean by `times` its deviation."""
    d = np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2
    sums, squares = (np.concatenate(([0.0], np.cumsum(x))) for x in (d, d * d))
    k = np.arange(len(d))
    low, high = np.maximum(k - around, 0), np.minimum(k + around + 1, len(d))
    others = np.maximum(high - low - 1, 1)
    mean = (sums[high] - sums[low] - d) / others
    deviation = np.sqrt(np.maximum((squares[high] - squares[low] - d * d) / others - mean * mean, 0))
    cuts = np.flatnonzero((d > least) & (d > mean + times * deviation + 1e-9)) + 1
    bounds = [0, *cuts.tolist(), len(shares)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def clips(data: bytes) -> tuple[bytes, list[tuple[int, float, float, int]]]:
    """The payload of an AVI file (empty if it isn't ours), and its clips: number, start and end in seconds, frames."""
    frames, rate, length = read_avi(data)
    payload, shares = [], []
    if all(f[: len(_HEAD)] == _HEAD for f in frames):
        for k in range(0, len(frames), AT_ONCE):
            held, samples = decode_frames(frames[k : k + AT_ONCE])
            payload.append(held)
            shares.append(histograms(samples))
    else:  # of the first component, the light
        shares = [histograms(jpeg.decode(f)[0].reshape(1, -1)) for f in frames]
    found = shots(np.concatenate(shares))
    return b"".join(payload)[: length or 0], [(k, a / rate, (a + n) / rate, n) for k, (a, n) in enumerate(found)]


def padded(text: str | None) -> bytes:
    """A text's UTF-8 bytes and zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))


CLIPS = "doc_id long, n_bytes long, media binary, clips array<struct<clip:int,start_s:double,end_s:double,frames:int>>"
SUMMARY = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_clips long"


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32())]))
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            data = write_avi(padded(text))
            found = [dict(zip(("clip", "start_s", "end_s", "frames"), c)) for c in clips(data)[1]]
            size = len((text or "").encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary()), pa.array([found], kind)], names=["doc_id", "n_bytes", "media", "clips"])
    release()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            data = write_avi(padded(text))
            payload, found = clips(data)
            feature = ";".join(f"{a:.2f}-{b:.2f}" for _, a, b, _ in found)
            rows.append((doc, len((text or "").encode("utf-8", "surrogatepass")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(found)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)
    release()


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the AVI file), clips: a row for each row of `docs`. Null texts are empty."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_media, CLIPS)


def clip_rows(media: DataFrame) -> DataFrame:
    """A row for each clip of text_media's rows: doc_id, clip, start_s, end_s, frames. Repeated rows have theirs each; an empty table gives none."""
    return media.select("doc_id", F.inline("clips"))


CLIP = "key {}, clip int, start_s double, end_s double, frames int, error string"


def _clip_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, media in enumerate(batch.column(1)):
            try:
                rows = [(*c, None) for c in clips(media.as_py() or b"")[1]]
            except (ValueError, struct.error, IndexError, KeyError, OverflowError, MemoryError) as error:
                rows = [(None, None, None, None, str(error) or "broken")]
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.string())
            key = batch.column(0).take(pa.array([k] * len(rows)))
            yield pa.RecordBatch.from_arrays([key, *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], names=["key", "clip", "start_s", "end_s", "frames", "error"])
    release()


def media_clips(df: DataFrame, key: str, column: str) -> DataFrame:
    """A row for each clip of the AVI files in `column`: key, clip, start_s, end_s, frames, error.

    A file that can't be read, or null, has one row that says why. Keys may be null or repeated; repeated rows have
    their clips each. An empty table gives no rows. Other columns are not read.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").cast("binary").alias("media"))
    return rows.mapInArrow(_clip_rows, CLIP.format(rows.schema["key"].dataType.simpleString()))


def media_digests(docs: DataFrame) -> DataFrame:
    """What the stored media give when read back, without the media: a row for each row of `docs`.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (start and end
    of each shot in seconds), n_clips. Equal texts give equal values; a null or empty text is 64 zero bytes. A
    null doc_id stays null; an empty table gives no rows. Other columns are not read.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_summaries, SUMMARY)
