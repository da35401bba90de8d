"""Operators on single texts, sources and conversations."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import avi_media, chat_quotes, jpeg, langid_mixture, license_scan, mixing, packing


def test_media_round_trip():
    rng = np.random.default_rng(1)
    for payload in (b"\0" * 64, b"\xff" * 640, bytes(rng.integers(0, 256, 64 * 517, dtype=np.uint8)), bytes(range(256)) * 40):
        data = avi_media.write_avi(payload)
        back, clips = avi_media.clips(data)
        assert back == payload and data[:4] == b"RIFF" and int.from_bytes(data[4:8], "little") == len(data) - 8
        assert clips[0][1] == 0 and all(a[2] == b[1] for a, b in zip(clips, clips[1:])) and sum(c[3] for c in clips) == len(avi_media.read_avi(data)[0])


def test_frames_decode_as_their_coefficients_say():
    """Samples against the definition of the inverse transform."""
    payload = bytes(np.random.default_rng(2).integers(0, 256, avi_media.HELD, dtype=np.uint8))
    _, samples = avi_media.decode_frames(avi_media.encode_frames(payload))
    coefficients = np.zeros((8, 8))
    for k, b in enumerate(payload[:63], 1):
        coefficients[divmod(jpeg.ZIGZAG[k], 8)] = b if b > 127 else b - 255
    c = lambda u: np.sqrt(0.5) if u == 0 else 1
    for y, x in ((0, 0), (3, 5), (7, 7)):
        value = sum(c(u) * c(v) / 4 * coefficients[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8))
        assert abs(samples[0, 8 * y + x] - min(255, max(0, value + 128))) <= 0.5001


def test_shots():
    dark, light = np.full((10, 1024), 20, dtype=np.uint8), np.full((6, 1024), 200, dtype=np.uint8)
    of = lambda *x: avi_media.shots(avi_media.histograms(np.concatenate(x)))
    assert of(dark, light, dark) == [(0, 10), (10, 6), (16, 10)] and of(dark[:1]) == [(0, 1)] and of(dark) == [(0, 10)]


def coded(values, sampling, quantiser, interval, size, rng):
    """A JPEG image with codes of its own: symbols in a random order, 8 bits each for AC and 4 or 5 for DC."""
    height, width = size
    segment = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    dc, ac = rng.permutation(12).tolist(), [s for s in rng.permutation(256).tolist() if s & 15 <= 10][:200]
    ac += [s for s in (0, 0xF0) if s not in ac]
    ac_codes, dc_codes = {s: f"{k:08b}" for k, s in enumerate(ac)}, {s: f"{k:05b}" for k, s in enumerate(dc)}
    lengths = lambda n, at: bytes(n if k == at else 0 for k in range(1, 17))
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, b"\x01" + bytes(quantiser)) + segment(0xFE, b"a comment")
    head += segment(0xC0, struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([k + 1, h << 4 | v, 1]) for k, (h, v) in enumerate(sampling)))
    head += segment(0xC4, b"\x01" + lengths(len(dc), 5) + bytes(dc)) + segment(0xC4, b"\x12" + lengths(len(ac), 8) + bytes(ac))
    head += segment(0xDD, struct.pack(">H", interval)) if interval else b""
    head += segment(0xDA, bytes([len(sampling)]) + b"".join(bytes([k + 1, 0x12]) for k in range(len(sampling))) + b"\0\x3f\0")
    number = lambda v: "" if not v else f"{v if v > 0 else v + (1 << abs(v).bit_length()) - 1:0{abs(v).bit_length()}b}"
    units, out, bits, before, held, n = list(values), b"", "", [0] * len(sampling), 0, 0

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        raw = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        bits = ""
        return raw

    for unit in units:
        if interval and held == interval:
            out += flush() + bytes([0xFF, 0xD0 + n % 8])
            held, n, before = 0, n + 1, [0] * len(sampling)
        held += 1
        for component, blocks in enumerate(unit):
            for block in blocks:
                diff = int(block[0]) - before[component]
                before[component] = int(block[0])
                bits += dc_codes[abs(diff).bit_length()] + number(diff)
                zeros, last = 0, max([k for k in range(1, 64) if block[k]], default=0)
                for k in range(1, last + 1):
                    v = int(block[k])
                    if not v:
                        zeros += 1
                        continue
                    while zeros > 15 or (zeros << 4 | abs(v).bit_length()) not in ac_codes:
                        assert zeros > 15
                        bits, zeros = bits + ac_codes[0xF0], zeros - 16
                    bits += ac_codes[zeros << 4 | abs(v).bit_length()] + number(v)
                    zeros = 0
                if last < 63:
                    bits += ac_codes[0]
    return head + out + flush() + b"\xff\xd9"


@pytest.mark.parametrize("sampling, interval, size", [([(1, 1)], 0, (16, 24)), ([(2, 2), (1, 1), (1, 1)], 0, (19, 35)), ([(2, 1), (1, 1), (1, 1)], 3, (24, 33)), ([(1, 1)] * 3, 2, (8, 8))])
def test_jpeg_images_of_others(sampling, interval, size):
    """Own Huffman codes and quantisers, several components, restarts: planes against the transform's definition."""
    rng = np.random.default_rng(len(sampling) + interval)
    most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    down, across = -(-size[0] // (8 * most_v)), -(-size[1] // (8 * most_h))
    units = []
    for _ in range(down * across):
        unit = []
        for h, v in sampling:
            blocks = np.where(rng.random((h * v, 64)) < 0.06, rng.integers(-7, 8, (h * v, 64)), 0)
            blocks[:, 0] = rng.integers(-60, 60, h * v)
            unit.append(blocks)
        units.append(unit)
    quantiser = rng.integers(1, 9, 64).tolist()
    while True:  # codes that have all symbols that are needed
        try:
            image = coded(units, sampling, quantiser, interval, size, rng)
            break
        except AssertionError:
            continue
    planes = jpeg.decode(image)
    basis = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
    for c, (h, v) in enumerate(sampling):
        whole = np.zeros((down * v * 8, across * h * 8))
        for n, unit in enumerate(units):
            y, x = divmod(n, across)
            for k, block in enumerate(unit[c]):
                grid = np.zeros(64)
                grid[jpeg.ZIGZAG] = block * quantiser
                dy, dx = divmod(k, h)
                whole[(y * v + dy) * 8 : (y * v + dy) * 8 + 8, (x * h + dx) * 8 : (x * h + dx) * 8 + 8] = basis.T @ grid.reshape(8, 8) @ basis + 128
        rows, columns = -(-size[0] * v // most_v), -(-size[1] * h // most_h)
        assert planes[c].shape == (rows, columns)
        assert np.abs(planes[c] - np.clip(whole[:rows, :columns], 0, 255)).max() <= 0.5001
    with pytest.raises(ValueError):
        jpeg.decode(image[: len(image) * 2 // 3])
    with pytest.raises(ValueError):
        jpeg.decode(image.replace(b"\xff\xc0", b"\xff\xc2", 1))


def grey(level, rng):
    block = np.zeros((1, 64), dtype=int)
    block[0, 0] = level
    while True:
        try:
            return coded([[block], [block]], [(1, 1)], [8] * 64, 0, (8, 16), rng)
        except (AssertionError, KeyError):
            continue


def foreign_avi(frames, kind):
    """An AVI file as other writers make it: sound first, records, padding chunks, offsets from the file's start, or no index."""
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    header = lambda what, scale, rate: chunk(b"strh", what + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, scale, rate, 0, 0, 0, 0, 0, 0, 0, 0, 0))
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", struct.pack("<14I", 100_000, *[0] * 13)) + chunk(b"LIST", b"strl" + header(b"auds\0\0\0\0", 1, 8000)) + chunk(b"LIST", b"strl" + header(b"vidsMJPG", 100, 1250)))
    before, movie, index = chunk(b"JUNK", b"x" * 7), b"movi", []
    start = 12 + len(head) + len(before) + 8
    for f in frames:
        inner = b"rec " if kind == "records" else b""
        at = len(movie) + (12 if inner else 0)
        for name, body in ((b"00wb", b"sound"), (b"01dc", f)):
            index.append((name, (start if kind == "absolute" else 0) + at, len(body)))
            inner += chunk(name, body)
            at += len(chunk(name, body))
        movie += chunk(b"LIST", inner) if kind == "records" else inner
    tail = b"" if kind in ("records", "no index") else chunk(b"idx1", b"".join(struct.pack("<4sIII", n, 16, p, s) for n, p, s in index))
    return chunk(b"RIFF", b"AVI " + head + before + chunk(b"LIST", movie) + tail)


def test_avi_files_of_others(spark):
    rng = np.random.default_rng(5)
    frames = [grey(-60, rng)] * 6 + [grey(50, rng)] * 3 + [b""] * 2 + [grey(0, rng)] * 4
    expected = [(0, 0.0, 0.48, 6), (1, 0.48, 0.88, 5), (2, 0.88, 1.2, 4)]
    made = {kind: foreign_avi(frames, kind) for kind in ("relative", "absolute", "records", "no index")}
    for data in made.values():
        payload, found = avi_media.clips(data)
        assert payload == b"" and [(a, pytest.approx(b), pytest.approx(c), n) for a, b, c, n in found] == expected
    rows = [*made.items(), (None, made["relative"]), ("junk", b"RIFFxxxxWAVE"), ("none", None), ("cut", made["relative"][:400]), ("own", avi_media.write_avi(b"y" * 64 * 100)), ("own", avi_media.write_avi(b"y" * 64 * 100))]
    df = spark.createDataFrame(rows, "name string, media binary").selectExpr("name as clip", "media as error")
    got = avi_media.media_clips(df, "clip", "error").collect()
    by = Counter((r.key, r.error is None) for r in got)
    assert by[("relative", True)] == by[(None, True)] == 3 and by[("own", True)] == 4 and all(by[(k, False)] == 1 and by[(k, True)] == 0 for k in ("junk", "none", "cut"))
    assert avi_media.media_clips(df.limit(0), "clip", "error").count() == 0


def test_media_are_baseline_jpeg():
    """What is written, read by the general decoder."""
    payload = bytes(np.random.default_rng(8).integers(0, 256, 64 * 90, dtype=np.uint8))
    frames, _, length = avi_media.read_avi(avi_media.write_avi(payload))
    _, samples = avi_media.decode_frames(frames)
    assert length == len(payload)
    for image, row in zip(frames, samples):
        plane = jpeg.decode(image)[0]
        assert (plane.reshape(4, 8, 4, 8).swapaxes(1, 2).reshape(-1) == row).all()


def test_broken_media():
    data = avi_media.write_avi(b"x" * 64)
    for bad in (b"", b"RIFF" + data[4:8] + b"WAVE" + data[12:], data.replace(b"00dc", b"01wb", 1), data[:300]):
        with pytest.raises((ValueError, struct.error)):
            avi_media.clips(bad)


def test_corrupt_media_give_rows(spark):
    """A thousand files with changed, lost and cut bytes: each has rows, or one that says why; the job goes on."""
    rng = random.Random(11)
    good = [avi_media.write_avi(bytes(rng.randrange(256) for _ in range(640)))]
    changed = good[0].replace(b"\xff\xd8\xff", b"\xff\xd8\xff", 1)
    frame = good[0].index(b"\xff\xd8")
    rows = []
    for k in range(1000):
        data = bytearray(changed)
        for _ in range(rng.randint(1, 5)):
            at = rng.choice([rng.randrange(len(data)), frame + rng.randrange(min(400, len(data) - frame))])
            data[at] = rng.randrange(256)
        if k % 4 == 0:
            del data[rng.randrange(len(data)) :]
        rows.append((k, bytes(data)))
    got = avi_media.media_clips(spark.createDataFrame([*rows, (1000, good[0])], "k int, media binary"), "k", "media").collect()
    assert {r.key for r in got} == set(range(1001)) and any(r.error for r in got) and [r.error for r in got if r.key == 1000] == [None]


def test_media_digests(docs, rows, empty):
    got = avi_media.media_digests(docs).collect()
    assert len(got) == len(rows) and avi_media.media_digests(empty).count() == 0
    texts, seen = {r[0]: r[1] for r in rows}, {}
    for r in got:
        text = texts[r.doc_id] if r.doc_id is not None else None
        if r.doc_id is None:
            continue
        raw = (text or "").encode()
        payload = raw + b"\0" * (-(-max(len(raw), 1) // 64) * 64 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert seen.setdefault(payload, r.media_sha256) == r.media_sha256
    media = avi_media.text_media(docs)
    assert avi_media.clip_rows(media).count() == sum(r.n_clips for r in got)
    one = media.first()
    assert one.media[:4] == b"RIFF"


def plain_mix(rows, weights=(1, 2, 3), most=3.0):
    size = Counter()
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size.values()))
    while free:
        part = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if part[s] > most * size[s]]
        if not over:
            target |= part
            break
        for s in over:
            target[s] = most * size[s]
            left -= target[s]
            free.discard(s)
    return size, target


def test_mix(docs, rows, empty):
    size, target = plain_mix(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and mixing.mix(empty).count() == 0
    taken, biggest = Counter(), Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        biggest[r.source] = max(biggest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - target[s]) <= biggest[s] + 1e-6  # within a document of the target
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    emitted = mixing.mixed_documents(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r.copies for r in got)


def test_mix_caps_and_zeros(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string")
    rows = [(k, "w " * 10, "z") for k in range(50)] + [(100, "only one", "a"), (101, None, "b"), (102, "", "b")]
    size, target = plain_mix([(r[0], r[1], None, r[2]) for r in rows])
    assert {r.source: r.target for r in mixing.mix(make(rows)).collect()} == pytest.approx(target) and target["a"] == 6 and target["b"] == 0
    assert [r.taken for r in mixing.mix(make([(1, None, None), (2, "", "x")])).collect()] == [0, 0]


LICENSES = {
    0: "Some code.\nReleased under the MIT License.\nMore words.",
    1: "# licensed under the APACHE License, Version 2.0 (the \"License\"); you may not use this file\nexcept in compliance with the License. Other things follow",
    2: "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and limitations under the License.",
    3: "Licensed under CC BY-NC 4.0.",
    4: "license license license",
    5: None,
    6: "",
    7: "All rights reserved.\nNothing.\nNothing.\nNothing.\nThis program is free software; you can redistribute it",
    9: "ALL  RIGHTS\nreserved.",
    8: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nA line between.\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
}


def test_licenses(spark, empty):
    df = spark.createDataFrame([(k, t, "x") for k, t in LICENSES.items()], "doc_id long, text string, words string")
    found = defaultdict(set)
    for r in license_scan.licenses(df).collect():
        found[r.doc_id].add((r.license, r.rule, r.n_sentences))
    assert found[0] == {("MIT", "mit-reference", 1)} and found[3] == {("CC-BY-NC-4.0", "cc-by-nc-4.0-reference", 1)} and found[7] == {("Proprietary", "all-rights-reserved", 1)}
    assert found[1] == {("Apache-2.0", "apache-2-header-short", 2)}  # a sentence over two lines
    assert found[8] == {("BSD-2-Clause", "bsd-2-conditions", 3)} and not found[4] and not found[5] and not found[6]
    assert found[2] == {("Apache-2.0", "apache-2-header", 5)} and found[9] == found[7]
    assert license_scan.licenses(empty).count() == 0 and license_scan.licenses(df.union(df)).count() == sum(map(len, found.values()))


WRAPPED = {
    0: "// SPDX-License-Identifier: MIT\nint x;",
    1: "# SPDX-License-Identifier: Apache-2.0\n",
    2: "/* SPDX-License-Identifier: GPL-3.0-or-later */\n",
    3: " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n * This program is distributed in the hope that it will be useful,\n * but WITHOUT ANY WARRANTY; without even the implied warranty of\n * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n * GNU General Public License for more details.\n",
    4: "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.\n",
    5: "MIT License\n\nCopyright (c) 2020 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE.\n",
    6: "Copyright 2020 Some One\n\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.\n",
    7: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
}


BSD = (
    "Copyright (c) 2020, Some One\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n"
    "   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n%sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"\n"
    "AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE\n"
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL\nDAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR\nSERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER\n"
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,\nOR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE\nOF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.\n"
)
WRAPPED |= {
    8: BSD % "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\n",
    9: BSD % "",
    10: "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n",
    11: "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU\nLesser General Public License for more details.\n",
    12: "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    13: "long " * 40_000 + "\n\nReleased under the MIT License.\n" + "words. " * 20_000,
    14: WRAPPED[5] + "\nSPDX-License-Identifier: Apache-2.0\n",
}


def test_canonical_licenses(spark):
    df = spark.createDataFrame(list(WRAPPED.items()), "doc_id long, text string")
    found = sorted((r.doc_id, r.rule, r.n_sentences) for r in license_scan.licenses(df).collect())
    assert found == [
        (0, "mit-spdx", 1), (1, "apache-2.0-spdx", 1), (2, "gpl-3.0-or-later-spdx", 1), (3, "gpl-3.0-or-later-notice", 3), (4, "mpl-2-header", 2), (5, "mit-text", 4), (6, "apache-2-header", 5), (7, "gpl-3.0-or-later-grant", 1),
        (8, "all-rights-reserved", 1), (8, "bsd-3-text", 6), (9, "all-rights-reserved", 1), (9, "bsd-2-text", 5), (10, "isc-grant", 1), (11, "lgpl-2.1-or-later-notice", 3), (12, "cc-by-sa-4.0-reference", 1), (13, "mit-reference", 1),
        (14, "apache-2.0-spdx", 1), (14, "mit-text", 4),
    ]


def test_license_query_and_its_sql(spark, tmp_path):
    """The SQL has no filter before it: canonical, wrapped and odd texts, repeated rows and ties."""
    import duckdb

    near = [WRAPPED[3].replace("program", "package"), WRAPPED[6].replace("obtain", "get"), BSD.replace("CONTRIBUTORS", "REGENTS") % "", WRAPPED[5].replace("Software", "Module", 1)]
    texts = list(LICENSES.values()) + list(WRAPPED.values()) + list(OPENINGS.values()) + near + ["Released under the MIT License. Released under the MIT License", "a\n\n\nLicensed under the Apache License, Version 2.0. b", "LICENSED UNDER CC-BY 4.0\n\n-- \n\nreleased under the bsd license"]
    spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    told = con.execute(license_scan.ORACLE)
    names = [d[0] for d in told.description]
    got = sorted(tuple(r[n] for n in names) for r in license_scan.licenses(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect())
    assert got == sorted(told.fetchall()) and len(got) > 35


OPENINGS = {
    "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n\n      \"License\" shall mean the terms and conditions for use, reproduction,\n      and distribution as defined by Sections 1 through 9 of this document.\n",
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n",
    "PSF-2.0": "1. This LICENSE AGREEMENT is between the Python Software Foundation\n(\"PSF\"), and the Individual or Organization (\"Licensee\") accessing and\notherwise using this software (\"Python\") in source or binary form and\nits associated documentation.\n",
    "CC-BY-4.0": "By exercising the Licensed Rights (defined below), You accept and agree to be\nbound by the terms and conditions of this Creative Commons Attribution 4.0\nInternational Public License (\"Public License\"). To the extent",
    "NCSA": WRAPPED[5].replace("deal\nin the", "deal with\nthe").split("The above")[0],
    "MIT": WRAPPED[5].replace("to any person obtaining", "to any entity obtaining").split("The above")[0],
}


def test_openings_of_license_texts(spark):
    df = spark.createDataFrame(list(enumerate(OPENINGS.values())), "doc_id long, text string")
    found = {(r.doc_id, r.license) for r in license_scan.licenses(df).collect()}
    assert found == set(enumerate(OPENINGS))


def near_sentences(text, sentences):
    """A plain version: each run of three parts of each cutting against each known sentence."""
    end, found = r"[.!?:;]+[\x20\x09-\x0D]+", set()
    marked = re.sub(end, "\x01", text)
    cuttings = [re.split("[\x01\n]", marked), marked.split("\x01"), re.split("\x01|\n[^A-Za-z0-9\x01\n]*\n", marked)]
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    sentences = [(name, known, known.split(), shingles(known.split())) for name, known in sentences]
    for c, cutting in enumerate(cuttings, 1):
        parts = [re.sub("[^a-z0-9]+", " ", x.lower()).strip() for x in cutting]
        for i in range(len(parts)):
            for j in range(i, min(i + 3, len(parts))):
                if not parts[i] or not parts[j]:
                    continue
                words, best = " ".join(x for x in parts[i : j + 1] if x), None
                a, of = words.split(), shingles(words.split())
                for name, known, b, there in sentences:
                    if words == known:
                        best = (-2.0, "", name)
                    elif of and there and 80 * len(b) <= 100 * len(a) <= 125 * len(b) and [x for x in a if re.search("[0-9]", x)] == [x for x in b if re.search("[0-9]", x)]:
                        both, either = len(of & there), len(of | there)
                        if 100 * both >= 80 * either:
                            best = min(best or (0, "", ""), (-both / either, known, name))
                if best:
                    found.add((c, i, j, best[2], -best[0]))
    return found


def test_near_sentences_against_a_plain_version(spark, empty):
    """Words changed, dropped, repeated and moved, at every rate around the threshold."""
    rng = random.Random(31)
    texts = ["", "license", "license " * 3000]
    for _ in range(150):
        w = rng.choice(license_scan.TEXTS)[1].split()
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([["other"], [], [w[k], w[k]], ["7"], [w[k] + ".\n"], w[k : k + 1]])
        texts.append("Before. " + " ".join(w) + rng.choice([". ", "\n\n", " ", "; "]) + "after it")
    df = spark.createDataFrame([*enumerate(texts), (None, None), (3, texts[3])], "doc_id long, text string")
    got, told = defaultdict(set), {k: near_sentences(t, license_scan.SENTENCES) for k, t in enumerate(texts)}
    for r in license_scan.sentence_ids(df).collect():
        got[r.doc_id].add((r.cutting, r["at"], r.last, r.sentence, r.score))
    assert got == {k: v for k, v in told.items() if v}
    scores = [s for v in told.values() for *_, s in v]
    assert sum(s < 2 for s in scores) > 80 and min(scores) < 0.82
    assert license_scan.sentence_ids(empty).count() == 0
    exact = license_scan.sentence_ids(df, near=None).collect()
    assert {(r.doc_id, r.cutting, r["at"], r.last, r.sentence) for r in exact} == {(k, *x[:4]) for k, v in told.items() for x in v if x[4] == 2}


def test_runs_without_a_hint_are_not_made(spark):
    """One sentence among thousands: the rows that arrays give are those around it, not all that the text could be cut into."""
    texts = ["Plain words here.\n" * 3000 + "Released under the MIT License.\n" + "Plain words here.\n" * 3000, "Plain words here.\n" * 3000]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = license_scan.sentence_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        assert {(r.cutting, r["at"], r.last, r.sentence) for r in found.collect()} == {(c, 3000, 3000, "mit-reference") for c in (1, 2, 3)}
        made, plans = 0, [found._jdf.queryExecution().executedPlan()]
        while plans:
            plan = plans.pop()
            plans += [plan.children().apply(k) for k in range(plan.children().size())]
            made += plan.metrics().apply("numOutputRows").value() if plan.nodeName() == "Generate" else 0
        assert 0 < made < 200
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_near_sentences_keep_their_numbers_and_places(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version %s of the License, or (at your option) any later version."
    texts = [gpl % 2, gpl % 4, (gpl % 3).replace("program", "package"), "All rights reserved. " + OPENINGS["MIT"]]
    found = {(r.doc_id, r.rule, r.place) for r in license_scan.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {(0, "gpl-2.0-or-later-grant", 0), (2, "gpl-3.0-or-later-grant", 0), (3, "all-rights-reserved", 0), (3, "mit-grant", 3)}


def test_sentences_of_many_parts(spark):
    """A sentence given with its marks may be cut into as many parts as these make."""
    whole = "Take it; share it; keep it; but never: ever: sell it."
    df = spark.createDataFrame([(1, "Head. " + whole + " Tail."), (2, "take it share it keep it but never ever sell it")], "doc_id long, text string")
    found = license_scan.licenses(df, sentences=[("all", whole)], rules=[("all", "OWN", ["all"])]).collect()
    assert license_scan.span_of([("all", whole)]) == 6 and sorted((r.doc_id, r.rule, r.place) for r in found) == [(1, "all", 1), (2, "all", 0)]


def test_license_tables():
    names = {n for n, _ in license_scan.SENTENCES}
    assert all(set(ids) <= names for _, _, ids in license_scan.RULES) and len({w for _, w in license_scan.SENTENCES}) == len(license_scan.SENTENCES)
    pattern = re.compile(license_scan.hints(license_scan.SENTENCES))
    assert all(license_scan.spelled(w) == w and pattern.search(w) for _, w in license_scan.SENTENCES)
    assert len({r[0] for r in license_scan.RULES}) == len({tuple(r[2]) for r in license_scan.RULES}) == len(license_scan.RULES)


def test_own_license_tables(spark):
    df = spark.createDataFrame([(1, "You may eat this. Share it, please!"), (2, "Released under the MIT License.")], "doc_id long, text string")
    found = license_scan.licenses(df, sentences=[("eat", "you may eat this"), ("share", "share it please")], rules=[("both", "FOOD", ["eat", "share"])]).collect()
    assert [tuple(r) for r in found] == [(1, "FOOD", "both", 0, 2)]


def test_mixture():
    counts = {"aa": np.zeros(langid_mixture.BUCKETS), "bb": np.zeros(langid_mixture.BUCKETS)}
    texts = {"aa": "lorem ipsum dolor sit amet consectetur " * 20, "bb": "zwölf boxkämpfer jagen viktor quer über den sylter deich " * 20}
    for k, t in texts.items():
        counts[k] += np.bincount(langid_mixture.trigrams(t), minlength=langid_mixture.BUCKETS)
    m = langid_mixture.Model(counts)
    assert m.proportions(*langid_mixture.counted(texts["aa"])).tolist() == [1, 0, 0]
    both = m.proportions(*langid_mixture.counted(texts["aa"] + texts["bb"]))
    share = len(texts["bb"]) / (len(texts["aa"]) + len(texts["bb"]))
    assert both[1] == pytest.approx(share, abs=0.1)


def plain_mixture(p, found, counts, penalty=1.0):
    """The set that the penalised likelihood prefers, every candidate tried."""

    def fit(columns):
        w = np.full(len(columns), 1 / len(columns))
        for _ in range(200):
            joint = p[found][:, columns] * w
            new = ((counts / joint.sum(axis=1))[:, None] * joint).sum(axis=0) / counts.sum()
            done, w = np.abs(new - w).max() < 1e-3, new
            if done:
                break
        return w, float((counts * np.log(p[found][:, columns] @ w)).sum())

    k = p.shape[1]
    first = max(range(k - 1), key=lambda j: float((counts * np.log(p[found][:, j])).sum()))
    chosen, (w, best) = [first], (np.ones(1), float((counts * np.log(p[found][:, first])).sum()))
    for j in np.argsort(-fit(list(range(k)))[0], kind="stable"):
        if j != first:
            tried, value = fit([*chosen, int(j)])
            if value - best > penalty * np.log(counts.sum() + 1):
                chosen, w, best = [*chosen, int(j)], tried, value
    out = np.zeros(k)
    out[chosen] = w
    return out


def test_mixture_against_all_trials():
    rng = np.random.default_rng(6)
    counts = {x: np.zeros(langid_mixture.BUCKETS) for x in "abcdef"}
    for x in counts:
        np.add.at(counts[x], rng.zipf(1.3, 4000) * (ord(x) - 90) % langid_mixture.BUCKETS, 1)
    m = langid_mixture.Model(counts)
    several = 0
    for _ in range(60):
        parts = rng.choice(7, rng.integers(1, 4), replace=False)
        drawn = np.concatenate([rng.choice(langid_mixture.BUCKETS, rng.integers(1, 400), p=m.p[:, k] / m.p[:, k].sum()) for k in parts])
        found, n = np.unique(drawn, return_counts=True)
        got, expected = m.proportions(found, n.astype(float)), plain_mixture(m.p, found, n.astype(float))
        assert got == pytest.approx(expected, abs=1e-9)
        several += np.count_nonzero(got) > 1
    assert several > 10


def test_languages(spark, docs, rows, empty):
    path = "/root/testdata/sf0.001/documents.parquet"
    labelled = spark.read.parquet(path)
    got = {r.doc_id: r for r in langid_mixture.identify(labelled).collect()}
    truth = {r.doc_id: r.lang for r in labelled.collect()}
    out = [k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sorted(out) == sorted(k for k in got if got[k].held_out)
    assert np.mean([got[k].lang_pred == truth[k] for k in out]) > 0.9 and all(0 <= r.score <= 1 for r in got.values())
    odd = langid_mixture.identify(docs, labelled).collect()
    assert len(odd) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in odd:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
    assert langid_mixture.identify(empty).count() == 0
    assert all(r.lang_pred == "und" for r in langid_mixture.identify(docs, empty).collect())


def test_known_languages(spark, docs, rows, empty):
    """Documents of the languages stay; other scripts and junk leave, unless they are too short to tell."""
    labelled = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = np.random.default_rng(3)
    junk = ["".join(rng.choice(list("qxzjkwvbQXZ#$%&*0123456789+/=~^|"), 900)) + "x", "Привет мир это текст на другом языке " * 20, "あいうえおかきくけこさしすせそ" * 30]
    made = labelled.unionByName(spark.createDataFrame([(10**6 + k, t, None, "z", len(t or "")) for k, t in enumerate([*junk, "zq", None, "", "12 34"])], labelled.schema))
    kept = langid_mixture.in_known_language(made)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == made.columns and not ids & {10**6 + k for k in (0, 1, 2, 4, 5, 6)} and 10**6 + 3 in ids
    of = {r.doc_id: r.text for r in labelled.collect()}
    left = {k for k in of if k not in ids}
    assert all(not re.search(r"[a-zà-ÿ]{3,} [a-zà-ÿ]{2,} [a-zà-ÿ]{2,}", of[k] or "", re.I) for k in left)
    told = {r.doc_id: r.mixture for r in langid_mixture.identify(made).collect()}
    size = {r.doc_id: len(langid_mixture.trigrams(r.text or "")) for r in made.collect()}
    assert all((k in ids) == (bool(told[k]) and (size[k] < 40 or 1 - told[k].get("und", 0) >= 0.5)) for k in told)
    assert langid_mixture.in_known_language(empty).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = langid_mixture.in_known_language(unlabelled)
    assert kept.columns == docs.columns and kept.count() == sum(any(c.isalpha() for c in r[1] or "") for r in rows)


def test_plan_is_whole_and_tight():
    rng = np.random.default_rng(3)
    for lengths in ([], [2048] * 5, [1] * 5000, [1025] * 9, [700, 700, 648] * 50, np.clip(rng.lognormal(6.3, 1, 20_000), 1, 2048).astype(int).tolist()):
        histogram = Counter(lengths)
        runs = packing.plan(histogram)
        held = Counter()
        for content, n in runs:
            assert sum(a * b for a, b in content) <= 2048
            for a, b in content:
                held[a] += b * n
        assert held == histogram
        bins, least = sum(n for _, n in runs), -(-sum(lengths) // 2048)
        assert bins <= least * 1.01 + 1 or lengths[:1] == [1025]


def test_pack_documents(docs, rows, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    expected = Counter()
    for r in rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        n = len(ids)
        ends = list(range(n % 2048 or 2048, n + 1, 2048)) if n > 2048 else [n]
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            expected[(r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    got = packing.pack_documents(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty).count() == 0


def test_word_cache_gives_the_tokenizers_ids():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    e = packing.Encoder("byte_bpe_50k", room=4000)
    texts = ["", " ", "a", " a", "a ", "a  b", "a\n\nb", "a \nb", "a\n b", "a\tb", "it's don't  x", "<|endoftext|> is text", "é 中 文 x", "x y z " * 30 + "end", "one two three\nfour five. six", "\n", "a\x1cb c", "Ａ１ ²"]
    plain = Tokenizer.from_file(path("byte_bpe_50k.json"))  # as the file has it, added tokens included
    ids = [np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert e.encode(texts) == ids and e.encode(texts[::-1]) == ids[::-1]
    assert plain.encode("one <|endoftext|> two", add_special_tokens=False).ids == [505, 220, 50256, 734] == np.frombuffer(e.encode(["one <|endoftext|> two"])[0], dtype="<u4").tolist()
    for k in range(200):  # what is kept stays bounded
        e.encode([" ".join(f"word{k}x{i}" for i in range(40))])
        assert e.held < 4000 + 41 * 400


def test_quotes():
    text = "Hi,\n\nOn Monday Bob wrote:\n> I said\n>> you said\n> again\n\nmine"
    content, said, quoted = chat_quotes.parse(text)
    assert content == "Hi,\n\n\nmine" and [(d, k) for d, k, _ in quoted] == [(1, 0), (2, 1), (1, 2)]
    assert chat_quotes.parse(None) == ("", [], []) and chat_quotes.parse("plain\ntext ")[0] == "plain\ntext "


def test_threads(spark):
    fine = "I am fine, and so are the others here."
    rows = [
        (1, 0, "user", "Hello there.\nHow are you today?"), (1, 1, "assistant", f"On Monday, Bob wrote:\n> hello  there.\n> How are you today?\n\n{fine}\nThanks a lot"),
        (1, 2, "user", f">> How are you today?\n> {fine}\n\nGreat!"), (2, 0, "user", f"> {fine}\nwhat?"), (3, 0, "user", None), (3, 1, "a", ""), (3, 1, "a", ""), (None, None, None, "x"), (4, 0, "user", "> nobody said this\nyes"),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, unit string, position int")
    got = {(r.conv_id, r.turn, r.position): r for r in chat_quotes.reply_ordered(df).collect()}
    assert len(got) == len(rows)
    assert [got[(1, k, k)].reply_turn for k in range(3)] == [None, 0, 1] and got[(1, 1, 1)].content == f"{fine}\nThanks a lot"
    other = got[(2, 0, 3)]
    assert (other.conversation, other.reply_conv_id, other.reply_turn, other.content) == (1, 1, 1, "what?")
    assert got[(3, 0, 0)].content is None and got[(4, 0, 0)].reply_turn is None and got[(4, 0, 0)].n_quotes == 1
    levels = {(r.conv_id, r.turn, r.depth): (r.of_conv_id, r.of_turn) for r in chat_quotes.quote_links(chat_quotes.messages(df)).collect()}
    assert levels[(1, 2, 2)] == (1, 0) and levels[(1, 2, 1)] == (1, 1)
    assert chat_quotes.reply_ordered(df.limit(0)).count() == 0
    ordered = chat_quotes.reply_ordered(df)
    assert {r.conversation: len(r.messages) for r in chat_quotes.threads(ordered).collect()}[1] == 4
    assert sorted((r.part, len(r.messages)) for r in chat_quotes.threads(ordered, 3).collect() if r.conversation == 1) == [(0, 3), (1, 1)]


def plain_origins(rows):
    """(conversation, turn, level, passage) to (conversation, turn, hashes) of its origin, by all pairs."""
    parsed = {r[:2]: chat_quotes.parse(r[3]) for r in rows}
    expected = {}
    for at, (_, _, quoted) in parsed.items():
        for depth, k, wanted in quoted:
            votes = []
            for o, (_, said, _) in parsed.items():
                n = len({u for u in set(said) & set(wanted) if o[0] == at[0] or u[:1] == chat_quotes.LONG})
                if n and (o[0] != at[0] or o[1] < at[1]):
                    votes.append((o[0] == at[0], n, -o[0], -o[1]))
            if votes:
                _, n, c, t = max(votes)
                expected[(*at, depth, k)] = (-c, -t, n)
    return expected


def test_origins_are_those_that_share_most(spark):
    """Greetings and copies in many messages, against counts over all pairs."""
    import random

    rng = random.Random(8)
    polite = ["Thanks.", "Best regards from all of us here", "See you", "Hello to everybody in the whole team"]
    rows = [(1, 0, "a", "Thanks.\nBest regards from all of us here\nSee you"), (2, 0, "b", "Thanks.\nBest regards from all of us here\nBring the long report along"), (3, 0, "c", "> Thanks.\n> Best regards from all of us here\n> Bring the long report along\nDone")]
    rows += [(4, 0, "a", "Only here is this long line\nHello"), (4, 1, "b", "> Only here is this long line\n> Hello\nyes"), (5, 0, "c", "Only here is this long line\nHello"), (6, 0, "d", "> Only here is this long line\nagain"), (7, 0, "a", "> Hello\n> See you\nshort")]
    line = lambda: f"line {rng.randint(0, 30)}" + " with more words after it" * rng.randint(0, 1)
    for c in range(10, 60):
        for t in range(3):
            own = rng.sample(polite, rng.randint(0, 3)) + [line() for _ in range(rng.randint(0, 2))]
            quote = rng.sample(polite, rng.randint(1, 3)) + [line() for _ in range(rng.randint(0, 2))]
            rows.append((c, t, "x", "\n".join([f"> {x}" for x in quote] * (t > 0) + own)))
    expected = plain_origins(rows)
    messages = chat_quotes.messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert expected[(3, 0, 1, 0)][:2] == (2, 0) and (7, 0, 1, 0) not in expected
    for frequent in (chat_quotes.FREQUENT, 0, 1000):
        assert {tuple(r[:4]): tuple(r[4:]) for r in chat_quotes.quote_links(messages, frequent).collect()} == expected


def plain_ordered(rows):
    """(conversation, position, conv_id, turn, reply_conv_id, reply_turn) of messages whose links make no circle."""
    origins = plain_origins(rows)
    links = {(k[:2], v[:2]) for k, v in origins.items() if k[0] != v[0]}
    root = {r[0]: r[0] for r in rows}
    for _ in rows:
        for (a, _), (b, _) in links:
            root[a] = root[b] = min(root[a], root[b])

    def level(at):
        return max([level(of) + 1 for by, of in links if by[0] == at[0] and by[1] <= at[1]], default=0)

    turns = {c: sorted(r[1] for r in rows if r[0] == c) for c in root}
    place = {}
    for r in set(root.values()):
        for k, at in enumerate(sorted((x[:2] for x in rows if root[x[0]] == r), key=lambda at: (level(at), *at))):
            place[at] = (r, k)
    out = []
    for c, t in place:
        quoted = min((k[2:], v[:2]) for k, v in origins.items() if k[:2] == (c, t))[1] if any(k[:2] == (c, t) for k in origins) else None
        before = turns[c].index(t) - 1
        out.append((*place[(c, t)], c, t, *(quoted or ((c, turns[c][before]) if before >= 0 else (None, None)))))
    return sorted(out, key=str)


def test_reply_order_against_a_plain_version(spark):
    import random

    rng = random.Random(4)
    rows, said, turn = [], [], Counter()
    ids = rng.sample(range(100, 999), 25)
    for k in range(110):  # in order of time, which ids don't follow
        c = rng.choice(ids)
        own = f"message {k} says this and nothing else of note"
        quote = [rng.choice(said)] if said and rng.random() < 0.35 else []
        rows.append((c, turn[c], rng.choice("ab"), "\n".join([*(f"> {q}" for q in quote), own, "ok"])))
        said.append(own)
        turn[c] += 1
    rows += [(50, 0, "a", "> ok\nnot linked"), (51, 0, "b", "> ok\nneither"), (52, 0, "c", "ok"), (60, 0, "a", "> the question that 70 asks here\nthe reply"), (70, 0, "b", "the question that 70 asks here")]
    got = chat_quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted([(r.conversation, r.position, r.conv_id, r.turn, r.reply_conv_id, r.reply_turn) for r in got], key=str) == plain_ordered(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert [by[(c, 0)].conversation for c in (50, 51, 52)] == [50, 51, 52] and (by[(70, 0)].position, by[(60, 0)].position) == (0, 1)


def test_very_long_messages(spark):
    text = "\n".join(f"this is line number {k} of a long message" for k in range(20_000))
    rows = [(1, 0, "a", text), (2, 0, "b", "\n".join(f"> {x}" for x in text.split("\n")[5_000:15_000]) + "\nyes"), (2, 1, "b", "x" * 300_000)]
    got = {(r.conv_id, r.turn): r for r in chat_quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[(2, 0)].reply_conv_id, got[(2, 0)].position, got[(2, 0)].content, len(got[(2, 1)].content)) == (1, 1, "yes", 300_000)


def test_replies_follow_across_conversations(spark):
    long = lambda x: f"{x} is what this line says here"
    rows = [
        (3, 0, "a", "first of three"), (3, 1, "b", f"> {long('second of nine')}\n{long('answer to nine')}"), (3, 2, "a", long("last of three")), (9, 0, "c", "first of nine"), (9, 1, "d", long("second of nine")), (9, 2, "d", f"> {long('last of three')}\nend of nine"),
        (1, 0, "e", f"> {long('answer to nine')}\nalso"), (20, 0, "a", f"> {long('said in 30')}\nsaid in 20"), (20, 1, "b", long("x of 20")), (30, 0, "c", f"> {long('x of 20')}\n{long('said in 30')}"), (10, 0, "f", f"> {long('said in 30')}\nbeyond"), (40, 0, "a", "alone"), (40, 1, "b", "more"),
    ]
    got = chat_quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    order = [(r.conv_id, r.turn) for r in sorted(got, key=lambda r: r.position) if r.conversation == 1]
    assert order == [(3, 0), (9, 0), (9, 1), (3, 1), (3, 2), (1, 0), (9, 2)]
    by = {(r.conv_id, r.turn): r for r in got}
    assert len(got) == len(rows) and (by[(9, 2)].reply_conv_id, by[(9, 2)].reply_turn) == (3, 2) and (by[(3, 2)].reply_conv_id, by[(3, 2)].reply_turn) == (3, 1)
    # 20 and 30 quote each other: the link to the later one doesn't count
    round_ = [(r.conv_id, r.turn) for r in sorted(got, key=lambda r: r.position) if r.conversation == 10]
    assert round_ == [(20, 0), (20, 1), (30, 0), (10, 0)] and [by[(40, k)].position for k in (0, 1)] == [0, 1] and by[(40, 1)].reply_turn == 0
    assert sorted(r.position for r in got if r.conversation == 1) == list(range(7))
