"""Bundles, archives, MATLAB files, PNG images, the ledger and logged remote calls."""

import io
import os
import random
import struct
import threading
import time
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.errors import RefusedInput
from tabulon.operators import gates, remote, scoring, suppression
from tabulon.plans import catalogue
from tabulon.sources import bundle, mat, png, store, zip_index


@pytest.fixture
def bundles(spark):
    spark.dataSource.register(bundle.FileBundle)
    return lambda rows, path, kind="string": spark.createDataFrame(rows, f"name string, content {kind}").repartition(3).write.format("file_bundle").mode("append").save(path)


def listed(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, files in os.walk(folder) for f in files)


def test_bundle(bundles, tmp_path):
    path = str(tmp_path / "a/report")
    bundles([("metrics.json", "{}"), ("tables/x.csv", "é\n"), ("empty", None)], path)
    assert listed(tmp_path) == ["a/report/empty", "a/report/metrics.json", "a/report/tables/x.csv"]
    assert (tmp_path / "a/report/tables/x.csv").read_text() == "é\n"
    with pytest.raises(Exception, match="isn't empty"):
        bundles([("other", "")], path)
    assert len(listed(tmp_path)) == 3


@pytest.mark.parametrize("bad", ["../out", "/abs", "c:x", "a\\b", "", ".", None])
def test_failed_bundle_leaves_nothing(bundles, tmp_path, bad):
    with pytest.raises(Exception):
        bundles([(f"f{k}", "x") for k in range(20)] + [(bad, "x")], str(tmp_path / "r"))
    assert listed(tmp_path) == [] and not (tmp_path / "r").exists()


def test_names_that_come_twice(bundles, tmp_path):
    with pytest.raises(Exception, match="two files"):
        bundles([("f", str(k)) for k in range(9)], str(tmp_path / "r"))
    assert listed(tmp_path) == []


# ---------------------------------------------------------------- archives


def archive(names, comment=b"", folders=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in folders:
            z.writestr(zipfile.ZipInfo(f), b"")
        for k, n in enumerate(names):
            info = zipfile.ZipInfo(n)
            info.comment = b"PK\x01\x02 a comment with a member's mark" if k % 5 == 0 else b""
            z.writestr(info, n.encode() * (k % 7))
        z.comment = comment
    return out.getvalue()


def test_archive_members(spark, bundles, tmp_path):
    names = [f"d{k % 9}/PK\x01\x02file{k}.txt" for k in range(300)]
    bundles([("a.zip", archive(names, b"PK\x05\x06 in a comment", ["d1/", "d2/"])), ("b.zip", archive([])), ("c.zip", b"junk"), ("d.zip", archive(["x", "X", "y"])), ("e.zip", archive(["ok", "../up"]))], str(tmp_path / "z"), "binary")
    paths = spark.createDataFrame([(f"{tmp_path}/z/{n}.zip", n) for n in "abcdef"], "path string, part string")
    told = {}
    for parts in (1, 7, 64):
        got = zip_index.archive_members(paths, "path", parts)
        assert got.columns == ["path", "part", "name", "expected_bytes", "expected_crc32", "error"]
        told[parts] = got.collect()
        own = sorted((r.name, r.expected_bytes, r.expected_crc32) for r in told[parts] if r.part == "a")
        assert own == sorted((n, len(n) * (k % 7), zlib.crc32(n.encode() * (k % 7))) for k, n in enumerate(names)), parts
        assert {r.error is None for r in told[parts] if r.part == "a"} == {True} and not [r for r in told[parts] if r.part == "b"]
        assert {(r.name, r.error is None) for r in told[parts] if r.part == "d"} == {("x", False), ("X", False), ("y", True)}
        for broken in "cef":
            assert [r for r in told[parts] if r.part == broken and r.error]
    spark.dataSource.register(zip_index.ZipIndex)
    assert spark.read.format("zip_index").option("paths", f"{tmp_path}/z/a.zip").load().count() == 300


# ---------------------------------------------------------------- MATLAB files


def element(kind, content, small=False):
    if small:
        return struct.pack("<HH", kind, len(content)) + content.ljust(4, b"\0")
    return struct.pack("<II", kind, len(content)) + content + b"\0" * (-len(content) % 8)


def matrix(kind, shape, body, name=b""):
    return element(14, element(6, struct.pack("<II", kind, 0)) + element(5, struct.pack(f"<{len(shape)}i", *shape)) + element(1, name, 0 < len(name) <= 4) + body)


def letters(text):
    return matrix(4, (1, len(text)) if text else (0, 0), element(17, text.encode("utf-16-le")) if text else element(17, b""))


def mat_file(*elements):
    return b"MATLAB 5.0 MAT-file".ljust(124, b" ") + b"\0\1IM" + b"".join(elements)


def test_mat_lookups(spark, bundles, tmp_path):
    """The three lookups: names in a cell column and a cell row, and a table of files with colours; plain and deflated."""
    makes = matrix(1, (3, 1), b"".join(map(letters, ["ABT", "", "Bézier "])), b"make_names")
    types = matrix(1, (1, 2), letters("MPV") + letters("SUV"), b"typ")
    colours = matrix(1, (2, 2), letters("1/a.jpg") + letters("2/b.jpg") + matrix(6, (1, 1), element(9, struct.pack("<d", 3))) + matrix(6, (1, 1), element(1, struct.pack("<b", -1), True)), b"color_list")
    numbers = matrix(6, (2, 3), element(4, struct.pack("<6H", *range(6))), b"n")
    bundles([("a.mat", mat_file(makes, element(15, zlib.compress(types))[: 8 + len(zlib.compress(types))], numbers)), ("b.mat", mat_file(element(15, zlib.compress(colours))[: 8 + len(zlib.compress(colours))]))], str(tmp_path / "m"), "binary")
    spark.dataSource.register(mat.MatFile)
    found = spark.read.format("mat_file").option("paths", f"{tmp_path}/m/a.mat,{tmp_path}/m/b.mat").load()
    assert found.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, mat.names(found, "make_names").collect())) == [(1, "ABT"), (3, "Bézier")]
    assert sorted(map(tuple, mat.names(found, "typ").collect())) == [(1, "MPV"), (2, "SUV")]
    assert sorted(map(tuple, mat.table(found, "color_list", ["relative_key", "color_id"]).collect())) == [(1, "1/a.jpg", "3"), (2, "2/b.jpg", "-1")]
    assert sorted((tuple(r.place), r.number) for r in found.filter("variable = 'n'").collect()) == [((r + 1, c + 1), float(2 * c + r)) for r in range(2) for c in range(3)]


def test_broken_mat_files():
    good = mat_file(matrix(6, (2, 1), element(9, struct.pack("<2d", 1, 2)), b"x"))
    assert len(list(mat.variables(good))) == 2
    rng = random.Random(3)
    for _ in range(2000):
        data = bytearray(good)
        for _ in range(rng.randint(1, 4)):
            data[rng.randrange(124, len(data))] = rng.randrange(256)
        try:
            list(mat.variables(bytes(data[: rng.randint(100, len(data))])))
        except (RefusedInput, UnicodeDecodeError, ValueError, MemoryError):
            pass


# ---------------------------------------------------------------- images


def paeth(a, b, c):
    p = a + b - c
    return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]


def filtered(lines, step, kinds):
    """Scanlines with their filters, written out from the format's text."""
    out, above = b"", bytes(len(lines[0]))
    for line, kind in zip(lines, kinds):
        row = bytearray()
        for i, x in enumerate(line):
            a, b, c = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            row.append((x - (0, a, b, (a + b) // 2, paeth(a, b, c))[kind]) % 256)
        out, above = out + bytes([kind]) + bytes(row), line
    return out


def image(width, height, depth, colour, raw, woven=0, palette=None):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    packed = zlib.compress(raw)
    return png.MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, woven)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", packed[:9]) + chunk(b"IDAT", packed[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour", [0, 2, 4, 6])
@pytest.mark.parametrize("depth", [8, 16])
def test_png_filters(colour, depth):
    rng = np.random.default_rng(colour * 20 + depth)
    samples, size = {0: 1, 2: 3, 4: 2, 6: 4}[colour], depth // 8
    pixels = rng.integers(0, 256, (11, 7, samples, size), dtype=np.uint8)
    lines = [row.tobytes() for row in pixels]
    for kinds in [[k] * 11 for k in range(5)] + [[k % 5 for k in range(11)]]:
        got = png.decode(image(7, 11, depth, colour, filtered(lines, samples * size, kinds)))
        want = pixels[..., 0]
        assert (got == (want[..., :3] if samples > 2 else np.repeat(want[..., :1], 3, axis=2))).all()


def test_png_bits_palettes_and_passes():
    bits = np.random.default_rng(1).integers(0, 2, (5, 11))
    assert (png.decode(image(11, 5, 1, 0, filtered([np.packbits(r).tobytes() for r in bits], 1, [0, 1, 2, 3, 4])))[..., 1] == bits * 255).all()
    palette = bytes(range(12))
    raw = filtered([bytes([0b00011011])] * 2, 1, [0, 2])
    assert png.decode(image(4, 2, 2, 3, raw, palette=palette))[1].tolist() == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11]]
    pixels = np.random.default_rng(2).integers(0, 256, (9, 10, 3), dtype=np.uint8)
    parts = b""
    for x, y, dx, dy in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)):
        some = pixels[y::dy, x::dx]
        if some.size:
            parts += filtered([r.tobytes() for r in some], 3, [k % 5 for k in range(len(some))])
    assert (png.decode(image(10, 9, 8, 2, parts, woven=1)) == pixels).all()


def test_broken_images_are_told(spark):
    good = image(7, 3, 8, 2, filtered([bytes(range(21))] * 3, 3, [4, 3, 1]))
    rng, rows = random.Random(9), [(0, good)]
    for k in range(1, 400):
        data = bytearray(good)
        data[rng.randrange(len(data))] = rng.randrange(256)
        rows.append((k, bytes(data[: rng.randint(0, len(data))])))
    rows.append((400, None))
    df = spark.createDataFrame(rows, "k int, content binary")
    got = scoring.inspect_images(df).select("k", "image.*").collect()
    assert len(got) == 401 and {r.k: (r.status, r.width, r.height) for r in got}[0] == ("ok", 7, 3) and {r.k: r.status for r in got}[400] == "error"
    arrays = scoring.image_arrays(df, 2).filter("array.error != ''").count()
    assert arrays == sum(r.status == "error" for r in got)


def test_image_arrays(spark):
    rgb = np.random.default_rng(5).integers(0, 256, (6, 9, 3), dtype=np.uint8)
    data = image(9, 6, 8, 2, filtered([r.tobytes() for r in rgb], 3, [4] * 6))
    rows = spark.createDataFrame([(1, data, None, 3), (2, data, (3, 2, 50, 50), 3), (3, data, (5, 5, 5, 6), 3)], "k int, content binary, box struct<x1:int,y1:int,x2:int,y2:int>, pixels int")
    got = {r.k: r for r in scoring.image_arrays(rows, 3, box="box").select("k", "pixels", "array.*").toDF("k", "own", "pixels", "width", "height", "error").collect()}
    mean, deviation = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])
    want = rgb.reshape(3, 2, 3, 3, 3).mean(axis=(1, 3))
    assert np.allclose(got[1].pixels, ((want / 255 - mean) / deviation).ravel(), atol=1e-5) and got[1].own == 3
    assert (got[2].width, got[2].height) == (6, 4) and "no pixel" in got[3].error
    assert np.allclose(png.resized(rgb, 4, 5).mean(axis=(0, 1)), rgb.mean(axis=(0, 1))) and np.allclose(png.resized(rgb, 12, 18)[::2, ::2], rgb)


def test_resized_images(spark, monkeypatch, tmp_path):
    """Sizes above and below what is kept of weights, against a sum over all pixels; weights of a size are told once, and a small file's images are dealt out."""
    rng = np.random.default_rng(6)
    for h, w, height, width in ((5, 7, 3, 4), (1, 1, 2, 2), (300, 40, 64, 8), (33, 200, 90, 100)):
        rgb = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        want = np.einsum("yh,hwc,xw->yxc", png._weights(h, height), rgb.astype(float), png._weights(w, width))
        assert np.allclose(png.resized(rgb, height, width), want) and np.allclose(png.resized(rgb[:, ::-1], height, width)[:, ::-1], want)
    calls = []
    monkeypatch.setattr(np, "linspace", lambda *a, f=np.linspace, **k: calls.append(a) or f(*a, **k))
    for _ in range(50):
        png.resized(np.zeros((6, 11, 3), dtype=np.uint8), 3, 5)
    assert len(calls) == 2
    spark.range(1000).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    tasks = catalogue.queries()["png_arrays"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert [r["count"] for r in tasks] == [250] * 4


# ---------------------------------------------------------------- ledger


def test_store(spark, tmp_path):
    folder = store.fresh_folder(spark, str(tmp_path / "x"))
    path = store.write_new(spark, folder, "sub/a.txt", "é")
    assert open(path).read() == "é"
    with pytest.raises(RefusedInput, match="there already"):
        store.write_new(spark, folder, "sub/a.txt", "b")
    with pytest.raises(RefusedInput, match="isn't empty"):
        store.fresh_folder(spark, folder)
    for bad in ("../a", "/a", "", "a/../../b", "a:b"):
        with pytest.raises(RefusedInput, match="leads out"):
            store.write_new(spark, folder, bad, "")


def test_exposures(spark, tmp_path):
    ledger = store.Ledger(spark, str(tmp_path / "ledger"))
    assert store.evaluated(ledger, "test set A", "job1", "t1", lambda: 5) == (5, 1)
    with pytest.raises(RefusedInput, match="1 times"):
        store.evaluated(ledger, "test set A", "job2", "t2", lambda: 6)
    assert store.evaluated(ledger, "test set A", "job2", "t2", lambda: 6, confirmed=True) == (6, 2)
    with pytest.raises(ZeroDivisionError):
        store.evaluated(ledger, "test set B", "job3", "t3", lambda: 1 / 0)
    assert {r.subject: (r.exposures, r.last_job) for r in ledger.exposures().collect()} == {"test set A": (2, "job2"), "test set B": (1, "job3")}
    assert {r.job: (r.status, r.entries) for r in ledger.jobs().collect()} == {"job1": ("succeeded", 3), "job2": ("succeeded", 3), "job3": ("failed", 3)}
    for status in ("running", "submitted"):
        with pytest.raises(RefusedInput, match="can't be"):
            store.advance(ledger, "evaluation", "test set A", "job1", status, "t")


def test_writers_at_once(spark, tmp_path):
    """Each entry gets a number of its own, and with an expected number only one writer wins."""
    ledger = store.Ledger(spark, str(tmp_path / "ledger"))
    got, lost = [], []

    def write(k, expected):
        try:
            got.append(ledger.append("note", "s", f"j{k}", "x", "t", expected=expected))
        except RefusedInput:
            lost.append(k)

    for expected in (None, 9):
        threads = [threading.Thread(target=write, args=(k, expected)) for k in range(8)]
        [t.start() for t in threads]
        [t.join() for t in threads]
    assert sorted(got) == list(range(1, 10)) and len(lost) == 7 and ledger.entries().count() == 9


# ---------------------------------------------------------------- remote calls


def test_resumed_calls(spark, tmp_path):
    folder, rows = str(tmp_path / "log"), spark.createDataFrame([(f"i{k}",) for k in range(60)] + [("i1",), (None,)], "image string")

    def limited(value):
        k = int(value[1:])
        if k % 7 == 0:
            raise ValueError("bad image")
        if k >= 30:
            raise RuntimeError("429 quota")
        return {"make": f"m{k}"}, {"prompt": 2, "output": 1}

    first = remote.ask(rows, "image", limited, ["make"], folder, waves=1, retries=2, wait=0.0)
    told = {r.key: r for r in first.collect()}
    assert len(told) == 60 and sum(r.error == "" for r in told.values()) == 25
    left = sorted(r.key for r in remote.remaining(rows, "image", spark, folder).collect())
    assert left == sorted(k for k, r in told.items() if r.error)
    second = remote.ask(rows, "image", lambda v: ({"make": "later"}, {"prompt": 1}), ["make", "model"], folder, waves=3, wait=0.0)
    again = {r.key: (r.attempt, r.make_pred, r.error) for r in second.collect()}
    assert all(again[k] == ((1, f"m{k[1:]}", "") if k not in left else (2, "later", "")) for k in again) and len(again) == 60
    calls = spark.read.option("mergeSchema", True).parquet(f"{folder}/answers/*").groupBy("attempt").count().collect()
    assert {r.attempt: r["count"] for r in calls} == {1: 60, 2: 35}
    assert remote.ask(rows, "image", limited, ["make"], folder, waves=2, wait=0.0).filter("error != ''").count() == 0


def test_calls_of_a_batch():
    """A batch's answers are one frame in the order of its keys; no more calls than workers are under way, and a slow one holds up no other."""
    now, most, held, lock = [0], [0], threading.Event(), threading.Lock()

    def call(value):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        if value == "k0":
            held.wait(30)  # until the batch's last key was asked
        elif value == "k999":
            held.set()
        with lock:
            now[0] -= 1
        if value == "k7":
            raise ValueError("bad image")
        return {"make": value}, {"prompt": 1}

    batches = [pd.DataFrame({"key": [f"k{k}" for k in range(1000)]}), pd.DataFrame({"key": []}), pd.DataFrame({"key": ["x"]})]
    got = list(remote._calls(call, ["make"], 3, 2, 0.0)(iter(batches)))
    assert [len(f) for f in got] == [1000, 0, 1] and held.is_set() and 1 < most[0] <= 3
    assert list(got[0]["key"]) == list(batches[0]["key"]) and got[0]["error"].tolist()[7] == "ValueError: bad image" and got[0]["make_pred"].tolist()[8] == "k8"


def test_a_limit_ends_the_run(spark, tmp_path):
    folder, rows = str(tmp_path / "log"), spark.createDataFrame([(f"i{k}",) for k in range(80)], "image string")

    def out_of_quota(value):
        raise RuntimeError("503 unavailable")

    asked = remote.ask(rows, "image", out_of_quota, ["make"], folder, waves=8, retries=1, wait=0.0).count()
    assert 0 < asked < 40 and remote.remaining(rows, "image", spark, folder).count() == 80


def test_a_key_that_looks_like_a_code(spark, tmp_path):
    """Errors that name their key don't pass because its digits or words are those of a limit, so each key is asked once and no wave is the last."""
    rows = spark.createDataFrame([(k,) for k in ("img4290", "a-429.png", "resources/503", "img1503", "img7")], "image string")

    def missing(value):
        raise ValueError(f"no image {value}")

    begin = time.monotonic()
    told = scoring.remote(rows, "image", missing, ["make"]).collect()  # a retry would wait for 75 seconds
    assert sorted(r.error for r in told) == sorted(f"ValueError: no image {r.image}" for r in told) and len(told) == 5 and time.monotonic() - begin < 60
    asked = remote.ask(rows, "image", missing, ["make"], str(tmp_path / "log"), waves=4, wait=0.0)
    assert asked.filter("NOT transient").count() == 5
    assert gates.is_transient(RuntimeError("HTTP 429: img4290"), "img4290") and gates.is_transient(RuntimeError("(503)"), "503") and gates.is_transient(RuntimeError("Quota for a is used up"), "a")


# ---------------------------------------------------------------- overlapping boxes


def plain_suppression(boxes, share):
    def both(a, b):
        w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
        return w * h / union if union else 0

    kept = {}
    for image, box, score, key in sorted(boxes, key=lambda r: (r[0], -r[2], r[1])):
        if all(both(box, other) <= share for other, _ in kept.get(image, [])):
            kept.setdefault(image, []).append((box, key))
    return {key for some in kept.values() for _, key in some}


@pytest.mark.parametrize("share", [0.3, 0.5, 0.8])
def test_suppression(spark, share):
    rng, boxes = random.Random(int(share * 10)), []
    for k in range(700):
        scale = rng.choice([1, 10, 10, 300])
        x, y, w, h = rng.uniform(-50, 200), rng.uniform(-50, 200), rng.uniform(0.1, 1) * scale, rng.uniform(0.1, 1) * scale
        boxes.append((rng.choice(["a", "a", "a", "b"]), (x, y, x + w, y + h), rng.choice([0.5, rng.random()]), k))
    boxes.append(("a", (5.0, 5.0, 5.0, 9.0), 0.9, 700))
    rows = [(i, *b, s, k) for i, b, s, k in boxes] + [("a", None, 0.0, 1.0, 1.0, 0.5, 701), ("a", 3.0, 0.0, 1.0, 1.0, 0.5, 702), ("a", 0.0, 0.0, 1.0, 1.0, float("nan"), 703)]
    df = spark.createDataFrame(rows, "image string, x1 double, y1 double, x2 double, y2 double, score double, id int")
    got = {r.id: r.kept for r in suppression.suppressed(df, "image", "score", share).collect()}
    assert {k for k, v in got.items() if v} == plain_suppression(boxes, share) and [got[k] for k in (701, 702, 703)] == [None] * 3


def test_crowded_image(spark):
    """Very many equal boxes: one stays, and no pairs are made."""
    df = spark.range(60_000).select(F.lit(None).cast("string").alias("image"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(4.0).alias("x2"), F.lit(4.0).alias("y2"), F.lit(0.5).alias("score"))
    assert suppression.suppressed(df, "image", "score").groupBy("kept").count().orderBy("kept").collect() == [(False, 59_999), (True, 1)]
    assert suppression.suppressed(df.limit(0), "image", "score").count() == 0


def test_copies_are_decided_once(spark, monkeypatch):
    """The rounds see each different box once, whatever the number of its copies, and none of boxes without an area, which all stay."""
    sizes = []
    monkeypatch.setattr(suppression, "_cells", lambda rows, more, f=suppression._cells: sizes.append(rows.count()) or f(rows, more))
    place = (F.col("id") % 12).cast("double")
    flat = F.col("id") >= 6_000
    df = spark.range(6_200).select("id", F.when(F.col("id") % 2 == 0, "a").alias("image"), place.alias("x1"), F.lit(0.0).alias("y1"), F.when(flat, place).otherwise(place + 10).alias("x2"), F.lit(10.0).alias("y2"), (F.col("id") % 1000).alias("score"))
    got = {r.id: r.kept for r in suppression.suppressed(df, "image", "score").collect()}
    assert max(sizes) == 12 and len(got) == 6_200 and all(got[k] for k in range(6_000, 6_200))
    rows = [("a" if k % 2 == 0 else "b", (float(k % 12), 0.0, k % 12 + 10.0, 10.0), k % 1000, k) for k in range(6_000)]
    where = {k: (image, box, score) for image, box, score, k in rows}
    # of copies with equal scores any may stay
    assert sorted(where[k] for k in got if k < 6_000 and got[k]) == sorted(where[k] for k in plain_suppression(rows, 0.5))
