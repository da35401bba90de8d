"""Hard negatives, the run-length index and the filter audit against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from tabulon.llm import filter_audit as A
from tabulon.llm import hard_negatives as H
from tabulon.llm import run_index as R

EMBEDDED = "vec_id long, embedding array<float>, label int, score long, tag string, positives int, `a.b` string"


def vectors(seed=2, n=420, dims=12):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        v = [rng.gauss(0.3, 0.4) / (1 + d) for d in range(dims)]
        rows.append((k, v, rng.randrange(4), 1, "t", 2, "x"))
    common = rows[5][1]
    rows = [(r[0], common if r[0] % 3 == 0 else r[1], *r[2:]) for r in rows]  # a third of all rows are one vector: ties
    odd = [(500, None, 1), (600, rows[9][1], None), (700, [float("nan")] * dims, 1), (800, [float("inf")] + [0.0] * (dims - 1), 1), (900, [None] + [0.5] * (dims - 1), 1)]
    odd += [(None, rows[9][1], 1), (1000, [0.0] * dims, 2), (1100, [-1.0] * dims, 3), (1200, [], 1), (1300, [0.25, 0.5], 1), (100, rows[100][1], 3)]  # shorter ones, and a repeated vec_id
    return rows + [(*r, 1, "t", 2, "x") for r in odd] + [rows[200], rows[200]]


def plain_negatives(rows):
    kept = []
    for vec_id, v, label, *_ in rows:
        if vec_id is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * float(np.float32(x))) for x in v]
            kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, q, len(kept)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in kept:
        if a[0] % 100:
            continue
        scored = sorted(((-dot(a[2], b[2]), b[0], b[3], b[1]) for b in kept if b[3] != a[3]))
        for p in [s for s in scored if s[3] == a[1]][:5]:
            fit = [s for s in scored if s[3] != a[1] and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:5]
            out += [(a[0], p[1], k + 1, s[1], -p[0], -s[0]) for k, s in enumerate(fit)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    rows = vectors()
    monkeypatch.setattr(H, "ROWS", 60)  # several blocks of rows and of anchors
    monkeypatch.setattr(H, "ANCHORS", 5)
    got = H.mined(spark.createDataFrame(rows, EMBEDDED).repartition(5))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_hard_negatives_of_few(spark):
    assert H.mined(spark.createDataFrame([], EMBEDDED)).count() == 0
    one = [(100, [1.0, 2.0], 1, 0, None, None, None)]
    assert H.mined(spark.createDataFrame(one, EMBEDDED)).count() == 0
    three = [*one, (1, [1.0, 2.0], 1, 0, None, None, None), (2, [1.0, 1.9], 2, 0, None, None, None)]
    assert [tuple(r)[:4] for r in H.mined(spark.createDataFrame(three, EMBEDDED)).collect()] == [(100, 1, 1, 2)]


def test_bounds_hold():
    """Partial products with their room hold the whole product, after the first step and after all."""
    rng = np.random.default_rng(4)
    x, q = rng.integers(-3000, 3000, (200, 40)), rng.integers(-3000, 3000, (30, 40))
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    block = H._Block(x, q, turn)
    part, low, high = block.first(slice(0, 30))
    whole = q @ x.T
    assert (low <= whole).all() and (whole <= high).all()
    a, b = np.indices(part.shape).reshape(2, -1)
    low, high = block.further(part[a, b], a, b)
    assert (low <= whole[a, b]).all() and (whole[a, b] <= high).all() and (high - low < 4e9).all()


def plain_repeats(rows, match):
    count, data = Counter(), [(r[0], (r[1] or "").encode()) for r in rows]
    for _, b in data:
        count.update(b[k : k + match] for k in range(len(b) - match + 1))
    out = []
    for doc_id, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - match + 1):
            if count[b[k : k + match]] > 1:
                gone[k : k + match] = b"\1" * match
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_longest_elsewhere():
    rng = random.Random(6)
    for letters in (b"ab\0", b"a", bytes(range(256))):
        for _ in range(60):
            some = sorted({bytes(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 9))})
            got, begins, index = R.longest_elsewhere(some)
            places = [(s, k) for s, x in enumerate(some) for k in range(len(x))]
            for s, k in places:
                best = 0
                for t, m in places:
                    if (s, k) != (t, m):
                        n = 0
                        while n < min(len(some[s]) - k, len(some[t]) - m) and some[s][k + n] == some[t][m + n]:
                            n += 1
                        best = max(best, n)
                assert got[begins[s] + k] == best
            assert (np.diff(index.begin) > 0).all() and len(index.first) == len(index.last) == len(index.byte)


def test_equal_strings_have_equal_keys():
    rng = random.Random(8)
    inner = bytes(rng.randrange(97, 101) for _ in range(90))
    keys = []
    for _ in range(20):
        text = bytes(rng.randrange(97, 123) for _ in range(rng.randrange(300))) + inner + bytes(rng.randrange(97, 123) for _ in range(rng.randrange(300)))
        at, found = text.index(inner), {}
        for key, start, n, _ in zip(*R.text_runs(text, 60)):
            found |= {start + k: key for k in range(n)}
        assert sorted(found) == list(range(len(text) - 59))
        keys.append([found[at + k] for k in range(len(inner) - 59)])
    assert all(k == keys[0] for k in keys)


@pytest.mark.parametrize(("match", "bin_bytes"), [(40, 1_500_000), (30, 700)])
def test_long_repeats(spark, docs, rows, match, bin_bytes):
    """Small bins make hot keys, which are dealt again and at last string by string."""
    some = docs if bin_bytes > 1000 else docs.filter("coalesce(length(text), 0) < 1000")
    got = R.long_repeats(some, match, bin_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == plain_repeats([r for r in rows if some is docs or len(r[1] or "") < 1000], match)


def test_repeats_within_a_text(spark, empty):
    """One byte or a short period over and over, strings that touch and overlap, slices, and texts at the limit."""
    inner = "the very same line of text. "
    texts = ["a" * 9000, "ab" * 40, "x" + inner + inner + "y", inner, inner[:-1], "é" * 30 + "q", "é" * 30, None, "", "z" * 20]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, inner), (None, inner)]
    got = R.long_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20)
    assert sorted(map(tuple, got.collect()), key=str) == plain_repeats(rows, 20)
    assert R.long_repeats(empty).count() == 0


def test_texts_without_repeats(spark):
    shared = "this passage stands in two texts. "
    rows = [(1, "first " + shared + "and more", "k"), (2, shared, None), (3, None, "n"), (4, "alone", "é")]
    got = R.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, `start.end` string"), 30)
    assert sorted(map(tuple, got.collect())) == [(1, "first and more", "k"), (2, "", None), (3, None, "n"), (4, "alone", "é")]


def plain_audit(rows, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    smallest = {}
    for d, t, *_ in rows:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    failed = []
    for d, t, _, source, *_ in rows:
        t = t or ""
        w = words(t)
        first = smallest.get(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": first is not None and (d is None or d > first)}
        failed.append((source or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = []
    for part in {f[0] for f in failed}:
        own, removed_of, steps = [f for f in failed if f[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                removed = [f for f in left if k in f[1]]
                left = [f for f in left if k not in f[1]]
                removed_of[k] += len(removed)
                fails = sum(k in f[1] for f in own)
                steps.append((part, "".join(order), step, len(left), len(removed), fails - len(removed), sum(f[1] == {k} for f in own), sum(f[2] for f in removed), sum(f[3] for f in removed), k))
        out += [(*s[:-1], removed_of[s[-1]]) for s in steps]
    return sorted(out)


def test_filter_audit(spark, docs, rows, empty):
    more = [(900 + k, ("Word " * 250 if k % 2 else " ".join(f"w{i}" for i in range(300))) + "#" * (k % 3), None, "b", None, None, None, None, None) for k in range(9)]
    table = docs.unionByName(spark.createDataFrame(more, docs.schema))
    labels = [(k, k % 2, k % 3 == 0) for k in range(40)] + [(901, 1, 1), (901, 0, 0), (None, 1, 1), (5555, 1, 0), (902, None, None)]
    told = spark.createDataFrame([(d, q, None if t is None else int(t)) for d, q, t in labels], "doc_id long, quality int, toxic int")
    got = A.filter_audit(table, told)
    assert sorted(map(tuple, got.collect())) == plain_audit([*rows, *more], [(d, q, int(t) if t is not None else None) for d, q, t in labels])
    assert A.filter_audit(empty, told).count() == 0
    assert A.filter_audit(table, told.limit(0)).agg({"good_lost": "max"}).first()[0] == 0


def test_audit_of_own_filters(spark):
    rows = spark.createDataFrame([("p", True, False, True, False), ("p", True, True, False, True), ("q", False, False, True, True)], "part string, good boolean, toxic boolean, short boolean, `long one` boolean")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in A.audit(rows, ["short", "long one"]).collect()}
    assert got == {("p", "shortlong one", 1): (1, 1, 2), ("p", "shortlong one", 2): (0, 1, 2), ("p", "long oneshort", 1): (1, 1, 2), ("p", "long oneshort", 2): (0, 1, 2),
                   ("q", "shortlong one", 1): (0, 1, 1), ("q", "shortlong one", 2): (0, 0, 1), ("q", "long oneshort", 1): (0, 1, 1), ("q", "long oneshort", 2): (0, 0, 1)}
