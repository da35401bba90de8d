"""Operators that find copies, against plain versions of themselves."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.llm import chunk_dedup, components, exact_dedup, line_winnow, minhash_forest
from tabulon.llm.common import distributed_rank, identity


def plain_components(sets, similar=80):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = [k for k in sets if sets[k]]
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(sets[a] & sets[b])
            if 100 * n >= similar * (len(sets[a]) + len(sets[b]) - n):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in sets}


def plain_shingles(text, n):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if x]
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(docs, rows, n):
    sets = {r[0]: plain_shingles(r[1], n) for r in rows if r[0] is not None}
    truth = plain_components(sets)
    got = minhash_forest.near_duplicates(docs, n).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), truth[r.doc_id], truth[r.doc_id] == r.doc_id)
    assert {r.component_id for r in got if r.doc_id is None} == {3, None}


def test_near_duplicates_in_a_large_region(spark):
    """Copies of one text with more and more changes: large regions, chains, and members that belong to none."""
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(160)]
    texts = []
    for k in range(260):
        t = list(base)
        for at in rng.choice(160, size=k % 13, replace=False):
            t[at] = f"x{k}_{at}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    truth = plain_components({k: plain_shingles(t, 4) for k, t in enumerate(texts)})
    assert 1 < len(set(truth.values())) < 250
    got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(df, 4).collect()}
    assert got == truth


def test_blocks_find_all_links(spark, monkeypatch):
    monkeypatch.setattr(minhash_forest, "BLOCK", 6000)  # many blocks
    test_near_duplicates_in_a_large_region(spark)


def test_neighbours():
    tree = np.array([0, 0, 0, 1])
    h = np.array([[1, 2, 3, 4, 5, 6], [1, 2, 3, 9, 9, 9], [1, 2, 4, 0, 0, 0], [1, 2, 4, 0, 0, 0]])
    later, earlier, _ = minhash_forest.near(tree, h)
    assert list(zip(later, earlier)) == [(1, 0)]
    assert [len(x) for x in minhash_forest.near(tree[:0], h[:0])] == [0, 0, 0]


def test_near_dedup_keeps_columns(docs, rows):
    kept = minhash_forest.near_dedup(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 4 in ids and ids.count(3) == 3 and len([i for i in ids if i is not None and 60 <= i < 68]) == 1


def test_exact_groups(docs, rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    for share in (0.001, 0.04, 0.5):  # all, some and no groups are heavy
        got = exact_dedup.exact_groups(docs, share).collect()
        assert len(got) == len(rows)
        by = defaultdict(list)
        for r in got:
            by[r.text_sha256].append(r)
        for text, ids in groups.items():
            found = by[hashlib.sha256(text.encode()).hexdigest()]
            ids = [i for i in ids if i is not None]
            assert {r.keep_id for r in found} == {min(ids) if ids else None} and {r.group_size for r in found} == {len(found)} and [r.kept for r in found].count(True) == 1


def test_heavy_hitters_are_bounded_and_found(spark):
    df = spark.range(20_000).selectExpr("cast(case when id % 3 = 0 then 'hot' else string(id) end as binary) as d").repartition(7)
    found = [bytes(r.digest) for r in exact_dedup.heavy_hitters(df, 0.1).collect()]
    assert found == [b"hot"]


def test_exact_dedup_keeps_columns(docs):
    out = exact_dedup.exact_dedup(docs)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and ids.count(3) == 1 and len(ids) == len(set(ids))


def plain_chunks(data):
    mask, reach = (1 << 32) - 1, chunk_dedup.REACH
    gear, begin, out, h = chunk_dedup._GEAR.tolist(), 0, [], []
    for i in range(len(data)):
        value = 0
        for k in range(min(chunk_dedup.WINDOW, i + 1)):
            value = value + (gear[data[i - k]] << k) & mask
        h.append(value)
    for i in range(len(data)):
        least = all(h[i] < x for x in h[max(0, i - reach) : i]) and all(h[i] <= x for x in h[i + 1 : i + 1 + reach])
        if least or i + 1 == len(data):
            while i + 1 - begin > chunk_dedup.MOST:
                out.append((begin, begin + chunk_dedup.MOST))
                begin += chunk_dedup.MOST
            out.append((begin, i + 1))
            begin = i + 1
    return out


def test_chunks_against_a_byte_loop():
    rng = np.random.default_rng(2)
    for data in (b"", b"a", b"ab" * 900, bytes(rng.integers(0, 256, 3000, dtype=np.uint8)), "é中".encode() * 200):
        ends = chunk_dedup.chunk_ends(data).tolist()
        assert list(zip([0, *ends[:-1]], ends)) == plain_chunks(data)
        assert chunk_dedup.chunk_ends(data, at_once=37).tolist() == ends


def test_chunks_resist_insertions():
    data = bytes(np.random.default_rng(4).integers(97, 123, 6000, dtype=np.uint8))

    def cut(d):
        ends = chunk_dedup.chunk_ends(d).tolist()
        return {d[a:b] for a, b in zip([0, *ends[:-1]], ends)}

    assert len(cut(data) - cut(data[:3000] + b"inserted" + data[3000:])) <= 3


def documents(df):
    """(none, id, mark) to text: the documents in their order."""
    return dict(sorted({(r.none, r.id, r.mark): r.text for r in df.select(*identity(), "text").collect()}.items()))


def doc_id(who):
    return None if who[0] else who[1]


def awkward(spark):
    """Rows without id and with one that others have too, which share passages with others or nothing."""
    rng = random.Random(12)
    line = lambda: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8))) for _ in range(9))
    shared, own = [line() for _ in range(5)], [[line() for _ in range(10)] for _ in range(6)]
    texts = [(None, shared + own[0]), (None, own[1][:3] + shared), (None, own[2]), (2, own[3]), (2, own[4][:4] + shared + own[4][4:]), (2, own[4][:4] + shared + own[4][4:]), (1, ["short"]), (5, ["short"]), (None, []), (7, own[5] * 2)]
    return spark.createDataFrame([(k, "\n".join(t), "x", 1) for k, t in texts] + [(None, None, "x", 1)], "doc_id long, text string, mark string, start int")


def plain_blocks(data, least):
    parts = plain_chunks(data)
    out = []
    for i, (a, _) in enumerate(parts):
        end = next((b for _, b in parts[i:] if b - a >= least), None)
        out += [(a, end)] if end else []
    if parts and not out:
        return [(0, len(data))]
    return out if not out or out[-1][1] == len(data) else [*out, (out[-1][0], len(data))]


def test_blocks():
    rng = np.random.default_rng(9)
    for n in (0, 1, 20, 47, 48, 49, 90, 700, 3000):
        data = bytes(rng.integers(97, 123, n, dtype=np.uint8))
        a, b = chunk_dedup.blocks(data)
        assert list(zip(a.tolist(), b.tolist())) == plain_blocks(data, chunk_dedup.LEAST)
        covered = {i for x, y in zip(a.tolist(), b.tolist()) for i in range(x, y)}
        assert covered == set(range(n))


def plain_repeats(texts):
    first, found = {}, {k: plain_blocks((t or "").encode(), chunk_dedup.LEAST) for k, t in texts.items()}
    for k, parts in found.items():
        for a, b in parts:
            first.setdefault(texts[k].encode()[a:b], (k, a))
    out = []
    for k, parts in found.items():
        run, data = None, (texts[k] or "").encode()
        for a, b in [x for x in parts if first[data[x[0] : x[1]]] != (k, x[0])]:
            if run and a <= run[1]:
                run[1] = max(run[1], b)
                continue
            run = [a, b, *first[data[a:b]]]
            out.append((k, run))
    return sorted((repr(doc_id(k)), a, b - a, repr(doc_id(of)), at, (a, b) == (0, len(texts[k].encode()))) for k, (a, b, of, at) in out)


def test_repeats(spark, docs, rows):
    for df in (docs, awkward(spark)):
        got = chunk_dedup.repeats(df).collect()
        expected = plain_repeats(documents(df))
        assert sorted((repr(r.doc_id), r.start, r.length, repr(r.first_doc_id), r.first_start, r.whole) for r in got) == expected and expected
    shared = {r.doc_id for r in chunk_dedup.repeats(docs).collect()}
    assert set(range(9, 60, 9)) <= shared  # the passage of 70 words
    assert 9 not in {r.doc_id for r in chunk_dedup.repeats(docs.filter("doc_id in (9, 10)")).collect()}


def test_passages_of_51_short_words(spark):
    """Pairs of texts that share nothing but such a passage."""
    rng, common = random.Random(51), "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down should because long each just state those people too mr how little good world make very year still see own work men day get here old life both".split()
    other = lambda n: " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(2, 9))) for _ in range(n))
    texts = []
    for k in range(800):
        passage = " ".join(rng.choice(common) for _ in range(51))
        texts += [(2 * k, f"{other(30)} {passage} {other(30)}"), (2 * k + 1, f"{other(40)} {passage} {other(20)}")]
    found = {r.doc_id for r in chunk_dedup.repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert len(found & set(range(1, 1600, 2))) >= 0.99 * 800 and not found & set(range(0, 1600, 2))


def test_without_repeats(spark, docs, rows):
    out = chunk_dedup.without_repeats(docs)
    texts = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    assert out.columns == docs.columns and texts[1] == rows[1][1] and texts[68] == "" and len(texts[9]) < len(rows[9][1]) - 200
    df = awkward(spark)
    left = chunk_dedup.without_repeats(df)
    assert left.columns == df.columns and left.count() == df.count()
    gone = defaultdict(list)
    texts = documents(df)
    for who, text in texts.items():
        gone[doc_id(who)].append(text)
    untouched = [t for t in (r.text for r in df.collect()) if t and t not in ("short",) and all(sum(line in (u or "") for u in texts.values()) == 1 and t.count(line) == 1 for line in t.split("\n"))]
    after = [r.text for r in left.collect()]
    assert len(untouched) == 2 and all(t in after for t in untouched)  # a row without id, and one of a repeated id


def plain_runs(texts, size):
    """Runs of lines in stretches of `size` lines that stand earlier, in the order of documents and lines."""
    first, out = {}, []
    split = lambda t: [y for x in (t or "").split("\n") if (y := re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x))]
    for who, t in texts.items():
        own, run = split(t), None
        for k in range(len(own) - size + 1):
            x = tuple(own[k : k + size])
            if x in first:
                if run and k <= run[1] + run[2]:
                    run[2] = k + size - run[1]
                else:
                    out.append(run := [repr(doc_id(who)), k, size, repr(doc_id(first[x][0])), first[x][1]])
            first.setdefault(x, (who, k))
    return sorted(map(tuple, out))


@pytest.mark.parametrize("gram, window", [(1, 1), (2, 2), (1, 3), (3, 2), (1, 5)])
def test_repeated_runs(spark, docs, gram, window):
    """Every maximal run of the guaranteed length, however long, and nothing else."""
    block = "alpha beta\ngamma\n\n delta \nepsilon"
    rng = random.Random(gram * 7 + window)
    made = {0: f"first\n{block}\nlast", 1: f"other\nthing\n{block}", 2: "x\n" * 7, 3: f"{block}\n{block}", 4: "", 5: None, 6: "gamma", 7: "f1\nf2\nz", 8: "a\nu\nf1\nf2", 9: "b\nu\nf1\nf2\nc", 10: "u"}
    made |= {k: "\n".join(f"line {rng.randint(0, 3)}" for _ in range(rng.randint(0, 12))) for k in range(20, 70)}
    made |= {k: "\n".join(f"long {n}" for n in range(k, k + 40)) for k in (100, 120, 130)}
    small = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    for df in (small, awkward(spark), docs.filter("length(text) < 3000 or text is null")):
        got = [(repr(r.doc_id), r.first_line, r.n_lines, repr(r.of_doc_id), r.of_line) for r in line_winnow.repeated_runs(df, gram, window).collect()]
        assert sorted(got) == plain_runs(documents(df), gram + window - 1)


def test_query_of_repeated_runs(spark, tmp_path):
    """The query and its SQL; the functions for single lines."""
    import duckdb

    from tabulon.llm.queries import op6_line_winnowing

    made = {0: "f1\nf2\nz\nq", 1: "a\nf1\nf2\nz\nq\nf1\nf2\nz", 2: "b\nf2\nz\nq\nc", 3: "d\nz\nq", 4: "u\n" * 6, 5: "u\nu", 7: None, 8: ""}
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.first_line, r.n_lines, r.of_doc_id, r.of_line) for r in op6_line_winnowing(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(line_winnow.ORACLE).fetchall()) == [(1, 1, 7, 0, 0), (2, 1, 3, 0, 1), (4, 1, 5, 4, 0)]
    assert sorted((r.doc_id, r.first_line, r.n_lines) for r in line_winnow.repeated_lines(df).collect()) == [(1, 1, 7), (2, 1, 3), (3, 1, 2), (4, 1, 5), (5, 0, 2)]


def test_many_equal_rows_without_id(spark):
    """They are one document: no window gets them all."""
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a\nb\nc\nd\na\nb\nc").alias("text"))
    assert [tuple(r) for r in line_winnow.repeated_runs(rows).collect()] == [(None, 4, 3, None, 0)]


def test_links_of_joined_components():
    """Two components of many equal sets need one link, not one for each pair."""
    sets = [np.arange(50, dtype=np.int64)] * 60
    block = pd.DataFrame({"query": [True] * 60 + [False] * 60, "a": list(range(120)), "root": [0] * 60 + [60] * 60, "grams": sets * 2})
    assert len(minhash_forest._block_links(80)(block)) == 1
    three = pd.DataFrame({"query": [True] * 3 + [False] * 6, "a": list(range(9)), "root": [0, 1, 2, 3, 3, 4, 4, 5, 5], "grams": [np.arange(50, dtype=np.int64)] * 9})
    assert len(minhash_forest._block_links(80)(three)) == 5


def test_texts_without_repeated_lines(spark):
    made = {0: "a1\nb\nc", 1: "x\n b \n\nc\ny", 2: "a1\nb\nc", 3: None, 4: "", 5: "c\nnew"}
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_winnow.without_repeats(df, 1, 1).collect()} == {0: made[0], 1: "x\ny", 2: "", 3: None, 4: "", 5: "new"}
    df = awkward(spark)
    left = line_winnow.without_repeats(df)
    before, after = [r.text for r in df.collect()], [r.text for r in left.collect()]
    assert left.columns == df.columns and len(before) == len(after)
    assert sum(t in after for t in before if t and len(t.split("\n")) == 10) == 2  # a row without id, and one of a repeated id


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (7, 7_000_000_000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in [*range(41), 7_000_000_000]} | {90: 90, 95: 90, 100: 90}


def test_ranks(spark):
    from pyspark.sql import functions as F

    df = spark.range(500).select((F.col("id") % 2 * F.lit(None)).alias("none"), F.when(F.col("id") % 3 == 0, "a").alias("g"), F.col("id"))
    got = distributed_rank(df.repartition(4), [F.col("g")], [-F.col("id")], "rank").collect()
    for g in ("a", None):
        ids = sorted((r.id for r in got if r.g == g), reverse=True)
        assert [r.rank for r in sorted((r for r in got if r.g == g), key=lambda r: -r.id)] == list(range(len(ids)))


def test_empty_tables(empty):
    for call in (minhash_forest.near_duplicates, minhash_forest.near_dedup, exact_dedup.exact_groups, exact_dedup.exact_dedup, chunk_dedup.repeats, chunk_dedup.without_repeats, line_winnow.repeated_runs, line_winnow.without_repeats):
        assert call(empty).count() == 0
