"""Near-duplicates by an LSH forest over MinHash signatures.

Each of `TREES` trees is a sorted order of all documents by its own sequence of `DEPTH` MinHash values. A region
is a run of documents with the same first `LEAST` values. In a small region all documents are candidates of
each other. In a large one the depth grows until the runs are small, so candidates are the neighbours with the
longest common prefix, and neighbouring runs are chained. Candidates are confirmed on the full shingle sets and
the links joined to components. Where a large region still holds several components, what the depth parted
is made good: each document outside the region's largest component is compared with all of the region, in
blocks that hold their sets and emit links only.

Documents with the same shingle set are one class from the start, so copies are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabulon.llm.common import WHO, cut, doc_id_of, identity, release, same_document, ship, small
from tabulon.llm.components import components, joined

TREES, DEPTH, LEAST = 14, 6, 3
SMALL = 16  # documents of a region in which all are compared
#: Of TREES * DEPTH values a pair of similarity 0.8 shares 67 on average, with a deviation of 3.7.
AGREE = 46
#: Ids of at most so many candidates (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Rows of a range of the sorted orders, on average.
RANGE = 250_000
#: Hashes (8 bytes each) of a block's queries, and of its other rows, when what a region parted is made good.
BLOCK = 2_000_000

_rng = np.random.default_rng(20_240_611)
_XOR = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) << np.uint64(1)
_ODD = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `words` words; of a shorter text, of all its words as one."""
    parts = text.lower().split()  # of bytes: lowers A-Z only and splits at the ASCII blanks
    n = len(parts)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=np.uint64, count=n)
    size = min(n, words)
    g = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        g = (g ^ h[k : n - size + 1 + k]) * _MIX
        g ^= g >> np.uint64(29)
    g *= _MIX2
    g ^= g >> np.uint64(32)
    return np.unique(g)


def signature(found: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """The smallest value of each hash function, upper 32 bits."""
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), at_once):
        some = found[at : at + at_once]
        values = (some[None, :] ^ _XOR[:, None]) * _ODD[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(">u4")


def _key(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def _sign(words: int, rows: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                few = batch.slice(at, rows)
                sets = [shingles(t.as_py() or b"", words) for t in few.column(3)]
                keys = pa.array([_key(s) for s in sets], pa.binary())
                signs = pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*few.columns[:3], pa.array([len(s) for s in sets], pa.int64()), keys, signs], names=[*WHO, "n_shingles", "key", "sign"])
        release()

    return run


def _sets(words: int, rows: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                sets = [shingles(t.as_py() or b"", words) for t in batch.column(0).slice(at, rows)]
                values = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.binary()), values], names=["key", "grams"])
        release()

    return run


def near(tree: np.ndarray, h: np.ndarray, small: int = SMALL, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order: the candidates' positions (later, earlier), and which rows lie in a region that is large or may go on outside."""
    n = len(tree)
    same = np.ones(max(n - 1, 0), dtype=bool)
    same &= tree[1:] == tree[:-1]
    for d in range(least):
        same = same & (h[1:, d] == h[:-1, d])
    regions = None
    run, rows_of = [], []  # at each depth from `least`: the run of each row and its number of rows
    chain = same
    for d in range(least, h.shape[1] + 1):
        if d > least:
            same = same & (h[1:, d - 1] == h[:-1, d - 1])
        ids = np.concatenate(([0], np.cumsum(~same))) if n else np.empty(0, dtype=np.int64)
        counts = np.bincount(ids, minlength=1)
        run.append(ids)
        rows_of.append(counts[ids] if n else ids)
        regions = ids if regions is None else regions
    deep = np.stack(rows_of) <= small
    level = np.where(deep.any(axis=0), deep.argmax(axis=0), len(run) - 1)  # the first depth with small runs
    own = np.stack(run)[level, np.arange(n)] if n else regions
    later, earlier = [], []
    fits = deep.any(axis=0)
    for lag in range(1, small):
        i = np.arange(lag, n)
        j = i - lag
        ok = fits[i] & (level[i] == level[j]) & (own[i] == own[j])
        if not ok.any():
            break
        later.append(i[ok])
        earlier.append(j[ok])
    i = np.flatnonzero(chain & (rows_of[0][1:] > small)) + 1 if n else np.empty(0, dtype=np.int64)
    later.append(i)
    earlier.append(i - 1)
    open_ = (rows_of[0] > small) | (regions == 0) | (regions == regions[-1]) if n else np.empty(0, dtype=bool)
    return np.concatenate(later), np.concatenate(earlier), open_


#: What a row of a partition's ends begins with; regions begin with the tree's number.
ENDS = b"\xff"


def _across(found: DataFrame) -> DataFrame:
    """(a, b): the last node of a partition and the first of the next, where a region goes on. A row for each partition."""
    one = 1 + 4 * LEAST
    ends = found.filter(F.substring("region", 1, 1) == F.lit(ENDS)).select("a", "b", "region")
    before = W.orderBy("region")
    part = lambda k: F.substring("region", 6 + k * one, one)
    linked = ends.select(F.lag("b").over(before).alias("last"), F.col("a").alias("first"), (F.lag(part(1)).over(before) == part(0)).alias("goes_on")).filter("goes_on")
    return linked.select(F.least("last", "first").alias("a"), F.greatest("last", "first").alias("b"))


def _neighbours(similar: int):
    """Candidate pairs (a, b), the rows of open regions (a, region), and the partition's ends.

    The ends are the first node (a), the last (b), and as region a mark, the partition's number and both their regions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None  # a range partition: of an even size
        if table is None or not table.num_rows:
            return
        tree, node, size = (table.column(k).to_numpy() for k in ("tree", "node", "n"))
        raw = b"".join(table.column("prefix").to_pylist())
        h = np.frombuffer(raw, dtype=">u4").reshape(len(tree), DEPTH)
        i, j, open_ = near(tree, h)
        ok = (np.minimum(size[i], size[j]) * 100 >= similar * np.maximum(size[i], size[j])) & (node[i] != node[j])
        a, b = node[i[ok]], node[j[ok]]
        some = np.flatnonzero(open_)
        width = 4 * LEAST
        region_of = lambda k: int(tree[k]).to_bytes(1, "big") + raw[k * 4 * DEPTH : k * 4 * DEPTH + width]
        ends = ENDS + TaskContext.get().partitionId().to_bytes(4, "big") + region_of(0) + region_of(len(tree) - 1)
        regions = [region_of(k) for k in some]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.binary())], names=["a", "b", "region"])
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.nulls(len(some), pa.int64()), pa.array(regions, pa.binary())], names=["a", "b", "region"])
        yield pa.RecordBatch.from_arrays([pa.array(node[:1]), pa.array(node[-1:]), pa.array([ends], pa.binary())], names=["a", "b", "region"])

    return run


def _sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """node, grams: the shingle sets of some classes, each from the text of one of its documents; cut."""
    wanted = cut(nodes.join(classes.select("node", "key", "first.*"), "node"))
    ids = wanted.select(*WHO)
    texts = docs.select(*identity(), F.col("text").cast("binary").alias("text"))
    texts = texts.join(F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids, same_document(texts, ids), "left_semi").select("text")
    found = texts.mapInArrow(_sets(words), "key binary, grams array<long>").dropDuplicates(["key"])
    return cut(found.join(wanted.select("key", "node"), "key").select("node", "grams"))


def links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, similar: int) -> DataFrame:
    """The pairs (a, b) of `pairs` whose full shingle sets have `similar` % of their union in common; cut.

    Pairs whose signatures rule the similarity out leave first; only the others' texts are read again.
    """
    side = lambda k: classes.select(F.col("node").alias(k), F.col("sign").alias(f"sign_{k}"), F.col("n_shingles").alias(f"n_{k}"))
    wide = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    wide = wide.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * similar)
    values = lambda k: F.transform(F.sequence(F.lit(0), F.lit(TREES * DEPTH - 1)), lambda i: F.substring(f"sign_{k}", i * 4 + 1, F.lit(4)))
    agree = F.size(F.filter(F.zip_with(values("a"), values("b"), lambda x, y: x == y), lambda x: x))
    likely = cut(wide.filter(agree >= AGREE).select("a", "b"))
    sets = _sets_of(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct(), classes, docs, words)
    set_of = lambda k: sets.select(F.col("node").alias(k), F.col("grams").alias(f"grams_{k}"))
    both = likely.join(set_of("a"), "a").join(set_of("b"), "b")
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    return cut(both.withColumn("shared", shared).filter(F.col("shared") * 100 >= (F.size("grams_a") + F.size("grams_b") - F.col("shared")) * similar).select("a", "b"))


def _open_regions(members: DataFrame, found: DataFrame) -> DataFrame:
    """region, a, root of the members of regions that hold more than one component; cut."""
    labelled = cut(members.join(found.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a")))
    several = cut(labelled.groupBy("region").agg((F.min("root") != F.max("root")).alias("several")).filter("several").select("region"))
    return cut(labelled.join(small(several), "region"))


def _block_links(similar: int):
    """Links between the queries and the other rows of a block that join components; what two joined ones have more of is left out."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        asks, rows = block[block["query"]], block[~block["query"]]
        if asks.empty or rows.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sizes = rows["grams"].map(len).to_numpy()
        values = np.concatenate(rows["grams"].to_list())
        order = np.argsort(values, kind="stable")
        values, owner = values[order], np.repeat(np.arange(len(rows)), sizes)[order]
        nodes, roots, out, joins = rows["a"].to_numpy(), rows["root"].to_numpy(), [], {}

        def top(root):
            while (up := joins.get(root, root)) != root:
                joins[root] = root = joins.get(up, up)
            return root

        for a, root, grams in zip(asks["a"], asks["root"], asks["grams"]):
            low, high = np.searchsorted(values, grams, "left"), np.searchsorted(values, grams, "right")
            n = high - low
            at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=len(rows))
            near = np.flatnonzero((shared * 100 >= similar * (sizes + len(grams) - shared)) & (roots != root))
            for k in near[np.unique(roots[near], return_index=True)[1]]:  # one of each component
                if (one := top(root)) != (other := top(roots[k])):
                    joins[one] = other
                    out.append((min(a, nodes[k]), max(a, nodes[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _rest_links(left: DataFrame, classes: DataFrame, docs: DataFrame, words: int, similar: int) -> DataFrame:
    """Links of members outside their region's largest component with members of its other components; cut.

    A region is dealt into blocks of some `BLOCK` hashes of queries and as many of all its members, so no task
    holds a region; a block's sets meet in memory and only links leave it.
    """
    sized = left.join(classes.select(F.col("node").alias("a"), F.col("n_shingles").alias("n")), "a")
    parts = sized.groupBy("region", "root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    tops = parts.groupBy("region").agg(F.max(F.struct("rows", "root", "n")).alias("top"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    tops = cut(tops.select("region", F.col("top.root").alias("top"), blocks(F.col("n")).alias("of_rows"), blocks(F.col("n") - F.col("top.n")).alias("of_asks")))
    dealt = left.join(small(tops), "region")
    own = lambda n: F.pmod(F.xxhash64("a"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = dealt.filter(F.col("root") != F.col("top")).select("region", "a", "root", F.lit(True).alias("query"), own("of_asks").alias("i"), every("of_rows").alias("j"))
    rows = dealt.select("region", "a", "root", F.lit(False).alias("query"), own("of_rows").alias("j"), every("of_asks").alias("i"))
    sets = _sets_of(left.select(F.col("a").alias("node")).distinct(), classes, docs, words)
    held = asks.unionByName(rows).join(sets.withColumnRenamed("node", "a"), "a")
    return cut(held.groupBy("region", "i", "j").applyInPandas(_block_links(similar), "a long, b long").distinct())


def near_classes(docs: DataFrame, words: int = 5, similar: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a row for each row of docs: none, id, mark, n_shingles, key; classes: key, node, first (its first document); node to root of linked classes)."""
    ship(docs.sparkSession)
    texts = docs.select(*identity(), F.col("text").cast("binary").alias("text"))
    signed = cut(texts.mapInArrow(_sign(words), "none boolean, id long, mark int, n_shingles long, key binary, sign binary").withColumn("tag", F.monotonically_increasing_id()))
    some = signed.filter(F.col("key").isNotNull())
    classes = cut(some.groupBy("key").agg(F.min("tag").alias("node"), F.min(F.struct(*WHO)).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("sign").alias("sign")))
    trees = classes.select("node", F.col("n_shingles").alias("n"), "sign", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    forest = trees.select("tree", F.expr(f"substring(sign, tree * {4 * DEPTH} + 1, {4 * DEPTH})").alias("prefix"), "node", "n")
    # a range is held in memory at once
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-TREES * classes.count() // RANGE))
    ordered = forest.repartitionByRange(ranges, "tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node")
    found = cut(ordered.mapInArrow(_neighbours(similar), "a long, b long, region binary"))
    pairs = found.filter(F.col("region").isNull()).select("a", "b").unionByName(_across(found))
    roots = components(links(pairs, classes, docs, words, similar))
    members = found.filter(F.col("b").isNull()).select("region", "a")
    left = _open_regions(members, roots)
    if not left.isEmpty():
        roots = joined(roots, _rest_links(left, classes, docs, words, similar))
    return signed, classes, cut(roots)


def _marked(docs: DataFrame, words: int, similar: int) -> DataFrame:
    """none, id, mark, n_shingles, component (none, id and mark of the first document that links reach)."""
    signed, classes, roots = near_classes(docs, words, similar)
    linked = classes.select("key", "node", "first").join(roots, "node")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component"))
    by_key = linked.join(smallest, "root").select("key", "component").unionByName(
        classes.join(roots.select("node"), "node", "left_anti").select("key", F.col("first").alias("component"))
    )
    out = signed.select(*WHO, "n_shingles", "key").join(by_key, "key", "left")
    return out.select(*WHO, "n_shingles", F.when(F.col("key").isNull(), F.struct(*WHO)).otherwise(F.col("component")).alias("component"))


def near_duplicates(docs: DataFrame, words: int = 5, similar: int = 80) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_shingles, component_id, kept.

    Words are what blanks separate after lower-casing A-Z; a document's set is that of its distinct shingles of
    `words` words, or all its words as one shingle if it has fewer. Documents are linked if their sets share
    `similar` % of their union. component_id is the smallest doc_id reachable over links, and its document is kept. A
    document without words has no shingles and no links. Documents without doc_id come after all others, in some
    fixed order: component_id is null where links reach no others. Rows that share a doc_id but not the text are
    documents of their own; rows that share both are marked alike. An empty table gives no rows. Other columns are
    not read.
    """
    first = F.struct(*WHO) == F.col("component")
    return _marked(docs, words, similar).select(doc_id_of("none", "id").alias("doc_id"), "n_shingles", doc_id_of("component.none", "component.id").alias("component_id"), first.alias("kept"))


def near_dedup(docs: DataFrame, words: int = 5, similar: int = 80) -> DataFrame:
    """The rows of `docs` that near_duplicates keeps, one document of each component, with the columns of `docs`.

    Ids of dropped documents meet the rows, by a broadcast while they are few; texts aren't shuffled then. Rows that
    share doc_id and text stay or leave together; documents without words all stay. An empty table stays empty.
    """
    dropped = cut(_marked(docs, words, similar).filter(F.struct(*WHO) != F.col("component")).select(*WHO).distinct())
    # as a struct, the columns of `docs` can't clash with those of the join
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *identity())
    return rows.join(small(dropped), same_document(rows, dropped), "left_anti").select("row.*")


#: An exact join over all shingles; fit for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON r.doc_id = e.x
), c AS (
  SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1
)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""
