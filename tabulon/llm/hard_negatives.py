"""Hard negatives by inner product, with an orthogonal rotation to principal components.

Products don't change when all vectors are rotated. After a rotation to the principal components (of second moments) the
leading components hold most of a product: their partial product, give or take the product of the residuals'
lengths and a slack for rounding, bounds it on either side. Anchors meet all rows in blocks; pairs whose bounds rule
them out are discarded after a quarter of the components, more after half, and the survivors are verified
with products of the integers themselves. Each block keeps its best few rows of an anchor, so groups of
a label or of equal vectors, whatever their size, are spread over the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabulon.llm.common import cut, release, ship

#: Rows and anchors of a block on average, anchors looked at together, and pairs verified together.
ROWS, ANCHORS, TOGETHER, PAIRS = 8192, 4096, 256, 1 << 15


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vector (array<long>), tag: the rows that take part; cut.

    Rows with a null vec_id, label or vector, or with a null or non-finite component, don't. Components become floor(256 * x); where
    vec_id is divisible by 7, label becomes (label + 1) % 10. tag tells rows apart that share a vec_id.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    id_, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return cut(some.select(id_.alias("vec_id"), F.when(id_ % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label).alias("label"), vector.alias("vector"), F.monotonically_increasing_id().alias("tag")))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """The vectors as rows of `dims` integers; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def _moments(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((dims, dims))
        for batch in batches:
            x = _matrix(batch.column(0), dims).astype(float)
            held += x.T @ x
        i, j = np.indices((dims, dims)).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(held.ravel())], names=["i", "j", "v"])
        release()

    return run


def rotation(rows: DataFrame, dims: int) -> np.ndarray:
    """Orthogonal columns, those of the largest second moments of `rows` first. What reaches the driver is `dims` squared numbers."""
    sums = rows.select("vector").mapInArrow(_moments(dims), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    moments = np.zeros((dims, dims))
    for r in sums:
        moments[r.i, r.j] = r.v
    return np.ascontiguousarray(np.linalg.eigh(moments)[1][:, ::-1])


class _Block:
    """The rows of a block and some anchors, rotated, with the lengths of what the leading components leave."""

    def __init__(self, x: np.ndarray, q: np.ndarray, turn: np.ndarray):
        self.x, self.q = x, q
        self.xs, self.qs = x.astype(float) @ turn, q.astype(float) @ turn
        dims = x.shape[1]
        self.steps = sorted({max(1, dims // 4), max(1, dims // 2)})
        length = lambda v: np.sqrt((v * v).sum(axis=1))
        self.x_rest = {c: length(self.xs[:, c:]) for c in self.steps}
        self.q_rest = {c: length(self.qs[:, c:]) for c in self.steps}
        # what rounding can add to a product of rotated vectors
        slack = 8 * dims**1.5 * 2.0**-52
        self.x_slack, self.q_slack = slack * length(self.xs), length(self.qs)

    def first(self, anchors: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Partial products of the anchors with all rows, and bounds on the whole ones."""
        c = self.steps[0]
        part = self.qs[anchors, :c] @ self.xs[:, :c].T
        room = self.q_rest[c][anchors, None] * self.x_rest[c][None, :] + self.q_slack[anchors, None] * self.x_slack[None, :] + 1e-9
        return part, part - room, part + room

    def further(self, part: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds after all steps, of pairs of an anchor and a row."""
        for before, c in zip(self.steps, self.steps[1:]):
            part = part + _products(self.qs[:, before:c], self.xs[:, before:c], a, b)
        c = self.steps[-1]
        room = self.q_rest[c][a] * self.x_rest[c][b] + self.q_slack[a] * self.x_slack[b] + 1e-9
        return part - room, part + room


def _products(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), dtype=q.dtype)
    for at in range(0, len(a), PAIRS):
        some = slice(at, at + PAIRS)
        out[some] = np.einsum("ij,ij->i", q[a[some]], x[b[some]])
    return out


def _least_of_best(low: np.ndarray, wanted: np.ndarray, k: int) -> np.ndarray:
    """For each anchor a bound that its k best rows reach: the k-th largest of `low` among the wanted ones, or -inf."""
    if low.shape[1] < k:
        return np.full(len(low), -np.inf)
    return np.partition(np.where(wanted, low, -np.inf), low.shape[1] - k, axis=1)[:, -k]


def _pair_bounds(low: np.ndarray, group: np.ndarray, sure: np.ndarray, groups: int, k: int) -> np.ndarray:
    """The same for pairs, by group."""
    out = np.full(groups, -np.inf)
    some = np.flatnonzero(sure)
    order = some[np.lexsort((-low[some], group[some]))]
    sizes = np.bincount(group[some], minlength=groups)
    ends = np.cumsum(sizes)
    enough = np.flatnonzero(sizes >= k)
    out[enough] = low[order[ends[enough] - sizes[enough] + k - 1]]
    return out


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, tags: np.ndarray, k: int) -> np.ndarray:
    """The first k of each group: by score, then smaller id, then tag."""
    order = np.lexsort((tags, ids, -score, group))
    sorted_groups = group[order]
    begins = np.concatenate(([0], np.flatnonzero(sorted_groups[1:] != sorted_groups[:-1]) + 1)) if len(order) else np.empty(0, dtype=np.int64)
    rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return order[rank < k]


FOUND = "anchor long, positive long, id long, tag long, score long"


def _search(turn: np.ndarray, k: int, low: int | None, high: int | None):
    """A block's part of the search: the k best rows of the anchor's label, or, with limits in %, of other labels below each positive."""
    dims = len(turn)

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
        rows, anchors = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
        out = []
        if rows.num_rows and anchors.num_rows:
            block = _Block(_matrix(rows.column("vector"), dims), _matrix(anchors.column("vector"), dims), turn)
            ids, tags, labels = (rows.column(c).to_numpy() for c in ("vec_id", "tag", "label"))
            own, own_labels = anchors.column("tag").to_numpy(), anchors.column("label").to_numpy()
            positives = anchors.column("positives").to_pylist() if low is not None else None
            for at in range(0, len(own), TOGETHER):
                some = slice(at, min(at + TOGETHER, len(own)))
                part, least, most = block.first(some)
                same = own_labels[some, None] == labels[None, :]
                if low is None:
                    wanted = same & (own[some, None] != tags[None, :])
                    wanted &= most >= _least_of_best(least, wanted, k)[:, None]
                    a, b = np.nonzero(wanted)
                    under, over = block.further(part[a, b], a + at, b)
                    fit = over >= _pair_bounds(under, a, np.ones(len(a), dtype=bool), len(part), k)[a]
                    a, b = a[fit] + at, b[fit]
                    score = _products(block.q, block.x, a, b)
                    keep = _best(a, score, ids[b], tags[b], k)
                    out.append((own[a[keep]], np.full(len(keep), -1), ids[b[keep]], tags[b[keep]], score[keep]))
                    continue
                given = positives[some]
                tops = np.array([[p[n]["score"] if n < len(p) else p[0]["score"] for n in range(max(map(len, given)))] for p in given], dtype=np.int64)
                # of all positives together once; then each looks at what this leaves
                wanted = ~same & (most >= tops.min(axis=1)[:, None] * (low / 100) - 1) & (least <= tops.max(axis=1)[:, None] * (high / 100) + 1)
                a, b = np.nonzero(wanted)
                under, over = block.further(part[a, b], a + at, b)
                for n, top in enumerate(tops.T):
                    has = np.array([n < len(p) for p in given])
                    floor, cap = (top * low / 100)[a], (top * high / 100)[a]
                    fit = has[a] & (over >= floor - 1) & (under <= cap + 1)
                    inside = fit & (over <= cap - 1) & (under >= floor + 1)
                    fit &= over >= _pair_bounds(under, a, inside, len(part), k)[a]
                    x, y = a[fit], b[fit]
                    score = _products(block.q, block.x, x + at, y)
                    right = (score * 100 >= top[x] * low) & (score * 100 <= top[x] * high)
                    x, y, score = x[right], y[right], score[right]
                    keep = _best(x, score, ids[y], tags[y], k)
                    tag = np.array([p[n]["tag"] if n < len(p) else -1 for p in given])
                    out.append((own[x[keep] + at], tag[x[keep]], ids[y[keep]], tags[y[keep]], score[keep]))
        columns = [np.concatenate([o[c] for o in out]).astype(np.int64) if out else np.empty(0, dtype=np.int64) for c in range(5)]
        release()
        return pa.table([pa.array(c) for c in columns], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def _in_blocks(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, search) -> DataFrame:
    """`search` over each block of rows with each block of anchors (a row set and a stated query set; both of bounded size)."""
    blocks = lambda n, of: max(1, -(-n // of))
    i, j = blocks(n_rows, ROWS), blocks(n_anchors, ANCHORS)
    own = lambda n: F.pmod(F.xxhash64("tag"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind = anchors.schema["positives"].dataType
    left = rows.select("vec_id", "tag", "label", "vector", F.lit(None).cast(kind).alias("positives"), F.lit(False).alias("query"), own(i).alias("i"), every(j).alias("j"))
    right = anchors.select("vec_id", "tag", "label", "vector", "positives", F.lit(True).alias("query"), own(j).alias("j"), every(i).alias("i"))
    return left.unionByName(right).groupBy("i", "j").applyInArrow(search, FOUND)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, of quantised's `rows`.

    Anchors are the rows for which `anchor` holds. An anchor's positives are its first `positives` other rows of its label:
    those with the largest product, of equal ones the smaller vec_id. For each of them come the first `negatives` rows of
    other labels whose product is at least `low` % and at most `high` % of the positive's, with rank from 1. An anchor
    without another row of its label, or a positive without such rows, gives none. Rows that share a vec_id are rows of
    their own. Vectors of different lengths count as if the shorter ended in zeros; products must fit into a long. An empty
    table gives no rows.
    """
    ship(rows.sparkSession)
    sized = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims")).first()
    asks = rows.filter(anchor)
    dims, n_anchors = max(1, sized.dims or 0), asks.count()
    turn = rotation(rows, dims) if sized.n else np.eye(dims)
    no = asks.withColumn("positives", F.lit(None).cast("array<struct<tag:long,score:long>>"))
    best = lambda *by: W.partitionBy(*by).orderBy(F.desc("score"), "id", "tag")
    near = _in_blocks(rows, no, sized.n, n_anchors, _search(turn, positives, None, None))
    # the best of each block; Spark limits each task's share before it shuffles
    near = cut(near.withColumn("r", F.row_number().over(best("anchor"))).filter(F.col("r") <= positives).select("anchor", F.col("tag").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    given = near.groupBy("anchor").agg(F.collect_list(F.struct(F.col("positive").alias("tag"), F.col("positive_score").alias("score"))).alias("positives"))
    ready = cut(asks.join(given.withColumnRenamed("anchor", "tag"), "tag"))
    far = _in_blocks(rows, ready, sized.n, n_anchors, _search(turn, negatives, low, high))
    far = far.withColumn("rank", F.row_number().over(best("anchor", "positive"))).filter(F.col("rank") <= negatives)
    names = asks.select(F.col("tag").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return far.join(near, ["anchor", "positive"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def mined(embeddings: DataFrame) -> DataFrame:
    """`hard_negatives` of an embedding table (vec_id, embedding, label; other columns are not read): anchors are the rows whose vec_id is divisible by 100."""
    return hard_negatives(quantised(embeddings), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id != b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""
