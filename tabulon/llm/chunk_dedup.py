"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text; a chunk ends where the hash of the last `WINDOW` bytes is the least within
`REACH` bytes on either side, so chunks depend on the bytes around their ends only, and an insertion changes the
chunks that it touches. Such ends lie more evenly than those below a threshold, so fewer chunks find as short passages.
As short chunks are equal by chance or habit, the unit that is deduplicated is a block: from each chunk on, the
fewest chunks that have `least` bytes together. Blocks of all texts meet by a digest of 96 bits; the first occurrence
stays. Neighbouring blocks that occurred before make a repeated passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabulon.llm.common import WHO, cut, doc_id_of, identity, release, same_document, ship, small, tidy

WINDOW, REACH, MOST = 16, 16, 512  # bytes: that a hash is of, on either side of an end, of a chunk at most
LEAST = 72  # bytes of a block: of 3,000 passages of 51 short words 0.2 % hold none, and of clean texts few repeat so much by chance

#: One random 32-bit number for each byte.
_GEAR = np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint32)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    some, k = values, 1
    while 2 * k <= width:
        some, k = np.minimum(some[:-k], some[k:]), 2 * k
    n = len(values) - width + 1
    return np.minimum(some[:n], some[width - k : width - k + n])


def chunk_ends(data: bytes, at_once: int = 1 << 20) -> np.ndarray:
    """Where chunks end (exclusive), ascending; the last is the text's length."""
    n, found = len(data), []
    raw, beyond = np.frombuffer(data, dtype=np.uint8), np.full(REACH, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, n, at_once):
        low = max(0, at - REACH)
        begin = max(0, low - WINDOW + 1)
        h = _GEAR[raw[begin : at + at_once + REACH]]
        step = 1
        while step < WINDOW:  # after each pass, h holds twice as many bytes
            h[step:] += h[:-step] << np.uint32(step)
            step *= 2
        h = h[low - begin :]
        around = _least(np.concatenate((beyond, h, beyond)), REACH)
        # the first of equal ones; a text of one byte over and over has none
        ends = np.flatnonzero((h < around[: len(h)]) & (h <= around[REACH + 1 : REACH + 1 + len(h)])) + low + 1
        found.append(ends[(ends > at) & (ends <= at + at_once)])
    ends = np.concatenate([*found, [n]]) if n else np.empty(0, dtype=np.int64)
    if n and len(ends) > 1 and ends[-2] == n:
        ends = ends[:-1]
    sizes = np.diff(ends, prepend=0)
    if n and sizes.max() > MOST:  # equal parts of what has no end for long
        ends = np.concatenate([np.append(np.arange(e - s + MOST, e, MOST), e) for e, s in zip(ends, sizes)])
    return ends


def blocks(data: bytes, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks begin and end. The last ends with the text; a text of less than `least` bytes is one block."""
    ends = chunk_ends(data)
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    last = np.searchsorted(ends, begins + least)
    whole = last < len(ends)
    if not whole.any():
        return np.zeros(min(len(ends), 1), dtype=np.int64), ends[-1:]
    a, b = begins[whole], ends[last[whole]]
    return (a, b) if b[-1] == len(data) else (np.append(a, a[-1]), np.append(b, len(data)))


#: span: start, length and whether the block ends its text, in one number that orders as the start does, as blocks are many.
SCHEMA = "digest long, check int, none boolean, id long, mark int, span long"
_LENGTHS = 20  # bits of the span below the start


def _start(span: str | Column) -> Column:
    return F.shiftright(span, _LENGTHS)


def _length(span: str | Column) -> Column:
    return F.shiftright(span, 1).bitwiseAND((1 << _LENGTHS - 1) - 1)


def _last(span: str | Column) -> Column:
    return (F.col(span) if isinstance(span, str) else span).bitwiseAND(1) == 1


def _blocks(least: int, rows: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int64())
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                few = batch.slice(at, rows)
                digests, counts, spans = [], [], []
                for text in few.column(3):
                    data = text.as_py() or b""
                    a, b = blocks(data, least)
                    digests += [digest(data[x:y]) for x, y in zip(a.tolist(), b.tolist())]
                    counts.append(len(a))
                    spans.append(a << _LENGTHS | b - a << 1 | (b == len(data)))
                if not digests:
                    continue
                raw = np.frombuffer(b"".join(digests), dtype="<i8, <i4, <i4")
                who = [np.repeat(c.to_numpy(zero_copy_only=False), counts) for c in (few.column(0), few.column(1), few.column(2))]
                columns = (raw["f0"], raw["f1"], *who, np.concatenate(spans))
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])
        release()

    return run


def lean_identity(docs: DataFrame) -> DataFrame:
    """none, id, mark, text (as bytes) of `docs`; mark is 0 where no other row has the doc_id, so that it needs no room in shuffles."""
    twice = cut(docs.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("twice")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("twice"))
    rows = docs.select(*identity(), F.col("text").cast("binary").alias("text")).join(small(twice), F.col("id") == F.col("twice"), "left")
    return rows.select("none", "id", F.when(F.col("none") | F.col("twice").isNotNull(), F.col("mark")).otherwise(0).alias("mark"), "text")


def text_blocks(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """digest, check, none, id, mark, span: a row for each block of lean_identity's texts."""
    ship(rows.sparkSession)
    return rows.mapInArrow(_blocks(least), SCHEMA)


def _passages(rows: DataFrame, least: int) -> DataFrame:
    """none, id, mark, start, end, of (place of its first block's first occurrence), whole: of lean_identity's rows."""
    place = F.struct(*WHO, "span")
    # counts and first places form on the map side: a block that half of the texts share is one row a task. Blocks are
    # computed again for the join, which costs less than to write them, about the size of the texts
    found = text_blocks(rows, least)
    firsts = cut(found.groupBy("digest", "check").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    tidy(firsts)  # the shuffle's files aren't needed any more
    again = found.join(firsts, ["digest", "check"]).filter(place != F.col("first")).select(*WHO, "span", "first")
    doc = W.partitionBy(*WHO).orderBy("span")
    end = _start("span") + _length("span")
    fresh = F.coalesce(_start("span") > F.max(end).over(doc.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    runs = again.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(doc.rowsBetween(W.unboundedPreceding, 0)))
    passages = runs.groupBy(*WHO, "run").agg(F.min(_start("span")).alias("start"), F.max(end).alias("end"), F.min(F.struct("span", "first")).alias("at"), F.max(_last("span")).alias("last"))
    return passages.select(*WHO, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("at.first").alias("of"), ((F.col("start") == 0) & F.col("last")).alias("whole"))


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """A row for each repeated passage: doc_id, start, length (in UTF-8 bytes), first_doc_id, first_start, whole.

    A passage is a maximal run of blocks, overlapping or next to each other, that occur before: in a document with a
    smaller doc_id (null ones come last, in some fixed order) or earlier in the same one. So it has `least` bytes, or
    is a whole text. first_doc_id and first_start say where its first block occurs first. Rows that share a doc_id
    but not the text are documents of their own; rows that share both are one. Null and empty texts have no blocks;
    an empty table gives no rows. Other columns are not read.
    """
    return _passages(lean_identity(docs), least).select(
        doc_id_of("none", "id").alias("doc_id"), "start", (F.col("end") - F.col("start")).alias("length"), doc_id_of("of.none", "of.id").alias("first_doc_id"), _start("of.span").cast("int").alias("first_start"), "whole"
    )


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """`docs` with repeated passages cut out of the texts; characters that a cut parts leave with it.

    All rows and columns stay. Rows without doc_id, or with one that others have too, lose what their own text
    repeats only; rows that repeat a document lose the same passages. Null and empty texts, and an empty table, stay.
    """
    ship(docs.sparkSession)
    full = docs.select(*identity(), F.col("text").cast("binary").alias("text"))
    spans = _passages(full, least).groupBy(*WHO).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *identity())
    joined = rows.join(spans, same_document(rows, spans), "left").select("row", "spans")

    @F.pandas_udf("string")
    def cut_out(text, spans):
        def one(t, s):
            if t is None or s is None:
                return t
            data, out, at = t.encode(), [], 0
            for x in s:
                out.append(data[at : x["start"]])
                at = max(at, x["end"])
            return b"".join([*out, data[at:]]).decode("utf-8", "ignore")

        return text.combine(spans, one)

    return joined.withColumn("row", F.col("row").withField("text", cut_out(F.col("row.text"), F.col("spans")))).select("row.*")
