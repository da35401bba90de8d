"""Long repeated strings, told by a run-length index of a repetitive corpus.

A string of `match` bytes is dealt by its rarest-looking part: the gram of the least hash in it, which is the same
wherever the string stands. Neighbouring strings that share it make one run of a text, so equal strings lie in runs of
the same key, and a text is cut into few runs. Only runs whose key comes back are looked at. Equal runs are one
sequence with a number of occurrences, and the sequences of some keys, a few megabytes together, make a bin.

For each bin a Burrows-Wheeler transform is built and kept as runs of equal bytes with the text positions of both
ends of each run (the samples of an r-index). Longest common prefixes with a suffix's neighbours have to be compared
at those ends only; streamed over the text, every other position's is that of the position before less one. So
the stream gives each position's longest match elsewhere, and matches of `match` bytes are marked.

A key whose sequences alone exceed a bin is dealt again by the least gram in another order of hashes, several
times if need be, and what is left then is dealt string by string, so no bin grows with the corpus.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import WHO, cut, drop_folder, identity, release, same_document, shared_folder, ship, small, tidy

MATCH = 200
#: Bytes of a bin's sequences at most (half of it on average), strings of a run at most, strings looked at together, and orders of hashes tried.
BIN, MOST, SLICE, LEVELS = 1_500_000, 4096, 1 << 19, 4

_MIX, _MIX2, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), 0xD1342543DE82EF95
_PLACE = np.uint64((1 << 20) - 1)


def _gram_hashes(raw: np.ndarray, gram: int, level: int) -> np.ndarray:
    """A hash of each `gram` neighbouring bytes; other levels order them differently."""
    part, size, power = (raw.astype(np.uint64) + np.uint64(1)) * _MIX, 1, _BASE
    out, done = None, 0
    while True:  # hashes of 1, 2, 4, ... bytes make up the wanted length
        if gram & size:
            n = len(raw) - done - size + 1
            out = part if out is None else out[:n] * np.uint64(power) + part[done : done + n]
            done += size
        if size * 2 > gram:
            break
        n = len(part) - size
        part = part[:n] * np.uint64(power) + part[size : size + n]
        size, power = size * 2, power * power % (1 << 64)
    out = out ^ out >> np.uint64(29) ^ np.uint64(level * 0x94D049BB133111EB % (1 << 64))
    out *= _MIX2
    out ^= out >> np.uint64(32)
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    some, k = values, 1
    while 2 * k <= width:
        some, k = np.minimum(some[:-k], some[k:]), 2 * k
    n = len(values) - width + 1
    return np.minimum(some[:n], some[width - k : width - k + n])


def text_runs(data: bytes, match: int = MATCH, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's strings of `match` bytes, in runs of one key: key, first string, number of strings, and whether the run may repeat itself."""
    gram = max(1, match * 8 // 25)
    width, n = match - gram + 1, len(data) - match + 1
    raw, found = np.frombuffer(data, dtype=np.uint8), []
    for at in range(0, max(n, 0), SLICE):
        h = _gram_hashes(raw[at : at + SLICE + match - 1], gram, level)
        place = (_least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), width) & _PLACE).astype(np.int64)
        key = h[place]
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.append(begins[1:], len(key))
        if (ends - begins).max() > MOST:
            begins = np.concatenate([np.arange(b, e, MOST) for b, e in zip(begins, ends)])
            ends = np.append(begins[1:], len(key))
        # equal strings have their first least gram at the same place of them, so a run around one place has none
        found.append((key[begins].view(np.int64), begins + at, ends - begins, place[begins] != place[ends - 1]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else tuple(np.empty(0, dtype=np.int64) for _ in range(4))


#: span: first string, number of strings and whether the run may repeat itself, in one number.
RUNS = "key long, digest long, none boolean, id long, mark int, span long"


def _start(span: str) -> F.Column:
    return F.shiftright(span, 14)


def _length(span: str) -> F.Column:
    return F.shiftright(span, 1).bitwiseAND(8191)


def _weight(span: str) -> F.Column:
    return F.col(span).bitwiseAND(1) + 1


def _digests(data: bytes, start: np.ndarray, length: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(start.tolist(), (start + length).tolist())]


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c.cast(kinds[k]) if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names)], names=[n for n, _ in names])


def _all_runs(match: int, rows: int = 128):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                few = batch.slice(at, rows)
                keys, digests, counts, spans = [], [], [], []
                for text in few.column(3):
                    data = text.as_py() or b""
                    key, start, n, again = text_runs(data, match)
                    keys.append(key)
                    digests += _digests(data, start, n + match - 1)
                    counts.append(len(key))
                    spans.append(start << 14 | n << 1 | again)
                who = [np.repeat(c.to_numpy(zero_copy_only=False), counts) for c in few.columns[:3]]
                yield _batch([np.concatenate(keys), np.array(digests, dtype=np.uint64).view(np.int64), *who, np.concatenate(spans)], RUNS)
        release()

    return run


#: times: how often the sequence occurs.
SEQUENCES = "key long, digest long, times long, seq binary"


def _cut_out(match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, wanted in zip(batch.column(0), batch.column(1)):
                data, some = data.as_py() or b"", wanted.values.flatten()
                key, digest, times, span = (c.to_numpy() for c in some)
                start, n = span >> 14, (span >> 1) & 8191
                yield _batch([key, digest, times, [data[a:b] for a, b in zip(start.tolist(), (start + n + match - 1).tolist())]], SEQUENCES)
        release()

    return run


#: weight: times, twice that for what may repeat itself.
CHILDREN = "pkey long, pdigest long, key long, digest long, times long, weight long, at long, seq binary"


def _deal_again(match: int, level: int):
    """The runs of sequences in another order of hashes; at the last level each string by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pkey, pdigest, times, seq in zip(*(c.to_pylist() for c in batch.columns)):
                if level < LEVELS:
                    key, start, n, again = text_runs(seq, match, level)
                else:
                    start = np.arange(len(seq) - match + 1)
                    key, n, again = np.zeros(len(start), dtype=np.int64), np.ones(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
                digest = np.array(_digests(seq, start, n + match - 1), dtype=np.uint64).view(np.int64)
                # a key of the parent's and the own one, so that keys of other parents stay apart
                own = ((key if level < LEVELS else digest).view(np.uint64) * _MIX ^ np.uint64(pkey % (1 << 64))) * _MIX2
                pieces = [seq[a:b] for a, b in zip(start.tolist(), (start + n + match - 1).tolist())]
                yield _batch([np.full(len(start), pkey), np.full(len(start), pdigest), own.view(np.int64), digest, np.full(len(start), times), times * (1 + again.astype(np.int64)), start, pieces], CHILDREN)
        release()

    return run


@dataclass
class RunIndex:
    """A Burrows-Wheeler transform as runs: the byte of each, where it begins, and the text positions of its ends' suffixes."""

    byte: np.ndarray
    begin: np.ndarray
    first: np.ndarray
    last: np.ndarray


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes. `words` holds the 7 symbols at each position as one number."""
    n = len(words)
    bits = n.bit_length()
    parts = 3 if 3 * bits < 64 else 2  # ranks that one number holds
    order = np.argsort(words)
    held = words[order]
    head = np.concatenate(([True], held[1:] != held[:-1]))
    begins = np.flatnonzero(head)
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = 0  # beyond the end: less than all, as no rank is 0 below
    rank[order] = np.repeat(begins, np.diff(np.append(begins, n))) + 1
    alone = head & np.append(head[1:], True)
    left, depth = order[~alone], 7
    while len(left):  # ranks of `depth` symbols, side by side, are one of two or three times as many
        key = rank[left]
        for k in range(1, parts):
            key = key << bits | rank[np.minimum(left + k * depth, n)]
        by = np.argsort(key)
        left, key = left[by], key[by]
        head = np.concatenate(([True], key[1:] != key[:-1]))
        begins = np.flatnonzero(head)
        old = key >> bits * (parts - 1)
        group = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
        offset = np.arange(len(left)) - np.repeat(group, np.diff(np.append(group, len(left))))
        rank[left] = old + np.repeat(offset[begins], np.diff(np.append(begins, len(left))))
        left, depth = left[~(head & np.append(head[1:], True))], depth * parts
    out = np.empty(n, dtype=np.int64)
    out[rank[:n] - 1] = np.arange(n)
    return out


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes at a and b share, `most` at most."""
    out = most.copy()
    live, n = np.arange(len(a)), 0
    while len(live):
        x = words[a[live] + n] ^ words[b[live] + n]
        differ = np.flatnonzero(x)
        same = np.zeros(len(differ), dtype=np.int64)
        for k in range(1, 7):
            same += x[differ] >> np.uint64(63 - 9 * k) == 0
        out[live[differ]] = np.minimum(n + same, most[live[differ]])
        n += 7
        live = live[(x == 0) & (most[live] > n)]
    return out


def longest_elsewhere(sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray, RunIndex]:
    """(for each position of the sequences, each followed by one more, the length of its longest match at another position; where they begin; the index)."""
    sizes = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
    ends = np.cumsum(sizes + 1) - 1  # of a separator, less than any byte
    n = int(ends[-1]) + 1
    text = np.frombuffer(b"\0".join(sequences) + b"\0", dtype=np.uint8).astype(np.uint16) + np.uint16(1)
    text[ends] = 0
    padded = np.concatenate((text, np.zeros(8, dtype=np.uint16))).astype(np.uint64)
    words = np.zeros(n + 1, dtype=np.uint64)
    for k in range(7):
        words = words << np.uint64(9) | padded[k : n + 1 + k]
    order = suffix_array(words[:n])
    before = text[order - 1]  # of the first position it is the last separator
    # a separator never continues a run: no match goes over it
    head = np.concatenate(([True], (before[1:] != before[:-1]) | (before[1:] == 0)))
    begin = np.flatnonzero(head)
    last = np.append(begin[1:], n) - 1
    index = RunIndex(before[begin], begin, order[begin], order[last])
    rest = np.repeat(ends, sizes + 1) - np.arange(n)
    # a run's first suffix follows the last one of the run before; those are all that has to be compared
    shared = _common(words, index.first[1:], index.last[:-1], np.minimum(rest[index.first[1:]], rest[index.last[:-1]]))
    longest = np.zeros(n, dtype=np.int64)
    for ends_at, lengths in ((index.first, np.append([0], shared)), (index.last, np.append(shared, [0]))):
        known = np.zeros(n, dtype=np.int64)
        at = np.zeros(n, dtype=np.int64)
        known[ends_at], at[ends_at] = lengths, ends_at
        at = np.maximum.accumulate(at)
        np.maximum(longest, known[at] - (np.arange(n) - at), out=longest)
    return longest, ends - sizes, index


MARKS = "key long, digest long, first long, n long"


def _mark(match: int):
    def run(table: pa.Table) -> pa.Table:
        rows = {(k, d): (t, s) for k, d, t, s in zip(*(table.column(c).to_pylist() for c in ("key", "digest", "times", "seq")))}
        who = list(rows)
        longest, begins, _ = longest_elsewhere([s for _, s in rows.values()])
        sizes = np.array([len(s) for _, s in rows.values()])
        times = np.array([t for t, _ in rows.values()])
        again = (longest >= match) | np.repeat(times > 1, sizes + 1)
        # only where a whole string is left of the sequence
        again &= np.arange(len(longest)) <= np.repeat(begins + sizes - match, sizes + 1)
        edges = np.diff(np.concatenate(([0], again.astype(np.int8), [0])))
        first, after = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        owner = np.searchsorted(begins, first, "right") - 1
        columns = [np.array([who[k][c] for k in owner], dtype=np.int64) for c in (0, 1)]
        release()
        return pa.table([*map(pa.array, columns), pa.array(first - begins[owner]), pa.array(after - first)], names=["key", "digest", "first", "n"])

    return run


class _Written:
    """Tables written into one folder of the shared one, read again, and deleted together."""

    def __init__(self, spark):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/run-index-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.parquet(f"{self.folder}/{self.n}")

    def drop(self) -> None:
        drop_folder(self.spark, self.folder)


def _recurring(rows: DataFrame, weight: F.Column) -> DataFrame:
    """key: those that occur twice or more; cut."""
    return cut(rows.groupBy("key").agg(F.sum(weight).alias("weight")).filter("weight > 1").select("key"))


def _marks(sequences: DataFrame, match: int, level: int, written: _Written, bin_bytes: int) -> DataFrame:
    """key, digest, first, n: runs of strings of the sequences (a written table) that occur elsewhere; written."""
    sizes = sequences.groupBy("key").agg(F.sum(F.length("seq") + 1).alias("bytes"))
    total = cut(sizes.groupBy((F.col("bytes") > bin_bytes).alias("hot")).agg(F.sum("bytes").alias("bytes")))
    found = {r.hot: r.bytes for r in total.collect()}
    hot = small(cut(sizes.filter(F.col("bytes") > bin_bytes).select("key"))) if True in found else None
    bins = max(1, -(-2 * found.get(False, 0) // bin_bytes))
    calm = sequences if hot is None else sequences.join(hot, "key", "left_anti")
    binned = calm.withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(bins)))
    marks = written(binned.repartition(min(bins, 20_000), "bin").groupBy("bin").applyInArrow(_mark(match), MARKS))
    if hot is None:
        return marks
    ready = sequences.join(hot, "key", "left_semi").select("key", "digest", "times", "seq").dropDuplicates(["key", "digest"])
    children = written(ready.mapInArrow(_deal_again(match, level + 1), CHILDREN))
    some = children.join(_recurring(children, F.col("weight")), "key")
    distinct = written(some.groupBy("key", "digest").agg(F.sum("times").alias("times"), F.first("seq").alias("seq")))
    if level + 1 < LEVELS:
        inner = _marks(distinct, match, level + 1, written, bin_bytes)
    else:  # strings by themselves: each is as often there as counted
        inner = distinct.filter("times > 1").select("key", "digest", F.lit(0).cast("long").alias("first"), F.lit(1).cast("long").alias("n"))
    outer = some.select("key", "digest", "pkey", "pdigest", "at").join(inner, ["key", "digest"]).select(F.col("pkey").alias("key"), F.col("pdigest").alias("digest"), (F.col("at") + F.col("first")).alias("first"), "n")
    return marks.unionByName(written(outer))


def _removed(docs: DataFrame, match: int, bin_bytes: int) -> DataFrame:
    """none, id, mark, spans (array of start, end in bytes; sorted, they may overlap) of the documents that have repeated strings; cut."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(*identity(), F.col("text").cast("binary").alias("text"))
    written = _Written(spark)
    try:
        runs = written(texts.mapInArrow(_all_runs(match), RUNS))
        again = written(runs.join(_recurring(runs, _weight("span")), "key"))
        distinct = again.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(*WHO, "span")).alias("place"))
        # each sequence is read once, from its first place; a document has no more of them than its text is long
        wanted = distinct.groupBy("place.none", "place.id", "place.mark").agg(F.collect_list(F.struct("key", "digest", "times", F.col("place.span").alias("span"))).alias("wanted"))
        wanted = cut(wanted)
        tidy(wanted)
        one = texts.join(wanted, WHO).select("text", "wanted")
        sequences = written(one.mapInArrow(_cut_out(match), SEQUENCES))
        marks = _marks(sequences, match, 0, written, bin_bytes)
        at = _start("span") + F.col("first")
        spans = again.join(marks, ["key", "digest"]).select(*WHO, F.struct(at.alias("start"), (at + F.col("n") + (match - 1)).alias("end")).alias("span"))
        found = cut(spans.groupBy(*WHO).agg(F.array_sort(F.collect_set("span")).alias("spans")))
        tidy(found)
        return found
    finally:
        written.drop()


def _kept(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[list[tuple[int, int]], list[bytes]]:
    """(the maximal removed runs, the parts between them)."""
    runs: list[tuple[int, int]] = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    left = [0, *(b for _, b in runs)]
    return runs, [data[a:b] for a, b in zip(left, [*(a for a, _ in runs), len(data)])]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _spans_of(row) -> tuple[np.ndarray, np.ndarray]:
    if not row.is_valid:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    a, b = row.values.flatten()
    return a.to_numpy(), b.to_numpy()


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1), batch.column(2)):
            data = text.as_py() or b""
            runs, parts = _kept(data, *_spans_of(spans))
            sha = hashlib.sha256()
            for part in parts:
                sha.update(part)
            rows.append((len(data), sum(b - a for a, b in runs), len(runs), sha.hexdigest()))
        sizes, removed, n, sha = zip(*rows) if rows else ((), (), (), ())
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip((sizes, removed, n, sha), kinds)]], names=[x.split()[0] for x in RESULT.split(", ")])
    release()


def _with_spans(docs: DataFrame, match: int, bin_bytes: int) -> DataFrame:
    """row (all columns of `docs`), spans."""
    found = _removed(docs, match, bin_bytes)
    # as a struct, the columns of `docs` can't clash with those of the join
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *identity())
    return rows.join(found, same_document(rows, found), "left").select("row", "spans")


def long_repeats(docs: DataFrame, match: int = MATCH, bin_bytes: int = BIN) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts count as UTF-8 bytes, null as empty. A byte is removed if a string of `match` bytes over it also starts anywhere
    else, in any text or the same one, overlaps included; strings are judged on the input. n_spans counts
    the maximal removed runs, kept_sha256 is of the other bytes in their order. Rows that repeat a row, with the same
    doc_id or without one, are documents of their own, so a repeated row of `match` bytes is removed in all copies. Texts of
    fewer bytes stay. An empty table gives no rows. Other columns are not read.
    """
    few = docs.select("doc_id", "text")
    rows = _with_spans(few, match, bin_bytes)
    return rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("binary").alias("text"), "spans").mapInArrow(_told, RESULT)


def without_repeats(docs: DataFrame, match: int = MATCH, bin_bytes: int = BIN) -> DataFrame:
    """`docs` with the bytes that `long_repeats` removes cut out of the texts; characters that a cut parts leave with it.

    All rows and columns stay, null texts too.
    """

    @F.pandas_udf("string")
    def cut_out(text, spans):
        def one(t, s):
            if t is None or s is None:
                return t
            starts, ends = (np.array([x[k] for x in s], dtype=np.int64) for k in ("start", "end"))
            return b"".join(_kept(t.encode(), starts, ends)[1]).decode("utf-8", "ignore")

        return text.combine(spans, one)

    return _with_spans(docs, match, bin_bytes).withColumn("row", F.col("row").withField("text", cut_out(F.col("row.text"), F.col("spans")))).select("row.*")


#: Every string by itself, as hexadecimal digits; fit for small tables.
ORACLE = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (
  SELECT doc_id, c, substr(h, 400 * c + 1, 798) AS x FROM (SELECT doc_id, h, unnest(range(length(h) // 400)) AS c FROM d WHERE length(h) >= 400)
), w AS (
  SELECT doc_id, 200 * c + j AS i, count(*) OVER (PARTITION BY md5(substr(x, 2 * j + 1, 400))) AS n FROM (SELECT doc_id, c, x, unnest(range(length(x) // 2 - 199)) AS j FROM p)
), g AS (
  SELECT doc_id, i, i > coalesce(lag(i) OVER v + 200, -1) AS fresh FROM w WHERE n > 1 WINDOW v AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g
), s AS (
  SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM r GROUP BY doc_id, run
), k AS (
  SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM s UNION ALL SELECT doc_id, 0, min(a) FROM s GROUP BY 1
), t AS (
  SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY 1
), c AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM s GROUP BY 1
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
"""
