"""Best-fit packing of tokenised documents into sequences of a fixed length.

The packing is planned on the driver from the histogram of piece lengths, which has at most `capacity`
entries whatever the corpus, by a linear grouping scheme:

1. Pieces longer than `small` are sorted by length and cut into groups of equal cardinality; every length
   of a group counts as the group's largest.
2. Configurations (multisets of few group sizes that fit into one sequence) are chosen one after the other:
   a knapsack over the groups that are left gives the fullest one that holds the largest of them, which is
   used as often as they allow.
3. The pieces themselves take the places, largest first in each group. As they are no longer than their
   group's size, slack remains.
4. The small pieces, longest first, go where they leave the least room: into the slack, then into new sequences.

Bins that hold the same lengths are one run with a count throughout, so the plan has a few thousand runs,
not one for each sequence. The pieces find their places by their rank among the pieces of equal length.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabulon.llm.common import cut, release, ship

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


# ---------------------------------------------------------------- token ids


#: What keeps a text from being encoded in parts: white space other than spaces and line ends, and spaces beside white space.
_ODD = ["  ", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]

WORD_BYTES = 64 << 20  # that a Python worker keeps of words and their ids


class Encoder:
    """Texts to the tokenizer's ids (little-endian unsigned 32-bit, as bytes), by the words that were met before.

    The vocabulary's pattern never takes a space or line end after another character into one match, so a
    text that has only single spaces between words gives the same ids as its parts between spaces. Other
    texts, and those that hold one of the vocabulary's added tokens, are encoded whole. What is kept of words is
    bounded by its bytes.
    """

    def __init__(self, vocabulary: str, room: int = WORD_BYTES):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self.odd = [*_ODD, *(t.content for t in self.whole.get_added_tokens_decoder().values())]
        self.ranks = self._ranks(public_tokenizers, vocabulary)
        self.room, self.held, self.seen, self.first = room, 0, {}, {}

    @staticmethod
    def _ranks(public, vocabulary):
        """The same vocabulary for the faster encoder, where there is one."""
        import base64
        import os

        if not os.path.exists(public.path(f"{vocabulary}.tiktoken")):
            return None
        import tiktoken

        with open(public.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding(vocabulary, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def keep(self, words: dict[str, bytes], word: str, ids: bytes) -> None:
        words[word] = ids
        self.held += 200 + 2 * len(word) + len(ids)  # with the objects' and the table's own bytes

    def learn(self, parts: set[str]) -> None:
        """Encode new parts, each with a space before it, in one run; their ends show where each begins."""
        if self.held > self.room:
            self.seen.clear()
            self.first.clear()
            self.held = 0
        new = list(parts.difference(self.seen))
        if not new:
            return
        if not hasattr(self, "bytes_of"):
            self.bytes_of = np.array([len(self.ranks.decode_single_token_bytes(i)) for i in range(self.ranks.n_vocab)])
        spaced = [" " + p for p in new]
        ids = np.array(self.ranks.encode_ordinary("".join(spaced)), dtype="<u4")
        ends = np.cumsum(self.bytes_of[ids])
        at = np.searchsorted(ends, np.cumsum([len(p.encode()) for p in spaced])) + 1
        raw, begin = ids.tobytes(), 0
        for part, end in zip(new, (at * 4).tolist()):
            self.keep(self.seen, part, raw[begin:end])
            begin = end

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.ranks is None:
            return [self.ids(t) for t in texts]
        # a text that ends with a space has an empty last part, which isn't one
        split = [None if t[-1:] == " " or any(map(t.__contains__, self.odd)) else t.split(" ") for t in texts]
        rest = [None if s is None else s[1:] for s in split]
        self.learn(set().union(*filter(None, rest)))
        out, ids_of = [], self.seen.__getitem__
        for text, parts, others in zip(texts, split, rest):
            if parts is None:
                out.append(self.ids(text))
                continue
            if parts[0] not in self.first:
                self.keep(self.first, parts[0], array("I", self.ranks.encode_ordinary(parts[0])).tobytes())
            out.append(self.first[parts[0]] + b"".join(map(ids_of, others)))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One for each Python worker."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def cut_pieces(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of a document's pieces. The first takes what full pieces leave."""
    n = len(ids) // 4
    ends = range(n % capacity or capacity, n + 1, capacity) if n > capacity else [n]
    begin = 0
    for end in ends:
        yield begin, end - begin, zlib.crc32(ids[4 * begin : 4 * end])
        begin = end


def _pieces(vocabulary: str, capacity: int, end_id: int, rows: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        end, part, nth = np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                few = batch.slice(at, rows)
                ids, out = few.column(0).to_pylist(), [[] for _ in range(7)]
                texts = [t or "" for t in few.column(1).to_pylist()]
                for doc, raw in zip(ids, encoder(vocabulary).encode(texts)):
                    for piece, (begin, length, crc) in enumerate(cut_pieces(raw + end, capacity)):
                        for column, value in zip(out, (doc, piece, begin, length, crc, part, nth[length])):
                            column.append(value)
                        nth[length] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])
        release()

    return run


def tokenised_pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32; part and nth: its number among the pieces of its length in its partition."""
    ship(docs.sparkSession)
    return cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(vocabulary, capacity, end_id), PIECES))


# ---------------------------------------------------------------- the plan, from the histogram


def grouped(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count), longest first, cut into groups of equal cardinality; a length can be in two groups."""
    total = sum(c for _, c in lengths)
    out, room = [], 0
    for length, count in lengths:
        while count:
            if room == 0:
                out.append([])
                room = -(-total // groups)
            take = min(room, count)
            out[-1].append((length, take))
            room -= take
            count -= take
    return out


def fullest(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size (largest first) make the fullest configuration with the largest that is left.

    Bits of an integer are the sums that can be reached.
    """
    top = next(k for k, n in enumerate(left) if n)
    reach, steps = 1 << sizes[top], []
    for k in range(top, len(sizes)):
        for _ in range(min(left[k] - (k == top), capacity // sizes[k])):
            new = (reach | reach << sizes[k]) & ((1 << capacity + 1) - 1)
            if new == reach:
                break
            steps.append((k, reach))
            reach = new
    at, use = reach.bit_length() - 1, [0] * len(sizes)
    use[top] = 1
    for k, before in reversed(steps):
        if not before >> at & 1:
            use[k] += 1
            at -= sizes[k]
    return use


def plan(histogram: dict[int, int], capacity: int = CAPACITY, small: int = 256, groups: int = 1000) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Runs of sequences that hold the same lengths: (((length, how many), ...), how many sequences)."""
    lengths = sorted(((n, c) for n, c in histogram.items() if c and n < capacity), reverse=True)
    runs: list[tuple[list[int], int]] = []
    large = grouped([x for x in lengths if x[0] > small], groups)
    sizes, left = [g[0][0] for g in large], [sum(c for _, c in g) for g in large]
    while any(left):
        use = fullest(sizes, left, capacity)
        times = min(left[k] // u for k, u in enumerate(use) if u)
        left = [n - u * times for n, u in zip(left, use)]
        while times:  # the pieces themselves, while each place holds one length
            places = [k for k, u in enumerate(use) for _ in range(u)]
            need = Counter(places)
            run = min([times, *(large[k][0][1] // u for k, u in need.items() if large[k][0][1] >= u)] if all(large[k][0][1] >= u for k, u in need.items()) else [1])
            held = []
            for k in places:
                take = run
                length, count = large[k][0]
                held.append(length)
                large[k][0] = (length, count - take)
                if count == take:
                    large[k].pop(0)
            runs.append((held, run))
            times -= run
    rooms: dict[int, list[tuple[list[int], int]]] = {}
    for held, n in runs:
        rooms.setdefault(capacity - sum(held), []).append((held, n))
    keys = sorted(rooms)
    for length, count in (x for x in lengths if x[0] <= small):
        while count:
            at = bisect.bisect_left(keys, length)
            if at == len(keys):  # nowhere: new sequences
                fit = capacity // length
                new, rest = divmod(count, fit)
                for held, n in (([length] * fit, new), ([length] * rest, 1)):
                    if held and n:
                        _put(rooms, keys, capacity - sum(held), held, n)
                break
            room = keys[at]
            held, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                keys.pop(at)
            fit = room // length
            full = min(n, count // fit)
            if full:
                _put(rooms, keys, room - fit * length, held + [length] * fit, full)
            count -= full * fit
            if full < n and count:
                _put(rooms, keys, room - count * length, held + [length] * count, 1)
                full, count = full + 1, 0
            if full < n:
                _put(rooms, keys, room, held, n - full)
    out = Counter()
    for kept in rooms.values():
        for held, n in kept:
            out[tuple(sorted(Counter(held).items(), reverse=True))] += n
    if histogram.get(capacity):
        out[((capacity, 1),)] += histogram[capacity]
    return sorted(out.items(), reverse=True)


def _put(rooms, keys, room, held, n):
    if room not in rooms:
        rooms[room] = []
        bisect.insort(keys, room)
    rooms[room].append((held, n))


def places(runs) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, pieces of the length in a sequence, offset of the first) of each run and length."""
    out, rank, sequence = [], Counter(), 0
    for held, n in runs:
        offset = 0
        for length, times in held:
            out.append((length, rank[length], rank[length] + n * times, sequence, times, offset))
            rank[length] += n * times
            offset += length * times
        sequence += n
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, small: int = 256, groups: int = 1000) -> DataFrame:
    """`pieces` (of tokenised_pieces) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    slots = spark.createDataFrame(places(plan(histogram, capacity, small, groups)), "s_length long, first long, past long, sequence long, times long, at long")
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("before"))
    # the plan's size depends on the capacity, not on the corpus
    here = (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past"))
    placed = ranked.join(F.broadcast(slots), here).withColumn("k", F.col("rank") - F.col("first"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.expr("k div times")).alias("sequence_id"),
        (F.col("at") + F.expr("k % times") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents, packed into as few sequences of `capacity` tokens as the scheme finds.

    Rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is the end id
    alone. A row that is repeated, and a document whose doc_id is null, is packed as often as it is there.
    An empty table gives no rows. Other columns are not read.
    """
    return pack(tokenised_pieces(docs, vocabulary, capacity), capacity)
