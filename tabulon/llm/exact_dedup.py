"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries of each partition's digests name the few that may be frequent; their rows are counted
exactly, the verified winners are broadcast, and their copies leave on the map side. Only the rows of the
other digests are shuffled, so no task gets a large group of copies.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabulon.llm.common import BLANK, WHO, cut, doc_id_of, identity, release, same_document, ship, small, text_of


def normalised(text: str | Column = "text") -> Column:
    """Each run of blanks as one space; null as empty."""
    return F.regexp_replace(text_of(text), f"[{BLANK}]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """none, id, mark, digest (SHA-256 of the normalised text), row_tag: a number for each row; cut."""
    return cut(docs.select(*identity(), F.unhex(F.sha2(normalised(), 256)).alias("digest"), F.monotonically_increasing_id().alias("row_tag")))


def _summary(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            counts = Counter(batch.column(0).to_pylist())
            for key, n in counts.items():
                held[key] = held.get(key, 0) + n
            if len(held) > counters:  # lower all by the (counters+1)-th largest, as merging summaries does
                least = sorted(held.values(), reverse=True)[counters]
                held = {k: n - least for k, n in held.items() if n > least}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["digest", "estimate"])
        release()

    return run


def heavy_hitters(keys: DataFrame, share: float) -> DataFrame:
    """Digests that more than `share` of the rows of `keys` (one binary column, cut) carry, and perhaps less frequent ones.

    With 2/share counters, a summary lacks share/2 of its partition's rows of any digest at most. So the sum of
    a digest's counters reaches share/2 of all rows if the digest has `share` of them, and at most 2/share
    digests reach that: the result's size is bounded whatever the corpus.
    """
    ship(keys.sparkSession)
    total = keys.count()
    found = keys.toDF("digest").mapInArrow(_summary(int(2 / share)), "digest binary, estimate long")
    return found.groupBy("digest").agg(F.sum("estimate").alias("estimate")).filter(F.col("estimate") >= F.lit(total * share / 2)).select("digest")


#: Copies of a text that one task may get by the shuffle, and the least share of rows that summaries look for (2 / LEAST counters a task).
COPIES, LEAST = 500_000, 1e-6


def exact_groups(docs: DataFrame, share: float = 0.001) -> DataFrame:
    """A row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256; none, id, mark (`identity`), winner (whether it repeats the row that stays, or is it).

    Texts are equal when identical after each run of blanks became one space; null counts as empty. Of equal
    texts the row with the smallest doc_id stays (null doc_ids after all others, in some fixed order); if a row is
    repeated, one of them stays. An empty table gives no rows. Other columns are not read. Digests of more than `share` of the
    rows, or of more than `COPIES` rows, are the heavy ones.
    """
    tagged = digests(docs)
    share = max(LEAST, min(share, COPIES / max(1, tagged.count())))
    heavy = cut(heavy_hitters(tagged.select("digest"), share))
    order = F.struct(*WHO, "row_tag")
    heavy_rows = tagged.join(F.broadcast(heavy), "digest", "left_semi")
    winners = cut(heavy_rows.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")))  # 2/share rows at most
    by_map = tagged.join(F.broadcast(winners), "digest")
    rest = tagged.join(F.broadcast(heavy), "digest", "left_anti")
    whole = W.partitionBy("digest")
    by_shuffle = rest.withColumn("first", F.min(order).over(whole)).withColumn("group_size", F.count(F.lit(1)).over(whole))
    return by_map.unionByName(by_shuffle).select(
        doc_id_of("none", "id").alias("doc_id"), doc_id_of("first.none", "first.id").alias("keep_id"), "group_size", (F.col("row_tag") == F.col("first.row_tag")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), *WHO, (F.struct(*WHO) == F.struct(*[f"first.{c}" for c in WHO])).alias("winner"),
    )


def exact_dedup(docs: DataFrame, share: float = 0.001) -> DataFrame:
    """The rows of `docs` that stay, with the columns of `docs`.

    Ids of dropped documents meet the rows, by a broadcast while they are few; texts aren't shuffled then. Of rows with
    the same text and doc_id one stays, whichever its other columns are. Null and empty texts are equal; of rows
    without doc_id one stays if no row with one has the text. An empty table stays empty.
    """
    lost = cut(exact_groups(docs, share).filter(~F.col("kept")).groupBy(*WHO).agg(F.max("winner").alias("repeated")))
    # as a struct, the columns of `docs` can't clash with those of the join
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *identity())
    single = rows.join(small(lost), same_document(rows, lost), "left_anti").select("row")
    repeated = lost.filter("repeated")
    if not repeated.isEmpty():  # rows that repeat the one that stays
        single = single.unionByName(rows.join(small(repeated), same_document(rows, repeated), "left_semi").dropDuplicates(WHO).select("row"))
    return single.select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
