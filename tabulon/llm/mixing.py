"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies: the source's target over its size. Within a
source, documents stand in order of size; with the prefix sums of their expected copies and one random offset,
a document is emitted once for each integer boundary that its interval crosses. As neighbours are alike in
size, what a source yields is near its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabulon.llm.common import BLANK, WHO, cut, distributed_rank, doc_id_of, identity, same_document, small, text_of

WEIGHTS = (1, 2, 3)
MOST = 3  # copies of a document


def words(text: str | Column = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(f"[^{BLANK}]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target of each source.

    Sources in order of code points, null last, weigh `weights`, repeating, and share the size of all. No target
    exceeds `most` times its source's size; what is over goes to the others by weight until none is above. That
    is min(cap, level * weight) with one level for all, which sums over the sources in order of cap / weight give.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")  # over sources, not documents
    listed = F.array(*[F.lit(w) for w in weights])
    sources = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(listed, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
    )
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    earlier, rest, all_rows = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    levelled = sources.withColumn(
        "level", (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(rest)
    )  # the level if all earlier sources are at their caps
    first_free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(all_rows)
    return levelled.withColumn("final", first_free["level"]).select(
        "source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target")
    )


def offset(seed: str) -> Column:
    """A source's offset: a fraction of 16 bits, from its name."""
    name = F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("none")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 4), 16, 10).cast("double") / 65536


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix", salts: int = 256) -> DataFrame:
    """A row for each row of `docs`: doc_id, source, size, source_size, target, copies, taken; none, id, mark (`identity`).

    Rank within a source goes by (bits of the size, salt of the doc_id, size, doc_id), so that a source of any
    share is ranked in many parts, whose counts are summed up before them; rows without doc_id are salted by their
    place in the table, as their texts may be equal. A null text has size 0. Of repeated rows each counts; which of equal rows gets a copy makes no
    difference. Where all sizes are 0, targets are 0 and nothing is taken. An empty table gives no rows.
    """
    sizes = cut(docs.select(*identity(), "source", words().alias("size")))
    own = F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 4), 16, 10).cast("int") % salts
    salt = F.when(F.col("none"), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).otherwise(own)
    dealt = sizes.withColumn("bits", F.length(F.bin("size"))).withColumn("salt", salt)
    blocks = dealt.groupBy("source", "bits", "salt").agg(F.count(F.lit(1)).alias("n"))  # at most 64 * salts for each source
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("bits", "salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select(F.col("source").alias("b_source"), F.col("bits").alias("b_bits"), F.col("salt").alias("b_salt"), before.alias("before"))
    inside = W.partitionBy("source", "bits", "salt").orderBy("size", *WHO)
    same_block = F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bits") == F.col("b_bits")) & (F.col("salt") == F.col("b_salt"))
    ranked = dealt.withColumn("inside", F.row_number().over(inside)).join(offsets, same_block).withColumn("rank", F.col("before") + F.col("inside"))
    targets = source_targets(sizes, weights, most).withColumn("from", offset(seed)).withColumnRenamed("source", "t_source")
    share = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    mixed = ranked.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).withColumn("share", share)
    crossed = lambda k: F.floor(F.col("from") + F.col("share") * k)
    return mixed.withColumn("copies", crossed(F.col("rank")) - crossed(F.col("rank") - 1)).select(
        doc_id_of("none", "id").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *WHO
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with the columns of `docs`.

    The numbers of copies meet the rows, by a broadcast while they are few; texts aren't shuffled then. Rows that
    repeat a document share the copies that `mix` gives to all of them evenly. Null and empty texts take part with
    size 0; rows without source are a source. An empty table stays empty.
    """
    per = cut(mix(docs, weights, most, seed).groupBy(*WHO).agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies")).filter("copies > 0"))
    # as a struct, the columns of `docs` can't clash with those of the join
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *identity())
    alone = per.filter("n = 1")
    emitted = rows.join(small(alone), same_document(rows, alone)).select("row", "copies")
    repeated = per.filter("n > 1")
    if not repeated.isEmpty():
        several = rows.join(small(repeated), same_document(rows, repeated)).select("row", rows["none"], rows["id"], rows["mark"], "n", "copies", F.monotonically_increasing_id().alias("tag"))
        ranked = distributed_rank(cut(several), [F.col(c) for c in WHO], [F.col("tag")], "rank")
        crossed = lambda k: F.expr(f"({k}) * copies div n")
        emitted = emitted.unionByName(ranked.select("row", (crossed("rank + 1") - crossed("rank")).alias("copies")).filter("copies > 0"))
    return emitted.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), g AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source
), w AS (
  SELECT *, [1.0::DOUBLE, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 3.0::DOUBLE AS cap FROM g
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, level LIMIT 1) * weight, cap)) AS target,
         ('0x' || substr(md5('mix|' || coalesce('s' || source, 'none')), 1, 4))::INT / 65536.0::DOUBLE AS start FROM l
), r AS (
  SELECT s.*, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)),
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::INT % 256, size, doc_id) AS k FROM s
)
SELECT r.doc_id, r.size, t.source_size, t.target,
       (CASE WHEN t.source_size = 0 THEN 0 ELSE floor(start + target / source_size * k) - floor(start + target / source_size * (k - 1)) END * size)::BIGINT AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
"""
