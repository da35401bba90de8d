"""How filters interact, audited by a trie of their orders.

Every order of the filters is a path of a trie; a node's survivors depend on which filters came before, not on their
order, so nodes with the same set share one state. The trie is walked depth first: a state's survivors are persisted
while its children are made from them, each state is made once, and at each edge the rows that the filter in fact
removes are counted by part. What one order, all orders or a single filter did is then told from the edges' counts.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import BLANK, cut, small, text_of

#: The least number of words, percent of distinct words, and the most percent of capitals.
WORDS, DISTINCT, CAPITALS = 200, 50, 2
MARKS = "[#$%&*|]"
FILTERS = "ABCDE"


def text_failures(text: str | Column = "text") -> dict[str, Column]:
    """What fails the filters of a text alone: A too short, B too repetitive, C too many capitals, D marks of markup."""
    content = text_of(text)
    words = F.regexp_extract_all(content, F.lit(f"[^{BLANK}]+"), F.lit(0))
    capitals = F.length(F.regexp_replace(content, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * DISTINCT,
        "C": capitals * 100 > F.length(content) * CAPITALS,
        "D": content.rlike(MARKS),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A, B, C, D, E, good, toxic: a row for each row of `docs`, with what it fails; cut.

    E: a row with a smaller doc_id has the same text (null as empty). A row without doc_id comes after all that have one, and
    not after each other; rows that share a doc_id don't fail each other. A null source is the part "". A row is good
    or toxic if any label of its doc_id says so. Only doc_id, text and source are read.
    """
    tagged = cut(
        docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text_of(), 256)).alias("digest"), *[c.alias(k) for k, c in text_failures().items()])
    )
    # one row a digest and task is shuffled, and only digests that repeat; Spark splits the other side where one is frequent
    firsts = cut(tagged.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first"))
    told = cut(
        labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t")).filter("q = 1 OR t = 1")
    )
    later = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    rows = tagged.join(small(firsts), "digest", "left").join(small(told), "id", "left")
    return cut(rows.select("part", *"ABCD", later.alias("E"), F.coalesce(F.col("q") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("t") == 1, F.lit(False)).alias("toxic")))


def trie_edges(rows: DataFrame, filters: str | list[str] = FILTERS) -> DataFrame:
    """part, prefix (bits of the filters applied before), filter, entered, removed, good_lost, toxic_lost; cut.

    `rows` has part, good, toxic and a boolean column for each of `filters`, true where the row fails it. There is an
    edge for each set of filters and each one outside it; a part without survivors of the set has no row. At most as
    many states are persisted at once as there are filters.
    """
    found: list[DataFrame] = []
    seen = {0}

    def visit(state: DataFrame, prefix: int) -> None:
        left = [k for k in range(len(filters)) if not prefix >> k & 1]
        if not left:
            return
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        fails = {k: F.col(f"`{filters[k]}`") for k in left}
        edges = [
            F.struct(F.lit(filters[k]).alias("filter"), F.count_if(fails[k]).alias("removed"), F.count_if(fails[k] & F.col("good")).alias("good_lost"), F.count_if(fails[k] & F.col("toxic")).alias("toxic_lost")) for k in left
        ]
        counted = state.groupBy("part").agg(F.count(F.lit(1)).alias("entered"), F.array(*edges).alias("edges"))
        found.append(cut(counted.select("part", F.lit(prefix).alias("prefix"), "entered", F.inline("edges"))))
        for k in left:
            if (child := prefix | 1 << k) not in seen:
                seen.add(child)
                visit(state.filter(~fails[k]), child)
        state.unpersist()

    visit(rows, 0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return cut(out)


def audit(rows: DataFrame, filters: str | list[str] = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, of trie_edges' rows.

    A row for each part of `rows`, order of all filters and step of it. redundant rows fail the step's filter but were removed
    before; unique_fails fail it only; shapley sums what it removes over all orders. An empty table gives no rows.
    """
    spark, n = rows.sparkSession, len(filters)
    found = trie_edges(rows, filters)
    grid = [(prefix, filters[k]) for prefix in range(1 << n) for k in range(n) if not prefix >> k & 1]
    weight = lambda p: factorial(p.bit_count()) * factorial(n - 1 - p.bit_count())  # noqa: E731  orders that reach the edge
    steps = [
        ("".join(filters[k] for k in order), at + 1, filters[k], sum(1 << x for x in order[:at])) for order in permutations(range(n)) for at, k in enumerate(order)
    ]
    # the trie's edges and the steps are as many for any corpus
    pairs = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(f).alias("filter"), F.lit(weight(p)).alias("orders"), F.lit((1 << n) - 1 == p | 1 << filters.index(f)).alias("alone")) for p, f in grid])
    parts = found.filter("prefix = 0").select("part").distinct().select("part", F.inline(pairs))
    counts = ["entered", "removed", "good_lost", "toxic_lost"]
    edges = parts.join(found, ["part", "prefix", "filter"], "left").select("part", "prefix", "filter", "orders", "alone", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    totals = edges.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("prefix") == 0, F.col("removed")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("alone"), F.col("removed")).otherwise(0)).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("orders")).alias("shapley"),
    )
    paths = spark.createDataFrame(steps, "filter_order string, step int, filter string, prefix int")
    return edges.join(totals, ["part", "filter"]).join(F.broadcast(paths), ["prefix", "filter"]).select(
        "part", "filter_order", "step", (F.col("entered") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`audit` of the five filters of `failures` over all `docs`, by source.

    Null texts are empty: they fail A only (and E, as others do). Repeated rows count each. Labels of documents that aren't
    there, and documents without a label, count for nothing. Other columns are not read.
    """
    return audit(failures(docs, labels))


#: Each row's failures as a bit set: what a prefix leaves is what fails none of it.
ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents
), w AS (
  SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY x) AS first FROM t
), l AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x))::INT
         + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * (doc_id > first)::INT AS m
  FROM w LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY 1, 2
), p AS (
  SELECT '' AS o, 0 AS prefix, 0 AS before, '' AS letter, 0 AS step, 0 AS bit
  UNION ALL
  SELECT o || b.k, prefix + (1 << b.i), prefix, b.k, step + 1, 1 << b.i FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k, unnest(range(5))::INT AS i) b WHERE prefix & (1 << b.i) = 0
), s AS (
  SELECT q.o AS filter_order, p.step, p.before, p.bit FROM p JOIN p q ON q.step = 5 AND p.step > 0 AND starts_with(q.o, p.o)
), r AS (
  SELECT part, filter_order, step::INT AS step, bit, sum(n) FILTER (m & (before | bit) = 0) AS kept, sum(n) FILTER (m & before = 0 AND m & bit > 0) AS removed,
         sum(n) FILTER (m & before > 0 AND m & bit > 0) AS redundant, sum(n) FILTER (m = bit) AS unique_fails,
         sum(g) FILTER (m & before = 0 AND m & bit > 0) AS good_lost, sum(x) FILTER (m & before = 0 AND m & bit > 0) AS toxic_lost
  FROM s, c GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM r
"""
