"""Line deduplication by winnowing.

Neighbouring lines make a gram; of each window of neighbouring grams the smallest hash (the last one if equal) is a
fingerprint, so two texts that share `gram + window - 1` lines in a row, a stretch, share the fingerprint of that
stretch at the same line of it. Fingerprints of all documents meet by hash, and only places whose fingerprint comes
back go on. There matches are extended both ways, over every stretch that has the fingerprint, and the stretches meet
by a hash of all their lines; the earliest place of each stays. As each stretch of a longer common run is met in this
way, matches reach as far as they go. Stretches that stood before, touching or overlapping, are a run, which is to be
deleted. So exactly the repeats of at least `gram + window - 1` lines are found: three lines by default, single ones with a
gram and a window of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabulon.llm.common import BLANK, WHO, cut, doc_id_of, identity, same_document, text_of

GRAM, WINDOW = 1, 3


def lines(text: str | Column = "text") -> Column:
    """The lines that hold more than blanks, without blanks around them, in their order."""
    parts = F.transform(F.split(text_of(text), "\n"), lambda x: F.regexp_replace(x, f"^[{BLANK}]+|[{BLANK}]+$", ""))
    return F.filter(parts, lambda x: x != "")


def line_hashes(docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """none, id, mark, h (two hashes of each line, 96 bits together), grams (a hash of each gram); cut."""
    hashes = F.transform(lines(), lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b")))
    hashed = cut(docs.select(*identity(), hashes.alias("h")).filter(F.size("h") >= gram))
    if gram == 1:
        return hashed.withColumn("grams", F.col("h.a"))
    # written once more: what reads single grams would else compute all of them each time
    return cut(hashed.withColumn("grams", F.transform(F.sequence(F.lit(0), F.size("h") - gram), lambda i: F.xxhash64(F.slice("h", i + 1, gram)))))


def stretches(hashed: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """none, id, mark, start, print (the hash of its fingerprint), fresh (whether the stretch before has another fingerprint), a, b (hashes of its lines): a row for each stretch."""
    size = gram + window - 1
    some = lambda i: F.slice("grams", i + 1, window)
    place = lambda i: i + window - F.array_position(F.reverse(some(i)), F.array_min(some(i)))  # noqa: E731  (of the window's last smallest gram)
    lines_of = lambda i: F.slice("h", i + 1, size)
    one = lambda i: F.struct(
        i.alias("start"), F.array_min(some(i)).alias("print"), F.when(i == 0, True).otherwise(place(F.greatest(i - 1, F.lit(0))) != place(i)).alias("fresh"), F.xxhash64(lines_of(i)).alias("a"), F.hash(lines_of(i)).alias("b")
    )
    return hashed.filter(F.size("h") >= size).select(*WHO, F.inline(F.transform(F.sequence(F.lit(0), F.size("h") - size), one)))


def covered(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """none, id, mark, start, of (none, id, mark, start of the earliest place): each stretch that stood before, once."""
    found = stretches(line_hashes(docs, gram), gram, window)
    # counts and first places form before rows are shuffled; a written table on this side lets Spark split the other where a hash is frequent
    again = cut(found.filter("fresh").groupBy("print").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("print"))
    # from fingerprints that come back, matches extend over all stretches that have them
    around = cut(found.join(again, "print").select(*WHO, "start", "a", "b"))
    place = F.struct(*WHO, "start")
    firsts = cut(around.groupBy("a", "b").agg(F.min(place).alias("of"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times"))
    later = around.join(firsts, ["a", "b"]).filter(place != F.col("of"))
    # rows that repeat a document become one before they are shuffled
    return later.groupBy(*WHO, "start").agg(F.min("of").alias("of"))


def _runs(docs: DataFrame, gram: int, window: int) -> DataFrame:
    """none, id, mark, first_line, n_lines, of: the runs of covered lines."""
    size = gram + window - 1
    doc = W.partitionBy(*WHO).orderBy("start")  # a document has no more stretches than lines
    fresh = F.coalesce(F.col("start") > F.lag("start").over(doc) + size, F.lit(True)).cast("int")
    numbered = covered(docs, gram, window).withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(doc.rowsBetween(W.unboundedPreceding, 0)))
    found = numbered.groupBy(*WHO, "run").agg(F.min("start").alias("first_line"), F.max("start").alias("last"), F.min_by("of", "start").alias("of"))
    return found.select(*WHO, "first_line", (F.col("last") + size - F.col("first_line")).cast("int").alias("n_lines"), "of")


def repeated_runs(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """A row for each run of lines that is to be deleted: doc_id, first_line, n_lines, of_doc_id, of_line.

    A run is made of stretches of `gram + window - 1` lines that stood before; shorter repeats stay, texts of fewer lines too.
    Lines are counted from 0 among those that hold more than blanks. of_doc_id and of_line say where the run's
    first stretch stands earliest: in a document with a smaller doc_id (null ones come last, in some fixed order) or
    before in the same one. Rows that share a doc_id but not the text are documents of their own; rows that share
    both are one. Null and empty texts have no lines; an empty table gives no rows. Other columns are not read.
    """
    return _runs(docs, gram, window).select(
        doc_id_of("none", "id").alias("doc_id"), "first_line", "n_lines", doc_id_of("of.none", "of.id").alias("of_doc_id"), F.col("of.start").alias("of_line")
    )


def without_repeats(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """`docs`, with the texts of documents that have repeated runs as their other lines, blank ones left out.

    All rows and columns stay. Rows without doc_id, or with one that others have too, lose what their own text
    repeats only; rows that repeat a document lose the same lines. Null and empty texts, and an empty table, stay.
    """
    runs = _runs(docs, gram, window)
    gone = runs.groupBy(*WHO).agg(F.flatten(F.collect_list(F.sequence("first_line", F.col("first_line") + F.col("n_lines") - 1))).alias("gone"))
    # as a struct, the columns of `docs` can't clash with those of the join
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *identity())
    joined = rows.join(gone, same_document(rows, gone), "left").select("row", "gone")
    every = lines("row.text")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), "gone"), lambda i: F.get(every, i))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    return joined.withColumn("row", F.col("row").withField("text", text)).select("row.*")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """`repeated_runs` of single lines: every line that stood before is in a run, one-line texts and lines that stand alone included."""
    return repeated_runs(docs, 1, 1)


#: For the query: every three lines in a row that stood before.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x != '') AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(list_transform(range(len(ls) - 2), lambda i: md5(array_to_string(ls[i + 1:i + 3], chr(10))))) AS x, unnest(range(len(ls) - 2)) AS pos FROM d WHERE len(ls) >= 3
), f AS (
  SELECT doc_id, pos, first_value(doc_id) OVER w AS of_doc_id, first_value(pos) OVER w AS of_line FROM l WINDOW w AS (PARTITION BY x ORDER BY doc_id, pos)
), g AS (
  SELECT *, pos > coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 3, -1) AS fresh FROM f WHERE doc_id != of_doc_id OR pos != of_line
), r AS (
  SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g
)
SELECT doc_id, min(pos)::INT AS first_line, (max(pos) + 3 - min(pos))::INT AS n_lines, arg_min(of_doc_id, pos) AS of_doc_id, arg_min(of_line, pos)::INT AS of_line FROM r GROUP BY doc_id, run
"""
