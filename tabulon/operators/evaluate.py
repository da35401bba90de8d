"""Evaluation of predicted labels under one specification: all metrics come from the cells of the confusion matrix.

Rows are aggregated once, to at most one cell for each pair of classes; everything after that works on cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabulon.errors import RefusedInput, UnusableRows
from tabulon.functions.labels import normaliser, problem, raw_label
from tabulon.functions.stats import ratio
from tabulon.schemas import CLASSES, require_columns
from tabulon.session import shared_folder

TOLERANCE = 1e-12


def class_table(spark: SparkSession, classes: Sequence[str], adapter: str = "none") -> DataFrame:
    """class_id, raw_label, display_label, changed, in the declared order; classes that the adapter would merge are refused."""
    if not classes:
        raise RefusedInput("no classes are declared")
    if any(not isinstance(c, str) or not c.strip() for c in classes):
        raise RefusedInput("class names must be texts that aren't empty")
    if len(set(classes)) < len(classes):
        raise RefusedInput(f"classes are declared twice: {sorted({c for c in classes if list(classes).count(c) > 1})[:5]}")
    normaliser(adapter)
    shown = [c.strip() if adapter == "strip" else c for c in classes]
    if len(set(shown)) < len(shown):
        raise RefusedInput(f"adapter {adapter!r} would merge classes: {sorted({c for c, s in zip(classes, shown) if shown.count(s) > 1})[:5]}")
    return spark.createDataFrame([(k, c, s, c != s) for k, (c, s) in enumerate(zip(classes, shown))], CLASSES)


def check_table(rows: DataFrame, target: str, prediction: str, id_column: str | None = None, expected_rows: int | None = None) -> int:
    """The number of rows; refuses an empty table, missing columns, repeated ids and another number than expected."""
    require_columns(rows, target, prediction, *([id_column] if id_column else []))
    n = rows.count()
    if not n:
        raise RefusedInput("the prediction table is empty")
    if id_column:
        twice = [r[0] for r in duplicate_ids(rows, id_column).limit(10).collect()]
        if twice:
            raise RefusedInput(f"ids are repeated in {id_column!r}, such as {twice}")
    if expected_rows is not None and n != expected_rows:
        raise RefusedInput(f"there are {n} rows, not {expected_rows}")
    return n


def duplicate_ids(rows: DataFrame, id_column: str) -> DataFrame:
    """id, n of ids that more than one row has; null counts as an id."""
    return rows.groupBy(F.col(id_column).alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def observed_collisions(rows: DataFrame, column: str, classes: DataFrame, adapter: str) -> DataFrame:
    """display_label, spellings: declared classes that several stored spellings become under the adapter."""
    raw = raw_label(F.col(column))
    shown = rows.select(raw.alias("raw"), normaliser(adapter)(raw).alias("display_label")).filter("raw IS NOT NULL")
    several = shown.groupBy("display_label").agg(F.array_sort(F.collect_set("raw")).alias("spellings")).filter(F.size("spellings") > 1)
    return several.join(F.broadcast(classes.select("display_label")), "display_label", "left_semi")


#: What classify adds.
VERDICT = ["target_id", "prediction_id", "reason", "raw_target", "raw_prediction"]


def classify(rows: DataFrame, classes: DataFrame, target: str, prediction: str, adapter: str = "none") -> DataFrame:
    """`rows` with target_id, prediction_id, reason, raw_target and raw_prediction; reason is null where both are classes.

    A table that has columns of these names already is refused, so that none of the user's is lost.
    """
    clash = [c for c in rows.columns if c.lower() in VERDICT]
    if clash:
        raise RefusedInput(f"columns {clash} have names that the classification adds")
    adapt = normaliser(adapter)
    out = rows.withColumns({"raw_target": raw_label(F.col(f"`{target}`")), "raw_prediction": raw_label(F.col(f"`{prediction}`"))})
    ids = lambda k: F.broadcast(classes.select(F.col("display_label").alias(f"__{k}"), F.col("class_id").alias(f"{k}_id")))  # noqa: E731  (a row for each declared class, which the driver has listed)
    out = out.join(ids("target"), adapt(F.col("raw_target")) == F.col("__target"), "left").join(ids("prediction"), adapt(F.col("raw_prediction")) == F.col("__prediction"), "left")
    why = F.concat_ws("; ", problem(F.col("raw_target"), F.col("target_id").isNotNull(), "target"), problem(F.col("raw_prediction"), F.col("prediction_id").isNotNull(), "prediction"))
    return out.withColumn("reason", F.nullif(why, F.lit(""))).drop("__target", "__prediction")


def classified_pairs(rows: DataFrame, classes: DataFrame, target: str, prediction: str, adapter: str = "none") -> DataFrame:
    """As classify, of the different pairs of labels, with n: how many rows have each. Labels are looked at once a pair, not once a row."""
    pairs = rows.groupBy(F.col(f"`{target}`").alias("target"), F.col(f"`{prediction}`").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
    return classify(pairs, classes, "target", "prediction", adapter)


def excluded(classified: DataFrame, *keep: str) -> DataFrame:
    """The rows that can't be scored: `keep`, target, prediction, reason."""
    return classified.filter("reason IS NOT NULL").select(*keep, F.col("raw_target").alias("target"), F.col("raw_prediction").alias("prediction"), "reason")


def with_position(rows: DataFrame, order: list[str | Column] | None = None, name: str = "row_position") -> DataFrame:
    """`rows` with their number from 0: in `order`, or as they are stored. No task holds more than a partition.

    The table is written to the shared checkpoint folder first, so that numbers don't change between uses.
    """
    shared_folder(rows.sparkSession)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    kept = ranged.withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = kept.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # a row for each partition
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("__part", before.alias("__before")))
    return kept.join(offsets, part == F.col("__part")).withColumn(name, F.col("__before") + inside).drop("__at", "__part", "__before")


def cells(classified: DataFrame) -> DataFrame:
    """target_id, prediction_id, n of the scorable rows, of classify's rows or classified_pairs' pairs."""
    n = F.sum("n") if classified.columns[:3] == ["target", "prediction", "n"] else F.count(F.lit(1))
    return classified.filter("reason IS NULL").groupBy("target_id", "prediction_id").agg(n.alias("n"))


def dense(cell: DataFrame, classes: DataFrame) -> DataFrame:
    """A cell for each pair of classes, 0 where there is none: class_id squared rows."""
    ids = classes.select("class_id")
    grid = ids.select(F.col("class_id").alias("target_id")).crossJoin(F.broadcast(ids.select(F.col("class_id").alias("prediction_id"))))
    return grid.join(F.broadcast(cell), ["target_id", "prediction_id"], "left").select("target_id", "prediction_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class(cell: DataFrame, classes: DataFrame) -> DataFrame:
    """class_index, class, display_class, precision, recall, f1, support, predicted of every declared class."""
    sides = cell.select(F.explode(F.array(F.struct(F.col("target_id").alias("class_id"), F.lit(True).alias("t")), F.struct(F.col("prediction_id").alias("class_id"), F.lit(False).alias("t")))).alias("s"), "n", (F.col("target_id") == F.col("prediction_id")).alias("hit"))
    sums = sides.groupBy(F.col("s.class_id").alias("class_id")).agg(
        F.sum(F.when(F.col("s.t"), F.col("n"))).alias("support"), F.sum(F.when(~F.col("s.t"), F.col("n"))).alias("predicted"), F.sum(F.when(F.col("s.t") & F.col("hit"), F.col("n"))).alias("hits")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    every = classes.join(F.broadcast(sums), "class_id", "left").select("class_id", "raw_label", "display_label", zero("support"), zero("predicted"), zero("hits"))
    scored = every.withColumns({"precision": ratio(F.col("hits"), F.col("predicted")), "recall": ratio(F.col("hits"), F.col("support"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.select(
        F.col("class_id").alias("class_index"), F.col("raw_label").alias("class"), F.col("display_label").alias("display_class"), "precision", "recall", f1.alias("f1"), "support", "predicted", "hits"
    )


def summary(classed: DataFrame) -> DataFrame:
    """One row: rows, correct, accuracy, macro and weighted averages over all declared classes, zero-support and never-predicted classes."""
    names = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c) == 0, F.struct("class_index", "class")))), lambda x: x["class"])
    return classed.agg(
        F.sum("support").alias("rows"), F.sum("hits").alias("correct"), ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1_excluding_zero_support"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        names("support").alias("classes_with_zero_support"), F.count_if(F.col("support") == 0).alias("zero_support_class_count"), names("predicted").alias("classes_never_predicted"),
    )


def row_shares(cell: DataFrame) -> DataFrame:
    """target_id, prediction_id, n, share of the target's rows."""
    return cell.withColumn("share", ratio(F.col("n"), F.sum("n").over(W.partitionBy("target_id"))))


def confusions(cell: DataFrame) -> DataFrame:
    """The cells off the diagonal that have rows."""
    return cell.filter((F.col("target_id") != F.col("prediction_id")) & (F.col("n") > 0))


def majority(rows: DataFrame, target: str) -> DataFrame:
    """`rows` with the most frequent target as `prediction`; of equally frequent ones the first in the alphabet."""
    top = rows.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), target).limit(1).select(F.col(target).alias("prediction"))
    return rows.crossJoin(F.broadcast(top))  # one row


def two_formulas(cell: DataFrame, classes: DataFrame) -> DataFrame:
    """class_index, f1 from precision and recall, f1_counts from 2 TP / (support + predicted), and how far apart they are."""
    classed = per_class(cell, classes)
    counts = ratio(2 * F.col("hits"), F.col("support") + F.col("predicted"))
    return classed.select("class_index", "class", "f1", counts.alias("f1_counts"), F.abs(F.col("f1") - counts).alias("difference"))


def exact_metrics(cell: DataFrame, classes: DataFrame) -> dict[str, Fraction]:
    """The averages as exact fractions, from the cells (classes squared) on the driver."""
    n = classes.count()
    counts = {(r.target_id, r.prediction_id): r.n for r in cell.collect()}
    support = [sum(c for (t, _), c in counts.items() if t == k) for k in range(n)]
    predicted = [sum(c for (_, p), c in counts.items() if p == k) for k in range(n)]
    hits = [counts.get((k, k), 0) for k in range(n)]
    part = lambda a, b: Fraction(a, b) if b else Fraction(0)
    precision, recall = [part(h, p) for h, p in zip(hits, predicted)], [part(h, s) for h, s in zip(hits, support)]
    f1 = [2 * a * b / (a + b) if a + b else Fraction(0) for a, b in zip(precision, recall)]
    total = sum(support)
    return {
        "accuracy": part(sum(hits), total), "macro_f1": sum(f1) / n, "macro_precision": sum(precision) / n, "macro_recall": sum(recall) / n,
        "weighted_f1": sum((f * s for f, s in zip(f1, support)), Fraction(0)) / total if total else Fraction(0),
    }


def cross_check(cell: DataFrame, classes: DataFrame) -> dict[str, object]:
    """How far the averages are from the exact ones."""
    told = summary(per_class(cell, classes)).first()
    gaps = {k: abs(float(told[k]) - float(v)) for k, v in exact_metrics(cell, classes).items()}
    worst = max(gaps, key=gaps.get)
    return {"max_abs_difference": gaps[worst], "worst_key": worst, "tolerance": TOLERANCE, "passed": gaps[worst] <= TOLERANCE}


def row_metrics(classified: DataFrame, classes: DataFrame) -> DataFrame:
    """accuracy and macro F1 from rows, not from cells: another plan for the cross-check. Each row counts once for its target's class and once for its prediction's."""
    t, p = F.col("target_id"), F.col("prediction_id")
    side = lambda of, s, q: F.struct(of.alias("class_id"), F.lit(s).alias("s"), F.lit(q).alias("p"), (t == p).cast("int").alias("h"))
    sides = classified.filter("reason IS NULL").select(F.inline(F.array(side(t, 1, 0), side(p, 0, 1))))
    counted = sides.groupBy("class_id").agg(F.sum("s").alias("s"), F.sum("p").alias("p"), F.sum(F.col("h") * F.col("s")).alias("h"))
    every = classes.select("class_id").join(F.broadcast(counted), "class_id", "left").na.fill(0)  # a row for each class
    return every.agg(ratio(F.sum("h"), F.sum("s")).alias("accuracy"), F.avg(ratio(2 * F.col("h"), F.col("s") + F.col("p"))).alias("macro_f1"))


def by_recall(classed: DataFrame) -> DataFrame:
    """per_class's rows, those with the lowest recall first, by name if equal."""
    return classed.orderBy("recall", "class")


def evaluate(rows: DataFrame, classes: Sequence[str], target: str = "target", prediction: str = "prediction", allow_unusable: bool = False, id_column: str | None = None, expected_rows: int | None = None, adapter: str = "none") -> dict[str, DataFrame]:
    """The whole evaluation: summary, per_class, cells, excluded, mapping. Refuses what the single checks refuse."""
    check_table(rows, target, prediction, id_column, expected_rows)
    table = class_table(rows.sparkSession, classes, adapter)
    if adapter != "none":
        for column in (target, prediction):
            merged = observed_collisions(rows, column, table, adapter).limit(5).collect()
            if merged:
                raise RefusedInput(f"spellings in {column!r} would merge under {adapter!r}: {[list(r.spellings) for r in merged]}")
    pairs = classified_pairs(rows, table, target, prediction, adapter).persist()  # a row for each pair of labels
    try:
        by_reason = pairs.filter("reason IS NOT NULL").groupBy("reason").agg(F.sum("n").alias("n"))
        unusable = by_reason.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        if unusable and not allow_unusable:
            listed = by_reason.orderBy(F.desc("n"), "reason").limit(1000).collect()  # the most frequent; the number above counts all
            reasons = {r.reason: r.n for r in listed}
            raise UnusableRows(f"{unusable} rows can't be scored: {dict(list(reasons.items())[:5])}", reasons, unusable)
        cell = rows.sparkSession.createDataFrame(cells(pairs).collect(), "target_id int, prediction_id int, n long")  # classes squared at most
    finally:
        pairs.unpersist()
    if cell.isEmpty():
        raise RefusedInput("no row is left to score")
    bad = excluded(classify(rows, table, target, prediction, adapter), *([id_column] if id_column else []))
    classed = per_class(cell, table)
    return {"summary": summary(classed), "per_class": classed.drop("hits").orderBy("class_index"), "cells": dense(cell, table), "excluded": bad, "mapping": table}


def evaluate_matrix(spark: SparkSession, classes: Sequence[str], cell: DataFrame, listed: Sequence[str], expected_rows: int | None = None) -> dict[str, DataFrame]:
    """The evaluation of a finished matrix over `listed`; refused unless these are the declared classes in their order, and the counts sum to `expected_rows`."""
    if list(classes) != list(listed):
        raise RefusedInput("the matrix lists other classes, or another order")
    total = cell.agg(F.sum("n")).first()[0]
    if expected_rows is not None and total != expected_rows:
        raise RefusedInput(f"the matrix counts {total} rows, not {expected_rows}")
    table = class_table(spark, classes)
    classed = per_class(cell, table)
    return {"summary": summary(classed), "per_class": classed.drop("hits").orderBy("class_index"), "cells": dense(cell, table), "mapping": table}
