"""Greedy suppression of overlapping boxes, image by image, in rounds over a grid.

The best box stays, those that overlap it by more than a share of their union leave, and so on with what is left. A box
that is the best of all the cells it touches has no better one near it, so all such boxes of all images are decided at
once, and with them the boxes that they suppress. Cells are as large as the boxes in them, by powers of two, so a box
touches a few, and only boxes of like size, which alone can overlap by much, meet. No pairs of undecided boxes are made: a crowded
image or cell is a group that is reduced to its best box before it is shuffled. Of equal boxes only the best is decided on, as what
keeps or suppresses it suppresses the others. Lists of ids are joined by a shuffle: they grow with the boxes, so the driver doesn't see them.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.errors import RefusedInput
from tabulon.session import shared_folder

_SIDES = ["x1", "y1", "x2", "y2"]


def overlap(a: Column, b: Column) -> Column:
    """The shared area of two boxes (structs of x1, y1, x2, y2) by that of both together; 0 where they have none."""
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def _cells(rows: DataFrame, more: int) -> DataFrame:
    """A row for each cell that a box touches, in its own size and `more` larger ones: image, level, cx, cy."""
    size = F.greatest(F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1"))
    level = F.when(size > 0, F.ceil(F.log2(size)).cast("int")).otherwise(-60)
    levels = rows.withColumn("level", F.explode(F.sequence(level, level + more)))
    edge = F.pow(F.lit(2.0), F.col("level"))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(f"box.{a}") / edge), F.floor(F.col(f"box.{b}") / edge)))
    return levels.withColumn("cx", span("x1", "x2")).withColumn("cy", span("y1", "y2"))


def suppressed(boxes: DataFrame, image: str, score: str, share: float = 0.5, sides: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """`boxes` with kept: whether greedy suppression keeps the box; boxes that overlap a kept better one by more than `share` leave.

    Better is the larger score, then the smaller x1, y1, x2, y2; of equal boxes one stays. Boxes without an area overlap nothing. A box with
    a null or non-finite side or score, or sides that don't rise, has kept null and suppresses nothing. Null images are one image.
    """
    if not 0 < share < 1:
        raise RefusedInput("the share must be between 0 and 1")
    shared_folder(boxes.sparkSession)
    more = ceil(log2(1 / share))
    value = lambda c: F.col(f"`{c}`").cast("double")
    fine = F.lit(True)
    for c in (*sides, score):
        fine = fine & value(c).isNotNull() & ~F.isnan(value(c)) & (F.abs(value(c)) < float("inf"))
    fine = fine & (value(sides[0]) <= value(sides[2])) & (value(sides[1]) <= value(sides[3]))
    box = F.struct(*[value(c).alias(n) for c, n in zip(sides, _SIDES)])
    given = boxes.select(F.struct(*[F.col(f"`{c}`") for c in boxes.columns]).alias("row"), F.col(f"`{image}`").alias("image"), box.alias("box"), value(score).alias("score"), F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = given.withColumn("id", F.monotonically_increasing_id()).checkpoint()
    order = F.struct((-F.col("score")).alias("worse"), *[F.col(f"box.{c}").alias(c) for c in _SIDES], F.col("id").alias("id"))
    on = ["none", "image", "level", "cx", "cy"]
    each = rows.filter("fine").select(F.col("image").isNull().alias("none"), F.coalesce(F.col("image").cast("string"), F.lit("")).alias("image"), "box", order.alias("order"), "id")
    flat = (F.col("box.x2") - F.col("box.x1")) * (F.col("box.y2") - F.col("box.y1")) == 0  # overlaps nothing
    alone = F.when(~(overlap(F.col("box"), F.col("box")) > share), F.col("id"))  # areas beyond the numbers there are
    kept = each.filter(flat).select("id")
    left = each.filter(~flat).groupBy("none", "image", "box", alone.alias("alone")).agg(F.min("order").alias("order")).select("none", "image", "box", "order", F.col("order.id").alias("id")).checkpoint()
    while not left.isEmpty():
        cells = _cells(left, more)
        best = cells.groupBy(*on).agg(F.min("order").alias("best"))
        first = cells.join(best, on).groupBy("id").agg(F.min(F.col("order") == F.col("best")).alias("first")).filter("first").select("id")
        stay = left.join(first.hint("merge"), "id", "left_semi").checkpoint()
        kept = kept.unionByName(stay.select("id"))
        near = _cells(stay.select("none", "image", F.col("box").alias("by"), F.col("box"), "id"), more).select(*on, "by", F.col("id").alias("of"))
        gone = cells.join(near, on).filter((F.col("id") == F.col("of")) | (overlap(F.col("box"), F.col("by")) > share)).select("id").distinct()
        left = left.join(gone.hint("merge"), "id", "left_anti").checkpoint()
    return rows.join(kept.withColumn("stays", F.lit(True)), "id", "left").select("row.*", F.when(F.col("fine"), F.col("stays").isNotNull()).alias("kept"))
