"""Boxes as column expressions: arrays or texts `(x1, y1, x2, y2)`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTS = "struct<x1:int,y1:int,x2:int,y2:int>"


def numbers(text: Column) -> Column:
    """The numbers of a box's text; null where it is none."""
    return F.from_json(F.translate(text, "()", "[]"), "array<double>")


def finite(values: Column) -> Column:
    """Whether there are four finite numbers."""
    return F.coalesce((F.size(values) == 4) & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def _struct(*values: Column) -> Column:
    return F.struct(*[v.cast("int").alias(n) for v, n in zip(values, ("x1", "y1", "x2", "y2"))])


def parsed(text: Column) -> Column:
    """A box of four numbers with x1 < x2, y1 < y2 and none negative, rounded half to even; else null."""
    n = numbers(text)
    v = [F.get(n, F.lit(k)) for k in range(4)]
    ok = finite(n) & (v[0] >= 0) & (v[1] >= 0) & (v[2] > v[0]) & (v[3] > v[1])
    return F.when(ok, _struct(*map(F.bround, v)))


def official(values: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """Whether four whole numbers are a 1-based inclusive box, inside the image if its size is given."""
    v = [F.get(values, F.lit(k)) for k in range(4)]
    ok = finite(values) & F.forall(values, lambda x: x == F.floor(x)) & (v[0] >= 1) & (v[1] >= 1) & (v[0] < v[2]) & (v[1] < v[3])
    if width is not None:
        ok = ok & (v[2] <= width) & (v[3] <= height)
    return F.coalesce(ok, F.lit(False))


def zero_based(values: Column) -> Column:
    """From 1-based inclusive to 0-based half-open."""
    v = [F.get(values, F.lit(k)) for k in range(4)]
    return _struct(v[0] - 1, v[1] - 1, v[2], v[3])


def clamped(values: Column | list[Column], width: Column, height: Column) -> Column:
    """Rounded (half to even) and inside the image; null if nothing is left. `values` is an array, or four columns, which stay in generated code."""
    if isinstance(values, Column):
        ok, each = finite(values), [F.get(values, F.lit(k)) for k in range(4)]
    else:
        ok, each = F.lit(True), values
        for v in values:
            ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    v = [F.bround(x) for x in each]
    x1, x2 = (F.greatest(F.lit(0), F.least(v[k], width)).cast("int") for k in (0, 2))
    y1, y2 = (F.greatest(F.lit(0), F.least(v[k], height)).cast("int") for k in (1, 3))
    return F.when(ok & (x2 > x1) & (y2 > y1), _struct(x1, y1, x2, y2))


def padded(box: Column, width: Column, height: Column, share: float = 0.15) -> Column:
    """A box with `share` of its size more on each side, cut to whole numbers and to the image."""
    dx, dy = (box["x2"] - box["x1"]) * share, (box["y2"] - box["y1"]) * share
    whole = lambda c: c.cast("int")
    return _struct(
        F.greatest(F.lit(0), whole(box["x1"] - dx)), F.greatest(F.lit(0), whole(box["y1"] - dy)), F.least(width, whole(box["x2"] + dx)), F.least(height, whole(box["y2"] + dy))
    )


def clipped(box: Column, width: Column, height: Column) -> Column:
    return _struct(F.least(box["x1"], width), F.least(box["y1"], height), F.least(box["x2"], width), F.least(box["y2"], height))


def aspect(width: Column, height: Column) -> Column:
    return F.round(width / height, 2)
