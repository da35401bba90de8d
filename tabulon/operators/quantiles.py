"""Exact quantiles of columns of any size, of all rows or by group, without a task that holds a group's values.

A sketch of bounded size proposes three values around each wanted rank; rows below and equal to them are counted exactly,
and only the rows between the two that enclose the rank are looked at in the next round. Each round leaves less than
a hundredth of the rows before, and what is left at last, `FEW` values at most, is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.errors import RefusedInput
from tabulon.session import shared_folder

#: Values of a wanted rank that are sorted in one place, parts of the sketch's grid, and its accuracy.
FEW, GRID, ACCURACY = 5_000, 512, 10_000
#: Groups whose states (some hundred bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 50_000

_WANT = "struct<rank:long,low:double,high:double,below:long,inside:long,value:double>"


def _state(rank: Column, low: Column, high: Column, below: Column, inside: Column, value: Column) -> Column:
    return F.struct(rank.alias("rank"), low.alias("low"), high.alias("high"), below.alias("below"), inside.alias("inside"), value.alias("value")).cast(_WANT)


def _within(v: Column, want: Column) -> Column:
    """Whether a value lies where the wanted one must be, which isn't found yet."""
    return want["value"].isNull() & (want["low"].isNull() | (v > want["low"])) & (want["high"].isNull() | (v < want["high"]))


def _with(rows: DataFrame, state: DataFrame, keys: list[str], few: bool) -> DataFrame:
    right = F.broadcast(state) if few else state
    return rows.join(right, keys) if keys else rows.crossJoin(F.broadcast(state))  # one row


def _narrowed(want: Column, k: int, names: list[str]) -> Column:
    """The state after the values that were proposed are counted: found, or between two of them."""
    value, low, high, below, above = want["value"], want["low"], want["high"], want["below"], want["below"] + want["inside"]
    for j in range(3):
        m, less, equal = F.col(names[3 * j]), F.col(names[3 * j + 1]), F.col(names[3 * j + 2])
        known = m.isNotNull() & want["value"].isNull()
        hit = known & (want["rank"] >= less) & (want["rank"] < less + equal)
        after = known & (want["rank"] >= less + equal) & (low.isNull() | (m >= low))
        before = known & (want["rank"] < less) & (high.isNull() | (m <= high))
        value = F.when(hit, m).otherwise(value)
        low, below = F.when(after, m).otherwise(low), F.when(after, less + equal).otherwise(below)
        high, above = F.when(before, m).otherwise(high), F.when(before, less).otherwise(above)
    return _state(want["rank"], low, high, below, F.when(value.isNotNull(), F.lit(0)).otherwise(above - below), value)


def quantiles(df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """`by`, n, q0, q1, ...: exact quantiles by linear interpolation, and the number of values.

    Null and NaN values are left out; a group without others has no row, and neither has an empty table. Null groups are a group.
    """
    if not shares or not all(0 <= s <= 1 for s in shares):
        raise RefusedInput("shares must be between 0 and 1")
    shared_folder(df.sparkSession)
    keys = [f"__k{i}" for i in range(len(by))]
    told = [f"__n{i}" for i in range(len(by))]  # whether a key is null, as joins don't match nulls
    v = F.col("__v")
    given = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], F.col(f"`{column}`").cast("double").alias("__v")).filter(v.isNotNull() & ~F.isnan(v))
    kinds = [given.schema[k].dataType for k in keys]
    rows = given.withColumns({n: F.col(k).isNull() for n, k in zip(told, keys)} | {k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys})
    on, wants = [*keys, *told], 2 * len(shares)
    place = [F.lit(float(s)) * (F.col("__rows") - 1) for s in shares]
    ranks = [r.cast("long") for p in place for r in (F.floor(p), F.ceil(p))]
    no = F.lit(None)
    first = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__rows"))
    state = first.select(*on, "__rows", *[_state(r, no, no, F.lit(0), F.col("__rows"), no).alias(f"w{k}") for k, r in enumerate(ranks)]).filter("__rows > 0").checkpoint()
    few = state.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    w = [F.col(f"w{k}") for k in range(wants)]
    whole = True  # in the first round all ranks are looked for among all rows: one sketch tells of each
    while state.filter(F.greatest(*[x["inside"] for x in w], F.lit(0)) > FEW).limit(1).count():
        grid = [j / GRID for j in range(GRID + 1)]
        seen = _with(rows, state, on, few).groupBy(*on).agg(*[F.percentile_approx(F.when(_within(v, x), v), grid, F.lit(ACCURACY)).alias(f"g{k}") for k, x in enumerate(w[:1] if whole else w)])
        probed = state.join(seen, on) if on else state.crossJoin(F.broadcast(seen))
        at = lambda k: F.coalesce(F.try_divide(w[k]["rank"] - w[k]["below"], w[k]["inside"]), F.lit(0.0)) * GRID
        near = lambda k, j: F.get("g0" if whole else f"g{k}", F.greatest(F.lit(0), F.least(F.lit(GRID), F.floor(at(k)) + (0, 1, 2)[j] - (1, 0, 0)[j])).cast("int"))
        probed = probed.select(*on, "__rows", *[f"w{k}" for k in range(wants)], *[near(k, j).alias(f"m{k}_{j}") for k in range(wants) for j in range(3)]).checkpoint()
        whole = False
        counts = [c for k in range(wants) for j in range(3) for c in (F.count_if(v < F.col(f"m{k}_{j}")).alias(f"l{k}_{j}"), F.count_if(v == F.col(f"m{k}_{j}")).alias(f"e{k}_{j}"))]
        counted = _with(rows, probed, on, few).groupBy(*on).agg(*counts)
        both = probed.join(counted, on) if on else probed.crossJoin(F.broadcast(counted))
        names = lambda k: [f"{c}{k}_{j}" for j in range(3) for c in "mle"]
        state = both.select(*on, "__rows", *[_narrowed(w[k], k, names(k)).alias(f"w{k}") for k in range(wants)]).checkpoint()
    left = _with(rows, state, on, few).groupBy(*on).agg(*[F.sort_array(F.collect_list(F.when(_within(v, x), v))).alias(f"c{k}") for k, x in enumerate(w)])
    ended = state.join(left, on) if on else state.crossJoin(F.broadcast(left))
    value = [F.coalesce(x["value"], F.get(f"c{k}", (x["rank"] - x["below"]).cast("int"))) for k, x in enumerate(w)]
    part = [p - F.floor(p) for p in place]
    out = [(value[2 * i] + (value[2 * i + 1] - value[2 * i]) * part[i]).alias(f"q{i}") for i in range(len(shares))]
    names = [F.when(~F.col(n), F.col(k)).cast(kind).alias(c) for n, k, kind, c in zip(told, keys, kinds, by)]
    return ended.select(*names, F.col("__rows").alias("n"), *out)


def description(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """`by`, n, mean, sd (of a sample), min, q1, median, q3, max: a row for each group, or one. Null and NaN values are left out."""
    v = F.col(f"`{column}`").cast("double")
    some = df.filter(v.isNotNull() & ~F.isnan(v))
    whole = some.groupBy(*[F.col(f"`{c}`").alias(f"__{c}") for c in by]).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))
    found = quantiles(df, column, (0.25, 0.5, 0.75), by).select(*[f"`{c}`" for c in by], "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    if not by:
        return found.crossJoin(F.broadcast(whole)).select("n", "mean", "sd", "min", "q1", "median", "q3", "max")  # one row each
    same = F.lit(True)
    for c in by:
        same = same & found[c].eqNullSafe(whole[f"__{c}"])
    return found.join(whole, same).select(*by, "n", "mean", "sd", "min", "q1", "median", "q3", "max")


def outliers(df: DataFrame, column: str, reach: float = 1.5) -> DataFrame:
    """The rows of `df` whose value lies more than `reach` quartile ranges outside of the quartiles."""
    q = quantiles(df, column, (0.25, 0.75)).select(F.col("q0").alias("__a"), F.col("q1").alias("__b"))
    v, gap = F.col(f"`{column}`"), (F.col("__b") - F.col("__a")) * reach
    return df.crossJoin(F.broadcast(q)).filter((v < F.col("__a") - gap) | (v > F.col("__b") + gap)).drop("__a", "__b")  # one row
