"""Deterministic splits that don't leak: ranks go by a hash of seed and key, so they need no generator and no order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabulon.errors import RefusedInput
from tabulon.operators.audit import conflicting, first_per


def hashed(seed: int | str, key: Column) -> Column:
    """What rows are ranked by."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256)


def _ranked(df: DataFrame, label: str, seed: int | str, key: str) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(label).orderBy(hashed(seed, F.col(key)), key)))


def capped_split(df: DataFrame, label: str, cap: int, seed: int | str, key: str = "relative_key", content: str = "sha256", reserved: DataFrame | None = None, share: float = 0.2) -> DataFrame:
    """key, content, label, experiment_split of at most `cap` train rows a class, one for each content.

    Train rows leave whose content is in test or in `reserved`, or carries several labels. Of those of one
    content the one with the smallest key stays. Of a class's chosen rows, the first `share` (rounded up, 1 at
    least) are for validation.
    """
    tested = df.filter(F.col("split") == "test").select(content)
    if reserved is not None:
        tested = tested.union(reserved.select(content))
    blocked = tested.union(conflicting(df, label, content).select(content)).distinct()
    eligible = df.filter(F.col("split") == "train").join(blocked, content, "left_anti")
    chosen = _ranked(first_per(eligible, content, [key]), label, seed, key).filter(F.col("_rank") <= cap)
    n = F.count(F.lit(1)).over(W.partitionBy(label))
    validation = F.col("_rank") <= F.greatest(F.lit(1), F.ceil(n * share))
    return chosen.withColumn("experiment_split", F.when(validation, "validation").otherwise("train")).select(key, content, label, "experiment_split")


def capped_split_summary(df: DataFrame, split: DataFrame, label: str, content: str = "sha256") -> DataFrame:
    """official_train_rows, official_test_rows, train_rows, validation_rows, classes."""
    given = df.agg(F.count_if(F.col("split") == "train").alias("official_train_rows"), F.count_if(F.col("split") == "test").alias("official_test_rows"))
    made = split.agg(F.count_if(F.col("experiment_split") == "train").alias("train_rows"), F.count_if(F.col("experiment_split") == "validation").alias("validation_rows"), F.countDistinct(label).alias("classes"))
    return given.crossJoin(F.broadcast(made))  # one row each


def require_two_each(df: DataFrame, split: DataFrame, label: str) -> None:
    """Refuses a split in which a train class of `df` has less than two rows."""
    there = split.groupBy(label).count().filter("count > 1").select(label)
    few = [r[0] for r in df.filter(F.col("split") == "train").select(label).distinct().join(there, label, "left_anti").limit(5).collect()]
    if few:
        raise RefusedInput(f"not enough rows for classes {few}")


#: Hex digits of the hash by which rows are counted before any are ranked: 65,536 buckets of a class.
_DIGITS = 4


def first_by_hash(df: DataFrame, by: list[str], seed: int | str, key: str, share: Column, name: str = "chosen") -> DataFrame:
    """`df` with `name`: whether a row is among the first of its group by hash; `share` says how many, of the group's number of rows `_n`.

    Buckets of the hash are counted, so that all rows of earlier buckets are chosen as they are and only the rows of
    one bucket of a group are ranked: no task gets a whole group. A row without key goes by a hash of all it holds; a
    column of `df` called `name` is refused, others can't clash.
    """
    if name.lower() in [c.lower() for c in df.columns]:
        raise RefusedInput(f"there is a column {name} already")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    content = F.coalesce(F.col(f"`{key}`").cast("string"), F.to_json(row, {"ignoreNullFields": "false"}))
    groups = [f"_by{k}" for k in range(len(by))]
    rows = df.select(row.alias("row"), hashed(seed, content).alias("_hash"), content.alias("_key"), *[F.col(f"`{c}`").alias(g) for c, g in zip(by, groups)]).withColumn("_bucket", F.substring("_hash", 1, _DIGITS))
    counts = rows.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    whole = W.partitionBy(*groups)
    before = F.coalesce(F.sum("_c").over(whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = counts.withColumns({"_n": F.sum("_c").over(whole), "_before": before}).withColumn("_left", share.cast("long") - F.col("_before"))
    found = left.select(*[F.col(g).alias(f"{g}_of") for g in groups], F.col("_bucket").alias("_b"), "_c", "_left")
    same = F.col("_bucket") == F.col("_b")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_of"))
    joined = rows.join(found, same)
    sure = joined.filter((F.col("_left") <= 0) | (F.col("_left") >= F.col("_c"))).select("row", (F.col("_left") > 0).alias("_chosen"))
    order = W.partitionBy(*groups, "_bucket").orderBy("_hash", "_key")
    some = joined.filter((F.col("_left") > 0) & (F.col("_left") < F.col("_c"))).select("row", (F.row_number().over(order) <= F.col("_left")).alias("_chosen"))
    return sure.unionByName(some).select("row.*", F.col("_chosen").alias(name))


def stratified_split(df: DataFrame, label: str, fraction: float, seed: int | str, key: str) -> DataFrame:
    """`df` with experiment_split: test stays, and of each train class `fraction` (rounded, 1 at least) is for validation. Rows of a null class, or without key, are split as others are."""
    if not 0 < fraction < 1:
        raise RefusedInput("the fraction must be between 0 and 1")
    held = "experiment_split"
    train = first_by_hash(df.filter(F.col("split") == "train"), [label], seed, key, F.greatest(F.lit(1), F.round(F.col("_n") * fraction)), held)
    return train.withColumn(held, F.when(F.col(held), "validation").otherwise("train")).unionByName(df.filter(F.col("split") == "test").withColumn(held, F.lit("test")))


def group_split(df: DataFrame, group: str, fraction: float, seed: int | str) -> DataFrame:
    """`df` with experiment_split: whole groups of train go to validation, those with the smallest hashes, `fraction` of the groups (rounded up)."""
    if not 0 < fraction < 1:
        raise RefusedInput("the fraction must be between 0 and 1")
    of = lambda s: df.filter(F.col("split") == s)
    parts = df.filter(F.col("split").isin("train", "test")).groupBy(group).agg(F.max(F.col("split") == "train").alias("train"), F.max(F.col("split") == "test").alias("test"))
    wrong = parts.agg(F.max(F.col(group).isNull() & F.col("train")), F.max(F.col("train") & F.col("test") & F.col(group).isNotNull())).first()
    if wrong[0]:
        raise RefusedInput("rows have no group")
    if wrong[1]:
        raise RefusedInput("a group is in train and in test")
    groups = parts.filter("train").select(F.col(group).alias("of"))
    held = first_by_hash(groups, [], seed, "of", F.ceil(F.round(F.col("_n") * fraction, 6))).filter("chosen").select("of")
    # as a struct, the columns of `df` can't clash with those of the join
    rows = of("train").select(F.struct("*").alias("row"), F.col(group).alias("group"))
    train = rows.join(held, F.col("group") == F.col("of"), "left").select("row.*", F.when(F.col("of").isNotNull(), "validation").otherwise("train").alias("experiment_split"))
    return train.unionByName(of("test").withColumn("experiment_split", F.lit("test")))


def require_coverage(split: DataFrame, label: str) -> None:
    """Refuses a split whose validation or train lacks a class of the other, or whose test has a class that train lacks."""
    of = lambda s: split.filter(F.col("experiment_split") == s).select(label)
    for a, b in (("train", "validation"), ("validation", "train"), ("test", "train")):
        lost = [r[0] for r in of(a).subtract(of(b)).limit(5).collect()]
        if lost:
            raise RefusedInput(f"{b} lacks classes that {a} has: {lost}")


def sample_per_class(df: DataFrame, label: str, n: int, seed: int | str, key: str) -> DataFrame:
    return _ranked(df.filter(F.col(label).isNotNull()), label, seed, key).filter(F.col("_rank") <= n).drop("_rank")


def sample(df: DataFrame, n: int, seed: int | str, key: str) -> DataFrame:
    """`n` rows, the same on each run."""
    return df.orderBy(hashed(seed, F.col(key)), key).limit(n)


def shuffled(df: DataFrame, seed: int | str, key: str) -> DataFrame:
    return df.orderBy(hashed(seed, F.col(key)), key)


def running_best(history: DataFrame, score: str = "validation_macro_f1") -> DataFrame:
    """`history` with best_before and improved: whether the epoch is better than all before it."""
    before = W.orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)  # a row for each epoch: small
    best = history.withColumn("best_before", F.max(score).over(before))
    return best.withColumn("improved", F.col("best_before").isNull() | (F.col(score) > F.col("best_before")))


def best_epoch(history: DataFrame, score: str = "validation_macro_f1") -> DataFrame:
    return history.orderBy(F.desc(score), "epoch").limit(1)
