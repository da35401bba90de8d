"""Audits of label tables: each finds the rows that break a rule; gates raise on what they find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabulon.errors import RefusedInput
from tabulon.functions import boxes
from tabulon.schemas import require_columns


def manifest_audit(df: DataFrame, label: str, key: Column, split: str = "split", box: str | None = None) -> DataFrame:
    """One row of counts: rows, classes, train_rows, test_rows, invalid_split_rows, missing_labels, invalid_bbox_rows, duplicate_path_rows, train_test_path_overlap, labels_only_in_test."""
    require_columns(df, label, split)
    of, lab = F.col(split), F.col(label)
    bad_box = F.count_if(boxes.parsed(F.col(box).cast("string")).isNull()) if box else F.lit(0).cast("long")
    rows = df.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(lab).alias("classes"), F.count_if(of == "train").alias("train_rows"), F.count_if(of == "test").alias("test_rows"),
        F.count_if(~F.coalesce(of.isin("train", "test"), F.lit(False))).alias("invalid_split_rows"), F.count_if(lab.isNull()).alias("missing_labels"), bad_box.alias("invalid_bbox_rows"),
    )
    both = lambda c: (F.max(F.when(of == "train", 1)) == 1) & (F.max(F.when(of == "test", 1)) == 1)
    keys = df.withColumn("_key", key).groupBy("_key").agg(F.count(F.lit(1)).alias("n"), both("_key").alias("both")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_path_rows"), F.count_if("both").alias("train_test_path_overlap")
    )
    unseen = only_in_test(df, label, split).agg(F.count(F.lit(1)).alias("labels_only_in_test"))
    return rows.crossJoin(F.broadcast(keys)).crossJoin(F.broadcast(unseen))  # one row each


def require_clean(audit: DataFrame) -> None:
    """Refuses an audit with invalid splits, missing labels, bad boxes, repeated or overlapping paths or unseen labels."""
    row = audit.first().asDict()
    found = {k: row[k] for k in ("invalid_split_rows", "missing_labels", "invalid_bbox_rows", "duplicate_path_rows", "train_test_path_overlap", "labels_only_in_test") if row[k]}
    if found:
        raise RefusedInput(f"the manifest's audit finds {found}")


def only_in_test(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """The labels that test rows have and train rows don't."""
    of = lambda s: df.filter((F.col(split) == s) & F.col(label).isNotNull()).select(label)
    return of("test").subtract(of("train"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def same_sets(a: DataFrame, b: DataFrame, key: str) -> bool:
    return a.select(key).subtract(b.select(key)).isEmpty() and b.select(key).subtract(a.select(key)).isEmpty()


def duplicate_groups(df: DataFrame, content: str = "sha256", split: str = "split") -> DataFrame:
    """content, rows, split_count of contents that several rows have."""
    return df.groupBy(content).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(split).alias("split_count")).filter("rows > 1")


def duplicate_members(df: DataFrame, content: str = "sha256", split: str = "split") -> DataFrame:
    return df.join(duplicate_groups(df, content, split).select(content), content, "left_semi")


def conflicting(df: DataFrame, label: str, content: str = "sha256") -> DataFrame:
    """content, labels: contents that carry several labels."""
    return df.groupBy(content).agg(F.countDistinct(label).alias("labels")).filter("labels > 1")


def reconcile(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, field: rows of `left` that `right` doesn't have (field `missing`) or has otherwise; null equals null."""
    r = right.select(F.col(key).alias("_k"), F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = left.join(r, F.col(key).eqNullSafe(F.col("_k")), "left")
    differs = [F.when(F.col("_there") & ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns]
    fields = F.array_compact(F.array(F.when(F.col("_there").isNull(), F.lit("missing")), *differs))
    return joined.select(key, F.explode(fields).alias("field"))


def require_unique(df: DataFrame, *columns: str) -> DataFrame:
    """`df`, if no row repeats a value of a column."""
    for c in columns:
        twice = [r[0] for r in df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(5).collect()]
        if twice:
            raise RefusedInput(f"column {c!r} repeats {twice}")
    return df


def coverage(official: DataFrame, manifest: DataFrame, key: str, by: str) -> DataFrame:
    """by, both, official_only, manifest_only: how the keys of two tables cover each other."""
    o, m = official.select(key, F.col(by).alias("o_by"), F.lit(1).alias("o")), manifest.select(key, F.col(by).alias("m_by"), F.lit(1).alias("m"))
    joined = o.join(m, key, "full")
    return joined.groupBy(F.coalesce("o_by", "m_by").alias(by)).agg(
        F.count_if(F.col("o").isNotNull() & F.col("m").isNotNull()).alias("both"), F.count_if(F.col("m").isNull()).alias("official_only"), F.count_if(F.col("o").isNull()).alias("manifest_only")
    )


def frozen_split(frame: DataFrame, official: DataFrame, label: str, test_contents: DataFrame, columns: list[str], key: str = "relative_key", content: str = "sha256") -> DataFrame:
    """rule, n: how many rows of a frozen split break each rule; a sound split gives no rows."""
    fields = [key, content, *columns, "experiment_split"]
    require_columns(frame, *dict.fromkeys([*fields, label]))
    empty = F.lit(False)
    for c in fields:
        empty = empty | F.col(c).isNull()
    of = F.col("experiment_split")
    fits = F.col("split").eqNullSafe("train") & F.coalesce(of.isin("train", "validation"), F.lit(False))
    # the rules on single rows go with the groups of a content; the others need a table of their own
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    contents = frame.groupBy(content).agg(F.count(F.lit(1)).alias("n"), F.count_if(empty).alias("empty"), F.count_if(~fits).alias("unfit")).join(test_contents.select(content).distinct().withColumn("_test", F.lit(1)), content, "left")
    first = contents.agg(n("empty").alias("missing value"), F.count_if(F.col("n") > 1).alias("repeated content"), n("unfit").alias("not train or validation of official train"), n(F.col("n") * F.col("_test")).alias("content of the official test"))
    keys = frame.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated key"))
    sides = frame.groupBy(label).agg(F.max(of.eqNullSafe("train")).alias("t"), F.max(of.eqNullSafe("validation")).alias("v")).agg(F.count_if(F.col("t") != F.col("v")).alias("class in one part only"))
    differs = reconcile(frame, official, key, columns).agg(F.count(F.lit(1)).alias("differs from the manifest"))
    row = first.crossJoin(F.broadcast(keys)).crossJoin(F.broadcast(sides)).crossJoin(F.broadcast(differs))  # one row each
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("n")) for c in row.columns]))).filter("n > 0")


def missing_files(df: DataFrame, path: str, files: DataFrame) -> DataFrame:
    """The rows of `df` whose path `files` (path) doesn't list."""
    listed = files.select(F.col("path").alias("_listed")).distinct()
    return df.join(listed, F.col(path) == F.col("_listed"), "left_anti")


def existing_files(df: DataFrame, path: str, files: DataFrame) -> DataFrame:
    """The rows of `df` whose path `files` (path) lists."""
    listed = files.select(F.col("path").alias("_listed")).distinct()
    return df.join(listed, F.col(path) == F.col("_listed"), "left_semi")


def preflight(df: DataFrame, path: str, files: DataFrame) -> DataFrame:
    """`df`, if all of its images can be used: paths that lead up or are empty, and files that aren't there, are counted and refused before any is read."""
    climbs = F.array_contains(F.split(F.translate(F.col(path), "\\", "/"), "/"), "..") | (F.trim(F.col(path)) == "")
    bad = F.coalesce(climbs, F.lit(True))
    reason = lambda rows, why: rows.select(F.col(path).alias("path"), F.lit(why).alias("reason"))
    unusable = reason(df.filter(bad), "unusable path").unionByName(reason(missing_files(df.filter(~bad), path, files), "missing file"))
    n = unusable.count()
    if n:
        raise RefusedInput(f"{n} images are missing or unusable, such as {[tuple(r) for r in unusable.limit(3).collect()]}")
    return df


def body_label_matches(identifier: Column, label: Column, name: Column) -> Column:
    """Whether a body label agrees with its official id, whose 1-based name is `name` (null if there is none); id 0 stands for no label."""
    return F.when(identifier == 0, label.isNull()).otherwise(F.coalesce(name.isNotNull() & (label == name), F.lit(False)))


def body_eligibility(df: DataFrame, attributes: DataFrame, names: DataFrame, label: str = "car_type_name") -> DataFrame:
    """`df` with official_type_id and status: `unavailable` for id 0, `valid`, `conflict` or `unknown model`."""
    joined = df.join(attributes.select("model_id", F.col("type").alias("official_type_id")), "model_id", "left")
    named = joined.join(names.select(F.col("id").alias("official_type_id"), F.col("name").alias("_name")), "official_type_id", "left")
    fine = F.coalesce(F.col(label) == F.col("_name"), F.lit(False))
    status = F.when(F.col("official_type_id").isNull(), "unknown model").when(F.col("official_type_id") == 0, "unavailable").when(fine, "valid").otherwise("conflict")
    return named.withColumn("status", status).drop("_name")


def malformed_hashes(df: DataFrame, column: str = "sha256") -> DataFrame:
    return df.filter(~F.coalesce(F.col(column).rlike("^[0-9a-f]{64}$"), F.lit(False)))


def integrity(listed: DataFrame, files: DataFrame) -> DataFrame:
    """name, expected and actual bytes and crc32, sha256, status (ok, mismatch, missing) of an inventory against files (name, content)."""
    actual = files.select("name", F.length("content").cast("long").alias("actual_bytes"), F.crc32("content").alias("actual_crc32"), F.sha2("content", 256).alias("sha256"))
    joined = listed.join(actual, "name", "left")
    same = (F.col("actual_bytes") == F.col("expected_bytes")) & (F.col("actual_crc32") == F.col("expected_crc32"))
    return joined.withColumn("status", F.when(F.col("actual_bytes").isNull(), "missing").when(same, "ok").otherwise("mismatch"))


def dominant_share(df: DataFrame, group: str, label: str, least_rows: int = 3, share: float = 0.8) -> DataFrame:
    """group, rows, label, share: groups in which one label has at least `share` of at least `least_rows` rows."""
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    every = counts.groupBy(group).agg(F.sum("n").alias("rows"), F.max(F.struct("n", label)).alias("top"))
    return every.select(group, "rows", F.col(f"top.{label}").alias(label), (F.col("top.n") / F.col("rows")).alias("share")).filter((F.col("rows") >= least_rows) & (F.col("share") >= share))


def first_per(df: DataFrame, by: str, order: list[str | Column]) -> DataFrame:
    """The first row of each `by` in `order`."""
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter("_nth = 1").drop("_nth")
