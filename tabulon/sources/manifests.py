"""Manifests of image folders, as listings joined with labels and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.paths import label_path, slashes

# Colours by their ids.
COLOURS = {-1: "unrecognized", 0: "black", 1: "white", 2: "red", 3: "yellow", 4: "blue", 5: "green", 6: "purple", 7: "brown", 8: "champagne", 9: "silver"}
# Viewpoints by their codes.
VIEWPOINTS = {1: "front", 2: "rear", 3: "side", 4: "front-side", 5: "rear-side"}


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path of all files below `root`; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path")


def _from_end(path: Column, k: int) -> Column:
    return F.element_at(F.split(slashes(path), "/"), -k)


def web_manifest(files: DataFrame, labels: DataFrame | None = None, attributes: DataFrame | None = None) -> DataFrame:
    """image_path, make_id, model_id, year (from make/model/year/file), bbox, viewpoint, car_type of label files by path, type of the model's attributes."""
    out = files.select(
        F.col("path").alias("image_path"), _from_end(F.col("path"), 4).alias("make_id"), _from_end(F.col("path"), 3).try_cast("int").alias("model_id"), _from_end(F.col("path"), 2).alias("year"),
        F.array_join(F.slice(F.split(slashes(F.col("path")), "/"), -4, 4), "/").alias("relative_key"),
    )
    if labels is not None:
        of = labels.select(F.array_join(F.slice(F.split(slashes(F.col("path")), "/"), -4, 4), "/").alias("_label"), "bbox", "viewpoint", "car_type")
        out = out.join(of, label_path(F.col("relative_key")) == F.col("_label"), "left").drop("_label")
    if attributes is not None:
        out = out.join(attributes.select(F.col("model_id").cast("int"), F.col("type").cast("int")), "model_id", "left")
    return out


def ordinal(df: DataFrame, id_column: str, names: DataFrame, out: str) -> DataFrame:
    """`df` with the name (id from 1, name) of an id; null where the id has none."""
    return df.join(names.select(F.col("id").alias("_id"), F.col("name").alias(out)), F.col(id_column).cast("int") == F.col("_id"), "left").drop("_id")


def colour_name(identifier: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair]), identifier)


def membership(df: DataFrame, key: str, train: DataFrame, test: DataFrame, out: str = "split") -> DataFrame:
    """`df` with train, test or null: which list (key) has its key; train wins."""
    listed = train.select("key", F.lit(1).alias("_train")).unionByName(test.select("key", F.lit(None).cast("int").alias("_train"))).groupBy("key").agg(F.max("_train").alias("_train"))
    joined = df.join(listed.withColumn("_in", F.lit(True)), F.col(key) == F.col("key"), "left")
    joined = joined if key == "key" else joined.drop(listed["key"])
    return joined.withColumn(out, F.when(F.col("_train") == 1, "train").when(F.col("_in"), "test")).drop("_train", "_in")


def surveillance_manifest(files: DataFrame, colours: DataFrame, names: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """image_path, surveillance_model_id (from model/file), make_name, model_name, web_nature_model_id, color_id, color_name, split.

    `colours` has relative_key and color_id; `names` has surveillance_model_id (from 1), make_name, model_name, web_nature_model_id.
    """
    out = files.select(F.col("path").alias("image_path"), _from_end(F.col("path"), 2).try_cast("int").alias("surveillance_model_id"), F.array_join(F.slice(F.split(slashes(F.col("path")), "/"), -2, 2), "/").alias("relative_key"))
    out = out.join(names, "surveillance_model_id", "left").join(colours.select("relative_key", "color_id"), "relative_key", "left")
    out = membership(out.withColumn("color_name", colour_name(F.col("color_id"))), "relative_key", train, test).drop("key")
    return out.select("image_path", "surveillance_model_id", "make_name", "model_name", "web_nature_model_id", "color_id", "color_name", "split")


def viewpoints(df: DataFrame, column: str = "viewpoint") -> DataFrame:
    """viewpoint, name, n; a code without a name is `unknown-` and the code."""
    name = F.try_element_at(F.create_map(*[F.lit(x) for pair in VIEWPOINTS.items() for x in pair]), F.col(column).cast("int"))
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.coalesce(name, F.concat(F.lit("unknown-"), F.col(column).cast("string"))))
