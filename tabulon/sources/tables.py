"""Reading and writing of tables: CSV with missing tokens, attribute files, matrices, key lists, class lists, detections."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.errors import RefusedInput
from tabulon.functions.labels import csv_value
from tabulon.operators.gates import read_json


def read_csv(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header: texts that stand for a missing value become null, blanks stay; with `schema`, columns are cast, null where that fails."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').option("multiLine", True).csv(path)
    if columns:
        raw = raw.select(*columns)
    out = raw.select(*[csv_value(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if schema is None:
        return out
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
    return out.select(*[F.col(f"`{c}`").try_cast(kinds.get(c, "string")).alias(c) for c in out.columns])


def read_columns(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """A file of columns between blanks, with a header unless `names` are given; all texts."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).filter("value != ''")
    if names is None:
        first = spark.read.text(path).filter(F.trim("value") != "").first()
        names = first.value.split()
        lines = lines.filter(F.array_join(F.split("value", r"\s+"), " ") != " ".join(names))
    parts = F.split("value", r"\s+")
    return lines.select(*[F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(names)])


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """key: the lines of a file, without blanks around them, each once."""
    return spark.read.text(path).select(F.trim("value").alias("key")).filter("key != ''").distinct()


def read_label_files(spark: SparkSession, path: str) -> DataFrame:
    """path, viewpoint, car_type, bbox of label files: a number, a number, and four numbers on their lines."""
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", r"\r?\n").alias("lines"))
    number = lambda k: F.trim(F.get("lines", F.lit(k))).try_cast("int")
    box = F.transform(F.split(F.trim(F.get("lines", F.lit(2))), r"\s+"), lambda x: x.try_cast("int"))
    return whole.select("path", number(0).alias("viewpoint"), number(1).alias("car_type"), F.when(F.size(box) == 4, box).alias("bbox"))


def class_list(payload: Any) -> list[str]:
    """Classes of a JSON list, or of a JSON object from names to positions 0..n-1; anything else is refused."""
    if isinstance(payload, dict):
        for name, at in payload.items():
            if isinstance(at, bool) or not isinstance(at, int):
                raise RefusedInput(f"position of {name!r} is no whole number: {at!r}")
        if sorted(payload.values()) != list(range(len(payload))):
            raise RefusedInput("positions must be 0..n-1, each once")
        payload = sorted(payload, key=payload.get)
    if not isinstance(payload, list) or not payload:
        raise RefusedInput("a class list must be a JSON list or object with classes")
    if not all(isinstance(c, str) and c.strip() for c in payload):
        raise RefusedInput("class names must be texts that aren't empty")
    if len(set(payload)) < len(payload):
        raise RefusedInput("class names are repeated")
    return payload


def read_classes(spark: SparkSession, path: str) -> list[str]:
    return class_list(read_json(spark, path))


def checked_count(value: Any) -> int:
    """A count of 64 bits; no booleans, fractions, negatives, texts or numbers that aren't finite. 1.0 is 1."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise RefusedInput(f"no count: {value!r}")
    if isinstance(value, float) and (not math.isfinite(value) or value != int(value)):
        raise RefusedInput(f"no whole count: {value!r}")
    if not 0 <= int(value) < 1 << 63:
        raise RefusedInput(f"count out of range: {value!r}")
    return int(value)


def matrix_cells(spark: SparkSession, classes: list[str], matrix: list[list[Any]]) -> DataFrame:
    """target_id, prediction_id, n of a square matrix over the classes; rows are targets."""
    class_list(classes)
    if len(matrix) != len(classes) or any(not isinstance(row, list) or len(row) != len(classes) for row in matrix):
        raise RefusedInput(f"the matrix isn't square over {len(classes)} classes")
    found = [(t, p, checked_count(v)) for t, row in enumerate(matrix) for p, v in enumerate(row)]
    if not any(n for _, _, n in found):
        raise RefusedInput("the matrix has no counts")
    return spark.createDataFrame(found, "target_id int, prediction_id int, n long")


def read_matrix(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Classes and cells of a confusion matrix in JSON (classes, confusion_matrix) or CSV (class names before the rows and above)."""
    if path.lower().endswith(".json"):
        payload = read_json(spark, path)
        if not isinstance(payload, dict) or not {"classes", "confusion_matrix"} <= set(payload):
            raise RefusedInput("a matrix in JSON needs classes and confusion_matrix")
        return payload["classes"], matrix_cells(spark, payload["classes"], payload["confusion_matrix"])
    raw = spark.read.option("header", True).csv(path)
    label, *names = raw.columns
    rows = [r.asDict() for r in raw.collect()]  # a row for each class
    if [r[label] for r in rows] != names:
        raise RefusedInput("rows and columns must list the same classes in the same order")

    def number(text):
        try:
            return float(text) if "." in text or "e" in text.lower() else int(text)
        except (TypeError, ValueError, AttributeError):
            return text

    return names, matrix_cells(spark, names, [[number(r[n]) for n in names] for r in rows])


def detections(df: DataFrame, column: str, schema: str | None = None) -> DataFrame:
    """`df` with position, vehicle_crop_id, bbox_xyxy, confidence: a row for each detection of a JSON object with `detections`, or of a bare list."""
    from tabulon.schemas import DETECTION

    kind = schema or DETECTION
    text = F.col(column)
    found = F.coalesce(F.from_json(text, f"struct<detections:array<struct<{_colons(kind)}>>>")["detections"], F.from_json(text, f"array<struct<{_colons(kind)}>>"))
    rows = df.select(*df.columns, F.posexplode(found).alias("position", "_d"))
    names = [x.strip().split()[0] for x in kind.split(", ")]
    number = F.coalesce(F.nullif(F.col("_d.vehicle_crop_id"), F.lit("")), F.format_string("vehicle_%03d", F.col("position") + 1))
    return rows.withColumns({n: number if n == "vehicle_crop_id" else F.col(f"_d.{n}") for n in names}).drop("_d")


def _colons(ddl: str) -> str:
    return ",".join(":".join(x.strip().split(" ", 1)) for x in ddl.split(", "))


# ---------------------------------------------------------------- sinks


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header into a fresh folder, blanks around values kept; `single` for tables that are known to be small."""
    writer = (df.coalesce(1) if single else df).write.mode("errorifexists").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def matrix_table(cell: DataFrame, classes: DataFrame) -> DataFrame:
    """target and a column for each class, in order: the layout that read_matrix reads."""
    names = [r.raw_label for r in classes.orderBy("class_id").select("raw_label").collect()]
    label = lambda k: F.broadcast(classes.select(F.col("class_id").alias(f"{k}_id"), F.col("raw_label").alias(k)))
    wide = cell.join(label("target"), "target_id").join(label("prediction"), "prediction_id").groupBy("target_id", "target").pivot("prediction", names).sum("n")
    return wide.orderBy("target_id").drop("target_id").na.fill(0)


def strict_json(value: Any) -> str:
    """JSON, refused where a number isn't finite."""
    try:
        return json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False, sort_keys=False)
    except ValueError as error:
        raise RefusedInput(f"a number isn't finite: {error}") from error


def tuning_examples(df: DataFrame, prompt: str, uri: str, prefix: str, make: str = "make_name", model: str = "model_name", body: str = "car_type_name", path: str = "image_path", order: str = "position") -> DataFrame:
    """value: a JSON line for each row, a user part with the file and the prompt and a model part with the cleaned labels."""
    from tabulon.functions.matching import clean_make, clean_model
    from tabulon.functions.paths import mime

    ext = F.coalesce(F.nullif(F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)), F.lit("")), F.lit(".jpg"))
    name = F.concat(F.format_string(f"{prefix}_%04d", F.col(order)), ext)
    answer = F.to_json(F.struct(clean_make(F.col(make)).alias("make"), clean_model(F.col(model), F.col(make)).alias("model"), F.trim(F.col(body)).alias("body_type")))
    file = F.struct(mime(name).alias("mimeType"), F.concat(F.lit(f"{uri}/images/"), name).alias("fileUri"))
    none = F.lit(None)
    part = lambda file, text: F.struct(file.cast("struct<mimeType:string,fileUri:string>").alias("fileData"), text.cast("string").alias("text"))
    user = F.struct(F.lit("user").alias("role"), F.array(part(file, none), part(none, F.lit(prompt))).alias("parts"))
    said = F.struct(F.lit("model").alias("role"), F.array(part(none, answer)).alias("parts"))
    return df.select(F.to_json(F.struct(F.array(user, said).alias("contents"))).alias("value"))


def write_lines(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("errorifexists").text(path)
