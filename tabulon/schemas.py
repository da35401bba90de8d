"""Declared schemas of the tables that the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabulon.errors import RefusedInput

MANIFEST = "image_path string, make_id string, model_id int, year string, bbox string, viewpoint int, car_type int, type int"
CLASSIFICATION_MANIFEST = f"{MANIFEST}, make_name string, model_name string, car_type_name string, relative_key string, split string"
SURVEILLANCE_MANIFEST = "image_path string, surveillance_model_id int, make_name string, model_name string, web_nature_model_id int, color_id int, color_name string, split string"
RESOLVED_INDEX = "source_image_path string, image_path string, relative_key string, split string, sha256 string"
IMAGE_CHECKS = "relative_key string, split string, status string, width int, height int, error string"
FILE_INTEGRITY = "name string, expected_bytes long, expected_crc32 long, status string, actual_bytes long, actual_crc32 long, sha256 string, error string"
PREDICTIONS = "sample_id string, task string, split string, declared_membership string, target string, prediction string, uncalibrated_score double, checkpoint_sha256 string"
CLASSES = "class_id int, raw_label string, display_label string, changed boolean"
DETECTION = "vehicle_crop_id string, bbox_xyxy array<double>, confidence double"
PROFILE = "make string, model string, body_type string, colour string, damage array<string>, accessories array<string>, confidence map<string,double>, status map<string,string>"
HISTORY = "epoch int, train_loss double, validation_accuracy double, validation_macro_f1 double, seconds double"


#: The label column of each task.
TASK_LABELS = {"make": "make_name", "body_type": "car_type_name", "colour": "color_name", "model": "model_name"}


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """`df`, if it has all columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise RefusedInput(f"columns {missing} are missing; there are {df.columns}")
    return df
