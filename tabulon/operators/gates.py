"""Gates before scoring: who is a member of which split, what run is frozen, where output may go."""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import time
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.errors import RefusedInput, UnusableRows
from tabulon.functions.labels import TEST_LIKE, TRAIN_LIKE

SPLITS = ("train", "test")
# What a record of a frozen run must state.
FROZEN_FIELDS = (
    "task", "dataset", "transform_id", "image_size", "checkpoint_sha256", "class_order_sha256", "membership_source_sha256", "code_hashes", "split_file_sha256",
    "split_column", "split_value", "label_column", "key_column", "sample_size", "seed", "selected_count", "selected_rows_sha256",
)
# What a model's file must hold, how its images may be prepared, and the networks that are known.
CHECKPOINT_FIELDS = ("state_dict", "classes", "config", "synthetic")
CONFIG_FIELDS = ("task", "architecture", "image_size", "preprocessing")
TRANSFORMS = {
    "OpenCV whole-crop resize 224x224, RGB, ImageNet mean/std": ("whole_crop_square_resize_imagenet_v1", 224),
    "OpenCV whole-crop square resize, RGB, ImageNet mean/std": ("whole_crop_square_resize_imagenet_v1", 224),
}
ARCHITECTURES = ("resnet18", "tiny_cnn")
# Words in the message of an error that may pass; numbers among them are codes.
TRANSIENT = ("429", "quota", "resource", "503", "unavailable")


def sha256_of(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while block := file.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def load_membership(spark: SparkSession, descriptor: dict[str, Any], dataset: str) -> DataFrame:
    """key, split of the lists that a descriptor pins by their hashes.

    Refused: another dataset, missing fields, splits that aren't exactly train or test, a split or file listed
    twice, a file with another hash, and a key that two lists have.
    """
    missing = [f for f in ("dataset", "version", "key_format", "provenance", "lists") if not descriptor.get(f)]
    if missing:
        raise RefusedInput(f"the membership descriptor lacks {missing}")
    if descriptor["dataset"] != dataset:
        raise RefusedInput(f"the membership is of {descriptor['dataset']!r}, not of {dataset!r}")
    out, splits, paths = None, set(), set()
    for entry in descriptor["lists"]:
        split, path, pinned = (entry.get(k) for k in ("split", "path", "sha256"))
        if split not in SPLITS or split in splits or path in paths:
            raise RefusedInput(f"no fresh train or test list: {entry}")
        splits.add(split)
        paths.add(path)
        if not isinstance(pinned, str) or not re.fullmatch("[0-9a-fA-F]{64}", pinned) or sha256_of(path) != pinned.lower():
            raise RefusedInput(f"list {path!r} isn't the pinned one")
        keys = spark.read.text(path).select(F.trim("value").alias("key"), F.lit(split).alias("split")).filter("key != ''").distinct()
        out = keys if out is None else out.unionByName(keys)
    twice = [r.key for r in membership_conflicts(out).limit(5).collect()]
    if twice:
        raise RefusedInput(f"keys are in several lists: {twice}")
    return out


def membership_conflicts(members: DataFrame) -> DataFrame:
    return members.groupBy("key").agg(F.countDistinct("split").alias("splits")).filter("splits > 1")


def unknown_members(rows: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """The keys of rows that no list has."""
    return rows.select(F.col(key).cast("string").alias("key")).distinct().join(members, "key", "left_anti")


def membership_counts(rows: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """split, n of the rows, by the lists."""
    return rows.select(F.col(key).cast("string").alias("key")).join(members, "key").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def ascii_name(name: str) -> str:
    return re.sub("[^a-z0-9]", "", str(name).strip().lower())


def require_membership(rows: DataFrame, key: str, members: DataFrame, split_value: str, sample_size: int | None = None) -> dict[str, int]:
    """Members by split; refuses unknown keys, a split name that contradicts them, and a sample of test members."""
    unknown = [r.key for r in unknown_members(rows, key, members).limit(5).collect()]
    if unknown:
        raise RefusedInput(f"no list has {unknown}")
    counts = {s: 0 for s in SPLITS} | {r.split: r.n for r in membership_counts(rows, key, members).collect()}
    name = ascii_name(split_value)
    if name not in TRAIN_LIKE + TEST_LIKE:
        raise RefusedInput(f"{split_value!r} is neither like train nor like test")
    other = "test" if name in TRAIN_LIKE else "train"
    if counts[other]:
        raise RefusedInput(f"{split_value!r} has {counts[other]} members of {other}")
    if sample_size is not None:
        if counts["test"]:
            raise RefusedInput("test members are scored as a whole, not sampled")
        if not 0 < sample_size <= sum(counts.values()):
            raise RefusedInput(f"no sample of {sample_size} from {sum(counts.values())} rows")
    return counts


def rows_digest(rows: DataFrame, key: str, label: str) -> str:
    """A digest of key, image path, label and box of all rows, whatever their order: the XOR and sum of their hashes, with their number.

    Rows are hashed where they are; only sums travel, so the digest needs neither a sort nor one task for all rows.
    """
    text = F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("None")) if c in rows.columns else F.lit("None") for c in (key, "image_path", label, "bbox")]))
    part = lambda k: F.conv(F.substring(F.sha2(text, 256), 1 + 8 * k, 8), 16, 10).cast("long")
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(part(k)).alias(f"x{k}") for k in range(8)], *[F.sum(part(k).cast("decimal(38,0)")).alias(f"s{k}") for k in range(8)]).first()
    return hashlib.sha256("|".join(str(v) for v in sums).encode()).hexdigest()


def ordered_rows_digest(rows: list[list[str]]) -> str:
    """The digest of a few rows on the driver: SHA-256 of the JSON of the sorted rows."""
    return hashlib.sha256(json.dumps(sorted(rows), ensure_ascii=False).encode()).hexdigest()


def class_order_digest(classes: list[str]) -> str:
    return hashlib.sha256(json.dumps(list(classes), ensure_ascii=False).encode()).hexdigest()


def require_frozen(record: Any, context: dict[str, Any], schema: str, fields: Iterable[str] = FROZEN_FIELDS) -> None:
    """Refuses a record that isn't an object of the schema, isn't frozen, lacks a field, or differs from the run; its code hashes must name the same files."""
    if not isinstance(record, dict):
        raise RefusedInput("a freeze record must be an object")
    if record.get("schema") != schema:
        raise RefusedInput(f"the record's schema is {record.get('schema')!r}, not {schema!r}")
    if record.get("status") != "frozen":
        raise RefusedInput(f"the record's status is {record.get('status')!r}, not 'frozen'")
    missing = [f for f in fields if f not in record]
    if missing:
        raise RefusedInput(f"the record lacks {missing}")
    given, real = record.get("code_hashes"), context.get("code_hashes", {})
    if not isinstance(given, dict) or set(given) != set(real):
        raise RefusedInput("the record's code hashes name other files")
    differs = [f for f in fields if f != "code_hashes" and record[f] != context.get(f)] + [f"code_hashes.{k}" for k in sorted(real) if given[k] != real[k]]
    if differs:
        raise RefusedInput(f"the record differs in {differs[:6]}")


def require_checkpoint(payload: Any) -> dict[str, Any]:
    """The payload of a model's file (read by whichever framework), if it has the parts, the configuration and different class names."""
    if not isinstance(payload, dict):
        raise RefusedInput("a checkpoint must hold an object")
    for name, held, needed in (("checkpoint", payload, CHECKPOINT_FIELDS), ("configuration", payload.get("config"), CONFIG_FIELDS)):
        if not isinstance(held, dict):
            raise RefusedInput(f"the {name} must be an object")
        missing = [f for f in needed if f not in held]
        if missing:
            raise RefusedInput(f"the {name} lacks {missing}")
    classes = payload["classes"]
    if not isinstance(classes, (list, tuple)) or not classes or not all(isinstance(c, str) and c for c in classes) or len(set(classes)) < len(classes):
        raise RefusedInput("the classes must be different texts that aren't empty")
    return payload


def require_transform(config: dict[str, Any]) -> dict[str, Any]:
    """declared, transform_id and image_size of a configuration whose preparation of images and network are known and agree."""
    declared = config["preprocessing"]
    if declared not in TRANSFORMS:
        raise RefusedInput(f"unknown preprocessing {declared!r}")
    name, size = TRANSFORMS[declared]
    if config["image_size"] != size:
        raise RefusedInput(f"an image size of {config['image_size']} doesn't fit {name}, which has {size}")
    if config["architecture"] not in ARCHITECTURES:
        raise RefusedInput(f"unknown architecture {config['architecture']!r}")
    return {"declared": declared, "transform_id": name, "image_size": size}


def intake(payload: Any, task: str, digest: str, expected: str | None = None, mapping: list[str] | None = None, load: Callable[[dict[str, Any]], int] | None = None) -> dict[str, Any]:
    """What a freeze record needs of a model's file that may be used; refused like require_checkpoint and require_transform, or if hash, task or class order differ, or it is synthetic.

    `load` puts the payload into its network and counts the parameters; an error of its own is a refusal too.
    """
    if expected and digest.lower() != expected.lower():
        raise RefusedInput("the file isn't the one that was agreed on")
    config = require_checkpoint(payload)["config"]
    if config["task"] != task:
        raise RefusedInput(f"the checkpoint is for {config['task']!r}, not {task!r}")
    transform = require_transform(config)
    if payload["synthetic"]:
        raise RefusedInput("the checkpoint is synthetic")
    classes = list(payload["classes"])
    if mapping is not None and list(mapping) != classes:
        raise RefusedInput("the class list isn't the checkpoint's, in its order")
    try:
        parameters = load(payload) if load else None
    except Exception as error:
        raise RefusedInput(f"the state doesn't load: {error}") from error
    values = {"task": task, "transform_id": transform["transform_id"], "image_size": transform["image_size"], "checkpoint_sha256": digest, "class_order_sha256": class_order_digest(classes)}
    return {"status": "acceptable", "architecture": config["architecture"], "classes": len(classes), "tensors": len(payload["state_dict"]), "parameters": parameters, "freeze_record_values": values}


def verdict(call: Callable[[], dict[str, Any]], out: Callable[[str], None] = print, err: Callable[[str], None] = lambda text: print(text, file=sys.stderr)) -> int:
    """0 where `call` gives a report, which is told as JSON; 2 where it refuses, 1 on any other error, both told as JSON and as a line for people. Writes no file."""
    try:
        found, code = call(), 0
    except UnusableRows as error:
        found, code = {"status": "failed", "error": str(error), "detail": {"rows": error.rows, "reasons": error.reasons}}, 2
    except RefusedInput as error:
        found, code = {"status": "failed", "error": str(error)}, 2
    except Exception as error:
        found, code = {"status": "failed", "error": failure(error)}, 1
    out(json.dumps(found, indent=2, ensure_ascii=False))
    if code:
        err(f"error: {found['error']}")
    return code


def read_json(spark: SparkSession, path: str) -> Any:
    """A JSON document, through Spark's own reader, so from any store; refused if it isn't one."""
    try:
        return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    except json.JSONDecodeError as error:
        raise RefusedInput(f"{path} is no JSON: {error}") from error


def require_proof(proof: dict[str, Any], checkpoint_sha256: str, score: dict[str, Any], baseline: dict[str, Any]) -> None:
    """Refuses to report a run whose reload and recount aren't proved, whose checkpoint has changed, or whose baseline has other classes or rows."""
    if not proof.get("fresh_process_cpu_reload_passed") or not proof.get("predictions_csv_metrics_verified"):
        raise RefusedInput("the run isn't verified")
    if proof.get("checkpoint_sha256") != checkpoint_sha256:
        raise RefusedInput("the checkpoint has changed since the run was verified")
    if any(score.get(k) != baseline.get(k) for k in ("classes", "rows")):
        raise RefusedInput("score and baseline are of other classes or rows")


def source_snapshot(spark: SparkSession, files: Iterable[str], folder: str) -> dict[str, str]:
    """The SHA-256 of source files by name, after copies of them were put into a fresh folder of any store, with the hashes as JSON."""
    from tabulon.sources import store

    paths, hashes = {}, {}
    for path in map(Path, files):
        if path.name in paths:
            raise RefusedInput(f"two sources are called {path.name!r}")
        paths[path.name] = path
    store.fresh_folder(spark, folder)
    for name, path in paths.items():
        store.write_new(spark, folder, name, path.read_bytes())
        hashes[name] = sha256_of(str(path))
    store.write_new(spark, folder, "source_hashes.json", json.dumps(hashes, indent=2))
    return hashes


def draft_record(context: dict[str, Any], schema: str) -> dict[str, Any]:
    """A record of a run to be approved; never frozen."""
    return {"schema": schema, **context, "status": "draft"}


def run_metadata(config: dict[str, Any]) -> dict[str, Any]:
    """When, where and with what a run took place."""
    import importlib.metadata
    import platform
    from datetime import UTC, datetime

    versions = {}
    for name in ("pyspark", "pandas", "numpy", "pyarrow"):
        try:
            versions[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            versions[name] = "not installed"
    return {
        "timestamp_utc": datetime.now(UTC).isoformat(), "command": sys.argv, "seed": config.get("seed"), "python": platform.python_version(), "platform": platform.platform(),
        "packages": versions, "config": config, "pid": os.getpid(),
    }


def overlay(config: dict[str, Any], record: dict[str, Any], keys: Iterable[str] = ("seed", "device")) -> dict[str, Any]:
    """`config` with `keys` from a run's record."""
    return config | {k: record[k] for k in keys if k in record}


def is_transient(error: Exception, about: str = "") -> bool:
    """Whether an error may pass: limits of rate or quota, and services that are down.

    A code counts only as a word of its own (no part of img4290), and what the call was `about` doesn't count where the message names it, as a key may hold any word.
    """
    message = str(error).lower()
    if about and about.lower() not in TRANSIENT:
        message = re.sub(rf"(?<!\w){re.escape(about.lower())}(?!\w)", " ", message)
    return any(re.search(rf"(?<!\w){word}(?!\w)", message) if word.isdigit() else word in message for word in TRANSIENT)


def with_retry(call: Callable[[], Any], retries: int = 5, first: float = 5.0, most: float = 60.0, transient: Callable[[Exception], bool] = is_transient, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The call's result; after a transient error again, after twice the wait each time. Other errors aren't tried again."""
    for k in range(retries):
        try:
            return call()
        except Exception as error:
            if k == retries - 1 or not transient(error):
                raise
            sleep(min(first * 2**k, most))
    raise RefusedInput("no retries")


def failure(error: Exception, length: int = 200) -> str:
    return f"{type(error).__name__}: {error}"[:length]
