"""Scoring by predictors, and what images and vehicles need before and after it."""

from __future__ import annotations

import functools
import hashlib
import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import RefusedInput
from tabulon.functions.labels import display
from tabulon.functions.stats import CHANNELS
from tabulon.operators.gates import failure, is_transient, with_retry
from tabulon.sources import png

TASKS = ("make", "model", "body_type", "colour")
SCORED = "struct<label:string,score:double,status:string,error:string>"


@dataclass(frozen=True)
class Predictor:
    """`load` makes a function from a batch of inputs to (label, score) pairs, once for each Python worker: later tasks of a worker use it again.

    `version` tells apart predictors of one task; without it, that is done by a digest of `load` with all that it holds.
    """

    task: str
    load: Callable[[], Callable[[list[Any]], list[tuple[str | None, float | None]]]]
    status: str = "predicted"
    version: str = ""
    transform: Callable[[Any], Any] | None = None  # of each input, before the call

    def __post_init__(self):
        if not self.version:
            object.__setattr__(self, "version", hashlib.sha256(cloudpickle.dumps((self.load, self.transform))).hexdigest())


#: By task and version, in a worker: this module's own, so it outlives a task.
_loaded: dict[tuple[str, str], Any] = {}


def loaded(predictor: Predictor) -> Any:
    key = (predictor.task, predictor.version)
    if key not in _loaded:
        _loaded[key] = predictor.load()
    return _loaded[key]


def registry(predictors: dict[str, Predictor]) -> dict[str, Predictor]:
    """The predictors, if each stands under its own task and all tasks are known."""
    for task, p in predictors.items():
        if task not in TASKS or p.task != task:
            raise RefusedInput(f"no predictor of task {task!r}: {p.task!r}")
    return predictors


def score(df: DataFrame, column: str, predictor: Predictor, out: str = "scored") -> DataFrame:
    """`df` with the struct label, score, status, error; an input that fails keeps its row and says why."""

    @F.pandas_udf(SCORED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from tabulon.operators import scoring  # the worker's own module, not a copy that came with the function

        call, prepare = scoring.loaded(predictor), predictor.transform or (lambda v: v)
        for values in batches:
            try:
                rows = [(label, s, predictor.status, "") for label, s in call([prepare(v) for v in values])]
            except Exception:
                rows = []
                for v in values:  # one by one, to keep the others
                    try:
                        rows.append((*call([prepare(v)])[0], predictor.status, ""))
                    except Exception as error:
                        rows.append((None, None, "failed", failure(error)))
            yield pd.DataFrame(rows, columns=["label", "score", "status", "error"])

    return df.withColumn(out, run(F.col(column)))


def remote(df: DataFrame, column: str, call: Callable[[str], tuple[dict[str, Any], dict[str, int]]], attributes: list[str], retries: int = 5) -> DataFrame:
    """image, error, prompt_tokens, output_tokens and {attribute}_pred: the answers of a client, with retries; a failed call keeps its row."""
    names = [f"{a}_pred" for a in attributes]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in batch[column]:
                try:
                    profile, usage = with_retry(lambda v=value: call(v), retries, transient=lambda error, v=value: is_transient(error, str(v)))
                    rows.append([value, "", usage.get("prompt", 0), usage.get("output", 0), *[profile.get(a) for a in attributes]])
                except Exception as error:
                    rows.append([value, failure(error), 0, 0, *[None for _ in attributes]])
            yield pd.DataFrame(rows, columns=["image", "error", "prompt_tokens", "output_tokens", *names])

    return df.select(column).mapInPandas(run, ", ".join(["image string, error string, prompt_tokens long, output_tokens long", *[f"{n} string" for n in names]]))


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """label, position, mean: the mean vector of each label."""
    at = df.filter(F.col(label).isNotNull()).select(label, F.posexplode(vector).alias("position", "value"))
    return at.groupBy(label, "position").agg(F.avg(F.col("value").cast("double")).alias("mean"))


def nearest_centroid(df: DataFrame, key: str, vector: str, centres: DataFrame, label: str) -> DataFrame:
    """key, prediction, distance: the label whose mean is nearest; the smallest label if several are.

    The means (labels times dimensions) are checked to be few and broadcast as arrays, so rows aren't multiplied.
    """
    listed = centres.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "mean"))), lambda s: s["mean"]).alias("centre"))
    few = listed.limit(100_001).count()
    if few > 100_000:
        raise RefusedInput("more than 100000 labels")
    every = listed.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "centre"))).alias("centres"))
    joined = df.crossJoin(F.broadcast(every))  # one row
    square = lambda c: F.aggregate(F.zip_with(F.col(vector), c, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, b: a + b)
    best = F.array_min(F.transform("centres", lambda c: F.struct(square(c["centre"]).alias("distance"), c["label"].alias("label"))))
    return joined.select(key, best.alias("b")).select(key, F.col("b.label").alias("prediction"), F.sqrt("b.distance").alias("distance"))


# ---------------------------------------------------------------- colours


@dataclass(frozen=True)
class ColourRules:
    """The middle of an image and the limits of hue (0 to 180), saturation and value (0 to 255)."""

    left: float = 0.15
    right: float = 0.85
    top: float = 0.30
    bottom: float = 0.82
    least_pixels: int = 100
    black_value: int = 45
    white_value: int = 205
    white_saturation: int = 45
    grey_saturation: int = 50
    hues: tuple = (("orange", 10, 20), ("yellow", 20, 35), ("green", 35, 85), ("blue", 85, 130), ("purple", 130, 160), ("pink", 160, 170))


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue as half degrees, saturation and value as bytes, of an array of RGB bytes."""
    c = rgb.astype(np.float64)
    value, least = c.max(axis=-1), c.min(axis=-1)
    spread = value - least
    safe = np.where(spread == 0, 1, spread)
    r, g, b = np.moveaxis(c, -1, 0)
    degrees = np.select([value == r, value == g], [(g - b) / safe * 60, (b - r) / safe * 60 + 120], (r - g) / safe * 60 + 240)
    hue = np.where(spread == 0, 0, np.where(degrees < 0, degrees + 360, degrees) / 2)
    saturation = np.where(value == 0, 0, spread / np.where(value == 0, 1, value) * 255)
    return np.stack([np.rint(hue) % 180, np.rint(saturation), value], axis=-1).astype(np.uint8)


def colour_table(rules: ColourRules) -> tuple[list[str], np.ndarray]:
    """(names, a name's number for each hue, saturation and value): the rules, told once for all colours there are."""
    names = ["red", "black", "white", "grey", *[n for n, _, _ in rules.hues]]
    of_hue = np.zeros(256, dtype=np.uint8)
    for name, begin, end in rules.hues:
        of_hue[begin:end] = names.index(name)
    table = np.repeat(np.repeat(of_hue[:, None, None], 256, axis=1), 256, axis=2)
    table[:, : rules.grey_saturation + 1, :] = names.index("grey")
    table[:, : rules.white_saturation + 1, rules.white_value :] = names.index("white")
    table[:, :, : rules.black_value + 1] = names.index("black")
    return names, table


_tables = functools.cache(colour_table)
_CODE = np.array([1 << 16, 1 << 8, 1], dtype=np.int32)


def _middle(rgb: np.ndarray, rules: ColourRules) -> tuple[int, np.ndarray, np.ndarray]:
    """Of an image's middle: the number of pixels, its different colours, and how many pixels have each."""
    region = (rules.left, rules.right, rules.top, rules.bottom)
    if min(region) < 0 or max(region) > 1 or rules.left >= rules.right or rules.top >= rules.bottom:
        raise RefusedInput("the region's limits must rise between 0 and 1")
    rows, columns = (slice(int(n * a), max(int(n * b), 1)) for n, a, b in ((rgb.shape[0], rules.top, rules.bottom), (rgb.shape[1], rules.left, rules.right)))
    pixels = rgb[rows, columns].reshape(-1, 3)
    return len(pixels), *np.unique(pixels.astype(np.int32) @ _CODE, return_counts=True)


def _estimates(middles: list[tuple[int, np.ndarray, np.ndarray]], rules: ColourRules) -> list[dict[str, Any]]:
    """The estimates of several images; their colours are classed together, as numpy's calls cost more than the pixels of small images."""
    if not middles:
        return []
    names, table = _tables(rules)
    codes = np.concatenate([colours for _, colours, _ in middles])
    classes, found, at = table[tuple(hsv(np.stack([codes >> 16, codes >> 8 & 255, codes & 255], axis=-1)).T)], [], 0
    for pixels, colours, times in middles:
        told = {"label": None, "confidence": None, "status": "insufficient_pixels", "evaluated_pixels": pixels, "class_distribution": {}}
        if pixels >= rules.least_pixels:
            counts = np.bincount(classes[at : at + len(colours)], weights=times, minlength=len(names)).tolist()
            shares = {name: round(int(n) / pixels, 6) for name, n in sorted(zip(names, counts)) if n}
            label = max(shares, key=shares.get)
            told |= {"label": label, "confidence": shares[label], "status": "baseline_estimate", "class_distribution": shares}
        found.append(told)
        at += len(colours)
    return found


def estimate_colour(rgb: np.ndarray, rules: ColourRules = ColourRules()) -> dict[str, Any]:
    """label, confidence, status, evaluated_pixels, class_distribution: shares of colours in an image's middle, rounded to 6 places; of equal ones the first in the alphabet."""
    return _estimates([_middle(rgb, rules)], rules)[0]


def decode(content: bytes) -> np.ndarray:
    """RGB bytes of an image: binary PPM and PNG here, other formats where Pillow is installed."""
    if content.startswith(png.MARK):
        return png.decode(content)
    if content[:2] == b"P6":
        parts = content.split(maxsplit=4)
        if parts[3] == b"255":
            w, h = int(parts[1]), int(parts[2])
            return np.frombuffer(content[-w * h * 3 :], dtype=np.uint8).reshape(h, w, 3)
    try:
        from PIL import Image
    except ImportError as error:
        raise NotImplementedError("images other than PPM and PNG need Pillow") from error
    return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))


#: Colours of images that are classed in one step, about: what it holds in memory.
TOGETHER = 1 << 14
COLOUR = "struct<label:string,confidence:double,status:string,evaluated_pixels:int,class_distribution:map<string,double>,error:string>"


def colours(df: DataFrame, content: str = "content", rules: ColourRules = ColourRules(), out: str = "colour") -> DataFrame:
    """`df` with the colour estimate of images; an image that can't be read says why."""

    @F.pandas_udf(COLOUR)
    def run(values: pd.Series) -> pd.DataFrame:
        rows, places, middles, held = [], [], [], 0

        def classed():
            for place, told in zip(places, _estimates(middles, rules)):
                rows[place] = told | {"error": ""}
            places.clear()
            middles.clear()

        for v in values:
            rows.append({"label": None, "confidence": None, "status": "error", "evaluated_pixels": 0, "class_distribution": {}, "error": ""})
            try:
                middles.append(_middle(decode(v), rules))
                places.append(len(rows) - 1)
                held += len(middles[-1][1])
            except Exception as error:
                rows[-1]["error"] = failure(error)
            if held > TOGETHER:
                classed()
                held = 0
        classed()
        return pd.DataFrame(rows, columns=["label", "confidence", "status", "evaluated_pixels", "class_distribution", "error"])

    return df.withColumn(out, run(F.col(content)))


IMAGE = "struct<status:string,width:int,height:int,error:string>"


def inspect_images(df: DataFrame, content: str = "content", box: str | None = None, out: str = "image") -> DataFrame:
    """`df` with status, width, height, error: whether images decode and (1-based) boxes lie inside them."""
    from tabulon.functions.boxes import numbers, official

    @F.pandas_udf(IMAGE)
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                h, w = decode(v).shape[:2]
                rows.append(("ok", w, h, ""))
            except Exception as error:
                rows.append(("error", None, None, failure(error)))
        return pd.DataFrame(rows, columns=["status", "width", "height", "error"])

    seen = df.withColumn(out, run(F.col(content)))
    if box is None:
        return seen
    i = F.col(out)
    fits = official(numbers(F.col(box)), i["width"], i["height"])
    outside = F.struct(F.lit("error").alias("status"), i["width"].alias("width"), i["height"].alias("height"), F.lit("the box isn't inside the image").alias("error"))
    return seen.withColumn(out, F.when((i["status"] == "ok") & ~fits, outside).otherwise(i))


#: Bytes of arrays that a batch from Python holds, at most (one image's at least).
BATCH_BYTES = 8 << 20


def image_arrays(df: DataFrame, size: int, content: str = "content", box: str | None = None, out: str = "array") -> DataFrame:
    """`df` with pixels (size * size * 3 normalised numbers, by rows, columns and channels), width, height, error.

    Of an image, or of the part inside its box (struct of x1, y1, x2, y2, 0-based and half-open, clamped to the image), areas become
    pixels of the wanted size. An image that can't be read, or a box without a pixel, says why.
    """
    mean, deviation = (np.array(x) for x in zip(*CHANNELS))
    kinds = df.select(F.col(f"`{content}`").alias("content"), (F.col(box) if box else F.lit(None).cast("struct<x1:int,y1:int,x2:int,y2:int>")).alias("box"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    few = max(1, BATCH_BYTES // (size * size * 12))

    def one(content, box):
        try:
            rgb = decode(bytes(content))
            if box is not None:
                (x1, x2), (y1, y2) = ((max(0, min(n, a)), max(0, min(n, b))) for n, a, b in ((rgb.shape[1], box["x1"], box["x2"]), (rgb.shape[0], box["y1"], box["y2"])))
                if x1 >= x2 or y1 >= y2:
                    raise ValueError("the box holds no pixel")
                rgb = rgb[y1:y2, x1:x2]
            return ((png.resized(rgb, size, size) / 255 - mean) / deviation).astype(np.float32).ravel(), rgb.shape[1], rgb.shape[0], ""
        except Exception as error:
            return None, None, None, failure(error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, few):
                some = batch.slice(at, few)
                pixels, width, height, errors = zip(*map(one, some.column(0).to_pylist(), some.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([some.column(2), pa.array(pixels, pa.list_(pa.float32())), pa.array(width, pa.int32()), pa.array(height, pa.int32()), pa.array(errors, pa.string())], names=["row", "pixels", "width", "height", "error"])

    schema = T.StructType([kinds.schema["row"], *T._parse_datatype_string("pixels array<float>, width int, height int, error string").fields])
    return kinds.mapInArrow(run, schema).select("row.*", F.struct("pixels", "width", "height", "error").alias(out))


# ---------------------------------------------------------------- vehicles


def flat_vehicles(df: DataFrame) -> DataFrame:
    """The 15 flat columns of nested vehicle records."""
    p = "vehicle_profile"
    status = [F.col(f"{p}.status")[a].alias(f"{a}_status") for a in ("colour", "make", "model", "body_type", "damage", "accessories")]
    box = [F.get("bbox_xyxy", F.lit(k)).alias(f"bbox_{n}") for k, n in enumerate(("x1", "y1", "x2", "y2"))]
    return df.select("source_image_id", "vehicle_crop_id", *box, F.col("confidence").alias("detection_confidence"), F.col(f"{p}.colour").alias("colour"), F.col(f"{p}.confidence")["colour"].alias("colour_confidence"), *status)


def fill(local: Column, answer: Column, covered: bool) -> Column:
    """The local value where a predictor covers the field, else the answer if there is one."""
    return local if covered else F.coalesce(answer, local)


def fallback(df: DataFrame, covered: set[str], source: str) -> DataFrame:
    """`df` with vehicle_profile filled from vlm_profile for make, model and body_type that no predictor covers; their status says `source` and their confidence is null."""
    fields = [f for f in ("make", "model", "body_type") if f not in covered]
    p, a = F.col("vehicle_profile"), F.col("vlm_profile")
    profile, confidence, status = p, p["confidence"], p["status"]
    without = lambda m, f: F.map_filter(m, lambda k, v: k != f)
    for f in fields:
        there = a[f].isNotNull()
        profile = profile.withField(f, fill(p[f], a[f], False))
        confidence = F.when(there, F.map_concat(without(confidence, f), F.create_map(F.lit(f), F.lit(None).cast("double")))).otherwise(confidence)
        status = F.when(there, F.map_concat(without(status, f), F.create_map(F.lit(f), F.lit(source)))).otherwise(status)
    return df.withColumn("attribute_profile", p).withColumn("vehicle_profile", profile.withField("confidence", confidence).withField("status", status))


def comparison(df: DataFrame, local: str = "attribute_profile", other: str = "vlm_profile", other_status: str = "vlm_status") -> DataFrame:
    """vehicle, attribute, local, source, other, other_source: a row for each vehicle and attribute."""
    rows = [
        F.struct(F.lit(a).alias("attribute"), display(F.col(local)[a]).alias("local"), F.coalesce(F.col(local)["status"][a], F.lit("not_assessed")).alias("source"), display(F.col(other)[a]).alias("other"))
        for a in ("make", "body_type", "colour", "model")
    ]
    return df.select(F.col("vehicle_crop_id").alias("vehicle"), F.inline(F.array(*rows)), F.coalesce(F.col(other_status), F.lit("not_assessed")).alias("other_source"))


# ---------------------------------------------------------------- what remote models are asked

# The classes of a detector that are vehicles.
VEHICLES = ["car", "truck", "bus"]


def vehicle_boxes(found: DataFrame, label: str = "class_name") -> DataFrame:
    """The boxes of a detector's output that are vehicles, without their class."""
    return found.filter(F.col(label).isin(VEHICLES)).drop(label)


# The colours and body types that an answer may name.
COLOUR_NAMES = ["black", "silver", "white", "red", "blue", "brown", "yellow", "champagne", "green", "purple"]
BODY_TYPES = ["sedan", "SUV", "hatchback", "sports", "MPV", "fastback", "estate", "hardtop convertible", "minibus", "convertible", "pickup", "crossover"]

PROMPTS = {
    "raw": "Name the make, model, body type and colour of the vehicle in this image, as a JSON object with these four keys; null for what can't be seen.",
    "constrained": "Name the make, model, body type and colour of the vehicle in this image, as a JSON object with these four keys; null for what can't be seen. The body type is one of: " + ", ".join(BODY_TYPES) + ". The colour is one of: " + ", ".join(COLOUR_NAMES) + ".",
}


def answerable(attributes: list[str], kind: str) -> list[str]:
    """The attributes that a model of this kind can answer: a tuned one knows no colours. Refused if none is left."""
    left = [a for a in attributes if kind != "tuned" or a != "colour"]
    if not left:
        raise RefusedInput(f"a {kind} model answers none of {attributes}")
    return left
