"""Remote calls with a bounded number at once, whose answers are kept: a rerun asks only for what has none.

    told = ask(images, "image", client, ["make", "model"], "runs/7")
    told.show(); print(remaining(images, "image", spark, "runs/7").count())
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.gates import failure, is_transient, with_retry


def _schema(attributes: list[str]) -> str:
    return ", ".join(["key string, error string, transient boolean, prompt_tokens long, output_tokens long", *[f"`{a}_pred` string" for a in attributes]])


def _log(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.option("mergeSchema", True).parquet(f"{folder}/answers/*")
    except AnalysisException:
        return None


def answers(spark: SparkSession, folder: str) -> DataFrame | None:
    """A row for each key that was asked: its answer, or the error of its last call; attempt says which run gave it. Null if nothing was asked."""
    log = _log(spark, folder)
    if log is None:
        return None
    last = log.groupBy("key").agg(F.max_by(F.struct(*[c for c in log.columns if c != "key"]), F.struct((F.col("error") == ""), F.col("attempt"), F.col("wave"))).alias("last"))
    return last.select("key", "last.*").drop("wave")


def remaining(df: DataFrame, key: str, spark: SparkSession, folder: str) -> DataFrame:
    """key: the different keys of `df` without an answer; null keys aren't asked."""
    keys = df.select(F.col(key).cast("string").alias("key")).filter("key IS NOT NULL").distinct()
    log = _log(spark, folder)
    return keys if log is None else keys.join(log.filter("error = ''").select("key").distinct(), "key", "left_anti")


def _calls(call: Callable[[str], tuple[dict[str, Any], dict[str, int]]], attributes: list[str], workers: int, retries: int, wait: float):
    columns = ["key", "error", "transient", "prompt_tokens", "output_tokens", *[f"{a}_pred" for a in attributes]]

    def one(value: str) -> list[Any]:
        try:
            profile, usage = with_retry(lambda: call(value), retries, first=wait, transient=lambda error: is_transient(error, value))
            return [value, "", False, usage.get("prompt", 0), usage.get("output", 0), *[profile.get(a) for a in attributes]]
        except Exception as error:
            return [value, failure(error), is_transient(error, value), 0, 0, *[None for _ in attributes]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                # each worker takes the next key when it is through with one, so no more than these are under way
                keys, told = iter(enumerate(batch["key"].tolist())), [None] * len(batch)
                lock = Lock()

                def work():
                    while True:
                        with lock:
                            at, value = next(keys, (None, None))
                        if at is None:
                            return
                        told[at] = one(value)

                for done in [pool.submit(work) for _ in range(workers)]:
                    done.result()
                yield pd.DataFrame(told, columns=columns)

    return run


def ask(df: DataFrame, key: str, call: Callable[[str], tuple[dict[str, Any], dict[str, int]]], attributes: list[str], folder: str, waves: int = 8, tasks: int = 4, workers: int = 4, retries: int = 5, wait: float = 5.0) -> DataFrame:
    """`answers` after a run over the keys of `df` that have none: key, error, transient, prompt_tokens, output_tokens, {attribute}_pred, attempt.

    Keys are dealt into waves by hash. A wave's answers are written as a table before the next begins, so a run that is killed loses a
    wave at most. At most `tasks` * `workers` calls are under way. A wave in which a transient error (limits of rate or quota)
    outlasted its retries is the run's last: the others' keys wait for a rerun. Other errors stay in the log, and are asked again too.
    """
    spark = df.sparkSession
    log = _log(spark, folder)
    attempt = 1 + ((log.agg(F.max("attempt")).first()[0] or 0) if log is not None else 0)
    left = remaining(df, key, spark, folder)
    for wave in range(waves):
        some = left.filter(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave)
        told = some.repartition(tasks).mapInPandas(_calls(call, attributes, workers, retries, wait), _schema(attributes))
        path = f"{folder}/answers/{attempt:06d}-{wave:06d}-{uuid.uuid4().hex}"
        told.withColumns({"attempt": F.lit(attempt), "wave": F.lit(wave)}).write.parquet(path)
        if spark.read.parquet(path).filter("transient").limit(1).count():
            break
    return answers(spark, folder)
