"""A session with the settings that the engine's results rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tabulon", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution, skew-join handling; `settings` with underscores for dots are added."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that spark.checkpoint.dir names, which all machines share; a local master without it gets a temporary one, a cluster an error."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if not now.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tabulon-shared-"))
        now = sc._jsc.sc().getCheckpointDir()
    return now.get()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly over all cores, for work on each that is far larger than its bytes tell: a small file, however many rows it has, is one partition."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
