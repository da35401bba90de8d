"""What the corpus operators share: cutting lineage, shipping code to executors, telling documents apart, ranks."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The characters that separate words, as a regular-expression class body.
BLANK = r"\x20\x09-\x0D"

#: Rows of a table (some 100 bytes each at most) that is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000

#: What `identity` makes.
WHO = ["none", "id", "mark"]

_shipped: set[str] = set()


#: Bytes and rows of a batch that goes to Python, at most: what a worker and the JVM hold at once.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application (Spark's own file server carries it), and bound the batches."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    target = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share.

    It is the one that spark.checkpoint.dir names. Where it is unset, a local master gets a temporary folder; a
    cluster gets an error, as its machines share no local folder.
    """
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tabulon-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """`df`, written once to the shared folder, so that a lost executor costs no recomputation of what led to it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(df: DataFrame) -> None:
    """Let Spark drop the shuffle and checkpoint files of what a loop has left behind: it does so once the driver's garbage is collected."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of written tables, in whichever file system it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give what a Python worker has freed back to the system: the worker stays for later tasks and stages."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small(df: DataFrame) -> DataFrame:
    """`df` (cut), for a broadcast if its rows are counted to be few; else as it is, for a join by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def identity(text: str | Column = "text") -> list[Column]:
    """none, id, mark: which document a row is.

    id is the doc_id, and mark a hash of the text, so that rows that repeat a doc_id with other texts are other
    documents; a row without doc_id (none, which orders last) has a second hash of its text as id. Rows that
    share all three repeat a document.
    """
    doc, content = F.col("doc_id").cast("long"), text_of(text)
    return [doc.isNull().alias("none"), F.coalesce(doc, F.xxhash64(content)).alias("id"), F.hash(content).alias("mark")]


def same_document(left: DataFrame, right: DataFrame) -> Column:
    return (left["none"] == right["none"]) & (left["id"] == right["id"]) & (left["mark"] == right["mark"])


def doc_id_of(none: str | Column, id_: str | Column) -> Column:
    """The doc_id of an identity; null where there is none."""
    return F.when(~(F.col(none) if isinstance(none, str) else none), F.col(id_) if isinstance(id_, str) else id_)


def text_of(col: str | Column = "text") -> Column:
    """A text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def distributed_rank(df: DataFrame, group: list[Column], order: list[Column], name: str) -> DataFrame:
    """`df` (already cut) with the 0-based rank `name` of each row in its group, in `order`.

    No task holds a whole group: rows are dealt by range of (group, order), ranked inside their range
    partition, and shifted by the rows that earlier range partitions hold of the same group. `order`
    should be fine enough for the ranges to be even. Rows that tie in `order` get some order.
    """
    keys = [f"_g{i}" for i in range(len(group))]
    ranks = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(keys, group)) | dict(zip(ranks, order)))
    ranged = cut(keyed.repartitionByRange(*keys, *ranks).withColumn("_part", F.spark_partition_id()))
    here = W.partitionBy("_part", *keys)
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part", *keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(F.col("_part").alias("_p"), *[F.col(k).alias(f"{k}r") for k in keys], "_before")
    )
    local = ranged.withColumn("_local", F.row_number().over(here.orderBy(*ranks)) - 1)
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}r"))
    return local.join(offsets, same).withColumn(name, F.col("_local") + F.col("_before")).drop("_part", "_p", "_local", "_before", *keys, *ranks, *[f"{k}r" for k in keys])
