"""Files in any store that Spark reaches: fresh folders, files made once, and a ledger of entries.

Everything goes through Hadoop's file systems, so that a path may be local, in HDFS or in an object store. A file is
made by a call that fails if it is there, which HDFS and local folders decide atomically.
"""

from __future__ import annotations

import json
import posixpath
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabulon.errors import RefusedInput


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def inside(root: str, name: str) -> str:
    """The path of `name` below `root`; refused if it would be elsewhere."""
    path = posixpath.normpath(name)
    if not name or path in (".", "..") or path.startswith(("/", "../")) or ":" in path or "\\" in path or "\0" in path:
        raise RefusedInput(f"{name!r} leads out of {root!r}")
    return f"{root.rstrip('/')}/{path}"


def in_use(spark: SparkSession, folder: str) -> bool:
    """Whether there is anything in a folder."""
    fs, path = _at(spark, folder)
    return bool(fs.exists(path)) and (not fs.getFileStatus(path).isDirectory() or len(fs.listStatus(path)) > 0)


def fresh_folder(spark: SparkSession, folder: str) -> str:
    """The folder, made if need be; refused if it holds anything."""
    if in_use(spark, folder):
        raise RefusedInput(f"{folder} isn't empty")
    fs, path = _at(spark, folder)
    fs.mkdirs(path)
    return folder


def write_new(spark: SparkSession, root: str, name: str, text: str | bytes) -> str:
    """A new file inside `root`; refused if it is there, or would be outside."""
    from py4j.protocol import Py4JJavaError

    where = inside(root, name)
    fs, path = _at(spark, where)
    try:
        out = fs.create(path, False)
    except (Py4JJavaError, PySparkException) as error:
        if fs.exists(path):
            raise RefusedInput(f"{where} is there already") from error
        raise
    try:
        out.write(bytearray(text.encode() if isinstance(text, str) else text))
    finally:
        out.close()
    return where


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _at(spark, path)
    fs.delete(target, True)


ENTRY = "number long, kind string, subject string, job string, status string, at string, detail string"


class Ledger:
    """An append-only table of entries, one file each, in a folder of any store.

    An entry's number is taken by making its file, which fails if another writer was first; then the next number is tried. Nothing is
    changed or deleted, so the state of a job, and how often a test set was looked at, follow from the entries.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def entries(self) -> DataFrame:
        """number, kind, subject, job, status, at, detail."""
        fs, path = _at(self.spark, self.folder)
        if not fs.exists(path):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).option("pathGlobFilter", "*.json").json(self.folder)

    def _next(self) -> int:
        return (self.entries().agg(F.max("number")).first()[0] or 0) + 1

    def append(self, kind: str, subject: str, job: str, status: str, at: str, expected: int | None = None, tries: int = 100, **detail: Any) -> int:
        """The number of the new entry. With `expected` the entry gets that number, or is refused if the number is taken or would leave a gap."""
        number = self._next()
        if expected is not None and expected != number:
            raise RefusedInput(f"the ledger is at {number - 1}, so entry {expected} isn't the next")
        for number in range(number, number + (tries if expected is None else 1)):
            entry = {"number": number, "kind": kind, "subject": subject, "job": job, "status": status, "at": at, "detail": json.dumps(detail, sort_keys=True)}
            try:
                write_new(self.spark, self.folder, f"{number:012d}.json", json.dumps(entry))
                return number
            except RefusedInput:
                continue
        raise RefusedInput("other writers were first each time")

    def jobs(self) -> DataFrame:
        """job, kind, subject, status, entries: each job by its last entry."""
        last = W.partitionBy("job").orderBy(F.desc("number"))
        n = F.count(F.lit(1)).over(W.partitionBy("job"))
        return self.entries().withColumns({"__last": F.row_number().over(last), "entries": n}).filter("__last = 1").select("job", "kind", "subject", "status", "entries")

    def exposures(self, kind: str = "evaluation") -> DataFrame:
        """subject, exposures, first_job, last_job: how many jobs of a kind looked at each subject, whether they succeeded or not."""
        some = self.entries().filter(F.col("kind") == kind)
        return some.groupBy("subject").agg(F.countDistinct("job").alias("exposures"), F.min_by("job", "number").alias("first_job"), F.max_by("job", "number").alias("last_job"))


#: What may follow a job's status.
FOLLOWS = {None: ("submitted",), "submitted": ("running", "failed"), "running": ("succeeded", "failed"), "succeeded": (), "failed": ()}


def advance(ledger: Ledger, kind: str, subject: str, job: str, status: str, at: str, **detail: Any) -> int:
    """An entry that moves a job on; refused if its status can't follow the last one, or another writer has moved it meanwhile."""
    rows = ledger.entries()
    now = rows.agg(F.max("number").alias("top"), F.max_by("status", F.when(F.col("job") == job, F.col("number"))).alias("status")).first()
    if status not in FOLLOWS[now.status]:
        raise RefusedInput(f"{job!r} can't be {status} after {now.status}")
    return ledger.append(kind, subject, job, status, at, expected=(now.top or 0) + 1, **detail)


def evaluated(ledger: Ledger, subject: str, job: str, at: str, run, confirmed: bool = False, **detail: Any) -> tuple[Any, int]:
    """(what `run()` gives, exposures of `subject` so far, this one included).

    The exposure is entered before anything is read, and counts if the run fails too. A second evaluation of a subject is refused unless `confirmed`.
    """
    before = ledger.exposures().filter(F.col("subject") == subject).select("exposures").first()
    if before and not confirmed:
        raise RefusedInput(f"{subject!r} was evaluated {before.exposures} times already")
    advance(ledger, "evaluation", subject, job, "submitted", at, **detail)
    advance(ledger, "evaluation", subject, job, "running", at)
    try:
        found = run()
    except Exception as error:
        advance(ledger, "evaluation", subject, job, "failed", at, error=f"{type(error).__name__}: {error}"[:200])
        raise
    advance(ledger, "evaluation", subject, job, "succeeded", at)
    return found, (before.exposures if before else 0) + 1


# ---------------------------------------------------------------- files from tasks


def opened(path: str) -> Any:
    """A file for reading at any place, from a task: a local path or the URI of a store that pyarrow knows."""
    fs, inner = filesystem(path)
    return fs.open_input_file(inner)


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
