"""An extension: files of predictions that arrive are classified and counted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tabulon.operators.evaluate import cells, classify, per_class


def arriving(spark: SparkSession, folder: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def running_cells(stream: DataFrame, classes: DataFrame, target: str, prediction: str) -> DataFrame:
    """target_id, prediction_id, n of all that has come: a state of classes squared rows."""
    return cells(classify(stream, classes, target, prediction))


def report(stream: DataFrame, classes: DataFrame, target: str, prediction: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes the per-class table of all that has come, anew after each batch."""

    def write(batch: DataFrame, number: int) -> None:
        per_class(batch, classes).write.mode("overwrite").parquet(out)

    writer = running_cells(stream, classes, target, prediction).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()
