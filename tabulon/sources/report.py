"""The files of an evaluation, in a folder that must be fresh, and configurations."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from tabulon.errors import RefusedInput
from tabulon.functions.labels import GUARDED
from tabulon.operators.evaluate import cross_check
from tabulon.operators.gates import run_metadata
from tabulon.sources.bundle import FileBundle
from tabulon.sources.store import in_use
from tabulon.sources.tables import matrix_table, strict_json

#: Told with every result.
POLICY = {
    "macro_f1": "the mean over all declared classes, those without rows included",
    "zero_division": 0,
    "unusable_rows": "refused, or left out and listed with their reasons",
    "labels": "compared as stored, white space included, unless an adapter is named",
}


def require_confirmed(split_name: str, confirmed: bool = False) -> None:
    """Refuses a guarded split that isn't confirmed, before anything is read."""
    name = "".join(c for c in str(split_name).lower() if c.isalnum())
    if name in GUARDED and not confirmed:
        raise RefusedInput(f"split {split_name!r} needs a confirmation")


def csv_text(columns: list[str], rows: list[tuple]) -> str:
    """Rows as CSV with a header; null is empty, a text that needs it is quoted."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(columns)
    writer.writerows(rows)
    return out.getvalue()


def _csv_files(columns: list[str], folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        for k, batch in enumerate(batches):
            if len(batch):
                rows = [tuple(None if pd.isna(v) else v for v in r) for r in batch.itertuples(index=False, name=None)]
                yield pd.DataFrame({"name": [f"{folder}/{TaskContext.get().partitionId():06d}-{k:06d}.csv"], "content": [csv_text(columns, rows).encode()]})

    return run


def write_report(found: dict[str, DataFrame], folder: str, config: dict[str, Any], log: list[str] | None = None) -> str:
    """metrics.json, per_class.csv, matrix.csv, mapping.csv, excluded/, warnings.json, environment.json, run_log.txt, README.md of evaluate()'s tables, as one bundle.

    The folder may be in any store; it is refused if it holds anything, and a report that can't be written leaves nothing. All but the
    excluded rows are of the classes' size and go through the driver; those are written by the tasks that have them.
    """
    spark = found["summary"].sparkSession
    if in_use(spark, folder):
        raise RefusedInput(f"{folder} isn't empty")
    row = found["summary"].first().asDict()
    metrics = row | {"arithmetic_check": cross_check(found["cells"], found["mapping"]), "policy": POLICY}
    small = {"per_class": found["per_class"], "matrix": matrix_table(found["cells"], found["mapping"]), "mapping": found["mapping"].orderBy("class_id")}
    metadata = run_metadata(config)
    warnings = [f"{k}: {', '.join(row[k])}" for k in ("classes_with_zero_support", "classes_never_predicted") if row[k]]
    lines = [f"# Evaluation of {config.get('task', 'labels')}", "", f"{row['correct']} of {row['rows']} rows are right.", "", *[f"- {k}: {row[k]}" for k in ("accuracy", "macro_f1", "weighted_f1")]]
    files = {f"{name}.csv": csv_text(df.columns, [tuple(r) for r in df.collect()]) for name, df in small.items()} | {
        "metrics.json": strict_json(metrics), "warnings.json": json.dumps(warnings, ensure_ascii=False, indent=2), "environment.json": json.dumps(metadata, indent=2),
        "run_log.txt": "\n".join([f"started: {metadata['timestamp_utc']}", f"command: {metadata['command']}", "", *(log or []), f"rows: {row['rows']}, correct: {row['correct']}"]) + "\n",
        "README.md": "\n".join(lines) + "\n", "excluded/columns.csv": csv_text(found["excluded"].columns, []),
    }
    told = spark.createDataFrame([(name, bytearray(text.encode())) for name, text in files.items()], "name string, content binary")
    rows = found["excluded"].mapInPandas(_csv_files(found["excluded"].columns, "excluded"), "name string, content binary")
    spark.dataSource.register(FileBundle)
    told.coalesce(1).unionByName(rows).write.format("file_bundle").mode("append").save(folder)
    return folder


def read_config(path: str) -> dict[str, Any]:
    """A JSON file, or a YAML file where PyYAML is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.lower().endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as error:
        raise NotImplementedError("YAML files need PyYAML") from error
    return yaml.safe_load(text)
