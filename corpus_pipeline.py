"""The corpus pipeline: language ID, exact dedup, MinHash near-dedup, mixing to target weights, best-fit packing.

Each stage is a function of (spark, docs, sf_dir). All but the last return documents with their columns; the last
returns the packed pieces. `run` writes each stage's rows as Parquet into the shared checkpoint folder and reads
them again as the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm.common import drop_folder, shared_folder
from tabulon.llm.exact_dedup import exact_dedup
from tabulon.llm.langid_mixture import in_known_language
from tabulon.llm.minhash_forest import near_dedup
from tabulon.llm.mixing import mixed_documents
from tabulon.llm.packing import pack_documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those that the known languages explain less than half of.

    So null and empty texts go. Rows that are equal stay or go together; rows without doc_id, lang or source are looked at as others
    are. An empty table stays empty. All columns are kept, whatever their names.
    """
    return in_known_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, the one with the smallest doc_id.

    Null and empty texts are equal. Of rows without doc_id one stays if no row with one has the text; of repeated rows one stays.
    An empty table stays empty. All columns are kept, whatever their names.
    """
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that near-duplicate links connect, the one with the smallest doc_id.

    Documents without words, null texts among them, have no links and all stay; rows that share doc_id and text stay or go
    together. An empty table stays empty. All columns are kept, whatever their names.
    """
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's weight asks for.

    Null and empty texts take part with size 0; rows without source are a source of their own, which comes last; repeated rows share their
    copies. An empty table stays empty. All columns are kept, whatever their names.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences.

    A null or empty text is its end token alone; rows without doc_id, or with one that others have, are packed as others are. An
    empty table gives no pieces. Other columns are not read.
    """
    return pack_documents(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixing", mixing), ("packing", packing)]

#: Language ID, MinHash and tokens can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents. What a stage wrote is deleted once the next has read it, and all of it if a stage fails."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before:
                drop_folder(spark, f"{folder}/{before}")
            before = name
        return STAGES[-1][1](spark, docs, sf_dir)  # it reads its checkpoint only, once it is made
    finally:
        drop_folder(spark, folder)
