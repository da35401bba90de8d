"""The corpus operators' queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.llm.minhash_forest import near_duplicates

    return near_duplicates(_docs(spark, sf_dir), words=4)


def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.llm.license_scan import licenses

    return licenses(_docs(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.llm.exact_dedup import exact_groups

    return exact_groups(_docs(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.llm.avi_media import media_digests

    return media_digests(_docs(spark, sf_dir))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.llm.mixing import mix

    return mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.llm.line_winnow import repeated_runs

    return repeated_runs(_docs(spark, sf_dir))


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.llm.langid_mixture import identify

    return identify(_docs(spark, sf_dir))


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.llm.chunk_dedup import repeats

    return repeats(_docs(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.llm.packing import pack_documents

    return pack_documents(_docs(spark, sf_dir))


def op10_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.llm.chat_quotes import reply_ordered

    return reply_ordered(_docs(spark, sf_dir, "conversations"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.llm.hard_negatives import mined

    return mined(_docs(spark, sf_dir, "embeddings"))


def op12_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.llm.run_index import long_repeats

    return long_repeats(_docs(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.llm.filter_audit import filter_audit

    return filter_audit(_docs(spark, sf_dir), _docs(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from tabulon.llm import exact_dedup, filter_audit, hard_negatives, license_scan, line_winnow, minhash_forest, mixing, run_index

    return {
        "op1_minhash_forest": minhash_forest.ORACLE, "op2_license_rules": license_scan.ORACLE, "op3_exact_dedup": exact_dedup.ORACLE, "op5_source_mixing": mixing.ORACLE,
        "op6_line_winnowing": line_winnow.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op12_run_index": run_index.ORACLE, "op13_filter_audit": filter_audit.ORACLE,
    }
