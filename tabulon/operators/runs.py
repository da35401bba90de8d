"""Comparison of scored runs: accuracy with intervals, mismatches, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.matching import MATCHERS
from tabulon.functions.stats import cost, wilson

# Billed tuning jobs (name, tokens, USD).
TUNING_JOBS = [("3 epochs, adapter 2", 587_983 * 3, 5.29), ("10 epochs, adapter 4", 587_983 * 10, 17.60)]


def scored(log: DataFrame, truths: dict[str, str], key=None) -> DataFrame:
    """`log` with {attribute}_ok from the matchers; `truths` maps each attribute to its truth column, {attribute}_pred has the answers."""
    kw = {"key": key} if key else {}
    out = log
    for attribute, truth in truths.items():
        args = {"make": F.col(truths["make"])} if attribute == "model" and "make" in truths else {}
        extra = {} if attribute == "colour" else kw
        out = out.withColumn(f"{attribute}_ok", MATCHERS[attribute](F.col(truth), F.col(f"{attribute}_pred"), **args, **extra))
    return out


def unpivoted(log: DataFrame, attributes: list[str], *keep: str) -> DataFrame:
    """keep, failed, attribute, truth, said, ok: a row for each row and attribute."""
    failed = F.coalesce(F.col("error"), F.lit("")) != "" if "error" in log.columns else F.lit(False)
    one = [F.struct(F.lit(a).alias("attribute"), F.col(f"{a}_gt").cast("string").alias("truth"), F.col(f"{a}_pred").cast("string").alias("said"), F.col(f"{a}_ok").cast("boolean").alias("ok")) for a in attributes]
    return log.select(*keep, failed.alias("failed"), F.inline(F.array(*one)))


def accuracy(long: DataFrame, *by: str) -> DataFrame:
    """by, attribute, n, successes, accuracy, ci_low, ci_high, null_rate, n_failed. Failed rows and rows without truth aren't scored."""
    use = ~F.col("failed") & F.col("truth").isNotNull()
    counts = long.groupBy(*by, "attribute").agg(
        F.count_if(use).alias("n"), F.count_if(use & F.coalesce("ok", F.lit(False))).alias("successes"), F.count_if(use & F.col("said").isNull()).alias("nulls"), F.count_if("failed").alias("n_failed")
    )
    low, high = wilson(F.col("successes"), F.col("n"))
    return counts.select(*by, "attribute", "n", "successes", F.try_divide("successes", "n").alias("accuracy"), low.alias("ci_low"), high.alias("ci_high"), F.try_divide("nulls", "n").alias("null_rate"), "n_failed")


def joint_accuracy(log: DataFrame, *attributes: str) -> DataFrame:
    """n, accuracy of rows that have all truths, where all attributes are right."""
    fine, there = F.lit(True), F.coalesce(F.col("error"), F.lit("")) == "" if "error" in log.columns else F.lit(True)
    for a in attributes:
        fine, there = fine & F.coalesce(F.col(f"{a}_ok").cast("boolean"), F.lit(False)), there & F.col(f"{a}_gt").isNotNull()
    return log.filter(there).agg(F.count(F.lit(1)).alias("n"), F.avg(fine.cast("int")).alias("accuracy"))


def top_mismatches(long: DataFrame, k: int, *by: str) -> DataFrame:
    """by, truth, said, count: the most frequent wrong answers, those first in the alphabet if equal."""
    from pyspark.sql.window import Window as W

    wrong = long.filter(~F.col("failed") & ~F.coalesce("ok", F.lit(False)) & F.col("truth").isNotNull())
    counts = wrong.groupBy(*by, "truth", "said").agg(F.count(F.lit(1)).alias("count"))
    order = [F.desc("count"), F.asc("truth"), F.asc_nulls_last("said")]
    if not by:
        return counts.orderBy(*order).limit(k)
    return counts.withColumn("_nth", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_nth") <= k).drop("_nth")


def costs(log: DataFrame, run: str = "run", kind: str = "kind") -> DataFrame:
    """run, kind, tokens_in, tokens_out, est_cost_usd."""
    sums = log.groupBy(run, kind).agg(F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("tokens_out"))
    return sums.withColumn("est_cost_usd", cost(F.col("tokens_in"), F.col("tokens_out"), F.col(kind) == "tuned"))


def total_cost(run_costs: DataFrame) -> DataFrame:
    """inference_usd, tuning_usd, total_usd."""
    tuning = sum(usd for _, _, usd in TUNING_JOBS)
    return run_costs.agg(F.sum("est_cost_usd").alias("inference_usd"), F.lit(tuning).alias("tuning_usd"), (F.sum("est_cost_usd") + tuning).alias("total_usd"))


def collect_runs(spark: SparkSession, specs: list[dict], folder: str) -> tuple[DataFrame | None, list[str]]:
    """The runs whose files can be read, as one table with run and kind; the labels of the others. A spec has label, file, kind."""
    from pyspark.errors import AnalysisException

    from tabulon.sources.tables import read_csv

    found, missing = None, []
    for spec in specs:
        try:
            log = read_csv(spark, f"{folder}/{spec['file']}")
        except AnalysisException:
            missing.append(spec["label"])
            continue
        log = log.withColumns({"run": F.lit(spec["label"]), "kind": F.lit(spec["kind"])})
        found = log if found is None else found.unionByName(log, allowMissingColumns=True)
    return found, missing


def seed_spread(scores: DataFrame, value: str, *by: str) -> DataFrame:
    """by, mean, sd (of a sample), min, max."""
    return scores.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
