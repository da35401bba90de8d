"""All queries over the driver's tables, with SQL that gives the same rows.

The tables have no vehicles, so others stand for them: documents (with a split by doc_id) for a manifest, part for
makes, models and body types, lineitem and labels for predictions, events for a run's log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import boxes, labels, matching, paths, stats
from tabulon.operators import audit, evaluate, gates, quantiles, runs, scoring, split, training
from tabulon.session import dealt, fresh_path
from tabulon.sources import manifests, tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- stand-ins

CLASSES = ["A", "N", "R", "Z"]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target, prediction: the return flag, and a guess from the quantity."""
    q = F.col("l_quantity")
    guess = F.when(q < 17, "A").when(q < 34, "N").otherwise("R")
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("target"), guess.alias("prediction"))


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, target, prediction with missing, reserved, unknown and padded labels."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    target = F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, "n/a").when(k % 17 == 0, "Unknown").otherwise(p)
    said = F.when(k % 7 == 0, F.concat(p, F.lit(" "))).when(k % 19 == 0, "not_assessed").when(k % 23 == 0, "6-NEW").when(k % 29 == 0, " ").otherwise(F.when(k % 3 == 0, "1-URGENT").otherwise(p))
    return table(spark, sf_dir, "orders").select(k.alias("order_id"), target.alias("target"), said.alias("prediction"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

_MESSY = """
  SELECT o_orderkey AS order_id,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'n/a' WHEN o_orderkey % 17 = 0 THEN 'Unknown' ELSE o_orderpriority END AS target,
    CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority || ' ' WHEN o_orderkey % 19 = 0 THEN 'not_assessed' WHEN o_orderkey % 23 = 0 THEN '6-NEW'
         WHEN o_orderkey % 29 = 0 THEN ' ' WHEN o_orderkey % 3 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS prediction
  FROM orders"""
_RAW = "CASE WHEN {0} IS NULL OR {0} = '' OR lower(trim({0})) IN ('nan', '<na>', 'null', 'na', 'n/a') THEN NULL ELSE {0} END"
_RESERVED = "('unknown', 'not_assessed', 'unassessed', 'synthetic', 'synthetic_smoke_only')"
_CLASSIFIED = f"""
messy AS ({_MESSY}),
raw AS (SELECT order_id, {_RAW.format("target")} AS target, {_RAW.format("prediction")} AS prediction FROM messy),
why AS (SELECT *,
  CASE WHEN target IS NULL THEN 'missing target label' WHEN lower(target) IN {_RESERVED} THEN 'reserved target token ''' || target || ''''
       WHEN target NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') THEN 'target label ''' || target || ''' outside the declared class list' END AS a,
  CASE WHEN prediction IS NULL THEN 'missing prediction label' WHEN lower(prediction) IN {_RESERVED} THEN 'reserved prediction token ''' || prediction || ''''
       WHEN prediction NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') THEN 'prediction label ''' || prediction || ''' outside the declared class list' END AS b
  FROM raw),
classified AS (SELECT order_id, target, prediction, nullif(concat_ws('; ', a, b), '') AS reason FROM why)"""

_PRED = """preds AS (SELECT l_returnflag AS target, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS prediction FROM lineitem),
classes(class_index, class) AS (VALUES (0, 'A'), (1, 'N'), (2, 'R'), (3, 'Z')),
per AS (SELECT class_index, class,
  (SELECT count(*) FROM preds WHERE target = class) AS support, (SELECT count(*) FROM preds WHERE prediction = class) AS predicted,
  (SELECT count(*) FROM preds WHERE prediction = class AND target = class) AS hits FROM classes),
pr AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS p, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS r FROM per),
scored AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM pr)"""

_MANIFEST = "manifest AS (SELECT doc_id, sha256(text) AS sha256, lang, source, CASE WHEN doc_id % 5 = 4 THEN 'test' ELSE 'train' END AS split FROM documents)"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, sha256, lang, source, split."""
    of = F.when(F.col("doc_id") % 5 == 4, "test").otherwise("train")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "lang", "source", of.alias("split"))


def _classes(spark: SparkSession) -> DataFrame:
    return evaluate.class_table(spark, CLASSES)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.cells(evaluate.classified_pairs(predictions(spark, sf_dir), _classes(spark), "target", "prediction"))


def _rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


# ---------------------------------------------------------------- evaluation


@query(f"WITH {_PRED} SELECT class_index, class, class AS display_class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support, predicted FROM scored")
def class_report(spark, sf_dir):
    """The flagship."""
    return _rounded(evaluate.per_class(_cells(spark, sf_dir), _classes(spark)).drop("hits"), "precision", "recall", "f1")


@query(f"""WITH {_PRED} SELECT sum(support)::BIGINT AS rows, sum(hits)::BIGINT AS correct, round(sum(hits) / sum(support), 6) AS accuracy, round(avg(f), 6) AS macro_f1,
  round(avg(f) FILTER (support > 0), 6) AS macro_f1_excluding_zero_support, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall,
  round(sum(f * support) / sum(support), 6) AS weighted_f1, coalesce(string_agg(class, ',' ORDER BY class_index) FILTER (support = 0), '') AS classes_with_zero_support,
  count(*) FILTER (support = 0) AS zero_support_class_count, coalesce(string_agg(class, ',' ORDER BY class_index) FILTER (predicted = 0), '') AS classes_never_predicted FROM scored""")
def class_summary(spark, sf_dir):
    """G12-G15."""
    out = _rounded(evaluate.summary(evaluate.per_class(_cells(spark, sf_dir), _classes(spark))), "accuracy", "macro_f1", "macro_f1_excluding_zero_support", "macro_precision", "macro_recall", "weighted_f1")
    return out.withColumns({c: F.array_join(c, ",") for c in ("classes_with_zero_support", "classes_never_predicted")})


@query("SELECT l_returnflag AS target, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS prediction, count(*) AS n FROM lineitem GROUP BY ALL")
def confusion_cells(spark, sf_dir):
    """G9."""
    name = lambda k: F.element_at(F.array(*map(F.lit, CLASSES)), F.col(f"{k}_id") + 1).alias(k)
    return _cells(spark, sf_dir).select(name("target"), name("prediction"), "n")


_DENSE = "dense AS (SELECT t.class_index AS target_id, p.class_index AS prediction_id, (SELECT count(*) FROM preds WHERE target = t.class AND prediction = p.class) AS n FROM classes t, classes p)"


@query(f"WITH {_PRED}, {_DENSE} SELECT * FROM dense")
def confusion_dense(spark, sf_dir):
    """J13."""
    return evaluate.dense(_cells(spark, sf_dir), _classes(spark))


@query(f"WITH {_PRED}, {_DENSE} SELECT *, round(CASE WHEN sum(n) OVER (PARTITION BY target_id) = 0 THEN 0 ELSE n / sum(n) OVER (PARTITION BY target_id) END, 6) AS share FROM dense")
def row_normalised_matrix(spark, sf_dir):
    """W6."""
    return _rounded(evaluate.row_shares(evaluate.dense(_cells(spark, sf_dir), _classes(spark))), "share")


@query(f"WITH {_PRED}, {_DENSE} SELECT t.class AS target, max(n) FILTER (prediction_id = 0) AS A, max(n) FILTER (prediction_id = 1) AS N, max(n) FILTER (prediction_id = 2) AS R, max(n) FILTER (prediction_id = 3) AS Z FROM dense JOIN classes t ON t.class_index = target_id GROUP BY 1")
def matrix_layout(spark, sf_dir):
    """K2, S2."""
    return tables.matrix_table(evaluate.dense(_cells(spark, sf_dir), _classes(spark)), _classes(spark))


@query("""WITH top AS (SELECT l_returnflag AS m FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), c AS (SELECT l_returnflag AS t, count(*) AS n FROM lineitem GROUP BY 1),
  a AS (SELECT sum(n)::BIGINT AS rows, max(n) FILTER (t = m) AS hits FROM c, top)
  SELECT m AS prediction, rows, hits AS correct, round(hits / rows, 6) AS accuracy, round(2 * (hits / rows) / (hits / rows + 1) / 4, 6) AS macro_f1 FROM a, top""")
def majority_baseline(spark, sf_dir):
    """G8, G16."""
    guessed = evaluate.majority(predictions(spark, sf_dir).select("target"), "target")
    counted = evaluate.cells(evaluate.classified_pairs(guessed, _classes(spark), "target", "prediction"))
    told = _rounded(evaluate.summary(evaluate.per_class(counted, _classes(spark))).select("rows", "correct", "accuracy", "macro_f1"), "accuracy", "macro_f1")
    return told.crossJoin(F.broadcast(guessed.select("prediction").limit(1)))


@query(f"WITH {_PRED} SELECT class_index, class, round(f, 6) AS f1, round(CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hits / (support + predicted) END, 6) AS f1_counts, true AS equal FROM scored")
def f1_two_formulas(spark, sf_dir):
    """G17, V2."""
    return _rounded(evaluate.two_formulas(_cells(spark, sf_dir), _classes(spark)).withColumn("equal", F.col("difference") < evaluate.TOLERANCE).drop("difference"), "f1", "f1_counts")


@query(f"WITH {_PRED} SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(f), 6) AS macro_f1, true AS agrees FROM scored")
def metric_crosscheck(spark, sf_dir):
    """Rows and cells give the same figures."""
    by_rows = evaluate.row_metrics(evaluate.classify(predictions(spark, sf_dir), _classes(spark), "target", "prediction"), _classes(spark))
    by_cells = evaluate.summary(evaluate.per_class(_cells(spark, sf_dir), _classes(spark))).select(F.col("accuracy").alias("a"), F.col("macro_f1").alias("f"))
    near = F.greatest(F.abs(F.col("accuracy") - F.col("a")), F.abs(F.col("macro_f1") - F.col("f"))) <= evaluate.TOLERANCE
    return _rounded(by_rows.crossJoin(F.broadcast(by_cells)).withColumn("agrees", near).drop("a", "f"), "accuracy", "macro_f1")


@query(f"WITH {_CLASSIFIED} SELECT order_id, target, prediction, reason FROM classified WHERE reason IS NOT NULL")
def excluded_rows(spark, sf_dir):
    """A19, X1, X21, A20."""
    return evaluate.excluded(evaluate.classify(messy(spark, sf_dir), evaluate.class_table(spark, PRIORITIES), "target", "prediction"), "order_id")


@query(f"WITH {_CLASSIFIED} SELECT reason, count(*) AS n FROM classified WHERE reason IS NOT NULL GROUP BY 1")
def exclusion_reasons(spark, sf_dir):
    """A20, G2."""
    pairs = evaluate.classified_pairs(messy(spark, sf_dir), evaluate.class_table(spark, PRIORITIES), "target", "prediction")
    return pairs.filter("reason IS NOT NULL").groupBy("reason").agg(F.sum("n").alias("n"))


@query(f"WITH {_CLASSIFIED} SELECT target, prediction, count(*) AS n FROM classified WHERE reason IS NULL GROUP BY ALL")
def scorable_cells(spark, sf_dir):
    """A19, G9."""
    classes = evaluate.class_table(spark, PRIORITIES)
    name = lambda k: F.element_at(F.array(*map(F.lit, PRIORITIES)), F.col(f"{k}_id") + 1).alias(k)
    return evaluate.cells(evaluate.classified_pairs(messy(spark, sf_dir), classes, "target", "prediction")).select(name("target"), name("prediction"), "n")


@query(f"""WITH {_CLASSIFIED}, s AS (SELECT {_RAW.format("target")} AS t, trim({_RAW.format("prediction")}) AS p FROM messy)
  SELECT t AS target, p AS prediction, count(*) AS n FROM s WHERE t IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') AND p IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') GROUP BY ALL""")
def stripped_cells(spark, sf_dir):
    """X2, A17, A19 with the adapter `strip`."""
    classes = evaluate.class_table(spark, PRIORITIES, "strip")
    name = lambda k: F.element_at(F.array(*map(F.lit, PRIORITIES)), F.col(f"{k}_id") + 1).alias(k)
    return evaluate.cells(evaluate.classified_pairs(messy(spark, sf_dir), classes, "target", "prediction", "strip")).select(name("target"), name("prediction"), "n")


@query(f"""WITH m AS ({_MESSY}), s AS (SELECT DISTINCT prediction AS raw, trim(prediction) AS display_label FROM m WHERE trim(prediction) IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'))
  SELECT display_label, string_agg('[' || raw || ']', '' ORDER BY raw) AS spellings FROM s GROUP BY 1 HAVING count(*) > 1""")
def observed_collisions(spark, sf_dir):
    """A18."""
    found = evaluate.observed_collisions(messy(spark, sf_dir), "prediction", evaluate.class_table(spark, PRIORITIES, "strip"), "strip")
    return found.withColumn("spellings", F.array_join(F.transform("spellings", lambda s: F.concat(F.lit("["), s, F.lit("]"))), ""))


@query("SELECT l_orderkey || '-' || l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    """A16."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sample_id"))
    return evaluate.duplicate_ids(rows, "sample_id")


_LABELS = "SELECT doc_id, quality::VARCHAR AS target, (1 - toxic)::VARCHAR AS prediction FROM labels"


@query(f"WITH p AS ({_LABELS}) SELECT target, prediction, count(*) AS n FROM p WHERE target != prediction GROUP BY ALL")
def off_diagonal_confusions(spark, sf_dir):
    """F9, T1."""
    rows = table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("target"), (1 - F.col("toxic")).cast("string").alias("prediction"))
    cell = evaluate.confusions(evaluate.cells(evaluate.classified_pairs(rows, evaluate.class_table(spark, ["0", "1"]), "target", "prediction")))
    return cell.select(F.col("target_id").cast("string").alias("target"), F.col("prediction_id").cast("string").alias("prediction"), "n").orderBy(F.desc("n"), "target", "prediction")


@query("""WITH c AS (SELECT o_orderstatus AS task, o_orderpriority AS target, c_mktsegment AS prediction, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
  SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY task ORDER BY n DESC, target, prediction) <= 5""")
def top_confusions_per_task(spark, sf_dir):
    """T4, T1."""
    from pyspark.sql.window import Window as W

    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = joined.groupBy(F.col("o_orderstatus").alias("task"), F.col("o_orderpriority").alias("target"), F.col("c_mktsegment").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("_k", F.row_number().over(W.partitionBy("task").orderBy(F.desc("n"), "target", "prediction"))).filter("_k <= 5").drop("_k")


# ---------------------------------------------------------------- audits


@query(f"""WITH {_MANIFEST} SELECT count(*) AS rows, count(DISTINCT lang) AS classes, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'test') AS test_rows,
  count(*) FILTER (split NOT IN ('train', 'test')) AS invalid_split_rows, count(*) FILTER (lang IS NULL) AS missing_labels, 0::BIGINT AS invalid_bbox_rows,
  count(*) - count(DISTINCT sha256) AS duplicate_path_rows,
  (SELECT count(*) FROM (SELECT sha256 FROM manifest WHERE split = 'train' INTERSECT SELECT sha256 FROM manifest WHERE split = 'test')) AS train_test_path_overlap,
  (SELECT count(*) FROM (SELECT lang FROM manifest WHERE split = 'test' EXCEPT SELECT lang FROM manifest WHERE split = 'train')) AS labels_only_in_test FROM manifest""")
def manifest_audit(spark, sf_dir):
    """A1, G6, U3, U4."""
    return audit.manifest_audit(manifest(spark, sf_dir), "lang", F.col("sha256")).withColumn("duplicate_path_rows", F.col("duplicate_path_rows").cast("long"))


@query(f"WITH {_MANIFEST} SELECT sha256, count(*) AS rows, count(DISTINCT split) AS split_count FROM manifest GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    """A10, G4, G5."""
    return audit.duplicate_groups(manifest(spark, sf_dir))


@query(f"WITH {_MANIFEST} SELECT doc_id, sha256, split FROM manifest WHERE sha256 IN (SELECT sha256 FROM manifest GROUP BY 1 HAVING count(DISTINCT split) > 1)")
def cross_split_duplicates(spark, sf_dir):
    """A10, J4."""
    rows = manifest(spark, sf_dir)
    return rows.join(audit.duplicate_groups(rows).filter("split_count > 1"), "sha256", "left_semi").select("doc_id", "sha256", "split")


@query(f"WITH {_MANIFEST} SELECT sha256, count(DISTINCT source) AS labels FROM manifest GROUP BY 1 HAVING count(DISTINCT source) > 1")
def conflicting_labels(spark, sf_dir):
    """G3, A4."""
    return audit.conflicting(manifest(spark, sf_dir), "source")


@query("""SELECT doc_id % 5 AS part, count(*) FILTER (o AND m) AS both, count(*) FILTER (o AND NOT m) AS official_only, count(*) FILTER (m AND NOT o) AS manifest_only
  FROM (SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS o, l.doc_id IS NOT NULL AS m FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id) GROUP BY 1""")
def coverage_report(spark, sf_dir):
    """A13, J10."""
    part = lambda n: table(spark, sf_dir, n).select("doc_id", (F.col("doc_id") % 5).alias("part"))
    return audit.coverage(part("documents"), part("labels"), "doc_id", "part")


@query("""WITH r AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 50 = 0 THEN 'changed' ELSE p_type END AS p_type, CASE WHEN p_partkey % 70 = 0 THEN NULL ELSE p_size END AS p_size FROM part WHERE p_partkey % 90 != 0)
  SELECT l.p_partkey, f.field FROM part l LEFT JOIN r ON l.p_partkey = r.p_partkey,
  unnest(list_filter([CASE WHEN r.p_partkey IS NULL THEN 'missing' END, CASE WHEN r.p_partkey IS NOT NULL AND l.p_type IS DISTINCT FROM r.p_type THEN 'p_type' END, CASE WHEN r.p_partkey IS NOT NULL AND l.p_size IS DISTINCT FROM r.p_size THEN 'p_size' END], lambda x: x IS NOT NULL)) f(field)""")
def reconcile_diff(spark, sf_dir):
    """A7, A8, J9, J11."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    other = part.filter(k % 90 != 0).withColumn("p_type", F.when(k % 50 == 0, "changed").otherwise(F.col("p_type"))).withColumn("p_size", F.when(k % 70 == 0, F.lit(None)).otherwise(F.col("p_size")))
    return audit.reconcile(part, other, "p_partkey", ["p_brand", "p_type", "p_size"])


@query(f"WITH {_MANIFEST} SELECT sha256 FROM manifest WHERE split = 'train' INTERSECT SELECT sha256 FROM manifest WHERE split = 'test'")
def train_test_overlap(spark, sf_dir):
    """U3."""
    rows = manifest(spark, sf_dir)
    return audit.overlap(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "sha256")


@query(f"WITH {_MANIFEST} SELECT DISTINCT sha256 FROM manifest WHERE split = 'test' EXCEPT SELECT sha256 FROM manifest WHERE split = 'train'")
def unseen_test_labels(spark, sf_dir):
    """U4."""
    return audit.only_in_test(manifest(spark, sf_dir), "sha256")


@query("SELECT o_custkey AS key FROM orders UNION SELECT c_custkey FROM customer")
def key_union(spark, sf_dir):
    """U1, U2."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))).distinct()


@query("SELECT doc_id AS key FROM documents EXCEPT SELECT doc_id FROM labels")
def key_difference(spark, sf_dir):
    """U4, J5, F3."""
    keys = lambda name: table(spark, sf_dir, name).select(F.col("doc_id").alias("key"))
    return keys("documents").subtract(keys("labels"))


@query("SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) = 0 AS subset, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) = 0 AND (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) = 0 AS equal")
def key_set_tests(spark, sf_dir):
    """U5."""
    a, b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    left = lambda x, y: x.subtract(y).agg((F.count(F.lit(1)) == 0).alias("e"))
    return left(a, b).withColumnRenamed("e", "subset").crossJoin(F.broadcast(left(b, a))).select("subset", (F.col("subset") & F.col("e")).alias("equal"))


@query(f"""WITH {_MANIFEST}, f AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'validation' ELSE 'train' END AS experiment_split FROM manifest),
  o AS (SELECT doc_id, sha256, CASE WHEN doc_id % 100 = 1 THEN 'zz' ELSE lang END AS lang, split FROM manifest)
  SELECT * FROM (
    SELECT 'repeated content' AS rule, (SELECT count(*) FROM (SELECT sha256 FROM f GROUP BY 1 HAVING count(*) > 1)) AS n
    UNION ALL SELECT 'not train or validation of official train', (SELECT count(*) FROM f WHERE split != 'train')
    UNION ALL SELECT 'content of the official test', (SELECT count(*) FROM f WHERE sha256 IN (SELECT sha256 FROM f WHERE split = 'test'))
    UNION ALL SELECT 'differs from the manifest', (SELECT count(*) FROM f JOIN o USING (doc_id) WHERE f.lang != o.lang)) WHERE n > 0""")
def frozen_split_audit(spark, sf_dir):
    """A7, A8, A9."""
    rows = manifest(spark, sf_dir)
    official = rows.withColumn("lang", F.when(F.col("doc_id") % 100 == 1, "zz").otherwise(F.col("lang")))
    frame = rows.withColumn("experiment_split", F.when(F.col("doc_id") % 3 == 0, "validation").otherwise("train"))
    return audit.frozen_split(frame, official, "lang", rows.filter("split = 'test'"), ["split", "lang", "sha256"], key="doc_id")


@query(f"WITH {_MANIFEST} SELECT count(*) AS malformed FROM manifest WHERE NOT regexp_full_match(sha256, '[0-9a-f]{{64}}')")
def malformed_hashes(spark, sf_dir):
    """F7."""
    return audit.malformed_hashes(manifest(spark, sf_dir)).agg(F.count(F.lit(1)).alias("malformed"))


@query("""SELECT o_custkey, count(*) AS rows, mode_.s AS o_orderstatus, round(mode_.n / count(*), 6) AS share FROM orders
  JOIN (SELECT * FROM (SELECT o_custkey AS k, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, s DESC) = 1) mode_ ON k = o_custkey
  GROUP BY o_custkey, mode_.s, mode_.n HAVING count(*) >= 3 AND mode_.n / count(*) >= 0.8""")
def dominant_share_warning(spark, sf_dir):
    """G26."""
    return _rounded(audit.dominant_share(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus"), "share")


@query("""WITH t(id, label) AS (SELECT p_partkey % 6, p_type FROM part), n(id, name) AS (SELECT row_number() OVER (ORDER BY p_type), p_type FROM (SELECT DISTINCT p_type FROM part))
  SELECT t.id AS type_id, count(*) AS rows, count(*) FILTER (CASE WHEN t.id = 0 THEN label IS NULL ELSE coalesce(label = name, false) END) AS matching FROM t LEFT JOIN n ON t.id = n.id GROUP BY 1""")
def body_label_truth(spark, sf_dir):
    """A5, A6, J6."""
    from pyspark.sql.window import Window as W

    part = table(spark, sf_dir, "part").select((F.col("p_partkey") % 6).alias("type_id"), F.col("p_type").alias("label"))
    names = part.select("label").distinct().select(F.row_number().over(W.orderBy("label")).alias("id"), F.col("label").alias("name"))  # a row for each class
    named = manifests.ordinal(part, "type_id", names, "name")
    return named.groupBy("type_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(audit.body_label_matches(F.col("type_id"), F.col("label"), F.col("name"))).alias("matching"))


# ---------------------------------------------------------------- splits

_CAPPED = f"""{_MANIFEST}, blocked AS (SELECT sha256 FROM manifest WHERE split = 'test' UNION SELECT sha256 FROM manifest GROUP BY 1 HAVING count(DISTINCT lang) > 1),
one AS (SELECT * FROM manifest WHERE split = 'train' AND sha256 NOT IN (SELECT sha256 FROM blocked) QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('11|' || doc_id), doc_id) AS k FROM one QUALIFY k <= 50),
capped AS (SELECT doc_id, sha256, lang, CASE WHEN k <= greatest(1, ceil(count(*) OVER (PARTITION BY lang) * 0.2)) THEN 'validation' ELSE 'train' END AS experiment_split FROM ranked)"""


def _capped(spark, sf_dir):
    return split.capped_split(manifest(spark, sf_dir), "lang", 50, 11, key="doc_id")


@query(f"WITH {_CAPPED} SELECT * FROM capped")
def capped_split(spark, sf_dir):
    """A4, W1, W3."""
    return _capped(spark, sf_dir)


@query(f"WITH {_CAPPED} SELECT experiment_split, lang, count(*) AS count FROM capped GROUP BY ALL")
def class_counts(spark, sf_dir):
    """G1."""
    return _capped(spark, sf_dir).groupBy("experiment_split", "lang").agg(F.count(F.lit(1)).alias("count"))


@query(f"WITH {_CAPPED} SELECT (SELECT count(*) FROM manifest WHERE split = 'train') AS official_train_rows, (SELECT count(*) FROM manifest WHERE split = 'test') AS official_test_rows, count(*) FILTER (experiment_split = 'train') AS train_rows, count(*) FILTER (experiment_split = 'validation') AS validation_rows, count(DISTINCT lang) AS classes FROM capped")
def split_summary(spark, sf_dir):
    """G29."""
    return split.capped_split_summary(manifest(spark, sf_dir), _capped(spark, sf_dir), "lang")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY sha256('5|' || p_partkey), p_partkey) <= 4")
def sample_per_class(spark, sf_dir):
    """W4."""
    return split.sample_per_class(table(spark, sf_dir, "part"), "p_brand", 4, 5, "p_partkey").select("p_partkey", "p_brand")


@query("SELECT c_custkey FROM customer ORDER BY sha256('9|' || c_custkey), c_custkey LIMIT 100")
def seeded_sample(spark, sf_dir):
    """T7, T8, T10."""
    return split.sample(table(spark, sf_dir, "customer").select("c_custkey"), 100, 9, "c_custkey")


@query(f"""WITH {_MANIFEST}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('3|' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM manifest WHERE split = 'train')
  SELECT doc_id, lang, CASE WHEN k <= greatest(1, round(n * 0.25)) THEN 'validation' ELSE 'train' END AS experiment_split FROM r UNION ALL SELECT doc_id, lang, 'test' FROM manifest WHERE split = 'test'""")
def stratified_split(spark, sf_dir):
    """A3."""
    return split.stratified_split(manifest(spark, sf_dir), "lang", 0.25, 3, "doc_id").select("doc_id", "lang", "experiment_split")


@query("""WITH m AS (SELECT CASE WHEN doc_id % 3 > 0 THEN lang END AS lang, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents),
  c AS (SELECT lang, split, count(*) AS n FROM m GROUP BY ALL), v AS (SELECT lang, n, greatest(1, round(n * 0.2))::BIGINT AS k FROM c WHERE split = 'train')
  SELECT lang, 'test' AS experiment_split, n FROM c WHERE split = 'test' UNION ALL SELECT lang, 'validation', k FROM v UNION ALL SELECT lang, 'train', n - k FROM v WHERE n > k""")
def split_without_keys(spark, sf_dir):
    """A3: rows without key or class, of which none is lost."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.when(k % 7 > 0, k).alias("doc_id"), F.when(k % 3 > 0, F.col("lang")).alias("lang"), F.when(k % 5 == 0, "test").otherwise("train").alias("split"), "text")
    return split.stratified_split(rows, "lang", 0.2, 3, "doc_id").groupBy("lang", "experiment_split").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey % 5 = 4 THEN 'test' ELSE 'train' END AS split FROM customer),
  g AS (SELECT c_nationkey, row_number() OVER (ORDER BY sha256('2|' || c_nationkey), c_nationkey) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT c_nationkey FROM c WHERE split = 'train'))
  SELECT c_custkey, CASE WHEN split = 'test' THEN 'test' WHEN k <= ceil(n * 0.25) THEN 'validation' ELSE 'train' END AS experiment_split FROM c LEFT JOIN g USING (c_nationkey)""")
def group_split(spark, sf_dir):
    """A3 by groups."""
    rows = table(spark, sf_dir, "customer").withColumn("split", F.when(F.col("c_nationkey") % 5 == 4, "test").otherwise("train"))
    return split.group_split(rows, "c_nationkey", 0.25, 2).select("c_custkey", "experiment_split")


@query("""WITH h AS (SELECT day(o_orderdate) AS epoch, round(avg(o_totalprice), 2) AS f FROM orders GROUP BY 1)
  SELECT epoch, f AS validation_macro_f1, max(f) OVER w AS best_before, coalesce(f > max(f) OVER w, true) AS improved FROM h WINDOW w AS (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def best_epoch_running(spark, sf_dir):
    """W2."""
    history = table(spark, sf_dir, "orders").groupBy(F.dayofmonth("o_orderdate").alias("epoch")).agg(F.round(F.avg("o_totalprice"), 2).alias("validation_macro_f1"))
    return split.running_best(history)


def _training_sql(epochs: int, rate: float, decay: float) -> str:
    """Full-batch AdamW of a softmax head from zeros, an epoch after the other."""
    steps = ["""e AS (SELECT vec_id, label, embedding, vec_id % 5 = 0 AS held FROM embeddings), k AS (SELECT unnest(range(10))::INT AS c),
  x AS (SELECT vec_id, label, held, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM e UNION ALL SELECT vec_id, label, held, 0, 1 FROM e),
  w0 AS (SELECT i, c, 0::DOUBLE AS w, 0::DOUBLE AS m, 0::DOUBLE AS s FROM (SELECT DISTINCT i FROM x), k)"""]
    for t in range(1, epochs + 1):
        scores = lambda n, w, held: f"{n} AS (SELECT vec_id, label, c, exp(sum(v * w)) AS z FROM x JOIN {w} USING (i) WHERE {held} GROUP BY ALL)"
        steps += [
            scores(f"z{t}", f"w{t - 1}", "NOT held"), f"p{t} AS (SELECT vec_id, label, c, z / sum(z) OVER (PARTITION BY vec_id) AS p FROM z{t})",
            f"l{t} AS (SELECT avg(-ln(p)) AS loss, count(*) AS n FROM p{t} WHERE c = label)",
            f"g{t} AS (SELECT i, c, sum(v * (p - (c = p{t}.label)::INT)) / (SELECT n FROM l{t}) AS g FROM x JOIN p{t} USING (vec_id) GROUP BY ALL)",
            f"m{t} AS (SELECT i, c, w, 0.9 * m + 0.1 * g AS m, 0.999 * s + 0.001 * g * g AS s FROM w{t - 1} JOIN g{t} USING (i, c))",
            f"w{t} AS (SELECT i, c, w - {rate} * (m / (1 - 0.9::DOUBLE ^ {t}) / (sqrt(s / (1 - 0.999::DOUBLE ^ {t})) + 1e-8) + {decay} * w) AS w, m, s FROM m{t})",
            scores(f"h{t}", f"w{t}", "held"), f"a{t} AS (SELECT label, arg_max(c, z) AS said FROM h{t} GROUP BY vec_id, label)",
            f"f{t} AS (SELECT avg(coalesce(2.0 * tp / nullif(n, 0), 0)) AS f1 FROM (SELECT c, count(*) FILTER (label = c AND said = c) AS tp, count(*) FILTER (label = c) + count(*) FILTER (said = c) AS n FROM k, a{t} GROUP BY c))",
            f"r{t} AS (SELECT {t} AS epoch, loss, n, (SELECT avg((said = label)::INT) FROM a{t}) AS accuracy, (SELECT f1 FROM f{t}) AS f1 FROM l{t})",
        ]
    every = " UNION ALL ".join(f"SELECT * FROM r{t}" for t in range(1, epochs + 1))
    return f"""WITH {", ".join(steps)}, r AS ({every}) SELECT epoch, 'all' AS phase, n AS rows, round(loss, 6) AS train_loss, round(accuracy, 6) AS validation_accuracy, round(f1, 6) AS validation_macro_f1,
  coalesce(f1 > max(f1) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM r"""


@query(_training_sql(4, 0.05, 0.01))
def training_history(spark, sf_dir):
    """A softmax classifier of the vectors, each epoch with its figures and whether it is the best so far."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    fit, held = rows.filter("vec_id % 5 != 0"), rows.filter("vec_id % 5 = 0")
    schedule = training.Schedule(epochs=4, head_rate=0.05, decay=0.01)
    found = training.train(fit, held, [str(k) for k in range(10)], schedule, training.Network(), fresh_path(spark, "training"), "embedding", "label")
    told = split.running_best(found.history).drop("best_before")
    return _rounded(told, "train_loss", "validation_accuracy", "validation_macro_f1")


@query("SELECT t.epoch::INT AS epoch, CASE WHEN t.epoch <= 2 THEN 'head' ELSE 'all' END AS phase, count(*) AS rows, t.epoch > 3 AS after_restart FROM embeddings, range(1, 5) t(epoch) WHERE vec_id % 5 != 0 GROUP BY ALL")
def training_resumed(spark, sf_dir):
    """A hidden layer stays as it is for two epochs; the run is stopped after the third, and goes on with the same figures as one that isn't stopped."""

    class Stopped(Exception):
        pass

    def stop(epoch):
        if epoch == 3:
            raise Stopped

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    fit, held, names = rows.filter("vec_id % 5 != 0"), rows.filter("vec_id % 5 = 0"), [str(k) for k in range(10)]
    schedule, network, folder = training.Schedule(epochs=4, head_epochs=2, steps=2, head_rate=0.05, trunk_rate=0.02), training.Network(hidden=16, seed=7), fresh_path(spark, "training")
    run = lambda where, after: training.train(fit, held, names, schedule, network, where, "embedding", "label", after)
    later: list[int] = []
    try:
        run(folder, stop)
    except Stopped:
        pass
    found = run(folder, later.append)
    whole = run(fresh_path(spark, "training"), lambda epoch: None).history
    figures = ["train_loss", "validation_accuracy", "validation_macro_f1"]
    same = _rounded(found.history, *figures, places=9).intersect(_rounded(whole, *figures, places=9))
    return same.select("epoch", "phase", "rows", F.col("epoch").isin(later).alias("after_restart"))


# ---------------------------------------------------------------- joins and membership


@query("""SELECT o_orderkey, c_name, n_name AS nation, r_name AS region FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def enriched_lookup(spark, sf_dir):
    """J1, J3, P1, P2."""
    t = lambda n: table(spark, sf_dir, n)
    nations = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")  # 25 rows at any scale
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("o_orderkey", "c_name", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("""SELECT a.user_id, a.n AS n_a, b.n AS n_b FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1) a JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY 1) b USING (user_id)""")
def suffix_join(spark, sf_dir):
    """J2."""
    events = table(spark, sf_dir, "events")
    ends = events.agg(F.min("event_type").alias("first"), F.max("event_type").alias("last"))  # one row
    side = lambda end, name: events.join(F.broadcast(ends.select(F.col(end).alias("event_type"))), "event_type").groupBy("user_id").agg(F.count(F.lit(1)).alias(name))
    return side("first", "n_a").join(side("last", "n_b"), "user_id")


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'train' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') THEN 'test' END AS split FROM customer")
def membership_class(spark, sf_dir):
    """J7, S12."""
    listed = lambda s: table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("key")).distinct()
    return manifests.membership(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", listed("F"), listed("O")).select("c_custkey", "split")


_MEMBERS = "members AS (SELECT DISTINCT doc_id::VARCHAR AS key, CASE WHEN doc_id % 7 = 0 THEN 'test' ELSE 'train' END AS split FROM labels)"


def _members(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("key"), F.when(F.col("doc_id") % 7 == 0, "test").otherwise("train").alias("split")).distinct()


@query(f"WITH {_MEMBERS} SELECT DISTINCT doc_id::VARCHAR AS key FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT key FROM members)")
def unknown_members(spark, sf_dir):
    """J5, J8, A25."""
    return gates.unknown_members(table(spark, sf_dir, "documents"), "doc_id", _members(spark, sf_dir))


@query(f"""WITH {_MEMBERS}, {_MANIFEST} SELECT m.split AS declared, b.split AS member_of, count(*) AS n FROM manifest m JOIN members b ON m.doc_id::VARCHAR = b.key WHERE m.split != b.split GROUP BY ALL""")
def split_contradictions(spark, sf_dir):
    """A26, A12."""
    rows = manifest(spark, sf_dir).select(F.col("doc_id").cast("string").alias("key"), F.col("split").alias("declared"))
    return rows.join(_members(spark, sf_dir).withColumnRenamed("split", "member_of"), "key").filter(F.col("declared") != F.col("member_of")).groupBy("declared", "member_of").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT split AS split, count(*) AS n FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN 'test' ELSE 'train' END AS split FROM labels) GROUP BY 1")
def membership_counts(spark, sf_dir):
    """J8, A26."""
    return gates.membership_counts(table(spark, sf_dir, "labels"), "doc_id", _members(spark, sf_dir))


# ---------------------------------------------------------------- strings and matching


@query("""SELECT DISTINCT url, regexp_replace(lower(url), '[^\\p{L}\\p{N}]', '', 'g') AS unicode_name, regexp_replace(lower(trim(url)), '[^a-z0-9]', '', 'g') AS ascii_name,
  regexp_replace(lower(regexp_extract(url, '^(https?)', 1)), '[^a-z]', '', 'g') IN ('test', 'holdout') AS guarded FROM pages""")
def normalised_keys(spark, sf_dir):
    """X3-X5."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("url", labels.split_name(url).alias("unicode_name"), labels.ascii_split_name(url).alias("ascii_name"), labels.is_guarded(F.regexp_extract(url, "^(https?)", 1)).alias("guarded")).distinct()


_ALIASED = "CASE regexp_replace(lower({0}), '[^a-z0-9]', '', 'g') WHEN 'vw' THEN 'volkswagen' WHEN 'mercedes' THEN 'mercedesbenz' WHEN 'chevy' THEN 'chevrolet' WHEN 'bwm' THEN 'bmw' WHEN 'benz' THEN 'mercedesbenz' ELSE regexp_replace(lower({0}), '[^a-z0-9]', '', 'g') END"
_NAMES = ["VW", "Mercedes", "Chevy", "BWM", "Benz", "BMW"]
_SAID = ["Volkswagen", "Mercedes-Benz", "Chevrolet", "bmw", "Benz!", "Audi"]
_PARTS = "SELECT p_partkey, (['VW', 'Mercedes', 'Chevy', 'BWM', 'Benz', 'BMW'])[(p_partkey % 6 + 1)::INT] AS truth, (['Volkswagen', 'Mercedes-Benz', 'Chevrolet', 'bmw', 'Benz!', 'Audi'])[(p_partkey // 6 % 6 + 1)::INT] AS said FROM part"


def _pick(values: list[str], at: str):
    return F.element_at(F.array(*map(F.lit, values)), F.expr(f"cast({at} as int)") + 1)


@query(f"WITH p AS ({_PARTS}) SELECT truth, said, {_ALIASED.format('truth')} = {_ALIASED.format('said')} AS matches, count(*) AS n FROM p GROUP BY ALL")
def alias_match(spark, sf_dir):
    """X7, X8, E4."""
    rows = table(spark, sf_dir, "part").select(_pick(_NAMES, "p_partkey % 6").alias("truth"), _pick(_SAID, "p_partkey div 6 % 6").alias("said"))
    return rows.groupBy("truth", "said", matching.make_matches(F.col("truth"), F.col("said")).alias("matches")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT p_partkey, p_brand AS make, p_brand || ' ' || p_type || ' sedan' AS truth, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_brand || ' ' || p_type || ' SEDAN' WHEN 2 THEN p_type || ' suv' END AS said FROM part),
  k AS (SELECT *, regexp_replace(lower(truth), '[^a-z0-9]', '', 'g') AS g, regexp_replace(lower(said), '[^a-z0-9]', '', 'g') AS s, regexp_replace(lower(make), '[^a-z0-9]', '', 'g') AS m FROM p)
  SELECT p_partkey, coalesce(g = s OR regexp_replace(substr(g, length(m) + 1), 'sedan$', '') = s, false) AS matches FROM k""")
def model_match(spark, sf_dir):
    """X10."""
    k, brand, kind = F.col("p_partkey"), F.col("p_brand"), F.col("p_type")
    said = F.when(k % 4 == 0, kind).when(k % 4 == 1, F.concat(brand, F.lit(" "), kind, F.lit(" SEDAN"))).when(k % 4 == 2, F.concat(kind, F.lit(" suv")))
    return table(spark, sf_dir, "part").select(k, matching.model_matches(F.concat(brand, F.lit(" "), kind, F.lit(" sedan")), said, brand).alias("matches"))


@query("""WITH p AS (SELECT (['Grey', 'gold', ' Navy ', 'red'])[(p_partkey % 4 + 1)::INT] AS truth, (['silver and white', 'champagne', 'dark-blue', 'maroon', 'grey/black'])[(p_partkey // 4 % 5 + 1)::INT] AS said FROM part),
  a AS (SELECT *, CASE lower(trim(truth)) WHEN 'grey' THEN 'silver' WHEN 'gold' THEN 'champagne' WHEN 'navy' THEN 'blue' ELSE lower(trim(truth)) END AS t,
    list_transform(regexp_extract_all(lower(said), '[a-z]+'), lambda w: CASE w WHEN 'grey' THEN 'silver' WHEN 'maroon' THEN 'red' ELSE w END) AS words FROM p)
  SELECT truth, said, list_contains(words, t) AS matches, count(*) AS n FROM a GROUP BY ALL""")
def colour_word_match(spark, sf_dir):
    """X9."""
    rows = table(spark, sf_dir, "part").select(
        _pick(["Grey", "gold", " Navy ", "red"], "p_partkey % 4").alias("truth"), _pick(["silver and white", "champagne", "dark-blue", "maroon", "grey/black"], "p_partkey div 4 % 5").alias("said")
    )
    return rows.groupBy("truth", "said", matching.colour_matches(F.col("truth"), F.col("said")).alias("matches")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE (CASE WHEN p_partkey % 3 = 1 THEN 'BMW' ELSE 'Mercedes-Benz' END) END AS make,
  CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_type || ' x' END AS model FROM part""")
def clean_model(spark, sf_dir):
    """X11, X12."""
    k = F.col("p_partkey")
    make = F.when(k % 3 == 0, F.col("p_brand")).when(k % 3 == 1, " BWM ").otherwise("Benz")
    raw = F.when(k % 2 == 0, F.concat(make, F.lit(" - "), F.col("p_type"), F.lit("  Hatchback"))).otherwise(F.concat(F.col("p_type"), F.lit(" x")))
    # the make before a model is compared without blanks around it
    return table(spark, sf_dir, "part").select(k, matching.clean_make(make).alias("make"), matching.clean_model(F.trim(raw), make).alias("model"))


@query("SELECT doc_id, nullif(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g'), '') AS key FROM documents")
def unicode_fold(spark, sf_dir):
    """X6."""
    return table(spark, sf_dir, "documents").select("doc_id", matching.folded_key(F.col("text")).alias("key"))


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '/[a-z]+/[0-9]+') THEN regexp_extract(url, '([a-z]+/[0-9]+)', 1) END AS relative_key, lower(url) AS folded, 'image/jpeg' AS mime FROM pages""")
def path_keys(spark, sf_dir):
    """X13, X17-X19."""
    url = F.col("url")
    key = F.when(url.rlike("/[a-z]+/[0-9]+"), paths.relative_key(url, "([a-z]+/[0-9]+)"))
    return table(spark, sf_dir, "pages").select("page_id", key.alias("relative_key"), paths.folded(url).alias("folded"), paths.mime(F.concat(F.lit("x"), F.col("page_id").cast("string"), F.lit(".JPG"))).alias("mime"))


@query("""SELECT page_id, 'image/' || regexp_extract(url, 'example[.](.*)$', 1) AS relative_key, 'data/data/image/' || regexp_extract(url, 'example[.](.*)$', 1) AS image_path FROM pages""")
def path_remap(spark, sf_dir):
    """X14-X16, P1."""
    raw = F.concat(F.lit("..\\..\\data\\raw\\image/"), F.regexp_extract("url", "example[.](.*)$", 1))
    mapped = paths.remapped(raw, "../../data/raw/", "", "data/data/")
    return table(spark, sf_dir, "pages").select("page_id", mapped["relative_key"].alias("relative_key"), mapped["image_path"].alias("image_path"))


@query("SELECT split_part(replace(replace(url, 'https://', ''), 'http://', ''), '/', 1) AS host, count(*) AS files, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1")
def prefix_counts(spark, sf_dir):
    """G22, G30."""
    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").groupBy(paths.level(path, 0).alias("host")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("html")).alias("chars"))


# ---------------------------------------------------------------- runs

_LOG = """log AS (SELECT event_id, event_type AS run, CASE WHEN event_id % 2 = 0 THEN 'tuned' ELSE 'zero-shot' END AS kind, CASE WHEN event_id % 10 = 0 THEN 'Timeout' ELSE '' END AS error,
  coalesce(json_extract_string(props, '$.k')::BIGINT, 0) AS prompt_tokens, event_id % 50 AS output_tokens,
  CASE WHEN event_id % 8 = 0 THEN NULL ELSE 'm' || (user_id % 5) END AS make_gt, CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'm' || (event_id % 5) END AS make_pred, 'b' || (user_id % 3) AS body_type_gt, 'b' || (event_id % 3) AS body_type_pred FROM events),
ok AS (SELECT *, coalesce(make_gt = make_pred, false) AS make_ok, coalesce(body_type_gt = body_type_pred, false) AS body_type_ok FROM log),
long AS (SELECT run, error != '' AS failed, 'make' AS attribute, make_gt AS truth, make_pred AS said, make_ok AS ok FROM ok UNION ALL SELECT run, error != '', 'body_type', body_type_gt, body_type_pred, body_type_ok FROM ok)"""


def _log(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    text = lambda a, c: F.concat(F.lit(a), c.cast("string"))
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("run"), F.when(e % 2 == 0, "tuned").otherwise("zero-shot").alias("kind"), F.when(e % 10 == 0, "Timeout").otherwise("").alias("error"),
        F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("prompt_tokens"), (e % 50).alias("output_tokens"),
        F.when(e % 8 != 0, text("m", u % 5)).alias("make_gt"), F.when(e % 9 != 0, text("m", e % 5)).alias("make_pred"), text("b", u % 3).alias("body_type_gt"), text("b", e % 3).alias("body_type_pred"),
    )
    return runs.scored(rows, {"make": "make_gt", "body_type": "body_type_gt"})


def _long(spark, sf_dir):
    return runs.unpivoted(_log(spark, sf_dir), ["make", "body_type"], "run")


@query(f"""WITH {_LOG}, c AS (SELECT run, attribute, count(*) FILTER (NOT failed AND truth IS NOT NULL) AS n, count(*) FILTER (NOT failed AND truth IS NOT NULL AND ok) AS successes,
    count(*) FILTER (NOT failed AND truth IS NOT NULL AND said IS NULL) AS nulls, count(*) FILTER (failed) AS n_failed FROM long GROUP BY ALL), p AS (SELECT *, successes / n AS p FROM c)
  SELECT run, attribute, n, successes, round(p, 6) AS accuracy, round((p + 1.96^2 / (2 * n) - 1.96 * sqrt((p * (1 - p) + 1.96^2 / (4 * n)) / n)) / (1 + 1.96^2 / n), 6) AS ci_low,
    round((p + 1.96^2 / (2 * n) + 1.96 * sqrt((p * (1 - p) + 1.96^2 / (4 * n)) / n)) / (1 + 1.96^2 / n), 6) AS ci_high, round(nulls / n, 6) AS null_rate, n_failed FROM p""")
def run_accuracy_wilson(spark, sf_dir):
    """G18, G19."""
    return _rounded(runs.accuracy(_long(spark, sf_dir), "run"), "accuracy", "ci_low", "ci_high", "null_rate")


@query(f"WITH {_LOG} SELECT count(*) AS n, round(avg((make_ok AND body_type_ok)::INT), 6) AS accuracy FROM ok WHERE error = '' AND make_gt IS NOT NULL AND body_type_gt IS NOT NULL")
def joint_accuracy(spark, sf_dir):
    """G20."""
    return _rounded(runs.joint_accuracy(_log(spark, sf_dir), "make", "body_type"), "accuracy")


@query(f"WITH {_LOG} SELECT run, kind, sum(prompt_tokens)::BIGINT AS tokens_in, sum(output_tokens)::BIGINT AS tokens_out, round((sum(prompt_tokens) * 0.25e-6 + sum(output_tokens) * 1.5e-6) * CASE WHEN kind = 'tuned' THEN 1.5 ELSE 1 END, 4) AS est_cost_usd FROM log GROUP BY run, kind")
def run_cost(spark, sf_dir):
    """G21, M24."""
    return runs.costs(_log(spark, sf_dir))


@query(f"""WITH {_LOG}, c AS (SELECT run, kind, round((sum(prompt_tokens) * 0.25e-6 + sum(output_tokens) * 1.5e-6) * CASE WHEN kind = 'tuned' THEN 1.5 ELSE 1 END, 4) AS usd FROM log GROUP BY run, kind)
  SELECT round(sum(usd), 4) AS inference_usd, 22.89::DOUBLE AS tuning_usd, round(sum(usd) + 22.89::DOUBLE, 4) AS total_usd FROM c""")
def total_cost(spark, sf_dir):
    """G21."""
    return _rounded(runs.total_cost(runs.costs(_log(spark, sf_dir))), "inference_usd", "tuning_usd", "total_usd", places=4)


@query(f"WITH {_LOG} SELECT run, failed, attribute, truth, said, ok, count(*) AS n FROM long GROUP BY ALL")
def attribute_unpivot(spark, sf_dir):
    """P5, P6."""
    return _long(spark, sf_dir).groupBy("run", "failed", "attribute", "truth", "said", "ok").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LOG}, c AS (SELECT attribute, truth, said, count(*) AS count FROM long WHERE NOT failed AND NOT ok AND truth IS NOT NULL GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY attribute ORDER BY count DESC, truth, said NULLS LAST) <= 5")
def top_mismatches(spark, sf_dir):
    """F5, T3."""
    return runs.top_mismatches(_long(spark, sf_dir), 5, "attribute")


@query(f"WITH {_LOG} SELECT event_id, make_gt, make_pred FROM ok WHERE make_gt = 'm1' AND make_pred = 'm2'")
def drill_down(spark, sf_dir):
    """F1, F10."""
    return _log(spark, sf_dir).filter((F.col("make_gt") == "m1") & (F.col("make_pred") == "m2")).select("event_id", "make_gt", "make_pred")


@query("SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1")
def seed_spread(spark, sf_dir):
    """G27, G7."""
    return _rounded(runs.seed_spread(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderstatus"), "mean", "sd", places=4)


# ---------------------------------------------------------------- statistics


@query("""SELECT count(*) AS n, round(avg(l_extendedprice), 4) AS mean, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
  round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, max(l_extendedprice) AS max FROM lineitem""")
def descriptive_stats(spark, sf_dir):
    """G23, G7."""
    found = quantiles.description(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return _rounded(found, "mean", "q1", "median", "q3", places=4).drop("sd")


@query("""SELECT l_returnflag, count(*) AS n, round(avg(l_quantity * l_discount), 4) AS mean, round(stddev_samp(l_quantity * l_discount), 4) AS sd, round(min(l_quantity * l_discount), 4) AS min,
  round(quantile_cont(l_quantity * l_discount, 0.25), 4) AS q1, round(quantile_cont(l_quantity * l_discount, 0.5), 4) AS median, round(quantile_cont(l_quantity * l_discount, 0.75), 4) AS q3, round(max(l_quantity * l_discount), 4) AS max FROM lineitem GROUP BY 1""")
def timing_table(spark, sf_dir):
    """What timings of trials are told by, for each group; quantities stand for milliseconds."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") * F.col("l_discount")).alias("milliseconds"))
    return _rounded(quantiles.description(rows, "milliseconds", ["l_returnflag"]), "mean", "sd", "min", "q1", "median", "q3", "max", places=4)


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders) SELECT o_orderkey, o_totalprice FROM orders, q WHERE o_totalprice < a - 0.2 * (b - a) OR o_totalprice > b + 0.2 * (b - a)""")
def iqr_outliers(spark, sf_dir):
    """G23; a fifth of the range, as the stand-in has no far outliers."""
    return quantiles.outliers(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.2)


@query("SELECT CASE WHEN l_quantity < 1 THEN 0 WHEN l_quantity >= 51 THEN 11 ELSE floor((l_quantity - 1) / 5)::BIGINT + 1 END AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark, sf_dir):
    """G24."""
    return table(spark, sf_dir, "lineitem").groupBy(F.width_bucket(F.col("l_quantity"), F.lit(1.0), F.lit(51.0), F.lit(10)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, c_nationkey LIMIT 20")
def top_groups(spark, sf_dir):
    """T5, T6, G2."""
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c_nationkey").limit(20)


@query("""SELECT c_custkey, coalesce(sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / count(o_orderkey) / 100, 0) AS mean, coalesce(min(o_totalprice), 0) AS min, coalesce(max(o_totalprice), 0) AS max, count(o_orderkey) AS n
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def confidence_per_image(spark, sf_dir):
    """G25; the mean of whole cents, which any order of summing gives alike."""
    price = F.col("o_totalprice")
    mean = F.sum(F.round(price * 100).cast("long")).cast("double") / F.count("o_orderkey") / 100
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(mean.alias("mean"), F.min(price).alias("min"), F.max(price).alias("max"), F.count("o_orderkey").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left").select("c_custkey", zero("mean"), zero("min"), zero("max"), zero("n"))


@query("SELECT p_size % 8 AS viewpoint, count(*) AS n, CASE p_size % 8 WHEN 1 THEN 'front' WHEN 2 THEN 'rear' WHEN 3 THEN 'side' WHEN 4 THEN 'front-side' WHEN 5 THEN 'rear-side' ELSE 'unknown-' || (p_size % 8) END AS name FROM part GROUP BY ALL")
def viewpoint_counts(spark, sf_dir):
    """G31."""
    return manifests.viewpoints(table(spark, sf_dir, "part").select((F.col("p_size") % 8).alias("viewpoint")))


@query(f"WITH {_MANIFEST} SELECT count(DISTINCT source) FILTER (split = 'train') AS inside, count(DISTINCT source) AS across FROM manifest")
def conditional_distinct(spark, sf_dir):
    """G32."""
    return manifest(spark, sf_dir).agg(F.countDistinct(F.when(F.col("split") == "train", F.col("source"))).alias("inside"), F.countDistinct("source").alias("across"))


@query("SELECT p_brand, count(*) AS models, count(*) FILTER (n < 3) AS rare FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY 1")
def rare_models(spark, sf_dir):
    """G30."""
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n")).groupBy("p_brand").agg(F.count(F.lit(1)).alias("models"), F.count_if(F.col("n") < 3).alias("rare"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IS DISTINCT FROM '5-LOW'")
def inequality_filter(spark, sf_dir):
    """F2, F4, P1, P3."""
    return table(spark, sf_dir, "orders").filter(~F.col("o_orderpriority").eqNullSafe("5-LOW")).select("o_orderkey", "o_orderpriority")


# ---------------------------------------------------------------- boxes, vehicles, JSON

_BOX = "b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - 5.5 AS x1, l_discount * 100 AS y1, l_quantity + l_tax * 100 + 0.5 AS x2, l_discount * 100 + 10 * l_linenumber + 0.5 AS y2 FROM lineitem)"


@query(f"""WITH {_BOX}, c AS (SELECT *, greatest(0, least(round_even(x1, 0), 40))::INT AS a, greatest(0, least(round_even(y1, 0), 30))::INT AS b, greatest(0, least(round_even(x2, 0), 40))::INT AS c, greatest(0, least(round_even(y2, 0), 30))::INT AS d FROM b),
  k AS (SELECT * FROM c WHERE c > a AND d > b)
  SELECT a AS x1, b AS y1, c AS x2, d AS y2, greatest(0, trunc(a - (c - a) * 0.15::DOUBLE))::INT AS px1, least(40, trunc(c + (c - a) * 0.15::DOUBLE))::INT AS px2, round((c - a) / (d - b), 2) AS aspect, count(*) AS n FROM k GROUP BY ALL""")
def box_algebra(spark, sf_dir):
    """M1-M7, M23."""
    q, d = F.col("l_quantity"), F.col("l_discount") * 100
    values = [q - 5.5, d, q + F.col("l_tax") * 100 + 0.5, d + 10 * F.col("l_linenumber") + 0.5]
    rows = table(spark, sf_dir, "lineitem").select(boxes.clamped(values, F.lit(40), F.lit(30)).alias("box")).filter("box IS NOT NULL")
    wide = rows.withColumn("p", boxes.padded(F.col("box"), F.lit(40), F.lit(30))).withColumn("aspect", boxes.aspect(F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1")))
    return wide.select("box.*", F.col("p.x1").alias("px1"), F.col("p.x2").alias("px2"), "aspect").groupBy("x1", "y1", "x2", "y2", "px1", "px2", "aspect").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT CASE p_size % 5 WHEN 0 THEN '(0, 1, 10, 10)' WHEN 1 THEN '(1, 2, 12, 13)' WHEN 2 THEN '(1.5, 1, 10, 10)' WHEN 3 THEN '(1, 2, 3)' END AS bbox FROM part)
  SELECT bbox, coalesce(bbox = '(1, 2, 12, 13)', false) AS official, CASE bbox WHEN '(1, 2, 12, 13)' THEN 0 END AS zero_x1, CASE bbox WHEN '(0, 1, 10, 10)' THEN 0 WHEN '(1, 2, 12, 13)' THEN 1 WHEN '(1.5, 1, 10, 10)' THEN 2 END AS parsed_x1, count(*) AS n FROM t GROUP BY ALL""")
def box_validity(spark, sf_dir):
    """M1-M3, M6."""
    k = F.col("p_size") % 5
    text = F.when(k == 0, "(0, 1, 10, 10)").when(k == 1, "(1, 2, 12, 13)").when(k == 2, "(1.5, 1, 10, 10)").when(k == 3, "(1, 2, 3)")
    rows = table(spark, sf_dir, "part").select(text.alias("bbox"))
    n = boxes.numbers(F.col("bbox"))
    ok = boxes.official(n)
    return rows.groupBy("bbox", ok.alias("official"), F.when(ok, boxes.zero_based(n)["x1"]).alias("zero_x1"), boxes.parsed(F.col("bbox"))["x1"].alias("parsed_x1")).agg(F.count(F.lit(1)).alias("n"))


def _vehicles(spark, sf_dir):
    k = F.col("p_partkey")
    status = F.create_map(*[F.lit(x) for a in ("colour", "make", "model", "body_type", "damage", "accessories") for x in (a, f"{a} local")])
    profile = F.struct(
        F.when(k % 2 == 0, F.col("p_brand")).alias("make"), F.lit("").alias("model"), F.when(k % 3 == 0, F.col("p_type")).alias("body_type"), F.lit("red").alias("colour"),
        F.create_map(F.lit("colour"), F.col("p_size") / 100.0).alias("confidence"), status.alias("status"),
    )
    other = F.struct(F.lit("Acme").alias("make"), F.when(k % 5 == 0, F.lit("T")).alias("model"), F.lit(None).cast("string").alias("body_type"), F.lit("blue").alias("colour"))
    return table(spark, sf_dir, "part").select(
        F.lit("image").alias("source_image_id"), F.format_string("vehicle_%03d", k).alias("vehicle_crop_id"), F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("bbox_xyxy"), F.lit(0.5).alias("confidence"),
        profile.alias("vehicle_profile"), other.alias("vlm_profile"), F.lit("remote").alias("vlm_status"),
    )


@query("""SELECT 'image' AS source_image_id, printf('vehicle_%03d', p_partkey) AS vehicle_crop_id, 1 AS bbox_x1, 2 AS bbox_y1, 3 AS bbox_x2, 4 AS bbox_y2, 0.5 AS detection_confidence, 'red' AS colour, round(p_size / 100.0, 6) AS colour_confidence,
  'colour local' AS colour_status, 'make local' AS make_status, 'model local' AS model_status, 'body_type local' AS body_type_status, 'damage local' AS damage_status, 'accessories local' AS accessories_status FROM part""")
def profile_flatten(spark, sf_dir):
    """P4, K7, W5, M21."""
    return _rounded(scoring.flat_vehicles(_vehicles(spark, sf_dir)), "colour_confidence")


@query("""SELECT printf('vehicle_%03d', p_partkey) AS vehicle_crop_id, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS make, CASE WHEN p_partkey % 5 = 0 THEN 'T' ELSE '' END AS model, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS body_type,
  CASE WHEN p_partkey % 5 = 0 THEN 'remote' ELSE 'model local' END AS model_status FROM part""")
def coalesce_fallback(spark, sf_dir):
    """Make is covered by a predictor, model and body type aren't."""
    out = scoring.fallback(_vehicles(spark, sf_dir), {"make"}, "remote")
    p = "vehicle_profile"
    return out.select("vehicle_crop_id", f"{p}.make", f"{p}.model", f"{p}.body_type", F.col(f"{p}.status")["model"].alias("model_status"))


@query("""SELECT printf('vehicle_%03d', p_partkey) AS vehicle, a AS attribute,
  CASE a WHEN 'make' THEN coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_brand END, 'not assessed') WHEN 'body_type' THEN coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_type END, 'not assessed') WHEN 'colour' THEN 'red' ELSE 'not assessed' END AS local,
  a || ' local' AS source, CASE a WHEN 'make' THEN 'Acme' WHEN 'colour' THEN 'blue' WHEN 'model' THEN CASE WHEN p_partkey % 5 = 0 THEN 'T' ELSE 'not assessed' END ELSE 'not assessed' END AS other, 'remote' AS other_source
  FROM part, (VALUES ('make'), ('body_type'), ('colour'), ('model')) v(a)""")
def vehicle_comparison(spark, sf_dir):
    """P5, X22."""
    return scoring.comparison(_vehicles(spark, sf_dir).withColumn("attribute_profile", F.col("vehicle_profile")))


@query("""SELECT event_id, 'vehicle_' || lpad(i::VARCHAR, 3, '0') AS vehicle_crop_id, i - 1 AS position, round(i / 10, 6) AS confidence FROM events, range(1, 3) t(i)""")
def detections_json(spark, sf_dir):
    """S15, W5."""
    text = F.when(F.col("event_id") % 2 == 0, '{"detections": [{"bbox_xyxy": [1, 2, 3, 4], "confidence": 0.1}, {"bbox_xyxy": [1, 2, 3, 4], "confidence": 0.2}]}').otherwise('[{"bbox_xyxy": [1, 2, 3, 4], "confidence": 0.1}, {"bbox_xyxy": [1, 2, 3, 4], "confidence": 0.2}]')
    return _rounded(tables.detections(table(spark, sf_dir, "events").select("event_id", text.alias("j")), "j").select("event_id", "vehicle_crop_id", F.col("position").cast("long").alias("position"), "confidence"), "confidence")


@query("SELECT event_id, '{\"k\": ' || event_id || '}' AS json, event_id AS k FROM events")
def json_from_text(spark, sf_dir):
    """M19, M20."""
    text = F.concat(F.lit("Sure: "), F.lit('{"k": '), F.col("event_id").cast("string"), F.lit("} I hope"))
    return table(spark, sf_dir, "events").select("event_id", paths.json_in(text).alias("json")).withColumn("k", F.from_json("json", "k long")["k"])


@query("SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS tokens FROM events GROUP BY 1")
def props_tokens(spark, sf_dir):
    """M19, G21."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens"))


@query("SELECT page_id, sha256(html) AS sha256, octet_length(encode(html)) AS bytes FROM pages")
def content_digest(spark, sf_dir):
    """M16, M17."""
    content = F.col("html").cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(content, 256).alias("sha256"), F.length(content).cast("long").alias("bytes"))


@query("""SELECT page_id, octet_length(encode(html)) AS actual_bytes, CASE WHEN page_id % 17 = 0 THEN 'missing' WHEN page_id % 13 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM pages WHERE page_id % 17 != 0
  UNION ALL SELECT page_id, NULL, 'missing' FROM pages WHERE page_id % 17 = 0""")
def archive_integrity(spark, sf_dir):
    """A14, A15, M17."""
    k, content = F.col("page_id"), F.col("html").cast("binary")
    pages = table(spark, sf_dir, "pages")
    listed = pages.select(k.alias("name"), (F.length(content) + F.when(k % 13 == 0, 1).otherwise(0)).cast("long").alias("expected_bytes"), F.crc32(content).alias("expected_crc32"))
    found = audit.integrity(listed, pages.filter(k % 17 != 0).select(k.alias("name"), content.alias("content")))
    return found.select(F.col("name").alias("page_id"), "actual_bytes", "status")


_HASHED = "SELECT sha256('[\"' || c_custkey || '\",\"None\",\"' || coalesce(c_mktsegment, 'None') || '\",\"None\"]') AS h FROM customer"
_PARTS = [f"('0x' || substr(h, {1 + 8 * k}, 8))::BIGINT" for k in range(8)]


@query(f"WITH r AS ({_HASHED}) SELECT sha256(concat_ws('|', count(*), {', '.join(f'bit_xor({p})' for p in _PARTS)}, {', '.join(f'sum({p})' for p in _PARTS)})) AS sha256, count(*) AS rows FROM r")
def rowset_digest(spark, sf_dir):
    """One digest of all rows."""
    rows = table(spark, sf_dir, "customer")
    return spark.createDataFrame([(gates.rows_digest(rows, "c_custkey", "c_mktsegment"), rows.count())], "sha256 string, rows long")


_CENTRE = """centre AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) WHERE label IS NOT NULL GROUP BY ALL) GROUP BY 1),
d AS (SELECT vec_id, centre.label, list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - c[i]) * (embedding[i]::DOUBLE - c[i]))) AS q FROM embeddings, centre)"""


@query(f"WITH {_CENTRE} SELECT vec_id, label AS prediction, round(sqrt(q), 4) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY q, label) = 1")
def centroid_predictions(spark, sf_dir):
    """E1, M13, L2."""
    rows = table(spark, sf_dir, "embeddings")
    return _rounded(scoring.nearest_centroid(rows, "vec_id", "embedding", scoring.centroids(rows, "embedding", "label"), "label"), "distance", places=4)


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings)
  SELECT vec_id, list_position(e, list_max(e)) - 1 AS best, round(list_max(e) / list_sum(e), 6) AS score FROM s""")
def softmax_scores(spark, sf_dir):
    """M13."""
    scores = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", scores.alias("s"))
    return _rounded(rows.select("vec_id", stats.argmax(F.col("s")).alias("best"), F.array_max(stats.softmax(F.col("s"))).alias("score")), "score")


@query("""WITH c AS (SELECT p_partkey, p_partkey * 37 % 256 AS r, p_partkey * 91 % 256 AS g, p_partkey * 53 % 256 AS b FROM part),
  m AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM c),
  h AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN v = r THEN (g - b)::DOUBLE / d * 60 WHEN v = g THEN (b - r)::DOUBLE / d * 60 + 120 ELSE (r - g)::DOUBLE / d * 60 + 240 END AS degrees,
    CASE WHEN v = 0 THEN 0 ELSE round_even(d::DOUBLE / v * 255, 0) END AS s FROM m),
  k AS (SELECT *, round_even(CASE WHEN degrees < 0 THEN degrees + 360 ELSE degrees END / 2, 0) % 180 AS hue FROM h)
  SELECT p_partkey, CASE WHEN v <= 45 THEN 'black' WHEN v >= 205 AND s <= 45 THEN 'white' WHEN s <= 50 THEN 'grey' WHEN hue >= 10 AND hue < 20 THEN 'orange' WHEN hue >= 20 AND hue < 35 THEN 'yellow'
    WHEN hue >= 35 AND hue < 85 THEN 'green' WHEN hue >= 85 AND hue < 130 THEN 'blue' WHEN hue >= 130 AND hue < 160 THEN 'purple' WHEN hue >= 160 AND hue < 170 THEN 'pink' ELSE 'red' END AS label,
    1.0::DOUBLE AS confidence, 'baseline_estimate' AS status, 560 AS evaluated_pixels FROM k""")
def hsv_colour(spark, sf_dir):
    """Images made from numbers, as there are no image tables."""
    k = F.col("p_partkey")
    byte = lambda c: F.lpad(F.hex(c % 256), 2, "0")
    pixel = F.concat(byte(k * 37), byte(k * 91), byte(k * 53))
    image = F.concat(F.lit(b"P6\n40 40\n255\n"), F.unhex(F.repeat(pixel, F.lit(1600))))
    seen = scoring.colours(dealt(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", image.alias("content")))
    return seen.select("p_partkey", "colour.label", "colour.confidence", "colour.status", "colour.evaluated_pixels")


@query("""WITH s AS (SELECT * FROM part WHERE p_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY sha256('42|' || p_partkey), p_partkey) <= 2)
  SELECT '{"contents":[{"role":"user","parts":[{"fileData":{"mimeType":"image/png","fileUri":"gs://bucket/images/' || printf('train_%04d', p_partkey) || '.png"}},{"text":"What is it?"}]},{"role":"model","parts":[{"text":"{\\"make\\":\\"'
    || p_brand || '\\",\\"model\\":\\"' || p_name || '\\",\\"body_type\\":\\"' || p_type || '\\"}"}]}]}' AS value FROM s""".replace("What is it?", scoring.PROMPTS["raw"].replace("'", "''")))
def tuning_jsonl(spark, sf_dir):
    """K4, L7, M20, E6."""
    rows = split.sample_per_class(table(spark, sf_dir, "part"), "p_type", 2, 42, "p_partkey").withColumn("image_path", F.concat(F.lit("a/b/"), F.col("p_partkey").cast("string"), F.lit(".png")))
    return tables.tuning_examples(rows, scoring.PROMPTS["raw"], "gs://bucket", "train", "p_brand", "p_name", "p_type", order="p_partkey")


from tabulon.plans import files_and_gates as _more  # noqa: E402, F401  (registers its queries here)
