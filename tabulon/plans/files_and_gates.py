"""Queries through files, images, remote calls and gates, with SQL that gives the same rows.

Tables are written to fresh folders of the shared checkpoint folder and read again by the engine's own sources.
"""

from __future__ import annotations

import io
import json
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabulon.errors import RefusedInput
from tabulon.functions import labels, stats
from tabulon.operators import audit, evaluate, gates, remote, runs, scoring, suppression
from tabulon.plans.catalogue import _PRED, CLASSES, _cells, _classes, _rounded, manifest, predictions, query, table
from tabulon.session import dealt, fresh_path
from tabulon.sources import bundle, manifests, mat, png, report, store, tables, zip_index


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


# ---------------------------------------------------------------- sources and sinks


@query("""SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'a,"b" ' WHEN c_custkey % 5 = 0 THEN ' x' ELSE c_mktsegment END AS label, CASE WHEN c_custkey % 4 != 0 THEN c_nationkey END AS nation FROM customer""")
def csv_roundtrip(spark, sf_dir):
    """Missing tokens, quotes, blanks, numbers that aren't, and a column that isn't read."""
    k = F.col("c_custkey")
    label = F.when(k % 9 == 0, "NA").when(k % 7 == 0, 'a,"b" ').when(k % 5 == 0, " x").otherwise(F.col("c_mktsegment"))
    nation = F.when(k % 4 == 0, "none").otherwise(F.col("c_nationkey").cast("string"))
    path = fresh_path(spark, "csv")
    tables.write_csv(table(spark, sf_dir, "customer").select(k, label.alias("label"), "c_name", nation.alias("nation")), path)
    return tables.read_csv(spark, path, "c_custkey long, label string, nation int", ["c_custkey", "label", "nation"])


@query("SELECT p_partkey::VARCHAR AS model_id, p_size::VARCHAR AS type FROM part")
def attribute_file(spark, sf_dir):
    """S3: columns between blanks."""
    path = fresh_path(spark, "attributes")
    _part(spark, sf_dir).select(F.concat(F.lit("  "), F.col("p_partkey").cast("string"), F.lit(" \t "), F.col("p_size").cast("string"), F.lit(" ")).alias("value")).write.text(path)
    return tables.read_columns(spark, path, ["model_id", "type"])


@query("""SELECT 'data/image/' || p_size % 7 || '/' || p_partkey || '/' || (2000 + p_size % 10) || '/x' || p_partkey || '.jpg' AS image_path, (p_size % 7)::VARCHAR AS make_id, p_partkey::INT AS model_id, (2000 + p_size % 10)::VARCHAR AS year,
  CASE WHEN p_partkey % 3 != 0 THEN '1,2,' || (10 + p_size) || ',40' END AS bbox, CASE WHEN p_partkey % 3 != 0 THEN p_size % 5 + 1 END AS viewpoint, CASE WHEN p_partkey % 3 != 0 THEN p_size % 12 END AS car_type, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS type FROM part""")
def path_manifest(spark, sf_dir):
    """Levels of a path, label files by path, attributes by model."""
    k, size = F.col("p_partkey"), F.col("p_size")
    stem = F.concat_ws("/", (size % 7).cast("string"), k.cast("string"), (2000 + size % 10).cast("string"), F.concat(F.lit("x"), k.cast("string")))
    part = _part(spark, sf_dir)
    files = part.select(F.concat(F.lit("data/image/"), stem, F.lit(".jpg")).alias("path"))
    texts = part.filter(k % 3 != 0).select(F.concat(F.lit("data\\label\\"), stem, F.lit(".txt")).alias("path"), F.array(F.lit(1), F.lit(2), 10 + size, F.lit(40)).alias("bbox"), (size % 5 + 1).alias("viewpoint"), (size % 12).alias("car_type"))
    found = manifests.web_manifest(files, texts, part.filter(k % 2 == 0).select(k.alias("model_id"), size.alias("type")))
    return found.select("image_path", "make_id", "model_id", "year", F.array_join(F.col("bbox").cast("array<string>"), ",").alias("bbox"), "viewpoint", "car_type", "type")


def _label_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a label file for each nation (a dimension of 25 rows)."""
    path, k = fresh_path(spark, "labels"), F.col("n_nationkey")
    lines = F.concat_ws("\n", (k % 5).cast("string"), F.col("n_regionkey").cast("string"), F.concat(F.lit("1 2 30 "), (k + 40).cast("string")))
    table(spark, sf_dir, "nation").select(k.alias("nation"), F.when(k % 6 == 0, "x").otherwise(lines).alias("value")).write.partitionBy("nation").text(path)
    return path


@query("""SELECT n_nationkey AS nation, CASE WHEN n_nationkey % 6 != 0 THEN n_nationkey % 5 END AS viewpoint, CASE WHEN n_nationkey % 6 != 0 THEN n_regionkey END AS car_type, CASE WHEN n_nationkey % 6 != 0 THEN '1,2,30,' || (n_nationkey + 40) END AS bbox FROM nation""")
def label_files(spark, sf_dir):
    """S7."""
    found = tables.read_label_files(spark, _label_files(spark, sf_dir))
    return found.select(F.regexp_extract("path", "nation=([0-9]+)", 1).cast("int").alias("nation"), "viewpoint", "car_type", F.array_join(F.col("bbox").cast("array<string>"), ",").alias("bbox"))


@query("SELECT c_custkey, c_custkey % 40 < 25 AS there FROM customer")
def files_exist(spark, sf_dir):
    """Rows by whether a listing has their file."""
    files = manifests.listing(spark, _label_files(spark, sf_dir), "*.txt").select(F.regexp_extract("path", "(nation=[0-9]+)/", 1).alias("path"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("nation="), (F.col("c_custkey") % 40).cast("string")).alias("folder"))
    mark = lambda df, there: df.select("c_custkey", F.lit(there).alias("there"))
    return mark(audit.existing_files(rows, "folder", files), True).unionByName(mark(audit.missing_files(rows, "folder", files), False))


@query("""SELECT 'sv/' || p_size || '/' || p_partkey || '.jpg' AS image_path, p_size AS surveillance_model_id, CASE WHEN p_size <= 40 THEN 'M' || p_size END AS make_name, CASE WHEN p_size <= 40 THEN 'X' || p_size END AS model_name,
  CASE WHEN p_size <= 40 THEN p_size + 100 END AS web_nature_model_id, CASE WHEN p_partkey % 4 != 0 THEN (p_partkey % 12 - 1)::INT END AS color_id,
  CASE WHEN p_partkey % 4 != 0 THEN CASE p_partkey % 12 - 1 WHEN -1 THEN 'unrecognized' WHEN 0 THEN 'black' WHEN 1 THEN 'white' WHEN 2 THEN 'red' WHEN 3 THEN 'yellow' WHEN 4 THEN 'blue' WHEN 5 THEN 'green' WHEN 6 THEN 'purple' WHEN 7 THEN 'brown' WHEN 8 THEN 'champagne' WHEN 9 THEN 'silver' END END AS color_name,
  CASE WHEN p_partkey % 3 = 0 THEN 'train' WHEN p_partkey % 3 = 1 THEN 'test' END AS split FROM part""")
def surveillance_files(spark, sf_dir):
    """S6, J6, J7."""
    k, size, part = F.col("p_partkey"), F.col("p_size"), _part(spark, sf_dir)
    key = F.concat(size.cast("string"), F.lit("/"), k.cast("string"), F.lit(".jpg"))
    files = part.select(F.concat(F.lit("sv/"), key).alias("path"))
    colours = part.filter(k % 4 != 0).select(key.alias("relative_key"), (k % 12 - 1).cast("int").alias("color_id"))
    names = part.filter(size <= 40).select(size.alias("surveillance_model_id"), F.concat(F.lit("M"), size.cast("string")).alias("make_name"), F.concat(F.lit("X"), size.cast("string")).alias("model_name"), (size + 100).alias("web_nature_model_id")).distinct()
    listed = lambda *rest: part.filter((k % 3).isin(*rest)).select(key.alias("key"))
    return manifests.surveillance_manifest(files, colours, names, listed(0), listed(0, 1))


_DENSE = "SELECT t.class AS target, p.class AS prediction, (SELECT count(*) FROM preds WHERE target = t.class AND prediction = p.class) AS n FROM classes t, classes p"


@query(f"WITH {_PRED} {_DENSE}")
def matrix_csv(spark, sf_dir):
    """A confusion matrix written as CSV and read again with its checks."""
    path = fresh_path(spark, "matrix")
    tables.write_csv(tables.matrix_table(evaluate.dense(_cells(spark, sf_dir), _classes(spark)), _classes(spark)), path, single=True)
    names, cells = tables.read_matrix(spark, path)
    name = lambda k: F.element_at(F.array(*map(F.lit, names)), F.col(f"{k}_id") + 1).alias(k)
    return cells.select(name("target"), name("prediction"), "n")


@query(f"WITH {_PRED} SELECT sum(support)::BIGINT AS rows, sum(hits)::BIGINT AS correct, round(sum(hits) / sum(support), 6) AS accuracy, round(avg(f), 6) AS macro_f1 FROM scored")
def matrix_evaluation(spark, sf_dir):
    """From a matrix alone, with its order of classes and its total."""
    found = evaluate.evaluate_matrix(spark, CLASSES, _cells(spark, sf_dir), CLASSES, table(spark, sf_dir, "lineitem").count())
    return _rounded(found["summary"].select("rows", "correct", "accuracy", "macro_f1"), "accuracy", "macro_f1")


@query("SELECT l_returnflag AS target, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS prediction, count(*) AS n FROM lineitem GROUP BY ALL")
def reloaded_cells(spark, sf_dir):
    """V2, V3: predictions that were written give the same matrix when they are read again."""
    path = fresh_path(spark, "predictions")
    predictions(spark, sf_dir).write.parquet(path)
    name = lambda k: F.element_at(F.array(*map(F.lit, CLASSES)), F.col(f"{k}_id") + 1).alias(k)
    return evaluate.cells(evaluate.classified_pairs(spark.read.parquet(path), _classes(spark), "target", "prediction")).select(name("target"), name("prediction"), "n")


@query(f"WITH {_PRED} SELECT sum(support)::BIGINT AS rows, sum(hits)::BIGINT AS correct, round(avg(f), 6) AS macro_f1 FROM scored")
def strict_json(spark, sf_dir):
    """A report as JSON, which has no NaN, and read again."""
    row = evaluate.summary(evaluate.per_class(_cells(spark, sf_dir), _classes(spark))).select("rows", "correct", "macro_f1").first()
    text = spark.createDataFrame([(tables.strict_json(row.asDict()),)], "j string")
    return _rounded(text.select(F.from_json("j", "rows long, correct long, macro_f1 double").alias("j")).select("j.*"), "macro_f1")


@query("""SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS run, CASE WHEN event_id % 2 = 0 THEN 'tuned' ELSE 'raw' END AS kind, event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS error FROM events""")
def collected_runs(spark, sf_dir):
    """Logs of runs with other columns, one of which is missing."""
    folder, events = fresh_path(spark, "runs"), table(spark, sf_dir, "events")
    tables.write_csv(events.filter("event_id % 2 = 0").select("event_id", F.col("event_type").alias("error")), f"{folder}/even.csv")
    tables.write_csv(events.filter("event_id % 2 = 1").select("event_id"), f"{folder}/odd.csv")
    specs = [{"label": "even", "file": "even.csv", "kind": "tuned"}, {"label": "odd", "file": "odd.csv", "kind": "raw"}, {"label": "none", "file": "none.csv", "kind": "raw"}]
    found, missing = runs.collect_runs(spark, specs, folder)
    if missing != ["none"]:
        raise RefusedInput(f"other logs are missing: {missing}")
    return found.select("run", "kind", F.col("event_id").cast("long").alias("event_id"), "error")


def _bundle(rows: DataFrame, name: str) -> str:
    """A fresh folder of the shared one with the files of `rows` (name, content)."""
    spark = rows.sparkSession
    folder = fresh_path(spark, name)
    spark.dataSource.register(bundle.FileBundle)
    rows.write.format("file_bundle").mode("append").save(folder)
    return folder


@query("""SELECT 'r' || n_regionkey || '.zip' AS archive, n_name || '.txt' AS name, length(n_name) * (n_nationkey + 1)::BIGINT AS expected_bytes, true AS sampled FROM nation""")
def zip_members(spark, sf_dir):
    """Directories of archives, read in parts by a table function, and members by the headers before them; both must tell the same."""

    def packed(rows):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as out:
            for r in rows.sort_values("n_nationkey").itertuples():
                out.writestr(f"{r.n_name}.txt", r.n_name * (r.n_nationkey + 1))
        return pd.DataFrame({"name": [f"r{rows.n_regionkey.iloc[0]}.zip"], "content": [data.getvalue()]})

    folder = _bundle(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").groupBy("n_regionkey").applyInPandas(packed, "name string, content binary"), "zip")
    archives = manifests.listing(spark, folder, "*.zip").select("path", F.element_at(F.split("path", "/"), -1).alias("archive"))

    def sampled(batches):
        for batch in batches:
            for path, archive in zip(batch.path, batch.archive):
                with store.opened(path) as file:
                    yield pd.DataFrame([(archive, name, len(data)) for name, data in zip_index.first_members(file)], columns=["archive_", "name_", "n"])

    listed = zip_index.archive_members(archives, "path", 3)
    first = archives.mapInPandas(sampled, "archive_ string, name_ string, n long")
    same = (F.col("archive") == F.col("archive_")) & (F.col("name") == F.col("name_"))
    told = F.coalesce((F.col("n") == F.col("expected_bytes")) & F.col("error").isNull(), F.lit(False))
    return listed.join(first, same, "full").select(F.coalesce("archive", "archive_").alias("archive"), F.coalesce("name", "name_").alias("name"), "expected_bytes", told.alias("sampled"))


@query("""SELECT 'n' || n_regionkey || '.mat' AS file, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS id, n_name AS name, n_nationkey FROM nation""")
def mat_lookups(spark, sf_dir):
    """Names in cells of MATLAB files, each a partition, half of them deflated, joined by their place."""

    def stored(rows):
        region = int(rows.n_regionkey.iloc[0])
        return pd.DataFrame({"name": [f"n{region}.mat"], "content": [mat.cell_file({"names": rows.sort_values("n_nationkey").n_name.tolist()}, region % 2 == 1)]})

    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    folder = _bundle(nations.groupBy("n_regionkey").applyInPandas(stored, "name string, content binary"), "mat")
    spark.dataSource.register(mat.MatFile)
    paths = ",".join(f"{folder}/n{k}.mat" for k in sorted(r[0] for r in nations.select("n_regionkey").distinct().collect()))  # a row for each region
    found = spark.read.format("mat_file").option("paths", paths).load().filter("variable = 'names'")
    lookup = found.select(F.element_at(F.split("file", "/"), -1).alias("file"), F.get("place", F.lit(0)).alias("id"), F.col("text").alias("name"))
    nth = F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey"))
    numbered = nations.select(F.concat(F.lit("n"), F.col("n_regionkey").cast("string"), F.lit(".mat")).alias("file"), nth.alias("id"), "n_nationkey")
    return lookup.join(numbered, ["file", "id"], "full").select("file", "id", "name", "n_nationkey")


@query(f"WITH {_PRED} SELECT class_index, class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support, predicted, 10::BIGINT AS files FROM scored")
def report_bundle(spark, sf_dir):
    """A report written as one bundle, a second one into its folder refused, and its table of classes read again."""
    found = evaluate.evaluate(predictions(spark, sf_dir), CLASSES)
    folder = report.write_report(found, fresh_path(spark, "report"), {"task": "flags", "seed": 1})
    try:
        report.write_report(found, folder, {})
    except RefusedInput:
        files = manifests.listing(spark, folder).count() + 1
    names = "class_index int, class string, precision double, recall double, f1 double, support long, predicted long"
    read = tables.read_csv(spark, f"{folder}/per_class.csv", "class_index int, class string, display_class string, precision double, recall double, f1 double, support long, predicted long", [x.split()[0] for x in names.split(", ")])
    return _rounded(read, "precision", "recall", "f1").withColumn("files", F.lit(files).cast("long"))


@query("SELECT r_name AS subject, CASE WHEN r_regionkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS exposures, CASE WHEN r_regionkey % 2 = 0 THEN 'second' ELSE 'first' END || r_regionkey AS last_job, CASE WHEN r_regionkey = 3 THEN 'failed' ELSE 'succeeded' END AS status, true AS refused FROM region")
def exposures(spark, sf_dir):
    """Test sets evaluated once or twice, of which the ledger tells; without a confirmation the second time is refused."""
    ledger, refused = store.Ledger(spark, fresh_path(spark, "ledger")), []
    run = lambda r, job, **kw: store.evaluated(ledger, r.r_name, f"{job}{r.r_regionkey}", "2024-01-01T00:00:00+00:00", lambda: 1 // (r.r_regionkey - 3), **kw)
    for r in table(spark, sf_dir, "region").collect():  # a dimension of five rows
        try:
            run(r, "first")
        except ZeroDivisionError:
            pass
        try:
            run(r, "more")
        except RefusedInput:
            refused.append(r.r_name)
        if r.r_regionkey % 2 == 0:
            run(r, "second", confirmed=True)
    jobs = ledger.jobs().select(F.col("job").alias("last_job"), "status")
    return ledger.exposures().join(jobs, "last_job").select("subject", "exposures", "last_job", "status", F.col("subject").isin(refused).alias("refused"))


# ---------------------------------------------------------------- images, models, remote calls


@query("""WITH i AS (SELECT p_partkey AS k, p_partkey % 5 != 0 AS fine, (10 + p_partkey % 3)::INT AS w FROM part)
  SELECT k AS p_partkey, CASE WHEN fine AND k % 4 != 0 THEN 'ok' ELSE 'error' END AS status, CASE WHEN fine THEN w END AS width, CASE WHEN fine THEN 12 END AS height FROM i""")
def image_checks(spark, sf_dir):
    """Images that don't decode, and boxes outside of them."""
    k = F.col("p_partkey")
    w = 10 + k % 3
    image = F.concat(F.encode(F.concat(F.lit("P6\n"), w.cast("string"), F.lit(" 12\n255\n")), "utf-8"), F.unhex(F.repeat(F.lit("0a141e"), (w * 12).cast("int"))))
    box = F.concat(F.lit("(1, 1, "), (w + F.when(k % 4 == 0, 5).otherwise(0)).cast("string"), F.lit(", 12)"))
    rows = dealt(_part(spark, sf_dir).select(k)).select(k, F.when(k % 5 == 0, F.lit(b"junk")).otherwise(image).alias("content"), box.alias("bbox"))
    return scoring.inspect_images(rows, box="bbox").select("p_partkey", "image.status", "image.width", "image.height")


@query("""WITH i AS (SELECT p_partkey AS k, (p_partkey * 37 % 256)::DOUBLE / 255 AS r, (p_partkey * 91 % 256)::DOUBLE / 255 AS g, (p_partkey * 53 % 256)::DOUBLE / 255 AS b, p_partkey % 11 != 0 AS fine FROM part)
  SELECT k AS p_partkey, CASE WHEN fine THEN round((r - 0.485::DOUBLE) / 0.229::DOUBLE, 4) END AS red, CASE WHEN fine THEN round((g - 0.456::DOUBLE) / 0.224::DOUBLE, 4) END AS green,
  CASE WHEN fine THEN round((b - 0.406::DOUBLE) / 0.225::DOUBLE, 4) END AS blue, CASE WHEN fine THEN 12 END AS numbers, CASE WHEN fine THEN '' ELSE 'ValueError: a chunk is cut off or damaged' END AS error FROM i""")
def png_arrays(spark, sf_dir):
    """PNG images of each filter, the part inside a box as an array of one size; broken ones say why."""

    @F.pandas_udf("binary")
    def drawn(keys: pd.Series) -> pd.Series:
        def one(k):
            rgb = np.full((5, 6, 3), 9, dtype=np.uint8)
            rgb[1:4, 2:5] = k * 37 % 256, k * 91 % 256, k * 53 % 256
            data = png.encode(rgb, k % 5)
            return data[:-20] if k % 11 == 0 else data

        return keys.map(one)

    box = F.struct(F.lit(2).alias("x1"), F.lit(1).alias("y1"), F.lit(5).alias("x2"), F.lit(4).alias("y2"))
    rows = dealt(_part(spark, sf_dir).select("p_partkey")).select("p_partkey", drawn("p_partkey").alias("content"), box.alias("box"))
    pixels = F.col("array.pixels")
    mean = lambda k: F.aggregate(F.filter(pixels, lambda v, i: i % 3 == k), F.lit(0.0), lambda a, v: a + v.cast("double")) / 4
    seen = scoring.image_arrays(rows, 2, box="box")
    return _rounded(seen.select("p_partkey", mean(0).alias("red"), mean(1).alias("green"), mean(2).alias("blue"), F.when(pixels.isNotNull(), F.size(pixels)).alias("numbers"), "array.error"), "red", "green", "blue", places=4)


@query("""SELECT 'img' || p_partkey AS key, CASE WHEN p_partkey % 10 = 3 OR p_partkey % 2 = 0 THEN 2 ELSE 1 END AS attempt, CASE WHEN p_partkey % 10 = 3 THEN 'ValueError: no image' ELSE '' END AS error,
  CASE WHEN p_partkey % 10 = 3 THEN NULL WHEN p_partkey % 2 = 0 THEN 'later' ELSE 'm' || p_partkey % 3 END AS make_pred FROM part""")
def remote_resumed(spark, sf_dir):
    """A run in which half of the calls end in a limit, and a second that asks only for what has no answer; errors that pass are tried again at once."""
    failed_once: set[str] = set()  # a worker's own

    def first(image):
        k = int(image[3:])
        if k % 10 == 3:
            raise ValueError("no image")
        if k % 2 == 0:
            raise RuntimeError("429 quota")
        if k % 5 == 1 and image not in failed_once:
            failed_once.add(image)
            raise RuntimeError("503 unavailable")
        return {"make": f"m{k % 3}"}, {"prompt": 1, "output": 1}

    def second(image):
        k = int(image[3:])
        if k % 10 == 3:
            raise ValueError("no image")
        if k % 2:
            raise RefusedInput("asked again")
        return {"make": "later"}, {}

    rows = _part(spark, sf_dir).select(F.concat(F.lit("img"), F.col("p_partkey").cast("string")).alias("image"))
    folder = fresh_path(spark, "answers")
    remote.ask(rows, "image", first, ["make"], folder, waves=1, retries=2, wait=0.0)
    return remote.ask(rows, "image", second, ["make"], folder, waves=2, wait=0.0).select("key", "attempt", "error", "make_pred")


_BOX = "greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"


@query(f"""WITH b AS (SELECT p_partkey AS id, p_partkey % 40 AS image, p_partkey * 37 % 200 AS x1, p_partkey * 91 % 150 AS y1, p_partkey * 37 % 200 + 20 + p_partkey * 13 % 30 AS x2, p_partkey * 91 % 150 + 20 + p_partkey * 17 % 25 AS y2, p_partkey * 7919 % 100003 AS score FROM part),
  l AS (SELECT image, list([{{'id': id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] ORDER BY score DESC) AS boxes FROM b GROUP BY 1),
  k AS (SELECT image, list_reduce(boxes, lambda kept, x: CASE WHEN len(list_filter(kept, lambda a: 2 * {_BOX.format(a="a", b="x[1]")} > (a.x2 - a.x1) * (a.y2 - a.y1) + (x[1].x2 - x[1].x1) * (x[1].y2 - x[1].y1) - {_BOX.format(a="a", b="x[1]")})) > 0 THEN kept ELSE list_concat(kept, x) END) AS kept FROM l)
  SELECT image, unnest(kept).id AS id FROM k""")
def suppressed_boxes(spark, sf_dir):
    """Of boxes that overlap by more than half the best stay."""
    k = F.col("p_partkey")
    x, y = k * 37 % 200, k * 91 % 150
    boxes = _part(spark, sf_dir).select(k.alias("id"), (k % 40).alias("image"), x.alias("x1"), y.alias("y1"), (x + 20 + k * 13 % 30).alias("x2"), (y + 20 + k * 17 % 25).alias("y2"), (k * 7919 % 100003).alias("score"))
    return suppression.suppressed(boxes, "image", "score").filter("kept").select("image", "id")


@query("""SELECT 'img' || p_partkey AS image, CASE WHEN p_partkey % 10 = 0 THEN 'ValueError: no image img' || p_partkey ELSE '' END AS error, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE p_partkey % 7 END AS prompt_tokens,
  CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 1 END::BIGINT AS output_tokens, CASE WHEN p_partkey % 10 != 0 THEN 'm' || p_partkey % 3 END AS make_pred, CASE WHEN p_partkey % 10 != 0 AND p_partkey % 4 != 0 THEN 'x' END AS model_pred FROM part""")
def remote_answers(spark, sf_dir):
    """A client's answers and its errors, which aren't tried again unless they may pass."""

    def client(image):
        k = int(image[3:])
        if k % 10 == 0:
            raise ValueError(f"no image {image}")
        return {"make": f"m{k % 3}", "model": None if k % 4 == 0 else "x"}, {"prompt": k % 7, "output": 1}

    rows = dealt(_part(spark, sf_dir).select(F.concat(F.lit("img"), F.col("p_partkey").cast("string")).alias("image")))
    return scoring.remote(rows, "image", client, ["make", "model"])


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 != 0 THEN 'M' || p_partkey % 3 END AS label, CASE WHEN p_partkey % 10 != 0 THEN 0.5::DOUBLE END AS score, CASE WHEN p_partkey % 10 = 0 THEN 'failed' ELSE 'predicted' END AS status, CASE WHEN p_partkey % 10 = 0 THEN 'KeyError: 0' ELSE '' END AS error FROM part")
def predictor_scores(spark, sf_dir):
    """A predictor with a transform of its inputs; a row that fails says why."""

    def load():
        names = {1: "M1", 2: "M2", 3: "M0"}  # a model
        return lambda values: [(names[v], 0.5) for v in values]

    predictor = scoring.Predictor("make", load, transform=lambda k: 0 if k % 10 == 0 else k % 3 or 3)
    return scoring.score(dealt(_part(spark, sf_dir).select("p_partkey")), "p_partkey", predictor).select("p_partkey", "scored.*")


@query("SELECT event_type, count(*) AS boxes FROM events WHERE event_id % 5 IN (0, 2, 3) GROUP BY 1")
def vehicle_detections(spark, sf_dir):
    """Of a detector's boxes those of vehicles."""
    kind = F.element_at(F.array(*map(F.lit, ("car", "person", "truck", "bus", "Car"))), (F.col("event_id") % 5 + 1).cast("int"))
    return scoring.vehicle_boxes(table(spark, sf_dir, "events").select("event_type", kind.alias("class_name"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("boxes"))


_LINEAR = "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END"


@query(f"""WITH c AS (SELECT p_partkey, p_partkey % 256 AS a, (p_partkey * 7 % 256)::DOUBLE / 255 AS r, (p_partkey * 11 % 256)::DOUBLE / 255 AS g, (p_partkey * 13 % 256)::DOUBLE / 255 AS b FROM part)
  SELECT p_partkey, round((a / 255.0::DOUBLE - 0.485::DOUBLE) / 0.229::DOUBLE, 6) AS red, round((a / 255.0::DOUBLE - 0.406::DOUBLE) / 0.225::DOUBLE, 6) AS blue,
  round({_LINEAR.format("r")} * 0.2126::DOUBLE + {_LINEAR.format("g")} * 0.7152::DOUBLE + {_LINEAR.format("b")} * 0.0722::DOUBLE, 6) AS luminance FROM c""")
def channel_values(spark, sf_dir):
    """M14, M15."""
    k = F.col("p_partkey")
    part = lambda n: (k * n % 256) / 255.0
    values = _part(spark, sf_dir).select(k, stats.normalised(k % 256, 0).alias("red"), stats.normalised(k % 256, 2).alias("blue"), stats.luminance(part(7), part(11), part(13)).alias("luminance"))
    return _rounded(values, "red", "blue", "luminance")


# ---------------------------------------------------------------- positions, order, presentation


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS row_position FROM orders")
def row_positions(spark, sf_dir):
    """W7."""
    return evaluate.with_position(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"]).select("o_orderkey", "row_position")


@query("SELECT c_custkey FROM customer QUALIFY row_number() OVER (ORDER BY c_custkey) BETWEEN 11 AND 30")
def positional_slice(spark, sf_dir):
    """rows 10 to 29, which is the feature."""
    return evaluate.with_position(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"]).filter("row_position BETWEEN 10 AND 29").select("c_custkey")


@query(f"WITH {_PRED} SELECT row_number() OVER (ORDER BY r, class) AS place, class, round(r, 6) AS recall FROM scored")
def worst_recall(spark, sf_dir):
    """T2."""
    ordered = evaluate.by_recall(evaluate.per_class(_cells(spark, sf_dir), _classes(spark)))
    return ordered.select(F.row_number().over(W.orderBy("recall", "class")).alias("place"), "class", F.round("recall", 6).alias("recall"))  # a row for each class


@query("""SELECT n_nationkey, '&lt;b&gt;' || n_name || ' &amp; &quot;co&quot; &#x27;s' AS escaped, 'Nation ' || n_nationkey AS title FROM nation""")
def html_labels(spark, sf_dir):
    """X20."""
    name = F.col("n_name")
    return table(spark, sf_dir, "nation").select("n_nationkey", labels.html_escaped(F.concat(F.lit("<b>"), name, F.lit(" & \"co\" 's"))).alias("escaped"), labels.title(F.lower(name)).alias("title"))


# ---------------------------------------------------------------- gates and records


@query("SELECT sha256('[\"' || string_agg(p_brand, '\", \"' ORDER BY p_brand) || '\"]') AS sha256, count(*) AS classes FROM (SELECT DISTINCT p_brand FROM part)")
def class_digest(spark, sf_dir):
    """M18, G6."""
    names = [r[0] for r in _part(spark, sf_dir).select("p_brand").distinct().orderBy("p_brand").collect()]  # class names
    return spark.createDataFrame([(gates.class_order_digest(names), len(names))], "sha256 string, classes long")


@query("SELECT event_type AS run, max(event_id) AS seed, 3 AS epochs, 'cpu' AS device, 'make,model' AS answered, true AS utc, 2 AS sources FROM events GROUP BY 1")
def run_records(spark, sf_dir):
    """For each run of a log the configuration with what its record overrides, the attributes that are asked for, and a snapshot of sources."""
    found = []
    for r in table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("event_id").alias("seed")).collect():  # a row for each run
        config = gates.overlay({"seed": 1, "epochs": 3}, {"seed": r.seed, "device": "cpu", "epochs": 9})
        told = gates.run_metadata(config)
        hashes = gates.source_snapshot(spark, [stats.__file__, labels.__file__], fresh_path(spark, "sources"))
        answered = scoring.answerable(["make", "colour", "model"], "tuned")
        found.append((r.event_type, told["seed"], told["config"]["epochs"], config["device"], ",".join(answered), told["timestamp_utc"].endswith("+00:00"), len(hashes)))
    return spark.createDataFrame(found, "run string, seed long, epochs int, device string, answered string, utc boolean, sources int")


@query("""WITH c AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_brand || ' ' ELSE p_brand END AS raw_label FROM part WHERE p_size % 2 = (right(p_brand, 1)::INT % 2)), n AS (SELECT raw_label, row_number() OVER (ORDER BY raw_label) - 1 AS class_id FROM c)
  SELECT class_id::INT AS class_id, raw_label, trim(raw_label) AS display_label, raw_label != trim(raw_label) AS changed FROM n""")
def label_mapping(spark, sf_dir):
    """A list of classes with their numbers, in a file, whose labels have blanks around them."""
    odd = F.substring("p_brand", -1, 1).cast("int") % 2
    some = _part(spark, sf_dir).filter(F.col("p_size") % 2 == odd)
    names = some.select(F.when(odd == 0, F.concat("p_brand", F.lit(" "))).otherwise(F.col("p_brand")).alias("raw")).distinct().groupBy().agg(F.array_sort(F.collect_set("raw")).alias("names"))  # class names
    content = names.select(F.lit("classes.json").alias("name"), F.encode(F.to_json(F.map_from_arrays("names", F.sequence(F.lit(0), F.size("names") - 1))), "utf-8").alias("content"))
    return evaluate.class_table(spark, tables.read_classes(spark, f"{_bundle(content, 'classes')}/classes.json"), "strip")


CHECKPOINT = {
    "state_dict": {"w": 1}, "classes": CLASSES, "synthetic": False,
    "config": {"task": "make", "architecture": "resnet18", "image_size": 224, "preprocessing": "OpenCV whole-crop square resize, RGB, ImageNet mean/std"},
}


def _refusals(spark: SparkSession, sf_dir: str) -> list[tuple[str, bool, object]]:
    """(gate, whether it should refuse, call)."""
    rows = manifest(spark, sf_dir)
    folder = fresh_path(spark, "gates")
    store.write_new(spark, folder, "a.txt", "x")
    context = {f: f for f in gates.FROZEN_FIELDS} | {"code_hashes": {"x.py": "1"}}
    frozen = context | {"schema": "frozen_run/1", "status": "frozen"}
    config = CHECKPOINT["config"]
    proof = {"fresh_process_cpu_reload_passed": True, "predictions_csv_metrics_verified": True, "checkpoint_sha256": "ab"}
    path = fresh_path(spark, "proof")
    spark.createDataFrame([(json.dumps(proof),)], "value string").coalesce(1).write.text(path)
    read = gates.read_json(spark, path)
    score = {"classes": CLASSES, "rows": 5}
    members = rows.select(F.col("doc_id").cast("string").alias("key"), "split")
    listed = rows.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"))
    sample = lambda part, size: gates.require_membership(rows.filter(F.col("split") == part), "doc_id", members, part, size)
    unusable = lambda: evaluate.evaluate(predictions(spark, sf_dir), ["A", "N"])
    quiet = lambda call: gates.verdict(call, out=lambda t: None, err=lambda t: None)

    def code(expected, call):
        if quiet(call) != expected:
            raise RefusedInput("another verdict")

    return [
        ("A2 audit with repeated content", True, lambda: audit.require_clean(audit.manifest_audit(rows, "lang", F.col("sha256")))),
        ("A16 repeated ids", True, lambda: evaluate.check_table(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_orderkey")),
        ("A16 number of rows", True, lambda: evaluate.check_table(predictions(spark, sf_dir), "target", "prediction", None, 1)),
        ("A20 unusable rows", True, unusable),
        ("A22 order of classes", True, lambda: evaluate.evaluate_matrix(spark, CLASSES, _cells(spark, sf_dir), CLASSES[::-1])),
        ("A22 total", True, lambda: evaluate.evaluate_matrix(spark, CLASSES, _cells(spark, sf_dir), CLASSES, 1)),
        ("A23 checkpoint", False, lambda: gates.require_checkpoint(CHECKPOINT)),
        ("A23 checkpoint without configuration", True, lambda: gates.require_checkpoint(CHECKPOINT | {"config": None})),
        ("A24 transform", False, lambda: gates.require_transform(config)),
        ("A24 other size", True, lambda: gates.require_transform(config | {"image_size": 64})),
        ("A24 other network", True, lambda: gates.require_transform(config | {"architecture": "x"})),
        ("A26 split against members", True, lambda: gates.require_membership(rows.filter("split = 'test'"), "doc_id", members, "train")),
        ("A27 sample of train", False, lambda: sample("train", 5)),
        ("A27 sample of test", True, lambda: sample("test", 5)),
        ("A28 frozen record", False, lambda: gates.require_frozen(frozen, context, "frozen_run/1")),
        ("A28 other schema", True, lambda: gates.require_frozen(frozen | {"schema": "x"}, context, "frozen_run/1")),
        ("A28 other label column", True, lambda: gates.require_frozen(frozen | {"label_column": "x"}, context, "frozen_run/1")),
        ("A29 draft", True, lambda: gates.require_frozen(gates.draft_record(context, "frozen_run/1"), context, "frozen_run/1")),
        ("A30 files there", False, lambda: audit.preflight(listed, "path", listed)),
        ("A30 files missing", True, lambda: audit.preflight(listed, "path", listed.limit(1))),
        ("A30 path upwards", True, lambda: audit.preflight(listed.select(F.concat(F.lit("../"), "path").alias("path")), "path", listed)),
        ("A31 accepted with 0", False, lambda: code(0, lambda: gates.intake(CHECKPOINT, "make", "ab", "AB", CLASSES))),
        ("A31 other hash refused with 2", False, lambda: code(2, lambda: gates.intake(CHECKPOINT, "make", "ab", "cd"))),
        ("A31 other error with 1", False, lambda: code(1, lambda: {}["x"])),
        ("A31 synthetic", True, lambda: gates.intake(CHECKPOINT | {"synthetic": True}, "make", "ab")),
        ("A32 proof", False, lambda: gates.require_proof(read, "ab", score, score)),
        ("A32 changed checkpoint", True, lambda: gates.require_proof(read, "cd", score, score)),
        ("A32 other rows", True, lambda: gates.require_proof(read, "ab", score, score | {"rows": 4})),
        ("K3 NaN", True, lambda: tables.strict_json({"a": float("nan")})),
        ("K5 folder in use", True, lambda: store.fresh_folder(spark, folder)),
        ("K6 file in use", True, lambda: store.write_new(spark, folder, "a.txt", "y")),
        ("K6 out of the folder", True, lambda: store.write_new(spark, folder, "../a.txt", "y")),
        ("M10 fraction", True, lambda: tables.checked_count(0.5)),
        ("M10 whole number", False, lambda: tables.checked_count(1.0)),
        ("N6 failure told with 2", False, lambda: code(2, unusable)),
        ("N8 snapshot into a folder in use", True, lambda: gates.source_snapshot(spark, [__file__], folder)),
    ]


_TOLD = [
    ("A2 audit with repeated content", True), ("A16 repeated ids", True), ("A16 number of rows", True), ("A20 unusable rows", True), ("A22 order of classes", True), ("A22 total", True), ("A23 checkpoint", False),
    ("A23 checkpoint without configuration", True), ("A24 transform", False), ("A24 other size", True), ("A24 other network", True), ("A26 split against members", True), ("A27 sample of train", False), ("A27 sample of test", True),
    ("A28 frozen record", False), ("A28 other schema", True), ("A28 other label column", True), ("A29 draft", True), ("A30 files there", False), ("A30 files missing", True), ("A30 path upwards", True), ("A31 accepted with 0", False),
    ("A31 other hash refused with 2", False), ("A31 other error with 1", False), ("A31 synthetic", True), ("A32 proof", False), ("A32 changed checkpoint", True), ("A32 other rows", True), ("K3 NaN", True), ("K5 folder in use", True),
    ("K6 file in use", True), ("K6 out of the folder", True), ("M10 fraction", True), ("M10 whole number", False), ("N6 failure told with 2", False), ("N8 snapshot into a folder in use", True),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{gate}', {str(refused).lower()})" for gate, refused in _TOLD) + ") t(gate, refused)")
def gate_refusals(spark, sf_dir):
    """What each gate says of a good and a bad input."""
    found = []
    for gate, _, call in _refusals(spark, sf_dir):
        try:
            call()
            found.append((gate, False))
        except RefusedInput:
            found.append((gate, True))
    return spark.createDataFrame(found, "gate string, refused boolean")
