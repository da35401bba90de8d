import hashlib
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.errors import RefusedInput
from tabulon.functions import boxes, labels, matching, paths, stats
from tabulon.operators import audit, gates, runs, scoring, split
from tabulon.plans import catalogue
from tabulon.sources import manifests, tables, zip_index


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_labels(spark):
    df = spark.createDataFrame([(None,), ("",), (" NaN ",), ("n/a",), ("none",), ("  ",), ("A ",)], "v string")
    assert [r[0] for r in df.select(labels.raw_label(F.col("v"))).collect()] == [None, None, None, None, "none", "  ", "A "]
    assert one(spark, labels.split_name(F.lit("Official-Test é"))) == "officialtesté" and one(spark, labels.ascii_split_name(F.lit(" Official_Test é"))) == "officialtest"
    assert one(spark, labels.is_guarded(F.lit("Final test"))) and not one(spark, labels.is_guarded(F.lit("latest")))
    assert one(spark, labels.csv_value(F.lit("None"))) is None and one(spark, labels.csv_value(F.lit(" "))) == " "


@pytest.mark.parametrize(
    "truth, said, make, expected",
    [("Audi Q5", "Q5", "Audi", True), ("AVEO hatchback", "Aveo", None, True), ("SUV", "", None, False), ("Q5", "Q7", None, False), ("Q5", None, None, False), ("suv", "suv", None, True), (None, "a", None, False)],
)
def test_models(spark, truth, said, make, expected):
    c = lambda v: F.lit(v).cast("string")
    assert one(spark, matching.model_matches(c(truth), c(said), None if make is None else c(make))) is expected


def test_matching(spark):
    assert one(spark, matching.make_matches(F.lit("BWM"), F.lit("BMW"))) and not one(spark, matching.make_matches(F.lit("BMW"), F.lit(None).cast("string")))
    assert one(spark, matching.body_matches(F.lit("estate"), F.lit("Station Wagon")))
    assert one(spark, matching.colour_matches(F.lit("Silver"), F.lit("grey and white"))) and not one(spark, matching.colour_matches(F.lit(""), F.lit("red")))
    assert one(spark, matching.make_matches(F.lit("Citroën"), F.lit("citroen"))) and one(spark, matching.make_matches(F.lit("Skoda"), F.lit("Škoda"))) and one(spark, matching.model_matches(F.lit("Mégane"), F.lit("MEGANE")))
    assert one(spark, matching.folded_key(F.lit("Citroën É5"))) == "citroene5" and one(spark, matching.folded_key(F.lit("中"))) is None
    assert one(spark, matching.clean_model(F.lit("BWM 5 Series GT"), F.lit("BWM"))) == "5 Series GT" and one(spark, matching.clean_model(F.lit("Audi"), F.lit("Audi"))) == "Audi"
    assert one(spark, matching.clean_model(F.lit("AVEO couple"), F.lit("x"))) == "AVEO" and one(spark, matching.clean_make(F.lit(" Buck "))) == "Buick"


def test_folded_keys_are_those_of_the_decomposition(spark):
    import unicodedata

    texts = [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x1D400, 0x1D800)] + ["ﬁat ½ Ⅷ ㎏", "e\u0301a\u030a", "ΑΒΓ", "ǅ", "İi", "K"]
    found = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", matching.folded_key(F.col("t")).alias("key")).collect()
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower() if c.isalnum()) or None
    assert [(texts[r.k], r.key) for r in found if r.key != plain(texts[r.k])] == []


def test_folded_keys_of_long_texts(spark):
    """Characters that become several, next to each other and in long texts; folding takes about as long as the plain key, not a step for each known character."""
    import time
    import unicodedata

    several = list(matching._folds()[2])
    texts = ["".join(several), "a".join(several), " é".join(several) + "z", "".join(f"{c}\U0001d400" for c in several), "½", "x½", "½x", "\U0001f12d\U0001f12d", "™ and ™"]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower() if c.isalnum()) or None
    found = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", matching.folded_key(F.col("t")).alias("key")).collect()
    assert {r.k: r.key for r in found} == {k: plain(t) for k, t in enumerate(texts)}
    long = spark.range(24).select(F.concat(F.when(F.col("id") % 2 == 0, "é").otherwise("™ é"), F.repeat(F.lit("some words of 3 parts "), F.lit(20_000))).alias("t")).persist()
    long.count()

    def took(key):
        begin = time.perf_counter()
        assert long.groupBy().agg(F.sum(F.length(key(F.col("t"))))).first()[0] > 0
        return time.perf_counter() - begin

    took(matching.folded_key)  # warm
    assert min(took(matching.folded_key) for _ in range(2)) < 12 * max(took(matching.ascii_key), 0.2)


def test_split_without_keys_or_with_odd_names(spark):
    """Rows of null keys and classes stay, equal rows too, and columns may have any name."""
    rows = [(k if k % 20 else None, "train" if k % 4 else "test", "a" if k % 3 else None, k) for k in range(200)] + [(None, "train", "a", 5)] * 3
    df = spark.createDataFrame(rows, "k long, split string, label string, row int").withColumnsRenamed({}).selectExpr("k", "split", "label", "row", "1 AS chosen", "2 AS _n", "3 AS _hash", "4 AS _rank", "5 AS _bucket", "6 AS `of`", "7 AS `a.b`")
    got = split.stratified_split(df, "label", 0.25, 3, "k")
    assert got.columns == [*df.columns, "experiment_split"] and got.drop("experiment_split").exceptAll(df).count() == 0 and got.count() == len(rows)
    for label in ("a", None):
        n = sum(r[1] == "train" and r[2] == label for r in rows)
        assert got.filter(F.col("label").eqNullSafe(F.lit(label)) & (F.col("experiment_split") == "validation")).count() == max(1, int(n * 0.25 + 0.5))
    again = split.stratified_split(df.repartition(7), "label", 0.25, 3, "k")
    assert again.exceptAll(got).count() == 0
    groups = split.group_split(df.filter("k IS NOT NULL").withColumn("g", F.concat(F.col("split"), (F.col("k") % 9).cast("string"))), "g", 0.3, 1)
    assert groups.count() == df.filter("k IS NOT NULL").count() and groups.filter("experiment_split = 'validation'").select("g").distinct().count() == 3
    with pytest.raises(RefusedInput):
        split.stratified_split(df.withColumn("experiment_split", F.lit(1)), "label", 0.25, 3, "k")


def test_first_by_hash(spark):
    rows = [(k, "big" if k % 3 else "small", None) for k in range(4000)]
    df = spark.createDataFrame(rows, "k long, label string, _b string")
    got = split.first_by_hash(df.drop("_b"), ["label"], 5, "k", F.round(F.col("_n") * 0.3)).collect()
    for label in ("big", "small"):
        own = sorted((hashlib.sha256(f"5|{r[0]}".encode()).hexdigest(), r[0]) for r in rows if r[1] == label)
        assert {r.k for r in got if r.label == label and r.chosen} == {k for _, k in own[: round(len(own) * 0.3)]}
    assert len(got) == 4000


def test_positions(spark):
    from tabulon.operators.evaluate import with_position

    df = spark.range(1000).repartition(7)
    assert [r.row_position for r in with_position(df, ["id"]).orderBy("id").collect()] == list(range(1000))
    assert sorted(r.row_position for r in with_position(df).collect()) == list(range(1000)) and with_position(df.limit(0), ["id"]).count() == 0


def test_boxes(spark):
    box = lambda t: one(spark, boxes.parsed(F.lit(t)))
    assert tuple(box("(0.5, 1.5, 10, 2.5)")) == (0, 2, 10, 2)
    assert [box(t) for t in ("(3, 1, 2, 2)", "(1, 2, 3)", "(-1, 0, 2, 2)", "(1, NaN, 2, 2)", "x", None)] == [None] * 6
    assert [one(spark, boxes.official(boxes.numbers(F.lit(t)))) for t in ("(0, 1, 10, 10)", "(1, 2, 3)", "(1.5, 1, 10, 10)", "(1, 2, 12, 13)")] == [False, False, False, True]
    assert tuple(one(spark, boxes.zero_based(boxes.numbers(F.lit("(1, 2, 12, 13)"))))) == (0, 1, 12, 13)
    inside = F.struct(*[F.lit(v).alias(n) for v, n in zip((20, 20, 60, 60), ("x1", "y1", "x2", "y2"))])
    assert tuple(one(spark, boxes.padded(inside, F.lit(100), F.lit(80)))) == (14, 14, 66, 66)
    assert one(spark, boxes.clamped(F.array(F.lit(200.0), F.lit(0.0), F.lit(300.0), F.lit(9.0)), F.lit(100), F.lit(80))) is None


def test_paths_and_stats(spark):
    assert one(spark, paths.relative_key(F.lit("a\\1\\2\\2009\\x.jpg"))) == "1/2/2009/x.jpg" and one(spark, paths.relative_key(F.lit("1/2/unknown/x.jpg"))) is None
    assert one(spark, paths.remapped(F.lit("../../r/image/1/x.jpg"), "../../r/", "image/", "d/")).image_path == "d/image/1/x.jpg"
    assert one(spark, paths.remapped(F.lit("../../r/image/../x.jpg"), "../../r/", "image/", "d/")) is None
    assert one(spark, paths.json_in(F.lit('so {"a": {"b": 1}} !'))) == '{"a": {"b": 1}}' and one(spark, paths.json_in(F.lit("no"))) is None
    low, high = (one(spark, c) for c in stats.wilson(F.lit(8), F.lit(10)))
    assert (round(low, 4), round(high, 4)) == (0.4902, 0.9433)
    assert np.isnan(one(spark, stats.wilson(F.lit(0), F.lit(0))[0]))


def manifest(spark):
    rows = [(f"{lab}{k}", f"h{lab}{k}", lab, "test" if k >= 18 else "train") for lab in "ab" for k in range(20)]
    return spark.createDataFrame([*rows, ("dup", "ha19", "a", "train")], "relative_key string, sha256 string, make_name string, split string")


def test_capped_split(spark):
    df = manifest(spark)
    got = split.capped_split(df, "make_name", 10, 7).toPandas()
    assert (got.experiment_split == "train").sum() == 16 and (got.experiment_split == "validation").sum() == 4 and "ha19" not in set(got.sha256) and got.sha256.is_unique
    again = split.capped_split(df.repartition(7), "make_name", 10, 7).toPandas()
    assert set(map(tuple, got.values)) == set(map(tuple, again.values))
    split.require_two_each(df, spark.createDataFrame(got), "make_name")
    with pytest.raises(RefusedInput):
        split.require_two_each(df, spark.createDataFrame(got).filter("make_name = 'a'"), "make_name")


def test_other_splits(spark):
    df = manifest(spark).withColumn("group", F.substring("relative_key", 2, 1))
    got = split.stratified_split(df, "make_name", 0.25, 1, "relative_key")
    split.require_coverage(got, "make_name")
    assert got.filter("experiment_split = 'test'").count() == 4
    with pytest.raises(RefusedInput):
        split.group_split(df, "group", 0.5, 1)  # groups 1 are in train and test
    free = df.withColumn("group", F.concat("split", F.col("group")))
    got = split.group_split(free, "group", 0.4, 1)
    both = got.filter("split = 'train'").groupBy("group").agg(F.countDistinct("experiment_split").alias("n"))
    assert both.filter("n > 1").isEmpty() and not got.filter("experiment_split = 'validation'").isEmpty()


def test_frozen_split(spark):
    official = manifest(spark).filter("relative_key != 'dup'")
    frame = official.filter("split = 'train'").withColumn("experiment_split", F.when(F.col("relative_key").isin("a1", "b1"), "validation").otherwise("train"))
    tests = official.filter("split = 'test'")
    check = lambda f: {r.rule for r in audit.frozen_split(f, official, "make_name", tests, ["split", "make_name", "sha256"]).collect()}
    assert check(frame) == set()
    tampered = F.when(F.col("relative_key") == "a2", "ha19").otherwise(F.col("sha256"))
    assert check(frame.withColumn("sha256", tampered)) == {"content of the official test", "differs from the manifest"}
    assert check(frame.union(frame.limit(1))) == {"repeated key", "repeated content"}
    assert "class in one part only" in check(frame.filter("relative_key != 'b1'"))


def test_manifest_audit(spark):
    df = manifest(spark).withColumn("bbox", F.when(F.col("relative_key") == "a1", "(1, 2)").otherwise("(1, 2, 3, 4)"))
    row = audit.manifest_audit(df, "make_name", F.col("sha256"), box="bbox").first()
    assert (row.rows, row.classes, row.invalid_bbox_rows, row.duplicate_path_rows, row.train_test_path_overlap) == (41, 2, 1, 1, 1)
    with pytest.raises(RefusedInput):
        audit.require_clean(audit.manifest_audit(df, "make_name", F.col("sha256"), box="bbox"))


def test_body_labels(spark):
    frame = spark.createDataFrame([(1, "convertible"), (2, "convertible"), (3, "x")], "model_id int, car_type_name string")
    attributes = spark.createDataFrame([(1, 0), (2, 12)], "model_id int, type int")
    names = spark.createDataFrame([(12, "convertible")], "id int, name string")
    assert {r.model_id: r.status for r in audit.body_eligibility(frame, attributes, names).collect()} == {1: "unavailable", 2: "valid", 3: "unknown model"}
    truth = [(0, None, None, True), (0, "a", None, False), (1, "a", "a", True), (1, "b", "a", False), (9, "a", None, False)]
    df = spark.createDataFrame([t[:3] for t in truth], "i int, label string, name string")
    assert [r[0] for r in df.select(audit.body_label_matches(F.col("i"), F.col("label"), F.col("name"))).collect()] == [t[3] for t in truth]


def test_membership(spark, tmp_path):
    lists = []
    for name, keys in (("train", "a\n b \n\n"), ("test", "c\n")):
        (tmp_path / name).write_text(keys)
        lists.append({"split": name, "path": str(tmp_path / name), "sha256": hashlib.sha256(keys.encode()).hexdigest()})
    good = {"dataset": "d", "version": "1", "key_format": "k", "provenance": "p", "lists": lists}
    members = gates.load_membership(spark, good, "d")
    rows = spark.createDataFrame([("a",), ("b",)], "key string")
    assert gates.require_membership(rows, "key", members, "Train") == {"train": 2, "test": 0}
    for bad_rows, name, size in ((rows, "test", None), (rows, "other", None), (rows.union(spark.createDataFrame([("z",)])), "train", None), (spark.createDataFrame([("c",)], "key string"), "test", 1), (rows, "train", 9)):
        with pytest.raises(RefusedInput):
            gates.require_membership(bad_rows, "key", members, name, size)
    for change in ({"dataset": "e"}, {"version": ""}, {"lists": [lists[0] | {"split": " test"}]}, {"lists": [lists[0], lists[0]]}, {"lists": [lists[0] | {"sha256": "0" * 64}]}):
        with pytest.raises(RefusedInput):
            gates.load_membership(spark, good | change, "d")
    (tmp_path / "test").write_text("a\n")
    lists[1]["sha256"] = hashlib.sha256(b"a\n").hexdigest()
    with pytest.raises(RefusedInput):
        gates.load_membership(spark, good, "d")


def test_freeze_records():
    context = {f: f for f in gates.FROZEN_FIELDS} | {"code_hashes": {"x.py": "1"}}
    frozen = context | {"schema": "run/1", "status": "frozen"}
    gates.require_frozen(frozen, context, "run/1")
    assert len(gates.FROZEN_FIELDS) == 17
    bad_hashes = ({}, {"x.py": "2"}, {"x.py": "1", "y.py": "1"}, None)
    for bad in (gates.draft_record(context, "run/1"), frozen | {"seed": 2}, *(frozen | {"code_hashes": h} for h in bad_hashes), {"status": "frozen"}, frozen | {"schema": "v2"}, [], *({k: v for k, v in frozen.items() if k != f} for f in gates.FROZEN_FIELDS)):
        with pytest.raises(RefusedInput):
            gates.require_frozen(bad, context, "run/1")


def test_digests(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "key string, label string")
    digest = gates.rows_digest(df, "key", "label")
    assert digest == gates.rows_digest(df.repartition(3).orderBy(F.desc("key")), "key", "label") != gates.rows_digest(df.filter("key != 'c'"), "key", "label")
    assert gates.ordered_rows_digest([["b"], ["a"]]) == gates.ordered_rows_digest([["a"], ["b"]])


def test_strict_json():
    with pytest.raises(RefusedInput):
        tables.strict_json({"a": float("nan")})


def test_retry():
    waits, calls = [], iter([ValueError("429 too many"), ValueError("Service Unavailable"), None])

    def call():
        if error := next(calls):
            raise error
        return 5

    assert gates.with_retry(call, sleep=waits.append) == 5 and waits == [5.0, 10.0]
    with pytest.raises(KeyError):
        gates.with_retry(lambda: {}["x"], sleep=waits.append)  # such an error doesn't pass
    assert len(waits) == 2


def test_zip_index(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/é.txt", b"hello")
        z.writestr("d/", b"")
        z.writestr("b.bin", b"\0" * 1000)
    spark.dataSource.register(zip_index.ZipIndex)
    got = spark.read.format("zip_index").option("paths", str(tmp_path / "a.zip")).load()
    assert {(r.name, r.expected_bytes, r.expected_crc32) for r in got.collect()} == {("d/é.txt", 5, zlib.crc32(b"hello")), ("b.bin", 1000, zlib.crc32(b"\0" * 1000))}
    for name in ("/x", "../x", "a/../../x", "c:x", "a\\x", "a/.."):
        with pytest.raises(RefusedInput):
            zip_index.safe_name(name)
    (tmp_path / "no.zip").write_bytes(struct.pack("<4s", b"none"))
    with open(tmp_path / "no.zip", "rb") as f, pytest.raises(RefusedInput):
        list(zip_index.members(f))
    with open(tmp_path / "a.zip", "rb") as f:
        assert list(zip_index.first_members(f, 1)) == [("d/é.txt", b"hello")]
    whole = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "comment.zip").write_bytes(whole[:-2] + struct.pack("<H", 28) + b"PK\x05\x06 not the end" + b"x" * 12)
    with open(tmp_path / "comment.zip", "rb") as f:
        assert len(list(zip_index.members(f))) == 2
    at = whole.rindex(b"PK\x05\x06")
    for k, v in ((4, 1), (10, 9), (12, 5)):  # another disk, other numbers of members and bytes
        (tmp_path / "bad.zip").write_bytes(whole[: at + k] + struct.pack("<H", v) + whole[at + k + 2 :])
        with open(tmp_path / "bad.zip", "rb") as f, pytest.raises(RefusedInput):
            list(zip_index.members(f))
    files = spark.createDataFrame([("b.bin", bytearray(1000)), ("d/é.txt", bytearray(b"hallo"))], "name string, content binary")
    listed = got.unionByName(spark.createDataFrame([("a", "lost", 1, 1)], got.schema))
    assert {r.name: r.status for r in audit.integrity(listed, files).collect()} == {"b.bin": "ok", "d/é.txt": "mismatch", "lost": "missing"}


def test_colours(spark):
    solid = lambda *rgb: np.full((40, 40, 3), rgb, dtype=np.uint8)
    seen = [scoring.estimate_colour(solid(*c))["label"] for c in ((255, 0, 0), (0, 0, 255), (10, 10, 10), (250, 250, 250), (128, 128, 128), (0, 200, 0), (255, 255, 0))]
    assert seen == ["red", "blue", "black", "white", "grey", "green", "yellow"]
    assert scoring.estimate_colour(solid(1, 2, 3)[:5, :5])["status"] == "insufficient_pixels"
    df = spark.createDataFrame([(bytearray(b"P6\n40 40\n255\n" + solid(255, 0, 0).tobytes()),), (bytearray(b"junk"),)], "content binary")
    got = [r.colour for r in scoring.colours(df).collect()]
    assert got[0].label == "red" and got[0].class_distribution == {"red": 1.0} and got[1].status == "error" and got[1].error
    seen = scoring.inspect_images(df.withColumn("bbox", F.lit("(1, 1, 41, 40)")), box="bbox").select("image.*").collect()
    assert [(r.status, r.width) for r in seen] == [("error", 40), ("error", None)]


def test_colours_of_many_images(spark, monkeypatch, tmp_path):
    """Images that are classed together get what each gets alone, broken ones between them too; small files are dealt out before they are worked on."""
    rng = np.random.default_rng(5)
    images = [rng.integers(0, 256, (rng.integers(8, 40), rng.integers(8, 40), 3), dtype=np.uint8) // np.uint8(rng.choice([1, 64])) for _ in range(60)] + [np.full((40, 40, 3), 128, dtype=np.uint8)]
    ppm = [b"P6\n%d %d\n255\n" % (i.shape[1], i.shape[0]) + i.tobytes() for i in images]
    rows = [(k, bytearray(b"junk") if k % 7 == 3 else bytearray(p)) for k, p in enumerate(ppm)]
    got = {r.k: r.colour for r in scoring.colours(spark.createDataFrame(rows, "k int, content binary").coalesce(1)).collect()}
    for k, image in enumerate(images):
        if k % 7 == 3:
            assert got[k].status == "error" and got[k].error and got[k].evaluated_pixels == 0
            continue
        rules = scoring.ColourRules()
        pixels = image[int(len(image) * rules.top) : int(len(image) * rules.bottom), int(image.shape[1] * rules.left) : int(image.shape[1] * rules.right)].reshape(-1, 3)
        names, table = scoring.colour_table(rules)
        each = [names[n] for n in table[tuple(scoring.hsv(pixels).T)]]  # pixel by pixel
        shares = {n: round(each.count(n) / len(each), 6) for n in sorted(set(each))} if len(each) >= 100 else {}
        assert got[k].evaluated_pixels == len(pixels) and got[k].class_distribution == shares and got[k].error == "" and scoring.estimate_colour(image)["class_distribution"] == shares
        assert got[k].label == (max(shares, key=shares.get) if shares else None)
    calls = []
    monkeypatch.setattr(scoring, "hsv", lambda c, f=scoring.hsv: calls.append(len(c)) or f(c))
    middles = [scoring._middle(i, scoring.ColourRules()) for i in images]
    assert len(scoring._estimates(middles, scoring.ColourRules())) == 61 and calls == [sum(len(m[1]) for m in middles)]
    spark.range(10_000).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    tasks = catalogue.queries()["hsv_colour"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert [r["count"] for r in tasks] == [2500] * 4


def test_predictors(spark):
    def load():
        def call(values):
            if "bad" in values:
                raise ValueError("no such image")
            return [(v.upper(), 0.5) for v in values]

        return call

    p = scoring.Predictor("make", load)
    got = scoring.score(spark.createDataFrame([("a",), ("bad",), ("b",)], "v string").coalesce(1), "v", p).collect()
    assert [(r.scored.label, r.scored.status) for r in got] == [("A", "predicted"), (None, "failed"), ("B", "predicted")]
    assert scoring.registry({"make": p})
    calls = spark.sparkContext.accumulator(0)

    def counted():
        calls.add(1)
        return lambda values: [(v, 1.0) for v in values]

    many = spark.range(600).selectExpr("string(id) as v").repartition(12)
    several = [scoring.Predictor("make", counted, version=str(k)) for k in range(2)]
    for q in several:
        assert scoring.score(many, "v", q).select("scored.label").distinct().count() == 600
    assert 2 <= calls.value <= 2 * 4 * 2  # once a worker, not once for each of 24 tasks (a worker may be started anew)
    assert scoring.Predictor("make", load).version != scoring.Predictor("make", counted, transform=str).version
    for bad in ({"model": p}, {"wheels": scoring.Predictor("wheels", load)}):
        with pytest.raises(RefusedInput):
            scoring.registry(bad)

    def client(v):
        if v == "bad":
            raise RuntimeError("down")
        return {"make": v}, {"prompt": 3, "output": 1}

    log = scoring.remote(spark.createDataFrame([("a",), ("bad",)], "v string"), "v", client, ["make"], retries=1).orderBy("image").collect()
    assert [(r.error, r.prompt_tokens, r.make_pred) for r in log] == [("", 3, "a"), ("RuntimeError: down", 0, None)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('image,label,n\nx,"Hyundai ",1\ny,NA,2\nz,None,bad\nw,"a,""b""",\n')
    got = tables.read_csv(spark, str(tmp_path / "a.csv"), "image string, label string, n int").orderBy("image").collect()
    assert [tuple(r) for r in got] == [("w", 'a,"b"', None), ("x", "Hyundai ", 1), ("y", None, 2), ("z", None, None)]
    (tmp_path / "attr.txt").write_text("model_id  type doors\n1 0 4\n 2   12 2\n")
    assert {(r.model_id, r.type) for r in tables.read_columns(spark, str(tmp_path / "attr.txt")).collect()} == {("1", "0"), ("2", "12")}
    for key in ("78/1/2009/a", "78/1/unknown/b"):
        for root, ext in (("image", "jpg"), ("label", "txt")):
            path = tmp_path / root / f"{key}.{ext}"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text("1\n2\n3 4 50 60\n")
    attributes = tables.read_columns(spark, str(tmp_path / "attr.txt"))
    found = manifests.web_manifest(manifests.listing(spark, str(tmp_path / "image"), "*.jpg"), tables.read_label_files(spark, str(tmp_path / "label")), attributes).collect()
    assert {(r.make_id, r.model_id, r.year, tuple(r.bbox), r.viewpoint, r.type) for r in found} == {("78", 1, "2009", (3, 4, 50, 60), 1, 0), ("78", 1, "unknown", (3, 4, 50, 60), 1, 0)}
    files = spark.createDataFrame([("x/sv/1/a.jpg",), ("x/sv/2/b.jpg",)], "path string")
    colours = spark.createDataFrame([("1/a.jpg", 9)], "relative_key string, color_id int")
    names = spark.createDataFrame([(1, "BMW", "X1", 5)], "surveillance_model_id int, make_name string, model_name string, web_nature_model_id int")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    sv = {r.image_path[-5:]: r for r in manifests.surveillance_manifest(files, colours, names, keys("1/a.jpg"), keys("1/a.jpg", "2/b.jpg")).collect()}
    assert (sv["a.jpg"].split, sv["a.jpg"].color_name, sv["b.jpg"].split, sv["b.jpg"].make_name) == ("train", "silver", "test", None)


def test_run_collection(spark, tmp_path):
    (tmp_path / "a.csv").write_text("image,error,prompt_tokens,output_tokens\nx,,10,2\n")
    found, missing = runs.collect_runs(spark, [{"label": "one", "file": "a.csv", "kind": "tuned"}, {"label": "two", "file": "b.csv", "kind": "raw"}], str(tmp_path))
    assert missing == ["two"] and [(r.run, r.kind, r.error) for r in found.collect()] == [("one", "tuned", None)]


def test_running_best(spark):
    history = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.7), (4, 0.6)], "epoch int, validation_macro_f1 double")
    assert [r.improved for r in split.running_best(history).orderBy("epoch").collect()] == [True, False, True, False] and split.best_epoch(history).first().epoch == 3


def test_streaming(spark, tmp_path):
    from tabulon.operators.evaluate import class_table
    from tabulon.streaming.predictions import arriving, report

    schema = "target string, prediction string"
    spark.createDataFrame([("a", "a"), ("b", "a"), ("z", "a")], schema).write.parquet(str(tmp_path / "in"))
    query = report(arriving(spark, str(tmp_path / "in"), schema), class_table(spark, ["a", "b"]), "target", "prediction", str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    query.awaitTermination(120)
    assert {r["class"]: r.support for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a": 1, "b": 1}


def test_answerable():
    assert scoring.answerable(["make", "colour"], "tuned") == ["make"] and scoring.answerable(["colour"], "raw") == ["colour"]
    assert all(b in scoring.PROMPTS["constrained"] for b in scoring.BODY_TYPES)
    with pytest.raises(RefusedInput):
        scoring.answerable(["colour"], "tuned")
