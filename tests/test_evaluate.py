import json

import pytest

from tabulon.errors import RefusedInput, UnusableRows
from tabulon.operators import evaluate as E
from tabulon.sources import tables


def rows(spark, pairs):
    return spark.createDataFrame([(f"s{k}", t, p) for k, (t, p) in enumerate(pairs)], "sample_id string, target string, prediction string")


def summary(found):
    return found["summary"].first()


def test_never_predicted_class(spark):
    told = summary(E.evaluate(rows(spark, [("a", "a"), ("a", "a"), ("b", "b"), ("c", "a")]), ["a", "b", "c"]))
    assert told.accuracy == 0.75 and told.macro_f1 == pytest.approx((0.8 + 1 + 0) / 3, abs=1e-12) and told.classes_never_predicted == ["c"]


def test_zero_support_class(spark):
    told = summary(E.evaluate(rows(spark, [("a", "a"), ("a", "b"), ("b", "b")]), ["a", "b", "c"]))
    assert told.classes_with_zero_support == ["c"] and told.macro_f1 == pytest.approx(2 / 3 * 2 / 3) and told.macro_f1_excluding_zero_support == pytest.approx(2 / 3)


def test_reasons_and_their_order(spark):
    bad = [("z", "a"), (None, "a"), ("unknown", "not_assessed"), ("N/A", "a "), ("a", "a")]
    with pytest.raises(UnusableRows) as error:
        E.evaluate(rows(spark, bad), ["a", "unknown"])
    assert sum(error.value.reasons.values()) == 4
    told = {r.sample_id: r.reason for r in E.evaluate(rows(spark, bad), ["a", "unknown"], allow_unusable=True, id_column="sample_id")["excluded"].collect()}
    assert told["s1"] == "missing target label"
    assert told["s2"] == "reserved target token 'unknown'; reserved prediction token 'not_assessed'"  # even as a declared class
    assert told["s3"] == "missing target label; prediction label 'a ' outside the declared class list"


def test_refusals(spark):
    with pytest.raises(RefusedInput):
        E.evaluate(rows(spark, [("a", "a")]).limit(0), ["a"])
    with pytest.raises(RefusedInput):
        E.evaluate(rows(spark, [("a", "a")]), ["a"], expected_rows=2)
    with pytest.raises(RefusedInput):
        E.evaluate(rows(spark, [("a", "a")]), ["a"], target="absent")
    twice = rows(spark, [("a", "a")]).union(rows(spark, [("a", "a")]))
    with pytest.raises(RefusedInput):
        E.evaluate(twice, ["a"], id_column="sample_id")
    with pytest.raises(RefusedInput):
        E.evaluate(rows(spark, [("z", "z")]), ["a"], allow_unusable=True)
    for classes in ([], ["a", "a"], ["a", " "], ["x", 1]):
        with pytest.raises(RefusedInput):
            E.class_table(spark, classes)


def test_all_unusable_rows_are_counted(spark):
    with pytest.raises(UnusableRows) as error:
        E.evaluate(rows(spark, [(f"z{k}", "a") for k in range(1500)] + [("a", "a")]), ["a"])
    assert error.value.rows == 1500 and str(error.value).startswith("1500 rows") and len(error.value.reasons) == 1000


def test_names_of_the_classification(spark):
    with pytest.raises(RefusedInput):
        E.evaluate(rows(spark, [("a", "a")]).selectExpr("*", "1 as Reason"), ["a"])


def test_adapters(spark):
    classes = ["Hyundai ", "Lamorghini ", "Honda"]
    pairs = [("Hyundai ", "Hyundai "), ("Honda", "Lamorghini ")]
    assert summary(E.evaluate(rows(spark, pairs), classes)).rows == 2
    assert [r.display_label for r in E.class_table(spark, classes, "strip").orderBy("class_id").collect()] == ["Hyundai", "Lamorghini", "Honda"]
    with pytest.raises(RefusedInput):
        E.class_table(spark, ["a", "a "], "strip")
    with pytest.raises(RefusedInput):
        E.evaluate(rows(spark, [("Honda", "Honda"), ("Honda ", "Honda")]), classes, adapter="strip")
    with pytest.raises(RefusedInput):
        E.class_table(spark, ["a"], "upper")


def test_class_lists():
    assert tables.class_list({"b": 1, "a": 0}) == ["a", "b"] and tables.class_list(["x", "y"]) == ["x", "y"]
    for bad in ({}, [], {"a": 0, "b": 2}, {"a": 0.0}, {"a": True}, {"a": "0"}, ["a", "a"], ["a", ""], "a", None):
        with pytest.raises(RefusedInput):
            tables.class_list(bad)


def test_counts():
    assert tables.checked_count(1.0) == 1 and tables.checked_count(2**63 - 1) == 2**63 - 1
    for bad in (True, 0.5, -1, float("nan"), float("inf"), "1", None, 2**63):
        with pytest.raises(RefusedInput):
            tables.checked_count(bad)


COLOURS = ["black", "blue", "brown", "champagne", "green", "purple", "red", "silver", "white", "yellow"]
# a published matrix, retyped
MATRIX = [
    [25, 1, 8, 0, 1, 2, 2, 1, 0, 0], [3, 33, 2, 0, 0, 0, 0, 2, 0, 0], [1, 1, 35, 0, 1, 0, 1, 1, 0, 0], [2, 1, 7, 21, 0, 0, 0, 7, 0, 2], [3, 2, 4, 0, 24, 0, 0, 1, 0, 0],
    [2, 0, 3, 0, 0, 26, 0, 1, 0, 0], [1, 0, 4, 0, 0, 1, 34, 0, 0, 0], [2, 5, 3, 2, 0, 0, 1, 25, 1, 1], [0, 0, 0, 1, 0, 0, 0, 1, 38, 0], [0, 2, 8, 3, 1, 0, 4, 2, 1, 19],
]


def test_golden_matrix(spark, tmp_path):
    classes = E.class_table(spark, COLOURS)
    cells = tables.matrix_cells(spark, COLOURS, MATRIX)
    told = E.summary(E.per_class(cells, classes)).first()
    assert (told.correct, told.rows) == (280, 386)
    assert told.macro_f1 == pytest.approx(0.7299082471403191, abs=1e-12) and told.weighted_f1 == pytest.approx(0.7264826819937054, abs=1e-12)
    assert told.macro_precision == pytest.approx(0.7643466608857694, abs=1e-12) and told.macro_recall == pytest.approx(0.7268382352941176, abs=1e-12)
    assert E.cross_check(cells, classes)["passed"]
    tables.write_csv(E_layout := tables.matrix_table(cells, classes), str(tmp_path / "m"), single=True)
    file = next((tmp_path / "m").glob("*.csv"))
    names, back = tables.read_matrix(spark, str(file))
    assert names == COLOURS and sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect())) and E_layout.columns[0] == "target"
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"classes": COLOURS, "confusion_matrix": MATRIX}))
    assert tables.read_matrix(spark, str(path))[0] == COLOURS
    for bad in ([[1]], [[1, 2], [3]], [[0] * 10] * 10):
        with pytest.raises(RefusedInput):
            tables.matrix_cells(spark, COLOURS, bad)


def test_report(spark, tmp_path):
    from tabulon.sources import report

    found = E.evaluate(rows(spark, [("a", "a"), ("a", "b"), ("z", "b")]), ["a", "b"], allow_unusable=True)
    report.write_report(found, str(tmp_path / "out"), {"task": "make", "seed": 1})
    folder = tmp_path / "out"
    assert json.loads((folder / "metrics.json").read_text())["accuracy"] == 0.5
    assert sorted(p.name for p in folder.iterdir()) == ["README.md", "environment.json", "excluded", "mapping.csv", "matrix.csv", "metrics.json", "per_class.csv", "run_log.txt", "warnings.json"]
    assert sorted(p.read_text() for p in (folder / "excluded").iterdir())[-1].startswith("target,prediction,reason\nz,b,")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    with pytest.raises(RefusedInput):
        report.write_report(found, str(tmp_path / "out"), {})
    report.require_confirmed("latest")
    report.require_confirmed("Official-Test", confirmed=True)
    with pytest.raises(RefusedInput):
        report.require_confirmed("Official_Test")
    (tmp_path / "c.json").write_text('{"seed": 1}')
    assert report.read_config(str(tmp_path / "c.json")) == {"seed": 1}
