"""Exact quantiles against numpy, through many rounds of a coarse sketch."""

import math
import random

import numpy as np
import pytest

from tabulon.errors import RefusedInput
from tabulon.operators import quantiles as Q

SHARES = (0.0, 0.5, 0.999)


def values(kind, n=3000):
    rng = random.Random(5)
    return {
        "normal": lambda: [rng.gauss(0, 3) for _ in range(n)],
        "two": lambda: [0.0] * (n // 2) + [7.0] * (n // 2),
        "wide": lambda: [10 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(n)],
        "pair": lambda: [1.0, 2.0],
    }[kind]()


@pytest.mark.parametrize("kind", ["normal", "two", "wide", "pair"])
def test_quantiles(spark, monkeypatch, kind):
    monkeypatch.setattr(Q, "FEW", 2)
    monkeypatch.setattr(Q, "GRID", 16)
    given = values(kind)
    df = spark.createDataFrame([(x,) for x in given] + [(None,), (float("nan"),)], "`x.y` double").repartition(3)
    got = Q.quantiles(df, "x.y", SHARES).first()
    assert got.n == len(given)
    for k, s in enumerate(SHARES):
        assert math.isclose(got[f"q{k}"], np.percentile(given, 100 * s), rel_tol=1e-9, abs_tol=1e-12), (kind, s)


def test_by_group(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEW", 5)
    monkeypatch.setattr(Q, "GRID", 16)
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), rng.choice(["a", None]), rng.choice([None, float(rng.randrange(40)), rng.random()])) for _ in range(2000)] + [(9, "a", None)]
    got = {(r.g, r.h): r for r in Q.quantiles(spark.createDataFrame(rows, "g int, h string, v double"), "v", (0.25, 0.9), ["g", "h"]).collect()}
    groups = {(g, h) for g, h, v in rows if v is not None}
    assert set(got) == groups and got[(1, "a")].asDict().keys() == {"g", "h", "n", "q0", "q1"}
    for key in groups:
        own = [v for g, h, v in rows if (g, h) == key and v is not None]
        assert got[key].n == len(own) and math.isclose(got[key].q0, np.percentile(own, 25)) and math.isclose(got[key].q1, np.percentile(own, 90))


def test_description_and_outliers(spark):
    rows = [("a", float(k)) for k in range(101)] + [("a", 1000.0), ("b", 2.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    a, b = sorted(Q.description(df, "v", ["g"]).collect())
    assert (a.n, a.q1, a.median, a.q3, a.max) == (102, 25.25, 50.5, 75.75, 1000.0) and (b.n, b.mean, b.sd, b.median) == (1, 2.0, None, 2.0)
    assert [tuple(r) for r in Q.outliers(df, "v").collect()] == [("a", 1000.0)]
    assert Q.quantiles(df.limit(0), "v", [0.5]).count() == 0 and Q.quantiles(df.filter("v IS NULL"), "v", [0.5], ["g"]).count() == 0
    for bad in ([], [1.5]):
        with pytest.raises(RefusedInput):
            Q.quantiles(df, "v", bad)


def test_no_task_holds_all_values(spark, monkeypatch):
    """What is sorted at last is a small part: the sketch and the counts come before."""
    monkeypatch.setattr(Q, "FEW", 200)
    got = Q.quantiles(spark.range(200_000).selectExpr("id * 7 % 200003 AS v"), "v", [0.5])
    assert got.first().q0 == np.percentile(np.arange(200_000) * 7 % 200_003, 50)
    plan = got._jdf.queryExecution().toString()
    assert "percentile(" not in plan
