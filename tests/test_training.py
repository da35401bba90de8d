"""Training against plain numpy runs, and runs that are stopped and go on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.errors import RefusedInput
from tabulon.operators import scoring, split, training
from tabulon.operators.training import Network, Schedule, train

CLASSES = ["a", "b", "c"]


def points(n=240, dims=5, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, dims)) + np.eye(3, dims)[y] * 1.5
    return x, y


@pytest.fixture(scope="module")
def rows(spark):
    x, y = points()
    return spark.createDataFrame([(k, v.tolist(), CLASSES[c]) for k, (v, c) in enumerate(zip(x, y))], "id long, features array<double>, label string").repartition(7).cache()


def plain(x, y, held, schedule, network):
    """The same in numpy, by formulas written out once more: (loss, accuracy, macro F1) of each epoch."""
    p = network.initial(x.shape[1], 3)
    m, v, n, out = {}, {}, {}, []
    for epoch in range(1, schedule.epochs + 1):
        h = np.maximum(x @ p["trunk"] + p["trunk_bias"], 0) if network.hidden else x
        z = h @ p["head"] + p["head_bias"]
        q = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        hot = np.eye(3)[y]
        loss = -(hot * np.log(q)).sum() / len(y)
        d = (q - hot) / len(y)
        g = {"head": h.T @ d, "head_bias": d.sum(0)}
        if epoch > schedule.head_epochs and network.hidden:
            back = d @ p["head"].T * (h > 0)
            g |= {"trunk": x.T @ back, "trunk_bias": back.sum(0)}
        for k in g:
            n[k] = n.get(k, 0) + 1
            m[k] = 0.9 * m.get(k, 0) + 0.1 * g[k]
            v[k] = 0.999 * v.get(k, 0) + 0.001 * g[k] ** 2
            rate = schedule.head_rate if k.startswith("head") else schedule.trunk_rate
            p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** n[k]) / (np.sqrt(v[k] / (1 - 0.999 ** n[k])) + 1e-8) + schedule.decay * p[k])
        hx, hy = held
        s = np.maximum(hx @ p["trunk"] + p["trunk_bias"], 0) if network.hidden else hx
        said = (s @ p["head"] + p["head_bias"]).argmax(axis=1)
        f1 = [2 * ((said == c) & (hy == c)).sum() / max(1, (said == c).sum() + (hy == c).sum()) for c in range(3)]
        out.append((loss, (said == hy).mean(), np.mean(f1)))
    return out, p


@pytest.mark.parametrize(("network", "schedule"), [(Network(), Schedule(epochs=6, head_rate=0.05)), (Network(hidden=4, seed=3), Schedule(epochs=5, head_epochs=2, head_rate=0.05, trunk_rate=0.02))])
def test_train_equals_numpy(spark, rows, tmp_path, network, schedule):
    x, y = points()
    some = np.arange(len(y)) % 4 == 0
    told, p = plain(x[~some], y[~some], (x[some], y[some]), schedule, network)
    found = train(rows.filter("id % 4 != 0"), rows.filter("id % 4 = 0"), CLASSES, schedule, network, str(tmp_path / "run"))
    history = sorted(map(tuple, found.history.collect()))
    assert [r[0] for r in history] == list(range(1, schedule.epochs + 1))
    assert [r[1] for r in history] == ["head" if e <= schedule.head_epochs else "all" for e in range(1, schedule.epochs + 1)]
    assert np.allclose([r[3:] for r in history], told, atol=1e-6)
    assert found.best_epoch == int(np.argmax([round(t[2], 12) for t in told])) + 1 == split.best_epoch(found.history).first().epoch
    if found.best_epoch == schedule.epochs:
        assert all(np.allclose(p[k], found.parameters[k], atol=1e-6) for k in p)


def test_stopped_run_goes_on(spark, rows, tmp_path):
    schedule, network = Schedule(epochs=4, head_epochs=2, steps=3, head_rate=0.05, trunk_rate=0.02), Network(hidden=4, seed=3)
    a, b = rows.filter("id % 4 != 0"), rows.filter("id % 4 = 0")

    def stop(epoch):
        if epoch in (1, 3):
            raise KeyboardInterrupt

    whole = train(a, b, CLASSES, schedule, network, str(tmp_path / "whole"))
    seen = []
    for _ in range(2):
        with pytest.raises(KeyboardInterrupt):
            train(a, b, CLASSES, schedule, network, str(tmp_path / "parts"), after=lambda e: (seen.append(e), stop(e)))
    parts = train(a, b, CLASSES, schedule, network, str(tmp_path / "parts"), after=seen.append)
    assert seen == [1, 2, 3, 4]
    assert np.allclose([r[3:] for r in sorted(map(tuple, whole.history.collect()))], [r[3:] for r in sorted(map(tuple, parts.history.collect()))], atol=1e-12)
    assert all(np.allclose(whole.parameters[k], parts.parameters[k], atol=1e-12) for k in whole.parameters)
    again = train(a, b, CLASSES, schedule, network, str(tmp_path / "parts"), after=seen.append)
    assert seen == [1, 2, 3, 4] and again.best_epoch == parts.best_epoch
    with pytest.raises(RefusedInput):
        train(a, b, CLASSES, Schedule(epochs=5), network, str(tmp_path / "parts"))
    with pytest.raises(RefusedInput):
        train(a.filter("id != 1"), b, CLASSES, schedule, network, str(tmp_path / "parts"))


def test_tree_of_partitions(spark, rows, monkeypatch):
    """Sums don't depend on how many partitions there are, and the driver gets few."""
    x, y = points()
    p = Network().initial(5, 3)
    told = training.gradients(x, y, p, True)
    monkeypatch.setattr(training, "FAN", 3)
    ready = training.labelled(rows.repartition(40), "features", "label", CLASSES)
    n, loss, g = training.summed_gradients(ready, p, True)
    assert n == len(y) and abs(loss - told[0]) < 1e-9
    assert all(np.allclose(g[k], told[1][k]) for k in told[1])


@pytest.mark.parametrize(
    "row", [(1, None, "a"), (1, [1.0, None, 0.0, 0.0, 0.0], "a"), (1, [float("nan")] * 5, "a"), (1, [1.0], "a"), (1, [1.0] * 5, "z"), (1, [1.0] * 5, None)]
)
def test_rows_that_are_refused(spark, rows, tmp_path, row):
    bad = rows.unionByName(spark.createDataFrame([row], rows.schema))
    with pytest.raises(RefusedInput):
        train(bad, rows, CLASSES, Schedule(epochs=1), Network(), str(tmp_path / "run"))


def test_empty_and_wrong_settings(spark, rows, tmp_path):
    for a, b in ((rows.limit(0), rows), (rows, rows.limit(0))):
        with pytest.raises(RefusedInput):
            train(a, b, CLASSES, Schedule(epochs=1), Network(), str(tmp_path / "run"))
    for bad in (dict(epochs=0), dict(epochs=1, steps=0), dict(epochs=1, head_epochs=2)):
        with pytest.raises(RefusedInput):
            Schedule(**bad)
    with pytest.raises(RefusedInput):
        Network(hidden=2, trunk=((1.0,),)).initial(5, 3)
    with pytest.raises(RefusedInput):
        Network(hidden=10**7).initial(5, 3)


def test_predictor_and_latency(spark, rows, tmp_path):
    found = train(rows.filter("id % 4 != 0"), rows.filter("id % 4 = 0"), CLASSES, Schedule(epochs=8, head_rate=0.1), Network(), str(tmp_path / "run"))
    predictor = found.predictor("make")
    scored = scoring.score(rows, "features", predictor).select("id", "label", "scored.*").collect()
    assert sum(r[1] == r[2] for r in scored) > 0.6 * len(scored) and all(0.3 < r.score <= 1 and r.status == "predicted" for r in scored)
    direct = {r.id: (r.prediction, r.score) for r in training.predictions(rows, found.parameters, CLASSES).collect()}
    assert all(direct[r.id][0] == r[2] and abs(direct[r.id][1] - r.score) < 1e-12 for r in scored)
    timed = training.latencies(rows.filter("id < 3"), "features", "id", predictor, 2, 5)
    assert timed.groupBy("id").agg(F.count("*"), F.max("trial")).count() == 3 and timed.count() == 15 and timed.filter("milliseconds <= 0").count() == 0
    ticks = iter(range(100))
    assert training.latency(lambda v: next(ticks), [1], 10, 4, lambda: next(ticks)) == [2000.0] * 4 and next(ticks) == 22
