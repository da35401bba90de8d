"""Supervised training of classifiers over feature vectors, as distributed synchronous steps that can be resumed.

Rows stay where they are. In each step the parameters are broadcast (their number is bounded), each partition sums the
gradients of its rows, and the sums are added up by a tree of partitions, so the driver gets a few arrays of the parameters'
size however many rows there are. Each epoch's parameters, the optimiser's state and the figures are written as a row of
a table; a run that was stopped goes on after the last epoch that is there, with the same figures.

    found = train(rows, validation, ["a", "b"], Schedule(epochs=8, head_epochs=2), Network(hidden=32), "runs/1")
    found.history.show()
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.errors import RefusedInput
from tabulon.operators import evaluate
from tabulon.operators.scoring import Predictor

#: Numbers that are broadcast in a step, at most, and how many partitions' sums are added by one task.
MOST_PARAMETERS, FAN = 5_000_000, 16


@dataclass(frozen=True)
class Network:
    """A softmax head over the features, or over a trunk of `hidden` rectified sums of them. `trunk` gives pretrained weights (features by hidden)."""

    hidden: int = 0
    seed: int = 0
    trunk: tuple[tuple[float, ...], ...] | None = None

    def initial(self, dims: int, classes: int) -> dict[str, np.ndarray]:
        """The head begins with zeros; the trunk as given, or with random numbers of the seed."""
        width = self.hidden or dims
        parameters = {"head": np.zeros((width, classes)), "head_bias": np.zeros(classes)}
        if self.hidden:
            first = np.array(self.trunk, dtype=float) if self.trunk is not None else np.random.default_rng(self.seed).normal(size=(dims, self.hidden)) * np.sqrt(2 / dims)
            if first.shape != (dims, self.hidden):
                raise RefusedInput(f"the trunk has weights of {first.shape}, not {(dims, self.hidden)}")
            parameters |= {"trunk": first, "trunk_bias": np.zeros(self.hidden)}
        if sum(p.size for p in parameters.values()) > MOST_PARAMETERS:
            raise RefusedInput(f"more than {MOST_PARAMETERS} parameters")
        return parameters


@dataclass(frozen=True)
class Schedule:
    """Epochs, of which the first `head_epochs` train the head only; steps an epoch (each over a slice of the rows by hash); AdamW's rates and decay."""

    epochs: int
    head_epochs: int = 0
    steps: int = 1
    head_rate: float = 0.01
    trunk_rate: float = 0.001
    decay: float = 0.01
    first: float = 0.9
    second: float = 0.999
    tiny: float = 1e-8

    def __post_init__(self):
        if self.epochs < 1 or self.steps < 1 or not 0 <= self.head_epochs <= self.epochs:
            raise RefusedInput("epochs and steps must be positive, and head epochs not more than epochs")


def probabilities(x: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(what the head sees, a probability for each class)."""
    seen = np.maximum(x @ p["trunk"] + p["trunk_bias"], 0) if "trunk" in p else x
    z = seen @ p["head"] + p["head_bias"]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return seen, z / z.sum(axis=1, keepdims=True)


def gradients(x: np.ndarray, y: np.ndarray, p: dict[str, np.ndarray], trunk: bool) -> tuple[float, dict[str, np.ndarray]]:
    """The sums, over the rows, of the cross entropy and its gradients; of the head only unless `trunk`."""
    seen, share = probabilities(x, p)
    loss = -np.log(np.maximum(share[np.arange(len(y)), y], 1e-300)).sum()
    error = share.copy()
    error[np.arange(len(y)), y] -= 1
    out = {"head": seen.T @ error, "head_bias": error.sum(axis=0)}
    if trunk and "trunk" in p:
        inner = (error @ p["head"].T) * (seen > 0)
        out |= {"trunk": x.T @ inner, "trunk_bias": inner.sum(axis=0)}
    return float(loss), out


def adamw(p: dict[str, np.ndarray], g: dict[str, np.ndarray], state: dict[str, np.ndarray], s: Schedule) -> None:
    """One step in place: only what has gradients moves, and only its moments and count change."""
    for name, grad in g.items():
        m, v, n = (state.setdefault(f"{kind}.{name}", np.zeros_like(grad) if kind != "n" else np.zeros(1)) for kind in "mvn")
        n += 1
        m += (1 - s.first) * (grad - m)
        v += (1 - s.second) * (grad * grad - v)
        rate = s.head_rate if name.startswith("head") else s.trunk_rate
        p[name] -= rate * (m / (1 - s.first ** n[0]) / (np.sqrt(v / (1 - s.second ** n[0])) + s.tiny) + s.decay * p[name])


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(arrays[k], dtype="<f8").tobytes() for k in sorted(arrays))


def _unpacked(data: bytes, shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    flat, out = np.frombuffer(data, dtype="<f8"), {}
    for k in sorted(shapes):
        n = int(np.prod(shapes[k]))
        out[k], flat = flat[:n].reshape(shapes[k]).copy(), flat[n:]
    return out


def _features(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(float).reshape(len(column), -1)


PARTIAL = "part int, rows long, loss double, gradient binary"


def _partials(shared, trunk: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from tabulon.operators import training

        p, loss, rows, total = shared.value, 0.0, 0, None
        for batch in batches:
            if batch.num_rows:
                some, g = training.gradients(training._features(batch.column(0)), batch.column(1).to_numpy(), p, trunk)
                loss, rows, total = loss + some, rows + batch.num_rows, g if total is None else {k: total[k] + g[k] for k in g}
        if total is not None:
            columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([rows]), pa.array([loss]), pa.array([training._packed(total)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "rows", "loss", "gradient"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task's rows; always in the same order, so that a rerun rounds alike."""
    found = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["part"])
    if found:
        total = sum(np.frombuffer(r["gradient"], dtype="<f8") for r in found)
        columns = [pa.array([found[0]["part"]], pa.int32()), pa.array([sum(r["rows"] for r in found)]), pa.array([sum(r["loss"] for r in found)]), pa.array([total.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "rows", "loss", "gradient"])


def summed_gradients(rows: DataFrame, p: dict[str, np.ndarray], trunk: bool) -> tuple[int, float, dict[str, np.ndarray]]:
    """(rows, loss, gradients) over `rows` (features, class_id), by a tree of partitions; nothing but its few last sums reaches the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(p)
    try:
        found = rows.select("features", "class_id").mapInArrow(_partials(shared, trunk), PARTIAL)
        parts = rows.rdd.getNumPartitions()
        while parts > FAN:
            parts = -(-parts // FAN)
            found = found.repartition(parts, F.floor(F.col("part") / FAN)).mapInArrow(_added, PARTIAL).withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        sums = sorted(found.collect(), key=lambda r: r.part)
    finally:
        shared.unpersist()
    if not sums:
        return 0, 0.0, {}
    names = [k for k in p if trunk or k.startswith("head")]
    total = sum(np.frombuffer(r.gradient, dtype="<f8") for r in sums)
    return sum(r.rows for r in sums), sum(r.loss for r in sums), _unpacked(total.tobytes(), {k: p[k].shape for k in names})


def predictions(rows: DataFrame, p: dict[str, np.ndarray], classes: list[str]) -> DataFrame:
    """`rows` with prediction and score: the class of the largest probability (the first if equal), and this."""
    shared = rows.sparkSession.sparkContext.broadcast(p)

    @F.pandas_udf("struct<prediction:string,score:double>")
    def run(values):
        import pandas as pd

        from tabulon.operators import training

        share = training.probabilities(np.stack(values.to_list()).astype(float), shared.value)[1]
        best = share.argmax(axis=1)
        return pd.DataFrame({"prediction": [classes[k] for k in best], "score": share[np.arange(len(best)), best]})

    return rows.withColumn("__said", run("features")).select(*rows.columns, "__said.*")


@dataclass
class Trained:
    """history: epoch, phase, rows, train_loss, validation_accuracy, validation_macro_f1; best_epoch: the first of the best; parameters: that epoch's."""

    history: DataFrame
    best_epoch: int
    classes: list[str]
    parameters: dict[str, np.ndarray]

    def predictor(self, task: str, status: str = "predicted") -> Predictor:
        """For `scoring.score` over a column of feature vectors."""
        p, classes = self.parameters, self.classes

        def load():
            from tabulon.operators import training

            def call(values):
                share = training.probabilities(np.stack(values).astype(float), p)[1]
                return [(classes[k], float(s[k])) for s, k in zip(share, share.argmax(axis=1))]

            return call

        return Predictor(task, load, status)


def labelled(df: DataFrame, features: str, label: str, classes: list[str]) -> DataFrame:
    """features (array<double>), class_id, slice (a hash of the features), label.

    Refused if a row has no vector, one with a null or non-finite component, or of another length than others, or a label that is no class.
    """
    values = F.transform(features, lambda v: v.cast("double"))
    spark = df.sparkSession
    ids = evaluate.class_table(spark, classes).select(F.col("raw_label").alias("label"), "class_id")
    rows = df.select(values.alias("features"), F.col(label).cast("string").alias("label")).join(F.broadcast(ids), "label", "left")  # a row for each declared class
    fine = F.col("features").isNotNull() & F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~fine | F.col("features").isNull()).alias("broken"), F.count_if(F.col("class_id").isNull()).alias("unknown"), F.min(F.size("features")).alias("least"), F.max(F.size("features")).alias("most")).first()
    if seen.n and (seen.broken or seen.unknown or seen.least != seen.most):
        raise RefusedInput(f"of {seen.n} rows {seen.broken} have no finite features, {seen.unknown} no declared label; features have {seen.least} to {seen.most} parts")
    return rows.select("features", F.col("class_id").cast("int").alias("class_id"), F.xxhash64("features").alias("slice"), "label")


def _stored(spark: SparkSession, folder: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{folder}/epochs/*")
    except AnalysisException:
        return None


STORED = "epoch int, phase string, rows long, train_loss double, validation_accuracy double, validation_macro_f1 double, config string, shapes string, parameters binary, moments binary"


def train(rows: DataFrame, validation: DataFrame, classes: list[str], schedule: Schedule, network: Network, folder: str, features: str = "features", label: str = "label", after: Callable[[int], None] = lambda epoch: None) -> Trained:
    """Trains on `rows`, tells each epoch of `validation`, and keeps the state in `folder` (shared by all machines); `after` is called once an epoch is written.

    An epoch is a row in a table of its own, written at once or not at all. A rerun with the same settings and row counts goes
    on after the last; with others it is refused. Steps take slices of the rows by a hash of their features and the
    epoch, so a rerun takes the same ones. Rows without a declared label or finite features, and empty tables, are refused.
    """
    spark = rows.sparkSession
    fit, held = labelled(rows, features, label, classes).persist(), labelled(validation, features, label, classes).persist()
    try:
        first = fit.select("features").first()
        counts = [fit.count(), held.count()]
        if first is None or not counts[1]:
            raise RefusedInput("there are no rows to train on, or none to validate")
        parameters, moments, done = network.initial(len(first.features), len(classes)), {}, 0
        settings = asdict(network) | {"trunk": network.trunk and hashlib.sha256(repr(network.trunk).encode()).hexdigest()}
        config = json.dumps({"schedule": asdict(schedule), "network": settings, "classes": classes, "rows": counts}, sort_keys=True)
        before = _stored(spark, folder)
        if before is not None:
            last = before.orderBy(F.desc("epoch")).first()
            if last.config != config:
                raise RefusedInput(f"{folder} holds a run with other settings or rows")
            shapes = json.loads(last.shapes)
            parameters, moments, done = _unpacked(last.parameters, shapes["parameters"]), _unpacked(last.moments, shapes["moments"]), last.epoch
        declared = evaluate.class_table(spark, classes)
        for epoch in range(done + 1, schedule.epochs + 1):
            both = epoch > schedule.head_epochs
            seen, loss = 0, 0.0
            for step in range(schedule.steps):
                some = fit if schedule.steps == 1 else fit.filter(F.pmod(F.xxhash64("slice", F.lit(epoch)), F.lit(schedule.steps)) == step)
                n, lost, g = summed_gradients(some, parameters, both)
                if not np.isfinite(lost):
                    raise RefusedInput(f"the loss of epoch {epoch} isn't finite")
                if n:
                    adamw(parameters, {k: v / n for k, v in g.items()}, moments, schedule)
                seen, loss = seen + n, loss + lost
            told = predictions(held, parameters, classes)
            score = evaluate.summary(evaluate.per_class(evaluate.cells(evaluate.classified_pairs(told, declared, "label", "prediction")), declared)).first()
            shapes = json.dumps({"parameters": {k: v.shape for k, v in parameters.items()}, "moments": {k: v.shape for k, v in moments.items()}})
            row = (epoch, "all" if both else "head", seen, loss / seen, score.accuracy, score.macro_f1, config, shapes, _packed(parameters), _packed(moments))
            # a rerun of a write that was stopped replaces it
            spark.createDataFrame([row], STORED).coalesce(1).write.mode("overwrite").parquet(f"{folder}/epochs/{epoch:06d}")
            after(epoch)
    finally:
        fit.unpersist()
        held.unpersist()
    stored = _stored(spark, folder)
    history = stored.select("epoch", "phase", "rows", "train_loss", "validation_accuracy", "validation_macro_f1")
    best = stored.orderBy(F.desc("validation_macro_f1"), "epoch").select("epoch", "shapes", "parameters").first()
    return Trained(history, best.epoch, classes, _unpacked(best.parameters, json.loads(best.shapes)["parameters"]))


def latency(predict: Callable[[list], object], sample: list, warm_ups: int = 10, trials: int = 50, clock: Callable[[], float] | None = None) -> list[float]:
    """Milliseconds of `trials` calls on one input after `warm_ups` calls that don't count."""
    import time

    clock = clock or time.perf_counter
    for _ in range(warm_ups):
        predict(sample)
    out = []
    for _ in range(trials):
        begin = clock()
        predict(sample)
        out.append((clock() - begin) * 1000)
    return out


def latencies(inputs: DataFrame, column: str, key: str, predictor: Predictor, warm_ups: int = 10, trials: int = 50) -> DataFrame:
    """key, trial, milliseconds: the predictor timed on each input, one at a time, where the executors run; a row for each trial."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tabulon.operators import scoring, training

        call, prepare = scoring.loaded(predictor), predictor.transform or (lambda v: v)
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                took = training.latency(call, [prepare(value)], warm_ups, trials)
                yield pa.RecordBatch.from_arrays([pa.array([k] * trials, batch.column(0).type), pa.array(range(1, trials + 1), pa.int32()), pa.array(took)], names=[key, "trial", "milliseconds"])

    kind = inputs.schema[key].dataType.simpleString()
    return inputs.select(key, column).mapInArrow(run, f"`{key}` {kind}, trial int, milliseconds double")
