"""Fitting a classifier epoch by epoch: passes over stored mini-batches, a history row each, early stopping, resuming."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirrup.functions.rand import unit
from chirrup.session import fresh_path, materialize

HISTORY = "run string, epoch bigint, train_loss double, train_accuracy double, val_loss double, val_accuracy double, next_lr double"
#: Folders that training rows are dealt to by a hash of their id; a mini-batch is a seeded choice of them.
BUCKETS = 32
#: Partial sums that the driver adds itself; more are added by a few tasks first.
DIRECT = 64
#: Fixed values of the optimiser (Adam), and the least rate of the schedule.
DECAY, DECAY_SQUARED, TINY, LEAST_RATE = 0.9, 0.999, 1e-8, 1e-6


@dataclass
class Settings:
    """What a run is told; `patience` epochs without a lower validation loss end it, `plateau` of them halve the rate."""

    classes: int
    epochs: int = 40
    batches: int = 4
    rate: float = 0.05
    smoothing: float = 0.1
    patience: int = 8
    plateau: int = 3
    seed: int = 42

    def __post_init__(self):
        if not (self.classes > 1 and self.epochs > 0 and 0 < self.batches <= BUCKETS and self.rate > 0 and 0 <= self.smoothing < 1 and self.patience > 0 and self.plateau >= 0):
            raise ValueError(f"unusable settings: {self}")


@dataclass
class State:
    """All that the next epoch needs; its size is that of the model."""

    weights: list
    moment: list
    square: list
    steps: int = 0
    rate: float = 0.0
    best: float = float("inf")
    best_weights: list = field(default_factory=list)
    stale: int = 0
    level: float = float("inf")
    waited: int = 0


def _sums(rows: DataFrame, weights: np.ndarray, shift: np.ndarray, scale: np.ndarray, smoothing: float, gradient: bool) -> tuple[np.ndarray | None, float, int, int]:
    """(gradient, loss, correct, rows) summed over (x, label_id) rows; a task sends one row, whatever it read."""
    d, k = weights.shape

    def stream(batches):
        total, loss, correct, n = np.zeros((d, k)), 0.0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(0).flatten()
            if len(flat) != batch.num_rows * (d - 1) or flat.null_count or batch.column(0).null_count:
                raise ValueError(f"every example needs {d - 1} features")
            x = (np.asarray(flat).reshape(-1, d - 1) - shift) * scale
            if not np.isfinite(x).all():
                raise ValueError("non-finite feature")
            x = np.hstack([x, np.ones((len(x), 1))])
            y = np.asarray(batch.column(1))
            z = x @ weights
            z -= z.max(axis=1, keepdims=True)
            logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
            loss -= (1 - smoothing) * logp[np.arange(len(y)), y].sum() + smoothing * logp.mean(axis=1).sum()
            correct += int((logp.argmax(axis=1) == y).sum())
            n += len(y)
            if gradient:
                target = np.full_like(logp, smoothing / k)
                target[np.arange(len(y)), y] += 1 - smoothing
                total += x.T @ (np.exp(logp) - target)
        yield pa.RecordBatch.from_pydict({"g": pa.array([total.tobytes() if gradient else b""], pa.binary()), "loss": [loss], "correct": [correct], "n": [n]})

    def add(batches):
        total, numbers = np.zeros(d * k if gradient else 0), np.zeros(3)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total += np.frombuffer(blob)
            numbers += [sum(c.to_pylist()) for c in batch.columns[1:]]
        yield pa.RecordBatch.from_pydict({"g": pa.array([total.tobytes()], pa.binary()), "loss": [float(numbers[0])], "correct": [int(numbers[1])], "n": [int(numbers[2])]})

    schema = "g binary, loss double, correct bigint, n bigint"
    parts = rows.mapInArrow(stream, schema)
    if rows.select(F.spark_partition_id().alias("p")).distinct().limit(DIRECT + 1).count() > DIRECT:
        parts = parts.repartition(DIRECT // 4).mapInArrow(add, schema)
    found = parts.collect()
    g = np.sum([np.frombuffer(r.g) for r in found], axis=0).reshape(d, k) if gradient and found else None
    return g, sum(r.loss for r in found), sum(r.correct for r in found), sum(r.n for r in found)


def _prepared(rows: DataFrame, id: str, column: str, classes: int) -> DataFrame:
    known = (F.col("label_id") >= 0) & (F.col("label_id") < classes)
    label = F.when(known, F.col("label_id").cast("bigint")).otherwise(F.raise_error(F.lit("a label outside the classes")).cast("bigint"))
    bucket = F.floor(unit(F.col(id), "bucket") * BUCKETS).cast("int")
    return rows.select(F.col(column).cast("array<double>").alias("x"), label.alias("y"), bucket.alias("bucket"))


def _scale(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and inverse spread of each feature over the training rows, by partial sums of a task."""

    def stream(batches):
        n, sums, squares = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
                n, sums, squares = n + len(x), sums + x.sum(axis=0), squares + (x * x).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "s": pa.array([sums.tolist()], pa.list_(pa.float64())), "q": pa.array([squares.tolist()], pa.list_(pa.float64()))})

    parts = rows.select("x").mapInArrow(stream, "n bigint, s array<double>, q array<double>")
    cells = parts.select("n", F.posexplode(F.arrays_zip("s", "q")).alias("at", "v"))
    found = cells.groupBy("at").agg(F.sum("n").alias("n"), F.sum("v.s").alias("s"), F.sum("v.q").alias("q")).orderBy("at").collect()
    if not found:
        raise ValueError("no training examples")
    n, s, q = (np.array([r[c] for r in found], float) for c in ("n", "s", "q"))
    spread = np.sqrt(np.maximum(q / n - (s / n) ** 2, 0))
    return s / n, np.divide(1, spread, out=np.zeros_like(spread), where=spread > 1e-12)


def fit_epochs(
    train: DataFrame, val: DataFrame, settings: Settings, id: str = "id", column: str = "features", folder: str | None = None, run: str = "fit"
) -> tuple[Callable[[np.ndarray], np.ndarray], DataFrame]:
    """(scorer, history): softmax regression on standardised features, fitted by mini-batches in seeded order.

    `train` and `val` have the id, an array of features and label_id.  Training
    rows are stored once, dealt to BUCKETS folders by a hash of their id; an
    epoch's mini-batches are disjoint choices of folders, by the seed and the
    epoch, and together all rows.  A mini-batch is one pass that reads its
    folders only; its gradient is summed by tasks, so what reaches the driver
    has the size of the model.  The result depends on the rows, not on how they
    are partitioned, but for the rounding of sums.

    The history has a row per epoch, with mean losses under label smoothing;
    `best_epoch_early_stop` of it names the epoch whose weights the scorer has.
    With `folder`, the state is kept there after each epoch, and a run that was
    stopped goes on after the last one kept.  An empty table is an error.
    """
    spark = train.sparkSession
    folder = folder or fresh_path(spark, "fit")
    path = fresh_path(spark, "examples")
    _prepared(train, id, column, settings.classes).write.partitionBy("bucket").parquet(path)
    stored = spark.read.schema("x array<double>, y bigint, bucket int").parquet(path)
    judged = materialize(_prepared(val, id, column, settings.classes).select("x", "y"))
    if judged.isEmpty():
        raise ValueError("no validation examples")
    shift, scale = _scale(stored)

    rows, state = _kept(spark, folder, run)
    if state is None:
        zero = np.zeros((len(shift) + 1, settings.classes)).tolist()
        state = State(zero, zero, zero, rate=settings.rate)
    weights, moment, square = (np.array(m) for m in (state.weights, state.moment, state.square))
    if weights.shape != (len(shift) + 1, settings.classes):
        raise ValueError(f"the state in {folder} is of another model")
    for epoch in range(len(rows) + 1, settings.epochs + 1):
        if state.stale >= settings.patience:
            break
        loss, correct, n = 0.0, 0, 0
        for chosen in np.array_split(np.random.default_rng([settings.seed, epoch]).permutation(BUCKETS), settings.batches):
            batch = stored.where(F.col("bucket").isin([int(b) for b in chosen])).select("x", "y")
            g, part_loss, part_correct, part_n = _sums(batch, weights, shift, scale, settings.smoothing, True)
            loss, correct, n = loss + part_loss, correct + part_correct, n + part_n
            if not part_n:
                continue
            g = g / part_n
            state.steps += 1
            moment = DECAY * moment + (1 - DECAY) * g
            square = DECAY_SQUARED * square + (1 - DECAY_SQUARED) * g * g
            step = moment / (1 - DECAY**state.steps) / (np.sqrt(square / (1 - DECAY_SQUARED**state.steps)) + TINY)
            weights = weights - state.rate * step
        _, val_loss, val_correct, val_n = _sums(judged, weights, shift, scale, settings.smoothing, False)
        val_loss /= val_n
        if val_loss < state.best:
            state.best, state.best_weights, state.stale = val_loss, weights.tolist(), 0
        else:
            state.stale += 1
        if val_loss < state.level * (1 - 1e-4):
            state.level, state.waited = val_loss, 0
        else:
            state.waited += 1
            if state.waited > settings.plateau:
                state.rate, state.waited = max(state.rate / 2, LEAST_RATE), 0
        rows.append((run, epoch, loss / n, correct / n, val_loss, val_correct / val_n, state.rate))
        state.weights, state.moment, state.square = weights.tolist(), moment.tolist(), square.tolist()
        kept = [(*rows[-1], json.dumps(state.__dict__))]
        spark.createDataFrame(kept, f"{HISTORY}, state string").coalesce(1).write.parquet(f"{folder}/{run}/epoch-{epoch:05d}")
    best = np.array(state.best_weights)

    def scorer(x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float64) - shift) * scale @ best[:-1] + best[-1]

    return scorer, spark.createDataFrame(rows, HISTORY)


def _kept(spark, folder: str, run: str) -> tuple[list[tuple], State | None]:
    """History rows and the state of the last epoch that was kept whole."""
    from pyspark.errors import AnalysisException

    rows, state = [], None
    while True:
        try:
            found = spark.read.schema(f"{HISTORY}, state string").parquet(f"{folder}/{run}/epoch-{len(rows) + 1:05d}").collect()
        except AnalysisException:
            found = []
        if not found:
            return rows, state
        rows.append(tuple(found[0][:-1]))
        state = State(**json.loads(found[0].state))
