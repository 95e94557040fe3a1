"""A multinomial classifier trained in steps: seeded batches, parameter groups, warm-up and decay, a starting matrix.

Each step reads one batch, a folder of its own. Tasks sum up the gradient of their rows; their sums meet in a tree, so the driver gets
a few matrices of features x classes, whatever the batch's size, takes the step and sends the new matrix out with the next."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.ordered import mini_batches
from loomgraph.sinks.workspace import new_path

#: Sums of tasks that meet in one task of the tree.
FAN_IN = 16


@dataclass(frozen=True)
class Group:
    """Rows of the matrix (from, to) with a learning rate and a decay of weights of their own."""

    rows: tuple[int, int]
    rate: float
    decay: float = 0.0


@dataclass
class Settings:
    features: int = 1 << 12
    classes: int = 4
    epochs: int = 5
    batch: int = 4096
    warmup: int = 3
    seed: int = 42
    groups: list[Group] = field(default_factory=list)
    betas: tuple[float, float] = (0.9, 0.999)
    epsilon: float = 1e-6

    def grouped(self) -> list[Group]:
        """By default all features decay and the intercepts, the last row, don't."""
        return self.groups or [Group((0, self.features), 0.05, 0.01), Group((self.features, self.features + 1), 0.05)]


def hashed(words: Column, features: int) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))


def share_of_rate(step: int, warmup: int, steps: int) -> float:
    """Up in a line over ``warmup`` steps, then down in a line to nothing after ``steps``."""
    return step / max(1, warmup) if step < warmup else max(0.0, (steps - step) / max(1, steps - warmup))


def loss_and_gradient(weights: np.ndarray, flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over rows whose features are ``flat``, ``sizes`` of them each; every row has the intercept, too."""
    rows = np.repeat(np.arange(sizes.size), sizes)
    scores = np.tile(weights[-1], (sizes.size, 1))
    np.add.at(scores, rows, weights[flat])
    scores -= scores.max(1, keepdims=True)
    chances = np.exp(scores)
    chances /= chances.sum(1, keepdims=True)
    loss = float(-np.log(np.maximum(chances[np.arange(sizes.size), labels], 1e-300)).sum())
    chances[np.arange(sizes.size), labels] -= 1
    out = np.zeros_like(weights)
    np.add.at(out, flat, chances[rows])
    out[-1] = chances.sum(0)
    return loss, out


def _features_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


_SUM = "n bigint, loss double, gradient binary"


def _total(batch: DataFrame, weights: np.ndarray) -> tuple[int, float, np.ndarray]:
    shape = weights.shape
    sent = batch.sparkSession.sparkContext.broadcast(weights)

    def packed(n, loss, gradient):
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss], pa.float64()), pa.array([gradient.tobytes()], pa.binary())], ["n", "loss", "gradient"])

    def of_rows(batches):
        n, loss, gradient = 0, 0.0, np.zeros(shape)
        for part in batches:
            flat, sizes = _features_of(part.column(0))
            more, own = loss_and_gradient(sent.value, flat, sizes, part.column(1).to_numpy())
            n, loss, gradient = n + part.num_rows, loss + more, gradient + own
        if n:
            yield packed(n, loss, gradient)

    def of_sums(batches):
        n, loss, gradient = 0, 0.0, np.zeros(shape)
        for part in batches:
            for k, more, own in zip(*(c.to_pylist() for c in part.columns), strict=True):
                n, loss, gradient = n + k, loss + more, gradient + np.frombuffer(own).reshape(shape)
        if n:
            yield packed(n, loss, gradient)

    sums, parts = batch.select("features", "label").mapInArrow(of_rows, _SUM), batch.rdd.getNumPartitions()
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        sums = sums.repartition(parts).mapInArrow(of_sums, _SUM)
    n, loss, gradient = 0, 0.0, np.zeros(shape)
    for r in sorted(sums.collect(), key=lambda r: (r.loss, r.n)):  # FAN_IN rows at most, added in the same order each time
        n, loss, gradient = n + r.n, loss + r.loss, gradient + np.frombuffer(r.gradient).reshape(shape)
    sent.destroy()
    return n, loss, gradient


class Steps:
    """Moments and decayed weights; a step with no rows changes nothing."""

    def __init__(self, settings: Settings, steps: int, start: np.ndarray | None):
        shape = (settings.features + 1, settings.classes)
        if start is not None and start.shape != shape:
            raise ValueError(f"a starting matrix of {start.shape} for {shape}")
        self.weights = np.zeros(shape) if start is None else start.astype(float).copy()
        self.settings, self.steps, self.taken = settings, steps, 0
        self.mean, self.square = np.zeros(shape), np.zeros(shape)

    def take(self, n: int, gradient: np.ndarray) -> None:
        if n:
            share = share_of_rate(self.taken, self.settings.warmup, self.steps)
            (a, b), g = self.settings.betas, gradient / n
            self.mean, self.square = a * self.mean + (1 - a) * g, b * self.square + (1 - b) * g * g
            for group in self.settings.grouped():
                own, rate = slice(*group.rows), group.rate * share
                self.weights[own] -= rate * self.mean[own] / (np.sqrt(self.square[own]) + self.settings.epsilon)
                self.weights[own] -= rate * group.decay * self.weights[own]
        self.taken += 1


def fit(samples: DataFrame, key: list[str], settings: Settings, start: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """The matrix, and (epoch, step, mean loss) of each step. ``samples``: ``features`` (array of ints below ``settings.features``),
    ``label`` (below ``settings.classes``; rows with another or none are left out) and ``key``, which orders them with the seed.
    ``start`` is the matrix of a model trained elsewhere. Without rows the start, or zeros, comes back."""
    spark, path = samples.sparkSession, new_path(samples.sparkSession, "batches")
    usable = samples.where((F.col("label") >= 0) & (F.col("label") < settings.classes) & F.col("features").isNotNull()).select(*key, "features", F.col("label").cast("int").alias("label"))
    mini_batches(usable, key, settings.batch, settings.seed).drop("place").write.partitionBy("batch").parquet(path)
    held = spark.read.schema("features array<int>, label int, batch bigint").parquet(path)
    batches = [r.batch for r in held.select("batch").distinct().orderBy("batch").collect()]  # one row a step
    state, log = Steps(settings, settings.epochs * len(batches), start), []
    for epoch in range(settings.epochs):
        for b in batches:
            n, loss, gradient = _total(held.where(F.col("batch") == b), state.weights)
            state.take(n, gradient)
            log.append((epoch, state.taken - 1, loss / n))
    return state.weights, log


def predict(samples: DataFrame, weights: np.ndarray) -> DataFrame:
    """``samples`` with the likeliest class ``y_pred``, the lower of equals, and its ``chance``; null features have the intercepts only."""
    sent, at = samples.sparkSession.sparkContext.broadcast(weights), samples.columns.index("features")

    def run(batches):
        for part in batches:
            flat, sizes = _features_of(part.column(at))
            scores = np.tile(sent.value[-1], (part.num_rows, 1))
            np.add.at(scores, np.repeat(np.arange(sizes.size), sizes), sent.value[flat])
            chances = np.exp(scores - scores.max(1, keepdims=True))
            chances /= chances.sum(1, keepdims=True)
            best = chances.argmax(1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best.astype(np.int32)), pa.array(chances[np.arange(best.size), best])], [*part.schema.names, "y_pred", "chance"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema)
    return samples.mapInArrow(run, f"{fields}, y_pred int, chance double")


def save(spark: SparkSession, weights: np.ndarray, path: str) -> str:
    """As a table of the matrix's rows."""
    spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(weights)], "feature int, weights array<double>").coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r.weights for r in spark.read.parquet(path).orderBy("feature").collect()])
