"""Feed-forward classifier with smooth hidden layers and a logistic output.

The model is p(x) = s(A_L [.. g(A_2 [g(A_1 [x, 1]), 1]) .., 1]) with the logistic function s
and the hidden curve g.  Every matrix A_k carries its offsets as its last row, and all
matrices are views of one flat vector, the only thing that travels.

Training is data-parallel by local steps: one Spark job per epoch.  Each partition starts
from the common state, takes one Adam step per mini-batch of its rows in random order (block by
block, :mod:`riskframe.models.blocks`; a task's rows are ordered by a hash, so that a block is a random part of them whatever
order the input has), and returns its state weighted by its rows; the weighted mean
(a vector sum) is the next common state.  The same job measures the loss of the state it started from, on the training rows
and on a hash-selected validation slice, which decides about early stopping.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.hashing import unit_hash
from riskframe.models import blocks as B
from riskframe.session import drop_scratch

# FIXED VALUES: constants of the smooth curve's usual approximation.
GELU_CUBIC = 0.044715
GELU_RATE = 2.0 * math.sqrt(2.0 / math.pi)
#: Rows whose layers are computed at a time: their outputs stay in the processor's cache.
ROWS_AT_ONCE = 1024
#: Bytes of a written block: a writer holds a hundred of them, and a reader the blocks of a row group.
BLOCK_BYTES = 1 << 20


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def gelu_curve(x: np.ndarray, steep: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(value, slope if ``steep``) of x s(k(x)), k(x) = r (x + c x^3); the slope follows from s' = s (1 - s)."""
    square = x * x
    share = square * GELU_CUBIC
    share += 1.0
    share *= x
    share *= 0.5 * GELU_RATE
    np.tanh(share, out=share)
    share *= 0.5
    share += 0.5
    value = x * share
    if not steep:
        return value, None
    square *= 3.0 * GELU_CUBIC * GELU_RATE
    square += GELU_RATE
    square *= value
    slope = 1.0 - share
    slope *= square
    slope += share
    return value, slope


def relu_curve(x: np.ndarray, steep: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    on = x > 0
    return np.where(on, x, 0.0), on.astype(float) if steep else None


CURVES = {"gelu": gelu_curve, "relu": relu_curve}


def matrices(flat: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Views of the flat vector: one (inputs + 1) x outputs matrix per layer."""
    views, at = [], 0
    for i, o in zip(sizes, sizes[1:]):
        views.append(flat[at:at + (i + 1) * o].reshape(i + 1, o))
        at += (i + 1) * o
    return views


def through(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """[x, 1] A without a copy of x."""
    out = x @ a[:-1]
    out += a[-1]
    return out


def layer_outputs(flat: np.ndarray, sizes: list[int], kind: str, x: np.ndarray) -> list[np.ndarray]:
    """Outputs of all layers, the probabilities last."""
    *hidden, last = matrices(flat, sizes)
    outputs = []
    for a in hidden:
        x = CURVES[kind](through(x, a), steep=False)[0]
        outputs.append(x)
    return [*outputs, logistic(through(x, last))]


def probabilities(flat: np.ndarray, sizes: list[int], kind: str, x: np.ndarray) -> np.ndarray:
    """Of class 1, some rows at a time."""
    parts = [layer_outputs(flat, sizes, kind, x[a:a + ROWS_AT_ONCE])[-1][:, 0] for a in range(0, len(x), ROWS_AT_ONCE)]
    return np.concatenate(parts) if parts else np.zeros(0)


def log_loss_sum(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-7, 1 - 1e-7)
    return -float(np.where(y > 0.5, np.log(p), np.log1p(-p)).sum())


def gradient(flat: np.ndarray, sizes: list[int], kind: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gradient of the mean log-loss of some rows with respect to the flat vector.

    The output's error is p - y; the error of a hidden layer is the one above it, carried
    through the matrix between them (without its offsets) and scaled by the curve's slope."""
    *hidden, last = matrices(flat, sizes)
    inputs, slopes = [x], []
    for a in hidden:
        value, slope = CURVES[kind](through(inputs[-1], a))
        inputs.append(value)
        slopes.append(slope)
    error = (logistic(through(inputs[-1], last)) - y[:, None]) / len(y)
    out = np.empty_like(flat)
    for k, part in reversed(list(enumerate(matrices(out, sizes)))):
        np.matmul(inputs[k].T, error, out=part[:-1])
        part[-1] = error.sum(axis=0)
        if k:
            error = error @ (last if k == len(hidden) else hidden[k])[:-1].T
            error *= slopes[k - 1]
    return out


def offsets_mask(sizes: list[int]) -> np.ndarray:
    """1 for the entries that are decayed, 0 for the offsets."""
    flat = np.ones(sum((i + 1) * o for i, o in zip(sizes, sizes[1:])))
    for a in matrices(flat, sizes):
        a[-1] = 0.0
    return flat


@dataclass
class Moments:
    """State of Adam: the vector and the running means of its gradient and squared gradient."""
    flat: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    steps: float = 0.0

    @classmethod
    def at(cls, flat: np.ndarray) -> Moments:
        return cls(flat, np.zeros_like(flat), np.zeros_like(flat))

    def move(self, grad: np.ndarray, rate: float) -> None:
        self.steps += 1
        self.mean = 0.9 * self.mean
        self.mean += 0.1 * grad
        grow = grad * grad
        grow *= 0.001
        grow += 0.999 * self.square
        self.square = grow
        up = math.sqrt(1 - 0.999 ** self.steps) / (1 - 0.9 ** self.steps)
        size = np.sqrt(self.square)
        size += 1e-8
        step = self.mean / size
        step *= rate * up
        self.flat = self.flat - step

    def packed(self) -> np.ndarray:
        return np.concatenate([self.flat, self.mean, self.square, [self.steps]])

    @classmethod
    def unpacked(cls, data: np.ndarray) -> Moments:
        flat, mean, square = np.split(data[:-1], 3)
        return cls(flat, mean, square, float(data[-1]))


def _inputs(df: DataFrame, features_col: str, n: int) -> list:
    """The vector as n DOUBLE columns, which Arrow hands to NumPy as one block."""
    x = vector_to_array(F.col(features_col))
    return [x[i].alias(f"_x{i}") for i in range(n)]


def _decode(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, labels, whether a row is for validation) of a written block."""
    return np.frombuffer(r["x"]).reshape(r["n"], -1), np.frombuffer(r["y"]), np.frombuffer(r["rest"], np.int8).astype(bool)


@dataclass
class GeluNetworkModel:
    sizes: list[int]
    weights: np.ndarray
    activation: str = "gelu"
    loss_curve: list[float] = field(default_factory=list)
    val_loss_curve: list[float] = field(default_factory=list)
    best_val_loss: float | None = None
    stopped_early: bool = False

    @property
    def n_params(self) -> int:
        return int(self.weights.size)

    def _outputs(self):
        flat, sizes, kind = self.weights.copy(), list(self.sizes), self.activation
        return lambda pdf: layer_outputs(flat, sizes, kind, pdf.to_numpy(dtype=float))

    def transform(self, df: DataFrame, features_col: str = "scaled", output: str = "p_gelu") -> DataFrame:
        """Probability of class 1, in Arrow batches."""
        flat, sizes, kind = self.weights.copy(), list(self.sizes), self.activation

        @F.pandas_udf("double")
        def probability(x: pd.DataFrame) -> pd.Series:
            return pd.Series(probabilities(flat, sizes, kind, x.to_numpy(dtype=float)))

        return df.withColumn(output, probability(F.struct(*_inputs(df, features_col, self.sizes[0]))))

    def activations(self, df: DataFrame, features_col: str = "scaled", output: str = "activations") -> DataFrame:
        """Per row the outputs of every layer, with the network's own curve."""
        outputs = self._outputs()

        @F.pandas_udf("array<array<double>>")
        def layers(x: pd.DataFrame) -> pd.Series:
            return pd.Series([[layer.tolist() for layer in row] for row in zip(*outputs(x))])

        return df.withColumn(output, layers(F.struct(*_inputs(df, features_col, self.sizes[0]))))

    def unit_statistics(self, df: DataFrame, features_col: str = "scaled", tol: float = 1e-3) -> DataFrame:
        """(layer, unit, mean_abs, std, dead) of each hidden unit over all rows.

        Spread is the population standard deviation; below ``tol`` a unit is dead.  Each
        partition returns sums of the outputs, their squares and absolute values."""
        outputs, widths = self._outputs(), self.sizes[1:-1]
        total = sum(widths)

        def sums(it):
            acc = np.zeros(3 * total + 1)
            for pdf in it:
                if len(pdf):
                    h = np.hstack(outputs(pdf)[:-1])
                    acc += np.concatenate([h.sum(0), (h * h).sum(0), np.abs(h).sum(0), [len(h)]])
            yield pd.DataFrame({"s": [acc.tolist()]})

        found = df.select(*_inputs(df, features_col, self.sizes[0])).mapInPandas(sums, "s array<double>")
        s = found.agg(Summarizer.sum(array_to_vector("s")).alias("s")).first()["s"].toArray()
        n = max(1.0, s[-1])
        one, two, size = np.split(s[:-1] / n, 3)
        std = np.sqrt(np.maximum(two - one * one, 0.0))
        units = [(k + 1, u) for k, w in enumerate(widths) for u in range(w)]
        rows = [(k, u, float(m), float(d), bool(d < tol)) for (k, u), m, d in zip(units, size, std)]
        return df.sparkSession.createDataFrame(rows, "layer int, unit int, mean_abs double, std double, dead boolean")

    def dead_neuron_report(self, df: DataFrame, features_col: str = "scaled", tol: float = 1e-3) -> DataFrame:
        """Per hidden layer and for the whole network (layer 0): units, dead units and their
        percentage, mean absolute output, smallest spread, healthy (at most 5 % dead)."""
        units = self.unit_statistics(df, features_col, tol)
        every = units.unionByName(units.withColumn("layer", F.lit(0)))
        pct = F.round(100.0 * F.col("dead") / F.col("units"), 1)
        return every.groupBy("layer").agg(
            F.count(F.lit(1)).cast("int").alias("units"), F.count_if("dead").cast("int").alias("dead"),
            F.round(F.avg("mean_abs"), 4).alias("mean_activation"), F.round(F.min("std"), 5).alias("min_std")) \
            .withColumn("pct_dead", pct).withColumn("healthy", F.col("pct_dead") <= 5.0)


@dataclass
class GeluNetwork:
    """Estimator (M5); ``activation='relu'`` is the lab network's curve (M6)."""
    hidden: tuple[int, ...] = (64, 32)
    epochs: int = 240
    lr: float = 0.01
    l2: float = 5e-4
    batch: int = 64
    patience: int = 12
    min_delta: float = 1e-4
    val_fraction: float = 0.15
    seed: int = 42
    activation: str = "gelu"
    partitions: int | None = None  # rows are dealt to so many tasks; the default parallelism if not given

    def start(self, sizes: list[int]) -> np.ndarray:
        """Normal entries with variance 2 / inputs, offsets 0."""
        rng = np.random.default_rng(self.seed)
        spread = np.concatenate([np.full((i + 1) * o, math.sqrt(2.0 / i)) for i, o in zip(sizes, sizes[1:])])
        return rng.standard_normal(len(spread)) * spread * offsets_mask(sizes)

    def fit(self, df: DataFrame, id_col: str, features_col: str = "scaled", label_col: str = "label") -> GeluNetworkModel:
        spark = df.sparkSession
        width = len(df.select(vector_to_array(F.col(features_col)).alias("x")).first()["x"])
        sizes = [width, *self.hidden, 1]
        rows = df.select(vector_to_array(F.col(features_col)).alias("x"), F.col(label_col).cast("double").alias("y"),
                         (unit_hash(id_col, self.seed + 1) < F.lit(self.val_fraction)).cast("tinyint").alias("val"),
                         unit_hash(id_col, self.seed + 2).alias("_u"))
        # by a hash of the row, and written: the same rows meet in a partition in every epoch, whatever executors are lost; in the
        # hash's order, as steps through rows that lie by class or by date go astray
        tasks = self.partitions or spark.sparkContext.defaultParallelism
        deal = rows.repartition(tasks, "_u").sortWithinPartitions("_u").drop("_u")
        table, path = B.written(B.in_blocks(deal, lambda x: x, lambda n, t: t["val"].to_numpy(), max(self.batch, BLOCK_BYTES // (8 * width))), "net-rows")
        rows = B.kept(table, _decode, tasks)
        state = Moments.at(self.start(sizes))
        model = GeluNetworkModel(sizes, state.flat, self.activation)
        best, waited = math.inf, 0
        for epoch in range(self.epochs):
            mean, train_loss, val_loss = self.epoch(rows, state, sizes, epoch)
            if train_loss is None:
                break
            model.loss_curve.append(train_loss)
            model.val_loss_curve.append(val_loss)
            waited += 1
            if val_loss < best - self.min_delta:
                best, waited, model.weights = val_loss, 0, state.flat
            if waited >= self.patience:
                model.stopped_early = True
                break
            state = mean
        model.best_val_loss = round(best, 4) if math.isfinite(best) else None
        rows.unpersist()
        drop_scratch(spark, [path])
        return model

    def epoch(self, rows: RDD, state: Moments, sizes: list[int], number: int):
        """(next state, mean training loss, mean validation loss of ``state``); (.., None, ..) without rows."""
        sent, kind, size = state.packed(), self.activation, self.batch
        rate, decay, seed = self.lr, self.l2 * offsets_mask(sizes), (self.seed, number)

        def local(it):
            here = Moments.unpacked(sent.copy())
            begun = here.flat
            tally = np.zeros(4)  # training loss and rows, validation loss and rows
            rng = np.random.default_rng(seed)
            for x, y, val in it:
                for k, some in ((0, ~val), (2, val)):
                    if some.any():
                        p = probabilities(begun, sizes, kind, x[some])
                        tally[k:k + 2] += log_loss_sum(p, y[some]), some.sum()
                order = rng.permutation(np.flatnonzero(~val))
                for pick in np.array_split(order, max(1, -(-len(order) // size))):
                    if len(pick):
                        here.move(gradient(here.flat, sizes, kind, x[pick], y[pick]) + decay * here.flat, rate)
            yield np.concatenate([here.packed() * tally[1], tally])

        s = B.added(rows.mapPartitions(local), len(sent) + 4)
        *_, t_loss, t_rows, v_loss, v_rows = s
        if t_rows == 0:
            return state, None, None
        train_loss = float(t_loss / t_rows)
        return Moments.unpacked(s[:-4] / t_rows), train_loss, float(v_loss / v_rows) if v_rows else train_loss
