"""The ensemble as arrays: many variants of a row are scored inside one task.

What-if analysis scores each row several times with a few of its encoded values replaced.  With the
fitted models as NumPy arrays a task makes the variants of its rows, scores them as one matrix and returns
one list of probabilities per row, so neither variants nor row numbers ever travel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from riskframe.models.ensemble import Ensemble
from riskframe.models.forest import slot_bit
from riskframe.models.gelu_net import probabilities
from riskframe.session import ship_package

#: Rows of a matrix scored at a time (trees x rows places are held at once).
SCORED_AT_ONCE = 4096
TREES = ("random_forest", "newton_boosting")


@dataclass
class MatrixScorer:
    """Probabilities of every model of an ensemble for a matrix of encoded, unscaled rows."""
    mean: np.ndarray
    std: np.ndarray
    models: dict

    @classmethod
    def of(cls, spark: SparkSession, ens: Ensemble) -> MatrixScorer:
        models = {}
        for name, m in ens.models.items():
            if name in TREES and m is not None:
                m = m.arrays()
            elif name == "logit" and m is not None:
                m = (m.coefficients.toArray(), float(m.intercept))
            elif name == "neural_net" and m is not None:
                m = (m.weights.copy(), list(m.sizes), m.activation)
            models[name] = m
        return cls(np.array(ens.scaler.mean), np.array(ens.scaler.std), models)

    def one(self, name: str, x: np.ndarray) -> np.ndarray:
        m = self.models[name]
        if m is None:
            return np.full(len(x), 0.5)
        if name == "random_forest":
            return m.probability(x)
        if name == "neural_net":
            return probabilities(*m, x)
        z = x @ m[0] + m[1] if name == "logit" else m.margin(x)
        return 1.0 / (1.0 + np.exp(-z))

    def with_variants(self, x: np.ndarray, made: np.ndarray, owner: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean over the models of rows, and of variants of the rows ``owner`` (in order) that differ in the slots ``moved``.

        A tree that tests none of them on a row's way gives the row's own value: only the other trees are walked again."""
        rows, others = np.empty(len(x)), np.empty(len(made))
        step = max(1, SCORED_AT_ONCE * len(x) // max(1, len(x) + len(made)))
        for a in range(0, len(x), step):
            some = slice(*np.searchsorted(owner, [a, a + step]))
            scaled, new = ((v - self.mean) / self.std for v in (x[a:a + step], made[some]))
            found = []
            for name, m in self.models.items():
                if m is not None and name in TREES:
                    found.append(m.with_variants(scaled, new, owner[some] - a, moved[some]))
                else:
                    found.append((self.one(name, scaled), self.one(name, new)))
            rows[a:a + step], others[some] = (sum(f) / len(found) for f in zip(*found))
        return rows, others

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Mean over the models (M8)."""
        out = np.empty(len(x))
        for a in range(0, len(x), SCORED_AT_ONCE):
            scaled = (x[a:a + SCORED_AT_ONCE] - self.mean) / self.std
            out[a:a + SCORED_AT_ONCE] = sum(self.one(n, scaled) for n in self.models) / len(self.models)
        return out


def variants(scorer: MatrixScorer, x: np.ndarray, row: np.ndarray, variant: np.ndarray, slot: np.ndarray, value: np.ndarray,
             counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, ends): for each row that of itself and of its ``counts`` variants, in turn.

    A variant whose moves all set what the row holds anyway is the row itself, which is scored once."""
    ends = np.cumsum(counts + 1)
    base = ends - counts - 1
    place = base[row] + 1 + variant
    moved = np.zeros(len(x) + int(counts.sum()), np.uint64)  # by row and variant
    differs = x[row, slot] != value
    np.bitwise_or.at(moved, place[differs], slot_bit(slot[differs]))
    other = np.flatnonzero(moved)
    owner = np.searchsorted(ends, other, "right")
    made = x[owner]
    made[np.searchsorted(other, place[differs]), slot[differs]] = value[differs]
    of_rows, of_variants = scorer.with_variants(x, made, owner, moved[other])
    out = np.repeat(of_rows, counts + 1)
    out[other] = of_variants
    return out, ends


def score_variants(spark: SparkSession, scorer: MatrixScorer, x: Column, moves: Column, count: Column) -> Column:
    """ARRAY<DOUBLE>: the probability of ``x`` and of its ``count`` variants.

    ``moves``: ARRAY<STRUCT<variant INT, slot INT, value DOUBLE>>; a variant is ``x`` with its moves' slots replaced."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(scorer)  # the models: some MB, whatever the rows

    @F.arrow_udf("array<double>")
    def probabilities(xs: pa.Array, ms: pa.Array, ns: pa.Array) -> pa.Array:
        n = len(xs)
        m = ms.flatten()
        lengths = np.diff(ms.offsets.to_numpy()) if n else np.zeros(0, np.int64)
        matrix = xs.flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 0))
        p, ends = variants(shared.value, matrix, np.repeat(np.arange(n), lengths), m.field("variant").to_numpy(), m.field("slot").to_numpy(),
                           m.field("value").to_numpy(), ns.to_numpy())
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(p))

    return probabilities(x, moves, count)
