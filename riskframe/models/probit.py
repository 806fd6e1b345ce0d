"""Probit by maximum likelihood, with the checks under which it has a finite unique solution (M2).

Before the fit, one aggregate of the products of all pairs of features (with the constant) tells which of them
follow from earlier ones; they leave the coefficients open and are left out (their coefficients are 0).  After the
fit, a pass tells whether a hyperplane separates the classes, in which case the likelihood grows without
end, and the iterations tell whether they came to rest.  In either of these cases the logistic model (with its small
L2 term, which is always solvable) is fitted in its place.  The model says what was done.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import PySparkException
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.session import ship_package

#: Smallest share of the largest singular value (features at unit length) that counts as a direction.
RANK_TOLERANCE = 1e-9
#: A scaled coefficient beyond this sends probabilities to 0 and 1: the iterations ran away.
RUNAWAY = 30.0


def gram(df: DataFrame, features: str, width: int) -> np.ndarray:
    """Products of all pairs of features and the constant, summed over all rows (partial sums per task)."""
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((width + 1, width + 1))
        for pdf in batches:
            if len(pdf):
                x = np.column_stack([np.ones(len(pdf)), np.stack(pdf["x"].to_numpy())])
                out += x.T @ x
        yield pd.DataFrame({"s": [out.ravel()]})

    ship_package(df.sparkSession)
    packed = df.select(vector_to_array(F.col(features)).alias("x")).mapInPandas(sums, "s array<double>")
    return packed.agg(Summarizer.sum(array_to_vector("s")).alias("s")).first()["s"].toArray().reshape(width + 1, -1)


def rank_of(products: np.ndarray) -> int:
    """How many of the columns behind these products are independent."""
    length = np.sqrt(np.diag(products))
    some = length > 0
    unit = products[np.ix_(some, some)] / np.outer(length[some], length[some])
    values = np.linalg.eigvalsh(unit)
    return int((values > RANK_TOLERANCE * values.max()).sum()) if len(values) else 0


def independent(products: np.ndarray) -> list[int]:
    """The features (numbered from 0, the constant is column 0) that do not follow from the constant and earlier ones."""
    kept = [0]
    for j in range(1, len(products)):
        if rank_of(products[np.ix_([*kept, j], [*kept, j])]) == len(kept) + 1:
            kept.append(j)
    return [j - 1 for j in kept[1:]]


@dataclass
class ProbitModel:
    used: str          # "probit" or "logit"
    reason: str        # "", "collinear: .. left out", or why not probit: "separable", "no convergence", the error
    coefficients: np.ndarray
    intercept: float
    iterations: int
    kept: list[int]
    fitted: GeneralizedLinearRegressionModel | None = None

    def linear(self, features_col: str) -> Column:
        x = vector_to_array(F.col(features_col))
        pairs = F.zip_with(x, F.array(*[F.lit(float(b)) for b in self.coefficients]), lambda a, b: a * b)
        return F.aggregate(pairs, F.lit(float(self.intercept)), lambda a, v: a + v)

    def transform(self, df: DataFrame, features_col: str = "scaled", output: str = "p_probit") -> DataFrame:
        """Probability of class 1 under the model that was used."""
        if self.used == "logit":
            return df.withColumn(output, 1.0 / (1.0 + F.exp(-self.linear(features_col))))
        inner = self.fitted.copy().setFeaturesCol("_kept").setPredictionCol(output)
        return inner.transform(df.withColumn("_kept", _only(features_col, self.kept))).drop("_kept")


def _only(features_col: str, kept: list[int]) -> Column:
    x = vector_to_array(F.col(features_col))
    return array_to_vector(F.array(*[x[j] for j in kept]).cast("array<double>"))


@dataclass
class Probit:
    max_iter: int = 200

    def fit(self, df: DataFrame, features: str = "scaled", label: str = "label") -> ProbitModel:
        data = df.select(vector_to_array(F.col(features)).alias("x"), F.col(features).alias("features"),
                         F.col(label).cast("double").alias("y")).filter("y is not null")
        width = len(data.first()["x"])
        kept = independent(gram(data, "features", width))
        reason = "" if len(kept) == width else f"collinear: {width - len(kept)} of {width} features left out"
        try:
            m = GeneralizedLinearRegression(featuresCol="_kept", labelCol="y", family="binomial", link="probit",
                                            maxIter=self.max_iter).fit(data.withColumn("_kept", _only("features", kept)))
        except PySparkException as e:
            return self.instead(data, f"failed: {str(e)[:100]}")
        beta, steps = np.zeros(width), m.summary.numIterations
        beta[kept] = m.coefficients.toArray()
        model = ProbitModel("probit", reason, beta, float(m.intercept), steps, kept, m)
        if not np.isfinite(beta).all():
            return self.instead(data, "no convergence")
        # every row on its own side: the likelihood has no maximum
        wrong = data.filter((2 * F.col("y") - 1) * model.linear("features") <= 0)
        if wrong.isEmpty():
            return self.instead(data, "separable")
        if steps >= self.max_iter or np.abs(beta).max(initial=0.0) > RUNAWAY:
            return self.instead(data, "no convergence")
        return model

    def instead(self, data: DataFrame, reason: str) -> ProbitModel:
        warnings.warn(f"probit has no solution on these rows ({reason}): a logistic model is used", stacklevel=3)
        m = LogisticRegression(featuresCol="features", labelCol="y", regParam=1.0 / max(1, data.count()), standardization=False,
                               maxIter=1000).fit(data)
        beta = m.coefficients.toArray()
        return ProbitModel("logit", reason, beta, float(m.intercept), m.summary.totalIterations, list(range(len(beta))))
