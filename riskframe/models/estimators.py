"""Estimators of the ensemble and the lab (M1-M4, M6).

Reference sizes are the defaults (200 trees of depth 10; 200 boosting rounds
of depth 6 at rate 0.1; 1000 logistic iterations; probit 200 iterations; lab network
64-32 with ReLU, at most 300 epochs with early stopping).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.models.forest import HistogramForest
from riskframe.models.gelu_net import GeluNetwork
from riskframe.models.newton_boosting import NewtonBoosting
from riskframe.models.probit import Probit

ENSEMBLE_MODELS = ("logit", "random_forest", "newton_boosting", "neural_net")
#: Fits of several hundred passes, each of which waits for the one before.
LONGEST = ("newton_boosting", "neural_net")
#: Models that add their own output column instead of a Spark ML probability vector.
_OWN = ("probit", "random_forest", "newton_boosting", "neural_net", "mlp")


@dataclass
class ModelSizes:
    trees: int = 200
    tree_depth: int = 10
    boost_rounds: int = 200
    boost_depth: int = 6
    boost_rate: float = 0.1
    logit_iter: int = 1000
    probit_iter: int = 200
    net_epochs: int = 240
    mlp_iter: int = 300


def build(name: str, n_rows: int, sizes: ModelSizes, features: str = "scaled", label: str = "label", seed: int = 42):
    """Estimator for ``name``; its probability of class 1 is read with :func:`probability_of`."""
    out = f"_raw_{name}"
    if name == "logit":
        # sklearn's L2 with C=1 on the summed loss == Spark's mean loss with regParam = 1/n
        return LogisticRegression(featuresCol=features, labelCol=label, regParam=1.0 / max(1, n_rows),
                                  elasticNetParam=0.0, standardization=False, maxIter=sizes.logit_iter, tol=1e-6,
                                  probabilityCol=out, rawPredictionCol=f"{out}_r", predictionCol=f"{out}_p")
    if name == "probit":
        return Probit(sizes.probit_iter)
    if name == "random_forest":
        return HistogramForest(sizes.trees, sizes.tree_depth, seed=seed)
    if name == "newton_boosting":
        return NewtonBoosting(sizes.boost_rounds, sizes.boost_depth, sizes.boost_rate)
    if name == "neural_net":
        return GeluNetwork(epochs=sizes.net_epochs, seed=seed)
    if name == "mlp":  # the lab network: its own curve, rate, decay and patience
        return GeluNetwork(epochs=sizes.mlp_iter, lr=0.001, l2=1e-4, batch=200, patience=10, val_fraction=0.1, seed=seed, activation="relu")
    raise ValueError(f"unknown model {name}")


def fit(name: str, train: DataFrame, sizes: ModelSizes, id_col: str, features: str = "scaled",
        label: str = "label", seed: int = 42):
    n = train.count() if name == "logit" else 0
    est = build(name, n, sizes, features, label, seed)
    if name in ("random_forest", "neural_net", "mlp"):
        return est.fit(train, id_col, features, label)
    if name in ("newton_boosting", "probit"):
        return est.fit(train, features, label)
    return est.fit(train.withColumn(label, F.col(label).cast("double")))


def probability_of(name: str, model, df: DataFrame, features: str = "scaled", output: str | None = None) -> DataFrame:
    """Add ``output`` (default ``p_<name>``) = P(class 1) of a fitted model."""
    output = output or f"p_{name}"
    if name in _OWN:
        return model.transform(df, features_col=features, output=output)
    cols = df.columns
    return model.transform(df).select(*cols, vector_to_array(F.col(f"_raw_{name}"))[1].alias(output))
