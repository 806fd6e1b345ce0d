"""Model persistence and registry (S11, M22, A15, T6, W4, ST4).

A trained ensemble is saved as Spark ML model folders plus ONE registry row
appended to a Parquet table; the registry row is the commit point: readers
take the newest row (``max_by`` over ``trained_at``), so a half-written model
folder is never picked up.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.models.ensemble import Ensemble
from riskframe.models.forest import ForestModel
from riskframe.models.gelu_net import GeluNetworkModel
from riskframe.models.newton_boosting import NewtonBoostingModel
from riskframe.operators.features import ScalerModel

REGISTRY_SCHEMA = (
    "version string, trained_at string, source string, dataset_size bigint, n_features int, "
    "approval_rate double, n_pos bigint, n_neg bigint, "
    "metrics map<string, struct<auc: double, accuracy: double>>, feature_names array<string>, "
    "feature_bases array<string>, feature_levels array<string>, "
    "ranges map<string, struct<min: double, max: double, mean: double, median: double>>, "
    "scaler_mean array<double>, scaler_std array<double>, models array<string>, "
    "net_sizes array<int>, net_weights array<double>, net_activation string, model_path string")

_TREES = {"random_forest": ForestModel, "newton_boosting": NewtonBoostingModel}


def save(spark: SparkSession, ens: Ensemble, model_path: str, registry_path: str) -> DataFrame:
    """Write model folders, then append the registry row (the commit point)."""
    ens.encoder.write().overwrite().save(f"{model_path}/encoder")
    for name, m in ens.models.items():
        if name in _TREES:
            m.save(spark, f"{model_path}/{name}")
        elif name == "logit":
            m.write().overwrite().save(f"{model_path}/{name}")
    net = ens.models.get("neural_net")
    row = {
        "version": ens.version, "trained_at": ens.trained_at, "source": ens.source,
        "dataset_size": ens.n_rows, "n_features": len(ens.names), "approval_rate": ens.approval_rate,
        "n_pos": ens.n_pos, "n_neg": ens.n_neg,
        "metrics": {k: (v["auc"], v["accuracy"]) for k, v in ens.metrics.items()},
        "feature_names": ens.feature_names, "feature_bases": [b for _, b, _ in ens.names],
        "feature_levels": [lv for _, _, lv in ens.names],
        "ranges": {k: (v["min"], v["max"], v["mean"], v["median"]) for k, v in ens.ranges.items()},
        "scaler_mean": [float(x) for x in ens.scaler.mean], "scaler_std": [float(x) for x in ens.scaler.std],
        "models": list(ens.models),
        "net_sizes": list(net.sizes) if net is not None else None,
        "net_weights": [float(x) for x in net.weights] if net is not None else None,
        "net_activation": net.activation if net is not None else None,
        "model_path": model_path,
    }
    df = spark.createDataFrame([row], REGISTRY_SCHEMA)
    df.write.mode("append").parquet(registry_path)
    return df


def read_registry(spark: SparkSession, registry_path: str) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).parquet(registry_path)


def latest(spark: SparkSession, registry_path: str) -> DataFrame:
    """W4/ST4: the newest registry row (ties: version)."""
    r = read_registry(spark, registry_path)
    return r.agg(F.max_by(F.struct(*r.columns), F.struct("trained_at", "version")).alias("r")).select("r.*")


def load(spark: SparkSession, registry_path: str, version: str | None = None) -> Ensemble:
    """Load the newest ensemble, or that of ``version``; a model folder that cannot be read is left out (scores 0.5)."""
    rows = latest(spark, registry_path) if version is None else read_registry(spark, registry_path).filter(F.col("version") == version)
    r = rows.first()
    path = r["model_path"]
    encoder = PipelineModel.load(f"{path}/encoder")
    models: dict[str, object] = {}
    for name in r["models"]:
        if name == "neural_net":
            models[name] = GeluNetworkModel(list(r["net_sizes"]), np.asarray(r["net_weights"]), r["net_activation"])
            continue
        try:
            models[name] = _TREES[name].load(spark, f"{path}/{name}") if name in _TREES else LogisticRegressionModel.load(f"{path}/{name}")
        except Exception as e:  # noqa: BLE001 - a broken model must not stop scoring, but it is said
            warnings.warn(f"model {name} of {r['version']} cannot be read and scores 0.5: {str(e)[:200]}", stacklevel=2)
            models[name] = None
    names = list(zip(r["feature_names"], r["feature_bases"], r["feature_levels"]))
    scaler = ScalerModel(list(r["feature_names"]), list(r["scaler_mean"]), list(r["scaler_std"]))
    metrics = {k: {"auc": v["auc"], "accuracy": v["accuracy"]} for k, v in (r["metrics"] or {}).items()}
    ranges = {k: v.asDict() for k, v in (r["ranges"] or {}).items()}
    return Ensemble(encoder, names, scaler, models, metrics, r["dataset_size"], r["n_pos"], r["n_neg"], ranges,
                    r["version"], r["trained_at"], r["source"])


def ranked_models(registry_row: DataFrame) -> DataFrame:
    """Models of a registry row ranked by test AUC (ties: name), best flagged."""
    m = registry_row.select("version", F.explode("metrics").alias("model", "m")) \
        .select("version", "model", F.col("m.auc").alias("auc"), F.col("m.accuracy").alias("accuracy"))
    from pyspark.sql import Window
    w = Window.partitionBy("version").orderBy(F.desc("auc"), "model")  # a handful of models per version
    return m.withColumn("rank", F.row_number().over(w)).withColumn("best", F.col("rank") == 1)


def best_model(registry_row: DataFrame) -> DataFrame:
    """Arg-max of AUC (explicit tie-break: alphabetically first model)."""
    m = registry_row.select("version", F.explode("metrics").alias("model", "m"))
    return m.groupBy("version").agg(
        F.min_by("model", F.struct(-F.col("m.auc"), F.col("model"))).alias("best_model"),
        F.max("m.auc").alias("best_auc"),
        F.min_by("m.accuracy", F.struct(-F.col("m.auc"), F.col("model"))).alias("best_accuracy"))


def summary(registry_row: DataFrame) -> DataFrame:
    """Version, training date, size, best algorithm with its AUC and accuracy, source, approval rate, class
    distribution, n_features, metrics JSON."""
    b = best_model(registry_row)
    return registry_row.join(b, "version").select(
        "version", "trained_at", "dataset_size", "best_model", "best_auc", "best_accuracy", "source",
        F.create_map(F.lit("0"), "n_neg", F.lit("1"), "n_pos").alias("class_distribution"),
        F.round("approval_rate", 4).alias("approval_rate"), "n_features", F.to_json("metrics").alias("metrics"))
