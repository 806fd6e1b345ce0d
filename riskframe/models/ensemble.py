"""Ensemble training, scoring and explanations.

Training (M7): encode -> exact stratified split -> population-std scaler fit
on the training part -> fit + evaluate every model on the test part ->
refit every model on all rows with a full-data scaler.  The encoded frame is
written once (``cut_lineage``) and reused by all fits.

Scoring (M9) is a pure DataFrame transformation (batch or stream): defaults
-> encode -> scale -> one probability column per model -> mean (M8) ->
bands, percent, per-model map, linear contributions (M10) and top factors.
"""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.functions import scoring as SC
from riskframe.models import estimators as E
from riskframe.operators import features as FE
from riskframe.operators import metrics as M
from riskframe.operators.stats import exact_medians
from riskframe.session import cut_lineage


@dataclass
class Ensemble:
    encoder: PipelineModel
    names: list[tuple[str, str, str | None]]
    scaler: FE.ScalerModel
    models: dict[str, object]
    metrics: dict[str, dict[str, float]] = field(default_factory=dict)
    n_rows: int = 0
    n_pos: int = 0
    n_neg: int = 0
    ranges: dict[str, dict[str, float]] = field(default_factory=dict)
    version: str = ""
    trained_at: str = ""
    source: str = "seed"

    @property
    def feature_names(self) -> list[str]:
        return [n for n, _, _ in self.names]

    @property
    def approval_rate(self) -> float:
        return self.n_pos / self.n_rows if self.n_rows else 0.0


def encode(df: DataFrame, encoder: PipelineModel, keep: list[str]) -> DataFrame:
    return encoder.transform(df).select(*keep, "features")


def _prepare(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(id_col, *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES,
                     F.col(S.TARGET).cast("int").alias("label"))


def evaluate(scored: DataFrame, p: str, label: str = "label") -> dict[str, float]:
    """Test-set AUC and accuracy of one probability column."""
    m = M.classification_metrics(scored.select(F.col(p).alias("probability"), F.col(label).alias("label"))).first()
    return {"auc": float(m["auc"]), "accuracy": float(m["accuracy"] or 0.0)}


def feature_ranges(enc: DataFrame, names: list[str]) -> dict[str, dict[str, float]]:
    """Least, largest, mean and median value of every encoded feature."""
    cols = [f"f{i}" for i in range(len(names))]
    wide = enc.select(vector_to_array("features").alias("x")).select(*[F.col("x")[i].alias(c) for i, c in enumerate(cols)])
    agg = wide.agg(*[F.struct(F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean")).alias(c) for c in cols]).first()
    med = exact_medians(wide, cols)
    return {n: {"min": agg[c]["min"], "max": agg[c]["max"], "mean": agg[c]["mean"], "median": float(med[c])} for n, c in zip(names, cols)}


def train_ensemble(df: DataFrame, id_col: str = "app_id", models: tuple[str, ...] = E.ENSEMBLE_MODELS,
                   sizes: E.ModelSizes | None = None, test_fraction: float = 0.2, seed: int = 42,
                   refit: bool = True, source: str = "seed") -> Ensemble:
    """M7: fit, evaluate on a stratified test split, refit on all rows."""
    sizes = sizes or E.ModelSizes()
    data = cut_lineage(_prepare(df, id_col), "labelled")    # read by the encoder, the counts and the split
    counts = data.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("pos")).first()
    encoder = FE.encoder_pipeline(S.NUMERIC_FEATURES, S.CATEGORICAL_FEATURES).fit(data)
    names = FE.feature_names(encoder, S.NUMERIC_FEATURES, S.CATEGORICAL_FEATURES)
    enc = FE.stratified_split(encode(data, encoder, [id_col, "label"]), id_col, "label", test_fraction, seed)
    enc = cut_lineage(enc)                                  # reused by every fit below
    sc_train = FE.fit_vector_scaler(enc.filter(F.col("split") == "train"), "features", [n for n, _, _ in names])
    scaler = FE.fit_vector_scaler(enc, "features", [n for n, _, _ in names]) if refit else sc_train
    # both scalings are written once; the fits and what is read off the data do not depend on each other and run side by side
    both = cut_lineage(scaler.transform_vector(sc_train.transform_vector(enc, output="by_train"), output="by_all")
                       .select(id_col, "label", "split", "by_train", "by_all"), "scaled")
    tr_s, te_s = (both.filter(F.col("split") == s).select(id_col, "label", F.col("by_train").alias("scaled"))
                  for s in ("train", "test"))
    all_s = both.select(id_col, "label", F.col("by_all").alias("scaled"))

    def fit(name, rows):
        model = E.fit(name, tr_s if rows == "train" else all_s, sizes, id_col, seed=seed)
        return model, evaluate(E.probability_of(name, model, te_s), f"p_{name}") if rows == "train" else None

    # the fits of most passes first
    work = [(name, rows) for name in sorted(models, key=lambda n: n not in E.LONGEST) for rows in (("train", "all") if refit else ("train",))]
    with ThreadPoolExecutor(max_workers=len(work) + 1) as pool:
        jobs = {job: pool.submit(fit, *job) for job in work}
        ranges = pool.submit(feature_ranges, enc, [n for n, _, _ in names]).result()
        done = {job: f.result() for job, f in jobs.items()}
    metrics = {name: done[name, "train"][1] for name in models}
    fitted = {name: done[name, "all" if refit else "train"][0] for name in models}
    now = dt.datetime.now(dt.timezone.utc)
    return Ensemble(encoder, names, scaler, fitted, metrics, int(counts["n"]), int(counts["pos"]),
                    int(counts["n"] - counts["pos"]), ranges, now.strftime("v%Y.%m.%d-%H%M"),
                    now.isoformat(timespec="microseconds"), source)


# ---- scoring -------------------------------------------------------------------
def ensemble_probability(df: DataFrame, ens: Ensemble, features: str = "scaled") -> DataFrame:
    """M8: one column per model, their mean as ``p_ensemble``; a missing model counts 0.5."""
    out = df
    cols: list[Column] = []
    for name in E.ENSEMBLE_MODELS if not ens.models else ens.models:
        m = ens.models.get(name)
        if m is None:
            out = out.withColumn(f"p_{name}", F.lit(0.5))
        else:
            out = E.probability_of(name, m, out, features)
        cols.append(F.col(f"p_{name}"))
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return out.withColumn("p_ensemble", total / float(len(cols)))


def logit_contributions(ens: Ensemble, features: str = "scaled") -> Column:
    """ARRAY<STRUCT<feature, impact>> = beta_j * x_scaled_j, |impact| < 1e-6 dropped later."""
    lr = ens.models.get("logit")
    coefs = list(lr.coefficients.toArray()) if lr is not None else [0.0] * len(ens.names)
    x = vector_to_array(F.col(features))
    betas = F.array(*[F.lit(float(b)) for b in coefs])
    names = F.array(*[F.lit(n) for n in ens.feature_names])
    return F.zip_with(F.arrays_zip(names.alias("n"), betas.alias("b")), x,
                      lambda nb, xv: F.struct(nb["n"].alias("feature"), (nb["b"] * xv).alias("impact")))


def importance_contributions(ens: Ensemble, name: str, features: str = "scaled") -> Column:
    """Tree-model contribution = feature importance x input value."""
    imp = list(ens.models[name].featureImportances.toArray())
    x = vector_to_array(F.col(features))
    names = F.array(*[F.lit(n) for n in ens.feature_names])
    w = F.array(*[F.lit(float(v)) for v in imp])
    return F.zip_with(F.arrays_zip(names.alias("n"), w.alias("w")), x,
                      lambda nw, xv: F.struct(nw["n"].alias("feature"), (nw["w"] * xv).alias("impact")))


def score(df: DataFrame, ens: Ensemble, id_col: str = "app_id", explain: bool = True) -> DataFrame:
    """M9: score applications (batch or streaming DataFrame)."""
    raw = FE.apply_defaults(df)
    enc = ens.encoder.transform(raw)
    scaled = ens.scaler.transform_vector(enc, "features", "scaled")
    pr = ensemble_probability(scaled, ens)
    p = F.col("p_ensemble")
    per_model = F.create_map(*[x for n in ens.models for x in (F.lit(n), F.round(F.col(f"p_{n}") * 100.0, 1))])
    out = pr.withColumns({
        "probability": F.round(p, 4),
        "percent": SC.percent(p),
        "risk": SC.risk_band(p),
        "risk_label": SC.risk_label(p),
        "verdict": SC.verdict_text(p),
        "decision": SC.decision_band(p),
        "aprobado": SC.binary_prediction(p),
        "per_model": per_model,
    })
    if explain:
        contribs = logit_contributions(ens)
        out = out.withColumn("_contribs", contribs)
        out = out.withColumn("positive_factors", SC.top_factors("_contribs", 5, positive=True)) \
            .withColumn("negative_factors", SC.top_factors("_contribs", 5, positive=False))
    keep = [c for c in df.columns if c in out.columns]
    extra = ["p_ensemble", "probability", "percent", "risk", "risk_label", "verdict", "decision", "aprobado",
             "per_model"] + ([f"p_{n}" for n in ens.models]) + (["positive_factors", "negative_factors"] if explain else [])
    return out.select(*dict.fromkeys(keep + [c for c in extra if c not in keep]))


def score_fn(ens: Ensemble):
    """Scoring function for the what-if operators: raw columns in, ``p`` out."""
    def fn(df: DataFrame) -> DataFrame:
        enc = ens.encoder.transform(df)
        scaled = ens.scaler.transform_vector(enc, "features", "scaled")
        return ensemble_probability(scaled, ens).withColumnRenamed("p_ensemble", "p") \
            .drop("features", "scaled", *[c for c in enc.columns if c.endswith("__idx") or c.endswith("__ohe")])
    return fn


# ---- learning artefacts (M18, T1, T2, A16) ---------------------------------------
def learning_artefacts(ens: Ensemble) -> DataFrame:
    """(model, artefact, key, value) rows from the fitted models' attributes."""
    rows = []
    lr = ens.models.get("logit")
    if lr is not None:
        for n, b in zip(ens.feature_names, lr.coefficients.toArray()):
            rows.append(("logit", "coefficient", n, float(b)))
        rows.append(("logit", "intercept", "", float(lr.intercept)))
        hist = lr.summary.objectiveHistory if lr.hasSummary else []
        for i, v in enumerate(hist):
            rows.append(("logit", "loss", str(i), float(v)))
        rows.append(("logit", "iterations", "", float(len(hist))))
    for name in ("random_forest", "newton_boosting"):
        m = ens.models.get(name)
        if m is not None:
            for n, v in zip(ens.feature_names, m.featureImportances.toArray()):
                rows.append((name, "importance", n, float(v)))
            rows.append((name, "trees", "", float(m.getNumTrees)))
    net = ens.models.get("neural_net")
    if net is not None:
        for i, v in enumerate(net.loss_curve):
            rows.append(("neural_net", "loss", str(i), float(v)))
        for i, v in enumerate(net.val_loss_curve):
            rows.append(("neural_net", "val_loss", str(i), float(v)))
        rows.append(("neural_net", "iterations", "", float(len(net.loss_curve))))
        rows.append(("neural_net", "parameters", "", float(net.n_params)))
        for i, s in enumerate(net.sizes):
            rows.append(("neural_net", "layer_size", str(i), float(s)))
        if net.loss_curve:
            rows.append(("neural_net", "final_loss", "", float(net.loss_curve[-1])))
    return rows


def artefacts_frame(spark, ens: Ensemble) -> DataFrame:
    return spark.createDataFrame(learning_artefacts(ens), "model string, artefact string, key string, value double")


def top_coefficients(spark, ens: Ensemble, k: int = 14) -> DataFrame:
    """The k logistic coefficients with the largest |beta| (ties: name)."""
    a = artefacts_frame(spark, ens).filter((F.col("model") == "logit") & (F.col("artefact") == "coefficient"))
    return a.select(F.col("key").alias("feature"), F.col("value").alias("coefficient")) \
        .orderBy(F.desc(F.abs("coefficient")), "feature").limit(k)


def top_importances(spark, ens: Ensemble, model: str = "random_forest", k: int = 15) -> DataFrame:
    """The k largest importances of a model (|beta| for the logistic model)."""
    a = artefacts_frame(spark, ens)
    if model == "logit":
        a = a.filter((F.col("model") == "logit") & (F.col("artefact") == "coefficient")) \
            .withColumn("value", F.abs("value"))
    else:
        a = a.filter((F.col("model") == model) & (F.col("artefact") == "importance"))
    return a.select(F.col("key").alias("feature"), F.col("value").alias("importance")) \
        .orderBy(F.desc("importance"), "feature").limit(k)


def importance_by_base(spark, ens: Ensemble, model: str = "random_forest") -> DataFrame:
    """One-hot importances summed back to the base variable (base from the encoder, not a prefix)."""
    base_of = {n: b for n, b, _ in ens.names}
    m = ens.models[model]
    rows = [(base_of[n], float(v)) for n, v in zip(ens.feature_names, m.featureImportances.toArray())]
    d = spark.createDataFrame(rows, "base string, importance double")
    return d.groupBy("base").agg(F.round(F.sum("importance"), 4).alias("importance")).orderBy(F.desc("importance"))


def reference_customer(train_raw: DataFrame, features: list[str]) -> dict[str, float]:
    """The median of every encoded, unscaled feature of the training part."""
    return {c: float(v) for c, v in exact_medians(train_raw, features).items()}


def scored_reference(spark, ens: Ensemble) -> DataFrame:
    """The ensemble's probability for the customer at the median of every encoded feature."""
    x = array_to_vector(F.array(*[F.lit(float(ens.ranges[n]["median"])) for n in ens.feature_names]))
    one = ens.scaler.transform_vector(spark.range(1).select(F.col("id").alias("app_id"), x.alias("features")), "features", "scaled")
    return ensemble_probability(one, ens).select("p_ensemble", *[f"p_{n}" for n in ens.models])
