"""Model queries.

Outputs of fitted models have no SQL twin (the driver checks them rows-only), except where SQL can tell
what a right fit must give: M1 (the fitted moments equal the observed ones), M4b (small boosted trees, grown
again in SQL), M16, F7 and X2.  All other fits run at the reference sizes (``ModelSizes()``).
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.models import ensemble as EN
from riskframe.models import estimators as E
from riskframe.models import registry as R
from riskframe.models import tree_nodes as TN
from riskframe.models.newton_boosting import NewtonBoosting
from riskframe.models.scorer import MatrixScorer, score_variants
from riskframe.operators import explain as X
from riskframe.operators import features as FE
from riskframe.plans import jobs
from riskframe.plans.boosting_sql import boosting_ctes
from riskframe.plans.registry import query
from riskframe.session import cut_lineage, scratch_path
from riskframe.sources import fixtures as fx

_CACHE: dict = {}


def _split_scaled(spark, sf):
    """Encoded, split and scaled applications (cached per session and scale factor)."""
    key = ("split", spark.sparkContext.applicationId, sf)
    if key not in _CACHE:
        a = fx.applications(spark, sf).select("app_id", *S.REQUIRED_COLUMNS) \
            .withColumn("label", F.col(S.TARGET).cast("int"))
        enc_model = FE.encoder_pipeline(S.NUMERIC_FEATURES, S.CATEGORICAL_FEATURES).fit(a)
        names = FE.feature_names(enc_model, S.NUMERIC_FEATURES, S.CATEGORICAL_FEATURES)
        enc = EN.cut_lineage(FE.stratified_split(enc_model.transform(a).select("app_id", "label", "features"),
                                                 "app_id", "label", 0.2, 42))
        train = enc.filter(F.col("split") == "train")
        sc = FE.fit_vector_scaler(train, "features", [n for n, _, _ in names])
        _CACHE[key] = (sc.transform_vector(train), sc.transform_vector(enc.filter(F.col("split") == "test")), names)
    return _CACHE[key]


def _ensemble(spark, sf) -> EN.Ensemble:
    key = ("ens", spark.sparkContext.applicationId, sf)
    if key not in _CACHE:
        _CACHE[key] = EN.train_ensemble(fx.applications(spark, sf), "app_id")
    return _CACHE[key]


def _registry(spark, sf):
    key = ("reg", spark.sparkContext.applicationId, sf)
    if key not in _CACHE:
        ens = _ensemble(spark, sf)
        mp, rp = scratch_path(spark, "models"), scratch_path(spark, "registry")
        R.save(spark, ens, mp, rp)
        _CACHE[key] = (mp, rp)
    return _CACHE[key]


def _fitted(spark, sf, name):
    """A model fitted on the training part."""
    key = ("fit", name, spark.sparkContext.applicationId, sf)
    if key not in _CACHE:
        _CACHE[key] = E.fit(name, _split_scaled(spark, sf)[0], E.ModelSizes(), "app_id")
    return _CACHE[key]


def _single_model(name):
    def fn(spark, sf):
        _, test, _ = _split_scaled(spark, sf)
        m = _fitted(spark, sf, name)
        return E.probability_of(name, m, test).select("app_id", "label", F.col(f"p_{name}").alias("probability"))
    return fn


for _qid, _name in [("M3", "random_forest"), ("M4", "newton_boosting"), ("M5", "neural_net"), ("M6", "mlp")]:
    query(_qid)(_single_model(_name))


def _moments_sql() -> tuple[str, dict[str, str]]:
    """Sum of label x scaled feature over the training part, with the encoding and scaling of the ensemble."""
    from riskframe.functions.hashing import unit_hash_sql as H
    from riskframe.plans.sqlgen import q
    cols = {n: f"CAST({n} AS DOUBLE)" for n in S.NUMERIC_FEATURES} | {
        f"{c}_{v}": f"CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END" for c in S.CATEGORICAL_FEATURES for v in sorted(S.DOMAINS[c])}
    ctes = {
        "m_rows": f"SELECT app_id, aprobado, {', '.join(f'{e} AS {q(n)}' for n, e in cols.items())} FROM applications",
        "m_split": f"""SELECT * FROM m_rows QUALIFY row_number() OVER (PARTITION BY aprobado ORDER BY {H('app_id', 42)}, app_id)
                 > round(0.2 * count(*) OVER (PARTITION BY aprobado))""",
        "m_stats": "SELECT " + ", ".join(f"avg({q(n)}) AS {q('m_' + n)}, coalesce(nullif(stddev_pop({q(n)}), 0), 1.0) AS {q('s_' + n)}"
                                         for n in cols) + " FROM m_split",
    }
    each = " UNION ALL ".join(f"SELECT '{n}' AS feature, aprobado * ({q(n)} - {q('m_' + n)}) / {q('s_' + n)} AS v FROM m_split, m_stats"
                              for n in cols)
    return f"""SELECT feature, CAST(count(*) AS BIGINT) AS n_train, round(sum(v), 2) + 0.0 AS moment
        FROM ({each} UNION ALL SELECT 'intercept', aprobado FROM m_split) GROUP BY feature""", ctes


_M1_BODY, _M1_CTES = _moments_sql()


@query("M1", _M1_BODY, _M1_CTES)
def m1_logistic_moments(spark, sf):
    """The fitted model's moments on its training rows: sum of p x, plus the L2 term's share, per feature.

    At the optimum they equal the observed sums of y x, which SQL computes without a model."""
    train, _, names = _split_scaled(spark, sf)
    m = _fitted(spark, sf, "logit")
    p = E.probability_of("logit", m, train).select(vector_to_array("scaled").alias("x"), F.col("p_logit").alias("p"))
    feats = [n for n, _, _ in names]
    sums = p.agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), *[F.sum(F.col("p") * F.col("x")[j]).alias(f"s{j}") for j in range(len(feats))])
    beta = m.coefficients.toArray()
    rows = [F.struct(F.lit(f).alias("feature"), (F.col(f"s{j}") + float(beta[j])).alias("v")) for j, f in enumerate(feats)]
    rows.append(F.struct(F.lit("intercept").alias("feature"), F.col("s").alias("v")))
    return sums.select("n", F.explode(F.array(*rows)).alias("r")).select(
        "r.feature", F.col("n").alias("n_train"), (F.round("r.v", 2) + F.lit(0.0)).alias("moment"))


@query("M2")
def m2_probit(spark, sf):
    """Probit on the lab encoding (first level of each category dropped), with the model that was used."""
    key = ("probit", spark.sparkContext.applicationId, sf)
    train, test, names = _split_scaled(spark, sf)
    if key not in _CACHE:
        _CACHE[key] = E.fit("probit", FE.drop_first_level(train, names, "scaled", "scaled")[0], E.ModelSizes(), "app_id")
    m = _CACHE[key]
    return m.transform(FE.drop_first_level(test, names, "scaled", "scaled")[0], "scaled", "probability").select(
        "app_id", "label", "probability", F.lit(m.used).alias("used"), F.lit(m.reason).alias("reason"))


@query("M7")
def m7_train_evaluate_refit(spark, sf):
    ens = _ensemble(spark, sf)
    rows = [(k, v["auc"], v["accuracy"]) for k, v in ens.metrics.items()]
    return spark.createDataFrame(rows, "model string, auc double, accuracy double")


@query("M8")
def m8_ensemble_probability(spark, sf):
    ens = _ensemble(spark, sf)
    return EN.score(fx.applications(spark, sf).select("app_id", *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES),
                    ens, explain=False).select("app_id", "p_ensemble", *[f"p_{n}" for n in ens.models])


@query("M9")
def m9_score_applications(spark, sf):
    ens = _ensemble(spark, sf)
    return EN.score(fx.applications(spark, sf).select("app_id", "user_id", *S.NUMERIC_FEATURES,
                                                      *S.CATEGORICAL_FEATURES), ens)


def _scored_with(spark, sf, contribs_fn):
    ens = _ensemble(spark, sf)
    a = fx.applications(spark, sf).select("app_id", *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES)
    enc = ens.encoder.transform(a)
    sc = ens.scaler.transform_vector(enc, "features", "scaled")
    return sc.select("app_id", contribs_fn(ens).alias("contribs"))


@query("M10")
def m10_linear_contributions(spark, sf):
    return X.factors_table(_scored_with(spark, sf, EN.logit_contributions), "app_id", "contribs", 5)


@query("M11")
def m11_tree_contributions(spark, sf):
    t = _scored_with(spark, sf, lambda e: EN.importance_contributions(e, "random_forest"))
    return X.factors_table(t, "app_id", "contribs", 5)


def _encoded(spark, sf):
    """All rows as encoded values, with the linear contributions that rank them."""
    ens = _ensemble(spark, sf)
    a = fx.applications(spark, sf).select("app_id", *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES)
    enc = ens.scaler.transform_vector(ens.encoder.transform(a), "features", "scaled")
    return ens, enc.select("app_id", vector_to_array("features").alias("x"), EN.logit_contributions(ens).alias("contribs"))


def _variants(spark, sf):
    """Scoring of rows' variants with the ensemble (its arrays are made once per session)."""
    key = ("scorer", spark.sparkContext.applicationId, sf)
    if key not in _CACHE:
        _CACHE[key] = MatrixScorer.of(spark, _ensemble(spark, sf))
    return lambda x, moves, count: score_variants(spark, _CACHE[key], x, moves, count)


@query("M12")
def m12_ablation(spark, sf):
    ens, rows = _encoded(spark, sf)
    med = {n: ens.ranges[n]["median"] for n in ens.feature_names}
    return X.encoded_ablation(rows.drop("contribs"), "app_id", ens.feature_names, med, _variants(spark, sf))


@query("M13")
def m13_sensitivity(spark, sf):
    ens, rows = _encoded(spark, sf)
    ranges = {n: (ens.ranges[n]["min"], ens.ranges[n]["max"]) for n in ens.feature_names}
    return X.encoded_sensitivity(rows, "app_id", ens.feature_names, ranges, _variants(spark, sf))


@query("M14")
def m14_recommendations(spark, sf):
    ens = _ensemble(spark, sf)
    a = fx.applications(spark, sf).select("app_id", *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES)
    rows = ens.encoder.transform(a).select("app_id", "creditos_activos", "historial_pagos", vector_to_array("features").alias("x"))
    slots = {b: k for k, (_, b, level) in enumerate(ens.names) if level is None}
    levels = {level: k for k, (_, b, level) in enumerate(ens.names) if b == "historial_pagos"}
    return X.encoded_recommendations(rows, "app_id", slots, levels, _variants(spark, sf))


_M16_ROWS = " UNION ALL ".join(
    f"SELECT '{n}' AS feature, round(median(\"{n}\"), 6) AS median FROM lab_split WHERE split = 'train'"
    for n in S.NUMERIC_FEATURES + [f"{c}_{v}" for c in S.CATEGORICAL_FEATURES for v in sorted(S.DOMAINS[c])[1:]])


@query("M18")
def m18_learning_artefacts(spark, sf):
    return EN.artefacts_frame(spark, _ensemble(spark, sf))


@query("T1")
def t1_top_coefficients(spark, sf):
    return EN.top_coefficients(spark, _ensemble(spark, sf), 14)


@query("T2")
def t2_top_importances(spark, sf):
    return EN.top_importances(spark, _ensemble(spark, sf), "random_forest", 15)


@query("A16")
def a16_importance_by_base(spark, sf):
    return EN.importance_by_base(spark, _ensemble(spark, sf), "random_forest")


def _scaled_as_trained(spark, sf):
    """All rows, encoded and scaled as the refitted models saw them."""
    ens = _ensemble(spark, sf)
    a = fx.applications(spark, sf).select("app_id", *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES)
    return ens, ens.scaler.transform_vector(ens.encoder.transform(a), "features", "scaled").select("app_id", "scaled")


@query("M19")
def m19_dead_neurons(spark, sf):
    ens, rows = _scaled_as_trained(spark, sf)
    return ens.models["neural_net"].dead_neuron_report(rows)


@query("M20")
def m20_activations(spark, sf):
    ens, rows = _scaled_as_trained(spark, sf)
    acts = ens.models["neural_net"].activations(rows)
    return acts.select("app_id", "activations", F.element_at(F.element_at("activations", -1), 1).alias("output"))


@query("M21")
def m21_tree_table(spark, sf):
    mp, _ = _registry(spark, sf)
    names = F.array(*[F.lit(n) for n in _ensemble(spark, sf).feature_names])
    forest = TN.first_levels(TN.forest_nodes(spark, f"{mp}/random_forest")).select(
        F.lit("random_forest").alias("model"), "tree", "node", "depth", F.col("n").alias("samples"), "class_0", "class_1",
        F.try_divide("class_1", F.col("class_0") + F.col("class_1")).alias("probability"), "feature", "threshold", "leaf",
        F.lit(None).cast("double").alias("weight"))
    boosted = TN.first_levels(spark.read.parquet(f"{mp}/newton_boosting/nodes")).select(
        F.lit("newton_boosting").alias("model"), "tree", "node", "depth", F.col("n").alias("samples"),
        *[F.lit(None).cast("double").alias(c) for c in ("class_0", "class_1", "probability")], "feature", "threshold", "leaf", "weight")
    return forest.unionByName(boosted).withColumn("feature", F.get(names, F.col("feature")))


_BOOST_FEATURES = {"edad": "edad", "banda_ingresos": "floor(ingresos_mensuales / 100)", "cargas_familiares": "cargas_familiares",
                   "creditos_activos": "creditos_activos"} | {
    f"{c}_{v}": f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END" for c in S.CATEGORICAL_FEATURES for v in sorted(S.DOMAINS[c])}
_BOOST = {"rounds": 2, "depth": 3, "rate": 0.1, "reg_lambda": 1.0, "least_hessian": 1.0}
_BOOST_ROWS = f"SELECT app_id, aprobado AS y, [{', '.join(f'CAST({e} AS DOUBLE)' for e in _BOOST_FEATURES.values())}] AS x FROM applications"
_BOOST_NAMES = "[" + ", ".join(f"'{n}'" for n in _BOOST_FEATURES) + "]"


@query("M4b", f"""
SELECT CAST(tree AS INTEGER) AS tree, CAST(node AS INTEGER) AS node, CAST(depth AS INTEGER) AS depth, {_BOOST_NAMES}[f + 1] AS feature,
       threshold, CAST(n AS BIGINT) AS n, round(G, 6) + 0.0 AS G, round(H, 6) AS H, gain, round(weight, 6) + 0.0 AS weight
FROM grown""", boosting_ctes(_BOOST_ROWS, **_BOOST))
def m4b_newton_trees(spark, sf):
    """Two rounds of boosting on features of few values: every node with its gradients, gain and Newton weight."""
    a = fx.applications(spark, sf).select("app_id", array_to_vector(F.array(*[F.expr(e).cast("double") for e in _BOOST_FEATURES.values()]))
                                          .alias("scaled"), F.col(S.TARGET).alias("label"))
    names = F.array(*[F.lit(n) for n in _BOOST_FEATURES])
    nodes = NewtonBoosting(**_BOOST, bins=255).fit(cut_lineage(a, "boost-rows")).node_table(spark)
    return nodes.select("tree", "node", "depth", F.get(names, F.col("feature")).alias("feature"), "threshold", "n",
                        (F.round("G", 6) + F.lit(0.0)).alias("G"), F.round("H", 6).alias("H"), "gain",
                        (F.round("weight", 6) + F.lit(0.0)).alias("weight"))


@query("S11")
def s11_persist_and_load(spark, sf):
    _, rp = _registry(spark, sf)
    loaded = R.load(spark, rp)
    a = fx.applications(spark, sf).select("app_id", *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES)
    return EN.score(a, loaded, explain=False).select("app_id", "probability", "decision")


@query("M22")
def m22_registry_summary(spark, sf):
    _, rp = _registry(spark, sf)
    return R.summary(R.latest(spark, rp))


@query("A15")
def a15_best_model(spark, sf):
    _, rp = _registry(spark, sf)
    return R.best_model(R.latest(spark, rp))


@query("T6")
def t6_ranked_models(spark, sf):
    _, rp = _registry(spark, sf)
    return R.ranked_models(R.latest(spark, rp))


@query("M23")
def m23_model_report(spark, sf):
    _, rp = _registry(spark, sf)
    t = jobs.report_tables(R.latest(spark, rp), fx.applications(spark, sf))
    f = t["fairness"].select(F.lit("fairness").alias("table"), F.col("dimension").alias("key"),
                             F.col("group_value").alias("item"), F.col("rate").alias("value"))
    d = t["disparity"].select(F.lit("disparity").alias("table"), F.col("dimension").alias("key"),
                              F.col("band").alias("item"), F.col("disparity_pts").alias("value"))
    m = t["models"].select(F.lit("models").alias("table"), F.col("model").alias("key"),
                           F.col("rank").cast("string").alias("item"), F.col("auc").alias("value"))
    return f.unionByName(d).unionByName(m)


@query("M24")
def m24_retrain_from_evaluations(spark, sf):
    ens = jobs.retrain_from_evaluations(spark, fx.evaluations(spark, sf), fx.truth_labels(spark, sf),
                                        scratch_path(spark, "models"), scratch_path(spark, "registry"))
    rows = [(k, v["auc"], v["accuracy"], ens.n_rows, ens.source) for k, v in ens.metrics.items()]
    return spark.createDataFrame(rows, "model string, auc double, accuracy double, dataset_size bigint, source string")


def _f7_sql() -> tuple[str, dict[str, str]]:
    from riskframe.functions.hashing import unit_hash_sql as H
    from riskframe.plans.sqlgen import q
    dummies = [(c, v) for c in S.CATEGORICAL_FEATURES for v in sorted(S.DOMAINS[c])[1:]]
    feats = S.NUMERIC_FEATURES + [f"{c}_{v}" for c, v in dummies]
    wide = ", ".join([f"CAST({c} AS DOUBLE) AS {c}" for c in S.NUMERIC_FEATURES] +
                     [f"CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END AS {q(f'{c}_{v}')}" for c, v in dummies])
    ctes = {
        "lab": f"SELECT app_id, aprobado, {wide} FROM applications",
        "lab_split": f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY aprobado ORDER BY {H('app_id', 42)}, app_id)
                 <= round(0.2 * count(*) OVER (PARTITION BY aprobado)) THEN 'test' ELSE 'train' END AS split FROM lab""",
        "lab_stats": "SELECT " + ", ".join(
            f"avg({q(f)}) AS {q('m_' + f)}, coalesce(nullif(stddev_pop({q(f)}), 0), 1.0) AS {q('s_' + f)}"
            for f in feats) + " FROM lab_split WHERE split = 'train'",
    }
    body = "SELECT app_id, aprobado, split, " + ", ".join(
        f"round(({q(f)} - {q('m_' + f)}) / {q('s_' + f)}, 6) AS {q(f)}" for f in feats) + " FROM lab_split, lab_stats"
    return body, ctes


_F7_BODY, _F7_CTES = _f7_sql()


@query("F7", _F7_BODY, _F7_CTES)
def f7_lab_preprocess(spark, sf):
    d = fx.applications(spark, sf).select("app_id", *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES, "aprobado")
    lab = jobs.prepare_lab(d, "aprobado", "app_id")
    out = lab.train.unionByName(lab.test)
    return out.withColumns({c: F.round(c, 6) for c in lab.feature_names})


@query("M16", _M16_ROWS, _F7_CTES)
def m16_reference_customer(spark, sf):
    """The reference customer: median of every unscaled feature of the lab's training part."""
    lab = jobs.prepare_lab(fx.applications(spark, sf).select("app_id", *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES, "aprobado"),
                           "aprobado", "app_id")
    med = EN.reference_customer(lab.train_raw, lab.feature_names)
    return spark.createDataFrame([(n, round(v, 6)) for n, v in med.items()], "feature string, median double")


@query("X2", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", {c} AS value, CAST(count(*) AS BIGINT) AS n FROM inverted
WHERE {c} NOT IN (SELECT DISTINCT {c} FROM applications WHERE {c} IS NOT NULL) GROUP BY {c}""" for c in S.CATEGORICAL_FEATURES))
def x2_unseen_categories(spark, sf):
    def pairs(df):
        return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))
                                             for c in S.CATEGORICAL_FEATURES])).alias("x")).select("x.column", "x.value")
    seen = pairs(fx.applications(spark, sf)).distinct()
    new = pairs(fx.inverted(spark, sf)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return new.filter(F.col("value").isNotNull()).join(seen, ["column", "value"], "left_anti").select("column", "value", "n")
