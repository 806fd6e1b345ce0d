"""What-ifs inside the task: the same probabilities as Spark's own scoring, whatever the order of the input."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.models import ensemble as EN
from riskframe.models import estimators as E
from riskframe.models.scorer import MatrixScorer, score_variants
from riskframe.operators import explain as X
from riskframe.sources import fixtures as fx
from tests.conftest import SMALL

SIZES = E.ModelSizes(trees=9, tree_depth=5, boost_rounds=5, boost_depth=3, logit_iter=100, net_epochs=4)


@pytest.fixture(scope="module")
def fitted(spark):
    ens = EN.train_ensemble(fx.applications(spark, SMALL), "app_id", sizes=SIZES)
    scorer = MatrixScorer.of(spark, ens)
    a = fx.applications(spark, SMALL).select("app_id", *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES)
    rows = ens.scaler.transform_vector(ens.encoder.transform(a), "features", "scaled").withColumn("x", vector_to_array("features"))
    return ens, scorer, rows, lambda x, m, n: score_variants(spark, scorer, x, m, n)


def by_spark(ens, df):
    """Ensemble probability of rows (id, features) by Spark's models."""
    return {r["k"]: r["p_ensemble"] for r in EN.ensemble_probability(ens.scaler.transform_vector(df, "features", "scaled"), ens)
            .select("k", "p_ensemble").collect()}


def test_matrix_scorer_equals_sparks_models(spark, fitted):
    ens, scorer, rows, _ = fitted
    got = EN.ensemble_probability(rows, ens).select("x", "p_ensemble", *[f"p_{n}" for n in ens.models]).collect()
    x = np.array([r["x"] for r in got])
    scaled = (x - scorer.mean) / scorer.std
    for n in ens.models:
        assert np.abs(scorer.one(n, scaled) - [r[f"p_{n}"] for r in got]).max() < 1e-9
    assert np.abs(scorer.probability(x) - [r["p_ensemble"] for r in got]).max() < 1e-9
    scorer = MatrixScorer(scorer.mean, scorer.std, scorer.models | {"logit": None})
    assert scorer.one("logit", scaled).tolist() == [0.5] * len(x)


def test_ablation_against_one_row_at_a_time(spark, fitted):
    ens, _, rows, score = fitted
    some = rows.orderBy("app_id").limit(25).select("app_id", "x", "features")
    med = {n: ens.ranges[n]["median"] for n in ens.feature_names}
    # an input in another order in every evaluation, with repeated ids
    shuffled = some.unionByName(some.limit(3)).select("app_id", "x").orderBy(F.rand())
    got = X.encoded_ablation(shuffled, "app_id", ens.feature_names, med, score).collect()
    assert len(got) == 28 * len(ens.feature_names)
    made = [(f"{r['app_id']}:{n}", [float(med[n]) if i == k else v for i, v in enumerate(r["x"])])
            for r in some.collect() for k, n in [(-1, "base"), *enumerate(ens.feature_names)]]
    p = by_spark(ens, spark.createDataFrame(made, "k string, x array<double>").withColumn("features", array_to_vector("x")))
    for r in got:
        assert abs(r["impact"] - (p[f"{r['app_id']}:base"] - p[f"{r['app_id']}:{r['feature']}"])) < 1e-9


def test_recommendations_equal_those_from_raw_columns(spark, fitted):
    ens, _, rows, score = fitted
    a = fx.applications(spark, SMALL).select("app_id", *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES)
    want = {r["app_id"]: (round(r["base_p"], 9), [tuple(x) for x in r["recommendations"]]) for r in X.recommendations(a, "app_id", EN.score_fn(ens)).collect()}
    slots = {b: k for k, (_, b, level) in enumerate(ens.names) if level is None}
    levels = {level: k for k, (_, b, level) in enumerate(ens.names) if b == "historial_pagos"}
    got = {r["app_id"]: (round(r["base_p"], 9), [tuple(x) for x in r["recommendations"]])
           for r in X.encoded_recommendations(rows, "app_id", slots, levels, score).collect()}
    assert got == want


def test_plans_have_no_exchange(spark, fitted):
    ens, _, rows, score = fitted
    ranges = {n: (ens.ranges[n]["min"], ens.ranges[n]["max"]) for n in ens.feature_names}
    med = {n: ens.ranges[n]["median"] for n in ens.feature_names}
    local = spark.createDataFrame([(r["app_id"], r["x"]) for r in rows.limit(20).collect()], "app_id long, x array<double>")
    contribs = F.transform("x", lambda v, i: F.struct(F.get(F.array(*[F.lit(n) for n in ens.feature_names]), i).alias("feature"), v.alias("impact")))
    for df in (X.encoded_ablation(local, "app_id", ens.feature_names, med, score),
               X.encoded_sensitivity(local.withColumn("contribs", contribs), "app_id", ens.feature_names, ranges, score)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.count() > 0


def test_variants_are_scored_by_the_trees_that_test_them(fitted):
    """The same numbers as from scoring every variant whole, with fewer rows and trees walked."""
    from riskframe.models import scorer as SC
    ens, scorer, rows, _ = fitted
    x = np.array([r["x"] for r in rows.select("x").limit(60).collect()])
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 9, len(x))
    counts[5] = 0
    row = np.repeat(np.arange(len(x)), counts)
    variant = np.concatenate([np.arange(c) for c in counts]).astype(int)
    slot = rng.integers(0, x.shape[1], len(row))
    value = np.where(rng.random(len(row)) < 0.3, x[row, slot], x[rng.integers(0, len(x), len(row)), slot])
    twice = rng.random(len(row)) < 0.4  # some variants have two moves
    also = rng.permutation(x.shape[1])[:1][0]
    slot2, value2 = np.full(twice.sum(), also), x[0, also] + 1.0
    keep = slot[twice] != also
    r, v, s = np.r_[row, row[twice][keep]], np.r_[variant, variant[twice][keep]], np.r_[slot, slot2[keep]]
    val = np.r_[value, np.full(keep.sum(), value2)]
    ends = np.cumsum(counts + 1)
    whole = x[np.repeat(np.arange(len(x)), counts + 1)]
    whole[(ends - counts - 1)[r] + 1 + v, s] = val
    scored = []

    class Watched(MatrixScorer):
        def with_variants(self, rows, made, *more):
            scored.append((len(rows), len(made)))
            return super().with_variants(rows, made, *more)
    for models in (scorer.models, scorer.models | {"logit": None, "newton_boosting": None}):
        got, at = SC.variants(Watched(scorer.mean, scorer.std, models), x, r, v, s, val, counts)
        assert (at == ends).all() and np.abs(got - MatrixScorer(scorer.mean, scorer.std, models).probability(whole)).max() < 1e-12
    different = (whole != x[np.repeat(np.arange(len(x)), counts + 1)]).any(axis=1).sum()
    assert scored[0] == (len(x), different) and different < len(row)
    got, at = SC.variants(scorer, x[:0], r[:0], v[:0], s[:0], val[:0], counts[:0])
    assert len(got) == len(at) == 0
    boosted = ens.models["newton_boosting"]
    scaled = (x - scorer.mean) / scorer.std
    assert (boosted.arrays().margin(scaled) == boosted.margin(scaled)).all()
