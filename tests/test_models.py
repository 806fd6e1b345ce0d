"""Model behaviour: metamorphic retrain checks, network health, registry round trip."""

import pytest
from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.models import ensemble as EN
from riskframe.models import estimators as E
from riskframe.models import registry as R
from riskframe.session import scratch_path
from riskframe.sources import fixtures as fx
from tests.conftest import SMALL

SIZES = E.ModelSizes(trees=10, tree_depth=5, boost_rounds=5, boost_depth=3, logit_iter=100, probit_iter=25,
                     net_epochs=15, mlp_iter=30)


@pytest.fixture(scope="module")
def seed_model(spark):
    return EN.train_ensemble(fx.applications(spark, SMALL), "app_id", sizes=SIZES)


def _coef(ens, name):
    return dict(zip(ens.feature_names, ens.models["logit"].coefficients.toArray()))[name]


def test_ensemble_learns(seed_model):
    assert set(seed_model.metrics) == set(E.ENSEMBLE_MODELS)
    assert seed_model.metrics["logit"]["auc"] > 0.75
    assert seed_model.n_pos + seed_model.n_neg == seed_model.n_rows


def test_inverted_income_flips_coefficient_and_adds_category(spark, seed_model):
    inv = EN.train_ensemble(fx.inverted(spark, SMALL), "app_id", sizes=SIZES, source="inverted")
    assert _coef(seed_model, "ingresos_mensuales") > 0 > _coef(inv, "ingresos_mensuales")
    assert "institucion_Cooperativa Nueva" in inv.feature_names
    assert "institucion_Cooperativa Nueva" not in seed_model.feature_names


def test_unseen_category_scores(spark, seed_model):
    one = fx.inverted(spark, SMALL).filter(F.col("institucion") == "Cooperativa Nueva").limit(5) \
        .select("app_id", *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES)
    scored = EN.score(one, seed_model).collect()
    assert all(0.0 <= r["probability"] <= 1.0 for r in scored)


def test_network_loss_decreases_and_no_dead_units(spark, seed_model):
    net = seed_model.models["neural_net"]
    assert net.loss_curve[-1] < net.loss_curve[0]
    a = fx.applications(spark, SMALL).select("app_id", *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES)
    scaled = seed_model.scaler.transform_vector(seed_model.encoder.transform(a), "features", "scaled")
    units = net.unit_statistics(scaled).collect()
    assert len(units) == 96 and all(u["std"] >= 0 and u["mean_abs"] >= 0 for u in units)
    report = {r["layer"]: r for r in net.dead_neuron_report(scaled).collect()}
    assert {k: r["units"] for k, r in report.items()} == {0: 96, 1: 64, 2: 32}
    assert report[0]["dead"] == sum(u["dead"] for u in units) and report[0]["healthy"] == (report[0]["pct_dead"] <= 5.0)
    assert report[0]["healthy"]
    # the statistics against the activations themselves
    acts = [r["a"] for r in net.activations(scaled, output="a").select("a").collect()]
    import numpy as np
    first = np.array([a[0] for a in acts])
    assert np.allclose(first.std(axis=0), [u["std"] for u in units if u["layer"] == 1])
    assert np.allclose(np.abs(first).mean(axis=0), [u["mean_abs"] for u in units if u["layer"] == 1])


@pytest.mark.parametrize("kind", ["gelu", "relu"])
def test_network_gradient_matches_differences(kind):
    import numpy as np
    from riskframe.models import gelu_net as G
    rng = np.random.default_rng(0)
    sizes = [5, 6, 4, 1]
    flat = G.GeluNetwork(hidden=(6, 4)).start(sizes) + 0.1 * rng.standard_normal(6 * 6 + 7 * 4 + 5)
    x, y = rng.standard_normal((7, 5)), (rng.random(7) < 0.5).astype(float)

    def loss(v):
        return G.log_loss_sum(G.layer_outputs(v, sizes, kind, x)[-1][:, 0], y) / 7

    steps = np.array([(loss(flat + 1e-6 * e) - loss(flat - 1e-6 * e)) / 2e-6 for e in np.eye(len(flat))])
    assert np.abs(steps - G.gradient(flat, sizes, kind, x, y)).max() < 1e-7


def test_network_is_close_to_the_linear_model_at_its_own_size(spark):
    from riskframe.operators import features as FE
    from riskframe.operators import metrics as M
    from tests.conftest import MEDIUM
    a = fx.applications(spark, MEDIUM).select("app_id", *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES, F.col("aprobado").cast("int").alias("label"))
    enc = FE.encoder_pipeline(S.NUMERIC_FEATURES, S.CATEGORICAL_FEATURES).fit(a).transform(a).select("app_id", "label", "features")
    rows = EN.cut_lineage(FE.stratified_split(FE.fit_vector_scaler(enc).transform_vector(enc), "app_id", "label", 0.2, 42))
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    auc = {n: M.auc(E.probability_of(n, E.fit(n, train, E.ModelSizes(), "app_id"), test), f"p_{n}").first()["auc"]
           for n in ("logit", "neural_net")}
    assert auc["neural_net"] > auc["logit"] - 0.02 > 0.8


def test_registry_round_trip_and_best_model(spark, seed_model):
    mp, rp = scratch_path(spark, "models"), scratch_path(spark, "registry")
    R.save(spark, seed_model, mp, rp)
    loaded = R.load(spark, rp)
    a = fx.applications(spark, SMALL).select("app_id", *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES)
    p1 = {r["app_id"]: r["probability"] for r in EN.score(a, seed_model, explain=False).collect()}
    p2 = {r["app_id"]: r["probability"] for r in EN.score(a, loaded, explain=False).collect()}
    assert p1 == p2
    best = R.best_model(R.latest(spark, rp)).first()["best_model"]
    assert best == max(seed_model.metrics, key=lambda k: (seed_model.metrics[k]["auc"], [-ord(c) for c in k]))


def test_recommendations_shape(spark, seed_model):
    from riskframe.operators import explain as X
    a = fx.applications(spark, SMALL).select("app_id", *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES)
    recs = X.recommendations(a, "app_id", EN.score_fn(seed_model)).collect()
    assert len(recs) == a.count()
    assert all(1 <= len(r["recommendations"]) <= 4 for r in recs)
