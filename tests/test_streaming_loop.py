"""The closed loop: a model, labels that arrive later, a retrain, and the swap in the running feed."""

from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.models import ensemble as EN
from riskframe.models import registry as R
from riskframe.plans import jobs
from riskframe.plans import q_streaming as Q
from riskframe.session import scratch_path
from riskframe.sources import fixtures as fx
from tests.conftest import SMALL


def test_labels_retrain_and_swap_the_model(spark):
    sink, reg = Q.closed_loop(spark, SMALL)
    got = {r["app_id"]: r for r in spark.read.parquet(sink).collect()}
    apps = fx.applications(spark, SMALL).select("app_id", "created_at", *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES)
    assert len(got) == apps.count() == spark.read.parquet(sink).count()  # re-sent applications once
    versions = {r["version"]: r["source"] for r in R.read_registry(spark, reg).collect()}
    assert sorted(versions.values()) == ["evaluations", "seed"] and {r["model_version"] for r in got.values()} == set(versions)
    year = {r["app_id"]: r["y"] for r in apps.select("app_id", F.year("created_at").alias("y")).collect()}
    by_source = {s: {year[i] for i, r in got.items() if r["model_source"] == s} for s in versions.values()}
    assert max(by_source["seed"]) < min(by_source["evaluations"])
    scores = {}
    for version in versions:
        batch = EN.score(apps.drop("created_at"), R.load(spark, reg, version), explain=False).collect()
        scores[version] = {r["app_id"]: (r["probability"], r["decision"]) for r in batch}
    assert all((r["probability"], r["decision"]) == scores[r["model_version"]][i] for i, r in got.items())
    one, two = scores.values()
    assert sum(abs(one[i][0] - two[i][0]) > 0.05 for i in one) > len(one) / 2


def test_retraining_joins_its_labels_once(spark, monkeypatch):
    """The gates and the preparation read the written export, not the join of evaluations and labels again."""
    seen, gate = [], jobs.C.check_training_gate
    monkeypatch.setattr(jobs.C, "check_training_gate", lambda d, *a: seen.append(d.inputFiles()) or gate(d, *a))
    ens = jobs.retrain_from_evaluations(spark, fx.evaluations(spark, SMALL), fx.truth_labels(spark, SMALL), scratch_path(spark, "models"),
                                        scratch_path(spark, "registry"), models=("logit",))
    assert ens.n_rows > 0 and seen[0] and all("/exported-" in f for f in seen[0])
