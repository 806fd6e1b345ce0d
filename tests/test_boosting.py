"""Second-order boosting and the node table: by hand, by brute force, and scored again in DuckDB."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.models import ensemble as EN
from riskframe.models import estimators as E
from riskframe.models import newton_boosting as NB
from riskframe.models import tree_nodes as TN
from riskframe.operators import features as FE
from riskframe.operators import metrics as M
from riskframe.session import cut_lineage, scratch_path
from riskframe.sources import fixtures as fx
from tests.conftest import SMALL


def frame(spark, x, y):
    rows = [(k, [float(v) for v in r], float(c)) for k, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x array<double>, label double").withColumn("scaled", array_to_vector("x"))


@pytest.fixture(scope="module")
def split(spark):
    a = fx.applications(spark, SMALL).select("app_id", *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES, F.col(S.TARGET).alias("label"))
    enc = FE.encoder_pipeline(S.NUMERIC_FEATURES, S.CATEGORICAL_FEATURES).fit(a).transform(a).select("app_id", "label", "features")
    rows = cut_lineage(FE.stratified_split(FE.fit_vector_scaler(enc).transform_vector(enc), "app_id", "label", 0.2, 42))
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


def brute_tree(x, g, h, depth, reg, least):
    """(prediction per row): the tree grown by trying every threshold of every feature at every node."""
    out = np.zeros(len(g))

    def grow(rows, d):
        G, H = g[rows].sum(), h[rows].sum()
        best = (0.0, 0, 0.0)
        for j in range(x.shape[1]) if d < depth else ():
            values = np.unique(x[:, j])
            for t in (values[:-1] + values[1:]) / 2:
                left = x[rows, j] <= t
                gl, hl = g[rows][left].sum(), h[rows][left].sum()
                if left.any() and not left.all() and min(hl, H - hl) >= least:
                    gain = round(0.5 * (gl ** 2 / (hl + reg) + (G - gl) ** 2 / (H - hl + reg) - G ** 2 / (H + reg)), NB.GAIN_DIGITS)
                    if gain > best[0]:
                        best = (gain, j, t)
        if best[0] > 0:
            left = x[rows, best[1]] <= best[2]
            grow(rows[left], d + 1)
            grow(rows[~left], d + 1)
        else:
            out[rows] = -G / (H + reg)
    grow(np.arange(len(g)), 0)
    return out


@pytest.mark.parametrize("partitions,merged", [(1, 1 << 25), (5, 0)])
def test_boosting_against_brute_force(spark, monkeypatch, partitions, merged):
    monkeypatch.setattr(NB, "MERGED_HERE", merged)
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 7, 300), rng.integers(0, 2, 300), rng.integers(0, 25, 300) / 4, np.ones(300)])
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 3 + x[:, 1] * x[:, 2] / 2)))).astype(float)
    m = NB.NewtonBoosting(rounds=5, depth=3, rate=0.3, bins=40, write_every=2, partitions=partitions).fit(frame(spark, x, y))
    margin = np.full(300, math.log(y.mean() / (1 - y.mean())))
    for _ in range(5):
        p = 1 / (1 + np.exp(-margin))
        margin = margin + 0.3 * brute_tree(x, p - y, p * (1 - p), 3, 1.0, 1.0)
    assert np.allclose(m.margin(x), margin, atol=1e-9)
    for r in m.node_table(spark).collect():
        assert r["weight"] == pytest.approx(-r["G"] / (r["H"] + 1.0))
    assert m.featureImportances.toArray()[3] == 0 and m.featureImportances.toArray().sum() == pytest.approx(1)


def test_dummies_share_a_column_and_grow_the_same_trees(spark):
    """Dummies of one category cost one sum a pass; two that meet in a row stay apart; a column of one value costs nothing."""
    rng = np.random.default_rng(9)
    kind, other = rng.integers(0, 5, 400), rng.integers(0, 2, 400)
    x = np.column_stack([rng.integers(0, 9, 400), *[kind == k for k in range(5)], other, 1 - other, np.ones(400)]).astype(float)
    x[0, 6:8] = 1  # one row says both
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 4 + 2 * x[:, 2] - x[:, 4] + x[:, 6])))).astype(float)
    bins = np.array([len(np.unique(v)) for v in x.T])
    above = (x > x.min(axis=0)).astype(int)
    columns = NB.Columns.of(bins, above.T @ above)
    assert columns.column.tolist() == [0, 1, 1, 1, 1, 1, 2, 3, 1] and columns.first.tolist() == [0, 9, 16, 18, 20]
    raw = np.stack([np.searchsorted(np.unique(v), v) for v in x.T]).astype(np.uint8)
    stored, first = columns.stored(raw), np.r_[0, np.cumsum(bins)]
    sums = np.concatenate([np.bincount(c, y, int(n)) for c, n in zip(stored, np.diff(columns.first))])
    assert np.allclose(columns.spread(sums, first), np.concatenate([np.bincount(b, y, int(n)) for b, n in zip(raw, bins)]))
    m = NB.NewtonBoosting(rounds=6, depth=3, rate=0.3, bins=40, write_every=2, partitions=3).fit(frame(spark, x, y))
    margin = np.full(400, math.log(y.mean() / (1 - y.mean())))
    for t in m.trees:
        p = 1 / (1 + np.exp(-margin))
        margin = margin + 0.3 * brute_tree(x, p - y, p * (1 - p), 3, 1.0, 1.0)
        assert (columns.walk(t, stored, 3) == t.walk(raw.T, 3)).all()
    assert np.allclose(m.margin(x), margin, atol=1e-9)


def test_a_pass_grows_two_levels_where_rows_are_few(spark, monkeypatch):
    """(F2-F7, F10, F11, F15, F19-F22) Sums by pairs of columns halve the passes and give the same trees."""
    rng = np.random.default_rng(12)
    kind = rng.integers(0, 4, 500)
    x = np.column_stack([rng.integers(0, 9, 500), *[kind == k for k in range(4)], rng.integers(0, 30, 500), np.ones(500)]).astype(float)
    y = (rng.random(500) < 1 / (1 + np.exp(-(x[:, 0] - 4 + x[:, 2] * x[:, 5] / 9 - x[:, 4])))).astype(float)
    passes, added = [], NB.B.added
    monkeypatch.setattr(NB.B, "added", lambda *a: passes.append(a[1]) or added(*a))
    found = {}
    for paired in (NB.PAIRED, -1):
        monkeypatch.setattr(NB, "PAIRED", paired)
        passes.clear()
        found[paired] = NB.NewtonBoosting(rounds=3, depth=5, rate=0.3, bins=40, partitions=4).fit(frame(spark, x, y)).trees, len(passes) - 1
    (two, fewer), (one, more) = found.values()
    assert (fewer, more) == (3 * 3, 3 * 5)
    assert [(t.feature, t.bin, t.left, t.right, t.depth, t.n) for t in two] == [(t.feature, t.bin, t.left, t.right, t.depth, t.n) for t in one]
    assert all(np.allclose(a.G, b.G) and np.allclose(a.H, b.H) and np.allclose(a.gain, b.gain, atol=1e-5) for a, b in zip(two, one))


def test_all_fits_of_the_ensemble_run_side_by_side(spark, monkeypatch):
    """(F2-F7, F10, F11, F15, F19-F22) No fit waits for another one to end."""
    import threading
    together, fit = threading.Barrier(2 * len(E.ENSEMBLE_MODELS), timeout=120), E.fit

    def meeting(*args, **more):
        together.wait()
        return fit(*args, **more)
    monkeypatch.setattr(EN.E, "fit", meeting)
    sizes = E.ModelSizes(trees=3, tree_depth=2, boost_rounds=2, boost_depth=2, logit_iter=20, net_epochs=2)
    ens = EN.train_ensemble(fx.applications(spark, SMALL), "app_id", sizes=sizes)
    assert list(ens.models) == list(ens.metrics) == list(E.ENSEMBLE_MODELS)


def test_boosting_learns_as_first_order_trees_do_and_saves(spark, split):
    from pyspark.ml.classification import GBTClassifier
    train, test = split
    m = NB.NewtonBoosting(rounds=40, depth=4).fit(train)
    first = GBTClassifier(featuresCol="scaled", labelCol="label", maxIter=40, maxDepth=4, stepSize=0.1).fit(train)
    ours = M.auc(m.transform(test, output="p"), "p").first()["auc"]
    theirs = M.auc(first.transform(test).select("label", vector_to_array("probability")[1].alias("p")), "p").first()["auc"]
    assert ours > theirs - 0.02 > 0.7
    path = scratch_path(spark, "boost")
    m.save(spark, path)
    again = NB.NewtonBoostingModel.load(spark, path)
    x = np.array([r["x"] for r in test.select(vector_to_array("scaled").alias("x")).collect()])
    assert (again.margin(x) == m.margin(x)).all() and again.rows() == m.rows()


def test_one_class_constant_features_and_no_rows(spark):
    m = NB.NewtonBoosting(rounds=2, depth=2).fit(frame(spark, [[1, 2]] * 9, [1] * 9))
    assert all(len(t.feature) == 1 for t in m.trees) and (m.margin(np.ones((1, 2))) > 13).all()
    with pytest.raises(ValueError):
        NB.NewtonBoosting(rounds=1).fit(frame(spark, [], []))


def test_node_tables_score_the_same_everywhere(spark, split):
    """Spark's own scoring, the joins on the node table and DuckDB on the written table agree."""
    train, test = split
    sizes = E.ModelSizes(trees=7, tree_depth=5, boost_rounds=6, boost_depth=4)
    forest, boosted = E.fit("random_forest", train, sizes, "app_id"), E.fit("newton_boosting", train, sizes, "app_id")
    path = scratch_path(spark, "trees")
    forest.write().overwrite().save(f"{path}/forest")
    boosted.save(spark, f"{path}/boosted")
    rows = test.select("app_id", vector_to_array("scaled").alias("x"))
    nodes = {"forest": TN.forest_nodes(spark, f"{path}/forest"), "boosted": spark.read.parquet(f"{path}/boosted/nodes")}
    expected = {"forest": E.probability_of("random_forest", forest, test, output="p"), "boosted": boosted.transform(test, output="p")}
    joined = {"forest": TN.forest_probability(rows, nodes["forest"], "app_id"), "boosted": TN.boosted_probability(rows, nodes["boosted"], "app_id")}
    rows.withColumnRenamed("app_id", "id").write.parquet(f"{path}/rows")
    for name, table in nodes.items():
        table.write.parquet(f"{path}/table-{name}")
        want = {r["app_id"]: r["p"] for r in expected[name].select("app_id", "p").collect()}
        got = {r["app_id"]: r["probability"] for r in joined[name].collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
        base = 0.0 if name == "forest" else boosted.base
        sql = TN.WALK_SQL.format(nodes=f"read_parquet('{path}/table-{name}/*.parquet')", rows=f"read_parquet('{path}/rows/*.parquet')")
        for k, total, trees in duckdb.sql(sql).fetchall():
            p = total / trees if name == "forest" else 1 / (1 + math.exp(-(base + total)))
            assert abs(p - want[k]) < 1e-9 and trees == (7 if name == "forest" else 6)


def test_first_levels_close_their_last_level(spark):
    nodes = spark.createDataFrame([(0, 0, 0, 1, 0.5, 1, 2, None), (0, 1, 1, 2, 0.5, 3, 4, None), (0, 2, 1, None, None, None, None, 0.1),
                                   (0, 3, 2, None, None, None, None, 0.2), (0, 4, 2, None, None, None, None, 0.3), (9, 0, 0, None, None, None, None, 1.0)],
                                  "tree int, node int, depth int, feature int, threshold double, left int, right int, value double")
    got = {r["node"]: (r["leaf"], r["feature"]) for r in TN.first_levels(nodes, 6, 1).collect()}
    assert got == {0: (False, 1), 1: (True, None), 2: (True, None)}


def test_probit_fits_or_says_why_not(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.standard_normal(400) > 0).astype(float)
    m = E.fit("probit", frame(spark, x, y), E.ModelSizes(), "id")
    assert m.used == "probit" and np.allclose(m.coefficients, [1, -2, 0.5], atol=0.35)
    z = x @ m.coefficients + m.intercept
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    p = np.array([r["p"] for r in m.transform(frame(spark, x, y), "scaled", "p").orderBy("id").collect()])
    assert np.allclose(p, cdf, atol=1e-9)
    slope = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (y - cdf) / (cdf * (1 - cdf))  # the likelihood's gradient is zero
    assert np.abs(np.column_stack([np.ones(400), x]).T @ slope).max() < 1e-3
    twice = np.column_stack([x, x[:, 0] + x[:, 1], np.ones(400)])  # a sum of two others, and a constant
    c = E.fit("probit", frame(spark, twice, y), E.ModelSizes(), "id")
    assert (c.used, c.reason, c.kept) == ("probit", "collinear: 2 of 5 features left out", [0, 1, 2])
    assert np.allclose(c.coefficients, [*m.coefficients, 0, 0], atol=1e-6)
    assert np.allclose([r["p"] for r in c.transform(frame(spark, twice, y), "scaled", "p").orderBy("id").collect()], p, atol=1e-6)
    with pytest.warns(UserWarning, match="separable"):
        m = E.fit("probit", frame(spark, x, x[:, 0] > 0.1), E.ModelSizes(), "id")
    assert m.used == "logit" and np.isfinite(m.coefficients).all()
    p = [r["p"] for r in m.transform(frame(spark, x, y), "scaled", "p").collect()]
    assert all(0 <= v <= 1 for v in p)


@pytest.mark.parametrize("partitions", [4, 64])
def test_network_does_not_depend_on_the_number_of_tasks(spark, split, partitions):
    from riskframe.models.gelu_net import GeluNetwork
    train, test = split
    auc = {n: M.auc(GeluNetwork(epochs=40, partitions=n).fit(train, "app_id").transform(test, output="p"), "p").first()["auc"]
           for n in (1, partitions)}
    assert abs(auc[1] - auc[partitions]) < 0.02


def test_lab_network_stops_early(spark, split):
    m = E.fit("mlp", split[0], E.ModelSizes(mlp_iter=60), "app_id")
    assert m.activation == "relu" and m.sizes[1:] == [64, 32, 1]
    assert len(m.loss_curve) == len(m.val_loss_curve) <= 60 and m.loss_curve[-1] < m.loss_curve[0]
    assert m.stopped_early == (len(m.loss_curve) < 60)


def test_reference_customer_is_scored(spark, split):
    sizes = E.ModelSizes(trees=5, tree_depth=3, boost_rounds=3, boost_depth=2, logit_iter=50, net_epochs=3)
    ens = EN.train_ensemble(fx.applications(spark, SMALL), "app_id", sizes=sizes)
    r = EN.scored_reference(spark, ens).first()
    assert r["p_ensemble"] == pytest.approx(np.mean([r[f"p_{n}"] for n in ens.models]))


def test_only_the_smaller_sibling_is_summed(spark, monkeypatch):
    """(F1-F21) A level's pass sums one child of every split; its sibling's sums follow from the parent's. Columns summed together
    give each column's own sums."""
    rng = np.random.default_rng(21)
    x = np.column_stack([rng.integers(0, 9, 600), rng.integers(0, 3, 600) == 1, rng.integers(0, 30, 600), rng.integers(0, 5, 600)]).astype(float)
    y = (rng.random(600) < 1 / (1 + np.exp(-(x[:, 0] - 4 + x[:, 1] * x[:, 2] / 9 - x[:, 3] / 2)))).astype(float)
    monkeypatch.setattr(NB, "PAIRED", -1)
    summed, histograms = [], NB._histograms

    def watched(tree, level, *more):
        summed.append((tree, list(level)))
        return histograms(tree, level, *more)
    monkeypatch.setattr(NB, "_histograms", watched)
    m = NB.NewtonBoosting(rounds=3, depth=4, rate=0.3, bins=40, partitions=3).fit(frame(spark, x, y))
    for tree, level in summed:
        if tree is not None:
            parents = {k: p for p, f in enumerate(tree.feature) if f >= 0 for k in (tree.left[p], tree.right[p])}
            assert len({parents[k] for k in level}) == len(level)
            assert all(tree.n[k] <= tree.n[parents[k]] / 2 for k in level)
    margin = np.full(600, math.log(y.mean() / (1 - y.mean())))
    for _ in range(3):
        p = 1 / (1 + np.exp(-margin))
        margin = margin + 0.3 * brute_tree(x, p - y, p * (1 - p), 4, 1.0, 1.0)
    assert np.allclose(m.margin(x), margin, atol=1e-9)
    columns = NB.Columns(np.arange(4), np.zeros(4, int), np.r_[0, np.cumsum([9, 2, 30, 5])])
    block = np.stack([x[:, j] for j in range(4)]).astype(np.uint8), y, rng.standard_normal(600)
    found = []
    for joined in (1, 1 << 12):
        monkeypatch.setattr(NB, "JOINED", joined)
        found.append((len(columns.joined(1)), next(histograms(None, [0], 0, columns)([block]))))
    assert [n for n, _ in found] == [4, 1] and np.allclose(found[0][1], found[1][1])
