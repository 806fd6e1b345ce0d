"""The histogram forest by brute force, its bags, its independence of the input's order, and the blocks that fits pass over."""

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskframe.models import forest as FO
from riskframe.models import newton_boosting as NB
from riskframe.models.gelu_net import GeluNetwork
from riskframe.operators import metrics as M
from riskframe.session import scratch_path, scratch_tables


def frame(spark, x, y):
    rows = [(k, [float(v) for v in r], float(c)) for k, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x array<double>, label double").withColumn("scaled", array_to_vector("x"))


def data(n, seed=5):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 7, n), rng.integers(0, 2, n), rng.standard_normal(n), np.ones(n)])
    return x, (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 3 + 2 * x[:, 1] * x[:, 2])))).astype(float)


def gini(y, w):
    return 1 - sum((w[y == c].sum() / w.sum()) ** 2 for c in (0, 1)) if w.sum() else 0.0


def test_splits_against_brute_force():
    rng = np.random.default_rng(1)
    bins, y, w = rng.integers(0, 5, (4, 200)).astype(np.uint8), rng.integers(0, 2, 200).astype(np.uint8), FO.WEIGHT[rng.integers(0, 1 << 16, 200)]
    sizes, tried = np.full(4, 5), np.array([[0, 2, 3], [1, 2, 3]])
    # the root was split at bin 2 of feature 1
    level = FO.Level(np.array([1, 0, 0]), np.array([2, 255, 255]), np.array([-1, 0, 1]), tried, np.arange(0, 30, 5).reshape(2, 3), 30)
    feature, cut, gain, whole, left = FO.splits(level, FO.counted(level, 1, bins, y, w), sizes)
    for k, here in enumerate((bins[1] <= 2, bins[1] > 2)):
        yy, ww, best = y[here], w[here].astype(float), (0.0, -1, 0)
        for f in tried[k]:
            for b in range(5):
                low = bins[f, here] <= b
                if ww[low].sum() and ww[~low].sum():
                    g = gini(yy, ww) - (ww[low].sum() * gini(yy[low], ww[low]) + ww[~low].sum() * gini(yy[~low], ww[~low])) / ww.sum()
                    if g > best[0] + 1e-12:
                        best = (g, f, b)
        assert (feature[k], cut[k]) == best[1:] and abs(gain[k] - best[0]) < 1e-9
        assert whole[k].tolist() == [ww[yy == c].sum() for c in (0, 1)]
        assert left[k].tolist() == [ww[(yy == c) & (bins[best[1], here] <= best[2])].sum() for c in (0, 1)]


def test_bags_are_poisson():
    share = np.bincount(FO.WEIGHT) / len(FO.WEIGHT)
    assert abs(FO.WEIGHT.mean() - 1) < 1e-3 and abs(FO.WEIGHT.astype(float).var() - 1) < 1e-2 and abs(share[0] - np.exp(-1)) < 1e-4


def test_forest_learns_as_sparks_does_and_saves(spark):
    from pyspark.ml.classification import RandomForestClassifier
    train, test = frame(spark, *data(1500)), frame(spark, *data(600, 6))
    tables, held = len(scratch_tables()), spark.sparkContext._jsc.getPersistentRDDs().size()
    m = FO.HistogramForest(trees=30, depth=5).fit(train, "id")
    assert len(scratch_tables()) == tables and spark.sparkContext._jsc.getPersistentRDDs().size() == held
    theirs = RandomForestClassifier(featuresCol="scaled", labelCol="label", numTrees=30, maxDepth=5, seed=1).fit(train)
    auc = M.auc(m.transform(test, output="p"), "p").first()["auc"]
    assert auc > M.auc(theirs.transform(test).select("label", vector_to_array("probability")[1].alias("p")), "p").first()["auc"] - 0.02 > 0.7
    assert m.getNumTrees == 30 and m.depth.max() <= 5 and abs(m.featureImportances.toArray().sum() - 1) < 1e-9
    assert m.featureImportances.toArray()[3] == 0  # a constant feature splits nothing
    # the children of a node share its rows
    inner, key = m.feature >= 0, {(t, k): i for i, (t, k) in enumerate(zip(m.tree, m.node))}
    for i in np.flatnonzero(inner):
        kids = [key[m.tree[i], m.left[i]], key[m.tree[i], m.right[i]]]
        assert (m.counts[kids].sum(axis=0) == m.counts[i]).all() and (m.depth[kids] == m.depth[i] + 1).all()
    path = scratch_path(spark, "forest")
    m.write().overwrite().save(path)
    x = data(600, 6)[0]
    assert (FO.ForestModel.load(spark, path).arrays().probability(x) == m.arrays().probability(x)).all()
    again = FO.HistogramForest(trees=30, depth=5).fit(train.repartition(3).orderBy(F.rand()), "id")  # the input in another order
    assert (again.arrays().probability(x) == m.arrays().probability(x)).all()


def test_one_class_and_no_split(spark):
    one = FO.HistogramForest(trees=3, depth=2).fit(frame(spark, [[1, 2]] * 9, [1] * 9), "id")
    assert len(one.node) == 3 and (one.arrays().probability(np.ones((2, 2))) == 1).all()


def test_few_rows_are_few_tasks_and_nothing_stays(spark, monkeypatch):
    seen = []
    real = NB.B.added
    monkeypatch.setattr(NB.B, "added", lambda v, *a: seen.append(v.getNumPartitions()) or real(v, *a))
    tables, held = len(scratch_tables()), spark.sparkContext._jsc.getPersistentRDDs().size()
    rows = frame(spark, *data(300)).repartition(6)
    NB.NewtonBoosting(rounds=3, depth=2, write_every=2).fit(rows)
    assert seen == [1] * 6
    GeluNetwork(epochs=2).fit(rows, "id")
    assert len(scratch_tables()) == tables and spark.sparkContext._jsc.getPersistentRDDs().size() == held
