"""Random forest on histograms of whole numbers (M3).

All trees grow together, one level a pass.  A row's weight in a tree is Poisson with mean 1, drawn from the seed of its
written block, so every pass and every repeated task meets the same bags.  A node tries a random ``sqrt(features)`` of
the features; tasks count weights by (node, tried feature, bin, class), the counts of a tree meet in one task by its
number, and only its splits come to the driver.  A split is the one with the largest drop of the Gini impurity; of equal ones
the smaller feature, then the smaller threshold.  Counts are whole numbers, so the result does not depend on the
order in which tasks end.  Nodes are numbered as in a heap: the children of k are 2 k + 1 and 2 k + 2.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.models import blocks as B
from riskframe.session import drop_scratch, ship_package

#: Weight of a row by 16 random bits: Poisson with mean 1.
_TAIL = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
WEIGHT = np.searchsorted(_TAIL, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)
DEEPEST = 16


def slot_bit(slot: np.ndarray) -> np.ndarray:
    """A set of features is a number of 64 bits; with more features some share a bit."""
    return np.uint64(1) << (np.asarray(slot) % 64).astype(np.uint64)


@dataclass
class Forest:
    """All trees of a forest side by side; a leaf is its own child."""
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    ways: np.ndarray   # (2, nodes): left, right
    value: np.ndarray
    depth: int

    def walked(self, flat: np.ndarray, first: np.ndarray, root: int, both: np.ndarray, bit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """The nodes of rows in a tree, and by ``bit`` the features tested on the way; ``both``: left and right of a node side by side."""
        node, tested = np.full(len(first), root), None if bit is None else np.zeros(len(first), np.uint64)
        for _ in range(self.depth):
            if bit is not None:
                tested |= bit.take(node)
            right = flat.take(first + self.feature.take(node)) > self.threshold.take(node)
            node = both.take(2 * node + right)
        return node, tested

    def sums(self, x: np.ndarray, start: float = 0.0) -> np.ndarray:
        """``start`` and the values of all trees, a tree at a time."""
        flat, width = np.ascontiguousarray(x).ravel(), x.shape[1] if x.ndim == 2 else 0
        first, total, both = np.arange(len(x)) * width, np.full(len(x), start), np.ascontiguousarray(self.ways.T).ravel()
        for root in self.roots:
            total += self.value.take(self.walked(flat, first, root, both)[0])
        return total

    def sums_with_variants(self, x: np.ndarray, made: np.ndarray, owner: np.ndarray, moved: np.ndarray, start: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """The same for rows, and for variants of the rows ``owner`` that differ in the features ``moved`` (:func:`slot_bit`).

        A tree that tests none of these on the row's way gives the row's own value; only the others are walked again."""
        inner, both = self.ways[0] != np.arange(len(self.feature)), np.ascontiguousarray(self.ways.T).ravel()
        bit = np.where(inner, slot_bit(self.feature), np.uint64(0))
        (flat, first), (flat_made, first_made) = ((np.ascontiguousarray(v).ravel(), np.arange(len(v)) * v.shape[1]) for v in (x, made))
        rows, others = np.full(len(x), start), np.full(len(made), start)
        for root in self.roots:
            node, tested = self.walked(flat, first, root, both, bit)
            own = self.value.take(node)
            new, some = own.take(owner), np.flatnonzero(tested.take(owner) & moved)
            new[some] = self.value.take(self.walked(flat_made, first_made.take(some), root, both)[0])
            rows += own
            others += new
        return rows, others

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Mean share of class 1 over the trees."""
        return self.sums(x) / max(1, len(self.roots))

    def with_variants(self, x: np.ndarray, made: np.ndarray, owner: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(s / max(1, len(self.roots)) for s in self.sums_with_variants(x, made, owner, moved))


@dataclass
class ForestModel:
    """Nodes of all trees, ordered by (tree, node); a tree's nodes are numbered from 0 (its root) on."""
    tree: np.ndarray
    node: np.ndarray
    depth: np.ndarray
    feature: np.ndarray    # -1 at a leaf
    threshold: np.ndarray
    left: np.ndarray       # -1 at a leaf
    right: np.ndarray
    counts: np.ndarray     # (nodes, 2): weights of the classes
    gain: np.ndarray
    width: int

    @property
    def getNumTrees(self) -> int:
        return len(np.unique(self.tree))

    @property
    def featureImportances(self) -> DenseVector:
        """Drop of impurity times rows of a feature's splits, as shares of the tree, then of the forest."""
        out, inner = np.zeros(self.width), self.feature >= 0
        drop = self.gain * self.counts.sum(axis=1)
        for t in np.unique(self.tree):
            some = inner & (self.tree == t)
            one = np.bincount(self.feature[some], drop[some], self.width)
            out += one / one.sum() if one.sum() > 0 else one
        return DenseVector(out / out.sum() if out.sum() > 0 else out)

    def arrays(self) -> Forest:
        roots = np.flatnonzero(np.r_[True, self.tree[1:] != self.tree[:-1]])
        base, leaf = np.repeat(roots, np.diff(np.r_[roots, len(self.tree)])), self.feature < 0
        left, right = (np.where(leaf, self.node, c) + base for c in (self.left, self.right))
        return Forest(roots, np.where(leaf, 0, self.feature), np.where(leaf, np.inf, self.threshold), np.stack([left, right]),
                      np.where(leaf, self.counts[:, 1] / np.maximum(self.counts.sum(axis=1), 1), 0.0), int(self.depth.max(initial=0)))

    def transform(self, df: DataFrame, features_col: str = "scaled", output: str = "p_random_forest") -> DataFrame:
        """Probability of class 1, in Arrow batches."""
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self.arrays())

        @F.pandas_udf("double")
        def probability(x: pd.DataFrame) -> pd.Series:
            return pd.Series(shared.value.probability(x.to_numpy(dtype=float)))

        values = vector_to_array(F.col(features_col))
        return df.withColumn(output, probability(F.struct(*[values[j].alias(f"x{j}") for j in range(self.width)])))

    def save(self, spark: SparkSession, path: str) -> None:
        """``data`` holds a row per node with the columns of Spark's own forests, which ``forest_nodes`` reads."""
        leaf, n = self.feature < 0, self.counts.sum(axis=1)
        share = self.counts / np.maximum(n, 1)[:, None]
        ends = pa.array(np.r_[0, np.cumsum(~leaf)].astype(np.int32))
        split = pa.StructArray.from_arrays(
            [pa.array(self.feature.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(self.threshold[~leaf])), pa.array(np.full(len(leaf), -1, np.int32))],
            ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
        stats = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(leaf) + 1, 2, dtype=np.int32)), pa.array(self.counts.astype(float).ravel()))
        data = pa.StructArray.from_arrays(
            [pa.array(self.node.astype(np.int32)), pa.array((share[:, 1] > 0.5).astype(float)), pa.array(1 - (share * share).sum(axis=1)), stats,
             pa.array(n.astype(np.int64)), pa.array(np.where(leaf, -1.0, self.gain)), pa.array(self.left.astype(np.int32)),
             pa.array(self.right.astype(np.int32)), split],
            ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
        spark.createDataFrame(pa.table({"treeID": pa.array(self.tree.astype(np.int32)), "depth": pa.array(self.depth.astype(np.int32)), "nodeData": data})) \
            .write.mode("overwrite").parquet(f"{path}/data")
        spark.createDataFrame([(self.width,)], "width int").write.mode("overwrite").parquet(f"{path}/model")

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForestModel:
        """The nodes (trees x 2^(depth + 1) at most) come to the driver."""
        ship_package(spark)
        d = spark.read.parquet(f"{path}/data").select("treeID", "depth", "nodeData.*").select(
            "treeID", "depth", "id", "leftChild", "rightChild", "gain", F.col("split.featureIndex").alias("f"),
            F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("t"), F.col("impurityStats")[0].alias("c0"),
            F.col("impurityStats")[1].alias("c1")).orderBy("treeID", "id").toArrow()
        c = {n: d[n].to_numpy() for n in d.column_names if n != "t"}
        return cls(c["treeID"], c["id"], c["depth"], c["f"], d["t"].fill_null(0.0).to_numpy(), c["leftChild"], c["rightChild"],
                   np.stack([c["c0"], c["c1"]], axis=1).astype(np.int64), np.maximum(c["gain"], 0.0),
                   spark.read.parquet(f"{path}/model").first()["width"])


@dataclass
class _Writer:
    """``model.write().overwrite().save(path)``, as Spark's own models are saved."""
    model: ForestModel

    def overwrite(self) -> _Writer:
        return self

    def save(self, path: str) -> None:
        self.model.save(SparkSession.getActiveSession(), path)


@dataclass
class Level:
    """What a pass needs of a tree: the heap so far and the open nodes with the features they try."""
    feature: np.ndarray   # by heap number; 0 where the node has no split
    cut: np.ndarray       # 255 there
    number: np.ndarray    # place among the open nodes by heap number, or -1
    tried: np.ndarray     # (open, m)
    start: np.ndarray     # (open, m): first slot of the tried feature
    slots: int


def counted(level: Level, depth: int, bins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a block by (slot, class): ``bins`` is (features, rows)."""
    flat, n = bins.ravel(), bins.shape[1]
    rows = np.flatnonzero(weight)
    node, first = np.zeros(len(rows), np.int64), level.feature * n
    for _ in range(depth):
        place = first.take(node)
        place += rows
        right = flat.take(place) > level.cut.take(node)
        node *= 2
        node += 1
        node += right
    at = level.number.take(node)
    if depth:
        some = np.flatnonzero(at >= 0)
        if len(some) < len(at):
            at, rows = at.take(some), rows.take(some)
    y, w = y.take(rows), weight.take(rows).astype(float)
    out = np.zeros(2 * level.slots)
    for tried, start in zip((level.tried * n).T.copy(), (2 * level.start).T.copy()):
        place = tried.take(at)
        place += rows
        slot = flat.take(place).astype(np.int64)
        slot *= 2
        slot += start.take(at)
        slot += y
        out += np.bincount(slot, w, len(out))
    return out.astype(np.int64)


def splits(level: Level, counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per open node: (feature or -1, bin, gain, counts of the node, counts of its left side)."""
    counts = counts.reshape(-1, 2)
    most = int(sizes[level.tried].max())
    at = np.arange(most)
    there = at < sizes[level.tried][:, :, None]
    got = counts[np.where(there, level.start[:, :, None] + at, 0)] * there[..., None]
    left = np.cumsum(got, axis=2)
    whole = left[:, 0, -1]
    right = whole[:, None, None] - left

    def spread(c):  # rows times Gini impurity
        n = c.sum(axis=-1)
        return n - (c.astype(float) ** 2).sum(axis=-1) / np.maximum(n, 1)
    able = (left.sum(axis=-1) > 0) & (right.sum(axis=-1) > 0)
    gain = np.where(able, (spread(whole)[:, None, None] - spread(left) - spread(right)) / np.maximum(whole.sum(axis=-1), 1)[:, None, None], 0.0)
    gain = np.round(gain, 12).reshape(len(gain), -1)  # the first of equals: smallest feature, then bin
    best, k = gain.argmax(axis=1), np.arange(len(gain))
    s, b, g = best // most, best % most, gain[k, best]
    return np.where(g > 0, level.tried[k, s], -1), b, g, whole, left[k, s, b]


@dataclass
class HistogramForest:
    """Estimator (M3); 32 bins, Gini and a square root of the features as Spark's own forests."""
    trees: int = 200
    depth: int = 10
    bins: int = 32
    seed: int = 42
    partitions: int | None = None  # rows are dealt to so many tasks; the default parallelism if not given

    def fit(self, df: DataFrame, id_col: str, features: str = "scaled", label: str = "label") -> ForestModel:
        from riskframe.models.newton_boosting import binned, thresholds
        if not 2 <= self.bins <= 255 or not 0 <= self.depth <= DEEPEST:
            raise ValueError(f"a bin is one byte (2 to 255 bins), a tree has at most {DEEPEST} levels")
        spark = df.sparkSession
        data = df.select(F.col(id_col).alias("id"), vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y")).filter("y is not null")
        width = data.agg(F.first(F.size("x")).alias("w")).first()["w"]
        if not width:
            raise ValueError("no labelled row to train on")
        cuts = thresholds(data, width, self.bins)
        sizes = np.array([len(c) + 1 for c in cuts])
        tasks = self.partitions or spark.sparkContext.defaultParallelism
        # by id and in order, so that a row's weights do not depend on how the input lies
        deal = data.repartition(tasks, "id").sortWithinPartitions("id", "y", "x").drop("id")
        table, path = B.written(B.in_blocks(deal, lambda x: binned(x, cuts).T, lambda n, t: np.zeros(0)), "forest-rows")
        rows = B.kept(table, _decode, tasks)
        model = self.grow(rows, sizes, cuts, tasks)
        rows.unpersist()
        drop_scratch(spark, [path])
        return model

    def grow(self, rows, sizes: np.ndarray, cuts: list[np.ndarray], tasks: int) -> ForestModel:
        sc, heap = rows.context, (1 << (self.depth + 1)) - 1
        feature, cut, gain = (np.full((self.trees, heap), v) for v in (-1, 255, 0.0))
        counts = np.zeros((self.trees, heap, 2), np.int64)
        rng = np.random.default_rng(self.seed)
        m = min(len(sizes), math.ceil(math.sqrt(len(sizes))))
        still = {t: np.zeros(1, np.int64) for t in range(self.trees)}  # open nodes by heap number
        for depth in range(max(1, self.depth)):
            levels: dict[int, Level] = {}
            for t, nodes in still.items():
                tried = np.sort(rng.random((len(nodes), len(sizes))).argsort(axis=1)[:, :m], axis=1)
                start = np.r_[0, np.cumsum(sizes[tried].ravel())]
                number = np.full(heap, -1)
                number[nodes] = np.arange(len(nodes))
                levels[t] = Level(np.maximum(feature[t], 0), cut[t], number, tried, start[:-1].reshape(tried.shape), int(start[-1]))
            if not levels:
                break
            sent = sc.broadcast(levels)
            found = rows.mapPartitions(_counts(sent, depth, self.trees, self.seed)).reduceByKey(np.add, tasks) \
                .map(lambda kv, sent=sent: (kv[0], *splits(sent.value[kv[0]], kv[1], sizes))).collect()
            sent.destroy()
            for t, f, b, g, whole, left in found:
                nodes = still[t]
                counts[t, nodes] = whole
                if not self.depth:
                    continue
                some = f >= 0
                at = nodes[some]
                feature[t, at], cut[t, at], gain[t, at] = f[some], b[some], g[some]
                counts[t, 2 * at + 1], counts[t, 2 * at + 2] = left[some], (whole - left)[some]
            below = depth + 1
            if below >= self.depth:
                break
            still = {}
            for t in range(self.trees):
                at = np.arange((1 << below) - 1, (1 << (below + 1)) - 1)
                at = at[(feature[t, (at - 1) // 2] >= 0) & (counts[t, at].min(axis=1) > 0)]  # a node of one class is a leaf
                if len(at):
                    still[t] = at
        return self.model(feature, cut, gain, counts, cuts)

    def model(self, feature, cut, gain, counts, cuts) -> ForestModel:
        parts = []
        for t in range(self.trees):
            heap = np.arange(feature.shape[1])
            there = (heap == 0) | (feature[t, (heap - 1) // 2] >= 0)
            at, f = heap[there], feature[t, there]
            new = np.cumsum(there) - 1
            inner, last = f >= 0, len(heap) - 1
            low, high = (np.where(inner, new[np.minimum(2 * at + k, last)], -1) for k in (1, 2))
            value = np.array([cuts[j][c] if j >= 0 else 0.0 for j, c in zip(f, cut[t, there])])
            parts.append((np.full(len(at), t), np.arange(len(at)), np.floor(np.log2(at + 1)).astype(int), f, value, low, high, counts[t, there], gain[t, there]))
        return ForestModel(*[np.concatenate(c) for c in zip(*parts)], width=len(cuts))


def _decode(r) -> tuple[int, np.ndarray, np.ndarray]:
    return r["block"], np.frombuffer(r["x"], np.uint8).reshape(-1, r["n"]), (np.frombuffer(r["y"]) > 0.5).astype(np.uint8)


def _counts(sent, depth: int, trees: int, seed: int):
    def run(blocks) -> Iterator[tuple[int, np.ndarray]]:
        levels, out = sent.value, {}
        for block, bins, y in blocks:
            rng = np.random.default_rng((seed, block))
            for t in range(trees):
                weight = WEIGHT[np.frombuffer(rng.bytes(2 * len(y)), np.uint16)]
                if t in levels:
                    here = counted(levels[t], depth, bins, y, weight)
                    out[t] = out[t] + here if t in out else here
        yield from out.items()
    return run
