"""Second-order boosting of the binary log-loss on histograms.

A round fits one tree to the gradients g = p - y and curvatures h = p (1 - p) of the current margin.
A distributed pass grows a level: tasks sum g, h and rows by (node, feature, bin) over their rows as
vectors, and one aggregate merges the sums.  The driver sees only those sums, whose size follows from
depth, features and bins, never from the rows (few tasks' sums are merged there at once).  Of two siblings only the one
with fewer rows is summed; the other's sums are those of their parent less these.  Where a task has few rows
and a pass costs more to start than to run, tasks sum by pairs of columns, too: the bins of one, split anywhere, then give
the sums of the other in both children, so that the pass grows two levels (but a tree's last two, whose many nodes make
the sums by pairs large).  A split's gain is

    1/2 [GL^2 / (HL + l) + GR^2 / (HR + l) - G^2 / (H + l)]

and a leaf's weight -G / (H + l) of its own round; ``rate`` times the weight is added to the margin before
the next round.  Binned rows are kept as blocks (:mod:`riskframe.models.blocks`); the first pass of a
round moves their margins by the tree before, and every ``write_every`` rounds they are written anew.
Two-valued features of which no row has two (the dummies of a category) share a stored column
(:class:`Columns`), as a pass costs a sum per column.

Equal gains (to ``GAIN_DIGITS`` decimals, as sums come in any order) are decided by the smaller feature,
then by the smaller threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.models import blocks as B
from riskframe.models.forest import Forest
from riskframe.session import drop_scratch, ship_package

GAIN_DIGITS = 6
#: The sums of all tasks are merged on the driver below so many bytes, in the tasks beyond.
MERGED_HERE = B.ADDED_HERE
#: A pass over fewer rows than this costs less than one more task.
ROWS_A_TASK = 1 << 19
#: Pairs of columns are summed while a task's rows times the pairs are at most so many; the sums take less time than another pass.
PAIRED = 1 << 22
#: Columns are summed together, by all of their bins at once, up to so many sums: adding a row costs the same for one column or for several.
JOINED = 1 << 12
NODE_SCHEMA = ("tree int, node int, depth int, feature int, threshold double, left int, right int, value double, "
               "G double, H double, n bigint, gain double, weight double, base double")


@dataclass
class Tree:
    """One tree as arrays; the children of a leaf are the leaf itself, so walking stops there."""
    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    G: list[float] = field(default_factory=list)
    H: list[float] = field(default_factory=list)
    n: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, depth: int, G: float, H: float, n: float) -> int:
        k = len(self.feature)
        for name, v in (("feature", -1), ("bin", 0), ("left", k), ("right", k), ("depth", depth), ("G", G), ("H", H), ("n", n), ("gain", 0.0)):
            getattr(self, name).append(v)
        return k

    def split(self, node: int, feature: int, cut: int, gain: float, left: int, right: int) -> None:
        self.feature[node], self.bin[node], self.gain[node], self.left[node], self.right[node] = feature, cut, gain, left, right

    def walk(self, bins: np.ndarray, steps: int) -> np.ndarray:
        """The node of every row (a row of ``bins``) after ``steps`` splits."""
        # values of a feature side by side: what is taken together lies together
        n, flat = len(bins), np.ascontiguousarray(bins.T).ravel()
        first, cut = np.array(self.feature) * n, np.array(self.bin)
        ways = np.column_stack([self.right, self.left]).ravel()
        inner = np.array(self.feature) >= 0
        first = np.where(inner, first, 0)
        node, rows = np.zeros(n, np.int64), np.arange(n)
        for _ in range(steps):
            node = ways.take(2 * node + (flat.take(first.take(node) + rows) <= cut.take(node)))
        return node

    def weights(self, reg_lambda: float) -> np.ndarray:
        return -np.array(self.G) / (np.array(self.H) + reg_lambda)


def best_splits(hist: np.ndarray, first: np.ndarray, reg_lambda: float, least_hessian: float) -> list[tuple[int, int, float, np.ndarray] | None]:
    """Per node the best (feature, bin, gain, sums of the left side), or None.

    ``hist``: (3, nodes, slots) sums of g, h and rows; feature j owns the slots first[j] to first[j + 1]."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    running = np.cumsum(hist, axis=2)
    before = np.concatenate([np.zeros_like(running[:, :, :1]), running], axis=2)[:, :, first[owner]]
    left = running - before
    total = hist[:, :, :first[1]].sum(axis=2)[:, :, None]
    right = total - left
    last = np.zeros(hist.shape[2], bool)
    last[first[1:] - 1] = True  # nothing is right of a feature's last bin
    (gl, hl, nl), (gr, hr, nr), (g, h, _) = left, right, total
    gain = 0.5 * (gl * gl / (hl + reg_lambda) + gr * gr / (hr + reg_lambda) - g * g / (h + reg_lambda))
    able = ~last & (hl >= least_hessian) & (hr >= least_hessian) & (nl > 0) & (nr > 0)
    gain = np.where(able, np.round(gain, GAIN_DIGITS), 0.0)
    out = []
    for k in range(hist.shape[1]):
        s = int(np.argmax(gain[k]))  # the first of equals: smallest feature, then bin
        out.append((int(owner[s]), s - int(first[owner[s]]), float(gain[k, s]), left[:, k, s]) if gain[k, s] > 0 else None)
    return out


@dataclass
class NewtonBoostingModel:
    trees: list[Tree]
    cuts: list[np.ndarray]
    base: float
    rate: float
    reg_lambda: float
    depth: int

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    @property
    def featureImportances(self) -> DenseVector:
        """Mean gain of a feature's splits, as shares."""
        total, splits = np.zeros(len(self.cuts)), np.zeros(len(self.cuts))
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    total[f] += g
                    splits[f] += 1
        mean = total / np.maximum(splits, 1)
        return DenseVector(mean / mean.sum() if mean.sum() > 0 else mean)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.cuts)
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += self.rate * t.weights(self.reg_lambda)[t.walk(bins, self.depth)]
        return out

    def arrays(self) -> Boosted:
        roots = np.r_[0, np.cumsum([len(t.feature) for t in self.trees])].astype(int)
        inner = np.array([f >= 0 for t in self.trees for f in t.feature], bool)
        feature, cut, left, right = (np.array([v for t in self.trees for v in getattr(t, n)], int) for n in ("feature", "bin", "left", "right"))
        base = np.repeat(roots[:-1], np.diff(roots))
        value = np.concatenate([self.rate * t.weights(self.reg_lambda) for t in self.trees]) if self.trees else np.zeros(0)
        trees = Forest(roots[:-1], np.where(inner, feature, 0), np.where(inner, cut, 255), np.stack([left, right]) + base, value, self.depth)
        return Boosted(trees, self.cuts, self.base)

    def transform(self, df: DataFrame, features_col: str = "scaled", output: str = "p_newton_boosting") -> DataFrame:
        """Probability of class 1, in Arrow batches."""
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self.arrays())

        @F.pandas_udf("double")
        def probability(x: pd.DataFrame) -> pd.Series:
            return pd.Series(1.0 / (1.0 + np.exp(-shared.value.margin(x.to_numpy(dtype=float)))))

        values = vector_to_array(F.col(features_col))
        return df.withColumn(output, probability(F.struct(*[values[j].alias(f"x{j}") for j in range(len(self.cuts))])))

    def rows(self) -> list[tuple]:
        """The node table: one row per node; ``value`` of a leaf is what the tree adds to the margin."""
        out = []
        for k, t in enumerate(self.trees):
            weight = t.weights(self.reg_lambda)
            for i, f in enumerate(t.feature):
                leaf = f < 0
                out.append((k, i, t.depth[i], None if leaf else f, None if leaf else float(self.cuts[f][t.bin[i]]),
                            None if leaf else t.left[i], None if leaf else t.right[i], float(self.rate * weight[i]) if leaf else None,
                            float(t.G[i]), float(t.H[i]), int(t.n[i]), None if leaf else t.gain[i], float(weight[i]), self.base))
        return out

    def node_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), NODE_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        self.node_table(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([([c.tolist() for c in self.cuts], self.base, self.rate, self.reg_lambda, self.depth)],
                              "cuts array<array<double>>, base double, rate double, reg_lambda double, depth int") \
            .write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NewtonBoostingModel:
        ship_package(spark)
        m = spark.read.parquet(f"{path}/model").first()
        cuts = [np.array(c) for c in m["cuts"]]
        trees: dict[int, Tree] = {}
        for r in spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes").orderBy("tree", "node").collect():  # rounds x 2^(depth + 1) rows at most
            t = trees.setdefault(r["tree"], Tree())
            k = t.add(r["depth"], r["G"], r["H"], r["n"])
            if r["feature"] is not None:
                f = r["feature"]
                t.split(k, f, int(np.searchsorted(cuts[f], r["threshold"])), r["gain"], r["left"], r["right"])
        return cls([trees[k] for k in sorted(trees)], cuts, m["base"], m["rate"], m["reg_lambda"], m["depth"])


@dataclass
class Boosted:
    """A model as one forest over bins, whose nodes' values are what the trees add to the margin."""
    trees: Forest
    cuts: list[np.ndarray]
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.trees.sums(binned(x, self.cuts), self.base)

    def with_variants(self, x: np.ndarray, made: np.ndarray, owner: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, ...]:
        """Probabilities of rows, and of variants of the rows ``owner`` that differ in the features ``moved``."""
        margins = self.trees.sums_with_variants(binned(x, self.cuts), binned(made, self.cuts), owner, moved, self.base)
        return tuple(1.0 / (1.0 + np.exp(-z)) for z in margins)


@dataclass
class Columns:
    """Where the bins of the features are stored: a column of its own each, or a column that two-valued features share.

    A shared column holds 0, or the ``code`` of the one feature whose larger value the row has."""
    column: np.ndarray  # of every feature
    code: np.ndarray  # 0: the column holds the feature's bins
    first: np.ndarray  # column c owns the slots first[c] to first[c + 1]

    @classmethod
    def of(cls, bins: np.ndarray, together: np.ndarray) -> Columns:
        """``bins`` of every feature; ``together``: rows in which two features both lie above their first bin."""
        column, code, members = np.zeros(len(bins), int), np.zeros(len(bins), int), []
        for j in range(len(bins)):
            if bins[j] <= 2:  # a feature of one value fits anywhere: no row has its code
                home = next((c for c, m in enumerate(members) if bins[m[0]] <= 2 and len(m) < 255 and not together[j, m].any()), len(members))
            else:
                home = len(members)
            if home == len(members):
                members.append([])
            members[home].append(j)
            column[j], code[j] = home, len(members[home]) if bins[j] <= 2 else 0
        first = np.r_[0, np.cumsum([len(m) + 1 if bins[m[0]] <= 2 else bins[m[0]] for m in members])].astype(int)
        return cls(column, code, first)

    def spread(self, sums: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sums by slot of a feature (last axis; feature j owns the slots first[j] to first[j + 1]) from those by slot of a column."""
        out = np.empty((*sums.shape[:-1], int(first[-1])))
        for c, k, start, end in zip(self.column, self.code, first, first[1:]):
            own = sums[..., self.first[c]:self.first[c + 1]]
            if not k:
                out[..., start:end] = own
            else:
                above = own[..., k] if end - start > 1 else 0.0
                out[..., start] = own.sum(axis=-1) - above
                if end - start > 1:
                    out[..., start + 1] = above
        return out

    def stored(self, bins: np.ndarray) -> np.ndarray:
        """(columns, rows) of the features' bins (features, rows)."""
        out = np.zeros((len(self.first) - 1, bins.shape[1]), np.uint8)
        for b, c, k in zip(bins, self.column, self.code):
            out[c] += b * np.uint8(k) if k else b
        return out

    @property
    def pairs(self) -> list[tuple[int, int]]:
        return [(a, b) for a in range(len(self.first) - 1) for b in range(a + 1, len(self.first) - 1)]

    def sums_a_node(self, paired: bool) -> int:
        sizes = np.diff(self.first)
        return int(sizes.sum() + (sum(sizes[a] * sizes[b] for a, b in self.pairs) if paired else 0))

    def parts(self, sums: np.ndarray, nodes: int, paired: bool) -> dict[tuple[int, ...], np.ndarray]:
        """The tasks' sums (3, ..) by column (3, nodes, slots) and by pair of columns (3, nodes, slots, slots)."""
        sizes, out, at = np.diff(self.first).tolist(), {}, 0
        for key in [(a,) for a in range(len(sizes))] + (self.pairs if paired else []):
            shape = (nodes, *[sizes[c] for c in key])
            end = at + int(np.prod(shape))
            out[key] = sums[:, at:end].reshape(3, *shape)
            at = end
        return out

    def joined(self, nodes: int) -> list[list[int]]:
        """Columns that are summed together for so many nodes."""
        sizes, groups = np.diff(self.first).tolist(), []
        for c in sorted(range(len(sizes)), key=lambda c: -sizes[c]):
            home = next((g for g in groups if nodes * sizes[c] * math.prod(sizes[k] for k in g) <= JOINED), None)
            if home is None:
                groups.append([c])
            else:
                home.append(c)
        return groups

    def by_slot(self, parts: dict[tuple[int, ...], np.ndarray]) -> np.ndarray:
        """(3, nodes, slots of all columns)."""
        return np.concatenate([parts[c,] for c in range(len(self.first) - 1)], axis=2)

    def children(self, parts: dict[tuple[int, ...], np.ndarray], node: int, feature: int, cut: int) -> list[np.ndarray]:
        """Sums by slot (3, slots) left and right of a split, from those by pairs of columns."""
        own, code = int(self.column[feature]), self.code[feature]
        slot = np.arange(self.first[own + 1] - self.first[own])
        left, out = slot != code if code else slot <= cut, []
        for side in (left, ~left):
            out.append(np.concatenate([
                parts[c,][:, node] * side if c == own else side @ parts[own, c][:, node] if own < c else parts[c, own][:, node] @ side
                for c in range(len(self.first) - 1)], axis=1))
        return out

    def walk(self, tree: Tree, stored: np.ndarray, steps: int) -> np.ndarray:
        """The node of every row after ``steps`` splits."""
        n, flat = stored.shape[1], stored.ravel()
        first, ways = np.zeros(len(tree.feature), np.int64), np.repeat(np.arange(len(tree.feature))[:, None], 256, axis=1)
        for k, f in enumerate(tree.feature):
            if f >= 0:
                first[k], ways[k] = self.column[f] * n, tree.left[k]
                if self.code[f]:
                    ways[k, self.code[f]] = tree.right[k]
                else:
                    ways[k, tree.bin[k] + 1:] = tree.right[k]
        ways, node, rows = ways.ravel(), np.zeros(n, np.int64), np.arange(n)
        for _ in range(steps):
            node = ways.take(256 * node + flat.take(first.take(node) + rows))
        return node


def _together(blocks) -> Iterator[np.ndarray]:
    """Rows of a task in which two features both lie above their first bin, as one vector."""
    out = None
    for bins, _, _ in blocks:
        above = (bins > 0).astype(np.float32)
        met = (above @ above.T).astype(float)
        out = met if out is None else out + met
    if out is not None:
        yield out.ravel()


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of every value: how many cuts are below it, so ``x <= cuts[k]`` is ``bin <= k``."""
    out = np.empty((len(cuts), len(x)), np.uint8)  # a feature's bins side by side
    for j, c in enumerate(cuts):
        out[j] = np.searchsorted(c, x[:, j], "left")
    return out.T


def thresholds(df: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Cuts per feature of ``x``: midpoints between neighbouring quantiles, least and largest value (all distinct values of a
    feature with few)."""
    shares = [k / bins for k in range(1, bins)]
    wide = df.select(*[F.col("x")[j].alias(f"x{j}") for j in range(width)])
    ends = wide.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in wide.columns]).first()
    known = {c: np.unique([v for v in ends[c] if v is not None]) for c in wide.columns}
    # a feature of two values needs no quantiles
    more = wide.agg(*[F.bool_or((F.col(c) != float(v[0])) & (F.col(c) != float(v[-1]))).alias(c) for c, v in known.items() if len(v)]).first()
    many = [c for c in known if len(known[c]) and more[c]]
    if many:
        found = wide.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in many]).first()
        known |= {c: np.unique([*known[c], *found[c]]) for c in many}
    return [(v[:-1] + v[1:]) / 2 if len(v) > 1 else np.zeros(0) for v in known.values()]


@dataclass
class NewtonBoosting:
    """Estimator (M4); defaults are the reference sizes, with lambda 1 and curvature 1 on either side of a split."""
    rounds: int = 200
    depth: int = 6
    rate: float = 0.1
    reg_lambda: float = 1.0
    least_hessian: float = 1.0
    bins: int = 64
    write_every: int = 16
    partitions: int | None = None  # rows are dealt to so many tasks; the default parallelism at most if not given

    def fit(self, df: DataFrame, features: str = "scaled", label: str = "label") -> NewtonBoostingModel:
        if not 2 <= self.bins <= 255:
            raise ValueError("a bin is one byte: 2 to 255 bins")
        data = df.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y")).filter("y is not null")
        head = data.agg(F.first(F.size("x")).alias("width"), F.avg("y").alias("mean"), F.count("y").alias("n")).first()
        width, mean = head["width"] or 0, head["mean"]
        if mean is None:
            raise ValueError("no labelled row to train on")
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        base = float(np.log(mean / (1 - mean)))
        cuts = thresholds(data, width, self.bins)
        model = NewtonBoostingModel([], cuts, base, self.rate, self.reg_lambda, self.depth)
        first = np.r_[0, np.cumsum([len(c) + 1 for c in cuts])]
        spark, path = df.sparkSession, None
        # dealt by their values, so that a recomputed task has the same rows
        tasks = self.partitions or min(spark.sparkContext.defaultParallelism, -(-head["n"] // ROWS_A_TASK))
        deal = data.repartition(tasks, F.xxhash64("x", "y", F.monotonically_increasing_id()))
        table, plain = B.written(B.in_blocks(deal, lambda x: binned(x, cuts).T, lambda n, t: np.full(n, base)), "boosting-bins")
        met = np.zeros(width * width)
        if (np.diff(first) == 2).sum() > 1:  # others never share a column
            met = B.added(table.coalesce(tasks).rdd.map(_decode).mapPartitions(_together), width * width, MERGED_HERE)
        columns = Columns.of(np.diff(first), met.reshape(width, width))
        table, rows = table.mapInArrow(_stored(columns), B.SCHEMA), None
        paired = head["n"] / tasks * len(columns.pairs) <= PAIRED
        for done in range(self.rounds):
            if done % self.write_every == 0:  # a written table ends the chain of kept margins
                if path is not None:
                    table = table.mapInArrow(_add_trees(model.trees[-self.write_every:], model, columns), B.SCHEMA)
                old, (table, path) = path or plain, B.written(table, "boosting-rows")
                before, rows = rows, B.kept(table, _held, tasks)
                if before is not None:
                    before.unpersist()
                drop_scratch(spark, [old])
                before = None
            else:
                before, rows = rows, rows.map(_moved_by(model.trees[-1], model, columns)).persist(StorageLevel.MEMORY_AND_DISK)
            model.trees.append(self.grow(rows, columns, first, paired))
            if before is not None:  # the first pass of the round has moved the margins
                before.unpersist()
        if rows is not None:
            rows.unpersist()
        drop_scratch(spark, [path or plain])
        return model

    def grow(self, rows: RDD, columns: Columns, first: np.ndarray, paired: bool = False) -> Tree:
        """One tree: a pass over all blocks per level, or per two levels where pairs of columns are summed."""
        if not self.depth:
            raise ValueError("a tree needs a level")
        tree, level, depth, tasks, above = Tree(), [0], 0, rows.getNumPartitions(), None
        while level and depth < self.depth:
            two = paired and depth + 2 < self.depth and tasks * 24 * len(level) * columns.sums_a_node(True) <= MERGED_HERE
            summed = level if two or above is None else [min(kids, key=lambda k: tree.n[k]) for kids in zip(level[::2], level[1::2])]
            size = 3 * len(summed) * columns.sums_a_node(two)
            merged = B.added(rows.mapPartitions(_histograms(tree if depth else None, summed, depth, columns, two)), size, MERGED_HERE)
            parts = columns.parts(merged.reshape(3, -1), len(summed), two)
            sums = columns.by_slot(parts)
            if summed is not level:  # a node, or its parent less its sibling
                other = above - sums
                sums = np.stack([(sums if node == summed[k // 2] else other)[:, k // 2] for k, node in enumerate(level)], axis=1)
            hist = columns.spread(sums, first)
            if depth == 0:
                tree.add(0, *hist[:, 0, :first[1]].sum(axis=1))
            parents, level, depth = level, self.split(tree, level, hist, first), depth + 1
            above = sums[:, [k for k, node in enumerate(parents) if tree.feature[node] >= 0]]
            if two and level:
                kids = [side for k, node in enumerate(parents) if tree.feature[node] >= 0
                        for side in columns.children(parts, k, tree.feature[node], tree.bin[node])]
                sums = np.stack(kids, axis=1)
                parents, level, depth = level, self.split(tree, level, columns.spread(sums, first), first), depth + 1
                above = sums[:, [k for k, node in enumerate(parents) if tree.feature[node] >= 0]]
        return tree

    def split(self, tree: Tree, level: list[int], hist: np.ndarray, first: np.ndarray) -> list[int]:
        """The children of the nodes of ``level``, left and right of every node that is split."""
        below = []
        for node, found in zip(level, best_splits(hist, first, self.reg_lambda, self.least_hessian)):
            if found is not None:
                feature, cut, gain, left = found
                whole = np.array([tree.G[node], tree.H[node], tree.n[node]])
                kids = tree.add(tree.depth[node] + 1, *left), tree.add(tree.depth[node] + 1, *(whole - left))
                tree.split(node, feature, cut, gain, *kids)
                below += kids
        return below


def _decode(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stored columns as (columns, rows), labels, margins) of a written block."""
    return np.frombuffer(r["x"], np.uint8).reshape(-1, r["n"]), np.frombuffer(r["y"]), np.frombuffer(r["rest"])


def _held(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, with labels 0 and 1 as bytes: every pass reads what is kept."""
    stored, y, margin = _decode(r)
    return stored, y.astype(np.int8) if np.isin(y, (0.0, 1.0)).all() else y, margin


def _stored(columns: Columns):
    """Written blocks of all features' bins as blocks of stored columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                bins, y, margin = _decode(r)
                yield B.row(r["block"], r["n"], columns.stored(bins), y, margin)
    return run


def _moved(margin: np.ndarray, stored: np.ndarray, tree: Tree, columns: Columns, depth: int, rate: float, reg_lambda: float) -> np.ndarray:
    return margin + rate * tree.weights(reg_lambda)[columns.walk(tree, stored, depth)]


def _moved_by(tree: Tree, model: NewtonBoostingModel, columns: Columns):
    settings = columns, model.depth, model.rate, model.reg_lambda  # tasks are sent no more than they use
    return lambda block: (block[0], block[1], _moved(block[2], block[0], tree, *settings))


def _add_trees(trees: list[Tree], model: NewtonBoostingModel, columns: Columns):
    """Written blocks with the margins of some more trees."""
    settings = columns, model.depth, model.rate, model.reg_lambda

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                stored, y, margin = _decode(r)
                for t in trees:
                    margin = _moved(margin, stored, t, *settings)
                yield B.row(r["block"], r["n"], stored, y, margin)
    return run


def _histograms(tree: Tree | None, level: list[int], depth: int, columns: Columns, paired: bool = False):
    """Sums of g, h and rows by (node of ``level``, slot) of each stored column, then of each pair of columns, over the rows of a
    task, as one vector."""
    sizes = np.diff(columns.first).tolist()
    groups = [[c] for c in range(len(sizes))] + [list(p) for p in columns.pairs] if paired else columns.joined(len(level))

    def run(blocks) -> Iterator[np.ndarray]:
        out = [np.zeros((3, len(level) * math.prod(sizes[c] for c in g))) for g in groups]
        for stored, y, margin in blocks:
            at = None
            if tree is not None:
                number = np.full(len(tree.feature), -1)
                number[level] = np.arange(len(level))
                at = number.take(columns.walk(tree, stored, depth))
                some = np.flatnonzero(at >= 0)
                if len(some) < len(at):
                    at, stored, y, margin = at.take(some), stored.take(some, axis=1), y.take(some), margin.take(some)
            p = 1.0 / (1.0 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            for group, sums in zip(groups, out):
                slot = stored[group[0]]
                for c in group[1:]:  # all bins of a group are less than 2^16
                    slot = slot.astype(np.uint16) * np.uint16(sizes[c]) + stored[c]
                slot = slot.astype(np.int64) if at is None else at * (sums.shape[1] // len(level)) + slot
                for k, v in enumerate((g, h, None)):
                    sums[k] += np.bincount(slot, v, sums.shape[1])
        if not paired:
            out = _by_column(out, groups, sizes, len(level))
        yield np.concatenate(out, axis=1).ravel()
    return run


def _by_column(sums: list[np.ndarray], groups: list[list[int]], sizes: list[int], nodes: int) -> list[np.ndarray]:
    """Sums (3, nodes x slots) of each column from those by all bins of a group of columns."""
    out: list[np.ndarray] = [np.zeros(0)] * len(sizes)
    for group, s in zip(groups, sums):
        s = s.reshape(3, nodes, *[sizes[c] for c in group])
        for k, c in enumerate(group):
            out[c] = s.sum(axis=tuple(i + 2 for i in range(len(group)) if i != k)).reshape(3, -1)
    return out
