"""Trees as one node table, and scoring as joins on it.

A node is a row (tree, node, depth, feature, threshold, left, right, value); ``x[feature] <= threshold`` goes to
``left``; a leaf has no feature and holds ``value``.  The table is plain Parquet: any SQL engine can score
with it.  ``walk`` does so with one join per level: the number of joins is the depth of the trees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.session import cut_lineage


def forest_nodes(spark: SparkSession, model_path: str) -> DataFrame:
    """Node table of a saved random forest; ``value`` of a leaf is its share of class 1.

    The saved ``data`` folder holds one row per node without its depth; depths follow from the root down,
    a join of the nodes with one level at a time."""
    saved = cut_lineage(spark.read.parquet(f"{model_path}/data").select("treeID", "nodeData.*"), "forest-data")
    level = saved.filter("id = 0").select("treeID", "id", "leftChild", "rightChild", F.lit(0).alias("depth"))
    depths, at = level.select("treeID", "id", "depth"), 0
    while True:
        at += 1
        kids = level.filter("leftChild >= 0").select("treeID", F.explode(F.array("leftChild", "rightChild")).alias("id"))
        level = cut_lineage(saved.join(kids, ["treeID", "id"]).select("treeID", "id", "leftChild", "rightChild", F.lit(at).alias("depth")),
                            "forest-level")
        if level.isEmpty():
            break
        depths = depths.unionByName(level.select("treeID", "id", "depth"))
    leaf, stats = F.col("leftChild") < 0, F.col("impurityStats")

    def inner(c: Column) -> Column:
        return F.when(~leaf, c)

    return saved.join(depths, ["treeID", "id"]).select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), "depth", inner(F.col("split.featureIndex")).alias("feature"),
        inner(F.get(F.col("split.leftCategoriesOrThreshold"), F.lit(0))).alias("threshold"), inner(F.col("leftChild")).alias("left"),
        inner(F.col("rightChild")).alias("right"), F.when(leaf, F.try_divide(stats[1], stats[0] + stats[1])).alias("value"),
        F.col("rawCount").alias("n"), stats[0].alias("class_0"), stats[1].alias("class_1"))


def first_levels(nodes: DataFrame, n_trees: int = 6, max_depth: int = 4) -> DataFrame:
    """The nodes of the first trees down to ``max_depth``; those at that depth are closed as leaves."""
    closed = F.col("depth") == max_depth
    shown = nodes.filter((F.col("tree") < n_trees) & (F.col("depth") <= max_depth))
    return shown.withColumn("leaf", F.col("feature").isNull() | closed).withColumns(
        {c: F.when(~closed, F.col(c)) for c in ("feature", "threshold", "left", "right")})


def walk(rows: DataFrame, nodes: DataFrame, id_col: str, x_col: str = "x") -> DataFrame:
    """(id, row, total, trees): the sum of the leaf values that a row meets, and how many trees it met.

    ``x_col``: ARRAY<DOUBLE>.  Rows with equal ids stay apart by ``row``.  Each level is one join on (tree, node)."""
    kept = nodes.select("tree", "node", "feature", "threshold", "left", "right", "value", "depth")
    levels = kept.agg(F.max("depth").alias("d"), F.collect_set("tree").alias("t")).first()  # one number per tree
    at = cut_lineage(rows.select(F.col(id_col), F.monotonically_increasing_id().alias("row"), F.col(x_col).alias("x")), "walk-rows") \
        .withColumn("tree", F.explode(F.array(*[F.lit(t) for t in sorted(levels["t"] or [])]).cast("array<int>"))).withColumn("node", F.lit(0))
    for _ in range(levels["d"] or 0):
        here = at.join(kept.drop("value", "depth"), ["tree", "node"])
        way = F.when(F.col("feature").isNull(), F.col("node")).when(F.get("x", F.col("feature")) <= F.col("threshold"), F.col("left")) \
            .otherwise(F.col("right"))
        at = here.select(id_col, "row", "x", "tree", way.alias("node"))
    return at.join(kept.select("tree", "node", "value"), ["tree", "node"]).groupBy(id_col, "row").agg(
        F.sum("value").alias("total"), F.count(F.lit(1)).alias("trees"))


def forest_probability(rows: DataFrame, nodes: DataFrame, id_col: str, x_col: str = "x") -> DataFrame:
    """(id, row, probability): mean of the trees' shares of class 1."""
    return walk(rows, nodes, id_col, x_col).select(id_col, "row", (F.col("total") / F.col("trees")).alias("probability"))


def boosted_probability(rows: DataFrame, nodes: DataFrame, id_col: str, x_col: str = "x") -> DataFrame:
    """(id, row, probability): logistic function of the base margin plus the trees' values."""
    base = nodes.agg(F.max("base")).scalar()
    return walk(rows, nodes, id_col, x_col).select(id_col, "row", (1.0 / (1.0 + F.exp(-(base + F.col("total"))))).alias("probability"))


#: Scoring with a node table in DuckDB: ``{nodes}`` and ``{rows}`` are table expressions, rows being (id, x DOUBLE[]).
WALK_SQL = """
WITH RECURSIVE nodes AS (SELECT * FROM {nodes}), points AS (SELECT * FROM {rows}),
place AS (
  SELECT id, x, tree, 0 AS node FROM points, (SELECT DISTINCT tree FROM nodes)
  UNION ALL
  SELECT id, x, p.tree, CASE WHEN x[feature + 1] <= threshold THEN n."left" ELSE n."right" END
  FROM place p JOIN nodes n ON n.tree = p.tree AND n.node = p.node WHERE n.feature IS NOT NULL)
SELECT id, sum(value) AS total, count(*) AS trees
FROM place p JOIN nodes n ON n.tree = p.tree AND n.node = p.node WHERE n.feature IS NULL GROUP BY id
"""
