"""Group fairness (A5, A6) in one grouping-sets pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_rates(df: DataFrame, target: str, groups: list[str]) -> DataFrame:
    """A5: approval rate and n per value of every grouping column.

    ``GROUPING SETS ((g1), (g2), ...)`` reads the data once; ``grouping_id``
    tells which dimension a row belongs to.
    """
    y = df.select(*groups, F.col(target).cast("double").alias("_y")).filter(F.col("_y").isNotNull())
    gs = y.groupingSets([[g] for g in groups], *groups).agg(
        F.avg("_y").alias("rate"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid"))
    dim = None
    value = None
    for i, g in enumerate(groups):
        # grouping_id bit for g is 0 when g is grouped
        bit = 1 << (len(groups) - 1 - i)
        cond = (F.col("_gid").bitwiseAND(F.lit(bit)) == 0)
        dim = F.when(cond, F.lit(g)) if dim is None else dim.when(cond, F.lit(g))
        value = F.when(cond, F.col(g).cast("string")) if value is None else value.when(cond, F.col(g).cast("string"))
    return gs.select(dim.alias("dimension"), value.alias("group_value"), "rate", "n")


def disparity(rates: DataFrame) -> DataFrame:
    """(max - min) group rate in points and its band."""
    d = rates.groupBy("dimension").agg(((F.max("rate") - F.min("rate")) * 100.0).alias("disparity_pts"))
    return d.withColumn("band", F.when(F.col("disparity_pts") < 10, "Baja")
                        .when(F.col("disparity_pts") < 20, "Moderada").otherwise("Alta"))
