"""Distributed running sums over an ordered key (used by W1, W2, E28, medians).

A window ``ORDER BY key`` without ``PARTITION BY`` runs in one task.  Instead the rows are
range-partitioned by the key in its own type (NULL sorts first, NaN last, as in any Spark
order) and written with their partition number.  Each partition is a window of its own, and the
totals of the partitions before it are added.  There is one path for every input size; the
table of totals has one row per shuffle partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import cut_lineage


def running_sums(df: DataFrame, key: str, cols: list[str], descending: bool = False, inclusive: bool = True,
                 tie_breaker: str | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over the rows up to this one, ordered by ``key`` (and ``tie_breaker``).

    ``inclusive=False`` gives the sum over strictly earlier rows.  Every row stays, whatever its key."""
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc(key) if descending else F.asc(key)]
    if tie_breaker:
        order.append(F.asc(tie_breaker))
    rows = cut_lineage(df, "running-input")  # the range partitioner samples its input: write it once
    ranged = cut_lineage(rows.repartitionByRange(partitions, *order).withColumn("_part", F.spark_partition_id()),
                         "running-ranges")
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols]).select(
        "_part", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in cols])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    return ranged.join(offsets, "_part").select(*df.columns, *[
        (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in cols])
