"""Deep pages of a long listing (S6, T5): a sorted table with a rank index.

``ORDER BY .. LIMIT .. OFFSET`` on any table keeps offset + limit rows in every task.  A listing that is paged
often is written once in its order, in files of bounded size, with an index of one row per file: how many
rows come before it.  A page then reads the one or two files that hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a file: a page reads little more than this.
ROWS_PER_FILE = 100_000


def write_pages(df: DataFrame, key: str, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write ``df`` below ``path`` by descending ``key`` (null keys last), with its rank index.

    Rows of equal keys lie in one file; the order among them follows their other columns of simple types."""
    rest = [c for c, t in df.dtypes if c != key and not t.startswith(("array", "map", "struct", "binary"))]
    order = [F.desc_nulls_last(key), *[F.col(c) for c in rest]]
    files = max(1, -(-df.count() // rows_per_file))
    df.repartitionByRange(files, F.desc_nulls_last(key)).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/rows")
    spark = df.sparkSession
    each = spark.read.schema(df.schema).parquet(f"{path}/rows").groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.max(key).alias("top"))
    before = Window.orderBy(F.desc_nulls_last("top"), "file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    each.select("file", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")).write.mode("overwrite").parquet(f"{path}/index")


def read_page(spark: SparkSession, schema, key: str, path: str, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the listing, in its order."""
    offset, limit = max(0, int(offset)), max(0, int(limit))
    index = spark.read.parquet(f"{path}/index")
    held = index.filter((F.col("first") < offset + limit) & (F.col("first") + F.col("n") > offset)).orderBy("first").collect()  # files of the page
    if not held:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[r["file"] for r in held])
    rest = [c for c, t in rows.dtypes if c != key and not t.startswith(("array", "map", "struct", "binary"))]
    return rows.orderBy(F.desc_nulls_last(key), *rest).offset(offset - held[0]["first"]).limit(limit)
