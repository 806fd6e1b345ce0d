"""The user dimension as a table that batches of visits change in place.

Users lie in buckets by a hash of their name; a batch rewrites only the buckets it touches, by dynamic
partition overwrite.  Every row keeps the last batch it counts, so a batch that is applied again (after a
failure between its buckets, or by mistake) changes nothing twice.  Ids are dealt per bucket, so a new
user needs no look at the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.operators.joins import NAME_CHARS, name_key
from riskframe.session import cut_lineage

SCHEMA = ("user_id bigint, name string, created_at timestamp_ntz, last_seen timestamp_ntz, visits bigint, evaluations bigint, "
          "last_batch bigint, bucket int")


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or no rows before its first batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _rewrite(rows: DataFrame, path: str) -> None:
    """Replace the buckets that ``rows`` fill; read and written folder are the same, so the rows are frozen first."""
    cut_lineage(rows, "user-buckets").repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("bucket").parquet(path)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def apply_batch(spark: SparkSession, path: str, arrivals: DataFrame, batch_id: int, buckets: int = 64) -> None:
    """Add the events ``arrivals`` (name, ts, kind = 'visit' or 'evaluation') of batch ``batch_id`` to the table at ``path``.

    Batches come in ascending order; one that a row already counts leaves it as it is.  The number of
    buckets belongs to the table and must not change."""
    key = name_key(F.col("name"))
    new = cut_lineage(arrivals.withColumn("_k", key).groupBy("_k").agg(
        F.min(F.struct("ts", "name"))["name"].alias("_name"), F.min("ts").alias("_first"), F.max("ts").alias("_last"),
        F.count_if(F.col("kind") == "visit").alias("_v"), F.count_if(F.col("kind") == "evaluation").alias("_e"))
        .withColumn("_b", bucket_of("_k", buckets)), "user-arrivals")
    touched = [r[0] for r in new.select("_b").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    old = _existing(spark, path, SCHEMA).filter(F.col("bucket").isin(touched)).withColumn("_k", key)
    both = old.join(new, "_k", "full")
    bucket = F.coalesce("bucket", "_b")
    counted = F.coalesce(F.col("last_batch") >= batch_id, F.lit(False)) | F.col("_v").isNull()
    is_new = F.col("last_batch").isNull()
    zero = F.lit(0).cast("bigint")

    def plus(column: str, more: str):
        base = F.coalesce(column, zero)
        return F.when(counted, base).otherwise(base + F.coalesce(more, zero)).alias(column)

    # the k-th user of a bucket has the id k * buckets + bucket + 1; new ones follow in the order of their names
    seq = F.max(F.floor((F.col("user_id") - 1) / buckets)).over(Window.partitionBy("_bucket"))
    place = F.sum(F.col("_new").cast("int")).over(Window.partitionBy("_bucket").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("_bucket", bucket).withColumn("_new", is_new)
    rows = rows.withColumn("_id", F.when(F.col("_new"), (F.coalesce(seq, F.lit(-1)) + place) * buckets + F.col("_bucket") + 1).otherwise(F.col("user_id")))
    out = rows.select(F.col("_id").cast("bigint").alias("user_id"), F.when(F.col("_new"), F.substring(F.trim("_name"), 1, NAME_CHARS))
                      .otherwise(F.col("name")).alias("name"), F.coalesce("created_at", "_first").alias("created_at"),
                      F.when(counted, F.col("last_seen")).otherwise(F.greatest("last_seen", "_last")).alias("last_seen"),
                      plus("visits", "_v"), plus("evaluations", "_e"),
                      F.when(counted, F.col("last_batch")).otherwise(F.lit(batch_id).cast("bigint")).alias("last_batch"),
                      F.col("_bucket").alias("bucket"))
    _rewrite(out, path)


ACTIVITY = "user_id bigint, first_seen timestamp_ntz, last_seen timestamp_ntz, visits bigint, evaluations bigint, last_batch bigint, bucket int"


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ACTIVITY).parquet(path)


def count_activity(spark: SparkSession, path: str, events: DataFrame, batch_id: int, buckets: int = 64) -> None:
    """Add the events (user_id, ts, kind) of a batch to the counters of their users, as ``apply_batch`` does by name.

    Events without a user are one user with a null id."""
    new = cut_lineage(events.groupBy("user_id").agg(
        F.min("ts").cast("timestamp_ntz").alias("_first"), F.max("ts").cast("timestamp_ntz").alias("_last"),
        F.count_if(F.col("kind") == "visit").alias("_v"), F.count_if(F.col("kind") == "evaluation").alias("_e"))
        .withColumnRenamed("user_id", "_u").withColumn("_b", bucket_of("_u", buckets)), "activity")
    touched = [r[0] for r in new.select("_b").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    old = _existing(spark, path, ACTIVITY).filter(F.col("bucket").isin(touched))
    both = old.join(new, old["user_id"].eqNullSafe(new["_u"]), "full")
    fresh = F.col("_v").isNotNull() & ~F.coalesce(F.col("last_batch") >= batch_id, F.lit(False))
    zero = F.lit(0).cast("bigint")
    out = both.select(
        F.coalesce("user_id", "_u").alias("user_id"),
        F.when(fresh, F.least("first_seen", "_first")).otherwise(F.col("first_seen")).alias("first_seen"),
        F.when(fresh, F.greatest("last_seen", "_last")).otherwise(F.col("last_seen")).alias("last_seen"),
        *[(F.coalesce(c, zero) + F.when(fresh, F.col(more)).otherwise(zero)).alias(c) for c, more in (("visits", "_v"), ("evaluations", "_e"))],
        F.when(fresh, F.lit(batch_id).cast("bigint")).otherwise(F.col("last_batch")).alias("last_batch"),
        F.coalesce("bucket", "_b").alias("bucket"))
    _rewrite(out, path)
