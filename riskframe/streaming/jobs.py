"""Structured Streaming jobs (ST1-ST5).

The per-request flow of the source product (score -> store -> counters) is a
stream: applications arrive as files, are scored in micro-batches and
appended; dashboards are streaming aggregates; late labels meet their
evaluations in a stream-stream join.  Event times arrive as
TIMESTAMP_NTZ and are cast to TIMESTAMP (session time zone UTC) before a
watermark is set.  All sinks are idempotent per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskframe.operators.joins import latest_per_key
from riskframe.operators.user_table import count_activity
from riskframe.sources.sinks import write_batch_idempotent

ScoreBatch = Callable[[DataFrame], DataFrame]


def _event_time(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.col(col).cast("timestamp"))


def application_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Applications arriving as Parquet files in ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def scoring_stream(spark: SparkSession, source: DataFrame, score_batch: ScoreBatch, sink_path: str,
                   checkpoint: str, dedup_delay: str = "30 days") -> StreamingQuery:
    """ST1 (+ST4): score every micro-batch and append it to the fact table.

    Re-sent applications are dropped with ``dropDuplicatesWithinWatermark``.
    ``foreachBatch`` is at-least-once, so each batch is written under its own
    ``batch_id`` partition with overwrite (a retried batch replaces itself).
    For a hot model swap (ST4) ``score_batch`` reads the newest registry row
    itself, so every batch uses the newest version.
    """
    src = _event_time(source, "created_at").withWatermark("created_at", dedup_delay) \
        .dropDuplicatesWithinWatermark(["app_id"])

    def run(batch: DataFrame, batch_id: int) -> None:
        write_batch_idempotent(score_batch(batch), sink_path, batch_id)

    return src.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def daily_trend_stream(source: DataFrame, sink_path: str, checkpoint: str, lateness: str = "1 day") -> StreamingQuery:
    """ST2: tumbling one-day windows of count and mean probability, in update mode.

    A batch emits only the days it changed, written under its ``batch_id`` (a retried batch
    replaces itself); :func:`newest` reads the current trend.  The watermark ends a day's
    state ``lateness`` after the newest event; rows that come later are not counted.
    """
    agg = _event_time(source, "created_at").withWatermark("created_at", lateness) \
        .groupBy(F.window("created_at", "1 day").alias("w")) \
        .agg(F.count(F.lit(1)).alias("n"), F.avg("probability").alias("avg_probability"))

    def run(batch: DataFrame, batch_id: int) -> None:
        write_batch_idempotent(batch.select(F.to_date(F.col("w.start")).alias("day"), "n", "avg_probability"),
                               sink_path, batch_id)

    return agg.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def user_counter_stream(activity: DataFrame, sink_path: str, checkpoint: str) -> StreamingQuery:
    """ST3: per-user first/last seen, visits and evaluations, kept in a user table.

    The stream itself holds no state: a batch is reduced to its users and added to their rows in the table, whose buckets
    are rewritten only where it touches them (:mod:`riskframe.operators.user_table`).  Users that stay away cost
    nothing, returning ones find their counters in the table, and a retried batch counts once."""
    def run(batch: DataFrame, batch_id: int) -> None:
        count_activity(batch.sparkSession, sink_path, batch, batch_id)

    return activity.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retraining_stream(spark: SparkSession, labels: DataFrame, label_path: str, retrain: Callable[[DataFrame], None], checkpoint: str,
                      least: int = 50) -> StreamingQuery:
    """ST4: labels arrive; every batch that leaves at least ``least`` of them calls ``retrain`` with all labels so far,
    which appends the new model's registry row - the swap that scoring streams see at their next batch."""
    def run(batch: DataFrame, batch_id: int) -> None:
        write_batch_idempotent(batch, label_path, batch_id)
        known = spark.read.parquet(label_path).drop("batch_id")
        if not batch.isEmpty() and known.count() >= least:
            retrain(known)

    return labels.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, sink_path: str, key: str) -> DataFrame:
    """The latest row of every key in a sink written batch by batch."""
    rows = spark.read.parquet(sink_path)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "batch_id")]), "batch_id").alias("r"))
    return last.select(key, "r.*")


def late_label_stream(evaluations: DataFrame, labels: DataFrame, sink_path: str, checkpoint: str,
                      horizon: str = "60 days") -> StreamingQuery:
    """ST5: labels that arrive up to ``horizon`` after their evaluation are joined to it
    (stream-stream join; watermarks on both sides bound the join state)."""
    e = _event_time(evaluations, "created_at").withWatermark("created_at", "1 day").alias("e")
    lab = _event_time(labels, "labelled_at").withWatermark("labelled_at", "1 day").alias("l")
    cond = (F.col("e.app_id") == F.col("l.app_id")) & \
        (F.col("l.labelled_at") >= F.col("e.created_at")) & \
        (F.col("l.labelled_at") <= F.col("e.created_at") + F.expr(f"INTERVAL {horizon}"))
    j = e.join(lab, cond, "inner").select(F.col("e.app_id").alias("app_id"), F.col("e.aprobado").alias("aprobado"),
                                          F.col("l.aprobado_real").alias("aprobado_real"),
                                          F.col("l.labelled_at").alias("labelled_at"))
    return j.writeStream.outputMode("append").format("parquet").option("path", sink_path) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_late_labels(evaluations: DataFrame, joined: DataFrame) -> DataFrame:
    """ST5: every evaluation with its last label so far, if any: the true class where known, else the
    predicted one (left join; the newest label wins)."""
    last = latest_per_key(joined, "app_id", "labelled_at", ["aprobado_real"])
    return evaluations.join(last, "app_id", "left").withColumn(
        "final", F.coalesce("aprobado_real", "aprobado", F.lit(0)).cast("int"))
