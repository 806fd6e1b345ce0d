"""Portfolio monitoring aggregates.

Each is one aggregate job with partial (map-side) aggregation, so a hot key
(one credit type, one day, one user holding a third of the rows) is reduced in
every map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.text import missing_to_null
from riskframe.operators.joins import latest_per_key


def portfolio_summary(evals: DataFrame, labels: DataFrame, users: DataFrame) -> DataFrame:
    """A1 (+P11): one pass over the evaluations instead of five scans."""
    labelled_ids = labels.select("app_id").distinct().withColumn("_labelled", F.lit(1))
    e = evals.select("app_id", "aprobado", "probability").join(labelled_ids, "app_id", "left")
    agg = e.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("aprobado") == 1).alias("approved"),
        F.avg("probability").alias("_avg"),
        F.count("_labelled").alias("labelled"),
    )
    n_users = users.agg(F.count(F.lit(1)).alias("n")).scalar()
    return agg.select(
        "total", "approved",
        (F.col("total") - F.col("approved")).alias("rejected"),
        F.round(F.coalesce(F.try_divide(F.col("approved"), F.col("total")), F.lit(0.0)), 3).alias("approval_rate"),
        F.round(F.coalesce(F.col("_avg"), F.lit(0.0)), 3).alias("avg_probability"),
        "labelled",
        n_users.alias("users"),
    )


def by_credit_type(evals: DataFrame) -> DataFrame:
    """A2: count and approved per credit type, most frequent first."""
    return (evals.groupBy("tipo_credito")
            .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("aprobado"), F.lit(0)).cast("bigint").alias("approved"))
            .orderBy(F.desc("n"), "tipo_credito"))


def by_risk_band(evals: DataFrame) -> DataFrame:
    """A3 (+P12): count per non-empty risk band."""
    return (evals.filter(F.col("risk").isNotNull() & (F.col("risk") != ""))
            .groupBy("risk").agg(F.count(F.lit(1)).alias("n")))


def daily_trend(evals: DataFrame, days: int = 14) -> DataFrame:
    """A4/T5: the last ``days`` days that have data, ascending; count and mean probability."""
    d = evals.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg("probability"), F.lit(0.0)), 3).alias("avg_probability"))
    # top-k on the (small) per-day aggregate: TakeOrderedAndProject, then re-sort
    return d.orderBy(F.desc("day")).limit(days).orderBy("day")


def class_balance(df: DataFrame, target: str = "aprobado") -> DataFrame:
    """n_pos, n_neg, approval rate."""
    return df.agg(
        F.count_if(F.col(target) == 1).alias("n_pos"),
        F.count_if(F.col(target) == 0).alias("n_neg"),
    ).select("n_pos", "n_neg",
             F.round(F.try_divide(F.col("n_pos"), F.col("n_pos") + F.col("n_neg")), 6).alias("approval_rate"))


def missing_total(df: DataFrame, tokens_as_missing: bool = True) -> DataFrame:
    """Number of missing cells in the whole table (one aggregate)."""
    parts = []
    for c in df.columns:
        v = missing_to_null(c) if tokens_as_missing and dict(df.dtypes)[c] == "string" else F.col(c)
        parts.append(F.count_if(v.isNull()))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.agg(total.cast("bigint").alias("missing_cells"), F.count(F.lit(1)).alias("n_rows"))


def user_totals(users: DataFrame) -> DataFrame:
    """Users, total visits, total evaluations."""
    return users.agg(F.count(F.lit(1)).alias("n_users"),
                     F.coalesce(F.sum("visits"), F.lit(0)).cast("bigint").alias("total_visits"),
                     F.coalesce(F.sum("evaluations"), F.lit(0)).cast("bigint").alias("total_evaluations"))


def user_counters(activity: DataFrame) -> DataFrame:
    """Per user first/last seen, visits and evaluations from the activity log."""
    return activity.groupBy("user_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.count_if(F.col("kind") == "visit").alias("visits"),
        F.count_if(F.col("kind") == "evaluation").alias("evaluations"))


def list_evaluations(evals: DataFrame, limit: int = 100, offset: int = 0, cap: int = 500) -> DataFrame:
    """Newest first with LIMIT/OFFSET (limit capped)."""
    n = max(0, min(int(limit), cap))
    return evals.orderBy(F.desc("app_id")).offset(int(offset)).limit(n)


def list_users(users: DataFrame) -> DataFrame:
    """User listing, newest first (credential column never listed)."""
    return users.drop("password_hash").orderBy(F.desc("created_at"), "user_id")


def export_training(evals: DataFrame, labels: DataFrame, prefer_real: bool = True,
                    labelled_only: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Training table with the best label available for every evaluation."""
    from riskframe.schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES
    last = latest_per_key(labels, "app_id", "labelled_at", ["aprobado_real"]).drop("labelled_at")
    j = evals.select("app_id", *NUMERIC_FEATURES, *CATEGORICAL_FEATURES, "aprobado").join(last, "app_id", "left")
    if labelled_only:
        j = j.filter(F.col("aprobado_real").isNotNull())
    y = F.coalesce(F.col("aprobado_real"), F.col("aprobado"), F.lit(0)) if prefer_real \
        else F.coalesce(F.col("aprobado"), F.lit(0))
    extra = [c for c in (keep or []) if c in j.columns]
    return j.select(*extra, *NUMERIC_FEATURES, *CATEGORICAL_FEATURES, y.cast("int").alias("aprobado"))
