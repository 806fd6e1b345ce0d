"""Model-quality metrics.

All metrics are aggregates over (score, label) rows; the ranking metrics go
through per-score counts first (one row per distinct score), then a bucketed
running sum, so no step holds all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.hashing import unit_hash
from riskframe.functions.scoring import bce_term
from riskframe.operators.prefix import running_sums
from riskframe.session import cut_lineage


def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score with its positive and negative counts."""
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def auc(df: DataFrame, score: str = "probability", label: str = "label") -> DataFrame:
    """Exact ROC-AUC (ties count one half); 0.5 when one class is absent.

    AUC = sum_s pos(s) * (neg(<s) + neg(s)/2) / (P * N).
    """
    sc = score_counts(df.filter(F.col(score).isNotNull()), score, label)
    cum = running_sums(sc, "score", ["neg"], inclusive=False)
    agg = cum.agg(F.sum(F.col("pos") * (F.col("cum_neg") + 0.5 * F.col("neg"))).alias("_num"),
                  F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return agg.select(
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
               F.col("_num") / (F.col("n_pos").cast("double") * F.col("n_neg"))).otherwise(F.lit(0.5)).alias("auc"),
        "n_pos", "n_neg")


def roc_curve(df: DataFrame, score: str = "probability", label: str = "label", points: int = 100) -> DataFrame:
    """ROC points at every distinct threshold (descending), plus (0,0), thinned
    to every ``max(1, len // points)``-th point, then (1,1) appended.

    Output ``(idx, fpr, tpr)``; ``idx`` orders the curve.
    """
    sc = cut_lineage(score_counts(df.filter(F.col(score).isNotNull()), score, label).withColumn("one", F.lit(1)), "roc-scores")
    t = sc.agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()  # three numbers
    n_pos, n_neg, length = F.lit(t["P"] or 0), F.lit(t["N"] or 0), t["n"] + 1
    # cum_one = 1-based rank of the distinct score in descending order (point 0 is the origin)
    cum = running_sums(sc, "score", ["pos", "neg", "one"], descending=True)
    step = max(1, length // points)
    pts = cum.select(F.col("cum_one").cast("bigint").alias("idx"),
                     F.try_divide(F.col("cum_neg").cast("double"), n_neg).alias("fpr"),
                     F.try_divide(F.col("cum_pos").cast("double"), n_pos).alias("tpr"))
    origin = df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("idx"), F.lit(0.0).alias("fpr"),
                                             F.lit(0.0).alias("tpr"))
    kept = origin.unionByName(pts).filter(F.col("idx") % step == 0)
    end = df.sparkSession.range(1).select(F.lit(length).cast("bigint").alias("idx"), F.lit(1.0).alias("fpr"),
                                          F.lit(1.0).alias("tpr"))
    return kept.unionByName(end)


def confusion(df: DataFrame, score: str = "probability", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """tp, fp, tn, fn at ``score >= threshold``."""
    pred = F.col(score) >= F.lit(threshold)
    y = F.col(label) == 1
    return df.agg(F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
                  F.count_if(~pred & ~y).alias("tn"), F.count_if(~pred & y).alias("fn"))


def classification_metrics(df: DataFrame, score: str = "probability", label: str = "label",
                           threshold: float = 0.5) -> DataFrame:
    """Accuracy, AUC, Gini, precision, recall, F1 (0 when undefined), confusion matrix."""
    c = confusion(df, score, label, threshold)
    j = c.withColumn("auc", auc(df, score, label).select("auc").scalar())  # scalar subquery
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    precision = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return j.select(
        F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        F.col("auc"), (2 * F.col("auc") - 1).alias("gini"),
        precision.alias("precision"), recall.alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        "tn", "fp", "fn", "tp")


def log_loss(df: DataFrame, score: str = "probability", label: str = "label") -> DataFrame:
    """Mean binary cross-entropy, p clipped to [1e-7, 1-1e-7]."""
    return df.agg(F.avg(bce_term(score, label)).alias("log_loss"))


def score_sample(df: DataFrame, id_col: str, score: str, label: str, n: int = 500, seed: int = 42) -> DataFrame:
    """Deterministic sample of at most ``n`` (score, label) pairs without replacement
    (the ``n`` rows with the smallest per-row hash; distributed top-k)."""
    return df.select(id_col, score, label, unit_hash(id_col, seed).alias("_h")) \
        .orderBy("_h", id_col).limit(n).drop("_h")
