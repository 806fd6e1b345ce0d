"""Metric queries on the latent-rule scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.hashing import unit_hash_sql as H
from riskframe.operators import metrics as M
from riskframe.plans.registry import query
from riskframe.sources import fixtures as fx


def _scored(spark, sf):
    # scores compared at 12 decimals: exp() differs by an ulp between engines
    return fx.applications(spark, sf).select("app_id", F.round("p_latent", 12).alias("probability"),
                                             F.col("aprobado").alias("label"))


_SC = """sc AS (SELECT round(p_latent, 12) AS score, count(*) FILTER (WHERE aprobado = 1) AS pos,
                 count(*) FILTER (WHERE aprobado = 0) AS neg FROM applications GROUP BY 1)"""

_AUC_SQL = f"""
WITH {_SC}, c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cneg FROM sc)
SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (cneg + 0.5 * neg)) / (CAST(sum(pos) AS DOUBLE) * sum(neg))
       ELSE 0.5 END AS auc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c"""


def _nest(sql: str) -> str:
    return f"SELECT * FROM ({sql})"


@query("W1", _nest(_AUC_SQL))
def w1_auc(spark, sf):
    return M.auc(_scored(spark, sf))


@query("W2", _nest(f"""
WITH {_SC}, c AS (SELECT row_number() OVER (ORDER BY score DESC) AS idx,
   sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cpos,
   sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cneg FROM sc),
 t AS (SELECT sum(pos) AS p, sum(neg) AS n, count(*) + 1 AS len FROM sc),
 pts AS (SELECT CAST(0 AS BIGINT) AS idx, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
         UNION ALL SELECT idx, cneg / t.n, cpos / t.p FROM c, t)
SELECT pts.* FROM pts, t WHERE idx % greatest(1, t.len // 100) = 0
UNION ALL SELECT len, 1.0, 1.0 FROM t"""))
def w2_roc_curve(spark, sf):
    return M.roc_curve(_scored(spark, sf))


@query("M15", _nest(f"""
WITH cm AS (SELECT count(*) FILTER (WHERE round(p_latent, 12) >= 0.5 AND aprobado = 1) AS tp,
                   count(*) FILTER (WHERE round(p_latent, 12) >= 0.5 AND aprobado <> 1) AS fp,
                   count(*) FILTER (WHERE round(p_latent, 12) < 0.5 AND aprobado <> 1) AS tn,
                   count(*) FILTER (WHERE round(p_latent, 12) < 0.5 AND aprobado = 1) AS fn FROM applications),
 a AS ({_AUC_SQL})
SELECT (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE) AS accuracy, a.auc, 2 * a.auc - 1 AS gini,
       coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS precision,
       coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS recall,
       coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0) AS f1,
       CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp
FROM cm, a"""))
def m15_classification_metrics(spark, sf):
    return M.classification_metrics(_scored(spark, sf))


@query("M17", f"""
SELECT app_id, round(round(p_latent, 12), 9) AS probability, aprobado AS label FROM applications
ORDER BY {H('app_id', 42)}, app_id LIMIT 500""")
def m17_score_sample(spark, sf):
    s = M.score_sample(_scored(spark, sf), "app_id", "probability", "label", 500, 42)
    return s.withColumn("probability", F.round("probability", 9))


@query("E17", """
SELECT round(avg(-(aprobado * ln(greatest(least(round(p_latent, 12), 1 - 1e-7), 1e-7))
                 + (1 - aprobado) * ln(1 - greatest(least(round(p_latent, 12), 1 - 1e-7), 1e-7)))), 9) AS log_loss
FROM applications""")
def e17_log_loss(spark, sf):
    return M.log_loss(_scored(spark, sf)).withColumn("log_loss", F.round("log_loss", 9))
