"""Monitoring, fairness and listing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.operators import fairness, monitoring
from riskframe.plans.registry import query
from riskframe.sources import fixtures as fx


@query("A1", """
SELECT CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE aprobado = 1) AS BIGINT) AS approved,
       CAST(count(*) - count(*) FILTER (WHERE aprobado = 1) AS BIGINT) AS rejected,
       round(coalesce(count(*) FILTER (WHERE aprobado = 1) / count(*), 0.0), 3) AS approval_rate,
       round(coalesce(avg(probability), 0.0), 3) AS avg_probability,
       CAST(count(l.app_id) AS BIGINT) AS labelled,
       (SELECT CAST(count(*) AS BIGINT) FROM users_dim) AS users
FROM evaluations e LEFT JOIN (SELECT DISTINCT app_id FROM truth_labels) l USING (app_id)
""")
def a1_portfolio_summary(spark, sf):
    return monitoring.portfolio_summary(fx.evaluations(spark, sf), fx.truth_labels(spark, sf), fx.users_dim(spark, sf))


@query("A2", """
SELECT tipo_credito, CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum(aprobado), 0) AS BIGINT) AS approved
FROM evaluations GROUP BY tipo_credito
""")
def a2_by_credit_type(spark, sf):
    return monitoring.by_credit_type(fx.evaluations(spark, sf))


@query("A3", """
SELECT risk, CAST(count(*) AS BIGINT) AS n FROM evaluations
WHERE risk IS NOT NULL AND risk <> '' GROUP BY risk
""")
def a3_by_risk_band(spark, sf):
    return monitoring.by_risk_band(fx.evaluations(spark, sf))


_A4_SQL = """
SELECT * FROM (
  SELECT CAST(created_at AS DATE) AS day, CAST(count(*) AS BIGINT) AS n,
         round(coalesce(avg(probability), 0.0), 3) AS avg_probability
  FROM evaluations GROUP BY 1 ORDER BY day DESC LIMIT 14) ORDER BY day
"""


@query("A4", _A4_SQL)
def a4_daily_trend(spark, sf):
    return monitoring.daily_trend(fx.evaluations(spark, sf))


@query("T5", _A4_SQL)
def t5_last_days(spark, sf):
    return monitoring.daily_trend(fx.evaluations(spark, sf), days=14)


_RATES_SQL = """
SELECT 'sexo' AS dimension, sexo AS group_value, avg(CAST(aprobado AS DOUBLE)) AS rate, CAST(count(*) AS BIGINT) AS n
FROM applications GROUP BY sexo
UNION ALL
SELECT 'institucion', institucion, avg(CAST(aprobado AS DOUBLE)), CAST(count(*) AS BIGINT)
FROM applications GROUP BY institucion
"""


@query("A5", f"SELECT dimension, group_value, round(rate, 9) AS rate, n FROM ({_RATES_SQL})")
def a5_group_rates(spark, sf):
    r = fairness.group_rates(fx.applications(spark, sf), S.TARGET, ["sexo", "institucion"])
    return r.withColumn("rate", F.round("rate", 9)).orderBy(F.desc("rate"))


@query("A6", f"""
SELECT dimension, round((max(rate) - min(rate)) * 100.0, 6) AS disparity_pts,
  CASE WHEN (max(rate) - min(rate)) * 100.0 < 10 THEN 'Baja'
       WHEN (max(rate) - min(rate)) * 100.0 < 20 THEN 'Moderada' ELSE 'Alta' END AS band
FROM ({_RATES_SQL}) GROUP BY dimension
""")
def a6_disparity(spark, sf):
    r = fairness.group_rates(fx.applications(spark, sf), S.TARGET, ["sexo", "institucion"])
    return fairness.disparity(r).withColumn("disparity_pts", F.round("disparity_pts", 6))


@query("A7", """
SELECT CAST(count(*) FILTER (WHERE aprobado = 1) AS BIGINT) AS n_pos,
       CAST(count(*) FILTER (WHERE aprobado = 0) AS BIGINT) AS n_neg,
       round(count(*) FILTER (WHERE aprobado = 1) / count(*), 6) AS approval_rate
FROM applications
""")
def a7_class_balance(spark, sf):
    return monitoring.class_balance(fx.applications(spark, sf))


def _dirty_missing_sql() -> str:
    from riskframe.sources.fixtures import DIRTY_HEADERS
    cols = ["id"] + [DIRTY_HEADERS[c] for c in S.REQUIRED_COLUMNS] + ["notas", "pais"]
    terms = " + ".join(
        f"count(*) FILTER (WHERE \"{c}\" IS NULL OR regexp_replace(regexp_replace(\"{c}\", '^\\s+', ''), '\\s+$', '') "
        f"IN ('', 'nan', 'NaN', 'None'))" for c in cols)
    return f"SELECT CAST({terms} AS BIGINT) AS missing_cells, CAST(count(*) AS BIGINT) AS n_rows FROM dirty"


@query("A8", _dirty_missing_sql())
def a8_missing_total(spark, sf):
    return monitoring.missing_total(fx.dirty(spark, sf))


@query("A13", """
SELECT CAST(count(*) AS BIGINT) AS n_users, CAST(coalesce(sum(visits), 0) AS BIGINT) AS total_visits,
       CAST(coalesce(sum(evaluations), 0) AS BIGINT) AS total_evaluations FROM users_dim
""")
def a13_user_totals(spark, sf):
    return monitoring.user_totals(fx.users_dim(spark, sf))


@query("A14", """
SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen,
       CAST(count(*) FILTER (WHERE kind = 'visit') AS BIGINT) AS visits,
       CAST(count(*) FILTER (WHERE kind = 'evaluation') AS BIGINT) AS evaluations
FROM visits GROUP BY user_id
""")
def a14_user_counters(spark, sf):
    return monitoring.user_counters(fx.visits(spark, sf))


@query("S6", """
SELECT * REPLACE (round(probability, 9) AS probability) FROM evaluations ORDER BY app_id DESC LIMIT 100 OFFSET 20
""")
def s6_list_evaluations(spark, sf):
    e = fx.evaluations(spark, sf).withColumn("probability", F.round("probability", 9))
    return monitoring.list_evaluations(e, limit=100, offset=20)


@query("S7", """
SELECT user_id, name, email, created_at, last_seen, visits, evaluations FROM users_dim
""")
def s7_list_users(spark, sf):
    return monitoring.list_users(fx.users_dim(spark, sf))


_EXPORT_SQL = """
SELECT edad, ingresos_mensuales, cargas_familiares, creditos_activos, sexo, educacion, historial_pagos,
       institucion, tipo_credito, situacion_laboral,
       CAST(coalesce(l.aprobado_real, e.aprobado, 0) AS INTEGER) AS aprobado
FROM evaluations e LEFT JOIN (
  SELECT app_id, arg_max(aprobado_real, (labelled_at, aprobado_real)) AS aprobado_real FROM truth_labels GROUP BY app_id) l USING (app_id)
"""


@query("S8", _EXPORT_SQL)
def s8_export_training(spark, sf):
    return monitoring.export_training(fx.evaluations(spark, sf), fx.truth_labels(spark, sf))


@query("P11", """
SELECT CAST(count(l.app_id) AS BIGINT) AS labelled, CAST(count(*) FILTER (WHERE e.aprobado = 1) AS BIGINT) AS approved,
       CAST(count(*) FILTER (WHERE e.aprobado = 1 AND l.app_id IS NOT NULL) AS BIGINT) AS labelled_approved
FROM evaluations e LEFT JOIN (SELECT DISTINCT app_id FROM truth_labels) l USING (app_id)
""")
def p11_filters(spark, sf):
    e = fx.evaluations(spark, sf).select("app_id", "aprobado")
    lab = fx.truth_labels(spark, sf).select("app_id").distinct().withColumn("_l", F.lit(1))
    j = e.join(lab, "app_id", "left")
    return j.agg(F.count("_l").alias("labelled"), F.count_if(F.col("aprobado") == 1).alias("approved"),
                 F.count_if((F.col("aprobado") == 1) & F.col("_l").isNotNull()).alias("labelled_approved"))


@query("P12", """
SELECT CAST(count(*) AS BIGINT) AS n_with_band FROM evaluations WHERE risk IS NOT NULL AND risk <> ''
""")
def p12_non_empty_band(spark, sf):
    e = fx.evaluations(spark, sf)
    return e.filter(F.col("risk").isNotNull() & (F.col("risk") != "")).agg(F.count(F.lit(1)).alias("n_with_band"))
