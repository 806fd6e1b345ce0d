"""Scalar-expression and per-row top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.functions import scoring as SC
from riskframe.functions.text import clamp, clean_email, clean_user_name, email_is_valid
from riskframe.operators import explain as X
from riskframe.plans import sqlgen as G
from riskframe.plans.registry import query
from riskframe.plans.q_metrics import _AUC_SQL
from riskframe.sources import fixtures as fx

P12 = "round(p_latent, 12)"


def _apps_p(spark, sf):
    # probabilities compared at 12 decimals (exp() differs by an ulp between engines)
    return fx.applications(spark, sf).withColumn("p", F.round("p_latent", 12))


@query("E10", f"""
SELECT CASE WHEN {P12} >= 0.66 THEN 'APROBAR' WHEN {P12} >= 0.40 THEN 'REVISAR' ELSE 'RECHAZAR' END AS decision,
       CAST(count(*) AS BIGINT) AS n FROM applications GROUP BY 1""")
def e10_decision_band(spark, sf):
    return _apps_p(spark, sf).groupBy(SC.decision_band("p").alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query("E11", f"""
SELECT CASE WHEN {P12} > 0.65 THEN 'APROBAR' WHEN {P12} > 0.40 THEN 'REVISAR' ELSE 'RECHAZAR' END AS decision,
       CAST(count(*) AS BIGINT) AS n FROM applications GROUP BY 1""")
def e11_lab_decision_band(spark, sf):
    hi, lo = S.LAB_DECISION_THRESHOLDS
    return _apps_p(spark, sf).groupBy(SC.decision_band("p", hi, lo, strict=True).alias("decision")) \
        .agg(F.count(F.lit(1)).alias("n"))


def _verdict_sql(p: str) -> str:
    v = SC.VERDICTS
    return (f"CASE WHEN {p} >= 0.66 THEN '{v[0]}' WHEN {p} >= 0.40 THEN '{v[1]}' ELSE '{v[2]}' END")


@query("E12", f"""
SELECT CASE WHEN {P12} >= 0.66 THEN 'alta' WHEN {P12} >= 0.40 THEN 'media' ELSE 'baja' END AS risk,
       CASE WHEN {P12} >= 0.66 THEN 'Excelente' WHEN {P12} >= 0.40 THEN 'Moderada' ELSE 'Riesgosa' END AS risk_label,
       {_verdict_sql(P12)} AS verdict, CAST(count(*) AS BIGINT) AS n FROM applications GROUP BY 1, 2, 3""")
def e12_risk_band(spark, sf):
    a = _apps_p(spark, sf)
    return a.groupBy(SC.risk_band("p").alias("risk"), SC.risk_label("p").alias("risk_label"),
                     SC.verdict_text("p").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("E13", f"""
SELECT CAST(CASE WHEN {P12} >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS prediction, aprobado,
       CAST(count(*) AS BIGINT) AS n FROM applications GROUP BY 1, 2""")
def e13_binary_prediction(spark, sf):
    return _apps_p(spark, sf).groupBy(SC.binary_prediction("p").alias("prediction"), "aprobado") \
        .agg(F.count(F.lit(1)).alias("n"))


@query("E14", f"""
SELECT round({P12} * 100.0, 1) AS percent, CAST(count(*) AS BIGINT) AS n FROM applications GROUP BY 1""")
def e14_percent(spark, sf):
    return _apps_p(spark, sf).groupBy(SC.percent("p").alias("percent")).agg(F.count(F.lit(1)).alias("n"))


@query("E15", """
SELECT CAST(count(*) FILTER (WHERE abs(z * 10) > 30) AS BIGINT) AS n_clipped,
       round(avg(1.0 / (1.0 + exp(-greatest(least(z * 10, 30.0), -30.0)))), 9) AS mean_sigmoid
FROM applications""")
def e15_sigmoid_clip(spark, sf):
    a = fx.applications(spark, sf).withColumn("z10", F.col("z") * 10)
    return a.agg(F.count_if(F.abs("z10") > 30).alias("n_clipped"),
                 F.round(F.avg(SC.sigmoid("z10", 30.0)), 9).alias("mean_sigmoid"))


_GELU_SQL = "0.5 * z * (1.0 + tanh(0.7978845608028654 * (z + 0.044715 * pow(z, 3))))"


@query("E16", f"SELECT round(avg({_GELU_SQL}), 9) AS mean_gelu, round(min({_GELU_SQL}), 9) AS min_gelu FROM applications")
def e16_gelu(spark, sf):
    a = fx.applications(spark, sf)
    return a.agg(F.round(F.avg(SC.gelu("z")), 9).alias("mean_gelu"), F.round(F.min(SC.gelu("z")), 9).alias("min_gelu"))


@query("E18", "SELECT app_id, z, round(p_latent, 9) AS p FROM applications")
def e18_scorecard(spark, sf):
    a = fx.application_features(spark, sf)
    z = SC.scorecard_z()
    return a.select("app_id", z.alias("z"), F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 9).alias("p"))


def _friendly_sql(base: str, level: str | None) -> str:
    m = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.FRIENDLY_LABELS.items())
    label = f"(CASE {base} {m} END)"
    if level is None:
        return label
    t = f"replace(replace({label}, 'Tu ', ''), 'Tus ', '')"
    cap = f"upper(substr({t}, 1, 1)) || lower(substr({t}, 2))"
    return f"{cap} || ': ' || replace({level}, '_', ' ')"


_LEVELS_UNION = " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS base, {c} AS level FROM applications"
                                   for c in S.CATEGORICAL_FEATURES)


@query("E19", f"""
SELECT base || '_' || level AS feature, {_friendly_sql('base', 'level')} AS label FROM ({_LEVELS_UNION})
UNION ALL SELECT * FROM (VALUES {', '.join(f"('{c}', '{S.FRIENDLY_LABELS[c]}')" for c in S.NUMERIC_FEATURES)})""")
def e19_friendly_labels(spark, sf):
    a = fx.applications(spark, sf)
    lv = a.select(F.explode(F.array(*[F.struct(F.lit(c).alias("base"), F.col(c).alias("level"))
                                      for c in S.CATEGORICAL_FEATURES])).alias("x")).select("x.*").distinct()
    dummies = lv.select(F.concat_ws("_", "base", "level").alias("feature"), SC.friendly_label("base", "level").alias("label"))
    bases = a.select(F.explode(F.array(*[F.lit(c) for c in S.NUMERIC_FEATURES])).alias("feature")).distinct() \
        .select("feature", SC.friendly_label("feature").alias("label"))
    return dummies.unionByName(bases)


def _impacts_sql() -> str:
    terms = [
        ("ingresos_mensuales", "ingresos_mensuales/1500.0*1.6"),
        ("historial_pagos", "CASE historial_pagos WHEN 'Malo' THEN -1.6 WHEN 'Regular' THEN -0.4 WHEN 'Bueno' THEN 0.7 ELSE 1.7 END"),
        ("educacion", "CASE educacion WHEN 'Primaria' THEN -0.3 WHEN 'Secundaria' THEN 0.0 WHEN 'Universitaria' THEN 0.5 ELSE 0.9 END"),
        ("creditos_activos", "-(0.45*creditos_activos)"),
        ("cargas_familiares", "-(0.15*cargas_familiares)"),
        ("situacion_laboral", "CASE situacion_laboral WHEN 'Empleado Público' THEN 0.8 WHEN 'Empleado Privado' THEN 0.6 WHEN 'Emprendedor' THEN 0.1 WHEN 'Negocio Propio' THEN 0.4 WHEN 'Trabajo Informal' THEN -0.6 ELSE -1.8 END"),
        ("tipo_credito", "CASE tipo_credito WHEN 'Microcrédito' THEN 0.5 WHEN 'Personal' THEN 0.2 WHEN 'Emprendimiento' THEN 0.0 WHEN 'Productivo' THEN -0.1 WHEN 'Vehicular' THEN -0.2 ELSE -0.5 END"),
        ("edad", "-(0.012*abs(edad-40))"),
    ]
    return " UNION ALL ".join(f"SELECT app_id, '{n}' AS feature, CAST({e} AS DOUBLE) AS impact FROM applications"
                              for n, e in terms)


def _factors_sql(k: int) -> str:
    return f"""
SELECT app_id, sign, CAST(rnk AS INTEGER) AS rank, feature, round(impact, 12) AS impact,
       round(least(1.0, abs(impact) / 3.0), 2) AS weight FROM (
  SELECT *, CASE WHEN impact > 0 THEN 'positive' ELSE 'negative' END AS sign,
         row_number() OVER (PARTITION BY app_id, impact > 0 ORDER BY abs(impact) DESC, feature) AS rnk
  FROM ({_impacts_sql()}) WHERE impact <> 0 AND abs(impact) >= 1e-6) WHERE rnk <= {k}"""


def _factors(spark, sf, k):
    a = fx.application_features(spark, sf).select("app_id", *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES) \
        .withColumn("contribs", SC.scorecard_contributions())
    t = X.factors_table(a, "app_id", "contribs", k)
    return t.withColumn("impact", F.round("impact", 12)).withColumn("rank", F.col("rank").cast("int"))


@query("W3", _factors_sql(5))
def w3_top_factors(spark, sf):
    return _factors(spark, sf, 5)


@query("E20", _factors_sql(5))
def e20_factor_weights(spark, sf):
    return _factors(spark, sf, 5)


_T3_RANKED = "SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY abs(impact) DESC, feature) AS k FROM impacts"


@query("T3", f"""
SELECT app_id, part, CAST(k AS INTEGER) AS rank, feature, round(impact, 12) + 0.0 AS impact FROM (
  SELECT *, 'shown' AS part FROM ({_T3_RANKED}) WHERE k <= 20
  UNION ALL SELECT *, 'considered' FROM ({_T3_RANKED}) WHERE k <= 12
  UNION ALL SELECT * EXCLUDE (k, s), row_number() OVER (PARTITION BY app_id, s ORDER BY k) AS k,
    CASE WHEN s > 0 THEN 'positive' ELSE 'negative' END FROM (SELECT *, sign(impact) AS s FROM ({_T3_RANKED})) WHERE s <> 0 QUALIFY
    row_number() OVER (PARTITION BY app_id, s ORDER BY k) <= 6)""", {"impacts": _impacts_sql()})
def t3_top_contributions(spark, sf):
    a = fx.application_features(spark, sf).select("app_id", *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES) \
        .withColumn("contribs", SC.scorecard_contributions())
    return X.contributions_table(a, "app_id").withColumn("impact", F.round("impact", 12) + F.lit(0.0))


@query("E22", """
SELECT historial_pagos, CASE historial_pagos WHEN 'Malo' THEN 'Regular' WHEN 'Regular' THEN 'Bueno'
       WHEN 'Bueno' THEN 'Excelente' END AS next_level, CAST(count(*) AS BIGINT) AS n FROM applications GROUP BY 1, 2""")
def e22_next_history_level(spark, sf):
    a = fx.applications(spark, sf)
    return a.groupBy("historial_pagos", SC.next_history_level("historial_pagos").alias("next_level")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("E23", """
SELECT greatest(25.0, least(edad, 60.0)) AS edad_clamped, CAST(count(*) AS BIGINT) AS n FROM applications GROUP BY 1""")
def e23_clamp(spark, sf):
    return fx.applications(spark, sf).groupBy(clamp("edad", 25.0, 60.0).alias("edad_clamped")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("E24", """
SELECT CAST(created_at AS DATE) AS day, strftime(created_at, 'v%Y.%m.%d-%H%M') AS version,
       strftime(created_at, '%Y%m%d_%H%M%S') AS file_stamp, CAST(count(*) AS BIGINT) AS n FROM evaluations GROUP BY 1, 2, 3""")
def e24_date_stamps(spark, sf):
    e = fx.evaluations(spark, sf)
    return e.groupBy(F.to_date("created_at").alias("day"),
                     F.concat(F.lit("v"), F.date_format("created_at", "yyyy.MM.dd-HHmm")).alias("version"),
                     F.date_format("created_at", "yyyyMMdd_HHmmss").alias("file_stamp")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("E25", f"""
SELECT app_id, '{{"rule":' || CAST(round({P12} * 100.0, 1) AS VARCHAR) || ',"inverse":' ||
       CAST(round(100.0 - round({P12} * 100.0, 1), 1) AS VARCHAR) || '}}' AS per_model FROM applications""")
def e25_per_model_json(spark, sf):
    a = _apps_p(spark, sf)
    pct = SC.percent("p")
    m = F.create_map(F.lit("rule"), pct, F.lit("inverse"), F.round(F.lit(100.0) - pct, 1))
    return a.select("app_id", SC.per_model_json(m).alias("per_model"))


@query("E26", """
SELECT user_id, substr(trim(name), 1, 40) AS name, substr(lower(trim(email)), 1, 120) AS email,
       regexp_matches(substr(lower(trim(email)), 1, 120), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AS email_valid FROM users_dim""")
def e26_user_quality(spark, sf):
    u = fx.users_dim(spark, sf)
    return u.select("user_id", clean_user_name("name").alias("name"), clean_email("email").alias("email"),
                    email_is_valid(clean_email("email")).alias("email_valid"))


@query("E27", "SELECT user_id, name, email, password_hash IS NOT NULL AS has_password FROM users_dim")
def e27_public_projection(spark, sf):
    u = fx.users_dim(spark, sf)
    return u.withColumn("has_password", F.col("password_hash").isNotNull()).select("user_id", "name", "email", "has_password")


_LOSS = "-(aprobado * ln(greatest(least({p}, 1 - 1e-7), 1e-7)) + (1 - aprobado) * ln(1 - greatest(least({p}, 1 - 1e-7), 1e-7)))"


@query("E28", f"""
SELECT auc, CASE WHEN auc >= 0.8 THEN 'bueno' WHEN auc >= 0.7 THEN 'aceptable' ELSE 'debil' END AS grade,
       (SELECT round(1 - avg({_LOSS.format(p='round(p_latent, 12)')}) / avg({_LOSS.format(p='base')}), 9)
        FROM applications, (SELECT avg(aprobado) AS base FROM applications)) AS loss_drop
FROM ({_AUC_SQL})""")
def e28_auc_grade(spark, sf):
    """Grade of the AUC, and how far the scores lower the log-loss of always giving the base rate."""
    from riskframe.operators import metrics as M
    from riskframe.plans.q_metrics import _scored, w1_auc
    rows = _scored(spark, sf)
    base = rows.agg(F.avg("label")).first()[0]
    last, first = (M.log_loss(d).scalar() for d in (rows, rows.withColumn("probability", F.lit(base))))
    return w1_auc(spark, sf).select("auc", SC.auc_grade("auc").alias("grade"),
                                    F.round(SC.loss_drop(first, last), 9).alias("loss_drop"))


# ---- what-if recommendations on the latent rule -------------------------------
def _rule_score(df):
    return df.withColumn("p", F.round(SC.sigmoid(SC.scorecard_z(), clip=None), 12))


def _recs(spark, sf):
    a = fx.application_features(spark, sf)
    return X.recommendations(a, "app_id", _rule_score)


def _z_sql(income: str, hist: str, credits: str) -> str:
    return (f"-1.2 + {income}/1500.0*1.6 + CASE {hist} WHEN 'Malo' THEN -1.6 WHEN 'Regular' THEN -0.4 WHEN 'Bueno' "
            f"THEN 0.7 ELSE 1.7 END + CASE educacion WHEN 'Primaria' THEN -0.3 WHEN 'Secundaria' THEN 0.0 WHEN "
            f"'Universitaria' THEN 0.5 ELSE 0.9 END - 0.45*{credits} - 0.15*cargas_familiares + CASE situacion_laboral "
            f"WHEN 'Empleado Público' THEN 0.8 WHEN 'Empleado Privado' THEN 0.6 WHEN 'Emprendedor' THEN 0.1 WHEN "
            f"'Negocio Propio' THEN 0.4 WHEN 'Trabajo Informal' THEN -0.6 ELSE -1.8 END + CASE tipo_credito WHEN "
            f"'Microcrédito' THEN 0.5 WHEN 'Personal' THEN 0.2 WHEN 'Emprendimiento' THEN 0.0 WHEN 'Productivo' THEN "
            f"-0.1 WHEN 'Vehicular' THEN -0.2 ELSE -0.5 END - 0.012*abs(edad-40)")


def _p(z: str) -> str:
    return f"round(1.0/(1.0+exp(-({z}))), 12)"


_NEXT = "CASE historial_pagos WHEN 'Malo' THEN 'Regular' WHEN 'Regular' THEN 'Bueno' WHEN 'Bueno' THEN 'Excelente' END"
_RECS_CTE = {"recs_base": f"""
SELECT app_id, creditos_activos, {_NEXT} AS nxt,
  {_p(_z_sql('ingresos_mensuales', 'historial_pagos', 'creditos_activos'))} AS p0,
  CASE WHEN floor(creditos_activos) >= 1 THEN {_p(_z_sql('ingresos_mensuales', 'historial_pagos', 'greatest(floor(creditos_activos) - 1, 0)'))} END AS p_c,
  CASE WHEN {_NEXT} IS NOT NULL THEN {_p(_z_sql('ingresos_mensuales', _NEXT, 'creditos_activos'))} END AS p_h,
  {_p(_z_sql('ingresos_mensuales*1.25', 'historial_pagos', 'creditos_activos'))} AS p_i
FROM applications""", "recs_long": """
SELECT app_id, 'credits' AS kind, round((p_c - p0) * 100.0, 1) AS gain FROM recs_base WHERE p_c - p0 > 0.01
UNION ALL SELECT app_id, 'history', round((p_h - p0) * 100.0, 1) FROM recs_base WHERE p_h - p0 > 0.01
UNION ALL SELECT app_id, 'income', round((p_i - p0) * 100.0, 1) FROM recs_base WHERE p_i - p0 > 0.01"""}


@query("T4", """
SELECT app_id, CAST(rk AS INTEGER) AS rank, kind, gain FROM (
  SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY gain DESC, CASE kind WHEN 'credits' THEN 1 WHEN 'history' THEN 2 ELSE 3 END) AS rk
  FROM recs_long) WHERE rk <= 4
UNION ALL SELECT app_id, 1, 'none', 0.0 FROM recs_base WHERE app_id NOT IN (SELECT app_id FROM recs_long)""", _RECS_CTE)
def t4_recommendations(spark, sf):
    r = _recs(spark, sf)
    return r.select("app_id", F.posexplode("recommendations").alias("rank", "r")) \
        .select("app_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("r.kind").alias("kind"),
                F.col("r.gain").alias("gain"))


@query("E21", """
SELECT app_id, kind, CASE kind
  WHEN 'credits' THEN printf('Si reduces tus créditos activos de %d a %d, tu aprobación sube ~%.0f%%.',
                             CAST(floor(b.creditos_activos) AS INTEGER), CAST(floor(b.creditos_activos) AS INTEGER) - 1, (b.p_c - b.p0) * 100.0)
  WHEN 'history' THEN printf('Mantener tus pagos al día (historial «%s») aumentaría tu aprobación ~%.0f%%.', b.nxt, (b.p_h - b.p0) * 100.0)
  ELSE printf('Demostrar ingresos un 25%% mayores elevaría tu aprobación ~%.0f%%.', (b.p_i - b.p0) * 100.0) END AS text
FROM recs_long JOIN recs_base b USING (app_id)
UNION ALL SELECT app_id, 'none', 'Tu perfil ya está bien optimizado. ¡Mantén tus buenos hábitos financieros!'
FROM recs_base WHERE app_id NOT IN (SELECT app_id FROM recs_long)""", _RECS_CTE)
def e21_recommendation_text(spark, sf):
    r = _recs(spark, sf)
    return r.select("app_id", F.explode("recommendations").alias("r")) \
        .select("app_id", F.col("r.kind").alias("kind"), F.col("r.text").alias("text"))
