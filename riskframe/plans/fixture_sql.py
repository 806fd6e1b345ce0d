"""DuckDB twins of the fixture views in :mod:`riskframe.sources.fixtures`.

They are used only by the oracle SQL of ``__spark_entry__.oracle_sql`` (the
driver's correctness check); the Spark side never runs SQL text from here.
"""

from __future__ import annotations

from riskframe.functions.hashing import unit_hash_sql as H
from riskframe.sources.fixtures import DIRTY_HEADERS, JUNK_SPELLINGS, NEGATIVE_SPELLINGS, POSITIVE_SPELLINGS


def _features_sql() -> str:
    return f"""
  SELECT o_orderkey AS app_id, o_orderdate AS created_at, o_custkey AS user_id, c_name AS user_name,
   CAST(20 + o_custkey % 50 AS DOUBLE) AS edad,
   CAST(greatest(c_acctbal, 0.0)/4.0 AS DOUBLE) AS ingresos_mensuales,
   CAST(o_custkey % 6 AS DOUBLE) AS cargas_familiares,
   CAST(o_orderkey % 6 AS DOUBLE) AS creditos_activos,
   CASE o_custkey % 2 WHEN 0 THEN 'Masculino' ELSE 'Femenino' END AS sexo,
   CASE o_custkey % 4 WHEN 0 THEN 'Primaria' WHEN 1 THEN 'Secundaria' WHEN 2 THEN 'Universitaria' ELSE 'Posgrado' END AS educacion,
   CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'Malo' WHEN '2' THEN 'Regular' WHEN '5' THEN 'Excelente' ELSE 'Bueno' END AS historial_pagos,
   CASE c_nationkey % 5 WHEN 0 THEN 'Banco A' WHEN 1 THEN 'Banco B' WHEN 2 THEN 'Banco C' WHEN 3 THEN 'Banco D' ELSE 'Cooperativa E' END AS institucion,
   CASE (o_orderkey+o_custkey) % 6 WHEN 0 THEN 'Hipotecario' WHEN 1 THEN 'Vehicular' WHEN 2 THEN 'Personal' WHEN 3 THEN 'Microcrédito' WHEN 4 THEN 'Productivo' ELSE 'Emprendimiento' END AS tipo_credito,
   CASE (o_custkey*7+o_orderkey*5) % 6 WHEN 0 THEN 'Empleado Público' WHEN 1 THEN 'Empleado Privado' WHEN 2 THEN 'Emprendedor' WHEN 3 THEN 'Negocio Propio' WHEN 4 THEN 'Trabajo Informal' ELSE 'Desempleado' END AS situacion_laboral,
   {H('o_orderkey', 42)} AS u
  FROM orders JOIN customer ON o_custkey = c_custkey"""


def _scored_sql(income_weight: str) -> str:
    return f"""
 SELECT b.*, 1.0/(1.0+exp(-b.z)) AS p_latent,
  CAST(CASE WHEN b.u < 1.0/(1.0+exp(-b.z)) THEN 1 ELSE 0 END AS INTEGER) AS aprobado
 FROM (
 SELECT a.*, -1.2 + a.ingresos_mensuales/1500.0*{income_weight}
  + CASE a.historial_pagos WHEN 'Malo' THEN -1.6 WHEN 'Regular' THEN -0.4 WHEN 'Bueno' THEN 0.7 ELSE 1.7 END
  + CASE a.educacion WHEN 'Primaria' THEN -0.3 WHEN 'Secundaria' THEN 0.0 WHEN 'Universitaria' THEN 0.5 ELSE 0.9 END
  - 0.45*a.creditos_activos - 0.15*a.cargas_familiares
  + CASE a.situacion_laboral WHEN 'Empleado Público' THEN 0.8 WHEN 'Empleado Privado' THEN 0.6 WHEN 'Emprendedor' THEN 0.1 WHEN 'Negocio Propio' THEN 0.4 WHEN 'Trabajo Informal' THEN -0.6 ELSE -1.8 END
  + CASE a.tipo_credito WHEN 'Microcrédito' THEN 0.5 WHEN 'Personal' THEN 0.2 WHEN 'Emprendimiento' THEN 0.0 WHEN 'Productivo' THEN -0.1 WHEN 'Vehicular' THEN -0.2 ELSE -0.5 END
  - 0.012*abs(a.edad-40) AS z
 FROM ({_features_sql()}) a) b"""


def _pick_sql(h: str, values: list[str]) -> str:
    n = len(values)
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE CAST(floor({h}*{n}) AS INTEGER) {whens} ELSE '{values[-1]}' END"


def _dirty_sql() -> str:
    num = []
    for c in ["edad", "ingresos_mensuales", "cargas_familiares", "creditos_activos"]:
        h = H("app_id", f"n_{c}")
        num.append(f"CASE WHEN {h} < 1.0/17.0 THEN '' WHEN {h} < 1.0/17.0 + 1.0/23.0 THEN 'abc' "
                   f"ELSE CAST({c} AS VARCHAR) END AS \"{DIRTY_HEADERS[c]}\"")
    cat = []
    for c in ["sexo", "educacion", "historial_pagos", "institucion", "tipo_credito", "situacion_laboral"]:
        h = H("app_id", f"c_{c}")
        cat.append(f"CASE WHEN {h} < 0.5/19.0 THEN ' ' WHEN {h} < 1.0/19.0 THEN NULL ELSE {c} END AS \"{DIRTY_HEADERS[c]}\"")
    ht, hs = H("app_id", "tgt"), H("app_id", "spell")
    tgt = (f"CASE WHEN {ht} < 0.05 THEN {_pick_sql(hs, JUNK_SPELLINGS)} "
           f"WHEN aprobado = 1 THEN {_pick_sql(hs, POSITIVE_SPELLINGS)} ELSE {_pick_sql(hs, NEGATIVE_SPELLINGS)} END "
           f"AS \"{DIRTY_HEADERS['aprobado']}\"")
    body = ", ".join([f"CAST(app_id AS VARCHAR) AS id"] + num + cat + [tgt, "CAST(NULL AS VARCHAR) AS notas", "'EC' AS pais",
                                                                       f"{H('app_id', 'dup')} AS _dup"])
    return f"SELECT * EXCLUDE (_dup, k) FROM (SELECT {body} FROM applications) d, (SELECT 1 UNION ALL SELECT 2) r(k) WHERE k = 1 OR _dup < 0.02"


FIXTURE_CTES = {
    "applications": _scored_sql("1.6"),
    "evaluations": """
  SELECT app_id, created_at, user_id, user_name, edad, ingresos_mensuales, cargas_familiares, creditos_activos,
   sexo, educacion, historial_pagos, institucion, tipo_credito, situacion_laboral,
   p_latent AS probability, round(p_latent*100.0, 1) AS percent,
   CASE WHEN p_latent >= 0.66 THEN 'alta' WHEN p_latent >= 0.40 THEN 'media' ELSE 'baja' END AS risk,
   CASE WHEN p_latent >= 0.66 THEN 'APROBAR' WHEN p_latent >= 0.40 THEN 'REVISAR' ELSE 'RECHAZAR' END AS decision,
   CAST(CASE WHEN p_latent >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS aprobado
  FROM applications""",
    "truth_labels": f"""
  SELECT app_id, aprobado AS aprobado_real, created_at + INTERVAL 30 DAY AS labelled_at
  FROM applications WHERE {H('app_id', 'lbl')} < 1.0/3.0
  UNION ALL
  SELECT app_id, CAST(1 - aprobado AS INTEGER) AS aprobado_real, created_at + INTERVAL 10 DAY AS labelled_at
  FROM applications WHERE {H('app_id', 'lbl')} < 1.0/3.0 AND {H('app_id', 'lbl')} < 1.0/30.0""",
    "users_dim": f"""
  SELECT c_custkey AS user_id, c_name AS name,
   'cliente' || substr(md5(CAST(c_custkey AS VARCHAR)||'|mail'),1,3) || '@correo.test' AS email,
   CASE WHEN {H('c_custkey', 'pwd')} < 0.5 THEN sha256(c_name || '|pwd') END AS password_hash,
   pu.created_at, pu.last_seen,
   CAST(coalesce(pu.evaluations, 0) % 7 + 1 AS BIGINT) AS visits,
   CAST(coalesce(pu.evaluations, 0) AS BIGINT) AS evaluations
  FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_at, max(o_orderdate) AS last_seen,
                                  count(*) AS evaluations FROM orders GROUP BY o_custkey) pu
   ON c_custkey = pu.o_custkey
  WHERE {H('c_custkey', 'usr')} < 0.9""",
    "visits": """
  SELECT user_id, ts, CASE WHEN event_type = 'purchase' THEN 'evaluation' ELSE 'visit' END AS kind
  FROM events WHERE event_type IN ('view', 'click', 'purchase')""",
    "inverted": f"""
  SELECT * REPLACE (CASE WHEN {H('app_id', 'inst')} < 1.0/9.0 THEN 'Cooperativa Nueva' ELSE institucion END AS institucion)
  FROM ({_scored_sql('(-1.6)')}) iv""",
}
FIXTURE_CTES["dirty"] = _dirty_sql()

_ORDER = ["applications", "evaluations", "truth_labels", "users_dim", "visits", "inverted", "dirty"]


def with_fixtures(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the fixture CTEs (DuckDB drops the unused ones)."""
    parts = [f"{name} AS ({FIXTURE_CTES[name]})" for name in _ORDER]
    for name, sql in (extra or {}).items():
        parts.append(f"{name} AS ({sql})")
    return "WITH " + ",\n".join(parts) + "\n" + body
