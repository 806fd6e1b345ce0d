"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.hashing import unit_hash, unit_hash_sql as H
from riskframe.operators import joins as J
from riskframe.plans.registry import query
from riskframe.sources import fixtures as fx


@query("J1", """
SELECT a.app_id, u.user_id, coalesce(u.name, 'Invitado') AS user_name
FROM applications a LEFT JOIN users_dim u ON a.user_id = u.user_id""")
def j1_attach_user(spark, sf):
    a = fx.applications(spark, sf).select("app_id", "user_id")
    return J.attach_user(a, fx.users_dim(spark, sf)).select("app_id", "user_id", "user_name")


@query("J2", """
SELECT e.app_id, l.aprobado_real, CAST(coalesce(l.aprobado_real, e.aprobado, 0) AS INTEGER) AS aprobado
FROM evaluations e LEFT JOIN (SELECT app_id, arg_max(aprobado_real, (labelled_at, aprobado_real)) AS aprobado_real
                              FROM truth_labels GROUP BY app_id) l USING (app_id)""")
def j2_apply_labels(spark, sf):
    e = fx.evaluations(spark, sf).select("app_id", "aprobado")
    return J.apply_labels(e, fx.truth_labels(spark, sf)).select("app_id", "aprobado_real", "aprobado")


@query("W4", """
SELECT app_id, arg_max(aprobado_real, (labelled_at, aprobado_real)) AS aprobado_real, max(labelled_at) AS labelled_at
FROM truth_labels GROUP BY app_id""")
def w4_latest_label(spark, sf):
    return J.latest_per_key(fx.truth_labels(spark, sf), "app_id", "labelled_at", ["aprobado_real"])


@query("J3", """
SELECT lower(trim(email)) AS email, CAST(count(*) AS BIGINT) AS n_users, min(user_id) AS first_user_id
FROM users_dim WHERE email IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def j3_duplicate_emails(spark, sf):
    return J.duplicate_emails(fx.users_dim(spark, sf))


def _arrivals(spark, sf):
    """Visit events with the visitor's name as typed (case varies by a per-row hash)."""
    v = fx.visits(spark, sf).filter(F.col("kind") == "visit")
    c = fx.read_table(spark, sf, "customer").select("c_custkey", "c_name")
    j = v.join(c, v.user_id == c.c_custkey)
    name = F.when(unit_hash(F.col("ts").cast("string"), "case") < F.lit(0.5), F.upper("c_name")) \
        .otherwise(F.concat(F.lit(" "), F.col("c_name")))
    return j.select(name.alias("name"), "ts")


_ARRIVALS_SQL = f"""
SELECT CASE WHEN {H('CAST(v.ts AS VARCHAR)', 'case')} < 0.5 THEN upper(c_name) ELSE ' ' || c_name END AS name, v.ts
FROM visits v JOIN customer c ON v.user_id = c.c_custkey WHERE v.kind = 'visit'"""


@query("P13", """
SELECT lower(trim(a.name)) AS name_key, CAST(count(*) AS BIGINT) AS n FROM arrivals a
WHERE lower(trim(a.name)) IN (SELECT lower(trim(name)) FROM users_dim) GROUP BY 1""", {"arrivals": _ARRIVALS_SQL})
def p13_case_insensitive_lookup(spark, sf):
    a = _arrivals(spark, sf)
    u = fx.users_dim(spark, sf).select(F.lower(F.trim("name")).alias("_k"))
    m = a.join(u, F.lower(F.trim(a["name"])) == u["_k"], "left_semi")
    return m.groupBy(F.lower(F.trim("name")).alias("name_key")).agg(F.count(F.lit(1)).alias("n"))


@query("J4", """
SELECT u.user_id, u.name, u.created_at, greatest(u.last_seen, n.last_ts) AS last_seen,
       CAST(coalesce(u.visits, 0) + coalesce(n.n, 0) AS BIGINT) AS visits,
       CAST(coalesce(u.evaluations, 0) AS BIGINT) AS evaluations, false AS is_new
FROM known u LEFT JOIN arrived n ON u.k = n.k
UNION ALL
SELECT CAST((SELECT max(user_id) FROM users_dim) + row_number() OVER (ORDER BY k) AS BIGINT), substr(trim(new_name), 1, 40),
       first_ts, last_ts, CAST(n AS BIGINT), CAST(0 AS BIGINT), true
FROM arrived WHERE k NOT IN (SELECT k FROM known)""",
       {"arrivals": _ARRIVALS_SQL, "known": "SELECT *, lower(trim(name)) AS k FROM users_dim",
        "arrived": """SELECT lower(trim(name)) AS k, arg_min(name, (ts, name)) AS new_name, count(*) AS n, min(ts) AS first_ts,
                             max(ts) AS last_ts FROM arrivals GROUP BY 1"""})
def j4_upsert_users(spark, sf):
    return J.upsert_users(fx.users_dim(spark, sf).drop("email", "password_hash"), _arrivals(spark, sf))
