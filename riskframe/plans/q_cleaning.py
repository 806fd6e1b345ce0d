"""Cleaning and profiling queries over the dirty upload fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.functions.targets import normalize_binary_columns, normalize_target, relabel_two_classes
from riskframe.functions.text import fill_missing_category, missing_to_null, normalize_text, parse_double
from riskframe.operators import cleaning as C
from riskframe.operators.stats import exact_medians, modes_frame
from riskframe.plans import sqlgen as G
from riskframe.plans.registry import query
from riskframe.session import cut_lineage
from riskframe.sources import fixtures as fx

CANON = {"dirty_canon": G.dirty_canon_select()}
CANON_COLS = ["id"] + S.REQUIRED_COLUMNS + ["notas", "pais"]


def _canon(spark, sf):
    df, _ = C.remap_columns(C.strip_headers(fx.dirty(spark, sf)))
    return df


def _round_nums(df, cols=S.NUMERIC_FEATURES, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols if c in df.columns})


@query("S4", "SELECT * RENAME (\" Edad \" AS \"Edad\") FROM dirty")
def s4_strip_headers(spark, sf):
    return C.strip_headers(fx.dirty(spark, sf))


@query("P2", "SELECT * FROM dirty_canon", CANON)
def p2_remap_columns(spark, sf):
    return _canon(spark, sf)


@query("P3", "SELECT * FROM dirty_canon", CANON)
def p3_reorder(spark, sf):
    return C.reorder_required_first(_canon(spark, sf))


@query("P1", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", true AS present, CAST(count({c}) AS BIGINT) AS n_non_null FROM dirty_canon"
    for c in S.REQUIRED_COLUMNS), CANON)
def p1_required_columns(spark, sf):
    return C.required_report(_canon(spark, sf))


@query("P4", "SELECT CAST(count(*) AS BIGINT) AS n_before, CAST(count(*) FILTER (WHERE NOT ("
       + " AND ".join(f"{c} IS NULL" for c in CANON_COLS) + ")) AS BIGINT) AS n_after FROM dirty_canon", CANON)
def p4_drop_empty_rows(spark, sf):
    df = _canon(spark, sf)
    before = df.agg(F.count(F.lit(1)).alias("n_before"))
    after = C.drop_all_null_rows(df).agg(F.count(F.lit(1)).alias("n_after"))
    return before.select("n_before", after.scalar().alias("n_after"))


@query("P5", " UNION ALL ".join(
    f"SELECT '{c}' AS dropped_column FROM dirty_canon HAVING count({c}) = 0" for c in CANON_COLS), CANON)
def p5_drop_empty_columns(spark, sf):
    df = _canon(spark, sf)
    _, dropped = C.drop_all_null_columns(df)
    return spark.createDataFrame([(c,) for c in dropped], "dropped_column string")


@query("P7", " UNION ALL ".join(
    f"SELECT '{c}' AS dropped_column FROM dirty_canon "
    f"HAVING count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) <= 1" for c in CANON_COLS), CANON)
def p7_drop_constant_columns(spark, sf):
    _, dropped = C.drop_constant_columns(_canon(spark, sf))
    return spark.createDataFrame([(c,) for c in dropped], "dropped_column string")


@query("P6", f"""
SELECT CAST(count(*) AS BIGINT) AS n_before,
       CAST(count(*) FILTER (WHERE {G.missing('aprobado')} IS NULL) AS BIGINT) AS n_removed,
       CAST(count(*) FILTER (WHERE {G.missing('aprobado')} IS NOT NULL) AS BIGINT) AS n_after
FROM dirty_canon""", CANON)
def p6_drop_null_target(spark, sf):
    df = _canon(spark, sf).withColumn("aprobado", missing_to_null("aprobado"))
    before = df.agg(F.count(F.lit(1)).alias("n_before"))
    out = C.drop_null_target(df, "aprobado")[0]
    after = out.agg(F.count(F.lit(1))).scalar()
    return before.select("n_before", (F.col("n_before") - after).alias("n_removed"), after.alias("n_after"))


@query("A11", """
SELECT CAST((SELECT count(*) FROM dirty_canon) AS BIGINT) AS n_before,
       CAST((SELECT count(*) FROM dirty_canon) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_canon)) AS BIGINT) AS n_duplicates,
       CAST((SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_canon)) AS BIGINT) AS n_after
""", CANON)
def a11_duplicates(spark, sf):
    df = _canon(spark, sf)
    before = df.agg(F.count(F.lit(1)).alias("n_before"))
    after = df.dropDuplicates().agg(F.count(F.lit(1))).scalar()
    return before.select("n_before", (F.col("n_before") - after).alias("n_duplicates"), after.alias("n_after"))


# ---- the cleaner chain, as SQL -------------------------------------------------
def _cleaner_sql() -> dict[str, str]:
    text_cols = CANON_COLS
    t1 = ", ".join(
        (f"{G.parse(G.missing(c))} AS {c}" if c in S.NUMERIC_FEATURES else f"{G.missing(c)} AS {c}")
        for c in text_cols if c != "notas")
    med = ", ".join(f"median({c}) AS {c}" for c in S.NUMERIC_FEATURES)
    t2 = ", ".join(
        (f"coalesce(t1.{c}, m.{c}) AS {c}" if c in S.NUMERIC_FEATURES else
         (f"{G.target('t1.aprobado', 'cleaner')} AS aprobado" if c == "aprobado" else f"t1.{c} AS {c}"))
        for c in text_cols if c != "notas")
    modes = " UNION ALL ".join(
        f"SELECT '{c}' AS col, (SELECT {c} FROM t2 WHERE {c} IS NOT NULL GROUP BY {c} "
        f"ORDER BY count(*) DESC, {c} LIMIT 1) AS v" for c in S.CATEGORICAL_FEATURES)
    final = ", ".join(
        (f"coalesce({c}, (SELECT v FROM modes WHERE col = '{c}'), 'Desconocido') AS {c}"
         if c in S.CATEGORICAL_FEATURES else c) for c in text_cols if c != "notas")
    return {
        "dirty_canon": G.dirty_canon_select(),
        "dedup": "SELECT DISTINCT * EXCLUDE (notas) FROM dirty_canon",
        "t1": f"SELECT {t1} FROM dedup",
        "med": f"SELECT {med} FROM t1",
        "t2": f"SELECT * FROM (SELECT {t2} FROM t1, med m) WHERE aprobado IS NOT NULL",
        "modes": modes,
        "cleaned": f"SELECT {final} FROM t2",
    }


CLEANER = _cleaner_sql()
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in S.NUMERIC_FEATURES)


@query("F9", f"SELECT * REPLACE ({ROUNDED}) FROM cleaned", CLEANER)
def f9_clean_dataset(spark, sf):
    cleaned, _ = C.clean_dataset(fx.dirty(spark, sf))
    return _round_nums(cleaned)


@query("A9", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(median({c}), 6) AS median FROM t1"
                                for c in S.NUMERIC_FEATURES), CLEANER)
def a9_medians(spark, sf):
    df = _canon(spark, sf).dropDuplicates()
    df = df.withColumns({c: parse_double(missing_to_null(c)) for c in S.NUMERIC_FEATURES})
    med = exact_medians(df, S.NUMERIC_FEATURES)
    # one row per column; values come from the distributed median jobs above
    return spark.createDataFrame([(c, round(float(v), 6)) for c, v in med.items()], "column string, median double")


@query("A10", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS \"column\", {c} AS mode, CAST(count(*) AS BIGINT) AS n FROM t2 "
    f"WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c in S.CATEGORICAL_FEATURES),
    CLEANER)
def a10_modes(spark, sf):
    df = _canon(spark, sf).dropDuplicates()
    df = df.withColumns({c: missing_to_null(c) for c in S.CATEGORICAL_FEATURES + ["aprobado"]})
    df = df.withColumn("aprobado", normalize_target("aprobado", "cleaner")).filter(F.col("aprobado").isNotNull())
    return modes_frame(df, S.CATEGORICAL_FEATURES)


@query("F6", " UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", 'median' AS method, round((SELECT {c} FROM med), 6) AS num_value, "
     f"CAST(NULL AS VARCHAR) AS text_value, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_filled FROM t1"
     for c in S.NUMERIC_FEATURES] +
    [f"SELECT '{c}', 'mode', CAST(NULL AS DOUBLE), (SELECT v FROM modes WHERE col = '{c}'), "
     f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) FROM t2" for c in S.CATEGORICAL_FEATURES]), CLEANER)
def f6_imputation_report(spark, sf):
    df = cut_lineage(_canon(spark, sf).dropDuplicates(), "distinct")  # read by every count below
    df = df.withColumns({c: missing_to_null(c) for c in df.columns})
    df = df.withColumns({c: parse_double(c) for c in S.NUMERIC_FEATURES})
    med = exact_medians(df, S.NUMERIC_FEATURES)
    num_nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in S.NUMERIC_FEATURES]).first()
    df2 = df.withColumn("aprobado", normalize_target("aprobado", "cleaner")).filter(F.col("aprobado").isNotNull())
    m = modes_frame(df2, S.CATEGORICAL_FEATURES).collect()
    cat_nulls = df2.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in S.CATEGORICAL_FEATURES]).first()
    mode_of = {r["column"]: r["mode"] for r in m}
    rows = [(c, "median", round(float(med[c]), 6), None, int(num_nulls[c])) for c in S.NUMERIC_FEATURES]
    rows += [(c, "mode", None, mode_of.get(c), int(cat_nulls[c])) for c in S.CATEGORICAL_FEATURES]
    return spark.createDataFrame(rows, "column string, method string, num_value double, text_value string, n_filled bigint")


def _production_sql() -> dict[str, str]:
    t = ", ".join([f"{c}" for c in S.NUMERIC_FEATURES + S.CATEGORICAL_FEATURES] +
                  [f"{G.target('aprobado', 'production')} AS aprobado"])
    p = ", ".join([f"{G.parse(f'CAST({c} AS VARCHAR)')} AS {c}" for c in S.NUMERIC_FEATURES] +
                  S.CATEGORICAL_FEATURES + ["aprobado"])
    med = ", ".join(f"median({c}) AS {c}" for c in S.NUMERIC_FEATURES)
    final = ", ".join([f"round(coalesce(p.{c}, m.{c}), 6) AS {c}" for c in S.NUMERIC_FEATURES] +
                      [f"coalesce({G.missing(c)}, 'NA') AS {c}" for c in S.CATEGORICAL_FEATURES] + ["aprobado"])
    return {
        "dirty_canon": G.dirty_canon_select(),
        "pt": f"SELECT * FROM (SELECT {t} FROM dirty_canon) WHERE aprobado IS NOT NULL",
        "pp": f"SELECT {p} FROM pt",
        "pm": f"SELECT {med} FROM pp",
        "prod": f"SELECT {final} FROM pp p, pm m",
    }


@query("F8", "SELECT * FROM prod", _production_sql())
def f8_prepare_production(spark, sf):
    return _round_nums(C.prepare_production(_canon(spark, sf)))


@query("P14", f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT aprobado) AS BIGINT) AS n_classes,
       count(*) >= 50 AND count(DISTINCT aprobado) = 2 AS ok FROM cleaned""", CLEANER)
def p14_training_gate(spark, sf):
    cleaned, _ = C.clean_dataset(fx.dirty(spark, sf))
    return C.training_gate(cleaned)


_P15_ORDER = S.REQUIRED_COLUMNS + ["id", "pais"]


@query("P15", "SELECT \"column\" FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS \"column\" FROM cleaned HAVING count(DISTINCT {c}) = 2"
    for i, c in enumerate(_P15_ORDER)) + ") ORDER BY pos LIMIT 1", CLEANER)
def p15_suggest_target(spark, sf):
    cleaned, _ = C.clean_dataset(fx.dirty(spark, sf))
    return spark.createDataFrame([(C.suggest_target(cleaned),)], "column string")


_APP_COLS = ["app_id", "user_id", "edad", "ingresos_mensuales", "cargas_familiares", "creditos_activos", "u", "z",
             "p_latent", "aprobado"]
_APP_TEXT = ["user_name", "sexo", "educacion", "historial_pagos", "institucion", "tipo_credito",
             "situacion_laboral"]


@query("P16", " UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", CASE WHEN bool_and({c} IN (0, 1)) AND count({c}) > 0 THEN 'categorical' "
     f"ELSE 'numeric' END AS kind, coalesce(bool_and({c} IN (0, 1)), false) AND count({c}) > 0 AS \"binary\" "
     f"FROM applications" for c in _APP_COLS] +
    [f"SELECT '{c}', 'categorical', false" for c in _APP_TEXT + ["created_at"]]))
def p16_column_types(spark, sf):
    a = fx.applications(spark, sf).select(*_APP_COLS, *_APP_TEXT, "created_at")
    return C.classify_columns(a)


@query("X1", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", coalesce(bool_and({c} IN (0, 1)), true) AS within_01 FROM applications"
    for c in _APP_COLS))
def x1_domain_subset(spark, sf):
    a = fx.applications(spark, sf)
    row = a.agg(*[F.bool_and(F.col(c).isNull() | F.col(c).isin(0, 1)).alias(c) for c in _APP_COLS])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(True))
                                                   .alias("within_01")) for c in _APP_COLS])).alias("r")).select("r.*")


# ---- scalar text expressions over the dirty upload ----------------------------
@query("E1", f"""
SELECT {G.norm('situacion_laboral')} AS value, CAST(count(*) AS BIGINT) AS n FROM dirty_canon GROUP BY 1""", CANON)
def e1_normalize_text(spark, sf):
    return _canon(spark, sf).groupBy(normalize_text("situacion_laboral").alias("value")) \
        .agg(F.count(F.lit(1)).alias("n"))


def _target_query(dictionary: str):
    def fn(spark, sf):
        d = _canon(spark, sf)
        return d.groupBy(F.col("aprobado").alias("token"), normalize_target("aprobado", dictionary).alias("y")) \
            .agg(F.count(F.lit(1)).alias("n"))
    sql = (f"SELECT aprobado AS token, {G.target('aprobado', dictionary)} AS y, CAST(count(*) AS BIGINT) AS n "
           f"FROM dirty_canon GROUP BY 1, 2")
    return sql, fn


for _qid, _dict in [("E3", "production"), ("E4", "cleaner"), ("E5", "report")]:
    _sql, _fn = _target_query(_dict)
    query(_qid, _sql, CANON)(_fn)


@query("E7", f"""
SELECT CAST(count(*) FILTER (WHERE {G.parse('ingresos_mensuales')} IS NOT NULL) AS BIGINT) AS n_parsed,
       CAST(count(*) FILTER (WHERE {G.parse('ingresos_mensuales')} IS NULL) AS BIGINT) AS n_null,
       round(sum({G.parse('ingresos_mensuales')}), 4) AS total FROM dirty_canon""", CANON)
def e7_numeric_coercion(spark, sf):
    v = parse_double("ingresos_mensuales")
    return _canon(spark, sf).agg(F.count_if(v.isNotNull()).alias("n_parsed"), F.count_if(v.isNull()).alias("n_null"),
                                 F.round(F.sum(v), 4).alias("total"))


@query("E8", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {G.missing(c)} IS NULL) AS BIGINT) AS n_missing "
    f"FROM dirty_canon" for c in S.CATEGORICAL_FEATURES + ["aprobado"]), CANON)
def e8_missing_tokens(spark, sf):
    d = _canon(spark, sf)
    cols = S.CATEGORICAL_FEATURES + ["aprobado"]
    row = d.agg(*[F.count_if(missing_to_null(c).isNull()).alias(c) for c in cols])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing"))
                                          for c in cols])).alias("r")).select("r.*")


@query("E9", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", coalesce({G.missing(c)}, 'NA') AS value, CAST(count(*) AS BIGINT) AS n "
    f"FROM dirty_canon GROUP BY 2" for c in S.CATEGORICAL_FEATURES), CANON)
def e9_na_category(spark, sf):
    d = _canon(spark, sf)
    st = d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), fill_missing_category(c).alias("value"))
                                      for c in S.CATEGORICAL_FEATURES])).alias("r")).select("r.*")
    return st.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


_FLAGS = {"hipoteca": ("tipo_credito = 'Hipotecario'", ["Sí", "si", "YES", "true"], ["No", "n", "false", "0"]),
          "femenino": ("sexo = 'Femenino'", ["1", "Verdadero", "y", "sí"], ["0", "Falso", "no", "N"])}


@query("E2", f"""
SELECT 'hipoteca' AS "column", true AS converted, CAST(sum(CASE WHEN tipo_credito = 'Hipotecario' THEN 1 ELSE 0 END) AS DOUBLE) AS n_true FROM applications
UNION ALL SELECT 'femenino', true, CAST(sum(CASE WHEN sexo = 'Femenino' THEN 1 ELSE 0 END) AS DOUBLE) FROM applications
UNION ALL SELECT 'educacion', false, CAST(NULL AS DOUBLE)""")
def e2_binary_text(spark, sf):
    a = fx.applications(spark, sf)
    cols = {}
    for name, (cond, yes, no) in _FLAGS.items():
        pick = lambda vals: F.element_at(F.array(*[F.lit(v) for v in vals]),
                                         (F.floor(F.col("u") * 4) + 1).cast("int"))
        cols[name] = F.when(F.expr(cond), pick(yes)).otherwise(pick(no))
    d = a.select(*[v.alias(k) for k, v in cols.items()], "educacion")
    out, converted = normalize_binary_columns(d, list(cols) + ["educacion"])
    sums = out.agg(*[F.sum(c).cast("double").alias(c) for c in converted]).first()
    rows = [(c, c in converted, float(sums[c]) if c in converted else None) for c in list(cols) + ["educacion"]]
    return spark.createDataFrame(rows, "column string, converted boolean, n_true double")


@query("E6", """
SELECT CASE sexo WHEN 'Femenino' THEN 0 ELSE 1 END AS y, sexo AS original, CAST(count(*) AS BIGINT) AS n
FROM applications GROUP BY sexo""")
def e6_two_class_relabel(spark, sf):
    a = fx.applications(spark, sf).select(F.col("sexo").alias("original"), F.col("sexo").alias("y"))
    out, _ = relabel_two_classes(a, "y")
    return out.groupBy("y", "original").agg(F.count(F.lit(1)).alias("n"))
