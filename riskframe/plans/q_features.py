"""Feature-engineering queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.functions.hashing import unit_hash_sql as H
from riskframe.operators import features as FE
from riskframe.plans import sqlgen as G
from riskframe.plans.registry import query
from riskframe.sources import fixtures as fx


def _dummy_sums(df, names, col="features"):
    """(feature, n_ones) for the dummy slots of an assembled vector (distributed sum)."""
    s = df.select(Summarizer.sum(F.col(col)).alias("s")).first()["s"].toArray()
    rows = [(n, float(s[i])) for i, (n, base, lv) in enumerate(names) if lv is not None]
    return df.sparkSession.createDataFrame(rows, "feature string, n_ones double")


def _levels_sql(source: str, drop_first: bool = False) -> str:
    parts = []
    for c in S.CATEGORICAL_FEATURES:
        rank = f"row_number() OVER (ORDER BY {c})"
        keep = f"WHERE rk > 1" if drop_first else ""
        parts.append(f"SELECT feature, n_ones FROM (SELECT '{c}_' || {c} AS feature, CAST(count(*) AS DOUBLE) AS n_ones, "
                     f"{rank} AS rk FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) {keep}")
    return " UNION ALL ".join(parts)


@query("F1", _levels_sql("applications"))
def f1_one_hot(spark, sf):
    a = fx.applications(spark, sf)
    model = FE.encoder_pipeline(S.NUMERIC_FEATURES, S.CATEGORICAL_FEATURES).fit(a)
    return _dummy_sums(model.transform(a), FE.feature_names(model, S.NUMERIC_FEATURES, S.CATEGORICAL_FEATURES))


@query("F2", _levels_sql("applications", drop_first=True))
def f2_one_hot_drop_first(spark, sf):
    a = fx.applications(spark, sf)
    model = FE.encoder_pipeline(S.NUMERIC_FEATURES, S.CATEGORICAL_FEATURES).fit(a)
    names = FE.feature_names(model, S.NUMERIC_FEATURES, S.CATEGORICAL_FEATURES)
    out, kept = FE.drop_first_level(model.transform(a), names)
    return _dummy_sums(out, kept)


@query("P8", """
SELECT 'institucion_' || i.institucion AS feature, CAST(count(v.institucion) AS DOUBLE) AS n_ones
FROM (SELECT DISTINCT institucion FROM applications) i LEFT JOIN inverted v USING (institucion) GROUP BY 1
UNION ALL
SELECT 'all_zero', CAST(count(*) AS DOUBLE) FROM inverted WHERE institucion NOT IN (SELECT institucion FROM applications)
""")
def p8_unseen_to_zero(spark, sf):
    train = fx.applications(spark, sf)
    model = FE.encoder_pipeline([], ["institucion"]).fit(train)
    names = FE.feature_names(model, [], ["institucion"])
    enc = model.transform(fx.inverted(spark, sf))
    sums = _dummy_sums(enc, names)
    zero = enc.agg(F.count_if(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda acc, x: acc + x) == 0)
                   .cast("double").alias("n_ones")).select(F.lit("all_zero").alias("feature"), "n_ones")
    return sums.unionByName(zero)


def _wide(a):
    for c in S.CATEGORICAL_FEATURES:
        a = FE.one_hot_columns(a, c, S.DOMAINS[c] if c != "institucion" else S.INSTITUTIONS)
    return a


WIDE = [f"{c}_{v}" for c in S.CATEGORICAL_FEATURES for v in sorted(S.DOMAINS[c])]
WIDE_SQL = ", ".join(f"CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END AS {G.q(f'{c}_{v}')}"
                     for c in S.CATEGORICAL_FEATURES for v in sorted(S.DOMAINS[c]))
RANGE_COLS = S.NUMERIC_FEATURES + WIDE


def _ranges_sql(binary: bool) -> str:
    parts = []
    for c in RANGE_COLS:
        qc = G.q(c)
        b = f", min({qc}) IN (0, 1) AND max({qc}) IN (0, 1) AS \"binary\"" if binary else ""
        parts.append(f"SELECT '{c}' AS feature, round(min({qc}), 6) AS min, round(max({qc}), 6) AS max, "
                     f"round(avg({qc}), 6) AS mean, round(median({qc}), 6) AS median{b} FROM wide")
    return " UNION ALL ".join(parts)


_WIDE_CTE = {"wide": f"SELECT *, {WIDE_SQL} FROM applications"}


def _round_ranges(df):
    return df.withColumns({c: F.round(c, 6) for c in ["min", "max", "mean", "median"]})


@query("F3", _ranges_sql(False), _WIDE_CTE)
def f3_ranges(spark, sf):
    return _round_ranges(FE.feature_ranges(_wide(fx.applications(spark, sf)), RANGE_COLS))


@query("A12", _ranges_sql(False), _WIDE_CTE)
def a12_column_ranges(spark, sf):
    return _round_ranges(FE.feature_ranges(_wide(fx.applications(spark, sf)), RANGE_COLS))


@query("P17", _ranges_sql(True), _WIDE_CTE)
def p17_feature_form(spark, sf):
    return _round_ranges(FE.feature_form(_wide(fx.applications(spark, sf)), RANGE_COLS))


@query("F4", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, "
    f"round(sum(pow(({c} - (SELECT avg({c}) FROM applications)) / (SELECT stddev_pop({c}) FROM applications), 2)), 3) "
    f"AS sum_sq FROM applications" for c in S.NUMERIC_FEATURES))
def f4_population_scaler(spark, sf):
    a = fx.applications(spark, sf)
    sc = FE.fit_scaler(a, S.NUMERIC_FEATURES)
    z = sc.transform(a.select(*S.NUMERIC_FEATURES))
    sums = z.agg(*[F.sum(F.col(c) * F.col(c)).alias(c) for c in S.NUMERIC_FEATURES]).first()
    rows = [(c, round(m, 6), round(s, 6), round(float(sums[c]), 3)) for c, m, s in zip(sc.columns, sc.mean, sc.std)]
    return spark.createDataFrame(rows, "feature string, mean double, std double, sum_sq double")


@query("F5", f"""
SELECT CASE WHEN {H('app_id', 42)} < 0.2 THEN 'test' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(aprobado) AS BIGINT) AS n_pos FROM applications GROUP BY 1""")
def f5_hash_split(spark, sf):
    s = FE.hash_split(fx.applications(spark, sf), "app_id", 0.2, 42)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("aprobado").cast("bigint").alias("n_pos"))


@query("W5", f"""
SELECT aprobado, split, CAST(count(*) AS BIGINT) AS n, CAST(sum(app_id) AS BIGINT) AS id_sum FROM (
  SELECT aprobado, app_id, CASE WHEN row_number() OVER (PARTITION BY aprobado ORDER BY {H('app_id', 42)}, app_id)
         <= round(0.2 * count(*) OVER (PARTITION BY aprobado)) THEN 'test' ELSE 'train' END AS split
  FROM applications) GROUP BY 1, 2""")
def w5_stratified_split(spark, sf):
    s = FE.stratified_split(fx.applications(spark, sf).select("app_id", "aprobado"), "app_id", "aprobado", 0.2, 42)
    return s.groupBy("aprobado", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("app_id").cast("bigint").alias("id_sum"))


_P9_SQL = "SELECT id, " + ", ".join(
    [f"coalesce({G.parse(f'CAST({c} AS VARCHAR)')}, {S.APPLICANT_DEFAULTS[c]}) AS {c}" for c in S.NUMERIC_FEATURES] +
    [f"coalesce({G.missing(c)}, '{S.APPLICANT_DEFAULTS[c]}') AS {c}" for c in S.CATEGORICAL_FEATURES]) + \
    " FROM dirty_canon"


@query("P9", _P9_SQL, {"dirty_canon": G.dirty_canon_select()})
def p9_defaults(spark, sf):
    from riskframe.operators.cleaning import remap_columns, strip_headers
    d, _ = remap_columns(strip_headers(fx.dirty(spark, sf)))
    return FE.apply_defaults(d.select("id", *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES))


@query("P10", "SELECT id, " + ", ".join(
    f"round(coalesce({G.parse(f'CAST({c} AS VARCHAR)')}, (SELECT median({c}) FROM applications)), 6) AS {c}"
    for c in S.NUMERIC_FEATURES) + " FROM dirty_canon", {"dirty_canon": G.dirty_canon_select()})
def p10_median_request(spark, sf):
    from riskframe.operators.cleaning import remap_columns, strip_headers
    from riskframe.operators.stats import exact_medians
    med = exact_medians(fx.applications(spark, sf), S.NUMERIC_FEATURES)
    d, _ = remap_columns(strip_headers(fx.dirty(spark, sf)))
    out = FE.fill_with_medians(d.select("id", *S.NUMERIC_FEATURES), med)
    return out.withColumns({c: F.round(c, 6) for c in S.NUMERIC_FEATURES})
