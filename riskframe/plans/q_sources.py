"""Source and sink queries.

Files are derived from the driver tables (written with Spark into the shared
checkpoint folder) and read back through the readers under test.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.functions.hashing import unit_hash, unit_hash_sql as H
from riskframe.operators import joins as J
from riskframe.operators import monitoring as MO
from riskframe.plans.q_monitoring import _EXPORT_SQL
from riskframe.plans.registry import query
from riskframe.session import scratch_path
from riskframe.sources import fixtures as fx
from riskframe.sources import readers as RD
from riskframe.sources import sinks as SK

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
                 "embeddings", "pages", "benchmark", "labels", "conversations"]
_CSV_KEEP_BLANKS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_S4_SQL = "SELECT * RENAME (\" Edad \" AS \"Edad\") FROM dirty"


def _write_csv(df, path, sep, encoding):
    df.write.mode("overwrite").options(header=True, sep=sep, encoding=encoding, **_CSV_KEEP_BLANKS).csv(path)


def _read_back(spark, path):
    sep, enc = RD.sniff_csv(spark, path)
    return RD.read_csv(spark, path, sep, enc, keep_blanks=True), sep, enc


def _csv_sql() -> str:
    from riskframe.sources.fixtures import DIRTY_HEADERS
    cols = ["id"] + [DIRTY_HEADERS[c] for c in S.REQUIRED_COLUMNS] + ["notas", "pais"]
    return "SELECT " + ", ".join(f'nullif("{c}", \'\') AS "{c.strip()}"' for c in cols) + " FROM dirty"


@query("S1", _csv_sql())
def s1_csv_sniff_latin1(spark, sf):
    path = scratch_path(spark, "upload-latin1.csv")
    _write_csv(fx.dirty(spark, sf), path, ";", "ISO-8859-1")
    df, sep, enc = _read_back(spark, path)
    assert (sep, enc) == (";", "ISO-8859-1"), (sep, enc)
    return df


@query("S2", _csv_sql())
def s2_csv_sniff_pipe(spark, sf):
    path = scratch_path(spark, "upload-pipe.csv")
    _write_csv(fx.dirty(spark, sf), path, "|", "UTF-8")
    df, sep, enc = _read_back(spark, path)
    assert (sep, enc) == ("|", "UTF-8"), (sep, enc)
    return df


@query("S3", _S4_SQL)
def s3_workbook_ingest(spark, sf):
    path = scratch_path(spark, "workbooks")
    d = fx.dirty(spark, sf)
    RD.write_workbooks(d.repartition(4), path)
    cols = [c.strip() for c in d.columns]
    return RD.read_workbooks(spark, path, cols)


@query("S5", "SELECT CAST(count(*) AS BIGINT) AS n_rows, 18 AS n_columns, count(*) = 0 AS empty FROM applications")
def s5_empty_guard(spark, sf):
    return RD.input_guard(fx.applications(spark, sf))


@query("S9", _EXPORT_SQL)
def s9_csv_sink(spark, sf):
    rows = MO.export_training(fx.evaluations(spark, sf), fx.truth_labels(spark, sf))
    path = SK.export_csv(rows, scratch_path(spark, "export"), "dataset", dt.datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("/dataset_20240102_030405.csv")
    back = RD.read_csv(spark, path)
    types = {**{c: "double" for c in S.NUMERIC_FEATURES}, "aprobado": "int"}
    return back.select(*[F.col(c).cast(types.get(c, "string")).alias(c) for c in back.columns])


@query("S10", "SELECT * REPLACE (round(probability, 9) AS probability) FROM evaluations")
def s10_append_facts(spark, sf):
    path = scratch_path(spark, "evaluations")
    ev = fx.evaluations(spark, sf).withColumn("probability", F.round("probability", 9))
    h = unit_hash("app_id", "part")
    SK.append_facts(ev.filter(h < 0.5), path)
    SK.append_facts(ev.filter(h >= 0.5), path)
    return spark.read.parquet(path)


_TYPES = [("VARCHAR", "string"), ("BIGINT", "bigint"), ("INTEGER", "int"), ("DOUBLE", "double"), ("FLOAT[]", "array<float>"),
          ("DOUBLE[]", "array<double>"), ("TIMESTAMP", "timestamp_ntz"), ("DATE", "date"), ("FLOAT", "float"), ("BOOLEAN", "boolean")]
_TYPE_SQL = "CASE data_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES) + " ELSE data_type END"


@query("S12", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, (SELECT CAST(count(*) AS INTEGER) FROM information_schema.columns "
    f"WHERE table_name = '{t}') AS n_columns, (SELECT string_agg(column_name || ' ' || {_TYPE_SQL}, ', ' ORDER BY ordinal_position) "
    f"FROM information_schema.columns WHERE table_name = '{t}') AS columns, (SELECT CAST(count(*) AS BIGINT) FROM {t}) AS n_rows"
    for t in DRIVER_TABLES))
def s12_catalog(spark, sf):
    return SK.describe_tables(spark, sf, DRIVER_TABLES)


@query("S13", """
SELECT c_custkey AS user_id, c_name AS name FROM customer
WHERE lower(trim(c_name)) NOT IN (SELECT lower(trim(name)) FROM users_dim)""")
def s13_json_migration(spark, sf):
    path = scratch_path(spark, "users.json")
    c = fx.read_table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    c.write.mode("overwrite").json(path)
    listed = RD.read_json_records(spark, path)
    return J.new_users(fx.users_dim(spark, sf), listed).select(F.col("user_id").cast("bigint"), "name")


@query("S14", """
SELECT * REPLACE (round(probability, 9) AS probability) FROM evaluations ORDER BY app_id LIMIT 8""")
def s14_preview(spark, sf):
    ev = fx.evaluations(spark, sf).withColumn("probability", F.round("probability", 9))
    return RD.preview(ev, "app_id", 8)


@query("S15", f"""
SELECT per_model IS NOT NULL AS has_per_model, canal IS NULL AS canal_missing, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN {H('app_id', 'evo')} >= 0.5 THEN 'x' END AS per_model, CAST(NULL AS VARCHAR) AS canal
  FROM evaluations) GROUP BY 1, 2""")
def s15_schema_evolution(spark, sf):
    path = scratch_path(spark, "evolving")
    ev = fx.evaluations(spark, sf).select("app_id", "probability")
    h = unit_hash("app_id", "evo")
    ev.filter(h < 0.5).write.mode("append").parquet(path)
    ev.filter(h >= 0.5).withColumn("per_model", F.to_json(F.create_map(F.lit("rule"), F.col("probability")))) \
        .write.mode("append").parquet(path)
    merged = spark.read.option("mergeSchema", True).parquet(path)
    merged = RD.add_missing_columns(merged, {"per_model": "string", "canal": "string"})
    return merged.groupBy(F.col("per_model").isNotNull().alias("has_per_model"),
                          F.col("canal").isNull().alias("canal_missing")).agg(F.count(F.lit(1)).alias("n"))


@query("S16", f"""
SELECT CASE WHEN {H('app_id', 'fmt')} < 1.0/3.0 THEN 'csv' WHEN {H('app_id', 'fmt')} < 2.0/3.0 THEN 'parquet'
            ELSE 'json' END AS format, CAST(count(*) AS BIGINT) AS n, CAST(sum(app_id) AS BIGINT) AS id_sum
FROM applications GROUP BY 1""")
def s16_reader_dispatch(spark, sf):
    a = fx.applications(spark, sf).select("app_id", "user_name")
    h = unit_hash("app_id", "fmt")
    parts = {"csv": a.filter(h < 1.0 / 3.0), "parquet": a.filter((h >= 1.0 / 3.0) & (h < 2.0 / 3.0)),
             "json": a.filter(h >= 2.0 / 3.0)}
    frames = []
    for fmt, df in parts.items():
        p = scratch_path(spark, "dispatch") + f".{fmt}"
        getattr(df.write.mode("overwrite").option("header", True) if fmt == "csv" else df.write.mode("overwrite"),
                fmt)(p)
        back = RD.read_any(spark, p)
        frames.append(back.select(F.lit(fmt).alias("format"), F.col("app_id").cast("bigint").alias("app_id")))
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f)
    return u.groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.sum("app_id").alias("id_sum"))
