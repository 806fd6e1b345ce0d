"""Fixture views derived from the driver tables (see FIXTURES.md).

Every view is a lazy DataFrame over the parquet tables, so its size grows with
the scale factor and Catalyst prunes the columns a query does not use.
Row selection for labels, users and corruption patterns uses the per-row hash
``unit_hash`` (never a row cap), so each view covers the whole input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.functions.hashing import unit_hash
from riskframe.functions.scoring import binary_prediction, decision_band, percent, risk_band, scorecard_z
from riskframe.session import table_path


# Unique key of each driver table: used to spread a scan that yields fewer
# partitions than the cluster's parallelism (a unique key cannot be skewed).
# Only fact tables are spread; dimension tables are joined (and broadcast when
# AQE measures them small), so re-partitioning them would be wasted work.
TABLE_KEYS = {"orders": "o_orderkey", "events": "event_id"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan a driver table.

    When the scan has fewer partitions than the default parallelism (a small
    file with one row group is one task), it is hash-partitioned on the
    table's unique key so the per-row work that follows uses every core.  At
    cluster scale the scan already has thousands of splits and this is a
    no-op (no extra shuffle).
    """
    df = spark.read.parquet(table_path(sf_dir, name))
    want = spark.sparkContext.defaultParallelism
    key = TABLE_KEYS.get(name)
    if key and df.rdd.getNumPartitions() < want:
        df = df.repartition(want, key)
    return df


def _case_mod(col: Column, values: list[str]) -> Column:
    out = None
    for i, v in enumerate(values[:-1]):
        out = F.when(col == i, F.lit(v)) if out is None else out.when(col == i, F.lit(v))
    return out.otherwise(F.lit(values[-1]))


def application_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One application per order, joined with its customer (no label yet)."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    j = orders.join(customer, orders.o_custkey == customer.c_custkey, "inner")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    prio = F.substring("o_orderpriority", 1, 1)
    return j.select(
        ok.alias("app_id"),
        F.col("o_orderdate").alias("created_at"),
        ck.alias("user_id"),
        F.col("c_name").alias("user_name"),
        (F.lit(20) + ck % 50).cast("double").alias("edad"),
        (F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 4.0).cast("double").alias("ingresos_mensuales"),
        (ck % 6).cast("double").alias("cargas_familiares"),
        (ok % 6).cast("double").alias("creditos_activos"),
        F.when(ck % 2 == 0, "Masculino").otherwise("Femenino").alias("sexo"),
        _case_mod(ck % 4, ["Primaria", "Secundaria", "Universitaria", "Posgrado"]).alias("educacion"),
        F.when(prio == "1", "Malo").when(prio == "2", "Regular").when(prio == "5", "Excelente")
        .otherwise("Bueno").alias("historial_pagos"),
        _case_mod(F.col("c_nationkey") % 5, S.INSTITUTIONS).alias("institucion"),
        _case_mod((ok + ck) % 6, ["Hipotecario", "Vehicular", "Personal", "Microcrédito", "Productivo",
                                  "Emprendimiento"]).alias("tipo_credito"),
        _case_mod((ck * 7 + ok * 5) % 6, S.EMPLOYMENT).alias("situacion_laboral"),
        unit_hash(ok, 42).alias("u"),
    )


def applications(spark: SparkSession, sf_dir: str, income_weight: float = S.SCORECARD_INCOME_WEIGHT) -> DataFrame:
    """FIXTURES §2: features + latent score ``z``, ``p_latent`` and sampled label ``aprobado``."""
    a = application_features(spark, sf_dir).withColumn("z", scorecard_z(income_weight))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("z")))
    return (a.withColumn("p_latent", p)
             .withColumn(S.TARGET, F.when(F.col("u") < F.col("p_latent"), 1).otherwise(0).cast("int")))


EVALUATION_COLUMNS = (["app_id", "created_at", "user_id", "user_name"] + S.NUMERIC_FEATURES + S.CATEGORICAL_FEATURES
                      + ["probability", "percent", "risk", "decision", "aprobado"])


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored applications as the fact table holds them (probability = latent rule)."""
    a = applications(spark, sf_dir)
    return a.select(
        *[c for c in EVALUATION_COLUMNS[:14]],
        F.col("p_latent").alias("probability"),
        percent("p_latent").alias("percent"),
        risk_band("p_latent").alias("risk"),
        decision_band("p_latent").alias("decision"),
        binary_prediction("p_latent").alias("aprobado"),
    )


def truth_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late ground truth for about a third of the evaluations.

    ``aprobado_real`` is the sampled label, written 30 days after the
    application; about one in thirty also got an earlier, wrong label 10 days
    after it, so "last write wins" matters.
    """
    a = applications(spark, sf_dir).select("app_id", "created_at", S.TARGET, unit_hash("app_id", "lbl").alias("_h"))
    h = F.col("_h")
    final = F.struct(F.col(S.TARGET).alias("aprobado_real"),
                     (F.col("created_at") + F.expr("INTERVAL 30 DAYS")).alias("labelled_at"))
    early = F.when(h < F.lit(1.0 / 30.0), F.struct((F.lit(1) - F.col(S.TARGET)).cast("int").alias("aprobado_real"),
                                                   (F.col("created_at") + F.expr("INTERVAL 10 DAYS")).alias("labelled_at")))
    # one scan: every labelled application emits one or two label rows
    return a.filter(h < F.lit(1.0 / 3.0)) \
        .select("app_id", F.explode(F.filter(F.array(final, early), lambda x: x.isNotNull())).alias("l")) \
        .select("app_id", "l.aprobado_real", "l.labelled_at")


def users_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User dimension from ``customer`` with first/last order; ~10 % of users left out (J1 misses)."""
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    per_user = orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("last_seen"),
        F.count(F.lit(1)).alias("evaluations"))
    kept = cust.filter(unit_hash("c_custkey", "usr") < F.lit(0.9))
    j = kept.join(per_user, kept.c_custkey == per_user.o_custkey, "left")
    return j.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("cliente"), F.substring(F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit("|mail"))), 1, 3),
                 F.lit("@correo.test")).alias("email"),
        F.when(unit_hash("c_custkey", "pwd") < F.lit(0.5),
               F.sha2(F.concat(F.col("c_name"), F.lit("|pwd")), 256)).alias("password_hash"),
        "created_at", "last_seen",
        (F.coalesce(F.col("evaluations"), F.lit(0)) % 7 + 1).cast("bigint").alias("visits"),
        F.coalesce(F.col("evaluations"), F.lit(0)).cast("bigint").alias("evaluations"),
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity log from ``events``: view/click = visit, purchase = evaluation."""
    ev = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    return (ev.filter(F.col("event_type").isin("view", "click", "purchase"))
              .select("user_id", "ts", F.when(F.col("event_type") == "purchase", "evaluation")
                      .otherwise("visit").alias("kind")))


# ---- dirty fixture -------------------------------------------------------------
# Headers of the dirty upload, in the order of the canonical columns they alias.
DIRTY_HEADERS = {
    "edad": " Edad ", "ingresos_mensuales": "Salario", "cargas_familiares": "cargas",
    "creditos_activos": "creditos", "sexo": "Género", "educacion": "educacion",
    "historial_pagos": "Buro", "institucion": "institucion", "tipo_credito": "tipo_credito",
    "situacion_laboral": "situacion_laboral", "aprobado": "Decisión",
}
POSITIVE_SPELLINGS = ["Sí", "si", "1", "0.7", "Aprobado"]
NEGATIVE_SPELLINGS = ["no", "Rechazado", "0"]
JUNK_SPELLINGS = ["nan", "", "maybe"]


def _pick(h: Column, values: list[str]) -> Column:
    idx = F.floor(h * len(values)).cast("int")
    return _case_mod(idx, values)


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column STRING with messy headers, tokens, blanks and duplicate rows.

    Each per-row hash is computed once in its own projection and then
    referenced by name (Catalyst does not inline an expensive expression that
    is used twice), so a row costs one md5 per hash, not one per reference.
    """
    a = applications(spark, sf_dir)
    hashes = {f"_h_{c}": unit_hash("app_id", f"n_{c}") for c in S.NUMERIC_FEATURES}
    hashes.update({f"_h_{c}": unit_hash("app_id", f"c_{c}") for c in S.CATEGORICAL_FEATURES})
    hashes.update({"_h_tgt": unit_hash("app_id", "tgt"), "_h_spell": unit_hash("app_id", "spell"),
                   "_dup": unit_hash("app_id", "dup")})
    h = a.select("app_id", *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES, S.TARGET,
                 *[v.alias(k) for k, v in hashes.items()])
    cols = [F.col("app_id").cast("string").alias("id")]
    for c in S.NUMERIC_FEATURES:
        hc = F.col(f"_h_{c}")
        v = F.when(hc < F.lit(1.0 / 17.0), F.lit("")).when(hc < F.lit(1.0 / 17.0 + 1.0 / 23.0), F.lit("abc")) \
            .otherwise(F.col(c).cast("string"))
        cols.append(v.alias(DIRTY_HEADERS[c]))
    for c in S.CATEGORICAL_FEATURES:
        hc = F.col(f"_h_{c}")
        v = F.when(hc < F.lit(0.5 / 19.0), F.lit(" ")).when(hc < F.lit(1.0 / 19.0), F.lit(None).cast("string")) \
            .otherwise(F.col(c))
        cols.append(v.alias(DIRTY_HEADERS[c]))
    ht, hs = F.col("_h_tgt"), F.col("_h_spell")
    target = F.when(ht < F.lit(0.05), _pick(hs, JUNK_SPELLINGS)) \
        .when(F.col(S.TARGET) == 1, _pick(hs, POSITIVE_SPELLINGS)) \
        .otherwise(_pick(hs, NEGATIVE_SPELLINGS))
    cols.append(target.alias(DIRTY_HEADERS[S.TARGET]))
    cols.append(F.lit(None).cast("string").alias("notas"))
    cols.append(F.lit("EC").alias("pais"))
    # one scan: every application emits one or two rows
    copies = F.when(F.col("_dup") < F.lit(0.02), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return h.select(*cols, F.explode(copies).alias("_copy")).drop("_copy")


def inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metamorphic retrain set: income effect flipped, one unseen institution."""
    a = applications(spark, sf_dir, income_weight=-S.SCORECARD_INCOME_WEIGHT)
    return a.withColumn("institucion", F.when(unit_hash("app_id", "inst") < F.lit(1.0 / 9.0), F.lit("Cooperativa Nueva"))
                        .otherwise(F.col("institucion")))
