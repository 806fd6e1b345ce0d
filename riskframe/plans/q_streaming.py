"""Streaming queries (ST1-ST5).

Inputs are derived from the driver tables and staged as Parquet files in the
shared checkpoint folder, one write job per time slice, so files arrive in
event-time order as a real feed would.  A slice is written by ``STAGED_FILES`` tasks, and a
micro-batch takes as many files: exactly one slice.  Each query then runs its stream with
``availableNow`` and returns the sink read back as a batch DataFrame.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.functions import scoring as SC
from riskframe.models import ensemble as EN
from riskframe.models import registry as R
from riskframe.operators import user_table as U
from riskframe.plans import jobs
from riskframe.plans.registry import query
from riskframe.session import cut_lineage, scratch_path
from riskframe.sources import fixtures as fx
from riskframe.streaming import jobs as ST

_STAGED: dict = {}


STAGED_FILES = 8


def _write_slices(d, path, slices):
    """One append job per slice of ``d`` (column _slice), each of exactly ``STAGED_FILES`` files: a slice of too few
    rows gets empty ones, so that batches stay aligned with slices."""
    rows = d.drop("_slice")
    made = 0
    for s in slices:
        d.filter(F.col("_slice") == s).drop("_slice").repartition(STAGED_FILES).write.mode("append").parquet(path)
        made += STAGED_FILES
        there = len(d.sparkSession.read.schema(rows.schema).parquet(path).inputFiles())  # STAGED_FILES names a slice
        for _ in range(made - there):
            rows.limit(0).coalesce(1).write.mode("append").parquet(path)


def _sliced(df, slice_col, name):
    """``df`` written once with its slice."""
    return cut_lineage(df.withColumn("_slice", slice_col), f"stage-{name}")


def _stage(spark, sf, name, df, slice_col):
    """Write ``df`` to a new folder, one append job per distinct ``slice_col`` value (ascending)."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STAGED:
        path = scratch_path(spark, f"stream-{name}")
        d = _sliced(df, slice_col, name)
        _write_slices(d, path, sorted(r[0] for r in d.select("_slice").distinct().collect()))  # one row per slice
        _STAGED[key] = (path, df.schema)
    return _STAGED[key]


def _run(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def _rule_scores(batch):
    p = F.round(SC.sigmoid(SC.scorecard_z(), clip=None), 12)
    return batch.select("app_id", p.alias("p")).select(
        "app_id", F.round("p", 9).alias("probability"), SC.decision_band("p").alias("decision"),
        SC.binary_prediction("p").alias("aprobado"))


def _applications_with_resends(spark, sf):
    a = fx.application_features(spark, sf)
    resent = a.filter(F.col("u") < F.lit(0.02))          # ~2 % of applications are sent twice
    return a.unionByName(resent)


@query("ST1", """
SELECT app_id, round(round(p_latent, 12), 9) AS probability,
       CASE WHEN round(p_latent, 12) >= 0.66 THEN 'APROBAR' WHEN round(p_latent, 12) >= 0.40 THEN 'REVISAR'
            ELSE 'RECHAZAR' END AS decision,
       CAST(CASE WHEN round(p_latent, 12) >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS aprobado FROM applications""")
def st1_streaming_scoring(spark, sf):
    apps = _applications_with_resends(spark, sf)
    path, schema = _stage(spark, sf, "applications", apps, F.year("created_at"))
    sink = scratch_path(spark, "st1-sink")
    src = ST.application_stream(spark, path, schema, STAGED_FILES)
    _run(ST.scoring_stream(spark, src, _rule_scores, sink, scratch_path(spark, "st1-ckpt")))
    return spark.read.parquet(sink).drop("batch_id")


@query("ST2", """
SELECT CAST(created_at AS DATE) AS day, CAST(count(*) AS BIGINT) AS n, round(avg(probability), 3) AS avg_probability
FROM evaluations GROUP BY 1""")
def st2_daily_trend_stream(spark, sf):
    ev = fx.evaluations(spark, sf)
    path, schema = _stage(spark, sf, "evaluations", ev, F.year("created_at"))
    sink = scratch_path(spark, "st2-sink")
    src = ST.application_stream(spark, path, schema, STAGED_FILES)
    _run(ST.daily_trend_stream(src, sink, scratch_path(spark, "st2-ckpt")))
    return ST.newest(spark, sink, "day").withColumn("avg_probability", F.round("avg_probability", 3))


@query("ST3", """
SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen,
       CAST(count(*) FILTER (WHERE kind = 'visit') AS BIGINT) AS visits,
       CAST(count(*) FILTER (WHERE kind = 'evaluation') AS BIGINT) AS evaluations
FROM visits GROUP BY user_id""")
def st3_user_counters_stream(spark, sf):
    v = fx.visits(spark, sf)
    path, schema = _stage(spark, sf, "visits", v, F.year("ts") * 100 + F.month("ts"))
    sink = scratch_path(spark, "st3-users")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", STAGED_FILES).parquet(path)
    _run(ST.user_counter_stream(src, sink, scratch_path(spark, "st3-ckpt")))
    return U.read_activity(spark, sink).select("user_id", "first_seen", "last_seen", "visits", "evaluations")


def closed_loop(spark, sf):
    """(folder of the scored applications, registry) of the loop closed: score, receive labels, retrain, score on with the new model.

    The first model knows a market where income counts the other way round.  Applications of the earlier years are
    scored with it; their labels arrive in a stream of their own, whose batch retrains (M24) on what was scored and
    labelled and appends a registry row; the scoring stream goes on with it where it had stopped."""
    reg, sink, ckpt = scratch_path(spark, "registry"), scratch_path(spark, "st4-sink"), scratch_path(spark, "st4-ckpt")
    first = EN.train_ensemble(fx.inverted(spark, sf), "app_id", models=("logit",), source="seed")
    R.save(spark, first, scratch_path(spark, "models"), reg)
    loaded = {}

    def score_latest(batch):
        newest = R.latest(spark, reg).first()["version"]  # the newest registry row at every batch
        if newest not in loaded:                          # its models are read only when they change
            loaded[newest] = R.load(spark, reg)
        ens = loaded[newest]
        return EN.score(batch.select("app_id", *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES), ens, explain=False).select(
            "app_id", "probability", "decision", F.lit(ens.version).alias("model_version"), F.lit(ens.source).alias("model_source"))

    def retrain(labels):
        jobs.retrain_from_evaluations(spark, evaluated, labels, scratch_path(spark, "models"), reg, models=("logit",), version_after=first.version)

    d = _sliced(_applications_with_resends(spark, sf), F.year("created_at"), "st4")
    years = sorted(r[0] for r in d.select("_slice").distinct().collect())
    half = years[len(years) // 2]
    path, label_path = scratch_path(spark, "stream-st4"), scratch_path(spark, "stream-st4-labels")
    schema = d.drop("_slice").schema

    def score_on():
        _run(ST.scoring_stream(spark, ST.application_stream(spark, path, schema, STAGED_FILES), score_latest, sink, ckpt))

    _write_slices(d, path, [y for y in years if y < half])
    score_on()
    evaluated = fx.evaluations(spark, sf).filter(F.year("created_at") < half)
    labels = fx.truth_labels(spark, sf).join(evaluated.select("app_id"), "app_id")
    labels.write.parquet(label_path)
    _run(ST.retraining_stream(spark, spark.readStream.schema(labels.schema).parquet(label_path), scratch_path(spark, "st4-labels"), retrain,
                              scratch_path(spark, "st4-label-ckpt")))
    _write_slices(d, path, [y for y in years if y >= half])
    score_on()
    return sink, reg


@query("ST4")
def st4_hot_model_swap(spark, sf):
    return spark.read.parquet(closed_loop(spark, sf)[0])


@query("ST5", """
SELECT e.app_id, e.aprobado, l.aprobado_real, l.labelled_at,
       CAST(coalesce(l.aprobado_real, e.aprobado, 0) AS INTEGER) AS final
FROM evaluations e LEFT JOIN (
  SELECT x.app_id, arg_max(t.aprobado_real, (t.labelled_at, t.aprobado_real)) AS aprobado_real, max(t.labelled_at) AS labelled_at
  FROM evaluations x JOIN truth_labels t ON x.app_id = t.app_id
   AND t.labelled_at >= x.created_at AND t.labelled_at <= x.created_at + INTERVAL 60 DAY GROUP BY x.app_id) l ON e.app_id = l.app_id""")
def st5_late_labels_stream(spark, sf):
    ev = fx.evaluations(spark, sf).select("app_id", "created_at", "aprobado")
    lab = fx.truth_labels(spark, sf)
    ep, es = _stage(spark, sf, "eval-keys", ev, F.year("created_at"))
    lp, ls = _stage(spark, sf, "labels", lab, F.year("labelled_at"))
    sink = scratch_path(spark, "st5-sink")
    e = spark.readStream.schema(es).option("maxFilesPerTrigger", STAGED_FILES).parquet(ep)
    lb = spark.readStream.schema(ls).option("maxFilesPerTrigger", STAGED_FILES).parquet(lp)
    _run(ST.late_label_stream(e, lb, sink, scratch_path(spark, "st5-ckpt")))
    joined = spark.read.parquet(sink).withColumn("labelled_at", F.col("labelled_at").cast("timestamp_ntz"))
    return ST.with_late_labels(ev.select("app_id", "aprobado"), joined)
