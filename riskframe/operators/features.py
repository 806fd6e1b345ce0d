"""Feature engineering.

Categoricals are encoded with Spark ML (``StringIndexer`` + ``OneHotEncoder``):
the result is a sparse vector, so a high-cardinality column never becomes
thousands of physical columns.  Levels are sorted alphabetically; the
"unknown" slot is the one the encoder drops, so unseen or missing values
encode as all zeros (P8).  Scaling statistics are one aggregate pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.functions.hashing import unit_hash
from riskframe.functions.text import missing_to_null, parse_double
from riskframe.operators.stats import exact_medians
from riskframe.session import cut_lineage


# ---- F1 / F2 / P8 ------------------------------------------------------------
def encoder_pipeline(numeric: list[str], categorical: list[str], drop_first: bool = False,
                     output: str = "features") -> Pipeline:
    """Unfitted pipeline: index (alphabetical, unseen->extra slot), one-hot, assemble.

    ``drop_first=False`` keeps every known level (production); ``True`` drops
    the alphabetically first level as well (lab), via the indexer order
    ``alphabetDesc`` + dropped last slot would change names, so it is done by
    slicing in :func:`drop_first_level`.
    """
    stages = []
    ohe_out = []
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__idx", stringOrderType="alphabetAsc",
                                    handleInvalid="keep"))
        ohe_out.append(f"{c}__ohe")
    if categorical:
        # the indexer already maps unseen/NULL to its extra last index; dropLast removes that slot
        stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in categorical], outputCols=ohe_out,
                                    dropLast=True))
    stages.append(VectorAssembler(inputCols=numeric + ohe_out, outputCol=output, handleInvalid="keep"))
    return Pipeline(stages=stages)


def feature_names(model: PipelineModel, numeric: list[str], categorical: list[str]) -> list[tuple[str, str, str | None]]:
    """Ordered (feature_name, base, level) of the assembled vector, from the fitted indexers."""
    labels = {}
    for st in model.stages:
        if hasattr(st, "labels") and st.getOutputCol().endswith("__idx"):
            labels[st.getInputCol()] = list(st.labels)
    names = [(c, c, None) for c in numeric]
    for c in categorical:
        names += [(f"{c}_{lv}", c, lv) for lv in labels[c]]
    return names


def drop_first_level(df: DataFrame, names: list[tuple[str, str, str | None]], col: str = "features",
                     output: str = "features") -> tuple[DataFrame, list[tuple[str, str, str | None]]]:
    """remove the first (alphabetical) dummy of every categorical from the vector."""
    seen = set()
    keep = []
    for i, (name, base, level) in enumerate(names):
        if level is not None and base not in seen:
            seen.add(base)
            continue
        keep.append(i)
    arr = vector_to_array(F.col(col))
    sliced = F.array(*[arr[i] for i in keep])
    return df.withColumn(output, array_to_vector(sliced)), [names[i] for i in keep]


def one_hot_columns(df: DataFrame, col: str, levels: list[str], drop_first: bool = False,
                    prefix: str | None = None) -> DataFrame:
    """Wide form of F1/F2 for small closed domains: one DOUBLE column per level."""
    lv = sorted(levels)[1:] if drop_first else sorted(levels)
    p = prefix or col
    return df.withColumns({f"{p}_{v}": (F.col(col) == F.lit(v)).cast("double") for v in lv})


#: More levels than this are no closed domain: one-hot columns are refused, not built.
MAX_LEVELS = 500


def levels_of(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """Distinct non-null levels per column; a column with more than ``MAX_LEVELS`` is an error.

    The distinct values are counted where they are; only columns within the limit are listed."""
    st = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"))
                                       for c in cols])).alias("kv")).select("kv.*").filter(F.col("v").isNotNull()).distinct()
    st = cut_lineage(st, "levels")
    wide = [r["c"] for r in st.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MAX_LEVELS).collect()]
    if wide:
        raise ValueError(f"too many distinct values for one-hot columns: {', '.join(sorted(wide))}")
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in st.collect():  # at most MAX_LEVELS rows per column
        out[r["c"]].append(r["v"])
    return {c: sorted(v) for c, v in out.items()}


# ---- F3 / P17 ----------------------------------------------------------------
def feature_ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    """Min, max, mean, median per column, as rows ``(feature, min, max, mean, median)``."""
    df = cut_lineage(df.select(*cols), "ranges")
    agg = df.agg(*[F.struct(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
                            F.avg(c).alias("mean")).alias(c) for c in cols]).first()
    med = exact_medians(df, cols, default=0.0)
    rows = [(c, agg[c]["min"], agg[c]["max"], agg[c]["mean"], float(med[c]) if med[c] is not None else None)
            for c in cols]
    return df.sparkSession.createDataFrame(rows, "feature string, min double, max double, mean double, median double")


def feature_form(df: DataFrame, cols: list[str]) -> DataFrame:
    """F3 plus a binary flag (min and max both in {0,1})."""
    r = feature_ranges(df, cols)
    return r.withColumn("binary", F.col("min").isin(0.0, 1.0) & F.col("max").isin(0.0, 1.0))


# ---- F4 ----------------------------------------------------------------------
@dataclass
class ScalerModel:
    """Population-std standard scaler: z = (x - mean) / std_pop, std 0 -> 1."""
    columns: list[str]
    mean: list[float]
    std: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s)
                               for c, m, s in zip(self.columns, self.mean, self.std)})

    def transform_vector(self, df: DataFrame, col: str = "features", output: str = "scaled") -> DataFrame:
        arr = vector_to_array(F.col(col))
        means = F.array(*[F.lit(m) for m in self.mean])
        stds = F.array(*[F.lit(s) for s in self.std])
        z = F.zip_with(F.zip_with(arr, means, lambda x, m: x - m), stds, lambda d, s: d / s)
        return df.withColumn(output, array_to_vector(z))


def fit_scaler(df: DataFrame, cols: list[str]) -> ScalerModel:
    """F4 on wide columns: one pass of ``avg`` and ``stddev_pop``."""
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    means = [float(row[f"m_{i}"] or 0.0) for i in range(len(cols))]
    stds = [float(row[f"s_{i}"]) if row[f"s_{i}"] and row[f"s_{i}"] > 0 else 1.0 for i in range(len(cols))]
    return ScalerModel(list(cols), means, stds)


def fit_vector_scaler(df: DataFrame, col: str = "features", names: list[str] | None = None) -> ScalerModel:
    """F4 on a vector column: per-slot mean and population std via ``Summarizer``."""
    from pyspark.ml.stat import Summarizer
    s = df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(col)).alias("s")).first()["s"]
    n = s["count"]
    means = [float(x) for x in s["mean"].toArray()]
    # Summarizer variance is the sample variance; convert to population variance
    var = [float(v) * (n - 1) / n if n > 1 else 0.0 for v in s["variance"].toArray()]
    stds = [math.sqrt(v) if v > 0 else 1.0 for v in var]
    return ScalerModel(names or [f"f{i}" for i in range(len(means))], means, stds)


# ---- F5 / W5 -----------------------------------------------------------------
def hash_split(df: DataFrame, id_col: str, test_fraction: float = 0.2, seed: int = 42,
               out: str = "split") -> DataFrame:
    """F5 (scalable form): Bernoulli split on the per-row hash; no shuffle, stable on retry."""
    frac = max(0.1, min(float(test_fraction), 0.5))
    return df.withColumn(out, F.when(unit_hash(id_col, seed) < F.lit(frac), "test").otherwise("train"))


def stratified_split(df: DataFrame, id_col: str, label: str, test_fraction: float = 0.2, seed: int = 42,
                     out: str = "split", rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Exact stratified split - per class, the ``round(f * n_class)`` rows with the
    smallest (hash, id) go to test.  Rows without a label are a class of their own.

    The hash is uniform, so fixed-width hash buckets are balanced by
    construction: per (class, bucket) counts locate the one boundary bucket
    per class, and only rows of that bucket are ranked (window partitioned by
    class and bucket).  No step holds a whole class, and nothing reaches the driver
    but the number of rows.
    """
    frac = max(0.1, min(float(test_fraction), 0.5))
    nb = max(1, math.ceil(df.count() / rows_per_bucket))
    d = df.withColumn("_h", unit_hash(id_col, seed)) \
        .withColumn("_b", F.least(F.floor(F.col("_h") * nb), F.lit(nb - 1)).cast("int"))
    per = d.groupBy(F.col(label).alias("_l"), F.col("_b").alias("_pb")).agg(F.count(F.lit(1)).alias("_nb"))
    whole = Window.partitionBy("_l")
    earlier = whole.orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.withColumn("_before", F.coalesce(F.sum("_nb").over(earlier), F.lit(0))) \
        .withColumn("_need", F.floor(F.lit(frac) * F.sum("_nb").over(whole) + 0.5))
    j = d.join(offs, d[label].eqNullSafe(offs["_l"]) & (d["_b"] == offs["_pb"])).drop("_l", "_pb")
    full_in = F.col("_before") + F.col("_nb") <= F.col("_need")
    boundary = (F.col("_before") < F.col("_need")) & ~full_in
    decided = j.filter(~boundary).withColumn(out, F.when(full_in, "test").otherwise("train"))
    # only the boundary bucket of each class is ranked
    w = Window.partitionBy(label, "_b").orderBy("_h", id_col)
    edge = j.filter(boundary).withColumn("_r", F.row_number().over(w)) \
        .withColumn(out, F.when(F.col("_before") + F.col("_r") <= F.col("_need"), "test").otherwise("train")) \
        .drop("_r")
    return decided.unionByName(edge).drop("_h", "_b", "_nb", "_before", "_need")


def train_test_split(df: DataFrame, id_col: str, label: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """stratified when the label has exactly two classes of at least two rows, else the plain hash split."""
    sizes = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(3).collect()
    if len(sizes) == 2 and min(r["n"] for r in sizes) >= 2:
        return stratified_split(df, id_col, label, test_fraction, seed)
    return hash_split(df, id_col, test_fraction, seed)


# ---- P9 / P10 ----------------------------------------------------------------
def apply_defaults(df: DataFrame, defaults: dict = S.APPLICANT_DEFAULTS) -> DataFrame:
    """Absent columns added, blank/missing/unparsable values replaced by defaults."""
    out = df
    for c, v in defaults.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(v))
        elif isinstance(v, float):
            out = out.withColumn(c, F.coalesce(parse_double(F.col(c).cast("string")), F.lit(v)))
        else:
            out = out.withColumn(c, F.coalesce(missing_to_null(c), F.lit(v)))
    return out


def fill_with_medians(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """P10: missing / blank / unparsable numbers -> the training median."""
    return df.withColumns({c: F.coalesce(parse_double(F.col(c).cast("string")), F.lit(float(m)))
                           for c, m in medians.items()})
