"""End-to-end jobs: production retrain (M24), model report tables (M23), lab flow.

Each job is a composition of the operators; its only driver-side state is the
(small) fitted model and the report rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.functions.targets import normalize_binary_columns, normalize_target, relabel_two_classes
from riskframe.models import ensemble as EN
from riskframe.models import estimators as E
from riskframe.models import registry as R
from riskframe.operators import cleaning as C
from riskframe.operators import fairness
from riskframe.operators import features as FE
from riskframe.operators import monitoring as MO
from riskframe.session import cut_lineage


def retrain_from_evaluations(spark: SparkSession, evaluations: DataFrame, labels: DataFrame, model_path: str,
                             registry_path: str, sizes: E.ModelSizes | None = None, min_rows: int = 50,
                             id_col: str = "app_id", models: tuple[str, ...] = E.ENSEMBLE_MODELS,
                             version_after: str | None = None) -> EN.Ensemble:
    """Export (J2) -> gates (P14) -> production prep (F8) -> train (M7) -> registry append.

    Versions are named by the minute; one that would be equal to ``version_after`` gets a suffix."""
    exported = cut_lineage(MO.export_training(evaluations, labels, keep=[id_col]), "exported")  # the gates and the prep read it
    C.check_training_gate(exported, S.TARGET, min_rows)
    prepared = cut_lineage(C.prepare_production(exported, extra=[id_col]))
    ens = EN.train_ensemble(prepared, id_col, models=models, sizes=sizes, source="evaluations")
    if version_after is not None and ens.version <= version_after:
        ens.version = f"{version_after}.next"
    R.save(spark, ens, model_path, registry_path)
    return ens


def report_tables(registry_row: DataFrame, labelled: DataFrame) -> dict[str, DataFrame]:
    """Summary card (M22), ranked models (T6), fairness rates (A5) and disparity."""
    rates = fairness.group_rates(labelled.withColumn("_y", normalize_target(F.col(S.TARGET).cast("string"), "report")),
                                 "_y", ["sexo", "institucion"])
    return {
        "summary": R.summary(registry_row),
        "models": R.ranked_models(registry_row),
        "fairness": rates,
        "disparity": fairness.disparity(rates),
    }


@dataclass
class LabResult:
    train: DataFrame
    test: DataFrame
    feature_names: list[str]
    scaler: FE.ScalerModel
    medians: dict
    modes: dict
    report: list[tuple[str, str]]
    train_raw: DataFrame  # the training part before scaling


def prepare_lab(df: DataFrame, target: str, id_col: str, test_fraction: float = 0.2, seed: int = 42) -> LabResult:
    """the lab preprocessing chain in its fixed order.

    drop null target -> target to 0/1 (binary words, else two-value relabel; any other
    value is refused, and both classes must occur) -> binary text columns -> detect
    types -> median / mode imputation -> one-hot (first level dropped) -> drop constant
    features -> split -> population-std scaling fitted on train.
    """
    report = []
    d, removed = C.drop_null_target(df, target)
    if removed:
        report.append(("drop_null_target", str(removed)))
    if dict(d.dtypes)[target] == "string":
        d, conv = normalize_binary_columns(d, [target])
        if not conv:
            d, mapping = relabel_two_classes(d, target)
            report.append(("relabel_target", str(mapping)))
    y = F.col(target).try_cast("double")
    seen = d.agg(F.count_if(y == 0).alias("zero"), F.count_if(y == 1).alias("one"), F.count(F.lit(1)).alias("n")).first()
    if seen["zero"] + seen["one"] != seen["n"]:
        raise ValueError("the target must be 0/1 (or two distinct values)")
    if not seen["zero"] or not seen["one"]:
        raise ValueError("the target needs both classes")
    d = d.withColumn(target, y.cast("int"))
    feats = [c for c in d.columns if c not in (target, id_col)]
    text = [c for c, t in d.dtypes if c in feats and t == "string"]
    d, converted = normalize_binary_columns(d, text)
    dtypes = dict(d.dtypes)
    numeric = [c for c in feats if C.is_numeric_type(dtypes[c])]
    categorical = [c for c in feats if c not in numeric]
    d, med, mod = C.impute(d.withColumns({c: F.col(c).cast("double") for c in numeric}), numeric, categorical)
    levels = FE.levels_of(d, categorical) if categorical else {}
    for c in categorical:
        d = FE.one_hot_columns(d, c, levels[c], drop_first=True).drop(c)
    feats = [c for c in d.columns if c not in (target, id_col)]
    kept, const = C.drop_constant_columns(d.select(*feats))
    feats = kept.columns
    d = cut_lineage(FE.train_test_split(d.select(id_col, target, *feats), id_col, target, test_fraction, seed))
    train, test = d.filter(F.col("split") == "train"), d.filter(F.col("split") == "test")
    scaler = FE.fit_scaler(train, feats)
    report.append(("features", str(len(feats))))
    if const:
        report.append(("drop_constant", ",".join(const)))
    return LabResult(scaler.transform(train), scaler.transform(test), feats, scaler, med, mod, report, train)
