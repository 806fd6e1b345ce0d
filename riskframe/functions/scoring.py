"""Score-side column expressions.

All of these are plain Catalyst expressions: they stay inside whole-stage
code generation and need no Python worker.
"""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe import schema as S


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _case(col: Column, mapping: dict, default) -> Column:
    """``CASE col WHEN k THEN v ... ELSE default END`` with DOUBLE results."""
    out = None
    for k, v in mapping.items():
        out = (F.when(col == F.lit(k), F.lit(float(v))) if out is None
               else out.when(col == F.lit(k), F.lit(float(v))))
    return out.otherwise(F.lit(float(default)))


# ---- E10 / E11 / E12 / E13 / E14 -------------------------------------------------
def decision_band(p: Column | str, hi: float = S.DECISION_THRESHOLDS[0],
                  lo: float = S.DECISION_THRESHOLDS[1], strict: bool = False) -> Column:
    """E10 (inclusive 0.66/0.40) and E11 (``strict=True``, 0.65/0.40)."""
    p = _c(p)
    if strict:
        return F.when(p > hi, "APROBAR").when(p > lo, "REVISAR").otherwise("RECHAZAR")
    return F.when(p >= hi, "APROBAR").when(p >= lo, "REVISAR").otherwise("RECHAZAR")


def risk_band(p: Column | str) -> Column:
    """Alta / media / baja."""
    p = _c(p)
    (a, _), (m, _), (b, _) = S.RISK_BANDS
    return F.when(p >= 0.66, a).when(p >= 0.40, m).otherwise(b)


def risk_label(p: Column | str) -> Column:
    p = _c(p)
    (_, a), (_, m), (_, b) = S.RISK_BANDS
    return F.when(p >= 0.66, a).when(p >= 0.40, m).otherwise(b)


# FIXED VALUES: verdict texts of the three risk bands (high, medium, low).
VERDICTS = (
    "¡Felicidades! Tu perfil tiene una alta probabilidad de aprobación.",
    "Tu perfil es viable, pero puedes mejorarlo para asegurar la aprobación.",
    "Tu perfil presenta riesgo. Sigue las recomendaciones para mejorar.",
)


def verdict_text(p: Column | str) -> Column:
    p = _c(p)
    return F.when(p >= 0.66, VERDICTS[0]).when(p >= 0.40, VERDICTS[1]).otherwise(VERDICTS[2])


def binary_prediction(p: Column | str, threshold: float = 0.5) -> Column:
    """``prob >= 0.5`` as INT."""
    return (_c(p) >= F.lit(threshold)).cast("int")


def percent(p: Column | str) -> Column:
    """``round(100 p, 1)`` (HALF_UP)."""
    return F.round(_c(p) * 100.0, 1)


# ---- E15 / E16 / E17 ---------------------------------------------------------------
def sigmoid(z: Column | str, clip: float | None = 30.0) -> Column:
    """Logistic function, argument clipped to +-clip (None: no clip)."""
    z = _c(z)
    if clip is not None:
        z = F.greatest(F.least(z, F.lit(clip)), F.lit(-clip))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


_GELU_C = math.sqrt(2.0 / math.pi)


def gelu(x: Column | str) -> Column:
    """Tanh form of GELU."""
    x = _c(x)
    return 0.5 * x * (1.0 + F.tanh(F.lit(_GELU_C) * (x + 0.044715 * F.pow(x, 3))))


def bce_term(p: Column | str, y: Column | str, eps: float = 1e-7) -> Column:
    """Per-row binary cross-entropy with p clipped to [eps, 1-eps]; average it."""
    p = F.greatest(F.least(_c(p), F.lit(1.0 - eps)), F.lit(eps))
    y = _c(y).cast("double")
    return -(y * F.log(p) + (1.0 - y) * F.log(1.0 - p))


# ---- E18 scorecard ---------------------------------------------------------------
def scorecard_terms(income_weight: float = S.SCORECARD_INCOME_WEIGHT) -> list[tuple[str, Column]]:
    """Additive terms of the latent approval rule, in the order they are summed."""
    return [
        ("ingresos_mensuales", F.col("ingresos_mensuales") / S.SCORECARD_INCOME_SCALE * income_weight),
        ("historial_pagos", _case(F.col("historial_pagos"), {k: v for k, v in S.SCORECARD_HISTORY.items() if k != "Excelente"}, S.SCORECARD_HISTORY["Excelente"])),
        ("educacion", _case(F.col("educacion"), {k: v for k, v in S.SCORECARD_EDUCATION.items() if k != "Posgrado"}, S.SCORECARD_EDUCATION["Posgrado"])),
        ("creditos_activos", -(F.lit(-S.SCORECARD_CREDITS) * F.col("creditos_activos"))),
        ("cargas_familiares", -(F.lit(-S.SCORECARD_DEPENDANTS) * F.col("cargas_familiares"))),
        ("situacion_laboral", _case(F.col("situacion_laboral"), {k: v for k, v in S.SCORECARD_EMPLOYMENT.items() if k != "Desempleado"}, S.SCORECARD_EMPLOYMENT["Desempleado"])),
        ("tipo_credito", _case(F.col("tipo_credito"), {k: v for k, v in S.SCORECARD_CREDIT_TYPE.items() if k != "Hipotecario"}, S.SCORECARD_CREDIT_TYPE["Hipotecario"])),
        ("edad", -(F.lit(-S.SCORECARD_AGE_WEIGHT) * F.abs(F.col("edad") - S.SCORECARD_AGE_CENTRE))),
    ]


def scorecard_z(income_weight: float = S.SCORECARD_INCOME_WEIGHT) -> Column:
    """Latent score, summed left to right exactly like the oracle SQL."""
    z = F.lit(S.SCORECARD_INTERCEPT)
    for name, term in scorecard_terms(income_weight):
        if name in ("creditos_activos", "cargas_familiares", "edad"):
            # ``z - w*x`` (not ``z + (-w*x)``) keeps bit-identical sums with the SQL twin
            z = z - (-term)
        else:
            z = z + term
    return z


def scorecard_contributions(income_weight: float = S.SCORECARD_INCOME_WEIGHT) -> Column:
    """Per-row ARRAY<STRUCT<feature, impact>> of the scorecard terms (input of W3/T3)."""
    return F.array(*[F.struct(F.lit(n).alias("feature"), t.alias("impact"))
                     for n, t in scorecard_terms(income_weight)])


# ---- W3 / T3: per-row top-k without a shuffle ------------------------------------
def top_factors(contribs: Column | str, k: int = 5, positive: bool = True, min_abs: float = 1e-6) -> Column:
    """Top-k contributions of one sign by |impact| desc (ties: feature name asc)."""
    arr = _c(contribs)
    kept = F.filter(arr, lambda e: (e["impact"] > 0) if positive else (e["impact"] < 0))
    kept = F.filter(kept, lambda e: F.abs(e["impact"]) >= min_abs)
    ordered = F.array_sort(
        kept,
        lambda a, b: F.when(F.abs(a["impact"]) > F.abs(b["impact"]), -1)
        .when(F.abs(a["impact"]) < F.abs(b["impact"]), 1)
        .when(a["feature"] < b["feature"], -1)
        .when(a["feature"] > b["feature"], 1)
        .otherwise(0),
    )
    return F.slice(ordered, 1, k)


def largest_factors(contribs: Column | str, k: int = 20) -> Column:
    """The k contributions of largest |impact| of either sign (ties: feature name asc)."""
    keyed = F.transform(_c(contribs), lambda e: F.struct((-F.abs(e["impact"])).alias("w"), e["feature"].alias("feature"), e["impact"].alias("impact")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda e: F.struct(e["feature"].alias("feature"), e["impact"].alias("impact")))


# ---- E19 / E20 / E21 / E22 -----------------------------------------------------
def _label_map() -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in S.FRIENDLY_LABELS.items()))


def capitalize(col: Column) -> Column:
    """Python ``str.capitalize``: first letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substring(col, 2, 1 << 30)))


def friendly_label(base: Column | str, value: Column | str | None = None) -> Column:
    """Display label of a base feature, or of a dummy ``base = value``."""
    base = _c(base)
    label = F.try_element_at(_label_map(), base)
    if value is None:
        return F.coalesce(label, capitalize(F.regexp_replace(base, "_", " ")))
    value = _c(value)
    trimmed = F.replace(F.replace(label, F.lit("Tu "), F.lit("")), F.lit("Tus "), F.lit(""))
    dummy = F.concat(capitalize(trimmed), F.lit(": "), F.regexp_replace(value, "_", " "))
    return F.when(label.isNull(), capitalize(F.regexp_replace(F.concat_ws("_", base, value), "_", " "))).otherwise(dummy)


def factor_weight(impact: Column | str) -> Column:
    """``round(min(1, |impact|/3), 2)``."""
    return F.round(F.least(F.lit(1.0), F.abs(_c(impact)) / 3.0), 2)


def next_history_level(col: Column | str) -> Column:
    """Next payment-history level, NULL for the best level or unknown text."""
    levels = F.array(*[F.lit(v) for v in S.PAYMENT_HISTORY])
    pos = F.array_position(levels, _c(col))
    return F.when(pos > 0, F.try_element_at(levels, (pos + 1).cast("int")))


def auc_grade(auc: Column | str) -> Column:
    """Display grade of an AUC."""
    a = _c(auc)
    return F.when(a >= 0.8, "bueno").when(a >= 0.7, "aceptable").otherwise("debil")


def loss_drop(first: Column | str, last: Column | str) -> Column:
    """Relative loss drop ``1 - last/first`` (NULL when first is 0)."""
    return F.lit(1.0) - F.try_divide(_c(last), _c(first))


def safe_double(col: Column | str) -> Column:
    """NaN / +-Inf -> NULL before JSON encoding."""
    c = _c(col)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(c)


def per_model_json(per_model: Column | str) -> Column:
    """``MAP<STRING,DOUBLE>`` -> JSON text, non-finite values as null."""
    m = F.transform_values(_c(per_model), lambda k, v: safe_double(v))
    return F.to_json(m)
