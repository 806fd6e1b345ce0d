"""Explanations and what-if analysis.

What-if analysis never loops over candidates on the driver.  With an ensemble, a row's variants
are made and scored inside the task that holds the row (:mod:`riskframe.models.scorer`): a column of
probabilities, no shuffle.  With any other score function over raw columns, every row is exploded into its
scenarios (a handful per row), all are scored in ONE batched pass and folded back per row by partial
aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.functions.scoring import factor_weight, largest_factors, next_history_level, top_factors

ScoreFn = Callable[[DataFrame], DataFrame]   # adds a DOUBLE column "p"
#: (x, moves, count) -> probabilities of a row and of its variants, see ``scorer.score_variants``.
VariantFn = Callable[[Column, Column, Column], Column]

# FIXED VALUES: recommendation icons and texts (formats take the values shown).
REC_CREDITS = ("💳", "Si reduces tus créditos activos de %d a %d, tu aprobación sube ~%.0f%%.")
REC_HISTORY = ("📅", "Mantener tus pagos al día (historial «%s») aumentaría tu aprobación ~%.0f%%.")
REC_INCOME = ("💵", "Demostrar ingresos un 25%% mayores elevaría tu aprobación ~%.0f%%.")
REC_DEFAULT = ("✅", "Tu perfil ya está bien optimizado. ¡Mantén tus buenos hábitos financieros!")


def factors_table(df: DataFrame, id_col: str, contribs: str = "contribs", k: int = 5) -> DataFrame:
    """Per row the top-k positive and negative contributions, flattened to
    ``(id, sign, rank, feature, impact, weight)``.  Arrays are sorted per row: no shuffle."""
    pos = top_factors(contribs, k, positive=True)
    neg = top_factors(contribs, k, positive=False)
    both = df.select(id_col, F.posexplode(pos).alias("rank", "f"), F.lit("positive").alias("sign")) \
        .unionByName(df.select(id_col, F.posexplode(neg).alias("rank", "f"), F.lit("negative").alias("sign")))
    return both.select(id_col, "sign", (F.col("rank") + 1).alias("rank"), F.col("f.feature").alias("feature"),
                       F.col("f.impact").alias("impact"), factor_weight(F.col("f.impact")).alias("weight"))


def contributions_table(df: DataFrame, id_col: str, contribs: str = "contribs", shown: int = 20, considered: int = 12,
                        signed: int = 6) -> DataFrame:
    """Per row its ``shown`` largest contributions, the ``considered`` first of them that what-ifs are made of, and the
    ``signed`` largest of each sign, flattened to ``(id, part, rank, feature, impact)``."""
    largest = largest_factors(contribs, shown)
    parts = {"shown": largest, "considered": F.slice(largest, 1, considered), "positive": top_factors(contribs, signed, positive=True, min_abs=0.0),
             "negative": top_factors(contribs, signed, positive=False, min_abs=0.0)}
    def ranked(part: str, arr: Column) -> Column:
        return F.transform(arr, lambda e, k: F.struct(F.lit(part).alias("part"), (k + 1).alias("rank"), e["feature"].alias("feature"),
                                                      e["impact"].alias("impact")))

    each = F.flatten(F.array(*[ranked(part, arr) for part, arr in parts.items()]))
    return df.select(id_col, F.explode(each).alias("f")).select(id_col, "f.*")


def recommendations(df: DataFrame, id_col: str, score_fn: ScoreFn, max_recs: int = 4,
                    min_gain: float = 0.01) -> DataFrame:
    """Three what-if scenarios on the raw applicant columns.

    (1) one active credit less, (2) next payment-history level, (3) income
    x 1.25.  Gains above ``min_gain`` are kept, sorted by gain, at most
    ``max_recs``; a default message when none.  Output: ``id, base_p,
    recommendations ARRAY<STRUCT<icon, text, gain, kind>>``.
    """
    ca = F.floor(F.col("creditos_activos")).cast("int")
    nxt = next_history_level("historial_pagos")
    raw = S.NUMERIC_FEATURES + S.CATEGORICAL_FEATURES
    base = df.select(id_col, *raw).withColumn("_row", F.monotonically_increasing_id())  # rows with equal ids stay apart

    def scen(kind: str, **over) -> Column:
        fields = [F.lit(kind).alias("kind")]
        for c in raw:
            fields.append((over[c] if c in over else F.col(c)).alias(c))
        return F.struct(*fields)

    arr = F.array(
        scen("base"),
        F.when(ca >= 1, scen("credits", creditos_activos=F.greatest(ca - 1, F.lit(0)).cast("double"))),
        F.when(nxt.isNotNull(), scen("history", historial_pagos=nxt)),
        scen("income", ingresos_mensuales=F.col("ingresos_mensuales") * 1.25),
    )
    exploded = base.select("_row", id_col, F.explode(F.filter(arr, lambda s: s.isNotNull())).alias("s")) \
        .select("_row", id_col, "s.*")
    scored = score_fn(exploded)                      # one batched scoring pass
    per_row = scored.groupBy("_row").agg(
        F.first(id_col).alias(id_col), *[F.max(F.when(F.col("kind") == k, F.col("p"))).alias(f"p_{k}") for k in ("base", "credits", "history", "income")],
        F.max(F.when(F.col("kind") == "base", F.col("creditos_activos"))).alias("_ca"),
        F.max(F.when(F.col("kind") == "history", F.col("historial_pagos"))).alias("_next"))
    return _recommended(per_row, id_col, max_recs, min_gain)


def _recommended(per_row: DataFrame, id_col: str, max_recs: int, min_gain: float) -> DataFrame:
    """From p_base, p_credits, p_history, p_income (null: no such scenario), _ca and _next to the recommendations."""
    d = {k: F.col(f"p_{k}") - F.col("p_base") for k in ("credits", "history", "income")}
    ca0 = F.floor(F.col("_ca")).cast("int")

    def rec(kind, icon, text, gain):
        return F.when(gain > F.lit(min_gain), F.struct(F.lit(icon).alias("icon"), text.alias("text"),
                                                       F.round(gain * 100.0, 1).alias("gain"),
                                                       F.lit(kind).alias("kind")))

    recs = F.array(
        rec("credits", REC_CREDITS[0], F.format_string(REC_CREDITS[1], ca0, ca0 - 1, d["credits"] * 100.0), d["credits"]),
        rec("history", REC_HISTORY[0], F.format_string(REC_HISTORY[1], F.col("_next"), d["history"] * 100.0), d["history"]),
        rec("income", REC_INCOME[0], F.format_string(REC_INCOME[1], d["income"] * 100.0), d["income"]),
    )
    kept = F.filter(recs, lambda r: r.isNotNull())
    ordered = F.array_sort(kept, lambda a, b: F.when(a["gain"] > b["gain"], -1).when(a["gain"] < b["gain"], 1)
                           .otherwise(0))
    default = F.array(F.struct(F.lit(REC_DEFAULT[0]).alias("icon"), F.lit(REC_DEFAULT[1]).alias("text"),
                               F.lit(0.0).alias("gain"), F.lit("none").alias("kind")))
    top = F.slice(ordered, 1, max_recs)
    return per_row.select(id_col, F.col("p_base").alias("base_p"),
                          F.when(F.size(top) > 0, top).otherwise(default).alias("recommendations"))


def encoded_recommendations(df: DataFrame, id_col: str, slots: dict[str, int], levels: dict[str, int], score: VariantFn,
                            max_recs: int = 4, min_gain: float = 0.01) -> DataFrame:
    """M14 on encoded rows: id, ``x`` and the raw ``creditos_activos``, ``historial_pagos``.

    ``slots``: places of the numeric features in ``x``; ``levels``: those of the payment-history levels.  Rows stay where they
    are: one variant per scenario, scored in the task."""
    ca = F.floor(F.col("creditos_activos")).cast("int")
    nxt = next_history_level("historial_pagos")
    income = slots["ingresos_mensuales"]

    def move(variant: Column, slot: Column | int, value: Column) -> Column:
        return F.struct(variant.cast("int").alias("variant"), (F.lit(slot) if isinstance(slot, int) else slot).cast("int").alias("slot"),
                        value.cast("double").alias("value"))

    place = F.create_map(*[F.lit(v) for pair in levels.items() for v in pair]) if levels else F.create_map().cast("map<string,int>")
    has = {"credits": ca >= 1, "history": nxt.isNotNull(), "income": F.lit(True)}
    number = {"credits": F.lit(0), "history": has["credits"].cast("int"), "income": has["credits"].cast("int") + has["history"].cast("int")}
    moves = F.filter(F.array(
        F.when(has["credits"], move(number["credits"], slots["creditos_activos"], F.greatest(ca - 1, F.lit(0)))),
        *[F.when(has["history"] & (F.col("historial_pagos") == lv), move(number["history"], k, F.lit(0.0))) for lv, k in levels.items()],
        F.when(has["history"] & F.try_element_at(place, nxt).isNotNull(), move(number["history"], F.try_element_at(place, nxt), F.lit(1.0))),
        move(number["income"], income, F.col("x")[income] * 1.25)), lambda m: m.isNotNull())
    count = has["credits"].cast("int") + has["history"].cast("int") + 1
    scored = df.withColumn("_ps", score(F.col("x"), moves, count))
    per_row = scored.select(id_col, F.col("_ps")[0].alias("p_base"), F.col("creditos_activos").alias("_ca"), nxt.alias("_next"), *[
        F.when(has[k], F.get("_ps", number[k] + 1)).alias(f"p_{k}") for k in has])
    return _recommended(per_row, id_col, max_recs, min_gain)


# ---- what-if on the encoded features (M12, M13, E21) --------------------------------
# FIXED VALUES: tip and explanation texts.
TIP_FLIP = "%s «%s» → tu probabilidad subiría +%.1f pts (a %.0f%%)."
TIP_MOVE = "%s «%s» mejoraría tu aprobación en +%.1f pts (a %.0f%%)."
TIP_NONE = ("Tu perfil ya está bien optimizado para este modelo: ninguna variable individual mejora mucho la "
            "probabilidad.")
EXPLANATION = ("El modelo (%s) estima una probabilidad de pago del %.1f%%. Las 3 variables con mayor peso en esta "
               "decisión son: %s.")
CONSIDERED, SHOWN, LEAST_GAIN = 12, 4, 0.005


def _scored_moves(df: DataFrame, moves: Column, score: VariantFn) -> DataFrame:
    """``df`` with its base probability ``_p0`` and ``scored``: the ``moves`` with their probabilities.

    ``moves``: ARRAY<STRUCT<slot, value, ...>> over the array column ``x``; each replaces one slot in a variant of its own."""
    single = F.transform("_moves", lambda m, k: F.struct(k.alias("variant"), m["slot"].cast("int").alias("slot"), m["value"].alias("value")))
    rows = df.withColumn("_moves", moves)
    rows = rows.withColumn("_ps", score(F.col("x"), single, F.size("_moves")))
    return rows.withColumn("_p0", F.col("_ps")[0]).withColumn("scored", F.arrays_zip("_moves", F.expr("slice(_ps, 2, size(_moves))").alias("p"))) \
        .drop("_ps", "_moves")


def encoded_ablation(df: DataFrame, id_col: str, names: list[str], medians: dict[str, float], score: VariantFn) -> DataFrame:
    """M12 on every encoded feature: probability minus the probability with the feature at its median."""
    slots = F.array(*[F.struct(F.lit(k).alias("slot"), F.lit(float(medians[n])).alias("value"), F.lit(n).alias("feature"))
                      for k, n in enumerate(names)])
    rows = _scored_moves(df, slots, score)
    return rows.select(id_col, "_p0", F.explode("scored").alias("m")).select(
        id_col, F.col("m._moves.feature").alias("feature"), (F.col("_p0") - F.col("m.p")).alias("impact"))


def encoded_sensitivity(df: DataFrame, id_col: str, names: list[str], ranges: dict[str, tuple[float, float]],
                        score: VariantFn, model: str = "ensemble") -> DataFrame:
    """What-if of the ``CONSIDERED`` features that weigh most in a row.

    ``df``: id, ``x`` (encoded values) and ``contribs`` (ARRAY<STRUCT<feature, impact>> in slot order).  A feature
    whose range is within {0, 1} is flipped, another is moved by a tenth of its range up and down, clamped;
    the better move stays (the upward one of equals).  Output: id, probability, improvers (gain above
    ``LEAST_GAIN``, at most ``SHOWN``, best first) with current and suggested value, delta and new
    probability, tips and the explanation sentence."""
    lows, highs = (F.array(*[F.lit(float(ranges[n][k])) for n in names]) for k in (0, 1))
    by_weight = F.array_sort(F.transform("contribs", lambda c, i: F.struct(
        (-F.abs(c["impact"])).alias("w"), c["feature"].alias("feature"), c["impact"].alias("impact"), i.alias("slot"))))
    top = df.withColumn("ranked", F.slice(by_weight, 1, CONSIDERED))

    def moves_of(c: Column) -> Column:
        now, lo, hi = F.get("x", c["slot"]), F.get(lows, c["slot"]), F.get(highs, c["slot"])
        binary = lo.isin(0.0, 1.0) & hi.isin(0.0, 1.0)
        step = (hi - lo) * 0.1
        values = F.when(binary, F.array(1.0 - now)).otherwise(F.filter(
            F.array(F.least(hi, now + step), F.greatest(lo, now - step)), lambda v: v != now))
        return F.transform(values, lambda v, k: F.struct(c["slot"].alias("slot"), v.alias("value"), c["feature"].alias("feature"),
                                                         now.alias("current"), binary.alias("binary"), k.alias("turn")))

    rows = _scored_moves(top, F.flatten(F.transform("ranked", moves_of)), score)
    rows = rows.withColumn("scored", F.transform("scored", lambda z: F.struct(
        *[z["_moves"][c].alias(c) for c in ("turn", "feature", "current", "value", "binary")], z["p"].alias("p"))))
    gains = F.array_sort(F.transform("scored", lambda m: F.struct(
        (F.col("_p0") - m["p"]).alias("loss"), m["turn"].alias("turn"), m["feature"].alias("feature"),
        m["current"].alias("current"), m["value"].alias("suggested"), (m["p"] - F.col("_p0")).alias("delta"),
        m["p"].alias("new_prob"), m["binary"].alias("binary"))))
    rows = rows.withColumn("g", gains)
    # sorted by gain, so a feature's better move is its first one
    best = F.filter("g", lambda m, k: (m["delta"] > LEAST_GAIN) & (
        F.array_position(F.transform("g", lambda n: n["feature"]), m["feature"]) == k + 1))
    rows = rows.withColumn("improvers", F.slice(best, 1, SHOWN))
    points = lambda m: (m["feature"], m["delta"] * 100.0, m["new_prob"] * 100.0)
    tip = lambda m: F.when(m["binary"], F.format_string(
        TIP_FLIP, F.when(m["suggested"] >= 0.5, "Activa").otherwise("Desactiva"), *points(m))).otherwise(F.format_string(
            TIP_MOVE, F.when(m["suggested"] > m["current"], "Aumentar").otherwise("Reducir"), *points(m)))
    weights = F.array_join(F.transform(F.slice("ranked", 1, 3), lambda c: F.format_string("%s (Δ=%+.3f)", c["feature"], c["impact"])), ", ")
    return rows.select(
        id_col, F.col("_p0").alias("probability"),
        F.transform("improvers", lambda m: F.struct(
            *[m[c].alias(c) for c in ("feature", "current", "binary", "suggested", "delta", "new_prob")])).alias("improvers"),
        F.when(F.size("improvers") > 0, F.transform("improvers", tip)).otherwise(F.array(F.lit(TIP_NONE))).alias("tips"),
        F.format_string(EXPLANATION, F.lit(model), F.col("_p0") * 100.0, weights).alias("explanation"))
