"""Scalable exact order statistics and modes.

``exact_medians`` writes the columns once and finds the medians of all of them together, whatever the
size.  A column of at most two values (its least and its largest one) needs only their counts.  For the
others approximate quantiles bracket the middle ranks, a counting pass checks all brackets, and the
distinct values inside a bracket, with their counts, are ranked exactly.
Nulls and NaN are no values.  A bracket holds a fixed small share of the ranks; a hot value
is one row of it.  ``modes`` counts values with partial aggregation and picks the most
frequent (ties -> smallest) with ``min_by``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import cut_lineage

APPROX_ACCURACY = 100_000


def _interpolate(lo: float, hi: float, frac: float) -> float:
    # same arithmetic as Spark's Percentile: (1-f)*lo + f*hi
    if frac == 0.0:
        return float(lo)
    return (1.0 - frac) * lo + frac * hi


def exact_medians(df: DataFrame, cols: list[str], default: float | None = 0.0) -> dict[str, float | None]:
    """Exact (linearly interpolated) median of every column; without a value -> ``default``.

    ``df`` is evaluated once."""
    if not cols:
        return {}
    names = {f"v{i}": c for i, c in enumerate(cols)}
    x = cut_lineage(df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(v) for v, c in names.items()]), "medians")
    out = {v: m if m is not None else default for v, m in _of_two_values(x).items()}
    eps, pending = 2.0 / APPROX_ACCURACY, [v for v in names if v not in out]
    while pending:
        share = [max(0.0, 0.5 - eps), min(1.0, 0.5 + eps)]
        first = x.agg(*[F.count(v).alias(f"n_{v}") for v in pending],
                      *[F.percentile_approx(v, share, APPROX_ACCURACY).alias(f"q_{v}") for v in pending]).first()
        live = [v for v in pending if first[f"n_{v}"]]
        out |= {v: default for v in pending if v not in live}
        if not live:
            break
        cut = {v: first[f"q_{v}"] for v in live}
        place = x.agg(*[F.count_if(F.col(v) < cut[v][0]).alias(f"b_{v}") for v in live],
                      *[F.count_if(F.col(v) <= cut[v][1]).alias(f"e_{v}") for v in live]).first()
        wanted = {v: ((first[f"n_{v}"] - 1) // 2, first[f"n_{v}"] // 2) for v in live}
        held = [v for v in live if place[f"b_{v}"] <= wanted[v][0] and place[f"e_{v}"] > wanted[v][1]]
        open_ = [v for v in held if cut[v][0] != cut[v][1]]
        out |= {v: float(cut[v][0]) for v in held if v not in open_}
        if open_:
            found = _ranked(x, {v: (*cut[v], *(r - place[f"b_{v}"] for r in wanted[v])) for v in open_})
            for v in open_:
                lo, hi = found[v]
                out[v] = _interpolate(lo, hi, (first[f"n_{v}"] - 1) / 2.0 - wanted[v][0])
        pending, eps = [v for v in live if v not in held], eps * 4.0
    return {c: out[v] for v, c in names.items()}


def _of_two_values(x: DataFrame) -> dict[str, float | None]:
    """Medians of the columns whose every value is their least or their largest one (None: no value)."""
    ends = x.agg(*[F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias(v) for v in x.columns]).first()
    out: dict[str, float | None] = {v: None for v in x.columns if ends[v]["lo"] is None}
    live = [v for v in x.columns if v not in out]
    if not live:
        return out
    seen = x.agg(*[F.struct(F.count(v).alias("n"), F.count_if(F.col(v) == ends[v]["lo"]).alias("a"), F.count_if(F.col(v) == ends[v]["hi"]).alias("b"))
                   .alias(v) for v in live]).first()
    for v in live:
        (n, a, b), (lo, hi) = seen[v], ends[v]
        if lo == hi:
            out[v] = float(lo)
        elif a + b == n:
            pair = [lo if r < a else hi for r in ((n - 1) // 2, n // 2)]
            out[v] = _interpolate(*pair, (n - 1) / 2.0 - (n - 1) // 2)
    return out


def _ranked(x: DataFrame, want: dict[str, tuple]) -> dict[str, tuple[float, float]]:
    """Values at two 0-based ranks inside each column's bracket (lo, hi, rank, rank)."""
    inside = F.array(*[F.when((F.col(v) >= lo) & (F.col(v) <= hi), F.struct(F.lit(v).alias("c"), F.col(v).alias("x")))
                       for v, (lo, hi, _, _) in want.items()])
    counts = x.select(F.explode(F.filter(inside, lambda s: s.isNotNull())).alias("s")).groupBy("s.c", "s.x").agg(
        F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.partitionBy("c").orderBy("x"))
    ranks = F.create_map(*[y for v, (_, _, a, b) in want.items() for y in (F.lit(v), F.array(F.lit(a), F.lit(b)))])
    rows = counts.select("c", "x", upto.alias("upto")).withColumn("r", ranks[F.col("c")]).groupBy("c").agg(
        F.min(F.when(F.col("upto") > F.col("r")[0], F.col("x"))).alias("lo"),
        F.min(F.when(F.col("upto") > F.col("r")[1], F.col("x"))).alias("hi")).collect()  # one row per column
    return {r["c"]: (r["lo"], r["hi"]) for r in rows}


def modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """Most frequent non-null value per column, ties -> smallest value (pandas ``mode()[0]``)."""
    if not cols:
        return {}
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("kv")) \
        .select("kv.column", "kv.value").filter(F.col("value").isNotNull())
    counts = stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
    found = {r["column"]: r["mode"] for r in best.collect()}  # one row per column
    return {c: found.get(c) for c in cols}


def modes_frame(df: DataFrame, cols: list[str]) -> DataFrame:
    """Same as :func:`modes`, as a DataFrame ``(column, mode, n)``."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("kv")) \
        .select("kv.column", "kv.value").filter(F.col("value").isNotNull())
    counts = stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(
        F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value"))).alias("m")) \
        .select("column", F.col("m.value").alias("mode"), F.col("m.n").alias("n"))
