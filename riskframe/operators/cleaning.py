"""Dataset cleaning and profiling.

Decisions that depend on the data (which columns are all null, constant,
binary; medians; modes) are taken from ONE aggregate pass each; the rows
themselves stay distributed and are transformed with column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.functions.targets import normalize_target
from riskframe.functions.text import missing_to_null, normalize_name, parse_double
from riskframe.operators.stats import exact_medians, modes
from riskframe.session import cut_lineage

NUMERIC_TYPES = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")


def is_numeric_type(dtype: str) -> bool:
    return dtype.startswith(NUMERIC_TYPES)


@dataclass
class Notes:
    """Step report of a cleaning run (kept on the driver: one line per step)."""
    lines: list[tuple[str, str, str, int]] = field(default_factory=list)

    def add(self, step: str, column: str, detail: str, n: int = 0) -> None:
        self.lines.append((step, column, detail, int(n)))


# ---- S4 / P2 / P3 / P1 / S5 ------------------------------------------------------
def strip_headers(df: DataFrame) -> DataFrame:
    """Strip blanks around every column name."""
    return df.toDF(*[c.strip() for c in df.columns])


def remap_columns(df: DataFrame, aliases: dict[str, list[str]] = S.COLUMN_ALIASES) -> tuple[DataFrame, dict]:
    """Normalise headers (E1) and rename known spellings to canonical names.

    Rule for clashes: an existing canonical column wins; an alias is only
    renamed when its canonical name is still free.
    """
    normed = [normalize_name(c) for c in df.columns]
    df = df.toDF(*normed)
    taken = set(normed)
    rename: dict[str, str] = {}
    for canon, variants in aliases.items():
        if canon in taken:
            continue
        vset = {normalize_name(v) for v in variants}
        for col in normed:
            if col in vset and col not in rename and col not in aliases:
                rename[col] = canon
                taken.add(canon)
                break
    return (df.withColumnsRenamed(rename) if rename else df), rename


def reorder_required_first(df: DataFrame, required: list[str] = S.REQUIRED_COLUMNS) -> DataFrame:
    """Required columns first (in their order), extras after."""
    first = [c for c in required if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def missing_columns(df: DataFrame, required: list[str] = S.REQUIRED_COLUMNS) -> list[str]:
    """Required columns not present (schema-level set difference)."""
    return [c for c in required if c not in df.columns]


def required_report(df: DataFrame, required: list[str] = S.REQUIRED_COLUMNS) -> DataFrame:
    """P1 as data: (column, present, n_non_null) for every required column, one pass."""
    present = [c for c in required if c in df.columns]
    row = df.agg(*[F.count(c).alias(c) for c in present]).first() if present else {}
    spark = df.sparkSession
    rows = [(c, c in df.columns, int(row[c]) if c in present else 0) for c in required]
    return spark.createDataFrame(rows, "column string, present boolean, n_non_null bigint")


# ---- P4 / P5 / P7 / A11 ----------------------------------------------------------
def drop_all_null_rows(df: DataFrame) -> DataFrame:
    """P4."""
    return df.na.drop(how="all")


def column_profile(df: DataFrame) -> dict[str, dict]:
    """One pass: non-null count, min, max and "more than one value" flag per column.

    ``n_values`` (distinct values counting NULL as one) is only needed up to 2,
    so it is derived from min/max and null counts instead of count_distinct.
    """
    aggs = []
    for c in df.columns:
        aggs += [F.count(c).alias(f"{c}__n"), F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
    aggs.append(F.count(F.lit(1)).alias("__rows"))
    row = df.agg(*aggs).first()
    rows = row["__rows"]
    out = {}
    for c in df.columns:
        n, lo, hi = row[f"{c}__n"], row[f"{c}__min"], row[f"{c}__max"]
        distinct_non_null = 0 if n == 0 else (1 if lo == hi else 2)  # 2 means ">= 2"
        has_null = n < rows
        out[c] = {"n": n, "min": lo, "max": hi, "rows": rows,
                  "n_values_capped": min(2, distinct_non_null + (1 if has_null else 0))}
    return out


def drop_all_null_columns(df: DataFrame, profile: dict | None = None) -> tuple[DataFrame, list[str]]:
    """P5."""
    profile = profile or column_profile(df)
    dropped = [c for c in df.columns if profile[c]["n"] == 0]
    return df.drop(*dropped), dropped


def drop_constant_columns(df: DataFrame, profile: dict | None = None) -> tuple[DataFrame, list[str]]:
    """Columns with at most one distinct value (NULL counted as a value)."""
    profile = profile or column_profile(df)
    dropped = [c for c in df.columns if profile[c]["n_values_capped"] <= 1]
    return df.drop(*dropped), dropped


def drop_duplicates(df: DataFrame) -> tuple[DataFrame, int]:
    """Remove exact duplicate rows; returns (frame, number removed)."""
    before = df.count()
    out = df.dropDuplicates()
    return out, before - out.count()


# ---- P6 / P14 / P15 / P16 / X1 --------------------------------------------------
def drop_null_target(df: DataFrame, target: str) -> tuple[DataFrame, int]:
    """P6."""
    before = df.count()
    out = df.filter(F.col(target).isNotNull())
    return out, before - out.count()


def training_gate(df: DataFrame, target: str = S.TARGET, min_rows: int = 50) -> DataFrame:
    """One aggregate -> (n_rows, n_classes, ok)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_distinct(F.col(target)).alias("n_classes")) \
        .withColumn("ok", (F.col("n_rows") >= min_rows) & (F.col("n_classes") == 2))


def check_training_gate(df: DataFrame, target: str = S.TARGET, min_rows: int = 50) -> None:
    r = training_gate(df, target, min_rows).first()
    if r["n_rows"] < min_rows:
        raise ValueError(f"at least {min_rows} rows are needed, got {r['n_rows']}")
    if r["n_classes"] < 2:
        raise ValueError("both classes (approved and rejected) are needed")


def two_valued_columns(df: DataFrame) -> list[str]:
    """Columns with exactly two distinct non-null values, in column order.

    Two passes of plain aggregates (min/max, then "anything else?") instead of
    an exact count_distinct per column.
    """
    prof = column_profile(df)
    cand = [c for c in df.columns if prof[c]["n"] > 0 and prof[c]["min"] != prof[c]["max"]]
    if not cand:
        return []
    row = df.agg(*[F.count_if(F.col(c).isNotNull() & (F.col(c) != F.lit(prof[c]["min"]))
                              & (F.col(c) != F.lit(prof[c]["max"]))).alias(c) for c in cand]).first()
    return [c for c in cand if row[c] == 0]


def suggest_target(df: DataFrame) -> str | None:
    """First column with exactly two distinct non-null values."""
    two = two_valued_columns(df)
    return two[0] if two else None


def classify_columns(df: DataFrame) -> DataFrame:
    """Numeric vs categorical; numeric columns whose values are within {0,1} are binary categorical."""
    dtypes = dict(df.dtypes)
    num = [c for c in df.columns if is_numeric_type(dtypes[c])]
    row = df.agg(*[F.bool_and(F.col(c).isNull() | F.col(c).isin(0, 1)).alias(f"{c}__01") for c in num],
                 *[F.count(c).alias(f"{c}__n") for c in num]).first() if num else None
    rows = []
    for c in df.columns:
        if c in num:
            binary = bool(row[f"{c}__01"]) and row[f"{c}__n"] > 0
            rows.append((c, "categorical" if binary else "numeric", binary))
        else:
            rows.append((c, "categorical", False))
    return df.sparkSession.createDataFrame(rows, "column string, kind string, binary boolean")


# ---- F6 / F8 / F9 ---------------------------------------------------------------
def impute(df: DataFrame, numeric: list[str], categorical: list[str], notes: Notes | None = None,
           categorical_fill: str = "mode", fallback: str = "MISSING") -> tuple[DataFrame, dict, dict]:
    """numeric -> median (0.0 when all null), categorical -> mode (or a literal)."""
    med = exact_medians(df, numeric, default=0.0)
    if categorical_fill == "mode":
        mod = {c: (m if m is not None else fallback) for c, m in modes(df, categorical).items()}
    else:
        mod = {c: categorical_fill for c in categorical}
    if notes is not None:
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in numeric + categorical]).first() \
            if numeric + categorical else {}
        for c in numeric:
            if nulls[c]:
                notes.add("impute", c, f"median={med[c]}", nulls[c])
        for c in categorical:
            if nulls[c]:
                notes.add("impute", c, f"mode={mod[c]}", nulls[c])
    return df.na.fill({**med, **mod}) if (med or mod) else df, med, mod


def clean_dataset(df: DataFrame, target: str = S.TARGET) -> tuple[DataFrame, Notes]:
    """the dataset cleaner, in its fixed order.

    remap headers -> drop empty rows/columns -> drop duplicates (before any
    trimming) -> strip text, missing tokens to NULL -> numeric coercion +
    median -> target to 0/1 (cleaner dictionary), drop unreadable -> mode fill.

    Passes: one dedup shuffle written as a table with the number of copies of every row,
    and over that table the profile, the median passes and one mode aggregate.  ``df`` is
    evaluated once; the result is a lazy frame over the table.
    """
    notes = Notes()
    df, renamed = remap_columns(strip_headers(df))
    for a, b in renamed.items():
        notes.add("rename", b, a)
    columns, dtypes = df.columns, dict(df.dtypes)
    exprs = {c: missing_to_null(c) for c in columns if dtypes[c] == "string"}
    exprs.update({c: parse_double(missing_to_null(c)) if dtypes[c] == "string" else F.col(c).cast("double")
                  for c in S.NUMERIC_FEATURES if c in columns})
    if target in columns:  # decided here, filtered after the medians: one write serves every later pass
        exprs["_target"] = normalize_target(exprs.get(target, F.col(target)), "cleaner")
    t1 = cut_lineage(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__copies"))
                     .withColumn("__full", F.array(*[F.col(c).isNotNull() for c in columns])).withColumns(exprs))
    empty_row = ~F.array_contains("__full", True)
    prof = t1.agg(*[F.coalesce(F.sum(F.when(cond, F.col("__copies"))), F.lit(0)).alias(name) for name, cond in (
        ("__rows", F.lit(True)), ("__empty", empty_row), *[(c, F.col("__full")[i]) for i, c in enumerate(columns)])]).first()
    dropped = [c for c in columns if prof[c] == 0]
    if prof["__empty"]:
        notes.add("drop_empty_rows", "*", "all-null rows", prof["__empty"])
    for c in dropped:
        notes.add("drop_empty_column", c, "all null")
    n1 = prof["__rows"] - prof["__empty"]
    t1 = t1.filter(~empty_row).drop("__copies", "__full", *dropped, *(["_target"] if target in dropped else []))
    nums = [c for c in S.NUMERIC_FEATURES if c in t1.columns]
    # one pass over the checkpoint: row count and non-null counts (nulls = rows - non-null)
    c1 = t1.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(c).alias(c) for c in nums]).first()
    n2 = c1["__rows"]
    if n2 < n1:
        notes.add("drop_duplicates", "*", "exact duplicates", n1 - n2)
    med = exact_medians(t1, nums, default=0.0)
    for c in nums:
        if n2 - c1[c]:
            notes.add("median_fill", c, f"{med[c]:g}", n2 - c1[c])
    t2 = t1.na.fill({c: v for c, v in med.items() if v is not None}) if nums else t1
    if target in t2.columns:
        t2 = t2.filter(F.col("_target").isNotNull()).withColumn(target, F.col("_target")).drop("_target")
    cats = [c for c in S.CATEGORICAL_FEATURES if c in t2.columns]
    c2 = t2.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(c).alias(c) for c in cats]).first()
    if target in t2.columns and n2 - c2["__rows"]:
        notes.add("target_unreadable", target, "dropped", n2 - c2["__rows"])
    missing_cats = [c for c in cats if c2["__rows"] - c2[c]]
    mod = modes(t2, missing_cats)
    fillc = {}
    for c in missing_cats:
        fillc[c] = mod[c] if mod[c] is not None else "Desconocido"
        notes.add("mode_fill", c, fillc[c], c2["__rows"] - c2[c])
    out = t2.na.fill(fillc) if fillc else t2
    return reorder_required_first(out), notes


def prepare_production(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """F8: production retrain preparation.

    schema check -> target (production dictionary) -> drop unreadable ->
    both-classes gate -> numeric coercion + median -> missing categories "NA".
    """
    missing = missing_columns(df)
    if missing:
        raise ValueError("missing required columns: " + ", ".join(sorted(missing)))
    df = df.select(*(extra or []), *S.REQUIRED_COLUMNS).withColumn(S.TARGET, normalize_target(S.TARGET, "production")) \
        .filter(F.col(S.TARGET).isNotNull())
    # read by the gate, the medians and the result: computed once
    df = cut_lineage(df.withColumns({c: parse_double(F.col(c).cast("string")) for c in S.NUMERIC_FEATURES}), "production")
    gate = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(S.TARGET) == 1).alias("pos")).first()
    if gate["n"] == 0:
        raise ValueError("the target column could not be read (use 1/0, Si/No or Aprobado/Rechazado)")
    if gate["pos"] in (0, gate["n"]):
        raise ValueError("the dataset needs approved AND rejected cases")
    med = exact_medians(df, S.NUMERIC_FEATURES, default=None)
    fill = {c: v for c, v in med.items() if v is not None}
    df = df.na.fill(fill) if fill else df
    return df.withColumns({c: F.coalesce(missing_to_null(c), F.lit("NA")) for c in S.CATEGORICAL_FEATURES})
