"""Target and binary-text normalisation.

One parametrised expression replaces the four dictionaries of the source
product: ``normalize_target(col, "production" | "cleaner" | "report" | "lab")``.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.text import normalize_text, parse_double, strip_blanks
from riskframe.schema import TARGET_DICTIONARIES


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dictionary_map(name: str) -> Column:
    d = TARGET_DICTIONARIES[name]
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


def target_key(col: Column | str, dictionary: str) -> Column:
    s = _c(col).cast("string")
    if dictionary == "cleaner":
        return normalize_text(s)
    return F.lower(strip_blanks(s))


def normalize_target(col: Column | str, dictionary: str = "production", numeric_fallback: bool = True) -> Column:
    """Token lookup, else ``number >= 0.5``, else NULL.  Result INT."""
    key = target_key(col, dictionary)
    looked_up = F.try_element_at(dictionary_map(dictionary), key)
    if not numeric_fallback:
        return looked_up.cast("int")
    # NULL >= 0.5 is NULL, so unreadable text stays NULL
    return F.coalesce(looked_up, (parse_double(key) >= 0.5).cast("int")).cast("int")


def binary_text_value(col: Column | str) -> Column:
    """Lab token lookup: 1/0 or NULL when the token is not a boolean word."""
    return F.try_element_at(dictionary_map("lab"), F.lower(strip_blanks(_c(col).cast("string")))).cast("double")


def normalize_binary_columns(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """All-or-nothing per column.

    A string column becomes DOUBLE 0/1 only when every non-null value is a
    boolean word and at least one value is present; otherwise it is left as it
    is.  One aggregate pass decides for all columns together.
    """
    if not columns:
        return df, []
    checks = []
    for c in columns:
        mapped = binary_text_value(c)
        checks.append(F.bool_and(F.col(c).isNull() | mapped.isNotNull()).alias(f"{c}__all"))
        checks.append(F.count(F.col(c)).alias(f"{c}__n"))
    row = df.agg(*checks).first()
    converted = [c for c in columns if row[f"{c}__all"] and row[f"{c}__n"] > 0]
    if not converted:
        return df, []
    return df.withColumns({c: binary_text_value(c) for c in converted}), converted


def relabel_two_classes(df: DataFrame, col: str) -> tuple[DataFrame, dict]:
    """Map a two-valued target to 0/1, smaller value -> 0.  Raises otherwise."""
    row = df.agg(F.count_distinct(col).alias("k"), F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    if row["k"] != 2:
        raise ValueError(f"target '{col}' must have exactly 2 classes, found {row['k']}")
    mapping = {row["lo"]: 0, row["hi"]: 1}
    return df.withColumn(col, F.when(F.col(col) == F.lit(row["hi"]), 1)
                         .when(F.col(col) == F.lit(row["lo"]), 0).cast("int")), mapping
