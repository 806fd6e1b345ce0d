"""DuckDB text of the column expressions, for oracle SQL only."""

from __future__ import annotations

from riskframe import schema as S
from riskframe.functions.text import NUMBER_PATTERN
from riskframe.sources.fixtures import DIRTY_HEADERS


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def missing(x: str) -> str:
    s = strip(x)
    return f"(CASE WHEN {s} IN ('', 'nan', 'NaN', 'None') THEN NULL ELSE {s} END)"


def parse(x: str) -> str:
    s = strip(x)
    return f"(CASE WHEN regexp_matches({s}, '{NUMBER_PATTERN}') THEN TRY_CAST({s} AS DOUBLE) END)"


def norm(x: str) -> str:
    s = f"regexp_replace(CAST({x} AS VARCHAR), '[\ufeff\u200b]', '', 'g')"
    s = f"lower({strip(s)})"
    s = f"regexp_replace({s}, '\\s+', '_', 'g')"
    return f"translate({s}, 'áéíóú', 'aeiou')"


def target(x: str, dictionary: str) -> str:
    key = norm(x) if dictionary == "cleaner" else f"lower({strip(f'CAST({x} AS VARCHAR)')})"
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.TARGET_DICTIONARIES[dictionary].items())
    num = parse(key)
    return (f"(CASE WHEN {x} IS NULL THEN NULL ELSE coalesce(CASE {key} {whens} END, "
            f"CASE WHEN {num} >= 0.5 THEN 1 WHEN {num} IS NOT NULL THEN 0 END) END)::INTEGER")


def dirty_canon_select(source: str = "dirty") -> str:
    """The dirty fixture with canonical column names (P2 applied), 'notas' kept."""
    cols = ["id"] + [f"{q(DIRTY_HEADERS[c])} AS {c}" for c in S.REQUIRED_COLUMNS] + ["notas", "pais"]
    return f"SELECT {', '.join(cols)} FROM {source}"
