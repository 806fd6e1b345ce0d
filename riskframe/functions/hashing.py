"""Deterministic per-row uniform numbers.

``unit_hash(id, salt)`` reads the first 8 hex digits of ``md5(id || '|' || salt)``
as an unsigned 32-bit number and divides by 2**32.  It is a pure column
expression (no RNG state, no shuffle), so it gives the same value for a row on
every executor, after every retry and in DuckDB (``UNIT_HASH_SQL``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def unit_hash(col: Column | str, salt: str | int = 42) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    digest = F.md5(F.concat(c.cast("string"), F.lit(f"|{salt}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)


def unit_hash_sql(expr: str, salt: str | int = 42) -> str:
    """DuckDB twin of :func:`unit_hash`."""
    return (f"(('0x'||substr(md5(CAST({expr} AS VARCHAR)||'|{salt}'),1,8))"
            f"::UBIGINT::DOUBLE/4294967296.0)")
