"""String expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe.schema import MISSING_TOKENS

# A number is only a number when it looks like one: no '1d', no 'inf', no 'nan'.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"

_ACCENTED = "áéíóú"
_PLAIN = "aeiou"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_blanks(col: Column | str) -> Column:
    """Strip all leading/trailing whitespace (``trim`` alone removes spaces only): what ``\\s`` stands for, without its cost."""
    return F.btrim(_c(col), F.lit(" \t\n\x0b\f\r"))


def normalize_text(col: Column | str) -> Column:
    """Drop BOM and zero-width space, strip, lower, blank runs -> '_', á é í ó ú -> a e i o u."""
    s = F.regexp_replace(_c(col).cast("string"), "[\ufeff\u200b]", "")
    s = F.lower(strip_blanks(s))
    s = F.regexp_replace(s, r"\s+", "_")
    return F.translate(s, _ACCENTED, _PLAIN)


def normalize_name(name: str) -> str:
    """Driver-side twin of :func:`normalize_text` for column headers (metadata, not data)."""
    shown = "".join(ch for ch in str(name) if ch not in "\ufeff\u200b").lower()
    return "_".join(shown.split()).translate(dict(zip(map(ord, _ACCENTED), _PLAIN)))


def missing_to_null(col: Column | str) -> Column:
    """E8: '' / nan / NaN / None (after strip) -> NULL, other text stripped.

    Written so the input is referenced once (no expression blow-up when
    several of these functions are nested and Catalyst collapses projections).
    """
    s = strip_blanks(_c(col).cast("string"))
    tokens = "|".join(re.escape(t) for t in MISSING_TOKENS if t)
    return F.nullif(F.regexp_replace(s, f"^({tokens})$", ""), F.lit(""))


def parse_double(col: Column | str) -> Column:
    """Text -> DOUBLE, anything that is not a plain decimal number -> NULL (never NaN)."""
    s = strip_blanks(_c(col).cast("string"))
    return F.regexp_extract(s, NUMBER_PATTERN, 0).try_cast("double")


def fill_missing_category(col: Column | str, fill: str = "NA") -> Column:
    """Missing tokens and NULL -> a literal category."""
    return F.coalesce(missing_to_null(col), F.lit(fill))


def clamp(col: Column | str, lo, hi) -> Column:
    """``max(lo, min(x, hi))``."""
    return F.greatest(F.lit(lo), F.least(_c(col), F.lit(hi)))


def clean_user_name(col: Column | str) -> Column:
    """Trim and cut to 40 characters."""
    return F.substring(F.trim(_c(col)), 1, 40)


def clean_email(col: Column | str) -> Column:
    """Trim, lower case, cut to 120 characters."""
    return F.substring(F.lower(F.trim(_c(col))), 1, 120)


def email_is_valid(col: Column | str) -> Column:
    return _c(col).rlike(EMAIL_PATTERN)
