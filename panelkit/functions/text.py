"""String cleaning expressions.

pandas semantics kept on purpose:
* ``str.strip()`` removes all surrounding whitespace, tabs included; Spark's
  ``trim`` only removes spaces, so a regex is used.
* ``pd.to_numeric(errors="coerce")`` turns junk into missing; with ANSI mode
  on, ``cast`` raises, so ``try_cast`` is used, via double so '2000.0' works.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Trim every kind of leading/trailing whitespace (tab, newline, ...)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def norm_key(c) -> Column:
    """Join key for name harmonisation: stripped and lower-cased."""
    return F.lower(strip_ws(c))


def sentinel_to_null(c, sentinels=("unknown", "")) -> Column:
    """Map sentinel text (case-insensitive, after stripping) to NULL."""
    v = strip_ws(c)
    return F.when(F.lower(v).isin(*sentinels), F.lit(None).cast("string")).otherwise(v)


def coerce_double(c) -> Column:
    """Numeric coerce: text that is no plain number becomes NULL instead of an
    error. ``NaN`` is missing, and Java's type suffixes (``12d``) are no numbers."""
    text = _c(c).cast("string")
    number = text.rlike(r"(?i)^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf(?:inity)?)\s*$")
    return F.when(number, text.try_cast("double"))


def coerce_long(c) -> Column:
    """Integer coerce through double ('2000.0' -> 2000, 'x12' -> NULL)."""
    return coerce_double(c).try_cast("bigint")


def is_entity_code(c, exclude_prefix: str = "OWID_") -> Column:
    """True for a three-letter upper-case code that is not an aggregate code."""
    v = strip_ws(c)
    return F.coalesce(v.rlike(r"^[A-Z]{3}$") & ~v.startswith(exclude_prefix), F.lit(False))


def starts_with(c, prefix: str) -> Column:
    return F.coalesce(_c(c).startswith(prefix), F.lit(False))


def cut(c, n: int = 240) -> Column:
    """Strip then keep the first ``n`` characters (report field width)."""
    return F.substring(strip_ws(c), 1, n)
