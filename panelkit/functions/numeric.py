"""Numeric expressions: ordinal levels, scores, tiers, safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the ordinal intensity levels 1..9; 0 is its own
# level (exactly zero) and anything above the last bound is level 10.
LEVEL_BOUNDS = (10, 25, 50, 100, 250, 500, 1000, 2500, 5000)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ordinal_bucket(c, bounds=LEVEL_BOUNDS) -> Column:
    """0 for exactly 0, then level i for value <= bounds[i-1], last level
    above the top bound. Negative values fall in level 1; NULL stays NULL."""
    x = _c(c)
    expr = F.when(x == 0, F.lit(0))
    for i, b in enumerate(bounds, start=1):
        expr = expr.when(x <= b, F.lit(i))
    return F.when(x.isNull(), F.lit(None)).otherwise(expr.otherwise(F.lit(len(bounds) + 1))).cast("long")


def weighted_score(count, severity, w: float = 0.5) -> Column:
    """Risk score = count + w * severity."""
    return _c(count) + F.lit(w) * _c(severity)


def tier(value, lo_cut, hi_cut, labels=("LOW", "MEDIUM", "HIGH")) -> Column:
    """Three-way tier; a missing value counts as 0 (lookup default)."""
    v = F.coalesce(_c(value), F.lit(0.0))
    return (F.when(v >= _c(hi_cut), F.lit(labels[2]))
            .when(v >= _c(lo_cut), F.lit(labels[1]))
            .otherwise(F.lit(labels[0])))


def safe_div(a, b) -> Column:
    """x/0 -> NULL (never inf, never an ANSI error)."""
    return F.try_divide(_c(a), _c(b))


def log1p_target(c) -> Column:
    """log1p of a non-negative target (negatives clipped to 0 first)."""
    return F.log1p(F.greatest(_c(c), F.lit(0.0)))


def expm1_inverse(c, upper=None) -> Column:
    """Back-transform a log1p prediction, clipped to [0, upper] on the log
    scale when an upper bound (log1p of the largest training target) is given."""
    x = _c(c)
    if upper is not None:
        x = F.least(x, _c(upper) if not isinstance(upper, (int, float)) else F.lit(float(upper)))
    return F.greatest(F.expm1(x), F.lit(0.0))


def clip(c, lo=None, hi=None) -> Column:
    x = _c(c)
    if lo is not None:
        x = F.greatest(x, F.lit(lo) if isinstance(lo, (int, float)) else lo)
    if hi is not None:
        x = F.least(x, F.lit(hi) if isinstance(hi, (int, float)) else hi)
    return x


def inf_to_null(c) -> Column:
    x = _c(c)
    return F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")), F.lit(None)).otherwise(x)


def flag(cond: Column) -> Column:
    """Boolean condition as 0/1 long; a NULL comparison counts as false."""
    return F.coalesce(cond, F.lit(False)).cast("long")


def rnd(c, places: int = 6) -> Column:
    """Round doubles for order-free comparisons (sum order changes last bits)."""
    return F.round(_c(c).cast("double"), places)
