"""Numeric column helpers. Missing is always NULL; nothing here raises under ANSI mode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

INF = float("inf")


def clip(col: Column, lo: float, hi: float) -> Column:
    """Bound to [lo, hi]. NULL stays NULL (bare least/greatest would skip it)."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(float(lo))), F.lit(float(hi))))


def nonzero(col: Column) -> Column:
    """0 becomes NULL, for denominators that must not be zero."""
    return F.when(col != 0, col)


def ieee_divide(num: Column, den: Column) -> Column:
    """Float division: x/0 is signed infinity and 0/0 is missing, as in a numeric array library."""
    return (
        F.when(den != 0, num / den)
        .when((den == 0) & (num > 0), F.lit(INF))
        .when((den == 0) & (num < 0), F.lit(-INF))
    )


def ieee_ln(col: Column) -> Column:
    """Natural log with ln(0) = -infinity; negative input is missing."""
    return F.when(col > 0, F.ln(col)).when(col == 0, F.lit(-INF))


def array_round(col: Column, digits: int) -> Column:
    """Rounding as numeric array libraries do it: scale, nearest integer (ties to even), scale back."""
    unit = float(10 ** digits)
    return F.rint(col * unit) / unit


def rolling(agg: Callable[[Column], Column], col: Column, n: int, window: WindowSpec) -> Column:
    """``agg`` over the last n rows; NULL unless all n values are present."""
    frame = window.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col).over(frame) == n, agg(col).over(frame))
