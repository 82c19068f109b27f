"""Column -> Column functions that compare a predicted figure with the true one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerances, and the ratios of figures copied at another scale.
EXACT_TOL, CLOSE_TOL, SCALE_TOL = 1e-9, 0.01, 1e-6
SCALE_RATIOS = (1e3, 1e6, 1e9, 1e-3, 1e-6, 1e-9)


def number_or_null(c: Column) -> Column:
    """As a double; null if it is no number or NaN."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def relative_error(gold: Column, pred: Column) -> Column:
    return F.when(gold == 0, F.abs(pred)).otherwise(F.try_divide(F.abs(pred - gold), F.abs(gold)))


def is_scale_error(gold: Column, pred: Column) -> Column:
    """Whether pred is gold at another reporting scale; false for zeros and for another sign."""
    ratio = F.try_divide(F.abs(gold), F.abs(pred))
    near = F.exists(F.array(*[F.lit(r) for r in SCALE_RATIOS]), lambda r: F.abs(ratio - r) <= SCALE_TOL * F.greatest(ratio, r))
    return (gold != 0) & (pred != 0) & ((gold < 0) == (pred < 0)) & F.coalesce(near, F.lit(False))


def verdict(gold: Column, pred: Column) -> Column:
    """exact, close, scale_error, wrong, missing, spurious or not_scored; a NaN prediction is wrong."""
    rel = relative_error(gold, pred)
    return (
        F.when(gold.isNull() & pred.isNull(), "not_scored")
        .when(gold.isNull(), "spurious")
        .when(pred.isNull(), "missing")
        .when(F.isnan(pred), "wrong")
        .when(rel <= EXACT_TOL, "exact")
        .when(rel <= CLOSE_TOL, "close")
        .when(is_scale_error(gold, pred), "scale_error")
        .otherwise("wrong")
    )


def is_scorable(v: Column) -> Column:
    return ~v.isin("not_scored", "spurious")


def is_hit(v: Column) -> Column:
    return v.isin("exact", "close")


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def f1(tp: Column, n_pred: Column, n_gold: Column) -> Column:
    """F1 in which each ratio with nothing below the line is 0."""
    p, r = F.coalesce(ratio(tp, n_pred), F.lit(0.0)), F.coalesce(ratio(tp, n_gold), F.lit(0.0))
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def round_exact(c: Column, digits: int) -> Column:
    """Rounded as the exact binary value says, halves to even."""
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit("")).cast("double")
