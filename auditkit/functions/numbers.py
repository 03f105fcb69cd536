"""Rounding, class weights and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct(part: Column, whole: Column, places: int = 4) -> Column:
    """Percentage at ``places`` decimals; null over an empty whole."""
    return F.round(F.try_divide(part * 100.0, whole), places)


def r6(value: Column) -> Column:
    return F.round(value, 6)


def class_ratio(label: Column) -> Column:
    """Negatives per positive; null without positives."""
    return F.try_divide(F.sum(1 - label).cast("double"), F.sum(label).cast("double"))


def ratio_or_zero(part: Column, whole: Column) -> Column:
    """A ratio that is 0 where its denominator is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.try_divide(part.cast("double"), whole.cast("double")))


def guarded_corr(a: Column, b: Column) -> Column:
    """Pearson correlation that is null, not an error, when a side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def null_if_nan(value: Column) -> Column:
    return F.when(F.isnan(value), None).otherwise(value)
