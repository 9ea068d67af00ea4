"""Moment corrections and bounded statistics expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(value: Column) -> Column:
    """Bias-corrected skewness; NULL below three values."""
    n = F.count(value).cast("double")
    corrected = F.skewness(value) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n >= 3, corrected)


def sample_kurtosis(value: Column) -> Column:
    """Bias-corrected excess kurtosis; NULL below four values."""
    n = F.count(value).cast("double")
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n >= 4, scale * ((n + 1) * F.kurtosis(value) + 6))


def pearson(x: str, y: str) -> Column:
    """Correlation of complete pairs; NULL, not an error, where one of them has no spread."""
    spread = F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x))
    return F.regr_sxy(y, x) / F.nullif(spread, F.lit(0.0))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def smoothed_share(count: Column, total: Column, labels: Column) -> Column:
    """Share after adding 1e-6 to every count."""
    return (count + 1e-6) / (total + labels * 1e-6)


def psi_term(reference: Column, current: Column) -> Column:
    return (current - reference) * F.log(current / reference)


def js_term(reference: Column, current: Column) -> Column:
    middle = (reference + current) / 2
    return (reference * F.log(reference / middle) + current * F.log(current / middle)) / 2
