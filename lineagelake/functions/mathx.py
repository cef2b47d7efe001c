"""Scalar functions that Spark lacks, as column expressions that stay in generated code."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Acklam's rational approximation of the inverse normal distribution (central and tail, numerators and
# denominators, highest power first) and its break-point.
NDTRI_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
NDTRI_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
NDTRI_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
NDTRI_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
NDTRI_BREAK = 0.02425

# Chebyshev coefficients of erfc(z) * exp(z^2) in t = 2 / (2 + z), z >= 0 (fractional error below 1.2e-7
# would need 10; these 28 reach double precision).
ERFC_C = (
    -1.3026537197817094, 6.4196979235649026e-1, 1.9476473204185836e-2, -9.561514786808631e-3, -9.46595344482036e-4, 3.66839497852761e-4,
    4.2523324806907e-5, -2.0278578112534e-5, -1.624290004647e-6, 1.303655835580e-6, 1.5626441722e-8, -8.5238095915e-8, 6.529054439e-9,
    5.059343495e-9, -9.91364156e-10, -2.27365122e-10, 9.6467911e-11, 2.394038e-12, -6.886027e-12, 8.94487e-13, 3.13092e-13, -1.12708e-13,
    3.81e-16, 7.106e-15, -1.523e-15, -9.4e-17, 1.21e-16, -2.8e-17,
)


def polynomial(x: Column, coefficients: tuple) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def ndtri(p: Column) -> Column:
    """Inverse of the normal distribution function; null outside (0, 1)."""
    q = p - F.lit(0.5)
    central = q * polynomial(q * q, NDTRI_A) / polynomial(q * q, NDTRI_B)
    low, high = F.sqrt(-2.0 * F.log(p)), F.sqrt(-2.0 * F.log(1.0 - p))
    tail_low = polynomial(low, NDTRI_C) / polynomial(low, NDTRI_D)
    tail_high = -polynomial(high, NDTRI_C) / polynomial(high, NDTRI_D)
    return F.when((p > 0) & (p < NDTRI_BREAK), tail_low).when((p >= NDTRI_BREAK) & (p <= 1 - NDTRI_BREAK), central).when((p > 1 - NDTRI_BREAK) & (p < 1), tail_high)


def liability_scale(k: Column) -> Column:
    """k (1 - k) / z^2, from the observed to the liability scale at prevalence k; null unless 0 < k < 1."""
    z = F.exp(-F.pow(ndtri(k), F.lit(2)) / 2) / F.lit((2 * math.pi) ** 0.5)
    return F.when((k > 0) & (k < 1), k * (1 - k) / (z * z))


def erfc(x: Column) -> Column:
    """Complementary error function by Clenshaw's recurrence on a Chebyshev series."""
    z = F.abs(x)
    t = F.lit(2.0) / (F.lit(2.0) + z)
    ty = F.lit(4.0) * t - 2.0
    # the recurrence runs over an array of coefficients, so that the expression stays small
    steps = F.array(*[F.lit(c) for c in reversed(ERFC_C[1:])])
    state = F.aggregate(steps, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("dd")), lambda s, c: F.struct((ty * s.d - s.dd + c).alias("d"), s.d.alias("dd")))
    value = t * F.exp(-z * z + F.lit(0.5) * (F.lit(ERFC_C[0]) + ty * state.d) - state.dd)
    return F.when(x >= 0, value).otherwise(F.lit(2.0) - value)


def norm_cdf(x: Column) -> Column:
    return F.lit(0.5) * erfc(-x / F.lit(math.sqrt(2)))


def norm_sf(x: Column) -> Column:
    return F.lit(0.5) * erfc(x / F.lit(math.sqrt(2)))


def norm_pdf(x: Column) -> Column:
    return F.exp(F.lit(-0.5) * x * x) / F.lit(math.sqrt(2 * math.pi))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate; null where either has no variance (corr itself raises under ANSI rules)."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.when(F.stddev_pop(x) * F.stddev_pop(y) > 1e-20, F.stddev_pop(x) * F.stddev_pop(y)))


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation by the normal approximation of t."""
    t = F.abs(r) * F.sqrt((n - 2) / F.greatest(F.lit(1e-30), 1 - r * r))
    z = t * (F.lit(1.0) - F.lit(1.0) / (F.lit(4.0) * (n - 2)))
    return F.when((n <= 2) | (1 - r * r < 1e-30), 0.0).otherwise(F.lit(2.0) * norm_sf(z))


def dempster_lerner(k: float) -> float:
    """Factor from the observed to the liability scale."""
    from statistics import NormalDist

    k = min(max(k, 1e-3), 1 - 1e-3)
    return k * (1 - k) / NormalDist().pdf(NormalDist().inv_cdf(1 - k)) ** 2
