"""Tetrachoric correlation of 2x2 counts: maximum likelihood under a bivariate normal. Runs on grouped counts only."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NORMAL = NormalDist()
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(20)


def bvn_upper(h: float, k: float, r: float) -> float:
    """P(X > h, Y > k): the product of margins plus the integral of the density over the correlation from 0 to r."""
    base = (1 - _NORMAL.cdf(h)) * (1 - _NORMAL.cdf(k))
    if r == 0:
        return base
    theta = 0.5 * math.asin(r) * (_NODES + 1)  # r = sin(theta) takes the singularity at 1 away
    f = np.exp(-(h * h - 2 * h * k * np.sin(theta) + k * k) / (2 * np.cos(theta) ** 2))
    return base + 0.5 * math.asin(r) * float(_WEIGHTS @ f) / (2 * math.pi)


def fit(n11: float, n10: float, n01: float, n00: float) -> tuple[float, float]:
    """(r, standard error); NaN if either margin is empty. Bisection on (-0.999, 0.999);
    an empty cell gives its end and no error."""
    n = n11 + n10 + n01 + n00
    if n <= 0 or not 0 < n11 + n10 < n or not 0 < n11 + n01 < n:
        return math.nan, math.nan
    p1, p2 = (n11 + n10) / n, (n11 + n01) / n
    h, k = _NORMAL.inv_cdf(1 - p1), _NORMAL.inv_cdf(1 - p2)

    if not (n11 and n00 and n10 and n01):  # an empty cell: the end of the range, without an error
        return (-0.999 if not (n11 and n00) else 0.999), math.nan
    # with the margins' thresholds the likelihood is greatest where the model's P11, which grows with r, is the observed one
    lo, hi, goal = -0.999, 0.999, n11 / n
    while hi - lo > 1e-12:
        r = (lo + hi) / 2
        lo, hi = (r, hi) if bvn_upper(h, k, r) < goal else (lo, r)
    r = (lo + hi) / 2
    p11 = bvn_upper(h, k, r)
    density = math.exp(-(h * h - 2 * r * h * k + k * k) / (2 * (1 - r * r))) / (2 * math.pi * math.sqrt(1 - r * r))
    info = n * density**2 * sum(1 / max(p, 1e-12) for p in (p11, p1 - p11, p2 - p11, 1 - p1 - p2 + p11))
    return r, 1 / math.sqrt(info) if info > 1e-4 else math.nan


@F.pandas_udf(T.StructType().add("r", T.DoubleType()).add("se", T.DoubleType()))
def _fit_rows(n11: pd.Series, n10: pd.Series, n01: pd.Series, n00: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fit(*map(float, c)) for c in zip(n11, n10, n01, n00)], columns=["r", "se"])


def tetrachoric(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Struct (r, se) of each row of counts."""
    return _fit_rows(n11, n10, n01, n00)
