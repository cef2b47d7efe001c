"""Baseline hazards: log h0(t), H0(t) and the inverse of H0, as column expressions where a closed form exists."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineagelake.functions.mathx import ndtri, norm_sf

NEVER, EARLIEST = 1e6, 1e-10

#: The parameters of each baseline.
BASELINES = {
    "weibull": ("scale", "rho"), "exponential": ("rate",), "gompertz": ("rate", "gamma"), "lognormal": ("mu", "sigma"),
    "loglogistic": ("scale", "shape"), "gamma": ("shape", "scale"), "first_passage": ("drift", "shape"),
}


def check(name: str, params: dict) -> None:
    if name not in BASELINES:
        raise ValueError(f"unknown baseline hazard {name!r}; known: {sorted(BASELINES)}")
    missing = [p for p in BASELINES[name] if p not in params]
    if missing:
        raise ValueError(f"baseline {name} needs {missing}")


def terms(name: str, t: Column, **p: float) -> tuple[Column, Column]:
    """(log h0, H0) at t > 0."""
    check(name, p)
    if name == "weibull":
        s, k = p["scale"], p["rho"]
        return F.log(F.lit(k / s)) + (k - 1) * F.log(t / s), F.pow(t / s, F.lit(k))
    if name == "exponential":
        return F.lit(math.log(p["rate"])) + 0 * t, p["rate"] * t
    if name == "gompertz":
        b, g = p["rate"], p["gamma"]
        return math.log(b) + g * t, b * t if abs(g) < 1e-12 else F.lit(b / g) * F.expm1(g * t)
    if name == "lognormal":
        z = (F.log(t) - p["mu"]) / p["sigma"]
        log_sf = F.log(norm_sf(z))
        return -0.5 * z * z - F.lit(math.log(p["sigma"] * math.sqrt(2 * math.pi))) - F.log(t) - log_sf, -log_sf
    if name == "loglogistic":
        u = p["shape"] * F.log(t / p["scale"])
        big = F.when(u > 30, u).otherwise(F.log1p(F.exp(F.least(u, F.lit(30.0)))))  # log(1 + e^u)
        return F.lit(math.log(p["shape"])) - F.log(t) + u - big, big
    if name == "gamma":
        out = _gamma_terms(F.lit(p["shape"]), t / p["scale"])
        return out["log_h"] - math.log(p["scale"]), out["cum"]
    d, lam = p["drift"], p["shape"]  # first passage of sqrt(lam) by a Brownian motion of drift -d towards 0
    y0 = math.sqrt(lam)
    a, b = (F.lit(y0) - d * t) / F.sqrt(t), (F.lit(-y0) - d * t) / F.sqrt(t)
    sf = F.greatest(F.lit(1e-300), norm_sf(-a) - F.exp(F.lit(2 * y0 * d)) * norm_sf(-b))
    log_pdf = F.lit(math.log(y0 / math.sqrt(2 * math.pi))) - 1.5 * F.log(t) - F.pow(F.lit(y0) - d * t, 2) / (2 * t)
    return log_pdf - F.log(sf), -F.log(sf)


def _clamped(t: Column) -> Column:
    return F.least(F.lit(NEVER), F.greatest(F.lit(EARLIEST), t))


def invert(name: str, h: Column, **p: float) -> Column:
    """The age t at which H0(t) = h; all but the Weibull are held within [EARLIEST, NEVER]."""
    check(name, p)
    if name == "weibull":
        return p["scale"] * F.exp(F.log(h) / p["rho"])
    if name == "exponential":
        return _clamped(h / p["rate"])
    if name == "gompertz":
        b, g = p["rate"], p["gamma"]
        if abs(g) < 1e-12:
            return _clamped(h / b)
        inside = h * (g / b)
        return F.when(inside <= -1, NEVER).otherwise(_clamped(F.log1p(F.when(inside > -1, inside)) / g))
    if name == "lognormal":
        surv = F.exp(-h)
        return F.when(surv <= 0, NEVER).otherwise(_clamped(F.exp(p["mu"] - p["sigma"] * ndtri(F.greatest(F.lit(1e-300), F.least(surv, F.lit(1 - 1e-16)))))))
    if name == "loglogistic":
        return _clamped(p["scale"] * F.exp(F.log(F.expm1(F.least(h, F.lit(700.0)))) / p["shape"]))
    if name == "gamma":
        return _clamped(_gamma_isf(F.lit(p["shape"]), h) * p["scale"])
    raise ValueError("first passage times are drawn, not inverted")


def _log_upper_gamma(a: float, x: np.ndarray) -> np.ndarray:
    """log of the regularised upper incomplete gamma function: series below a + 1, continued fraction above.

    Each is worked out where it holds, and goes on until no value changes any more.
    """
    x = np.maximum(x, 1e-300)
    out, low = np.empty_like(x), x < a + 1
    v = x[low]
    term, total = np.full_like(v, 1 / a), np.full_like(v, 1 / a)
    for n in range(1, 400):
        term = term * v / (a + n)
        before, total = total, total + term
        if (total == before).all():
            break
    lower = np.exp(np.minimum(a * np.log(v) - v - math.lgamma(a) + np.log(np.maximum(total, 1e-300)), 0))
    out[low] = np.log1p(-np.minimum(lower, 1 - 1e-16))
    v = x[~low]
    b = v + 1 - a
    c = np.full_like(v, 1e300)
    d = 1 / np.where(np.abs(b) < 1e-300, 1e-300, b)
    h = d.copy()
    for i in range(1, 300):
        an = -i * (i - a)
        b = b + 2
        d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
        c = b + an / c
        step = d * np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * step
        if (np.abs(step - 1) < 1e-15).all():
            break
    out[~low] = a * np.log(v) - v - math.lgamma(a) + np.log(np.maximum(np.abs(h), 1e-300))
    return out


@F.pandas_udf(T.StructType().add("log_h", T.DoubleType()).add("cum", T.DoubleType()))
def _gamma_terms(shape: pd.Series, x: pd.Series) -> pd.DataFrame:
    a, v = float(shape.iloc[0]), x.to_numpy(float)
    log_sf = _log_upper_gamma(a, v)
    return pd.DataFrame({"log_h": (a - 1) * np.log(v) - v - math.lgamma(a) - log_sf, "cum": -log_sf})


def gamma_isf(a: float, h: np.ndarray) -> np.ndarray:
    """x with upper tail exp(-h): Newton's steps on the logarithm of x within a bracket, halved where a step leaves it.

    Values that don't move any more are left out of further rounds.
    """
    goal, out = -np.asarray(h, float), np.full(len(h), math.exp(-60.0))  # for a missing h
    at = np.flatnonzero(~np.isnan(goal))
    lo, hi, u = np.full(len(at), -60.0), np.full(len(at), 20.0), np.full(len(at), math.log(a))
    for _ in range(200):
        if not len(at):
            break
        x = np.exp(u)
        log_sf = _log_upper_gamma(a, x)
        above = log_sf > goal[at]
        lo, hi = np.where(above, u, lo), np.where(above, hi, u)
        slope = -np.exp(np.minimum(a * u - x - math.lgamma(a) - log_sf, 700))  # of log_sf over u
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            new = u - (log_sf - goal[at]) / slope
        new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        still = (np.abs(new - u) > 1e-14 * np.maximum(1, np.abs(u))) & (hi - lo > 1e-15)
        out[at] = np.exp(new)
        at, lo, hi, u = at[still], lo[still], hi[still], new[still]
    return out


@F.pandas_udf(T.DoubleType())
def _gamma_isf(shape: pd.Series, h: pd.Series) -> pd.Series:
    return pd.Series(gamma_isf(float(shape.iloc[0]), h.to_numpy(float)))
