"""Where query modules register: name -> (function, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from lineagelake.functions.mathx import NDTRI_A, NDTRI_B, NDTRI_BREAK, NDTRI_C, NDTRI_D

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def phi_sql(x: str) -> str:
    """The normal distribution function in SQL, by its series x + x^3/3 + x^5/15 + ...; good for |x| up to 8."""
    term = f"pow({x}, 2 * n + 1) * exp(n * ln(2) + lgamma(n + 1) - lgamma(2 * n + 2))"
    return f"(0.5 + exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum([{term} for n in range(0, 150)]))"


def _double(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _poly(x: str, coefficients: tuple) -> str:
    out = _double(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * ({x}) + {_double(c)})"
    return out


def ndtri_sql(p: str) -> str:
    """The inverse of the normal distribution function in SQL, by the rational approximation of mathx."""
    q, low, high = f"({p} - 0.5)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    central = f"{q} * {_poly(f'{q} * {q}', NDTRI_A)} / {_poly(f'{q} * {q}', NDTRI_B)}"
    return f"CASE WHEN {p} < {_double(NDTRI_BREAK)} THEN {_poly(low, NDTRI_C)} / {_poly(low, NDTRI_D)} WHEN {p} <= {_double(1 - NDTRI_BREAK)} THEN {central} ELSE -{_poly(high, NDTRI_C)} / {_poly(high, NDTRI_D)} END"
