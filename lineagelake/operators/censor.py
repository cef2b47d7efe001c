"""Observation: age windows by generation and censoring by death."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineagelake.functions import rng
from lineagelake.operators.schema import CENSORED, PHENOTYPE, stage


def age_censor(t: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """(age within the window, whether the onset is outside it)."""
    return F.least(F.greatest(t, lo), hi), (t < lo) | (t > hi)


def death_age(scale: float, rho: float, seed: int = rng.DEFAULT_SEED, key: str = "id") -> Column:
    """Weibull age at death; one for both traits."""
    return F.lit(float(scale)) * F.pow(rng.exponential("death", F.col(key), seed=seed), F.lit(1.0 / rho))


def window_table(people: DataFrame, windows: dict[int, tuple[float, float]], censor_age: float) -> tuple[Column, Column]:
    """A window's ends as expressions of generation: few literals, so no join is needed."""
    lo, hi = F.lit(0.0), F.lit(float(censor_age))
    for g, (a, b) in windows.items():
        lo = F.when(F.col("generation") == int(g), F.lit(float(a))).otherwise(lo)
        hi = F.when(F.col("generation") == int(g), F.lit(float(b))).otherwise(hi)
    return lo, hi


def apply_censoring(people: DataFrame, windows: dict[int, tuple[float, float]], censor_age: float) -> DataFrame:
    """people with t1, t2 and death_age -> the four observation columns of each trait."""
    lo, hi = window_table(people, windows, censor_age)
    out = people
    for n in (1, 2):
        age, outside = age_censor(F.col(f"t{n}"), lo, hi)
        dies = age > F.col("death_age")
        out = out.withColumns({
            f"age_censored{n}": outside, f"death_censored{n}": dies,
            f"t_observed{n}": F.when(dies, F.col("death_age")).otherwise(age), f"affected{n}": ~outside & ~dies,
        })
    return out


@stage(reads=PHENOTYPE, writes=CENSORED, name="censor")
def run_censor(people: DataFrame, windows: dict, censor_age: float, death_scale: float = 164.0, death_rho: float = 2.73, seed: int = rng.DEFAULT_SEED) -> DataFrame:
    return apply_censoring(people.withColumn("death_age", death_age(death_scale, death_rho, seed)), windows or {}, censor_age)
