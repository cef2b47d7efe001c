"""Phenotype models: from liability to onset age, as column expressions on any people table; a registry for new ones."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineagelake.functions import hazards, rng
from lineagelake.functions.mathx import erfc
from lineagelake.operators.ranking import rank_within
from lineagelake.operators.schema import PEDIGREE, PHENOTYPE, stage

#: Ages of adult-onset models are held within these.
ADULT_RANGE = (0.01, hazards.NEVER)
STANDARDIZE = ("none", "global", "per_generation")


def resolve_standardize(mode: str | bool | None) -> str:
    """True is global, False none; other names raise."""
    mode = {True: "global", False: "none", None: "none"}.get(mode, mode) if not isinstance(mode, str) else mode
    if mode not in STANDARDIZE:
        raise ValueError(f"standardize must be one of {STANDARDIZE}")
    return mode


def standardized(df: DataFrame, column: str, mode: str, out: str = "L") -> DataFrame:
    """Adds (x - mean) / sd over all or by generation; only centred where sd is below 1e-12, as it is for none."""
    mode = resolve_standardize(mode)
    if mode == "none":
        return df.withColumn(out, F.col(column))
    keys = ["generation"] if mode == "per_generation" else []
    stats = df.groupBy(*keys).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    joined = df.join(F.broadcast(stats), "generation") if keys else df.crossJoin(F.broadcast(stats))  # one row
    z = F.col(column) - F.col("_m")
    return joined.withColumn(out, F.when(F.col("_s") < 1e-12, z).otherwise(z / F.col("_s"))).drop("_m", "_s")


def scaled_beta(df: DataFrame, column: str, beta: float, mode: str) -> DataFrame:
    """Adds log_z = beta * (x - mean) / sd under the mode; beta * x for none, 0 where sd is 0."""
    mode = resolve_standardize(mode)
    if mode == "none":
        return df.withColumn("log_z", F.lit(float(beta)) * F.col(column))
    keys = ["generation"] if mode == "per_generation" else []
    stats = df.groupBy(*keys).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    joined = df.join(F.broadcast(stats), "generation") if keys else df.crossJoin(F.broadcast(stats))  # one row
    return joined.withColumn("log_z", F.when(F.col("_s") < 1e-12, 0.0).otherwise(F.lit(float(beta)) * (F.col(column) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def prevalence_column(k) -> Column:
    """A number, {generation: K} (the last listed generation at or before one's own), or {female: ..., male: ...} of either."""
    if isinstance(k, dict) and set(k) & {"female", "male"}:
        if set(k) != {"female", "male"}:
            raise ValueError("prevalence by sex needs female and male")
        return F.when(F.col("sex") == 0, prevalence_column(k["female"])).otherwise(prevalence_column(k["male"]))
    if isinstance(k, dict):
        if not k:
            raise ValueError("prevalence is empty")
        gens = sorted(int(g) for g in k)
        out = prevalence_column(k[gens[0]] if gens[0] in k else k[str(gens[0])])
        for g in gens[1:]:
            out = F.when(F.col("generation") >= g, F.lit(float(k.get(g, k.get(str(g)))))).otherwise(out)
        return out
    if not 0 < float(k) < 1:
        raise ValueError("prevalence must be between 0 and 1")
    return F.lit(float(k))


def threshold_column(k) -> Column:
    """The liability threshold of a prevalence: computed on the driver for each of its few values."""
    if isinstance(k, dict) and set(k) & {"female", "male"}:
        return F.when(F.col("sex") == 0, threshold_column(k["female"])).otherwise(threshold_column(k["male"]))
    if isinstance(k, dict):
        gens = sorted(int(g) for g in k)
        out = threshold_column(k.get(gens[0], k.get(str(gens[0]))))
        for g in gens[1:]:
            out = F.when(F.col("generation") >= g, threshold_column(k.get(g, k.get(str(g))))).otherwise(out)
        return out
    prevalence_column(k)
    return F.lit(NormalDist().inv_cdf(1 - float(k)))


def apply_threshold(df: DataFrame, trait: int, k, standardize: str = "global") -> DataFrame:
    """affected{trait}: threshold <= standardised liability (not strict, unlike the models with ages)."""
    out = standardized(df, f"liability{trait}", standardize, "_L")
    return out.withColumn(f"affected{trait}", F.col("_L") >= threshold_column(k)).drop("_L")


@stage(reads=PEDIGREE, name="threshold")
def run_threshold(people: DataFrame, prevalence1=0.10, prevalence2=0.20, g_pheno: int | None = None, standardize: str = "global") -> DataFrame:
    people = trailing_generations(people, g_pheno)
    for n, k in ((1, prevalence1), (2, prevalence2)):
        people = apply_threshold(people, n, k, standardize).withColumn(f"t{n}", F.lit(None).cast("double"))
    return people


def trailing_generations(people: DataFrame, g: int | None) -> DataFrame:
    """The last g generations; all for None. One small job finds the last."""
    if g is None:
        return people
    top = people.agg(F.max("generation")).first()[0]
    if top is None:
        return people
    if not 0 < g <= top + 1:
        raise ValueError(f"{g} generations asked for, {top + 1} there")
    return people.filter(F.col("generation") >= top - g + 1)


@dataclass
class Model:
    """What all models have: beta on liability, on sex, and how liability is standardised."""

    beta: float = 1.0
    beta_sex: float = 0.0
    standardize: str = "global"
    hazard: str = "weibull"
    params: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not math.isfinite(self.beta) or not math.isfinite(self.beta_sex):
            raise ValueError("beta must be finite")
        self.standardize = resolve_standardize(self.standardize)

    def onset(self, df: DataFrame, trait: int, seed: int) -> DataFrame:
        """df with t{trait}."""
        raise NotImplementedError

    def describe(self) -> dict:
        return {"model": type(self).__name__.lower(), **vars(self)}


MODELS: dict[str, type[Model]] = {}


def model(name: str) -> Callable:
    """Registers a model class under a name; the way to plug in one's own."""

    def add(cls: type[Model]) -> type[Model]:
        MODELS[name] = cls
        return cls

    return add


def _draw(kind: str, trait: int, seed: int) -> Column:
    make = {"e": rng.exponential, "u": rng.uniform, "n": rng.normal}[kind]
    return make(f"onset{trait}.{kind}", F.col("id"), seed=seed)


@model("frailty")
@dataclass
class Frailty(Model):
    """Proportional hazards: E ~ Exp(1), H0(t) exp(beta L + beta_sex sex) = E."""

    def onset(self, df: DataFrame, trait: int, seed: int) -> DataFrame:
        hazards.check(self.hazard, self.params)
        df = scaled_beta(df, f"liability{trait}", self.beta, self.standardize)
        h = _draw("e", trait, seed) / F.exp(F.col("log_z") + self.beta_sex * F.col("sex"))
        return df.withColumn(f"t{trait}", hazards.invert(self.hazard, h, **self.params)).drop("log_z")


@model("cure_frailty")
@dataclass
class CureFrailty(Model):
    """Cases are above the threshold (strictly); their age comes from a frailty on the raw liability, others never."""

    prevalence: object = 0.1
    standardize_hazard: str | None = None

    def onset(self, df: DataFrame, trait: int, seed: int) -> DataFrame:
        df = standardized(df, f"liability{trait}", self.standardize, "_L")
        df = scaled_beta(df, f"liability{trait}", self.beta, self.standardize_hazard or self.standardize)
        h = _draw("e", trait, seed) / F.exp(F.col("log_z") + self.beta_sex * F.col("sex"))
        case = F.col("_L") > threshold_column(self.prevalence)
        return df.withColumn(f"t{trait}", F.when(case, hazards.invert(self.hazard, h, **self.params)).otherwise(hazards.NEVER)).drop("_L", "log_z")


def _logistic_age(cip: Column, k: Column, x0: float, slope: float) -> Column:
    """The age at which a logistic cumulative incidence with plateau k reaches cip."""
    age = F.lit(float(x0)) + F.log(cip / (k - cip)) / F.lit(float(slope))
    return F.least(F.lit(ADULT_RANGE[1]), F.greatest(F.lit(ADULT_RANGE[0]), age))


@model("adult_ltm")
@dataclass
class AdultLtm(Model):
    """No draw: the age is where the cumulative incidence equals the liability's upper tail; cases strictly above the threshold."""

    prevalence: object = 0.1
    x0: float = 50.0
    slope: float = 0.2

    def onset(self, df: DataFrame, trait: int, seed: int) -> DataFrame:
        df = standardized(df, f"liability{trait}", self.standardize, "_L")
        k = prevalence_column(self.prevalence)
        cip = F.lit(0.5) * erfc((self.beta * F.col("_L") + self.beta_sex * F.col("sex")) / F.lit(math.sqrt(2)))
        case = (F.col("_L") > threshold_column(self.prevalence)) & (cip < k)
        return df.withColumn("_c", cip).withColumn(f"t{trait}", F.when(case, _logistic_age(F.when(case, F.col("_c")), k, self.x0, self.slope)).otherwise(hazards.NEVER)).drop("_L", "_c")


@model("adult_cox")
@dataclass
class AdultCox(Model):
    """Raw times sqrt(E / exp(beta L)) are ranked within a prevalence; rank / (n + 1) is the cumulative incidence."""

    prevalence: object = 0.1
    x0: float = 50.0
    slope: float = 0.2

    def onset(self, df: DataFrame, trait: int, seed: int) -> DataFrame:
        df = standardized(df, f"liability{trait}", self.standardize, "_L").withColumn("_k", prevalence_column(self.prevalence))
        raw = F.sqrt(_draw("e", trait, seed) / F.exp(self.beta * F.col("_L") + self.beta_sex * F.col("sex")))
        df = df.withColumn("_raw", raw)
        df = rank_within(df, "_k", F.col("_raw"), "_n").withColumn("_c", F.col("_n") / (F.col("_n_of") + 1))
        case = F.col("_c") < F.col("_k")
        return df.withColumn(f"t{trait}", F.when(case, _logistic_age(F.when(case, F.col("_c")), F.col("_k"), self.x0, self.slope)).otherwise(hazards.NEVER)).drop("_L", "_k", "_raw", "_n", "_n_of", "_c")


@model("first_passage")
@dataclass
class FirstPassage(Model):
    """First passage through 0 of a Brownian motion from y0 = sqrt(shape) exp(-beta L); drift away from 0 leaves some uncured for ever."""

    def onset(self, df: DataFrame, trait: int, seed: int) -> DataFrame:
        drift, shape = float(self.params["drift"]), float(self.params["shape"])
        df = scaled_beta(df, f"liability{trait}", self.beta, self.standardize)
        y0 = F.lit(math.sqrt(shape)) * F.exp(-F.col("log_z") - self.beta_sex * F.col("sex"))
        lam, n, u = y0 * y0, _draw("n", trait, seed), _draw("u", trait, seed)
        if drift == 0:
            t = lam / (n * n)
        else:  # inverse Gaussian with mean mu and shape lam, by the root of a chi-square and a choice between its roots
            mu, w = y0 / abs(drift), n * n
            x = mu + mu * mu * w / (2 * lam) - mu / (2 * lam) * F.sqrt(4 * mu * lam * w + mu * mu * w * w)
            t = F.when(u <= mu / (mu + x), x).otherwise(mu * mu / x)
        if drift > 0:
            cured = rng.uniform(f"onset{trait}.cure", F.col("id"), seed=seed) < 1 - F.exp(-2.0 * y0 * drift)
            t = F.when(cured, hazards.NEVER).otherwise(t)
        return df.withColumn(f"t{trait}", F.least(F.lit(hazards.NEVER), F.greatest(F.lit(hazards.EARLIEST), t))).drop("log_z")


@model("mixture_cip")
@dataclass
class MixtureCip(AdultLtm):
    """Two logistic onset curves: a share `early` of the cases follows (x1, slope1), the others (x0, slope)."""

    early: float = 0.3
    x1: float = 20.0
    slope1: float = 0.4

    def onset(self, df: DataFrame, trait: int, seed: int) -> DataFrame:
        if self.standardize == "per_generation":
            raise ValueError("mixture_cip knows none and global")
        first = AdultLtm.onset(self, df, trait, seed).withColumnRenamed(f"t{trait}", "_late")
        other = AdultLtm(beta=self.beta, beta_sex=self.beta_sex, standardize=self.standardize, prevalence=self.prevalence, x0=self.x1, slope=self.slope1)
        both = other.onset(first, trait, seed)
        pick = rng.uniform(f"onset{trait}.mix", F.col("id"), seed=seed) < self.early
        return both.withColumn(f"t{trait}", F.when(pick, F.col(f"t{trait}")).otherwise(F.col("_late"))).drop("_late")


@model("two_threshold")
@dataclass
class TwoThreshold(AdultLtm):
    """Liabilities above a second, higher threshold (share `severe` of the cases) have the early curve."""

    severe: float = 0.3
    x1: float = 20.0
    slope1: float = 0.4

    def onset(self, df: DataFrame, trait: int, seed: int) -> DataFrame:
        if self.standardize == "per_generation" or isinstance(self.prevalence, dict):
            raise ValueError("two_threshold knows one prevalence, and none or global")
        df = AdultLtm.onset(self, df, trait, seed).withColumnRenamed(f"t{trait}", "_late")
        early = AdultLtm(beta=self.beta, beta_sex=self.beta_sex, standardize=self.standardize, prevalence=float(self.prevalence) * self.severe, x0=self.x1, slope=self.slope1)
        df = early.onset(df, trait, seed)
        return df.withColumn(f"t{trait}", F.when(F.col(f"t{trait}") < hazards.NEVER, F.col(f"t{trait}")).otherwise(F.col("_late"))).drop("_late")


@model("mixture_cure_frailty")
@dataclass
class MixtureCureFrailty(CureFrailty):
    """Cases draw their age from one of two Weibull baselines."""

    early: float = 0.3
    params1: dict = field(default_factory=lambda: {"scale": 20.0, "rho": 3.0})

    def onset(self, df: DataFrame, trait: int, seed: int) -> DataFrame:
        if self.standardize == "per_generation":
            raise ValueError("mixture_cure_frailty knows none and global")
        base = {"beta": self.beta, "beta_sex": self.beta_sex, "standardize": self.standardize, "prevalence": self.prevalence}
        df = CureFrailty(**base, hazard=self.hazard, params=self.params).onset(df, trait, seed).withColumnRenamed(f"t{trait}", "_late")
        df = CureFrailty(**base, hazard="weibull", params=self.params1).onset(df, trait, seed)
        pick = rng.uniform(f"onset{trait}.mix", F.col("id"), seed=seed) < self.early
        return df.withColumn(f"t{trait}", F.when(pick, F.col(f"t{trait}")).otherwise(F.col("_late"))).drop("_late")


def make_model(name: str, **config) -> Model:
    if name not in MODELS:
        raise ValueError(f"unknown phenotype model {name!r}; known: {sorted(MODELS)}")
    return MODELS[name](**config)


@stage(reads=PEDIGREE, writes=PHENOTYPE, name="phenotype")
def run_phenotype(people: DataFrame, model1: Model, model2: Model, g_pheno: int | None = None, seed: int = rng.DEFAULT_SEED) -> DataFrame:
    people = trailing_generations(people, g_pheno)
    return model2.onset(model1.onset(people, 1, seed), 2, seed)
