"""Prevalence, incidence, mortality and observation statistics as grouped aggregations.

Traits are unpivoted once, so that one pass serves both. Curves bucket each age to its grid point, count, and run a sum
over the grid: no age is ever joined with the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineagelake.functions.mathx import safe_corr
from lineagelake.operators.censor import window_table


def by_trait(people: DataFrame, *columns: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Long form: (trait, *columns) with the suffixes 1 and 2 taken off."""
    rows = [F.struct(F.lit(n).alias("trait"), *[F.col(f"{c}{n}").alias(c) for c in columns]) for n in (1, 2)]
    return people.select(*keep, F.inline(F.array(*rows)))


def share(flag: str | Column) -> Column:
    return F.avg((F.col(flag) if isinstance(flag, str) else flag).cast("double"))


def prevalence(people: DataFrame, by: tuple[str, ...] = ("generation",)) -> DataFrame:
    long = by_trait(people, "affected", keep=by)
    return long.groupBy("trait", *by).agg(F.count("*").alias("n"), share("affected").alias("prevalence"))


def prevalence_grouping_sets(people: DataFrame) -> DataFrame:
    """Overall, by sex, by generation and by both in one pass."""
    long = by_trait(people, "affected", keep=("sex", "generation"))
    out = long.groupingSets([["trait"], ["trait", "sex"], ["trait", "generation"], ["trait", "sex", "generation"]], "trait", "sex", "generation")
    return out.agg(F.count("*").alias("n"), share("affected").alias("prevalence"))


def mortality(people: DataFrame, censor_age: float, width: int = 10) -> DataFrame:
    """Life table in bins of `width` years up to censor_age: alive at the start, died within (before censor_age), rate."""
    bins = int(-(-censor_age // width))
    at = F.least(F.floor(F.col("death_age") / width), F.lit(bins)).cast("int")
    counts = people.filter("death_age is not null").groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("death_age") < censor_age).alias("died"))
    grid = people.sparkSession.range(bins + 1).select(F.col("id").cast("int").alias("bin"))
    full = grid.join(counts, "bin", "left").na.fill(0)
    out = full.withColumn("alive", F.sum("n").over(Window.orderBy(F.desc("bin")))).filter(F.col("bin") < bins)
    label = F.concat((F.col("bin") * width).cast("string"), F.lit("-"), (F.col("bin") * width + width - 1).cast("string"))
    rate = F.when(F.col("alive") > 0, F.col("died") / F.col("alive")).otherwise(0.0)
    return out.select("bin", label.alias("age"), "alive", "died", rate.alias("rate"))


def survival(life_table: DataFrame) -> DataFrame:
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    log_s = F.sum(F.when(F.col("rate") < 1, F.log1p(-F.col("rate"))).otherwise(-1e9)).over(w)
    return life_table.select("bin", "age", "rate", F.exp(log_s).alias("survival"), (1 - F.exp(log_s)).alias("cumulative_mortality"))


def cumulative_incidence(people: DataFrame, censor_age: float, points: int = 200, by: tuple[str, ...] = ()) -> DataFrame:
    """On linspace(0, censor_age, points): share of all with an observed onset by then, and with a true onset by then."""
    step = censor_age / (points - 1)
    long = by_trait(people, "t", "t_observed", "affected", keep=by)
    keys = ["trait", *by]

    def place(t: str) -> Column:  # the first grid point at or after t
        k = F.greatest(F.lit(0), F.ceil(F.col(t) / step))
        return F.when(F.col(t) <= (k - 1) * F.lit(step), k - 1).when(F.col(t) > k * F.lit(step), k + 1).otherwise(k)

    marks = long.select(*keys, F.explode(F.array(F.struct(F.lit("o").alias("kind"), F.when(F.col("affected"), place("t_observed")).alias("k")), F.struct(F.lit("t").alias("kind"), place("t").alias("k")))).alias("m"))
    hist = marks.groupBy(*keys, F.col("m.k").alias("k")).agg(F.count_if(F.col("m.kind") == "o").alias("o"), F.count_if(F.col("m.kind") == "t").alias("t"))
    hist = hist.filter(F.col("k") < points)
    size = long.groupBy(*keys).agg(F.count("*").alias("n"))
    grid = size.select("*", F.explode(F.expr(f"sequence(0L, {points - 1}L)")).alias("k"))
    w = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(hist, [*keys, "k"], "left").na.fill(0, ["o", "t"])
    return full.select(*keys, "k", (F.col("k") * F.lit(step)).alias("age"), "n", (F.sum("o").over(w) / F.col("n")).alias("observed"), (F.sum("t").over(w) / F.col("n")).alias("true_value"))


def half_target_age(curve: DataFrame, keys: tuple[str, ...] = ("trait",)) -> DataFrame:
    last = F.max_by("observed", "k").over(Window.partitionBy(*keys))
    return curve.withColumn("last", last).filter(F.col("observed") >= F.col("last") / 2).groupBy(*keys).agg(F.min("age").alias("half_target_age"))


def onset_quartiles(curve: DataFrame, keys: tuple[str, ...] = ("trait",)) -> DataFrame:
    """Ages at 25, 50 and 75 % of the last observed value; null below 1e-6."""
    last = F.max_by("observed", "k").over(Window.partitionBy(*keys))
    c = curve.withColumn("last", last)
    q = [F.min(F.when((F.col("last") >= 1e-6) & (F.col("observed") >= F.col("last") * p / 100), F.col("age"))).alias(f"age_q{p}") for p in (25, 50, 75)]
    return c.groupBy(*keys).agg(*q)


def joint_affection(people: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    a, b = F.col("affected1"), F.col("affected2")
    out = people.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only1"), F.count_if(~a & b).alias("only2"), F.count_if(~a & ~b).alias("neither")
    )
    return out.withColumn("co_affection", F.when(F.col("n") > 0, F.round(F.col("both") / F.col("n"), 4)))


def censor_confusion(people: DataFrame, windows: dict, censor_age: float) -> DataFrame:
    """True status (onset before censor_age) against observed status, over generations with a window of some width."""
    lo, hi = window_table(people, windows, censor_age)
    seen = people.filter(hi > lo)
    true, got = F.col("t") < censor_age, F.col("affected")
    return by_trait(seen, "t", "affected").groupBy("trait").agg(
        F.count_if(true & got).alias("tp"), F.count_if(true & ~got).alias("fn"), F.count_if(~true & got).alias("fp"), F.count_if(~true & ~got).alias("tn"), F.count("*").alias("n")
    )


def censor_cascade(people: DataFrame, windows: dict, censor_age: float) -> DataFrame:
    """What becomes of true onsets by generation: before the window, after it, after death, observed."""
    lo, hi = window_table(people, windows, censor_age)
    base = people.withColumns({"lo": lo, "hi": hi})
    long = by_trait(base, "t", keep=("generation", "lo", "hi", "death_age")).filter(F.col("t") < censor_age)
    left, right = F.col("t") < F.col("lo"), F.col("t") > F.col("hi")
    inside, dead = ~left & ~right, F.col("death_age") < F.col("t")
    out = long.groupBy("trait", "generation").agg(
        F.count("*").alias("true_cases"), F.count_if(left).alias("left_truncated"), F.count_if(right).alias("right_censored"),
        F.count_if(inside & dead).alias("death_censored"), F.count_if(inside & ~dead).alias("observed"),
    )
    return out.withColumn("sensitivity", F.col("observed") / F.col("true_cases"))


def censor_windows(people: DataFrame, windows: dict, censor_age: float) -> DataFrame:
    """Shares affected, before and after the window, and censored by death alone, by listed generation."""
    lo, hi = window_table(people, windows, censor_age)
    long = by_trait(people.withColumns({"lo": lo, "hi": hi}), "t", "affected", "death_censored", "age_censored", keep=("generation", "lo", "hi")).filter(F.col("generation").isin(*windows))
    return long.groupBy("trait", "generation").agg(
        F.count("*").alias("n"), share("affected").alias("pct_affected"), share(F.col("t") < F.col("lo")).alias("left_censored"),
        share(F.col("t") > F.col("hi")).alias("right_censored"), share(F.col("death_censored") & ~F.col("age_censored")).alias("death_only"),
    )


def person_years(people: DataFrame, windows: dict, censor_age: float) -> DataFrame:
    """Years under observation by generation: overall, deaths, and until onset for each trait; one decimal."""
    lo, hi = window_table(people, windows, censor_age)
    base = people.withColumns({"lo": lo, "hi": hi}).filter("hi > lo")
    span = lambda *ends: F.sum(F.greatest(F.least(*ends, F.col("hi")) - F.col("lo"), F.lit(0.0)))
    return base.groupBy("generation").agg(
        F.round(span(F.col("death_age")), 1).alias("person_years"), F.count_if((F.col("lo") <= F.col("death_age")) & (F.col("death_age") < F.col("hi"))).alias("deaths"),
        F.round(span(F.col("t_observed1"), F.col("death_age")), 1).alias("trait1_years"), F.round(span(F.col("t_observed2"), F.col("death_age")), 1).alias("trait2_years"),
    )


def incidence_rate(people: DataFrame, windows: dict, censor_age: float) -> DataFrame:
    """Onsets per 1000 person-years, by trait."""
    lo, hi = window_table(people, windows, censor_age)
    base = people.withColumns({"lo": lo, "hi": hi}).filter("hi > lo")
    long = by_trait(base, "t_observed", "affected", keep=("lo", "hi", "death_age"))
    years = F.sum(F.greatest(F.least("t_observed", "death_age", "hi") - F.col("lo"), F.lit(0.0)))
    return long.groupBy("trait").agg(F.count_if("affected").alias("cases"), years.alias("years")).withColumn("rate_per_1000", F.try_divide(F.col("cases") * 1000.0, F.col("years")))


def onset_regression(people: DataFrame) -> DataFrame:
    """Age at onset on liability among the affected; null with fewer than two."""
    long = by_trait(people, "affected", "t_observed", "liability").filter("affected and t_observed is not null and liability is not null")
    return long.groupBy("trait").agg(
        F.count("*").alias("n"), F.when(F.count("*") >= 2, F.regr_slope("t_observed", "liability")).alias("slope"),
        F.when(F.count("*") >= 2, F.regr_intercept("t_observed", "liability")).alias("intercept"), F.when(F.count("*") >= 2, safe_corr(F.col("liability"), F.col("t_observed"))).alias("r"),
    )


def means_by_affection(people: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = ("generation",)) -> DataFrame:
    """Means of components among all, affected and unaffected, and the prevalence."""
    long = by_trait(people, *columns, "affected", keep=by)
    cols = [f(c) for c in columns for f in (lambda c: F.avg(c).alias(f"{c}_all"), lambda c: F.avg(F.when(F.col("affected"), F.col(c))).alias(f"{c}_affected"), lambda c: F.avg(F.when(~F.col("affected"), F.col(c))).alias(f"{c}_unaffected"))]
    return long.groupBy("trait", *by).agg(*cols, share("affected").alias("prevalence"))


def onset_histogram(people: DataFrame, censor_age: float, bins: int = 50) -> DataFrame:
    long = by_trait(people, "t_observed", "affected", "death_censored")
    at = F.least(F.floor(F.col("t_observed") * bins / censor_age), F.lit(bins - 1)).cast("int")
    return long.filter("affected or death_censored").groupBy("trait", at.alias("bin")).agg(F.count_if("affected").alias("affected"), F.count_if("death_censored").alias("death_censored"))
