"""Comparisons over scenarios and replicates: tables (scenario, rep, ..., value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineagelake.operators.correlations import mate_correlations


def _number(value: str):
    return F.when(~F.isnan(value), F.col(value))


def envelope(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean, least and greatest over replicates; missing ones are skipped."""
    v = _number(value)
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("n_reps"))


def mean_sd_table(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Cells "mean ± sd" with four places; the mean alone where there is one replicate."""
    out = df.groupBy(*by).agg(F.avg(_number(value)).alias("_m"), F.stddev_samp(_number(value)).alias("_s"))
    return out.select(*by, F.when(F.col("_s").isNull(), F.format_string("%.4f", "_m")).otherwise(F.format_string("%.4f ± %.4f", "_m", "_s")).alias("cell"))


def bias(df: DataFrame, expected: float | None, value: str = "value") -> DataFrame:
    """Observed less configured; null where the configuration is by generation (expected None)."""
    return df.withColumn("bias", F.col(value) - F.lit(expected).cast("double"))


def regression_band(rows: DataFrame, grid: DataFrame, by: list[str], t95: float = 1.96) -> DataFrame:
    """95 % band of a fitted line at the grid's x: s sqrt(1/n + (x - mean)^2 / Sxx)."""
    fit = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("icpt"))
    both = grid.join(F.broadcast(fit), by) if set(by) <= set(grid.columns) else fit.crossJoin(F.broadcast(grid))  # a plot's grid
    s = F.sqrt((F.col("syy") - F.col("slope") * F.col("sxy")) / (F.col("n") - 2))
    half = t95 * s * F.sqrt(1 / F.col("n") + F.pow(F.col("x") - F.col("mx"), 2) / F.col("sxx"))
    line = F.col("icpt") + F.col("slope") * F.col("x")
    return both.select(*by, "x", line.alias("y"), (line - half).alias("low"), (line + half).alias("high"))


def with_truth(df: DataFrame, truth: DataFrame, key: str = "scenario") -> DataFrame:
    return df.join(F.broadcast(truth), key, "left")


def over_reps(reps: dict[int, DataFrame], table) -> DataFrame:
    """A table of each replicate, with its number: mate correlations, estimators of h2, cohort Falconer and the like."""
    parts = [table(df).withColumn("rep", F.lit(k)) for k, df in sorted(reps.items())]
    return reduce(DataFrame.unionByName, parts)


def mate_matrix(reps: dict[int, DataFrame]) -> DataFrame:
    """Mates' 2x2 liability correlations averaged over replicates."""
    every = over_reps(reps, mate_correlations)
    return every.agg(F.count("*").alias("n_reps"), *[F.avg(c).alias(c) for c in ("m1_f1", "m1_f2", "m2_f1", "m2_f2")])
