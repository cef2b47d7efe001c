"""A pedigree with liabilities and onset ages derived from the orders table by digests: the same rows in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagelake.functions import rng

GENERATIONS = 6
#: Loadings of A, C and E; Weibull (scale, rho, beta) of each trait and (scale, rho) of death: fixed values of the fixture.
LOADINGS = (0.7071, 0.4472, 0.5477)
ONSET = {1: (2160.0, 0.8, 1.0), 2: (333.0, 1.2, 1.5)}
DEATH = (164.0, 2.73)
CENSOR_AGE = 80.0
WINDOWS = {0: (80.0, 80.0), 1: (40.0, 80.0), 2: (20.0, 80.0), 3: (0.0, 80.0), 4: (0.0, 60.0), 5: (0.0, 40.0)}
PREVALENCE = {1: {0: 0.05, 1: 0.08, 2: 0.10, 3: 0.10, 4: 0.12, 5: 0.15}, 2: {0: 0.2, 1: 0.2, 2: 0.2, 3: 0.25, 4: 0.25, 5: 0.3}}


def pedigree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, generation, sex, mother, father, twin, household_id."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("id"))
    n = orders.count() // GENERATIONS
    i, founder = F.col("id") % n, F.col("id") < n
    twin = F.when(i % 100 == 10, F.col("id") + 2).when(i % 100 == 12, F.col("id") - 2).otherwise(F.lit(-1))
    couple = rng.integer("C", F.when(i % 100 == 12, F.col("id") - 2).otherwise(F.col("id"))) % (3 * n // 4)
    out = orders.filter(F.col("id") < n * GENERATIONS).select("id", F.floor(F.col("id") / n).cast("int").alias("generation"), (i % 2).cast("int").alias("sex"), twin.cast("long").alias("twin"), couple.alias("couple"))
    base, half = (F.col("generation") - 1).cast("long") * n, n // 2
    mother = F.when(F.col("id") < n, F.lit(-1)).otherwise(base + 2 * (F.col("couple") % half))
    father = F.when(F.col("id") < n, F.lit(-1)).otherwise(base + 2 * ((F.col("couple") + 3 + 11 * F.floor(F.col("couple") / half)) % half) + 1)
    out = out.select("id", "generation", "sex", mother.cast("long").alias("mother"), father.cast("long").alias("father"), "twin")
    return out.withColumn("household_id", F.when(F.col("mother") < 0, -1 - F.col("id")).otherwise(F.col("mother")))


def liabilities(ped: DataFrame) -> DataFrame:
    """Adds A, C, E and liability of both traits."""
    out = ped
    for n in (1, 2):
        for name, key, load in zip("ACE", ("id", "household_id", "id"), LOADINGS):
            out = out.withColumn(f"{name}{n}", F.lit(load) * rng.sum_normal(f"{name}{n}", F.col(key)))
        out = out.withColumn(f"liability{n}", F.col(f"A{n}") + F.col(f"C{n}") + F.col(f"E{n}"))
    return out


def fixture_uniform(stream: str, key: Column) -> Column:
    return (rng.integer(stream, key) + F.lit(0.5)) / F.lit(rng.SPAN)


def phenotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds onset ages t1, t2, rounded to 6 places."""
    out = liabilities(pedigree(spark, sf_dir))
    for n, (scale, rho, beta) in ONSET.items():
        e = -F.log(fixture_uniform(f"t{n}", F.col("id"))) / F.exp(F.lit(beta) * F.col(f"liability{n}"))
        out = out.withColumn(f"t{n}", F.round(F.lit(scale) * F.pow(e, F.lit(1 / rho)), 6))
    return out


def death_ages(people: DataFrame) -> DataFrame:
    return people.withColumn("death_age", F.round(F.lit(DEATH[0]) * F.pow(-F.log(fixture_uniform("death", F.col("id"))), F.lit(1 / DEATH[1])), 6))


def censored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineagelake.operators.censor import apply_censoring

    return apply_censoring(death_ages(phenotype(spark, sf_dir)), WINDOWS, CENSOR_AGE)


# The same in SQL.


def _h(tag: str, key: str) -> str:
    return f"CAST('0x' || substr(md5('42|{tag}|' || CAST({key} AS VARCHAR)), 1, 13) AS BIGINT)"


def _z(tag: str, key: str) -> str:
    d = f"md5('42|{tag}|' || CAST({key} AS VARCHAR))"
    parts = " + ".join(f"CAST('0x' || substr({d}, {1 + 4 * i}, 4) AS BIGINT)" for i in range(8))
    return f"(CAST({parts} - 262140 AS DOUBLE) / CAST(53509.47 AS DOUBLE))"


def _u(tag: str, key: str) -> str:
    return f"((CAST({_h(tag, key)} AS DOUBLE) + 0.5) / CAST(4503599627370496 AS DOUBLE))"


SQL_PED = f"""
cnt AS (SELECT CAST(count(*) // {GENERATIONS} AS BIGINT) AS n FROM orders),
ped0 AS (
  SELECT CAST(o_orderkey AS BIGINT) AS id, n, CAST(o_orderkey // n AS INTEGER) AS generation, CAST((o_orderkey % n) % 2 AS INTEGER) AS sex,
         CAST(CASE WHEN (o_orderkey % n) % 100 = 10 THEN o_orderkey + 2 WHEN (o_orderkey % n) % 100 = 12 THEN o_orderkey - 2 ELSE -1 END AS BIGINT) AS twin,
         {_h("C", "CASE WHEN (o_orderkey % n) % 100 = 12 THEN o_orderkey - 2 ELSE o_orderkey END")} % (3 * n // 4) AS couple
  FROM orders, cnt WHERE o_orderkey < n * {GENERATIONS}),
ped1 AS (
  SELECT id, generation, sex, twin,
         CAST(CASE WHEN id < n THEN -1 ELSE (generation - 1) * n + 2 * (couple % (n // 2)) END AS BIGINT) AS mother,
         CAST(CASE WHEN id < n THEN -1 ELSE (generation - 1) * n + 2 * ((couple + 3 + 11 * (couple // (n // 2))) % (n // 2)) + 1 END AS BIGINT) AS father
  FROM ped0),
ped AS (SELECT *, CASE WHEN mother < 0 THEN -1 - id ELSE mother END AS household_id FROM ped1)"""


def _component(name: str, n: int, key: str, load: float) -> str:
    return f"CAST({load} AS DOUBLE) * {_z(f'{name}{n}', key)} AS {name}{n}"


_parts = ", ".join(_component(c, n, k, w) for n in (1, 2) for c, k, w in zip("ACE", ("id", "household_id", "id"), LOADINGS))
_onset = ", ".join(f"round(CAST({s} AS DOUBLE) * pow(-ln({_u(f't{n}', 'id')}) / exp(CAST({b} AS DOUBLE) * liability{n}), CAST({1 / r} AS DOUBLE)), 6) AS t{n}" for n, (s, r, b) in ONSET.items())
_death = f"round(CAST({DEATH[0]} AS DOUBLE) * pow(-ln({_u('death', 'id')}), CAST({1 / DEATH[1]} AS DOUBLE)), 6) AS death_age"
SQL_LIAB = f"""{SQL_PED},
comp AS (SELECT *, {_parts} FROM ped),
liab AS (SELECT *, A1 + C1 + E1 AS liability1, A2 + C2 + E2 AS liability2 FROM comp)"""
SQL_PHENO = f"""{SQL_LIAB},
pheno AS (SELECT *, {_onset}, {_death} FROM liab)"""
SQL_WINDOWS = "windows(generation, lo, hi) AS (VALUES " + ", ".join(f"({g}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for g, (a, b) in WINDOWS.items()) + ")"
_age = ", ".join(f"t{n} < lo OR t{n} > hi AS age_censored{n}, least(greatest(t{n}, lo), hi) AS aged{n}" for n in (1, 2))
_obs = ", ".join(f"aged{n} > death_age AS death_censored{n}, CASE WHEN aged{n} > death_age THEN death_age ELSE aged{n} END AS t_observed{n}, NOT age_censored{n} AND NOT aged{n} > death_age AS affected{n}" for n in (1, 2))
SQL_CENS = f"""{SQL_PHENO},
{SQL_WINDOWS},
aged AS (SELECT p.*, lo, hi, {_age} FROM pheno p JOIN windows w ON p.generation = w.generation),
cens AS (SELECT * EXCLUDE (aged1, aged2, lo, hi), {_obs} FROM aged)"""
