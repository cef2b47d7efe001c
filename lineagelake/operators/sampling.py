"""Sampling and dropout with sizes that are met exactly: rows are ranked by a digest of their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineagelake.functions import rng
from lineagelake.operators.checkpoints import cut
from lineagelake.operators.ranking import rank_within


#: Counters of a pass; each pass narrows the keys' range by this factor.
BINS = 4096


def nth_smallest(df: DataFrame, column: str, n: int) -> tuple | None:
    """(value, rank among its equals) of the n-th smallest value, n from 1; None with fewer rows.

    A pass counts equal-width bins of the range, with map-side sums; the bin that holds the n-th is the next range. Only
    counters come to the driver, and no row is sorted: passes grow with the logarithm of the rows.
    """
    x = F.col(column)
    low, high, count = df.agg(F.min(x), F.max(x), F.count(x)).first()
    if n < 1 or count < n:
        return None
    while low != high:
        width = (high - low) / BINS
        own = df.filter((x >= F.lit(low)) & (x <= F.lit(high)))
        # monotone in x whatever the rounding, so bins don't overlap
        bins = own.groupBy(F.floor((x - F.lit(low)) / F.lit(float(width))).alias("b")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
        for row in sorted(bins.collect(), key=lambda r: r.b):
            if n <= row.n:
                low, high = row.low, row.high
                break
            n -= row.n
    return low, n


def smallest(df: DataFrame, key: Column, n: int) -> DataFrame:
    """The n rows with the smallest key (ties by id), all if there are fewer. Only the n-th key and id come to the driver."""
    keyed = df.withColumn("_key", key)
    if n <= 0:
        return df.filter(F.lit(False))
    keys = cut(keyed.select("_key", "id"))
    last = nth_smallest(keys, "_key", n)
    if last is None:
        return df
    value, left = last
    same = F.col("_key") == F.lit(value)
    last_id = nth_smallest(keys.filter(same), "id", left)[0]
    return keyed.filter((F.col("_key") < F.lit(value)) | (same & (F.col("id") <= F.lit(last_id)))).drop("_key")


def run_sample(people: DataFrame, n: int, case_ratio: float = 1.0, seed: int = rng.DEFAULT_SEED) -> DataFrame:
    """n people without replacement; all for n <= 0 or n >= rows. Cases of trait 1 weigh case_ratio, others 1.

    Weighted sampling takes the smallest exponential draw over weight, which has the law of drawing one by one.
    case_ratio 0 takes controls only; without cases or without controls it is uniform.
    """
    if case_ratio < 0:
        raise ValueError("case_ratio must not be negative")
    row = people.agg(F.count("*"), *([F.count_if("affected1")] if case_ratio != 1 else [])).first()
    if n <= 0 or n >= row[0]:
        return people
    if case_ratio == 1 or row[1] in (0, row[0]):
        return smallest(people, rng.integer("sample", F.col("id"), seed=seed), n)
    if case_ratio == 0:
        return smallest(people.filter("not affected1"), rng.integer("sample", F.col("id"), seed=seed), min(n, row[0] - row[1]))
    weight = F.when(F.col("affected1"), F.lit(float(case_ratio))).otherwise(1.0)
    return smallest(people, F.round(rng.exponential("sample", F.col("id"), seed=seed) / weight, 9), n)


def sever(people: DataFrame, kept: DataFrame) -> DataFrame:
    """Links to people who aren't kept become -1."""
    out = people
    for c in ("mother", "father", "twin"):
        ids = kept.select(F.col("id").alias("_k"))
        out = out.join(ids, out[c] == ids["_k"], "left").withColumn(c, F.when(F.col("_k").isNull(), F.lit(-1)).otherwise(F.col(c))).drop("_k")
    return out


def run_dropout(people: DataFrame, rate: float, seed: int = rng.DEFAULT_SEED) -> DataFrame:
    """Drops round(n * rate) people, halves to even, and severs links to them."""
    if not 0 <= rate < 1:
        raise ValueError("rate must be in [0, 1)")
    n = people.count()
    drop = round(n * rate)
    if drop == 0:
        return people
    if drop >= n:
        raise ValueError("dropout would drop everyone")
    kept = smallest(people, rng.integer("dropout", F.col("id"), seed=seed), n - drop)
    return sever(kept, kept)


def sample_with_parents(people: DataFrame, per_generation: int = 50_000, seed: int = rng.DEFAULT_SEED) -> DataFrame:
    """At most per_generation people of each generation, and the parents of those sampled."""
    picked = rank_within(people.select("id", "generation", "mother", "father"), "generation", rng.integer("plot", F.col("id"), seed=seed), "_r").filter(F.col("_r") <= per_generation)
    parents = picked.select(F.explode(F.array("mother", "father")).alias("id")).filter("id >= 0")
    ids = picked.select("id").unionByName(parents).distinct()
    return people.join(ids, "id", "left_semi")
