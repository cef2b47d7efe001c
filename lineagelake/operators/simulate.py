"""Simulation of pedigrees: founders, mating, reproduction, generation by generation.

All draws come from digests of (seed, stream, generation, person), so a lost task repeats the same draws. Each
generation is written off with a checkpoint; work per generation is a few joins of its own size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineagelake.functions import rng
from lineagelake.functions.mathx import ndtri, safe_corr
from lineagelake.operators.checkpoints import cut
from lineagelake.operators.ranking import rank_score
from lineagelake.operators.sampling import smallest
from lineagelake.operators.schema import PEDIGREE, assert_schema


def per_generation(value, generations: int, name: str = "parameter") -> list[float]:
    """A number, or {generation: number} filled forward; errors without an entry at or before 0, and for negative ones."""
    if not isinstance(value, dict):
        value = {0: value}
    known = {int(k): float(v) for k, v in value.items()}
    if not known or min(known) > 0:
        raise ValueError(f"{name} has no value for generation 0")
    if any(v < 0 for v in known.values()):
        raise ValueError(f"{name} must not be negative")
    return [known[max(k for k in known if k <= g)] for g in range(generations)]


@dataclass
class Parameters:
    n: int = 1000
    generations: int = 3
    burn_in: int = 0
    seed: int = rng.DEFAULT_SEED
    A: tuple = (0.5, 0.5)
    C: tuple = (0.2, 0.2)
    E: tuple = (0.3, 0.3)
    rA: float = 0.3
    rC: float = 0.5
    rE: float = 0.0
    mating_lambda: float = 0.5
    p_mztwin: float = 0.02
    assort: tuple = (0.0, 0.0)
    #: 2x2 correlations of mothers' with fathers' liabilities; its diagonal stands for assort.
    assort_matrix: tuple | None = None

    def __post_init__(self) -> None:
        if self.assort_matrix is not None:
            m = np.asarray(self.assort_matrix, float)
            if m.shape != (2, 2) or not np.allclose(m, m.T) or not (np.abs(m) <= 1).all():
                raise ValueError("assort_matrix must be a symmetric 2x2 matrix of correlations")
            self.assort = (float(m[0, 0]), float(m[1, 1]))
        if self.n < 4 or self.generations < 1 or self.burn_in < 0:
            raise ValueError("n of 4 or more and at least one generation are needed")
        if not all(-1 <= r <= 1 for r in (self.rA, self.rC, self.rE, *self.assort)):
            raise ValueError("correlations must be in [-1, 1]")
        if not 0 <= self.p_mztwin < 1 or self.mating_lambda <= 0:
            raise ValueError("p_mztwin must be in [0, 1), mating_lambda positive")
        if self.both_traits:
            within = self.within()
            if not abs(within) < 1:
                raise ValueError("assortment on both traits needs a correlation of the traits within (-1, 1)")
            if canonical(self.mate_target(within), within, within)[1].max() > 1 + 1e-9:
                raise ValueError("no joint distribution has these correlations of mates: not positive semidefinite")

    @property
    def both_traits(self) -> bool:
        return self.assort_matrix is not None or all(self.assort)

    def within(self) -> float:
        """Correlation of the two liabilities of one person."""
        cov = sum(r * math.sqrt(v[0] * v[1]) for r, v in ((self.rA, self.A), (self.rC, self.C), (self.rE, self.E)))
        total = math.sqrt((self.A[0] + self.C[0] + self.E[0]) * (self.A[1] + self.C[1] + self.E[1]))
        return cov / total if total else 0.0

    def mate_target(self, within: float) -> np.ndarray:
        """Correlations of mothers' (rows) with fathers' (columns) liabilities that mating aims at."""
        if self.assort_matrix is not None:
            return np.asarray(self.assort_matrix, float)
        return np.array(expected_mate_correlation(*self.assort, within))


def canonical(target: np.ndarray, within_f: float, within_m: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of weights for mothers' and for fathers' standardised liabilities, and the correlations of the pairs of scores.

    The scores of one side are uncorrelated, with variance 1; only scores of the same number correlate between mates.
    """
    root_f, root_m = (np.linalg.inv(np.linalg.cholesky(np.array([[1.0, r], [r, 1.0]]))) for r in (within_f, within_m))
    u, s, vt = np.linalg.svd(root_f @ target @ root_m.T)
    return u.T @ root_f, s, vt @ root_m


def correlated(stream: str, key: Column, sd1: float | Column, sd2: float | Column, r: float, seed: int) -> tuple[Column, Column]:
    """Two normals with the given deviations and correlation."""
    a, b = rng.normal(f"{stream}.1", key, seed=seed), rng.normal(f"{stream}.2", key, seed=seed)
    return sd1 * a, sd2 * (r * a + math.sqrt(max(0.0, 1 - r * r)) * b)


def truncated_poisson(u: Column, lam: float) -> Column:
    """A Poisson number given that it is at least 1, by its distribution function (a small table from the driver)."""
    total, p, k, out, cuts = 1 - math.exp(-lam), math.exp(-lam), 0, None, []
    cum = 0.0
    while cum < 1 - 1e-12 and k < 200:
        k += 1
        p *= lam / k
        cum += p / total
        cuts.append((k, cum))
    out = F.lit(cuts[-1][0])
    for k, c in reversed(cuts[:-1]):
        out = F.when(u < c, F.lit(k)).otherwise(out)
    return out


def founders(spark: SparkSession, p: Parameters) -> DataFrame:
    key, s = F.col("id"), p.seed
    a = correlated("A0", key, math.sqrt(p.A[0]), math.sqrt(p.A[1]), p.rA, s)
    c = correlated("C0", key, math.sqrt(p.C[0]), math.sqrt(p.C[1]), p.rC, s)
    e = correlated("E0", key, math.sqrt(p.E[0]), math.sqrt(p.E[1]), p.rE, s)
    base = spark.range(p.n).withColumns({"generation": F.lit(0), "sex": (key % 2).cast("int"), "mother": F.lit(-1).cast("long"), "father": F.lit(-1).cast("long"), "twin": F.lit(-1).cast("long"), "household_id": -1 - key})
    base = base.withColumns({f"{n}{i + 1}": v[i] for n, v in (("A", a), ("C", c), ("E", e)) for i in (0, 1)})
    return with_liabilities(base)


def with_liabilities(df: DataFrame) -> DataFrame:
    return df.withColumns({f"liability{n}": F.col(f"A{n}") + F.col(f"C{n}") + F.col(f"E{n}") for n in (1, 2)}).select(*PEDIGREE)


def mating_slots(people: DataFrame, p: Parameters, g: int) -> DataFrame:
    """(id, sex, slot): each person as often as a zero-truncated Poisson says."""
    k = truncated_poisson(rng.uniform(f"mates.{g}", F.col("id"), seed=p.seed), p.mating_lambda)
    return people.select("id", "sex", "liability1", "liability2", F.explode(F.sequence(F.lit(1), k)).alias("slot"))


def mate(people: DataFrame, p: Parameters, g: int) -> DataFrame:
    """(mating, mother, father), distinct couples, as many as the slots of the rarer sex.

    Slots of the sex that has more are dropped by digest, whatever their liability. Those left are put in an order and
    paired by position: a random one, or by a noisy score of one trait, or by two such scores for both traits. A score
    keeps sqrt(r) of itself beside noise on either side, so partners' scores correlate r (a Gaussian copula). With two
    scores the places are those within bands of the first one, so that partners are near in both.
    """
    slots = cut(mating_slots(people, p, g))
    n = {r.sex: r.n for r in slots.groupBy("sex").agg(F.count("*").alias("n")).collect()}
    least = min(n.get(0, 0), n.get(1, 0))
    sides = {}
    for sex, name in ((0, "mother"), (1, "father")):
        own = slots.filter(F.col("sex") == sex)
        if n.get(sex, 0) > least:
            own = smallest(own, rng.integer(f"trim.{g}.{name}", F.col("id"), F.col("slot"), seed=p.seed), least)
        sides[name] = own
    noise = lambda name, k: rng.normal(f"order.{g}.{name}{k}", F.col("id"), F.col("slot"), seed=p.seed)
    if p.both_traits:
        stats = {name: own.agg(*[f(f"liability{t}").alias(f"{k}{t}") for t in (1, 2) for k, f in (("m", F.avg), ("s", F.stddev_pop))], safe_corr(F.col("liability1"), F.col("liability2")).alias("r")).first() for name, own in sides.items()}
        within = {name: min(0.999, max(-0.999, v.r or 0.0)) for name, v in stats.items()}
        wf, r, wm = canonical(p.mate_target(p.within()), within["mother"], within["father"])
        orders = {}
        for name, w in (("mother", wf), ("father", wm)):
            v = stats[name]
            z = [(F.col(f"liability{t}") - F.lit(v[f"m{t}"] or 0.0)) / F.lit(v[f"s{t}"] or 1.0) for t in (1, 2)]
            orders[name] = [math.sqrt(min(1.0, r[k])) * (float(w[k, 0]) * z[0] + float(w[k, 1]) * z[1]) + math.sqrt(max(0.0, 1 - r[k])) * noise(name, k) for k in (0, 1)]
    else:
        trait, r = (1, p.assort[0]) if p.assort[0] else (2, p.assort[1])
        orders = {}
        for name, own in sides.items():
            sd = own.agg(F.stddev_pop(f"liability{trait}")).first()[0] or 1.0
            mean = own.agg(F.avg(f"liability{trait}")).first()[0] or 0.0
            sign = -1.0 if name == "father" and r < 0 else 1.0
            orders[name] = [math.sqrt(abs(r)) * sign * (F.col(f"liability{trait}") - F.lit(mean)) / F.lit(sd) + math.sqrt(1 - abs(r)) * noise(name, 0)]
    placed = [_placed(sides[name].select("id", "slot", *[o.alias(f"s{k}") for k, o in enumerate(orders[name])]), least).withColumnRenamed("id", name) for name in ("mother", "father")]
    pairs = cut(placed[0].join(placed[1], "place"))
    for _ in range(REPAIRS):
        pairs = swapped(pairs)
    return pairs.groupBy("mother", "father").agg(F.min("place").alias("mating"))


#: Times that repeated couples exchange partners with their neighbours.
REPAIRS = 2


def _placed(slots: DataFrame, n: int) -> DataFrame:
    """(id, place): places by s0, or by s1 within bands of sqrt(n) places of s0."""
    ranked = rank_score(slots, F.col("s0"), "q", distinct_ids=False)
    if "s1" not in slots.columns:
        return ranked.select("id", F.col("q_rank").alias("place"))
    width = max(1, math.isqrt(n))
    band = F.floor((F.col("q_rank") - 1) / width)
    inner = F.row_number().over(Window.partitionBy("_band").orderBy("s1", "id", "slot"))
    return ranked.withColumn("_band", band).select("id", (F.col("_band") * width + inner).cast("long").alias("place"))


def swapped(pairs: DataFrame) -> DataFrame:
    """(place, mother, father) where couples that were there before exchange fathers with the next place."""
    again = pairs.select("place", F.row_number().over(Window.partitionBy("mother", "father").orderBy("place")).alias("nth")).filter("nth > 1").select("place")
    # a place takes part in one exchange: of repeated couples in a row the first one moves
    alone = again.join(again.select((F.col("place") + 1).alias("place")), "place", "left_anti")
    moves = alone.join(pairs.select((F.col("place") - 1).alias("place")), "place", "left_semi")
    moves = cut(moves.select("place", (F.col("place") + 1).alias("other")))
    both = moves.unionByName(moves.select(F.col("other").alias("place"), F.col("place").alias("other")))
    new = both.join(pairs.select(F.col("place").alias("other"), F.col("father").alias("new")), "other").select("place", "new")
    return cut(pairs.join(new, "place", "left").select("place", "mother", F.coalesce("new", "father").alias("father")))


def reproduce(people: DataFrame, matings: DataFrame, p: Parameters, g: int, first_id: int) -> DataFrame:
    """The n children of generation g: each draws its mating, sex, Mendelian noise and environment."""
    spark, s, key = people.sparkSession, p.seed, F.col("id")
    m = rank_score(matings.withColumnRenamed("mating", "id"), rng.uniform(f"mating.{g}", F.col("id"), seed=s), "q").select(F.col("q_rank").alias("pick"), "mother", "father")
    m = cut(m)
    total = m.count()
    kids = spark.range(first_id, first_id + p.n).withColumn("pick", (F.floor(rng.uniform(f"child.{g}", key, seed=s) * total) + 1).cast("long"))
    # MZ twins: the second child of a mating copies the first's place, sex and A with probability p
    w = Window.partitionBy("pick").orderBy("id")
    kids = kids.withColumns({"nth": F.row_number().over(w), "n_kids": F.count("*").over(Window.partitionBy("pick")), "first": F.min("id").over(Window.partitionBy("pick")), "second": F.element_at(F.sort_array(F.collect_list("id").over(Window.partitionBy("pick"))), F.when(F.count("*").over(Window.partitionBy("pick")) > 1, 2).otherwise(1))})
    is_twin = (F.col("n_kids") > 1) & (F.col("nth") <= 2) & (rng.uniform(f"twin.{g}", F.col("pick"), seed=s) < p.p_mztwin)
    kids = kids.withColumn("twin", F.when(is_twin & (F.col("nth") == 1), F.col("second")).when(is_twin, F.col("first")).otherwise(F.lit(-1)).cast("long"))
    kids = kids.withColumn("zygote", F.when(F.col("twin") >= 0, F.col("first")).otherwise(F.col("id"))).join(m, "pick")
    sides = people.select("id", "A1", "A2")
    kids = kids.join(sides.withColumnsRenamed({"id": "mother", "A1": "m1", "A2": "m2"}), "mother").join(sides.withColumnsRenamed({"id": "father", "A1": "f1", "A2": "f2"}), "father")
    noise = correlated(f"A.{g}", F.col("zygote"), math.sqrt(p.A[0] / 2), math.sqrt(p.A[1] / 2), p.rA, s)
    c = correlated(f"C.{g}", F.col("mother"), math.sqrt(p.C[0]), math.sqrt(p.C[1]), p.rC, s)
    e = correlated(f"E.{g}", key, math.sqrt(p.E[0]), math.sqrt(p.E[1]), p.rE, s)
    out = kids.withColumns({
        "generation": F.lit(g), "sex": (rng.uniform(f"sex.{g}", F.col("zygote"), seed=s) < 0.5).cast("int"), "household_id": F.col("mother"),
        "A1": (F.col("m1") + F.col("f1")) / 2 + noise[0], "A2": (F.col("m2") + F.col("f2")) / 2 + noise[1], "C1": c[0], "C2": c[1], "E1": e[0], "E2": e[1],
    })
    return with_liabilities(out)


def run_simulation(spark: SparkSession, p: Parameters) -> DataFrame:
    """The pedigree of the last `generations` generations; those of the burn-in are dropped and their children are founders."""
    now, every = cut(founders(spark, p)), []
    for g in range(p.burn_in + p.generations):
        if g:
            now = cut(reproduce(now, mate(now, p, g), p, g, g * p.n))
        if g >= p.burn_in:
            every.append(now)
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    base = p.burn_in * p.n
    shift = lambda c: F.when(F.col(c) >= base, F.col(c) - base).otherwise(F.lit(-1)).cast("long").alias(c)
    out = out.withColumn("generation", (F.col("generation") - p.burn_in).cast("int"))
    out = out.select((F.col("id") - base).alias("id"), "generation", "sex", shift("mother"), shift("father"), shift("twin"), (F.col("household_id") - base).alias("household_id"), *[c for c in PEDIGREE if c[-1] in "12"])
    return assert_schema(out, PEDIGREE, "simulation")


def quantile_normal(df: DataFrame, column: str, out: str = "score") -> DataFrame:
    """Normal scores of the ranks."""
    return rank_score(df, F.col(column), "_q").withColumn(out, ndtri(F.col("_q"))).drop("_q", "_q_rank")


def expected_mate_correlation(r1: float, r2: float, within: float) -> list[list[float]]:
    """Mates' 2x2 correlations: as asked on the diagonal; with one trait only, what its correlation with the other brings."""
    if r1 and r2:
        cross = within * math.copysign(math.sqrt(abs(r1 * r2)), r1 * r2)
    else:
        cross = within * (r1 or r2)
    return [[r1 or r2 * within**2, cross], [cross, r2 or r1 * within**2]]
