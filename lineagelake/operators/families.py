"""Pair statistics of close relatives from family sums: no pair is made, so large families cost their size.

A pair is (x, y) with x the lower id, as in extract_pairs. In a family of m, by id, the k-th member is the lower one of
m - k pairs and the higher one of k - 1, and the products of all pairs are half of the squared sum less the sum of squares.
Maternal half sibs are the pairs of one mother less those of one couple, paternal ones alike. Few pairs have a closer
code: twins, and a child with a parent who is its half sib as well. They are listed and taken off.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineagelake.operators.checkpoints import cut
from lineagelake.operators.correlations import MIN_PAIRS
from lineagelake.operators.ranking import place_in_family

SIBLING_FAMILIES = {"couple": ("mother", "father"), "mother": ("mother",), "father": ("father",)}
SUMS = ("n_pairs", "sx", "sy", "sxx", "syy", "sxy")
FIRST_DEGREE = ("MZ", "MO", "FO", "FS", "MHS", "PHS")


def _listed(people: DataFrame) -> DataFrame:
    """(rel, id1, id2): twins, and children with their known parents, in the order that extract_pairs gives them; each pair once."""
    ids = people.select(F.col("id").alias("id2"))
    twins = people.filter("twin > id").select(F.lit(0).alias("rank"), F.col("id").alias("id1"), F.col("twin").alias("id2"))
    parents = people.select(F.expr("inline(array(struct(1 as rank, id as id1, mother as id2), struct(2 as rank, id as id1, father as id2)))")).filter("id2 >= 0")
    both = twins.unionByName(parents).join(ids, "id2", "left_semi")
    best = both.groupBy(F.least("id1", "id2").alias("lo"), F.greatest("id1", "id2").alias("hi")).agg(F.min(F.struct("rank", "id1", "id2")).alias("b"))
    return best.select(F.element_at(F.array(*map(F.lit, FIRST_DEGREE)), F.col("b.rank") + 1).alias("rel"), "b.id1", "b.id2")


def _sibling_code(a: str, b: str) -> Column:
    """The code that two people would have as siblings; null without a common known parent."""
    same = lambda c: (F.col(f"{a}.{c}") >= 0) & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return F.when(same("mother") & same("father"), "FS").when(same("mother"), "MHS").when(same("father"), "PHS")


def family_sums(people: DataFrame, column: str) -> DataFrame:
    """(rel, trait, n_pairs, sx, sy, sxx, syy, sxy) of MZ, MO, FO, FS, MHS and PHS pairs for `column`1 and `column`2 (not null)."""
    means = people.agg(*[F.avg(F.col(f"{column}{n}").cast("double")) for n in (1, 2)]).first()
    # booleans stay 0 and 1, as their sums are counts
    shift = [0.0 if dict(people.dtypes)[f"{column}{n}"] == "boolean" else (m or 0.0) for n, m in zip((1, 2), means)]
    values = [(F.col(f"{column}{n}").cast("double") - F.lit(s)).alias(f"v{n}") for n, s in zip((1, 2), shift)]
    slim = cut(people.select("id", "mother", "father", "twin", *values))
    traits = lambda *cells: F.inline(F.array(*[F.struct(F.lit(n).alias("trait"), *[c(n) for c in cells]) for n in (1, 2)]))

    def of_families(name: str) -> DataFrame:
        keys = SIBLING_FAMILIES[name]
        placed = place_in_family(slim.filter(" and ".join(f"{k} >= 0" for k in keys)), *keys).select(*keys, "_k", "_m", traits(lambda n: F.col(f"v{n}").alias("v")))
        v, lower, higher = F.col("v"), F.col("_m") - F.col("_k"), F.col("_k") - 1
        own = placed.groupBy(*keys, "trait").agg(
            F.first("_m").alias("m"), F.sum(v * lower).alias("sx"), F.sum(v * higher).alias("sy"), F.sum(v * v * lower).alias("sxx"), F.sum(v * v * higher).alias("syy"),
            ((F.sum(v) * F.sum(v) - F.sum(v * v)) / 2).alias("sxy"),
        )
        pairs = (F.col("m") * (F.col("m") - 1) / 2).cast("long")
        return own.groupBy("trait").agg(F.sum(pairs).alias("n_pairs"), *[F.sum(c).alias(c) for c in SUMS[1:]])

    sums = {name: of_families(name) for name in SIBLING_FAMILIES}
    signed = [sums[name].select(F.lit(rel).alias("rel"), "trait", *[(F.col(c) * sign).alias(c) for c in SUMS]) for rel, name, sign in (("FS", "couple", 1), ("MHS", "mother", 1), ("MHS", "couple", -1), ("PHS", "father", 1), ("PHS", "couple", -1))]

    listed = _listed(slim)
    end = lambda c: slim.select(F.col("id").alias(f"id{c}"), F.struct("mother", "father", "v1", "v2").alias(f"p{c}"))
    ends = cut(listed.join(end(1), "id1").join(end(2), "id2"))
    rows = lambda df, rel, sign: df.select(rel.alias("rel"), F.lit(sign).alias("s"), traits(lambda n: F.col(f"p1.v{n}").alias("x"), lambda n: F.col(f"p2.v{n}").alias("y")))
    # as siblings the lower id comes first
    turned = ends.select(F.when(F.col("id1") < F.col("id2"), F.col("p1")).otherwise(F.col("p2")).alias("p1"), F.when(F.col("id1") < F.col("id2"), F.col("p2")).otherwise(F.col("p1")).alias("p2"))
    off = rows(turned.withColumn("code", _sibling_code("p1", "p2")).filter("code is not null"), F.col("code"), -1)
    x, y, s = F.col("x"), F.col("y"), F.col("s")
    one_by_one = rows(ends, F.col("rel"), 1).unionByName(off).groupBy("rel", "trait").agg(F.sum(s).alias("n_pairs"), F.sum(s * x).alias("sx"), F.sum(s * y).alias("sy"), F.sum(s * x * x).alias("sxx"), F.sum(s * y * y).alias("syy"), F.sum(s * x * y).alias("sxy"))
    every = reduce(DataFrame.unionByName, [*signed, one_by_one])
    return every.groupBy("rel", "trait").agg(*[F.sum(c).alias(c) for c in SUMS]).filter("n_pairs > 0")


def family_correlations(people: DataFrame, column: str = "liability") -> DataFrame:
    """(rel, trait, n_pairs, r) as liability_correlations gives for these codes; 0 without variance, null below MIN_PAIRS."""
    n = F.col("n_pairs").cast("double")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    varied = (vx > 1e-12 * F.greatest(F.lit(1.0), F.col("sxx"))) & (vy > 1e-12 * F.greatest(F.lit(1.0), F.col("syy")))
    r = F.when(F.col("n_pairs") >= MIN_PAIRS, F.when(varied, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy)))).otherwise(0.0))
    return family_sums(people, column).select("rel", "trait", "n_pairs", r.alias("r"))


def family_two_by_two(people: DataFrame, column: str = "affected") -> DataFrame:
    """(rel, trait, n_pairs, n11, n10, n01, n00) as two_by_two gives for these codes."""
    sums = family_sums(people, column)
    both, x, y = (F.round(c).cast("long") for c in ("sxy", "sx", "sy"))
    return sums.select("rel", "trait", "n_pairs", both.alias("n11"), (x - both).alias("n10"), (y - both).alias("n01"), (F.col("n_pairs") - x - y + both).alias("n00"))


def family_pair_counts(people: DataFrame) -> DataFrame:
    """(rel, n_pairs) of MZ, MO, FO, FS, MHS and PHS from family sizes alone."""
    slim = people.select("id", "mother", "father", "twin")
    sizes = lambda keys: slim.filter(" and ".join(f"{k} >= 0" for k in keys)).groupBy(*keys).agg(F.count("*").alias("m")).agg(F.coalesce(F.sum((F.col("m") * (F.col("m") - 1) / 2).cast("long")), F.lit(0)).alias("n"))
    signed = [sizes(SIBLING_FAMILIES[name]).select(F.lit(rel).alias("rel"), (F.col("n") * sign).alias("n")) for rel, name, sign in (("FS", "couple", 1), ("MHS", "mother", 1), ("MHS", "couple", -1), ("PHS", "father", 1), ("PHS", "couple", -1))]
    listed = cut(_listed(slim))
    end = lambda c: slim.select(F.col("id").alias(f"id{c}"), F.struct("mother", "father").alias(f"p{c}"))
    off = listed.join(end(1), "id1").join(end(2), "id2").select(_sibling_code("p1", "p2").alias("rel")).filter("rel is not null")
    parts = [*signed, listed.groupBy("rel").agg(F.count("*").alias("n")), off.groupBy("rel").agg((-F.count("*")).alias("n"))]
    return reduce(DataFrame.unionByName, parts).groupBy("rel").agg(F.sum("n").alias("n_pairs")).filter("n_pairs > 0")
