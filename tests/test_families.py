"""Close relatives from family sums and heavy families in blocks, against plain pairs; kinship of lists; distributed selection."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lineagelake.operators import correlations, families, kinship, relatives, sampling

PED = "id long, generation int, sex int, mother long, father long, twin long, liability1 double, liability2 double, affected1 boolean, affected2 boolean"


def odd_pedigree(rng, n=260):
    """Unknown parents, parents outside the table, twins, children of a parent with its own child."""
    rows = []
    for i in range(n):
        g = min(4, i // (n // 5))
        older = range(0, g * (n // 5))
        pick = lambda share: rng.choice([x for x in older if x % 2 == share] or [-1]) if g and rng.random() < 0.9 else rng.choice([-1, 10_000])  # noqa: E731,B023
        mother, father = pick(0), pick(1)
        if g and rng.random() < 0.4:
            mother, father = 2 * (i % 3) + (g - 1) * (n // 5) // 2 * 2, 1
        rows.append([i, g, i % 2, mother, father, -1])
    rows[150][3:5] = rows[151][3:5] = [4, 1]
    rows[150][5], rows[151][5] = 151, 150
    rows[160][3:5] = rows[170][3:5] = [6, 3]
    rows[160][5] = 170  # named from one side only
    rows[200][3:5], rows[230][3:5] = [4, 3], [4, 200]  # the father of 230 is its half sib
    return [(*r, rng.gauss(0, 1), rng.gauss(5, 2), rng.random() < 0.3, rng.random() < 0.6) for r in rows]


def as_dict(df, keys=2):
    return {tuple(r)[:keys]: tuple(r)[keys:] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_family_sums_equal_pairs(spark, seed):
    people = spark.createDataFrame(odd_pedigree(random.Random(seed)), PED)
    pairs = relatives.extract_pairs(people, 1)
    counts = {r.rel: r.n_pairs for r in relatives.count_pairs(pairs).collect()}
    assert {r.rel: r.n_pairs for r in families.family_pair_counts(people).collect()} == counts and set(counts) == set(families.FIRST_DEGREE)
    want, got = as_dict(correlations.liability_correlations(people, pairs)), as_dict(families.family_correlations(people))
    assert set(want) == set(got)
    assert all(got[k][0] == n and got[k][1] == pytest.approx(r, abs=1e-9) for k, (n, r) in want.items())
    cells = correlations.two_by_two(correlations.pair_values(people, pairs, "affected"), ["rel", "trait"])
    assert as_dict(families.family_two_by_two(people)) == as_dict(cells)
    plan = families.family_correlations(people)._jdf.queryExecution().optimizedPlan().toString()
    assert "id1" not in plan.split("Aggregate", 1)[0]


def test_families_of_an_empty_table_and_without_variance(spark):
    people = spark.createDataFrame([(i, 0, 0, 100, 101, -1, 1.0, 2.0, True, False) for i in range(8)], PED)
    assert as_dict(families.family_correlations(people)) == {("FS", 1): (28, 0.0), ("FS", 2): (28, 0.0)}
    assert families.family_pair_counts(people.limit(0)).count() == 0 == families.family_sums(people.limit(0), "affected").count()


@pytest.mark.parametrize("degree", [1, 2, 4])
def test_heavy_parents_in_blocks_give_the_same_pairs(spark, monkeypatch, degree):
    people = spark.createDataFrame(odd_pedigree(random.Random(3)), PED)
    want = Counter(tuple(r) for r in relatives.extract_pairs(people, degree).collect())
    monkeypatch.setattr(relatives, "HEAVY", 3)
    monkeypatch.setattr(relatives, "BLOCK", 2)
    assert Counter(tuple(r) for r in relatives.extract_pairs(people, degree).collect()) == want


def test_a_father_of_ten_thousand(spark):
    """His children's pairs come from many join keys of bounded size, and sums of them cost his family's size."""
    n = 10_000
    kids = spark.range(n).select((F.col("id") + 10).alias("id"), F.lit(1).alias("generation"), F.lit(0).alias("sex"), F.lit(-1).cast("long").alias("mother"), F.lit(1).cast("long").alias("father"), F.lit(-1).cast("long").alias("twin"))
    heavy = relatives.heavy_parents(kids)
    assert [r.parent for r in heavy.collect()] == [1]
    blocks = relatives._in_blocks(kids.select("id", F.col("father").alias("parent"), F.col("mother").alias("other"), "twin"))
    dealt = blocks.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in dealt) == n * (n - 1) // 2
    assert len(dealt) == 1 or max(r.n for r in dealt) < 0.5 * n * (n - 1) / 2
    assert {r.rel: r.n_pairs for r in families.family_pair_counts(kids).collect()} == {"PHS": n * (n - 1) // 2}


def test_kinship_of_a_list_and_means_equal_the_whole_table(spark):
    rng = random.Random(4)
    rows, n = [], 24
    for i in range(5 * n):
        g = i // n
        m, f = (-1, -1) if g == 0 else ((g - 1) * n + 2 * rng.randrange(6), (g - 1) * n + 2 * rng.randrange(6) + 1)
        if g == 3 and i % n == 5:
            f = -1
        rows.append([i, g, i % 2, m, f, -1])
    for a, b in ((30, 31), (60, 64), (100, 101)):
        rows[b][3:5] = rows[a][3:5]
        rows[a][5], rows[b][5] = b, a
    ped = spark.createDataFrame([tuple(r) for r in rows], "id long, generation int, sex int, mother long, father long, twin long")
    k = {(r.i, r.j): r.k for r in kinship.kinship(ped).collect()}
    pairs = spark.createDataFrame([(i, j, "x") for i in range(40, 120) for j in range(i % 7, 120, 7)], "id1 long, id2 long, k string")
    for r in kinship.pair_kinship(ped, pairs).collect():
        assert r.kinship == pytest.approx(k.get((min(r.id1, r.id2), max(r.id1, r.id2)), 0.0))
    assert {r.id: r.f for r in kinship.inbreeding(ped).collect()} == pytest.approx({r[0]: 2 * k[(r[0], r[0])] - 1 for r in rows})
    for r in kinship.mean_coancestry(ped).collect():
        ids = [x[0] for x in rows if x[1] == r.generation]
        both = [k.get((i, j), 0.0) for i in ids for j in ids if i < j]
        own = [k[(i, i)] for i in ids]
        assert r.theta == pytest.approx(sum(both) / len(both)) and r.group == pytest.approx((2 * sum(both) + sum(own)) / len(ids) ** 2)
    assert kinship.mean_coancestry(ped.limit(0)).count() == 0


@pytest.mark.parametrize("bins", [2, 7, 4096])
def test_nth_smallest_among_ties(spark, monkeypatch, bins):
    monkeypatch.setattr(sampling, "BINS", bins)
    rng = random.Random(bins)
    values = [rng.choice([0.5, 1.25, rng.random(), rng.random() * 1e-9, -3.0, 1e15]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    for n in (1, 2, 199, 399, 400):
        value, place = sampling.nth_smallest(df, "v", n)
        assert value == sorted(values)[n - 1] and place == n - sum(v < value for v in values)
        got = sorted(r.id for r in sampling.smallest(df, F.col("v"), n).collect())
        assert got == sorted(i for v, i in sorted((v, i) for i, v in enumerate(values))[:n])
    assert sampling.nth_smallest(df, "v", 401) is None and sampling.smallest(df, F.col("v"), 401).count() == 400 and sampling.smallest(df, F.col("v"), 0).count() == 0
    plan = sampling.smallest(df, F.col("v"), 300)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan
