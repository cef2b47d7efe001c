"""Pairs found once by families against the joins that look for each code and keep the closest."""

import random

import pytest
from pyspark.sql import functions as F

from lineagelake.operators import close_kin, relatives

PED = "id long, generation int, mother long, father long, twin long, sex int, x1 double"


def tangled(seed, n=150):
    """Parents of any age and relation, full-sib matings, twins, unknown and absent parents."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        known = i >= 8
        mother = rng.choice([-1, 10_000, *[rng.randrange(max(0, i - 30), i)] * 12]) if known else -1
        father = rng.choice([-1, *[rng.randrange(max(0, i - 30), i)] * 12]) if known else -1
        if rows and known and rng.random() < 0.5:  # a sibling, full or half
            other = rng.choice(rows[-8:])
            mother, father = (other[2], other[3]) if rng.random() < 0.6 else (other[2], father) if rng.random() < 0.5 else (mother, other[3])
        rows.append([i, 0, mother, father, -1, i % 2, float(i)])
    for i in range(10, n - 1, 9):
        rows[i + 1][2:4] = rows[i][2:4]
        rows[i][4], rows[i + 1][4] = i + 1, i
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("seed, light", [(1, 64), (2, 64), (3, 1)])
def test_close_pairs_equal_the_closest_codes(spark, monkeypatch, seed, light):
    monkeypatch.setattr(close_kin, "LIGHT", light)
    monkeypatch.setattr(relatives, "HEAVY", 512 if light > 1 else 2)
    ped = spark.createDataFrame(tangled(seed), PED)
    want = sorted(map(tuple, relatives.extract_pairs(ped, 3, codes=close_kin.CLOSE).collect()))
    found = close_kin.close_pairs(ped, ("x1",)).collect()
    assert sorted((r.rel, r.id1, r.id2) for r in found) == want
    assert {r[0] for r in want} == set(close_kin.CLOSE)
    assert all(r.p1.id == r.id1 and r.p2.x1 == r.id2 for r in found)


def test_no_pair_is_shuffled(spark):
    """Grouping pairs by code is the only exchange above the joins: neither ends nor closest codes are looked up."""
    ped = spark.createDataFrame(tangled(4), PED)
    plan = close_kin.close_pairs(ped, ("x1",))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan
    assert close_kin.close_pairs(ped.limit(0), ("x1",)).count() == 0
    assert relatives.extract_pairs(ped, 2, sample=ped.filter(F.col("id") < 60)).filter("id1 >= 60 or id2 >= 60").isEmpty()


def test_far_pairs_are_counted_without_sorting_them(spark):
    ped = spark.createDataFrame(tangled(5, 60), PED)
    plan = relatives.extract_pairs(ped, 5)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
