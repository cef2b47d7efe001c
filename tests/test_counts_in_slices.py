"""Pair counts up to degree 5 are taken in slices of people, whose shuffle files go one after another."""

import random

from lineagelake.operators import relatives


def _pedigree(spark):
    rng, rows = random.Random(11), []
    for g in range(6):
        for i in range(40):
            mother, father = ((g - 1) * 40 + 2 * rng.randrange(12), (g - 1) * 40 + 2 * rng.randrange(12) + 1) if g else (-1, -1)
            rows.append((g * 40 + i, mother if rng.random() < 0.95 else -1, father if rng.random() < 0.95 else -1, -1))
    twin = {41: 43, 43: 41, 90: 999}
    return spark.createDataFrame([(i, m, f, twin.get(i, t)) for i, m, f, t in rows] + [(500, 900, 901, -1)], "id long, mother long, father long, twin long")


def _shuffled(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName(): found.apply(i).length() for i in range(found.size()) if found.apply(i).getName().endswith(".data")}


def test_counts_in_slices_equal_those_of_the_pairs_and_leave_no_pairs_on_disk(spark, monkeypatch):
    ped = _pedigree(spark)
    before = _shuffled(spark)
    want = {r.rel: r.n_pairs for r in relatives.count_pairs(relatives.extract_pairs(ped, 5)).collect()}
    of_pairs = sum(n for f, n in _shuffled(spark).items() if f not in before)
    monkeypatch.setattr(relatives, "SLICE", 130)
    monkeypatch.setattr(relatives, "HEAVY", 8)
    before = _shuffled(spark)
    got = {r.rel: r.n_pairs for r in relatives.count_all_pairs(ped).collect()}
    assert got == want and len(want) > 18
    assert sum(n for f, n in _shuffled(spark).items() if f not in before) < of_pairs / 4
