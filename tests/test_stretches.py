"""Allele counts and genetic values by stretches of the genome: no task holds a forest."""

import pytest

from lineagelake.operators import genome_sweep

EDGES = "parent long, child long, left double, right double"


def test_no_python_task_holds_a_forest(spark):
    edges = spark.createDataFrame([(10, 1, 0.0, 50.0), (11, 1, 50.0, 100.0), (10, 2, 0.0, 100.0), (12, 10, 0.0, 100.0), (12, 11, 20.0, 70.0)], EDGES)
    muts = spark.createDataFrame([(1, 10.0, 10), (2, 60.0, 12), (3, 80.0, 12), (4, 60.0, 12), (4, 60.0, 11), (5, 5.0, 1), (5, 5.0, 2)], "site_id long, position double, node long")
    samples = spark.createDataFrame([(1, 7), (2, 7)], "node long, individual long")
    counts = genome_sweep.allele_counts(edges, muts, samples.select("node"))
    effects = muts.filter("site_id < 4").selectExpr("*", "0 as trait_id", "double(site_id) as effect_size")
    values = genome_sweep.edge_genetic_values(edges, effects, samples)
    assert {r.site_id: r.AC for r in counts.collect()} == {1: 2, 2: 2, 3: 1, 4: 2, 5: 2}
    assert [r.genetic_value for r in values.collect()] == [pytest.approx(1 + 1 + 2 + 2 + 3)]
    for df in (counts, values):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "InArrow" not in plan and "InPandas" not in plan and "Python" not in plan


def test_a_nodes_stretches_become_one_step_function(spark):
    """One child goes where the other comes: above them the count doesn't change, and there is one stretch."""
    parts = spark.createDataFrame([(9, 0.0, 50.0, 1), (9, 50.0, 100.0, 1), (9, 20.0, 30.0, 2), (8, 0.0, 5.0, 1)], "node long, l double, r double, n long")
    got = sorted(tuple(r) for r in genome_sweep._added_up(parts).collect())
    assert got == [(8, 0.0, 5.0, 1), (9, 0.0, 20.0, 1), (9, 20.0, 30.0, 3), (9, 30.0, 100.0, 1)]
