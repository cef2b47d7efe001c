"""Genome sweeps against the tree at each position, and stored results against plain tables."""

import random

import pytest
from pyspark.sql import functions as F

from lineagelake.operators import genes, genome_sweep, stores

EDGES = "parent long, child long, left double, right double"


def random_trees(rng, n_nodes=40, length=100, n_samples=12):
    """Edges where each node has one parent, of a higher number, at a position; some nodes have none for a while."""
    edges = []
    for child in range(n_nodes - 1):
        at = 0.0
        while at < length:
            end = float(min(length, at + rng.choice([1, 5.5, 20, 100])))
            if rng.random() < 0.9:
                edges.append((rng.randrange(child + 1, min(n_nodes, child + 9)), child, at, end))
            at = end
    return edges, sorted(rng.sample(range(n_nodes), n_samples))


def up(edges, node, x):
    """The path from a node to its root at a position."""
    out = [node]
    while (found := [p for p, c, a, b in edges if c == out[-1] and a <= x < b]):
        out.append(found[0])
    return out


@pytest.mark.parametrize("events", [5, 40, 10**6])
def test_sweeps_equal_the_trees(spark, events):
    rng = random.Random(events)
    edges, samples = random_trees(rng)
    sites = [(s, rng.choice([float(rng.randrange(100)), round(rng.random() * 99.9, 2)])) for s in range(60)]
    mutations = [(s, x, rng.randrange(40)) for s, x in sites for _ in range(rng.choice((1, 1, 2, 4)))]
    e, m, s = spark.createDataFrame(edges, EDGES), spark.createDataFrame([*mutations, mutations[0]], "site_id long, position double, node long"), spark.createDataFrame([(i,) for i in samples], "node long")
    got = {r.site_id: r.AC for r in genome_sweep.allele_counts(e, m, s, events).collect()}
    want = {site: sum(any(n in up(edges, i, x) for t, _, n in mutations if t == site) for i in samples) for site, x in sites}
    assert got == want
    assert {r.site_id: r.AC for r in genes.sample_counts(e, m, s).collect()} == want
    effects = [(k, x, rng.randrange(40), k % 2, rng.gauss(0, 1)) for k, (_, x) in enumerate(sites)]
    owners = spark.createDataFrame([(n, i // 2) for i, n in enumerate(samples)] + [(1000, 99)], "node long, individual long")
    values = genome_sweep.edge_genetic_values(e, spark.createDataFrame(effects, "site_id long, position double, node long, trait_id int, effect_size double"), owners, events)
    got = {(r.trait_id, r.individual): r.genetic_value for r in values.collect()}
    for trait in (0, 1):
        for i in {k // 2 for k in range(len(samples))}:
            own = sum(b for _, x, n, t, b in effects if t == trait for node in samples[2 * i : 2 * i + 2] if n in up(edges, node, x))
            assert got.pop((trait, i)) == pytest.approx(own, abs=1e-9)
    assert got == {(0, 99): 0.0, (1, 99): 0.0}


def test_sweeps_of_empty_tables_and_of_no_tree(spark):
    none, m, s = spark.createDataFrame([], EDGES), spark.createDataFrame([(1, 5.0, 3), (2, 5.0, 4)], "site_id long, position double, node long"), spark.createDataFrame([(3,)], "node long")
    assert {r.site_id: r.AC for r in genome_sweep.allele_counts(none, m, s).collect()} == {1: 1, 2: 0}
    assert genome_sweep.allele_counts(none, m.limit(0), s).count() == 0
    odd = spark.createDataFrame([(None, 3, 0.0, 9.0), (7, 3, 5.0, 5.0), (8, 3, 0.0, 6.0)], EDGES)
    assert {r.site_id: r.AC for r in genome_sweep.allele_counts(odd, m.unionByName(m.selectExpr("site_id + 10 as site_id", "position", "8L as node")), s).collect()} == {1: 1, 2: 0, 11: 1, 12: 1}
    two = spark.createDataFrame([(7, 3, 0.0, 9.0), (8, 3, 4.0, 6.0)], EDGES)
    with pytest.raises(Exception, match="two parents"):
        genome_sweep.allele_counts(two, m, s).collect()


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_verify_names_what_differs(spark, buckets):
    schema = "k long, j string, a double, b array<int>"
    golden = [(1, "x", 1.0, [1]), (2, None, None, None), (3, "x", 3.0, []), (3, "x", 3.0, []), (None, "n", 0.0, [2]), (5, "y", 5.0, [5])]
    found = [(1, "x", 1.0, [1]), (2, None, 2.0, [2]), (3, "x", 3.0, []), (None, "n", 0.0, [2]), (5, "z", 5.0, [5])]
    g, f = spark.createDataFrame(golden, schema), spark.createDataFrame(found, schema)
    got = sorted(((r.status, r.k, r.j, r.columns) for r in stores.verify(f, g, ["k", "j"], buckets).collect()), key=str)
    assert got == sorted([("changed", 2, None, ["a", "b"]), ("missing", 3, "x", []), ("missing", 5, "y", []), ("extra", 5, "z", [])], key=str)
    assert stores.verify(g.repartition(5), g, ["k", "j"], buckets).count() == 0 == stores.verify(g.limit(0), g.limit(0), ["k"], buckets).count()
    with pytest.raises(ValueError, match="different columns"):
        stores.verify(f.withColumn("c", F.lit(1)), g, ["k"])


def test_stages_are_made_once_for_the_same_inputs_and_parameters(spark, tmp_path):
    calls = []

    def make(n):
        calls.append(n)
        return spark.range(n)

    inputs = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    first = stores.StageStore(spark, str(tmp_path))
    assert first.stage("numbers", lambda: make(5), {"in": inputs}, {"n": 5}).count() == 5
    second = stores.StageStore(spark, str(tmp_path))
    assert second.stage("numbers", lambda: make(5), {"in": inputs.orderBy(F.desc("i")).repartition(3)}, {"n": 5}).count() == 5
    assert calls == [5] and len(second.read) == 1 and not second.made
    assert second.stage("numbers", lambda: make(6), {"in": inputs}, {"n": 6}).count() == 6
    assert second.stage("numbers", lambda: make(7), {"in": inputs.filter("i = 1")}, {"n": 5}).count() == 7
    assert second.stage("others", lambda: make(8), {"in": inputs}, {"n": 5}).count() == 8
    assert calls == [5, 6, 7, 8]

    def broken():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        second.stage("broken", broken)
    assert second.stage("broken", lambda: make(9)).count() == 9


def test_site_store_is_sorted_numbered_and_read_by_ranges(spark, tmp_path):
    rng = random.Random(9)
    rows = [(c, rng.randrange(5000), k) for k, c in enumerate(rng.choice((1, 1, 2, 22)) for _ in range(3000))]
    store = stores.SiteStore.write(spark.createDataFrame(rows, "CHR int, POS long, x long"), str(tmp_path / "s"), partitions=16)
    ordered = sorted(rows)
    assert sorted((r.number, r.CHR, r.POS, r.x) for r in store.all().collect()) == [(i, *r) for i, r in enumerate(ordered)]
    part = store.between(1, 1000, 1400)
    assert sorted((r.CHR, r.POS, r.x) for r in part.collect()) == [r for r in ordered if r[0] == 1 and 1000 <= r[1] < 1400]
    files = {r[0] for r in part.select(F.input_file_name()).distinct().collect()}
    assert len(files) <= 4
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan and "POS" in plan.split("PushedFilters")[1]
    assert store.between(3, 0, 10).count() == 0
    assert store.at(spark.createDataFrame([(1, ordered[0][1], "q")], "CHR int, POS long, name string")).count() == sum(r[:2] == ordered[0][:2] for r in rows)
    assert stores.SiteStore.write(spark.createDataFrame([], "CHR int, POS long, x long"), str(tmp_path / "e")).all().count() == 0


def test_scenarios_share_a_pedigree(spark, tmp_path):
    from lineagelake.plans.scenario import run_scenario

    base = {"N": 60, "G_ped": 2, "G_sim": 2, "G_pheno": 1}
    store = stores.StageStore(spark, str(tmp_path))
    one = run_scenario(spark, base, store=store)
    two = run_scenario(spark, {**base, "G_pheno": 2, "N": 400, "drop_from": "base"}, store=store, scenarios={"base": base})
    assert len(store.made) == 1 == len(store.read)
    assert stores.verify(two["full"], one["full"], ["id"]).count() == 0
    run_scenario(spark, {**base, "N": 80}, store=store)
    assert len(store.made) == 2
    with pytest.raises(ValueError, match="drop_from"):
        run_scenario(spark, {**base, "drop_from": "nowhere"}, store=store)


def test_a_packed_haplotype_follows_its_parents_strands():
    """A strand is one row, whatever the number of sites: crossovers are summed within chromosomes, no row is made for a site."""
    import pyarrow as pa

    rng = random.Random(3)
    rows = []
    for i in range(40):
        firsts = {0, *rng.sample(range(1, 12), 2)}
        turns = [rng.randrange(2) + (4 + 2 * rng.randrange(2) if k in firsts else 0) for k in range(12)]
        rows.append({"id": i, "strand": i % 2, "part": 0, "one": list(range(12)), "two": list(range(100, 112)), "turns": turns})
    schema = pa.schema([("id", pa.int64()), ("strand", pa.int32()), ("part", pa.int64()), ("one", pa.list_(pa.int32())), ("two", pa.list_(pa.int32())), ("turns", pa.list_(pa.int8()))])
    got = [r for out in genes._follow(iter([pa.RecordBatch.from_pylist(rows[:9], schema=schema), pa.RecordBatch.from_pylist(rows, schema=schema).slice(9)])) for r in out.to_pylist()]
    for row, r in zip(rows, got, strict=True):
        want, at = [], 0
        for k, t in enumerate(row["turns"]):
            at = ((t >> 1 & 1) if t & 4 else at) ^ (t & 1)
            want.append(row[("one", "two")[at]][k])
        assert r["id"] == row["id"] and r["alleles"] == want
