"""Mating targets, effective sizes, validation, configuration routing and the genotype branch on small cases."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineagelake import config
from lineagelake.functions import tetrachoric
from lineagelake.operators import compare, correlations, genes, kinship, ranking, relatives, sampling, simulate, validate
from lineagelake.sources.io import migrate_prevalence


def people(spark, n=4000, r=0.3, seed=1, males=None):
    rng = np.random.RandomState(seed)
    a = rng.normal(0, 1, n)
    b = r * a + math.sqrt(1 - r * r) * rng.normal(0, 1, n)
    males = n // 2 if males is None else males
    rows = [(i, int(i < males), float(a[i]), float(b[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, sex int, liability1 double, liability2 double")


def mates(df, pairs):
    v = {r.id: (r.liability1, r.liability2) for r in df.collect()}
    got = pairs.collect()
    return np.array([[*v[r.mother], *v[r.father]] for r in got]), got


@pytest.mark.parametrize("r1,r2", [(0.4, 0.2), (-0.3, 0.25), (0.6, 0.6)])
def test_mates_correlate_as_asked_on_both_traits(spark, r1, r2):
    p = simulate.Parameters(n=4000, rA=0.3, rC=0.3, rE=0.3, assort=(r1, r2), mating_lambda=0.5)
    df = people(spark)
    m, got = mates(df, simulate.mate(df, p, 1))
    assert len({(r.mother, r.father) for r in got}) == len(got)
    want, se = p.mate_target(p.within()), 1 / math.sqrt(len(m))
    for i, j in itertools.product((0, 1), (0, 1)):
        assert abs(np.corrcoef(m[:, i], m[:, 2 + j])[0, 1] - want[i, j]) < 3 * se + 0.01, (i, j)


def test_mate_matrix_and_impossible_targets(spark):
    given = ((0.3, 0.25), (0.25, 0.1))
    p = simulate.Parameters(n=4000, rA=0.3, rC=0.3, rE=0.3, assort_matrix=given)
    m, _ = mates(df := people(spark), simulate.mate(df, p, 1))
    assert np.abs(np.corrcoef(m.T)[:2, 2:] - np.array(given)).max() < 3 / math.sqrt(len(m)) + 0.01 and p.assort == (0.3, 0.1)
    with pytest.raises(ValueError, match="semidefinite"):
        simulate.Parameters(rA=0.9, rC=0.9, rE=0.9, assort=(0.9, -0.9))
    for bad in (((0.3, 0.1), (0.2, 0.3)), ((1.5, 0), (0, 0.2)), (0.1, 0.2)):
        with pytest.raises(ValueError):
            simulate.Parameters(assort_matrix=bad)
    flat = config.resolve({"pedigree": {"assort_matrix": [[0.3, 0.1], [0.1, 0.2]]}})
    assert flat["assort_matrix"] == [[0.3, 0.1], [0.1, 0.2]] and config.run_parameters(flat)["assort_matrix"] == [[0.3, 0.1], [0.1, 0.2]]


def test_slots_are_trimmed_whatever_the_liability(spark):
    """With far more men than women, the men left out of assorted mating are no worse than the others."""
    df = people(spark, 4000, males=3000)
    p = simulate.Parameters(n=4000, assort=(0.6, 0.0))
    m, got = mates(df, simulate.mate(df, p, 1))
    fathers = {r.father for r in got}
    inside = [r.liability1 for r in df.collect() if r.id in fathers]
    outside = [r.liability1 for r in df.collect() if r.sex == 1 and r.id not in fathers]
    assert len(outside) > 1000 and abs(np.mean(inside) - np.mean(outside)) < 0.15
    assert abs(np.corrcoef(m[:, 0], m[:, 2])[0, 1] - 0.6) < 0.08


def test_repeated_couples_exchange_partners(spark):
    pairs = spark.createDataFrame([(1, 1, 10), (2, 1, 10), (3, 2, 11), (4, 3, 12), (5, 3, 12)], "place long, mother long, father long")
    got = {r.place: (r.mother, r.father) for r in simulate.swapped(pairs).collect()}
    assert got == {1: (1, 10), 2: (1, 11), 3: (2, 10), 4: (3, 12), 5: (3, 12)}


def test_ranks_within_groups(spark):
    rows = [(i, i % 3, float((i * 7) % 10)) for i in range(100)] + [(200, None, 1.0), (201, None, 0.0)]
    got = {r.id: (r.k, r.k_of) for r in ranking.rank_within(spark.createDataFrame(rows, "id long, g int, v double"), "g", F.col("v"), "k").collect()}
    for g in (0, 1, 2, None):
        own = sorted((v, i) for i, h, v in rows if h == g)
        assert [got[i] for _, i in own] == [(k + 1, len(own)) for k in range(len(own))]


def inbred_pedigree(rng, n=14, generations=5):
    rows = [(i, 0, i % 2, -1, -1, -1) for i in range(n)]
    for g in range(1, generations):
        base = (g - 1) * n
        for i in range(n):
            mother, father = base + 2 * rng.randint(n // 2), base + 2 * rng.randint(n // 2) + 1
            rows.append((g * n + i, g, i % 2, int(mother), int(father), -1))
    a, b = 2 * n, 2 * n + 2  # a pair of twins
    rows[b] = (b, 2, 0, rows[a][3], rows[a][4], a)
    rows[a] = (*rows[a][:5], b)
    return rows


def test_inbreeding_of_couples_equals_the_whole_table(spark):
    rows = inbred_pedigree(np.random.RandomState(3))
    ped = spark.createDataFrame(rows, "id long, generation int, sex int, mother long, father long, twin long")
    n = len(rows)
    k = np.zeros((n, n))
    for i, _, _, m, f, t in rows:
        if 0 <= t < i:
            k[i, :i], k[:i, i] = k[t, :i], k[t, :i]
            k[i, i] = k[i, t] = k[t, i] = k[t, t]
            continue
        if m >= 0:
            k[i, :i] = k[:i, i] = (k[m, :i] + k[f, :i]) / 2
        k[i, i] = 0.5 if m < 0 else (1 + k[m, f]) / 2
    want = {i: (k[m, f] if m >= 0 else 0.0) for i, _, _, m, f, _ in rows}
    assert {r.id: r.f for r in kinship.inbreeding(ped).collect()} == pytest.approx(want)
    whole = kinship.kinship(ped)
    assert {r.id: r.f for r in kinship.inbreeding(ped, whole).collect()} == pytest.approx(want)
    got = {(r.i, r.j): r.k for r in whole.collect()}
    assert got == pytest.approx({(i, j): k[i, j] for i in range(n) for j in range(i, n) if k[i, j] > 0})


def test_effective_sizes_and_their_expectations(spark):
    rng = np.random.RandomState(4)
    rows = [(i, 0, i % 2, -1, -1, -1) for i in range(200)]
    for g in range(1, 5):
        for i in range(200):
            rows.append((g * 200 + i, g, i % 2, (g - 1) * 200 + 2 * rng.randint(100), (g - 1) * 200 + 2 * rng.randint(100) + 1, -1))
    ped = spark.createDataFrame([tuple(map(int, r)) for r in rows], "id long, generation int, sex int, mother long, father long, twin long")
    v = [r.ne for r in kinship.family_size_variance(ped).collect()]
    h = [r.ne for r in kinship.hill_overlapping(ped).collect()]
    assert np.mean(v) == pytest.approx(200, rel=0.15) and np.mean(h) == pytest.approx(200, rel=0.15)  # random mating: Ne = N
    same = spark.createDataFrame([(0, 0, 0, -1, -1), (1, 0, 1, -1, -1), (2, 1, 0, 0, 1), (3, 1, 1, 0, 1)], "id long, generation int, sex int, mother long, father long")
    assert [r.ne for r in kinship.family_size_variance(same).collect()] == [None]  # no variance at all: without bound
    goal = kinship.expected_sizes({"N": 1000, "mating_lambda": 0.5, "G_ped": 3})
    assert goal["sex_ratio"] == 1000 and goal["variance_family_size"] == goal["hill_overlapping"] == pytest.approx(734.9, abs=1) and goal["inbreeding"] is None
    assert kinship.expected_sizes({"N": 1000, "mating_lambda": 0.5, "G_ped": 11})["inbreeding"] == pytest.approx(734.9, abs=1)
    assert set(kinship.expected_sizes({"N": 9, "mating_lambda": 1, "assort1": 0.1}).values()) == {None} == set(kinship.expected_sizes(None).values())
    assert kinship.expected_ne_ztp(50, 0) == 50 and not kinship.slopes_reliable(1e9, 1, 1)
    seen = spark.createDataFrame([("sex_ratio", 990.0), ("variance_family_size", 400.0), ("hill_overlapping", None)], "estimator string, ne double")
    checks = {r.name: r.passed for r in validate.effective_size(seen, goal).collect()}
    assert checks["sex_ratio"] and not checks["variance_family_size"] and checks["hill_overlapping"] and len(checks) == 8


def test_validation_holds_falconer_and_mates_to_their_targets(spark):
    p = simulate.Parameters(n=2000, generations=3, C=(0.0, 0.0), E=(0.5, 0.5), rC=0.0, p_mztwin=0.2)
    df = simulate.run_simulation(spark, p)
    checks = {r.name: r for r in validate.heritability(df, {"A1": 0.5, "A2": 0.5}).collect()}
    assert checks["falconer1"].passed and abs(checks["falconer1"].observed - 0.5) < 0.25 and "MZ" in checks["falconer1"].details
    assert not {r.name: r for r in validate.heritability(df, {"A1": 3.0, "A2": 0.5}).collect()}["falconer1"].passed
    assert checks["parent_offspring_A1"].observed == pytest.approx(1, abs=0.1) and checks["parent_offspring_liability2"].observed == pytest.approx(0.5, abs=0.12)
    rows = {r.name: r for r in validate.assortative(df, 0.9, 0.0, 0.0).collect()}
    assert not rows["mate_r1"].passed and rows["mate_r2"].passed and rows["mate_r12"].passed
    assert {r.name for r in validate.half_sibs(df).collect()} == {"half_sib_pair_proportion", "offspring_with_half_sib"}


def test_standardize_routing():
    base = {"phenotype": {"trait1": {"model": "cure_frailty", "params": {"distribution": "weibull", "scale": 100, "rho": 1, "prevalence": 0.1, "standardize_hazard": "per_generation"}}}}
    m = config.phenotype_model(config.resolve(base), 1)
    assert (m.standardize, m.standardize_hazard) == ("global", "per_generation")
    base["phenotype"]["trait1"] = {"model": "frailty", "params": {"distribution": "weibull", "scale": 100, "rho": 1, "standardize_hazard": "none"}}
    assert config.phenotype_model(config.resolve(base), 1).standardize == "none"
    base["phenotype"]["trait1"] = {"model": "adult", "params": {"method": "cox", "prevalence": 0.1, "standardize_hazard": "none"}}
    assert config.phenotype_model(config.resolve(base), 1).standardize == "none"
    base["phenotype"]["trait1"] = {"model": "adult", "params": {"method": "ltm", "prevalence": 0.1, "standardize_hazard": "none"}}
    with pytest.raises(ValueError, match="no hazard"):
        config.resolve(base)


def test_prevalence_moves_only_where_a_model_has_one():
    doc = {"a": {"phenotype": {"trait1": {"model": "adult", "prevalence": 0.1, "params": {"method": "cox"}}, "trait2": {"prevalence": 0.2, "params": {"x": 1}}}}, "trait1": {"prevalence": 0.3}, "b": [{"phenotype": {"trait1": {"model": "cure_frailty", "prevalence": {"female": 0.1, "male": 0.2}}, "trait2": {"model": "other", "prevalence": 0.5}}}]}
    want = {"a": {"phenotype": {"trait1": {"model": "adult", "params": {"method": "cox", "prevalence": 0.1}}, "trait2": {"params": {"x": 1}}}}, "trait1": {"prevalence": 0.3}, "b": [{"phenotype": {"trait1": {"model": "cure_frailty", "params": {"prevalence": {"female": 0.1, "male": 0.2}}}, "trait2": {"model": "other", "prevalence": 0.5}}}]}
    assert migrate_prevalence(doc) == want == migrate_prevalence(want)
    odd = {"phenotype": {"trait1": {"model": "adult", "prevalence": 0.1, "params": "no"}}}
    assert migrate_prevalence(odd) == odd


def test_sample_counts_follow_the_tree_at_the_position(spark):
    edges = spark.createDataFrame([(10, 1, 0, 50), (10, 2, 0, 100), (11, 1, 50, 100), (11, 3, 0, 100), (12, 10, 0, 100), (12, 11, 0, 60)], "parent long, child long, left long, right long")
    mutations = spark.createDataFrame([(1, 10, 12), (2, 70, 12), (3, 10, 10), (4, 70, 11), (5, 10, 3), (6, 10, 99)], "site_id long, position long, node long")
    samples = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    assert {r.site_id: r.AC for r in genes.sample_counts(edges, mutations, samples).collect()} == {1: 3, 2: 1, 3: 2, 4: 2, 5: 1, 6: 0}
    ped = spark.createDataFrame([(0, 0, -1, -1), (1, 0, -1, -1), (2, 1, 0, 1)], "id long, generation int, mother long, father long")
    assert sorted(tuple(r) for r in genes.pedigree_tables(ped, 2, 1).collect()) == [(0, 1, False, None, None), (1, 1, False, None, None), (2, 0, True, 0, 1)]
    with pytest.raises(ValueError):
        genes.pedigree_tables(ped, 2, 3)


def test_tetrachoric_recovers_the_correlation_and_has_ends():
    for r in (-0.7, 0.0, 0.35, 0.9):
        h, k = 0.8, 1.2
        p11 = tetrachoric.bvn_upper(h, k, r)
        p1, p2 = (0.5 * math.erfc(x / math.sqrt(2)) for x in (h, k))
        cells = [1e6 * p for p in (p11, p1 - p11, p2 - p11, 1 - p1 - p2 + p11)]
        assert tetrachoric.fit(*cells)[0] == pytest.approx(r, abs=1e-6)
    assert tetrachoric.fit(0, 5, 5, 90)[0] == pytest.approx(-0.999) and math.isnan(tetrachoric.fit(0, 0, 5, 90)[0])


def test_codes_limit_the_search_but_not_the_result(spark):
    ped = spark.createDataFrame(inbred_pedigree(np.random.RandomState(5)), "id long, generation int, sex int, mother long, father long, twin long")
    whole = relatives.extract_pairs(ped, 3)
    for codes in (("MZ",), ("FS", "1C"), ("GGP",)):
        assert sorted(map(tuple, relatives.extract_pairs(ped, 3, codes=codes).collect())) == sorted(map(tuple, whole.filter(F.col("rel").isin(*codes)).collect()))
    assert relatives.extract_pairs(ped, 2, codes=("GGP",)).count() == 0


def test_same_person_needs_enough_people(spark):
    rows = [(i, g, (i % 5) == 0, (i % 4) == 0) for g, n in ((0, 90), (1, 80), (2, 20)) for i in range(n)]
    df = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "id long, generation int, affected1 boolean, affected2 boolean")
    got = {r.generation: (r.n_pairs, r.r) for r in correlations.same_person_by_generation(df).collect()}
    assert set(got) == {1, 2} and got[1][0] == 80 and got[1][1] is not None and got[2] == (20, None)
    reps = {k: people(spark, 40).withColumns({"mother": F.lit(-1), "father": F.lit(-1)}) for k in (0, 1)}
    assert compare.mate_matrix(reps).first().n_reps == 2


def test_sample_of_each_generation(spark):
    df = spark.createDataFrame([(i, i // 50, -1 if i < 50 else i - 50, -1) for i in range(150)], "id long, generation int, mother long, father long")
    got = sampling.sample_with_parents(df, 10).collect()
    assert {g: sum(r.generation == g for r in got) for g in (0, 1, 2)}[2] == 10 and len(got) <= 50


def test_daily_onsets_of_a_stream_equal_the_batch(spark, tmp_path):
    from lineagelake.streaming.incidence_stream import daily_onsets

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = daily_onsets(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("onsets").outputMode("complete").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("onsets").collect())) == sorted(map(tuple, daily_onsets(events).collect()))
