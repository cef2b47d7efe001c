"""Operators on small hand-made tables and by their properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineagelake import config
from lineagelake.functions import hazards, mathx, rng, tetrachoric
from lineagelake.operators import compare, correlations, family, genes, incidence, kinship, phenotypes, relatives, sampling, schema, simulate, validate
from lineagelake.operators.censor import age_censor, apply_censoring
from lineagelake.sources import io

PED = "id long, generation int, sex int, mother long, father long, twin long"


@pytest.fixture(scope="module")
def ped(spark):
    # two founder couples, two full sibs (2, 3 with 4, 5 as their mates), a half sib, MZ twins, cousins
    rows = [
        (0, 0, 0, -1, -1, -1), (1, 0, 1, -1, -1, -1), (4, 0, 0, -1, -1, -1), (5, 0, 1, -1, -1, -1), (6, 0, 0, -1, -1, -1),
        (2, 1, 1, 0, 1, -1), (3, 1, 0, 0, 1, -1), (7, 1, 0, 6, 1, -1),
        (8, 2, 0, 4, 2, -1), (9, 2, 1, 3, 5, -1), (10, 2, 0, 3, 5, 11), (11, 2, 0, 3, 5, 10),
        (12, 3, 1, 8, 9, -1),
    ]
    return spark.createDataFrame(rows, PED)


def pairs_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.rel, set()).add((r.id1, r.id2))
    return out


def test_relatives_of_a_small_pedigree(ped):
    got = pairs_of(relatives.extract_pairs(ped, 2))
    assert got["MZ"] == {(10, 11)} and got["FS"] == {(2, 3), (9, 10), (9, 11)} and got["PHS"] == {(2, 7), (3, 7)} and "MHS" not in got
    assert got["1C"] == {(8, 9), (8, 10), (8, 11)} or got["1C"] == {(8, 10), (8, 11), (8, 9)}
    assert (8, 0) in got["GP"] and (12, 3) in got["GP"] and (3, 8) in got["Av"] and (2, 9) in got["Av"]
    assert set(got) <= set(relatives.CODES)
    half = pairs_of(relatives.extract_pairs(ped, 2, sample=ped.filter("id in (8, 9, 0)")))
    assert half == {"1C": {(8, 9)}, "GP": {(8, 0), (9, 0)}}
    with pytest.raises(ValueError):
        relatives.extract_pairs(ped, 6)


def test_kinship_and_inbreeding(ped):
    k = {(r.i, r.j): r.k for r in kinship.kinship(ped).collect()}
    assert k[(0, 0)] == 0.5 and k[(2, 3)] == 0.25 and k[(2, 7)] == 0.125 and k[(8, 9)] == 0.0625 and k[(10, 11)] == 0.5 and (0, 1) not in k
    f = {r.id: r.f for r in kinship.inbreeding(ped).collect()}
    assert f[12] == 0.0625 and f[8] == 0


def test_effective_sizes_of_a_random_population(spark):
    r = np.random.RandomState(1)
    rows, n = [(i, 0, i % 2, -1, -1, -1) for i in range(60)], 60
    for g in range(1, 7):
        rows += [(g * n + i, g, i % 2, (g - 1) * n + 2 * r.randint(n // 2), (g - 1) * n + 2 * r.randint(n // 2) + 1, -1) for i in range(n)]
    got = {r.estimator: r.ne for r in kinship.effective_sizes(spark.createDataFrame(rows, PED)).collect()}
    assert len(got) == 8 and all(v and 25 < v < 160 for k, v in got.items() if k != "long_term_contributions")


def test_age_windows(spark):
    df = spark.createDataFrame([(10.0,), (5.0,), (30.0,)], "t double").select(*age_censor(F.col("t"), F.lit(20.0), F.lit(60.0)))
    assert [tuple(r) for r in df.collect()] == [(20.0, True), (20.0, True), (30.0, False)]
    out = apply_censoring(spark.createDataFrame([(0, 50.0, 90.0, 40.0), (1, 30.0, 30.0, 60.0)], "generation int, t1 double, t2 double, death_age double"), {0: (0, 80)}, 80).collect()
    assert [(r.t_observed1, r.affected1, r.death_censored1) for r in out] == [(40.0, False, True), (30.0, True, False)]


def test_mortality_rates(spark):
    got = incidence.mortality(spark.createDataFrame([(v,) for v in (5.0, 15.0, 25.0, 35.0, 95.0)], "death_age double"), 50).orderBy("bin").collect()
    assert [round(r.rate, 3) for r in got] == [0.2, 0.25, 0.333, 0.5, 0.0] and got[0].age == "0-9"


def test_family_sizes(spark):
    rows = [(i, 100, 103, 0) for i in range(2)] + [(i, 101, 104, 1) for i in range(2, 4)] + [(i, 102, 105, 0) for i in range(4, 7)] + [(i, -1, -1, i % 2) for i in range(100, 106)]
    s = family.family_size_summary(spark.createDataFrame(rows, "id long, mother long, father long, sex int")).first()
    assert (s.n_families, s.median, s.size_2, s.with_full_sib) == (3, 2.0, pytest.approx(2 / 3), 1.0)


def test_schema_stage(spark):
    @schema.stage(reads={"a": "i"}, writes={"b": "f"})
    def double(df):
        return df.withColumn("b", F.col("a") * 2.0)

    assert double(spark.range(2).withColumnRenamed("id", "a")).count() == 2 and double.stage_name == "double"
    for bad in (spark.range(1), spark.createDataFrame([("x",)], "a string")):
        with pytest.raises(ValueError):
            double(bad)


def test_normal_functions(spark):
    from statistics import NormalDist

    p = [1e-9, 0.001, 0.02, 0.3, 0.5, 0.77, 0.99, 1 - 1e-7]
    got = spark.createDataFrame([(x,) for x in p], "p double").select(mathx.ndtri(F.col("p"))).collect()
    assert [r[0] for r in got] == pytest.approx([NormalDist().inv_cdf(x) for x in p], rel=1e-6, abs=1e-8)
    x = [-6.0, -1.5, -0.1, 0.0, 0.4, 3.0, 7.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(mathx.erfc(F.col("x"))).collect()
    assert [r[0] for r in got] == pytest.approx([math.erfc(v) for v in x], rel=1e-10)
    assert spark.range(5).select(F.lit(1.0).alias("x"), F.col("id").cast("double").alias("y")).agg(mathx.safe_corr(F.col("x"), F.col("y"))).first()[0] is None


@pytest.mark.parametrize("name,params", [("weibull", {"scale": 50, "rho": 2}), ("exponential", {"rate": 0.02}), ("gompertz", {"rate": 0.001, "gamma": 0.07}), ("lognormal", {"mu": 4, "sigma": 0.5}), ("loglogistic", {"scale": 60, "shape": 3}), ("gamma", {"shape": 3.0, "scale": 20})])
def test_hazards_invert(spark, name, params):
    t = spark.range(2, 100, 7).select(F.col("id").cast("double").alias("t"))
    out = t.withColumn("h", hazards.terms(name, F.col("t"), **params)[1]).withColumn("back", hazards.invert(name, F.col("h"), **params))
    for r in out.collect():
        assert r.back == pytest.approx(r.t, rel=1e-4)
    eps = 1e-4
    d = t.select("t", hazards.terms(name, F.col("t"), **params)[0].alias("l"), ((hazards.terms(name, F.col("t") + eps, **params)[1] - hazards.terms(name, F.col("t") - eps, **params)[1]) / (2 * eps)).alias("d"))
    for r in d.collect():
        assert math.exp(r.l) == pytest.approx(r.d, rel=1e-3)


def test_tetrachoric_recovers():
    r = np.random.RandomState(3)
    x = r.multivariate_normal([0, 0], [[1, 0.5], [0.5, 1]], 40000)
    a, b = x[:, 0] > 1, x[:, 1] > 0.5
    est, se = tetrachoric.fit((a & b).sum(), (a & ~b).sum(), (~a & b).sum(), (~a & ~b).sum())
    assert abs(est - 0.5) < 3 * se and 0 < se < 0.03
    assert math.isnan(tetrachoric.fit(0, 0, 5, 5)[0])


def test_random_columns_do_not_depend_on_partitions(spark):
    df = spark.range(2000).select("id", rng.normal("x", F.col("id")).alias("z"), rng.uniform("y", F.col("id")).alias("u"))
    assert sorted(df.collect()) == sorted(df.repartition(7).collect())
    m = df.agg(F.avg("z"), F.stddev("z"), F.min("u"), F.max("u")).first()
    assert abs(m[0]) < 0.1 and abs(m[1] - 1) < 0.1 and 0 < m[2] and m[3] < 1


def test_sampling_sizes(spark):
    people = spark.range(200).select("id", (F.col("id") % 10 == 0).alias("affected1"))
    assert sampling.run_sample(people, 50).count() == 50 and sampling.run_sample(people, 0).count() == 200
    assert sampling.run_sample(people, 500, 0).count() == 200 and sampling.run_sample(people, 190, 0).filter("affected1").count() == 0
    assert sampling.run_sample(people, 40, 50.0).filter("affected1").count() > 10
    with pytest.raises(ValueError):
        sampling.run_sample(people, 5, -1)


def test_dropout_severs_links(ped):
    out = sampling.run_dropout(ped, 0.3)
    ids = {r.id for r in out.collect()}
    assert len(ids) == 13 - round(13 * 0.3)
    assert all(v == -1 or v in ids for r in out.collect() for v in (r.mother, r.father, r.twin))


def test_simulation_passes_its_validation(spark):
    p = simulate.Parameters(n=600, generations=2, burn_in=1, C=(0.2, 0.2))
    people = simulate.run_simulation(spark, p)
    checks = validate._union([validate.structural(people), validate.twins(people, p.p_mztwin), validate.population(people, p.n)])
    assert checks.filter("not passed").collect() == []
    v = people.filter("generation = 1").agg(F.var_samp("A1"), F.var_samp("C1"), F.var_samp("E1")).first()
    assert [round(x, 1) for x in v] == pytest.approx([0.5, 0.2, 0.3], abs=0.11)


def test_assortative_mating(spark):
    p = simulate.Parameters(n=2000, generations=2, assort=(0.5, 0.0))
    r = correlations.mate_correlations(simulate.run_simulation(spark, p)).first()
    assert abs(r.m1_f1 - 0.5) < 0.12


@pytest.mark.parametrize("name", sorted(phenotypes.MODELS))
def test_models_give_ages(spark, name):
    people = spark.range(2000).select("id", F.lit(0).alias("generation"), (F.col("id") % 2).cast("int").alias("sex"), rng.normal("L", F.col("id")).alias("liability1"))
    extra = {"params": {"drift": -0.1, "shape": 30.0}} if name == "first_passage" else {"params": {"scale": 60.0, "rho": 2.0}} if "frailty" in name else {}
    extra |= {} if name in ("frailty", "first_passage") else {"prevalence": 0.2}
    out = phenotypes.make_model(name, **extra).onset(people, 1, 42)
    r = out.agg(F.count("t1"), F.min("t1"), F.corr("liability1", "t1"), F.avg((F.col("t1") < 1e6).cast("double"))).first()
    assert r[0] == 2000 and r[1] > 0 and r[2] < 0 and (abs(r[3] - 0.2) < 0.05 or name in ("frailty", "first_passage"))


def test_genetic_values_add_up_and_rescale(spark):
    geno = spark.createDataFrame([(1, s, i, (s * i) % 3) for s in range(8) for i in range(30)], "CHR long, site_id long, individual long, dosage long")
    eff = geno.select("CHR", "site_id").distinct().withColumns({"trait_id": F.lit(0), "effect_size": F.col("site_id") * 0.1})
    gv = genes.genetic_values(geno, eff)
    assert {r.individual: round(r.genetic_value, 9) for r in gv.collect()} == {i: round(sum(0.1 * s * ((s * i) % 3) for s in range(8)), 9) for i in range(30)}
    assert genes.rescale(gv, 0.4).agg(F.var_pop("genetic_value"), F.avg("genetic_value")).first() == (pytest.approx(0.4), pytest.approx(0, abs=1e-9))
    with pytest.raises(ValueError):
        genes.rescale(gv.withColumn("genetic_value", F.lit(1.0)), 1)
    assert genes.fingerprint(gv) == genes.fingerprint(gv.repartition(3))


def test_gene_drop_is_mendelian(spark, ped):
    sites = spark.createDataFrame([(1, s, 0.3) for s in range(6)], "CHR long, site_id long, r double")
    first = ped.filter("generation = 0").select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("strand")).crossJoin(sites.drop("r")).withColumn("allele", (F.col("id") * 2 + F.col("strand")).cast("int"))
    own = {}
    for r in genes.gene_drop(ped, first, sites).collect():
        own.setdefault((r.id, r.site_id), {})[r.strand] = r.allele
    for p in ped.collect():
        for s in range(6):
            if p.mother >= 0:
                assert own[(p.id, s)][0] in own[(p.mother, s)].values() and own[(p.id, s)][1] in own[(p.father, s)].values()


def test_config_and_documents(spark, tmp_path):
    p = config.resolve({"pedigree": {"trait1": {"A": 0.3}}, "N": 500})
    assert p["A1"] == 0.3 and p["N"] == 500 and p["censor_age"] == 80 and p["G_burn"] == 2 and config.run_parameters(p, 1)["seed"] == 43
    for bad in ({"nope": 1}, {"phenotype": {"trait1": {"model": "adult"}}}, {"pedigree": {"trait1": {"E": None}}}):
        with pytest.raises(ValueError):
            config.resolve(bad)
    assert simulate.per_generation({0: 1.0, 2: 3.0}, 4) == [1.0, 1.0, 3.0, 3.0]
    people = spark.createDataFrame([(1, 0.123456, 2.0)], "id long, A1 double, liability1 double")
    io.save_parquet(people, f"{tmp_path}/p.parquet")
    assert dict(spark.read.parquet(f"{tmp_path}/p.parquet").dtypes) == {"id": "int", "A1": "float", "liability1": "double"}
    out = io.parquet_to_tsv(spark, f"{tmp_path}/p.parquet")
    assert out.endswith("p.tsv.gz") and spark.read.option("sep", "\t").option("header", True).csv(out).first().A1 == "0.1235"
    import os

    os.makedirs(f"{tmp_path}/results/f/s/rep1")
    with open(f"{tmp_path}/results/f/s/rep1/validation.json", "w") as f:
        f.write('{"twins": {"rate": {"observed": 0.5}}}')
    r = io.gather(spark, f"{tmp_path}/results/*/*/*/validation.json", ["twins.rate.observed"]).first()
    assert (r.folder, r.scenario, r.rep, r.twins_rate_observed) == ("f", "s", 1, 0.5)
    assert io.migrate_prevalence({"phenotype": {"trait1": {"model": "adult", "prevalence": 0.1}}})["phenotype"]["trait1"]["params"] == {"prevalence": 0.1}


def test_compare(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, float("nan")), ("b", 1, 2.0)], "scenario string, rep int, value double")
    assert {r.scenario: (r.mean, r.low, r.high, r.n_reps) for r in compare.envelope(df, ["scenario"]).collect()} == {"a": (2.0, 1.0, 3.0, 2), "b": (2.0, 2.0, 2.0, 1)}
    assert {r.cell for r in compare.mean_sd_table(df, ["scenario"]).collect()} == {"2.0000 ± 1.4142", "2.0000"}


# whole tables in registered queries

SMALL = "/root/testdata/sf0.001"


def test_inbreeding_of_the_whole_pedigree(spark):
    import __spark_entry__ as entry
    from lineagelake.sources import fixture

    people = sorted(fixture.pedigree(spark, SMALL).collect(), key=lambda r: r.id)
    k = np.zeros((len(people), len(people)))  # the tabular method, ids in order of generation; founders are unrelated
    for r in people:
        i = r.id
        if r.mother >= 0 and 0 <= r.twin < i:
            k[i, : i + 1] = k[r.twin, : i + 1]
            k[i, i] = k[i, r.twin] = k[r.twin, r.twin]
        else:
            if r.mother >= 0:
                k[i, :i] = (k[r.mother, :i] + k[r.father, :i]) / 2
            k[i, i] = (1 + (k[r.mother, r.father] if r.mother >= 0 else 0)) / 2
        k[:i, i] = k[i, :i]
    want = {}
    for r in people:
        want.setdefault(r.generation, []).append(2 * k[r.id, r.id] - 1)
    got = {r.generation: r for r in entry.queries()["inbreeding_by_generation"](spark, SMALL).collect()}
    assert set(got) == set(want) == set(range(6))
    for g, f in want.items():
        assert got[g].mean_f == pytest.approx(np.mean(f), abs=2e-9) and got[g].n_inbred == sum(x > 0 for x in f)


def test_gene_drop_covers_people_and_sites(spark):
    import __spark_entry__ as entry
    from lineagelake.sources import fixture

    sites = {(r.n_regionkey + 1, r.n_nationkey) for r in spark.read.parquet(f"{SMALL}/nation.parquet").collect()}
    got = entry.queries()["gene_drop_founders"](spark, SMALL).collect()
    assert {(r.CHR, r.site_id) for r in got} == sites and len(got) == len(sites)
    assert {r.n for r in got} == {2 * fixture.pedigree(spark, SMALL).count()} and all(0 <= r.n_alleles <= r.n for r in got)
