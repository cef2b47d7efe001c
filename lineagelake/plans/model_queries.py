"""Queries on sampling, phenotype models, hazards, scores, genetic values, kinship and validation."""

from __future__ import annotations

import math
import uuid
from statistics import NormalDist

from pyspark.sql import functions as F

from lineagelake.functions import hazards, rng
from lineagelake.functions.mathx import liability_scale, ndtri, norm_cdf
from lineagelake.operators import compare, genes, genome_sweep, kinship, phenotypes, relatives, sampling, simulate, stores, validate
from lineagelake.operators.checkpoints import shared_folder
from lineagelake.plans.registry import SQL, ndtri_sql, phi_sql, query
from lineagelake.sources import fixture as fx

LIAB = f"WITH {fx.SQL_LIAB} "
CENS = f"WITH {fx.SQL_CENS} "
D = lambda x: f"CAST({x!r} AS DOUBLE)"


def _round(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


def _liab(spark, sf_dir):
    return fx.liabilities(fx.pedigree(spark, sf_dir))


def _z(k):
    return NormalDist().inv_cdf(1 - k)


# thresholds


def _z_sql(mode: str, n: int) -> str:
    over = "(PARTITION BY generation)" if mode == "per_generation" else "()"
    return f"(liability{n} - avg(liability{n}) OVER {over}) / stddev_pop(liability{n}) OVER {over}"


def _gen_case(values: dict) -> str:
    return "CASE " + " ".join(f"WHEN generation >= {g} THEN {D(v)}" for g, v in sorted(values.items(), reverse=True)) + " END"


_K2 = {g: _z(k) for g, k in fx.PREVALENCE[2].items()}
_K1 = {g: _z(k) for g, k in fx.PREVALENCE[1].items()}
_THRESHOLDS = {
    "pheno_threshold_global": ("global", 0.1, 0.2, D(_z(0.1)), D(_z(0.2))),
    "pheno_threshold_per_generation": ("per_generation", fx.PREVALENCE[1], fx.PREVALENCE[2], _gen_case(_K1), _gen_case(_K2)),
    "pheno_threshold_by_sex": ("global", {"female": 0.08, "male": 0.12}, {"female": 0.25, "male": 0.15}, f"CASE WHEN sex = 0 THEN {D(_z(0.08))} ELSE {D(_z(0.12))} END", f"CASE WHEN sex = 0 THEN {D(_z(0.25))} ELSE {D(_z(0.15))} END"),
}
for _name, (_mode, _k1, _k2, _s1, _s2) in _THRESHOLDS.items():

    def _thr(spark, sf_dir, mode=_mode, k1=_k1, k2=_k2):
        return phenotypes.run_threshold(_liab(spark, sf_dir), k1, k2, 3, mode).select("id", "affected1", "affected2")

    query(_name, LIAB + f", last AS (SELECT * FROM liab WHERE generation >= 3), z AS (SELECT *, {_z_sql(_mode, 1)} AS z1, {_z_sql(_mode, 2)} AS z2 FROM last) SELECT id, z1 >= {_s1} AS affected1, z2 >= {_s2} AS affected2 FROM z")(_thr)


# models with ages

_BASE = {
    "weibull": {"scale": 2160.0, "rho": 0.8}, "exponential": {"rate": 0.002}, "gompertz": {"rate": 0.0005, "gamma": 0.06}, "lognormal": {"mu": 4.5, "sigma": 0.6}, "loglogistic": {"scale": 90.0, "shape": 3.0},
}


def _h_sql(name: str, h: str) -> str:
    p = {k: D(v) for k, v in _BASE[name].items()}
    clamp = lambda x: f"least(1e6, greatest(1e-10, {x}))"
    return {
        "weibull": lambda: f"{p['scale']} * exp(ln({h}) / {p['rho']})", "exponential": lambda: clamp(f"{h} / {p['rate']}"),
        "gompertz": lambda: clamp(f"ln(1 + {h} * {p['gamma']} / {p['rate']}) / {p['gamma']}"), "loglogistic": lambda: clamp(f"{p['scale']} * exp(ln(exp({h}) - 1) / {p['shape']})"),
    }[name]()


def _model(spark, sf_dir, model):
    return _round(model.onset(_liab(spark, sf_dir), 1, 42).select("id", "t1"), "t1", places=3)


_E = f"-ln({fx._u('onset1.e', 'id')})"
_STD = "(liability1 - avg(liability1) OVER ()) / stddev_pop(liability1) OVER ()"
for _name in _BASE:
    if _name == "lognormal":
        _sql = LIAB + f", x AS (SELECT id, exp(-({_E}) / exp({D(0.8)} * ({_STD}) + {D(0.2)} * sex)) AS s FROM liab), c AS (SELECT id, greatest(1e-300, least(s, {D(1 - 1e-16)})) AS p, s FROM x) SELECT id, round(CASE WHEN s <= 0 THEN 1e6 ELSE least(1e6, greatest(1e-10, exp({D(4.5)} - {D(0.6)} * ({ndtri_sql('p')})))) END, 3) AS t1 FROM c"
    else:
        _sql = LIAB + f", x AS (SELECT id, {_E} / exp({D(0.8)} * ({_STD}) + {D(0.2)} * sex) AS h FROM liab) SELECT id, round({_h_sql(_name, 'h')}, 3) AS t1 FROM x"
    query(f"frailty_{_name}", _sql)(lambda spark, sf_dir, n=_name: _model(spark, sf_dir, phenotypes.Frailty(beta=0.8, beta_sex=0.2, hazard=n, params=_BASE[n])))


#: A whole shape: the tail is a Poisson sum, inverted by halving.
_GAMMA = LIAB.replace("WITH ", "WITH RECURSIVE ", 1) + f""", x AS (SELECT id, {_E} / exp({D(0.8)} * ({_STD})) AS h FROM liab),
b AS (
  SELECT id, h, CAST(-30 AS DOUBLE) AS lo, CAST(8 AS DOUBLE) AS hi, 0 AS n FROM x
  UNION ALL SELECT id, h, CASE WHEN less THEN mid ELSE lo END, CASE WHEN less THEN hi ELSE mid END, n + 1
  FROM (SELECT *, exp(mid) - ln(1 + exp(mid) + exp(2 * mid) / 2 + exp(3 * mid) / 6) < h AS less FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE n < 60)))
SELECT id, round(least(1e6, greatest(1e-10, {D(20.0)} * exp(lo))), 3) AS t1 FROM b WHERE n = 60"""


@query("frailty_gamma", _GAMMA)
def frailty_gamma(spark, sf_dir):
    return _model(spark, sf_dir, phenotypes.Frailty(beta=0.8, hazard="gamma", params={"shape": 4.0, "scale": 20.0}))


@query("cure_frailty", LIAB + f", x AS (SELECT id, {_STD} AS z, {_E} / exp({D(0.8)} * ({_STD})) AS h FROM liab) SELECT id, round(CASE WHEN z > {D(_z(0.15))} THEN {_h_sql('weibull', 'h')} ELSE 1e6 END, 3) AS t1 FROM x")
def cure_frailty(spark, sf_dir):
    return _model(spark, sf_dir, phenotypes.CureFrailty(beta=0.8, prevalence=0.15, params=_BASE["weibull"]))


@query("adult_cox", LIAB + f", x AS (SELECT id, sqrt({_E} / exp({D(0.8)} * ({_STD}))) AS raw FROM liab), c AS (SELECT id, CAST(row_number() OVER (ORDER BY raw, id) AS DOUBLE) / (count(*) OVER () + 1) AS cip FROM x) SELECT id, round(CASE WHEN cip < {D(0.15)} THEN least(1e6, greatest(0.01, 50 + ln(cip / ({D(0.15)} - cip)) / {D(0.2)})) ELSE 1e6 END, 3) AS t1 FROM c")
def adult_cox(spark, sf_dir):
    return _model(spark, sf_dir, phenotypes.AdultCox(beta=0.8, prevalence=0.15))


def _ltm_sql(k: float, x0: float, slope: float) -> str:
    """Age of the threshold model from z and cip, the standardised liability and its upper tail."""
    return f"CASE WHEN z > {D(_z(k))} AND cip < {D(k)} THEN least(1e6, greatest(0.01, {D(x0)} + ln(cip / ({D(k)} - cip)) / {D(slope)})) ELSE 1e6 END"


_TAIL = LIAB + f", s AS (SELECT id, {_STD} AS z, {_E} AS e FROM liab), x AS (SELECT id, z, e, {fx._u('onset1.mix', 'id')} AS mix, 1 - {phi_sql('z')} AS cip FROM s) "


@query("adult_ltm", _TAIL + f"SELECT id, round({_ltm_sql(0.15, 50.0, 0.2)}, 3) AS t1 FROM x")
def adult_ltm(spark, sf_dir):
    return _model(spark, sf_dir, phenotypes.AdultLtm(beta=1.0, prevalence=0.15))


@query("first_passage", LIAB + f""", x AS (SELECT id, {D(5.0)} * exp(-{D(0.3)} * ({_STD})) AS y0, sqrt(-2 * ln({fx._u('onset1.n.r', 'id')})) * cos(2 * pi() * {fx._u('onset1.n.a', 'id')}) AS n, {fx._u('onset1.u', 'id')} AS u FROM liab),
m AS (SELECT id, y0 / {D(0.08)} AS mu, y0 * y0 AS lam, n * n AS w, u FROM x), r AS (SELECT id, mu, u, mu + mu * mu * w / (2 * lam) - mu / (2 * lam) * sqrt(4 * mu * lam * w + mu * mu * w * w) AS x FROM m)
SELECT id, round(least(1e6, greatest(1e-10, CASE WHEN u <= mu / (mu + x) THEN x ELSE mu * mu / x END)), 3) AS t1 FROM r""")
def first_passage(spark, sf_dir):
    return _model(spark, sf_dir, phenotypes.FirstPassage(beta=0.3, params={"drift": -0.08, "shape": 25.0}))


_cure = lambda scale, rho: f"CASE WHEN z > {D(_z(0.15))} THEN {D(scale)} * exp(ln(e / exp(z)) / {D(rho)}) ELSE 1e6 END"
for _name, _sql in (
    ("mixture_cip", f"CASE WHEN mix < {D(0.3)} THEN {_ltm_sql(0.15, 20.0, 0.4)} ELSE {_ltm_sql(0.15, 50.0, 0.2)} END"),
    ("two_threshold", f"CASE WHEN {_ltm_sql(0.15 * 0.3, 20.0, 0.4)} < 1e6 THEN {_ltm_sql(0.15 * 0.3, 20.0, 0.4)} ELSE {_ltm_sql(0.15, 50.0, 0.2)} END"),
    ("mixture_cure_frailty", f"CASE WHEN mix < {D(0.3)} THEN {_cure(20.0, 3.0)} ELSE {_cure(2160.0, 0.8)} END"),
):
    _p = {"params": _BASE["weibull"]} if _name == "mixture_cure_frailty" else {}
    query(f"model_{_name}", _TAIL + f"SELECT id, round({_sql}, 3) AS t1 FROM x")(lambda spark, sf_dir, n=_name, p=_p: _model(spark, sf_dir, phenotypes.make_model(n, prevalence=0.15, **p)))

#: Ages of 1 to 120, one for each part.
_AGES = "WITH g AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size + p_partkey % 71 AS DOUBLE) AS t FROM part)"
_TERMS_SQL = {
    "weibull": ("ln({rho} / {scale}) + ({rho} - 1) * ln(t / {scale})", "pow(t / {scale}, {rho})"), "exponential": ("ln({rate})", "{rate} * t"),
    "gompertz": ("ln({rate}) + {gamma} * t", "{rate} / {gamma} * (exp({gamma} * t) - 1)"), "loglogistic": ("ln({shape}) - ln(t) + u - ln(1 + exp(u))", "ln(1 + exp(u))"),
}
for _name, _params in {**_BASE, "gamma": {"shape": 4.0, "scale": 20.0}, "first_passage": {"drift": -0.08, "shape": 25.0}}.items():

    def _terms(spark, sf_dir, n=_name, p=_params):
        ages = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_size") + F.col("p_partkey") % 71).cast("double").alias("t"))
        log_h, cum = hazards.terms(n, F.col("t"), **p)
        return ages.select("id", "t", F.round(log_h, 6).alias("log_hazard"), F.round(cum, 6).alias("cumulative"))

    _sql, _log = None, _AGES
    if _name == "lognormal":
        _sql = f"{_log}, x AS (SELECT id, t, (ln(t) - {D(4.5)}) / {D(0.6)} AS z FROM g), y AS (SELECT id, t, z, ln(1 - {phi_sql('z')}) AS s FROM x) SELECT id, t, round(-z * z / 2 - ln({D(0.6)} * sqrt(2 * pi())) - ln(t) - s, 6) AS log_hazard, round(-s, 6) AS cumulative FROM y"
    if _name == "gamma":  # a whole shape: the tail is a Poisson sum
        _sql = f"{_log}, x AS (SELECT id, t, t / {D(20.0)} AS v FROM g), y AS (SELECT id, t, v, ln(1 + v + v * v / 2 + v * v * v / 6) - v AS s FROM x) SELECT id, t, round(3 * ln(v) - v - ln(6) - s - ln({D(20.0)}), 6) AS log_hazard, round(-s, 6) AS cumulative FROM y"
    if _name == "first_passage":
        _sql = f"{_log}, x AS (SELECT id, t, ({D(5.0)} + {D(0.08)} * t) / sqrt(t) AS a, (-{D(5.0)} + {D(0.08)} * t) / sqrt(t) AS b FROM g), y AS (SELECT id, t, a, ln(greatest(1e-300, {phi_sql('a')} - exp({D(2 * 5.0 * -0.08)}) * {phi_sql('b')})) AS s FROM x) SELECT id, t, round(ln({D(5.0)} / sqrt(2 * pi())) - 1.5 * ln(t) - a * a / 2 - s, 6) AS log_hazard, round(-s, 6) AS cumulative FROM y"
    if _name in _TERMS_SQL:
        _p = {k: D(v) for k, v in _params.items()}
        _u = f", {_p['shape']} * ln(t / {_p['scale']}) AS u" if _name == "loglogistic" else ""
        _sql = f"{_log}, x AS (SELECT id, t{_u} FROM g) SELECT id, t, round({_TERMS_SQL[_name][0].format(**_p)}, 6) AS log_hazard, round({_TERMS_SQL[_name][1].format(**_p)}, 6) AS cumulative FROM x"
    query(f"hazard_terms_{_name}", _sql)(_terms)


# scores


@query("zscore_per_generation", LIAB + "SELECT id, round((liability1 - avg(liability1) OVER w) / stddev_pop(liability1) OVER w, 6) AS z FROM liab WINDOW w AS (PARTITION BY generation)")
def zscore(spark, sf_dir):
    return phenotypes.standardized(_liab(spark, sf_dir), "liability1", "per_generation", "z").select("id", F.round("z", 6).alias("z"))


@query("rank_scores", LIAB + "SELECT id, round(row_number() OVER (ORDER BY liability1, id) / (count(*) OVER () + 1), 9) AS score FROM liab")
def rank_scores(spark, sf_dir):
    return simulate.rank_score(_liab(spark, sf_dir), F.col("liability1"), "score").select("id", F.round("score", 9).alias("score"))


@query("quantile_normal_scores", LIAB + f", q AS (SELECT id, row_number() OVER (ORDER BY liability1, id) / (count(*) OVER () + 1) AS p FROM liab) SELECT id, round({ndtri_sql('p')}, 6) AS score FROM q")
def quantile_normal(spark, sf_dir):
    return simulate.quantile_normal(_liab(spark, sf_dir), "liability1").select("id", F.round("score", 6).alias("score"))


@query("normal_functions", f"WITH g AS (SELECT CAST(c_custkey AS BIGINT) AS id, CAST(floor(c_acctbal) AS BIGINT) % 4000 / CAST(1000 AS DOUBLE) AS x FROM customer), d AS (SELECT x, {phi_sql('x')} AS p FROM (SELECT DISTINCT x FROM g)) SELECT id, x, round(p, 9) AS cdf, round(x, 5) AS back FROM g JOIN d USING (x)")
def normal_functions(spark, sf_dir):
    """The normal distribution function by erfc of a value of each customer, and the argument back from it by the inverse, to five places."""
    x = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"), (F.floor("c_acctbal").cast("long") % 4000 / F.lit(1000.0)).alias("x"))
    p = norm_cdf(F.col("x"))
    return x.select("id", "x", F.round(p, 9).alias("cdf"), F.round(ndtri(p), 5).alias("back"))


_Z2 = f"pow(exp(-pow({ndtri_sql('k')}, 2) / 2) / sqrt(2 * pi()), 2)"


@query("dempster_lerner_table", CENS + f", p AS (SELECT generation, trait, avg(CAST(a AS DOUBLE)) AS k FROM (SELECT generation, 1 AS trait, affected1 AS a FROM cens UNION ALL SELECT generation, 2, affected2 FROM cens) GROUP BY ALL) SELECT generation, trait, round(k, 6) AS prevalence, round(CASE WHEN k > 0 AND k < 1 THEN k * (1 - k) / {_Z2} END, 5) AS factor FROM p")
def dempster_lerner_table(spark, sf_dir):
    """From the observed to the liability scale, at each generation's prevalence."""
    rows = [F.struct(F.lit(n).alias("trait"), F.col(f"affected{n}").alias("a")) for n in (1, 2)]
    k = fx.censored(spark, sf_dir).select("generation", F.inline(F.array(*rows))).groupBy("generation", "trait").agg(F.avg(F.col("a").cast("double")).alias("prevalence"))
    return _round(k.withColumn("factor", F.round(liability_scale(F.col("prevalence")), 5)), "prevalence")


# sampling

_KEY = lambda tag: fx._h(tag, "id")


@query("sample_uniform", CENS + f"SELECT id FROM cens ORDER BY {_KEY('sample')}, id LIMIT 1000")
def sample_uniform(spark, sf_dir):
    return sampling.run_sample(fx.censored(spark, sf_dir), 1000).select("id")


@query("sample_weighted", CENS + f"SELECT id FROM cens ORDER BY round(-ln({fx._u('sample', 'id')}) / CASE WHEN affected1 THEN CAST(5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END, 9), id LIMIT 1000")
def sample_weighted(spark, sf_dir):
    return sampling.run_sample(fx.censored(spark, sf_dir), 1000, 5.0).select("id")


@query("sample_per_generation_with_parents", f"WITH {fx.SQL_PED}, r AS (SELECT *, row_number() OVER (PARTITION BY generation ORDER BY {_KEY('plot')}, id) AS k FROM ped), s AS (SELECT * FROM r WHERE k <= 300) SELECT id, generation FROM ped WHERE id IN (SELECT id FROM s UNION SELECT mother FROM s UNION SELECT father FROM s)")
def sample_generations(spark, sf_dir):
    return sampling.sample_with_parents(fx.pedigree(spark, sf_dir), 300).select("id", "generation")


@query("dropout_relink", f"""WITH {fx.SQL_PED}, kept AS (SELECT * FROM ped ORDER BY {_KEY('dropout')}, id LIMIT (SELECT count(*) - CAST(round_even(count(*) * 0.2, 0) AS BIGINT) FROM ped))
SELECT id, CASE WHEN mother IN (SELECT id FROM kept) THEN mother ELSE -1 END AS mother, CASE WHEN father IN (SELECT id FROM kept) THEN father ELSE -1 END AS father, CASE WHEN twin IN (SELECT id FROM kept) THEN twin ELSE -1 END AS twin FROM kept""")
def dropout(spark, sf_dir):
    return sampling.run_dropout(fx.pedigree(spark, sf_dir), 0.2).select("id", "mother", "father", "twin")


# polygenic branch on genotypes from lineitem


def _genotypes(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("long").alias("individual"), F.col("l_partkey").cast("long").alias("site_id"), (F.col("l_linenumber") % 3).cast("long").alias("dosage"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("site_id"), (F.col("p_size") % 22 + 1).cast("long").alias("CHR"))
    return items.join(part, "site_id").groupBy("CHR", "site_id", "individual").agg(F.max("dosage").alias("dosage"))


_GENO = """WITH geno AS (SELECT CAST(p_size % 22 + 1 AS BIGINT) AS CHR, CAST(l_partkey AS BIGINT) AS site_id, CAST(l_orderkey AS BIGINT) AS individual, max(CAST(l_linenumber % 3 AS BIGINT)) AS dosage FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
cat AS (SELECT CHR, site_id, CAST(sum(dosage) AS BIGINT) AS AC, sum(dosage) / (2.0 * (SELECT count(DISTINCT individual) FROM geno)) AS AF FROM geno GROUP BY ALL)
"""


def _catalog(spark, sf_dir):
    g = _genotypes(spark, sf_dir)
    return g, genes.site_catalog(g, g.select("individual").distinct().count())


@query("site_catalog", _GENO + 'SELECT CHR AS "CHR", site_id, AC AS "AC", round(AF, 9) AS "AF" FROM cat')
def site_catalog(spark, sf_dir):
    return _round(_catalog(spark, sf_dir)[1], "AF", places=9)


@query("catalog_summary", _GENO + 'SELECT CHR AS "CHR", count(*) AS n_sites, round(avg(AF), 9) AS mean_af FROM cat GROUP BY CHR')
def catalog_summary(spark, sf_dir):
    return _round(genes.catalog_summary(_catalog(spark, sf_dir)[1]), "mean_af", places=9)


@query("maf_filter_effects", _GENO + 'SELECT CHR AS "CHR", site_id, round(AF, 9) AS "AF" FROM cat WHERE least(AF, 1 - AF) > 0.0009')
def maf_filter(spark, sf_dir):
    return genes.maf_filter(_catalog(spark, sf_dir)[1], 0.0009).select("CHR", "site_id", F.round("AF", 9).alias("AF"))


def _values(spark, sf_dir):
    g = _genotypes(spark, sf_dir)
    effects = g.select("CHR", "site_id").distinct().withColumns({"trait_id": F.lit(0), "effect_size": rng.sum_normal("beta", F.col("site_id"))})
    return genes.genetic_values(g, effects)


_GV = _GENO + f", gv AS (SELECT individual, sum({fx._z('beta', 'site_id')} * dosage) AS genetic_value FROM geno GROUP BY individual) "


@query("gv_by_individual", _GV + "SELECT individual, 0 AS trait_id, round(genetic_value, 6) AS genetic_value FROM gv")
def gv(spark, sf_dir):
    return _round(_values(spark, sf_dir), "genetic_value")


@query("gv_rescale", _GV + "SELECT individual, 0 AS trait_id, round((genetic_value - (SELECT avg(genetic_value) FROM gv)) * sqrt(CAST(0.5 AS DOUBLE) / (SELECT var_pop(genetic_value) FROM gv)), 5) AS genetic_value FROM gv")
def gv_rescale(spark, sf_dir):
    return _round(genes.rescale(_values(spark, sf_dir), 0.5), "genetic_value", places=5)


_NOISE_KEY = "(individual || '|0')"


@query("gv_with_noise", _GV + f""", r AS (SELECT individual, (genetic_value - (SELECT avg(genetic_value) FROM gv)) * sqrt(CAST(0.5 AS DOUBLE) / (SELECT var_pop(genetic_value) FROM gv)) AS g FROM gv),
n AS (SELECT individual, g, (SELECT sqrt(var_pop(g)) FROM r) * sqrt(-2 * ln({fx._u('noise.r', _NOISE_KEY)})) * cos(2 * pi() * {fx._u('noise.a', _NOISE_KEY)}) AS e FROM r)
SELECT individual, 0 AS trait_id, round(g, 5) AS genetic_value, round(e, 5) AS environmental_noise, round(g + e, 5) AS phenotype FROM n""")
def gv_noise(spark, sf_dir):
    return _round(genes.add_noise(genes.rescale(_values(spark, sf_dir), 0.5), 0.5), "genetic_value", "environmental_noise", "phenotype", places=5)


def _drop_sql(generations: int) -> str:
    """Haplotypes of one generation from those of the one before; strands change over where a digest is below the rate."""
    two = lambda tag, key: fx._h(tag, f"k.id AS VARCHAR) || '|' || CAST(k.strand AS VARCHAR) || '|' || {key} || CAST('' ")
    out = f"""sites AS (SELECT CAST(n_regionkey + 1 AS BIGINT) AS CHR, CAST(n_nationkey AS BIGINT) AS site_id FROM nation),
h0 AS (SELECT id, s.strand, CHR, site_id, CAST({fx._h('allele', "id AS VARCHAR) || '|' || CAST(s.strand AS VARCHAR) || '|' || CAST(site_id AS VARCHAR) || CAST('' ")} % 2 AS INTEGER) AS allele FROM ped, (VALUES (0), (1)) s(strand), sites WHERE generation = 0)"""
    for g in range(1, generations):
        cross = f"CASE WHEN (({two('cross', "CAST(CHR AS VARCHAR) || '|' || CAST(site_id AS VARCHAR)")}) + 0.5) / CAST(4503599627370496 AS DOUBLE) < 0.1 THEN 1 ELSE 0 END"
        start = f"CASE WHEN (({two('start', 'CAST(CHR AS VARCHAR)')}) + 0.5) / CAST(4503599627370496 AS DOUBLE) < 0.5 THEN 1 ELSE 0 END"
        out += f""",
k{g} AS (SELECT id, 0 AS strand, mother AS parent FROM ped WHERE generation = {g} UNION ALL SELECT id, 1, father FROM ped WHERE generation = {g}),
c{g} AS (SELECT k.id, k.strand, parent, CHR, site_id, ({start} + sum({cross}) OVER (PARTITION BY k.id, k.strand, CHR ORDER BY site_id)) % 2 AS src FROM k{g} k, sites),
h{g} AS (SELECT c.id, c.strand, c.CHR, c.site_id, h.allele FROM c{g} c JOIN h{g - 1} h ON h.id = c.parent AND h.strand = c.src AND h.CHR = c.CHR AND h.site_id = c.site_id)"""
    return out


@query("gene_drop_founders", f"WITH {fx.SQL_PED}, {_drop_sql(fx.GENERATIONS)} SELECT CHR AS \"CHR\", site_id, CAST(sum(allele) AS BIGINT) AS n_alleles, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT * FROM h{g}" for g in range(fx.GENERATIONS)) + ") GROUP BY ALL")
def gene_drop(spark, sf_dir):
    """The nation table as a panel of sites, dropped through the whole pedigree."""
    ped = fx.pedigree(spark, sf_dir)
    sites = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_regionkey") + 1).cast("long").alias("CHR"), F.col("n_nationkey").cast("long").alias("site_id"), F.lit(0.1).alias("r"))
    first = ped.filter("generation = 0").select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("strand")).crossJoin(F.broadcast(sites.drop("r")))
    first = first.withColumn("allele", (rng.integer("allele", F.col("id"), F.col("strand"), F.col("site_id")) % 2).cast("int"))
    return genes.gene_drop(ped, first, sites).groupBy("CHR", "site_id").agg(F.sum("allele").alias("n_alleles"), F.count("*").alias("n"))


@query("pedigree_tables", f"WITH {fx.SQL_PED} SELECT id AS individual, 5 - generation AS time, generation >= 3 AS is_sample, CASE WHEN mother >= 0 THEN mother END AS mother, CASE WHEN mother >= 0 THEN father END AS father FROM ped")
def pedigree_tables(spark, sf_dir):
    return genes.pedigree_tables(fx.pedigree(spark, sf_dir), fx.GENERATIONS, 3)


def _samples_sql(generations: int) -> str:
    """Nodes below each founder's mutation: at positions below 50 the tree is the mothers', above it the fathers'."""
    out = "n0 AS (SELECT id AS site_id, id % 100 AS position, id AS node FROM ped WHERE generation = 0)"
    for g in range(1, generations):
        out += f", n{g} AS (SELECT DISTINCT site_id, position, id AS node FROM n{g - 1} JOIN ped ON node = CASE WHEN position < 50 THEN mother ELSE father END)"
    return out


@query("sample_allele_counts", f"WITH {fx.SQL_PED}, {_samples_sql(fx.GENERATIONS)} SELECT n0.site_id, count(n5.node) AS \"AC\" FROM n0 LEFT JOIN n5 ON n0.site_id = n5.site_id GROUP BY n0.site_id")
def sample_allele_counts(spark, sf_dir):
    """Each founder's node has a mutation; two trees, of the mothers and of the fathers, and the last generation as samples."""
    return genes.sample_counts(*_two_trees(spark, sf_dir))


def _two_trees(spark, sf_dir):
    """The mothers' tree left of 50 and the fathers' right of it; each founder's node has a mutation, the last generation are samples."""
    ped = fx.pedigree(spark, sf_dir)
    edges = relatives.parent_edges(ped).select("parent", "child", F.when(F.col("role") == "M", 0).otherwise(50).alias("left"), F.when(F.col("role") == "M", 50).otherwise(100).alias("right"))
    mutations = ped.filter("generation = 0").select(F.col("id").alias("site_id"), (F.col("id") % 100).alias("position"), F.col("id").alias("node"))
    return edges, mutations, ped.filter(F.col("generation") == fx.GENERATIONS - 1).select(F.col("id").alias("node"))


@query("allele_counts_by_sweep", SQL["sample_allele_counts"])
def allele_counts_by_sweep(spark, sf_dir):
    return genome_sweep.allele_counts(*_two_trees(spark, sf_dir))


@query("gv_over_edges", f"WITH {fx.SQL_PED}, {_samples_sql(fx.GENERATIONS)}, gv AS (SELECT node, sum({fx._z('beta', 'site_id')}) AS v FROM n5 GROUP BY node) SELECT 0 AS trait_id, id AS individual, round(coalesce(v, 0), 6) AS genetic_value FROM ped LEFT JOIN gv ON id = node WHERE generation = {fx.GENERATIONS - 1}")
def gv_over_edges(spark, sf_dir):
    edges, mutations, samples = _two_trees(spark, sf_dir)
    effects = mutations.withColumns({"trait_id": F.lit(0), "effect_size": rng.sum_normal("beta", F.col("site_id"))})
    return _round(genome_sweep.edge_genetic_values(edges, effects, samples.withColumn("individual", F.col("node"))), "genetic_value")


@query("single_mutation_sites", """WITH m AS (SELECT CAST(l_linenumber AS BIGINT) AS "CHR", CAST(l_orderkey % 9973 AS BIGINT) AS site_id, CAST(l_partkey AS BIGINT) AS node FROM lineitem)
SELECT "CHR", site_id, max(node) AS node FROM m GROUP BY "CHR", site_id HAVING count(*) = 1""")
def single_mutation_sites(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    mutations = items.select(F.col("l_linenumber").cast("long").alias("CHR"), (F.col("l_orderkey") % 9973).cast("long").alias("site_id"), F.col("l_partkey").cast("long").alias("node"))
    return genes.single_mutation_sites(mutations).select("CHR", "site_id", "node")


@query("remap_sites", """SELECT CAST(c_nationkey % 22 + 1 AS BIGINT) AS "CHR", CAST(c_custkey AS BIGINT) AS "POS", CAST(s_suppkey + 1000000 AS BIGINT) AS site_id
FROM customer JOIN supplier ON c_nationkey % 22 = s_nationkey % 22 AND c_custkey = s_suppkey""")
def remap_sites(spark, sf_dir):
    """Customers' sites take the ids of suppliers' sites at the same place."""
    sites = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_nationkey") % 22 + 1).cast("long").alias("CHR"), F.col("c_custkey").cast("long").alias("POS"), F.lit(0).cast("long").alias("site_id"))
    onto = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_nationkey") % 22 + 1).cast("long").alias("CHR"), F.col("s_suppkey").cast("long").alias("POS"), (F.col("s_suppkey") + 1000000).cast("long").alias("site_id"))
    return genes.remap_sites(sites, onto).select("CHR", "POS", "site_id")


# stored results


@query("verify_golden", """WITH golden AS (SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_nationkey AS BIGINT) AS nation, CAST(c_acctbal AS DOUBLE) AS balance, c_mktsegment AS segment FROM customer),
found AS (
  SELECT id, CASE WHEN id % 13 = 0 THEN NULL ELSE nation END AS nation, CASE WHEN id % 7 = 0 THEN balance + 1 ELSE balance END AS balance, segment FROM golden WHERE id % 11 != 0
  UNION ALL SELECT id + 1000000, nation, balance, segment FROM golden WHERE id % 17 = 0)
SELECT * FROM (
  SELECT CASE WHEN f.id IS NULL THEN 'missing' WHEN g.id IS NULL THEN 'extra' WHEN f.nation IS DISTINCT FROM g.nation OR f.balance IS DISTINCT FROM g.balance THEN 'changed' END AS status, coalesce(f.id, g.id) AS id,
         CASE WHEN f.id IS NULL OR g.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN f.balance IS DISTINCT FROM g.balance THEN 'balance' END, CASE WHEN f.nation IS DISTINCT FROM g.nation THEN 'nation' END) END AS columns
  FROM found f FULL JOIN golden g ON f.id = g.id) WHERE status IS NOT NULL""")
def verify_golden(spark, sf_dir):
    """The customer table against one with rows changed, missing and added."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    golden = c.select(F.col("c_custkey").cast("long").alias("id"), F.col("c_nationkey").cast("long").alias("nation"), F.col("c_acctbal").cast("double").alias("balance"), F.col("c_mktsegment").alias("segment"))
    found = golden.filter("id % 11 != 0").withColumns({"nation": F.when(F.col("id") % 13 != 0, F.col("nation")), "balance": F.when(F.col("id") % 7 == 0, F.col("balance") + 1).otherwise(F.col("balance"))})
    found = found.unionByName(golden.filter("id % 17 = 0").withColumn("id", F.col("id") + 1000000))
    return stores.verify(found, golden, ["id"]).select("status", "id", F.array_join("columns", ",").alias("columns"))


def _fresh_folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("gv_from_store", _GV + "SELECT individual, 0 AS trait_id, round(genetic_value, 6) AS genetic_value, 1 AS times_made FROM gv")
def gv_from_store(spark, sf_dir):
    """Genetic values that are made once, though asked for twice."""
    store = stores.StageStore(spark, _fresh_folder(spark, "stages"))
    inputs = {"genotypes": _genotypes(spark, sf_dir)}
    for _ in range(2):
        values = store.stage("values", lambda: _values(spark, sf_dir), inputs, {"effects": "beta"})
    return _round(values, "genetic_value").withColumn("times_made", F.lit(len(store.made)))


def _site_store(spark, sf_dir):
    sites = _catalog(spark, sf_dir)[1].select("CHR", F.col("site_id").alias("POS"), "AC")
    return stores.SiteStore.write(sites, _fresh_folder(spark, "sites"))


_NUMBERED = _GENO + ', s AS (SELECT CHR AS "CHR", site_id AS "POS", AC AS "AC", row_number() OVER (ORDER BY CHR, site_id) - 1 AS number FROM cat)'


@query("site_store_numbers", _NUMBERED + " SELECT * FROM s")
def site_store_numbers(spark, sf_dir):
    return _site_store(spark, sf_dir).all()


@query("site_store_range", _NUMBERED + ' SELECT * FROM s WHERE "CHR" = 7 AND "POS" >= 100 AND "POS" < 1500')
def site_store_range(spark, sf_dir):
    return _site_store(spark, sf_dir).between(7, 100, 1500)


@query("population_nodes", "SELECT CAST(c_custkey AS BIGINT) AS node FROM customer WHERE c_nationkey = 7")
def population_nodes(spark, sf_dir):
    nodes = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("node"), F.col("c_nationkey").alias("population"))
    return genes.in_population(nodes, 7).select("node")


# kinship and effective size


def _couples_sql(generations: int) -> str:
    """Kinship of couples: the pairs needed from the last generation up, then their values from the founders down."""
    out = ""
    for g in range(generations - 1, -1, -1):
        want = f"SELECT least(mother, father) AS i, greatest(mother, father) AS j FROM ped WHERE generation = {g + 1}" if g < generations - 1 else "SELECT NULL::BIGINT AS i, NULL::BIGINT AS j WHERE false"
        if g < generations - 2:
            want += f" UNION SELECT least(a.p, b.p), greatest(a.p, b.p) FROM w{g + 1} w JOIN edge a ON a.child = w.i JOIN edge b ON b.child = w.j WHERE NOT w.same UNION SELECT least(mother, father), greatest(mother, father) FROM w{g + 1} w JOIN ped ON ped.id = w.i WHERE w.same"
        out += f", w{g} AS MATERIALIZED (SELECT i, j, i = j OR coalesce(t.twin = j, false) AS same FROM (SELECT DISTINCT i, j FROM ({want})) n LEFT JOIN ped t ON t.id = n.i)"
    out += ", v0 AS (SELECT i, j, CASE WHEN i = j THEN CAST(0.5 AS DOUBLE) ELSE 0 END AS k FROM w0)"
    for g in range(1, generations):
        out += f""", v{g} AS MATERIALIZED (SELECT w.i, w.j, CAST(0.5 AS DOUBLE) + v.k / 2 AS k FROM w{g} w JOIN ped ON ped.id = w.i JOIN v{g - 1} v ON v.i = least(mother, father) AND v.j = greatest(mother, father) WHERE w.same
UNION ALL SELECT w.i, w.j, sum(v.k) / 4 FROM w{g} w JOIN edge a ON a.child = w.i JOIN edge b ON b.child = w.j JOIN v{g - 1} v ON v.i = least(a.p, b.p) AND v.j = greatest(a.p, b.p) WHERE NOT w.same GROUP BY w.i, w.j)"""
    return "edge AS (SELECT id AS child, mother AS p FROM ped WHERE mother >= 0 UNION ALL SELECT id, father FROM ped WHERE father >= 0)" + out


_INBRED = f"""WITH {fx.SQL_PED}, {_couples_sql(fx.GENERATIONS)}, v AS ({' UNION ALL '.join(f'SELECT * FROM v{g}' for g in range(fx.GENERATIONS))}),
f AS (SELECT id, generation, coalesce(k, 0) AS f FROM ped LEFT JOIN v ON i = least(mother, father) AND j = greatest(mother, father))
"""


@query("inbreeding_by_generation", _INBRED + "SELECT generation, round(avg(f), 9) AS mean_f, count(*) FILTER (f > 0) AS n_inbred FROM f GROUP BY generation")
def inbreeding(spark, sf_dir):
    f = kinship.inbreeding(fx.pedigree(spark, sf_dir))
    return f.groupBy("generation").agg(F.round(F.avg("f"), 9).alias("mean_f"), F.count_if(F.col("f") > 0).alias("n_inbred"))


@query("inbreeding_whole_pedigree", _INBRED + "SELECT id, generation, round(f, 9) AS f FROM f")
def inbreeding_whole(spark, sf_dir):
    return _round(kinship.inbreeding(fx.pedigree(spark, sf_dir)), "f", places=9)


#: Kinship sums by generation: what an ancestor gives to all of a generation, squared, times its Mendelian variance.
_COANCESTRY = _INBRED + """,
can AS (SELECT id, CASE WHEN twin >= 0 AND twin < id AND mother >= 0 THEN twin ELSE id END AS self FROM ped),
given(g, id, w) AS (
  SELECT generation, self, CAST(1 AS DOUBLE) FROM ped JOIN can USING (id)
  UNION ALL SELECT g, c.self, w / 2 FROM given JOIN edge ON given.id = edge.child JOIN can c ON edge.p = c.id),
sums AS (SELECT g, id, sum(w) AS c FROM given GROUP BY g, id),
d AS (SELECT p.id, CASE WHEN p.mother < 0 THEN 1 ELSE 0.5 - (m.f + q.f) / 4 END AS d FROM ped p LEFT JOIN f m ON p.mother = m.id LEFT JOIN f q ON p.father = q.id),
whole AS (SELECT g, sum(c * c * d) / 2 AS every FROM sums JOIN d USING (id) GROUP BY g),
own AS (SELECT generation, count(*) AS n, sum((1 + f) / 2) AS self FROM f GROUP BY generation),
theta AS (SELECT generation, n, (every - self) / (n * (n - CAST(1 AS DOUBLE))) AS theta, every / (n * CAST(n AS DOUBLE)) AS grp FROM own JOIN whole ON generation = g)
"""
_COANCESTRY = _COANCESTRY.replace("WITH ", "WITH RECURSIVE ", 1)


@query("mean_coancestry", _COANCESTRY + 'SELECT generation, n, round(theta, 9) AS theta, round(grp, 9) AS "group" FROM theta')
def mean_coancestry(spark, sf_dir):
    return _round(kinship.mean_coancestry(fx.pedigree(spark, sf_dir)), "theta", "group", places=9)


def _loss_sql(value: str, source: str) -> str:
    return f"(SELECT 1 / (2 * (1 - exp(-regr_slope(-ln(1 - {value}), generation)))) FROM {source})"


@query("effective_sizes", _COANCESTRY + f""", byf AS (SELECT generation, avg(f) AS f FROM f WHERE generation >= 2 GROUP BY generation),
down(id, w) AS (SELECT id, CAST(1 AS DOUBLE) FROM ped WHERE generation = {fx.GENERATIONS - 1} UNION ALL SELECT p, w / 2 FROM down JOIN edge ON down.id = edge.child),
founders AS (SELECT id, sum(w) / (SELECT count(*) FROM ped WHERE generation = {fx.GENERATIONS - 1}) AS c FROM down JOIN ped USING (id) WHERE mother < 0 GROUP BY id),
kid AS (SELECT mother AS p, sex FROM ped WHERE mother >= 0 UNION ALL SELECT father, sex FROM ped WHERE father >= 0),
kids AS (SELECT id, generation, ped.sex, count(p) AS k, count(*) FILTER (kid.sex = ped.sex) AS same, count(*) FILTER (kid.sex != ped.sex) AS other FROM ped LEFT JOIN kid ON id = p WHERE generation < {fx.GENERATIONS - 1} GROUP BY ALL),
fam AS (SELECT generation, 2 * count(*) / ((var_samp(k) - avg(k)) * pow(2 / avg(k), 2) + 2) AS ne FROM kids GROUP BY generation),
sexes AS (SELECT generation, 4 * count(*) FILTER (sex = 1 AND k > 0) * count(*) FILTER (sex = 0 AND k > 0) / CAST(count(*) FILTER (k > 0) AS DOUBLE) AS ne FROM kids GROUP BY generation),
hill AS (
  SELECT generation, 1 / sum((2 + (var_samp_s - ms) / (ms * ms) + 1 + 2 * cov / (ms * mo) + (var_samp_o - mo) / (mo * mo) + 1) / (16 * n)) AS ne
  FROM (SELECT generation, sex, count(*) AS n, avg(same) AS ms, avg(other) AS mo, var_samp(same) AS var_samp_s, var_samp(other) AS var_samp_o, covar_samp(same, other) AS cov FROM kids GROUP BY generation, sex) GROUP BY generation),
ne(estimator, ne) AS (
  SELECT 'inbreeding', {_loss_sql('f', 'byf')} UNION ALL SELECT 'coancestry', {_loss_sql('theta', 'theta WHERE generation >= 1')} UNION ALL SELECT 'caballero_toro', {_loss_sql('grp', 'theta')}
  UNION ALL SELECT 'variance_family_size', (SELECT count(*) / sum(1 / ne) FROM fam WHERE ne > 0) UNION ALL SELECT 'sex_ratio', (SELECT count(*) / sum(1 / ne) FROM sexes WHERE ne > 0)
  UNION ALL SELECT 'hill_overlapping', (SELECT count(*) / sum(1 / ne) FROM hill WHERE ne > 0)
  UNION ALL SELECT 'individual_delta_f', 1 / (2 * (SELECT avg(1 - pow(1 - f, CAST({1 / (fx.GENERATIONS - 2)} AS DOUBLE))) FROM f WHERE generation = {fx.GENERATIONS - 1}))
  UNION ALL SELECT 'long_term_contributions', 1 / (2 * (SELECT sum(c * c) FROM founders)))
SELECT estimator, round(ne, 3) AS ne FROM ne""")
def effective_sizes(spark, sf_dir):
    return _round(kinship.effective_sizes(fx.pedigree(spark, sf_dir)), "ne", places=3)


#: Everyone of the last two generations with the person 2 and the one 14 ids on, and with both parents.
_LISTED = """, listed AS (
  SELECT a.id AS id1, b.id AS id2 FROM ped a JOIN ped b ON b.id IN (a.id + 2, a.id + 14) WHERE a.generation >= 4 AND b.generation = a.generation
  UNION SELECT id, mother FROM ped WHERE generation >= 4 UNION SELECT id, father FROM ped WHERE generation >= 4)"""


def _listed(ped):
    last = ped.filter("generation >= 4")
    near = last.select(F.col("id").alias("id1"), "generation", F.explode(F.array(F.col("id") + 2, F.col("id") + 14)).alias("id2"))
    near = near.join(ped.select(F.col("id").alias("id2"), F.col("generation").alias("g2")), "id2").filter("generation = g2").select("id1", "id2")
    return near.unionByName(last.select(F.col("id").alias("id1"), F.explode(F.array("mother", "father")).alias("id2"))).distinct()


@query("pair_kinship_listed", _COANCESTRY + _LISTED + """,
ends AS (SELECT DISTINCT c.self AS id FROM (SELECT id1 AS id FROM listed UNION SELECT id2 FROM listed) JOIN can c USING (id)),
reach(id, a, w) AS (SELECT id, id, CAST(1 AS DOUBLE) FROM ends UNION ALL SELECT reach.id, c.self, w / 2 FROM reach JOIN edge ON reach.a = edge.child JOIN can c ON edge.p = c.id),
shares AS (SELECT id, a, sum(w) AS w FROM reach GROUP BY id, a)
SELECT l.id1, l.id2, round(coalesce(sum(x.w * y.w * d.d), 0) / 2, 9) AS kinship
FROM listed l JOIN can p ON l.id1 = p.id JOIN can q ON l.id2 = q.id LEFT JOIN shares x ON x.id = p.self LEFT JOIN shares y ON y.id = q.self AND y.a = x.a LEFT JOIN d ON d.id = y.a
GROUP BY l.id1, l.id2""")
def pair_kinship_listed(spark, sf_dir):
    ped = fx.pedigree(spark, sf_dir)
    return _round(kinship.pair_kinship(ped, _listed(ped)), "kinship", places=9)


@query("ne_variance", f"""WITH {fx.SQL_PED}, k AS (SELECT p, count(*) AS k FROM (SELECT mother AS p FROM ped UNION ALL SELECT father FROM ped) WHERE p >= 0 GROUP BY p),
o AS (SELECT generation, coalesce(k, 0) AS k FROM ped LEFT JOIN k ON id = p WHERE generation < 5), s AS (SELECT generation, count(*) AS n, avg(k) AS m, var_samp(k) AS v FROM o GROUP BY generation)
SELECT generation, n, round(m, 6) AS mean_k, round(v, 6) AS var_k, round(2.0 * n / ((v - m) * pow(2 / m, 2) + 2), 4) AS ne FROM s""")
def ne_variance(spark, sf_dir):
    return _round(_round(kinship.family_size_variance(fx.pedigree(spark, sf_dir)), "mean_k", "var_k"), "ne", places=4)


@query("ne_sex_ratio", f"WITH {fx.SQL_PED}, p AS (SELECT DISTINCT p FROM (SELECT mother AS p FROM ped UNION ALL SELECT father FROM ped) WHERE p >= 0), s AS (SELECT generation, count(*) FILTER (sex = 1) AS n_male, count(*) FILTER (sex = 0) AS n_female FROM ped JOIN p ON id = p GROUP BY generation) SELECT *, round(4.0 * n_male * n_female / (n_male + n_female), 6) AS ne FROM s")
def ne_sex_ratio(spark, sf_dir):
    return _round(kinship.sex_counts(fx.pedigree(spark, sf_dir)), "ne")


def _ltc_sql(generations: int) -> str:
    out = f"c{generations - 1} AS (SELECT id, CAST(1 AS DOUBLE) AS w FROM ped WHERE generation = {generations - 1})"
    for g in range(generations - 2, -1, -1):
        out += f", c{g} AS (SELECT p AS id, sum(w) / 2 AS w FROM (SELECT mother AS p, w FROM c{g + 1} JOIN ped USING (id) UNION ALL SELECT father, w FROM c{g + 1} JOIN ped USING (id)) GROUP BY p)"
    return out


@query("hill_overlapping", f"""WITH {fx.SQL_PED}, k AS (SELECT p, sum(sex) AS sons, count(*) - sum(sex) AS daughters FROM (SELECT mother AS p, sex FROM ped UNION ALL SELECT father, sex FROM ped) WHERE p >= 0 GROUP BY p),
o AS (SELECT generation, sex, CASE WHEN sex = 1 THEN coalesce(sons, 0) ELSE coalesce(daughters, 0) END AS same, CASE WHEN sex = 1 THEN coalesce(daughters, 0) ELSE coalesce(sons, 0) END AS other FROM ped LEFT JOIN k ON id = p WHERE generation < {fx.GENERATIONS - 1}),
s AS (SELECT generation, count(*) AS n, avg(same) AS ms, avg(other) AS mo, var_samp(same) AS vs, var_samp(other) AS vo, covar_samp(same, other) AS c FROM o GROUP BY generation, sex),
i AS (SELECT generation, (2 + (vs - ms) / (ms * ms) + 1 + 2 * c / (ms * mo) + (vo - mo) / (mo * mo) + 1) / (16.0 * n) AS part FROM s) SELECT generation, round(1 / sum(part), 4) AS ne FROM i GROUP BY generation""")
def hill(spark, sf_dir):
    return _round(kinship.hill_overlapping(fx.pedigree(spark, sf_dir)), "ne", places=4)


@query("long_term_contributions", f"WITH {fx.SQL_PED}, {_ltc_sql(fx.GENERATIONS)} SELECT id AS founder, round(w / (SELECT count(*) FROM c{fx.GENERATIONS - 1}), 9) AS c FROM c0")
def contributions(spark, sf_dir):
    return _round(kinship.contributions(fx.pedigree(spark, sf_dir)), "c", places=9)


# validation


@query("ped_structural_checks", f"""WITH {fx.SQL_PED}, k AS (
SELECT 'id_integrity' AS name, CAST(count(*) - count(*) FILTER (id BETWEEN 0 AND (SELECT count(*) - 1 FROM ped)) + count(*) - count(DISTINCT id) AS DOUBLE) AS observed, CAST(0 AS DOUBLE) AS expected FROM ped
UNION ALL SELECT 'no_self_parent', count(*) FILTER (mother = id OR father = id), 0 FROM ped UNION ALL SELECT 'sex_ratio', avg(CAST(sex AS DOUBLE)), 0.5 FROM ped
UNION ALL SELECT 'mother_known', count(*) FILTER (p.id IS NULL), 0 FROM ped k LEFT JOIN ped p ON k.mother = p.id WHERE k.mother != -1 UNION ALL SELECT 'mother_sex', count(*) FILTER (p.sex != 0), 0 FROM ped k LEFT JOIN ped p ON k.mother = p.id WHERE k.mother != -1
UNION ALL SELECT 'father_known', count(*) FILTER (p.id IS NULL), 0 FROM ped k LEFT JOIN ped p ON k.father = p.id WHERE k.father != -1 UNION ALL SELECT 'father_sex', count(*) FILTER (p.sex != 1), 0 FROM ped k LEFT JOIN ped p ON k.father = p.id WHERE k.father != -1)
SELECT name, CASE WHEN name = 'sex_ratio' THEN observed BETWEEN 0.45 AND 0.55 ELSE observed = 0 END AS passed, observed, expected FROM k""")
def structural(spark, sf_dir):
    return validate.structural(fx.pedigree(spark, sf_dir)).select("name", "passed", "observed", "expected")


@query("ped_twin_checks", f"""WITH {fx.SQL_LIAB}, t AS (SELECT a.*, b.twin AS back, b.mother AS mb, b.father AS fb, b.sex AS sb, b.A1 AS a1b, b.A2 AS a2b, b.id AS bid FROM liab a LEFT JOIN liab b ON a.twin = b.id WHERE a.twin != -1)
SELECT 'bidirectional' AS name, CAST(count(*) FILTER (bid IS NULL OR back != id) AS DOUBLE) AS observed FROM t UNION ALL SELECT 'same_parents', count(*) FILTER (mother != mb OR father != fb) FROM t
UNION ALL SELECT 'same_sex', count(*) FILTER (sex != sb) FROM t UNION ALL SELECT 'same_A', count(*) FILTER (abs(A1 - a1b) > 1e-6 OR abs(A2 - a2b) > 1e-6) FROM t UNION ALL SELECT 'rate', round(avg(CAST(twin != -1 AS DOUBLE)), 9) FROM liab WHERE mother != -1""")
def twin_checks(spark, sf_dir):
    return validate.twins(_liab(spark, sf_dir), 0.02).select("name", F.round("observed", 9).alias("observed"))


@query("validation_statistical", f"""WITH {fx.SQL_LIAB}, f AS (SELECT * FROM liab WHERE mother = -1), s AS (SELECT a.C1 AS ca, b.C1 AS cb, a.E1 AS ea, b.E1 AS eb FROM liab a JOIN liab b ON a.mother = b.mother AND a.father = b.father AND a.id < b.id WHERE a.mother >= 0 AND a.twin != b.id)
""" + " UNION ALL ".join([f"SELECT 'variance_{c}{n}' AS name, round(var_samp({c}{n}), 6) AS observed FROM f" for n in (1, 2) for c in "ACE"] + [f"SELECT 'variance_total{n}', round(var_samp(liability{n}), 6) FROM f" for n in (1, 2)] + [f"SELECT 'correlation_{c}', round(corr({c}1, {c}2), 6) FROM f" for c in "ACE"] + ["SELECT 'shared_C1', round(corr(ca, cb), 6) FROM s", "SELECT 'unique_E1', round(corr(ea, eb), 6) FROM s"]))
def statistical(spark, sf_dir):
    goal = {f"{c}{n}": v for n in (1, 2) for c, v in zip("ACE", (0.5, 0.2, 0.3))} | {"rA": 0.0, "rC": 0.0, "rE": 0.0}
    return validate.statistical(_liab(spark, sf_dir), goal).select("name", F.round("observed", 6).alias("observed"))


@query("variance_by_generation", LIAB + ", x AS (SELECT 1 AS trait, generation, A1 AS A, C1 AS C, E1 AS E FROM liab UNION ALL SELECT 2, generation, A2, C2, E2 FROM liab) SELECT trait, generation, " + ", ".join(f"round({f}({e}), 6) AS \"{n}_{c}\"" for c, e in (("A", "A"), ("C", "C"), ("E", "E"), ("total", "A + C + E")) for n, f in (("mean", "avg"), ("var", "var_pop"), ("sd", "stddev_pop"))) + " FROM x GROUP BY trait, generation")
def variances(spark, sf_dir):
    out = validate.variance_by_generation(_liab(spark, sf_dir))
    return _round(out, *out.columns[2:])


# simulation: whole runs, checked by their own validation


@query("simulate_validate")
def simulate_validate(spark, sf_dir):
    """As many people a generation as there are customers."""
    p = simulate.Parameters(n=spark.read.parquet(f"{sf_dir}/customer.parquet").count() // 2 * 2, generations=3)
    people = simulate.run_simulation(spark, p)
    goal = {f"{c}{n}": getattr(p, c)[n - 1] for n in (1, 2) for c in "ACE"} | {"rA": p.rA, "rC": p.rC, "rE": p.rE}
    return _round(validate.run_validation(people, goal, p.n, p.p_mztwin), "observed")


@query("simulate_two_trait_mating")
def simulate_two_trait_mating(spark, sf_dir):
    """Mates' correlations of a simulation with assortment on both traits, beside what was asked for; as many people a generation as there are customers."""
    p = simulate.Parameters(n=spark.read.parquet(f"{sf_dir}/customer.parquet").count() // 2 * 2, generations=2, rA=0.3, rC=0.3, assort=(0.4, 0.2))
    people = simulate.run_simulation(spark, p)
    return _round(validate.assortative(people, *p.assort, float(p.mate_target(p.within())[0, 1])), "observed", "expected")


# comparisons


def _scenarios(spark, sf_dir):
    """Each third of the cohort as a replicate."""
    people = fx.censored(spark, sf_dir).withColumn("rep", (F.col("id") % 3).cast("int")).withColumn("scenario", F.lit("base"))
    return people.groupBy("scenario", "rep", "generation").agg(F.avg(F.col("affected1").cast("double")).alias("value"))


_REPS = CENS + ", r AS (SELECT 'base' AS scenario, CAST(id % 3 AS INTEGER) AS rep, generation, avg(CAST(affected1 AS DOUBLE)) AS value FROM cens GROUP BY ALL) "


@query("rep_envelope", _REPS + "SELECT scenario, generation, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high, count(*) AS n_reps FROM r GROUP BY ALL")
def rep_envelope(spark, sf_dir):
    return _round(compare.envelope(_scenarios(spark, sf_dir), ["scenario", "generation"]), "mean", "low", "high")


@query("paper_table", _REPS + "SELECT scenario, generation, printf('%.4f ± %.4f', avg(value), stddev_samp(value)) AS cell FROM r GROUP BY ALL")
def paper_table(spark, sf_dir):
    return compare.mean_sd_table(_scenarios(spark, sf_dir), ["scenario", "generation"])


@query("bias_table", _REPS + "SELECT scenario, rep, generation, round(value - 0.1, 6) AS bias FROM r")
def bias_table(spark, sf_dir):
    return _round(compare.bias(_scenarios(spark, sf_dir), 0.1), "bias").select("scenario", "rep", "generation", "bias")


@query("mate_matrix_over_reps", f"""WITH {fx.SQL_LIAB}, r AS (SELECT id % 3 AS rep, * FROM liab), c AS (SELECT DISTINCT rep, mother, father FROM r WHERE mother >= 0 AND father >= 0),
m AS (SELECT c.rep, """ + ", ".join(f"corr(m.liability{i}, f.liability{j}) AS m{i}_f{j}" for i in (1, 2) for j in (1, 2)) + """ FROM c JOIN liab m ON c.mother = m.id JOIN liab f ON c.father = f.id GROUP BY c.rep)
SELECT count(*) AS n_reps, """ + ", ".join(f"round(avg(m{i}_f{j}), 6) AS m{i}_f{j}" for i in (1, 2) for j in (1, 2)) + " FROM m")
def mate_matrix_over_reps(spark, sf_dir):
    """Each third of the children as a replicate, with everyone as possible parents."""
    people = _liab(spark, sf_dir)
    thirds = {k: people.withColumns({c: F.when(F.col("id") % 3 == k, F.col(c)).otherwise(-1) for c in ("mother", "father")}) for k in range(3)}
    return _round(compare.mate_matrix(thirds), "m1_f1", "m1_f2", "m2_f1", "m2_f2")
