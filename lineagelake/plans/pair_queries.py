"""Queries on relative pairs, their correlations, and parent-offspring regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineagelake.functions import rng
from lineagelake.operators import correlations as cor
from lineagelake.operators import families
from lineagelake.operators import relatives as rel
from lineagelake.operators.close_kin import close_pairs
from lineagelake.plans.registry import ndtri_sql, phi_sql, query
from lineagelake.sources import fixture as fx


def _round(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


_SQL_PAIRS = """
edges AS (SELECT id AS child, mother AS parent, 'MO' AS role FROM ped WHERE mother >= 0 UNION ALL SELECT id, father, 'FO' FROM ped WHERE father >= 0),
fs AS (SELECT a.id AS x, b.id AS y FROM ped a JOIN ped b ON a.mother = b.mother AND a.father = b.father AND a.id < b.id WHERE a.mother >= 0 AND a.father >= 0 AND NOT (a.twin = b.id)),
mhs AS (SELECT a.id AS x, b.id AS y FROM ped a JOIN ped b ON a.mother = b.mother AND a.father != b.father AND a.id < b.id WHERE a.mother >= 0),
phs AS (SELECT a.id AS x, b.id AS y FROM ped a JOIN ped b ON a.father = b.father AND a.mother != b.mother AND a.id < b.id WHERE a.father >= 0),
gp AS (SELECT DISTINCT a.child AS x, b.parent AS y FROM edges a JOIN edges b ON a.parent = b.child),
fs2 AS (SELECT x, y FROM fs UNION ALL SELECT y, x FROM fs),
av AS (SELECT DISTINCT least(s.y, e.child) AS x, greatest(s.y, e.child) AS y FROM fs2 s JOIN edges e ON e.parent = s.x WHERE s.y != e.child),
c1 AS (SELECT DISTINCT least(e.child, g.child) AS x, greatest(e.child, g.child) AS y FROM fs s JOIN edges e ON e.parent = s.x JOIN edges g ON g.parent = s.y WHERE e.child != g.child),
every_pair AS (
  SELECT 0 AS rank, 'MZ' AS rel, id AS id1, twin AS id2 FROM ped WHERE twin > id
  UNION ALL SELECT CASE role WHEN 'MO' THEN 1 ELSE 2 END, role, child, parent FROM edges
  UNION ALL SELECT 3, 'FS', x, y FROM fs UNION ALL SELECT 4, 'MHS', x, y FROM mhs UNION ALL SELECT 5, 'PHS', x, y FROM phs
  UNION ALL SELECT 6, 'GP', x, y FROM gp UNION ALL SELECT 7, 'Av', x, y FROM av UNION ALL SELECT 8, '1C', x, y FROM c1),
pairs AS (
  SELECT rel, id1, id2 FROM (SELECT *, row_number() OVER (PARTITION BY least(id1, id2), greatest(id1, id2) ORDER BY rank, id1, id2) AS k FROM every_pair) WHERE k = 1)
"""
PAIRS = f"WITH {fx.SQL_PED}, {_SQL_PAIRS}"
VALUES = f"WITH {fx.SQL_CENS}, {_SQL_PAIRS}, " + """
pv AS (
  SELECT rel, 1 AS trait, a.sex AS sex_1, b.sex AS sex_2, a.generation AS g1, a.liability1 AS l1, b.liability1 AS l2, a.affected1 AS a1, b.affected1 AS a2 FROM pairs p JOIN cens a ON p.id1 = a.id JOIN cens b ON p.id2 = b.id
  UNION ALL SELECT rel, 2, a.sex, b.sex, a.generation, a.liability2, b.liability2, a.affected2, b.affected2 FROM pairs p JOIN cens a ON p.id1 = a.id JOIN cens b ON p.id2 = b.id)
"""
_CELLS = "count(*) AS n_pairs, count(*) FILTER (a1 AND a2) AS n11, count(*) FILTER (a1 AND NOT a2) AS n10, count(*) FILTER (NOT a1 AND a2) AS n01, count(*) FILTER (NOT a1 AND NOT a2) AS n00"

_NAMES = {"pairs_mz": ("MZ",), "pairs_po": ("MO", "FO"), "pairs_fs": ("FS",), "pairs_mhs": ("MHS",), "pairs_phs": ("PHS",), "pairs_gp": ("GP",), "pairs_avuncular": ("Av",), "pairs_cousin": ("1C",)}
for _name, _codes in _NAMES.items():
    query(_name, PAIRS + f"SELECT rel, id1, id2 FROM pairs WHERE rel IN {str(_codes).replace(',)', ')')}")(
        lambda spark, sf_dir, codes=_codes: rel.extract_pairs(fx.pedigree(spark, sf_dir), 2, codes=codes)
    )


@query("pair_counts", PAIRS + "SELECT rel, count(*) AS n_pairs FROM pairs GROUP BY rel")
def pair_counts(spark, sf_dir):
    return rel.count_pairs(rel.extract_pairs(fx.pedigree(spark, sf_dir), 2))


@query("pair_counts_subsample", PAIRS + ", s AS (SELECT id FROM ped WHERE " + fx._h("S", "id") + " % 3 = 0) SELECT rel, count(*) AS n_pairs FROM pairs WHERE id1 IN (SELECT id FROM s) AND id2 IN (SELECT id FROM s) GROUP BY rel")
def pair_counts_subsample(spark, sf_dir):
    ped = fx.pedigree(spark, sf_dir)
    return rel.count_pairs(rel.extract_pairs(ped, 2, sample=ped.filter(rng.integer("S", F.col("id")) % 3 == 0)))


_CLOSE = "rel IN ('MZ', 'MO', 'FO', 'FS', 'MHS', 'PHS')"


@query("pair_counts_by_family", PAIRS + f"SELECT rel, count(*) AS n_pairs FROM pairs WHERE {_CLOSE} GROUP BY rel")
def pair_counts_by_family(spark, sf_dir):
    return families.family_pair_counts(fx.pedigree(spark, sf_dir))


@query("liability_corr_by_family", VALUES + f"SELECT rel, trait, count(*) AS n_pairs, round(CASE WHEN count(*) >= 10 THEN corr(l1, l2) END, 6) AS r FROM pv WHERE {_CLOSE} GROUP BY rel, trait")
def liability_corr_by_family(spark, sf_dir):
    return _round(families.family_correlations(fx.liabilities(fx.pedigree(spark, sf_dir))), "r")


@query("twobytwo_by_family", VALUES + f"SELECT rel, trait, {_CELLS} FROM pv WHERE {_CLOSE} GROUP BY rel, trait")
def twobytwo_by_family(spark, sf_dir):
    return families.family_two_by_two(fx.censored(spark, sf_dir))


def _deep_sql(hops: int) -> str:
    out = ", a1 AS (SELECT DISTINCT child AS id, parent AS anc FROM edges)"
    for k in range(2, hops + 1):
        out += f", a{k} AS (SELECT DISTINCT a.id, e.parent AS anc FROM a{k - 1} a JOIN edges e ON a.anc = e.child)"
    return out


@query("ancestor_pairs_by_distance", PAIRS + _deep_sql(5) + " SELECT up, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT {k} AS up, id, anc FROM a{k}" for k in range(1, 6)) + ") GROUP BY up")
def ancestor_pairs(spark, sf_dir):
    anc = rel.ancestors(rel.parent_edges(fx.pedigree(spark, sf_dir)), 5)
    out = None
    for k, df in anc.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(k).alias("up"), "n")
        out = part if out is None else out.unionByName(part)
    return out


#: Codes through siblings: half (or full) siblings, steps down from the one and from the other.
_FAR = {"HAv": ("hs", 0, 1), "GAv": ("fs", 0, 2), "HGAv": ("hs", 0, 2), "GGAv": ("fs", 0, 3), "H1C": ("hs", 1, 1), "1C1R": ("fs", 1, 2), "HGGAv": ("hs", 0, 3), "G3Av": ("fs", 0, 4), "H1C1R": ("hs", 1, 2), "1C2R": ("fs", 1, 3), "2C": ("fs", 2, 2)}


def _far_sql() -> str:
    out = _deep_sql(5) + ", a0 AS (SELECT id, id AS anc FROM ped), hs AS (SELECT x, y FROM mhs UNION SELECT x, y FROM phs)"
    ranks = {c: i for i, c in enumerate(rel.CODES)}
    parts = ["SELECT rank, rel, id1, id2 FROM every_pair WHERE rel NOT IN ('GP', 'Av', '1C')"]
    parts += [f"SELECT {ranks[c]}, '{c}', id, anc FROM a{k}" for c, k in (("GP", 2), ("GGP", 3), ("GGGP", 4), ("G3GP", 5))]
    for c, (kind, a, b) in {"Av": ("fs", 0, 1), "1C": ("fs", 1, 1), **_FAR}.items():
        both = f"(SELECT x, y FROM {kind} UNION ALL SELECT y, x FROM {kind})"
        parts.append(f"SELECT DISTINCT {ranks[c]}, '{c}', least(l.id, r.id), greatest(l.id, r.id) FROM {both} s JOIN a{a} l ON l.anc = s.x JOIN a{b} r ON r.anc = s.y WHERE l.id != r.id")
    return out + f", far AS ({' UNION ALL '.join(parts)}), closest AS (SELECT rel FROM (SELECT *, row_number() OVER (PARTITION BY least(id1, id2), greatest(id1, id2) ORDER BY rank, id1, id2) AS k FROM far) WHERE k = 1)"


@query("pair_counts_degree5", PAIRS + _far_sql() + " SELECT rel, count(*) AS n_pairs FROM closest GROUP BY rel")
def pair_counts_degree5(spark, sf_dir):
    return rel.count_all_pairs(fx.pedigree(spark, sf_dir))


@query("relatives_features", f"WITH {fx.SQL_CENS}, {_SQL_PAIRS}, " + """
d AS (SELECT rel, id1 AS id, id2 AS kin FROM pairs UNION ALL SELECT rel, id2, id1 FROM pairs WHERE rel NOT IN ('MO', 'FO', 'GP')),
j AS (SELECT d.rel, d.id, CAST(k.affected1 AS INTEGER) AS hit FROM d JOIN cens k ON d.kin = k.id JOIN cens p ON d.id = p.id WHERE d.rel != 'Av' OR p.generation > k.generation)
SELECT c.id, """ + ", ".join(f"CAST(count(*) FILTER (rel = '{k}' AND hit = 1) AS BIGINT) AS \"diagnosed_relatives_{k}\", count(*) FILTER (rel = '{k}') AS \"n_relatives_{k}\"" for k in ("MZ", "MO", "FO", "FS", "MHS", "PHS", "GP", "Av", "1C")) + " FROM cens c LEFT JOIN j ON c.id = j.id GROUP BY c.id")
def relatives_features(spark, sf_dir):
    people = fx.censored(spark, sf_dir)
    return rel.relative_counts(people, rel.extract_pairs(people, 2), "affected1", ("MZ", "MO", "FO", "FS", "MHS", "PHS", "GP", "Av", "1C"))


def _pairs(spark, sf_dir, *columns):
    """People, and their pairs with the members' values in these columns, of both traits but for sex and generation."""
    people = fx.censored(spark, sf_dir)
    return people, close_pairs(people, tuple(n for c in columns for n in ([c] if c in people.columns else [f"{c}1", f"{c}2"])))


@query("liability_corr_by_pair", VALUES + "SELECT rel, trait, count(*) AS n_pairs, round(CASE WHEN count(*) >= 10 THEN corr(l1, l2) END, 6) AS r FROM pv GROUP BY rel, trait")
def liability_corr(spark, sf_dir):
    return _round(cor.liability_correlations(*_pairs(spark, sf_dir, "liability")), "r")


_PHI = VALUES + ", phis AS (SELECT rel, trait, count(*) AS n_pairs, CASE WHEN count(*) >= 10 AND var_pop(CAST(a1 AS DOUBLE)) > 0 AND var_pop(CAST(a2 AS DOUBLE)) > 0 THEN corr(CAST(a1 AS DOUBLE), CAST(a2 AS DOUBLE)) END AS phi FROM pv GROUP BY rel, trait) "


@query("phi_by_pair", _PHI + "SELECT rel, trait, n_pairs, round(phi, 6) AS phi FROM phis")
def phi_by_pair(spark, sf_dir):
    return _round(cor.phi(*_pairs(spark, sf_dir, "affected")), "phi")


@query("twobytwo_by_pair", VALUES + f"SELECT rel, trait, {_CELLS} FROM pv GROUP BY rel, trait")
def twobytwo(spark, sf_dir):
    people, pairs = _pairs(spark, sf_dir, "affected")
    return cor.two_by_two(cor.pair_values(people, pairs, "affected"), ["rel", "trait"])


@query("twobytwo_by_pair_sex", VALUES + f"SELECT rel, trait, sex_1 AS sex, {_CELLS} FROM pv WHERE sex_1 = sex_2 GROUP BY rel, trait, sex_1")
def twobytwo_sex(spark, sf_dir):
    return cor.pairs_by_sex(*_pairs(spark, sf_dir, "sex", "affected"))


@query("twobytwo_by_pair_generation", VALUES + f"SELECT rel, trait, g1 AS generation, {_CELLS} FROM pv WHERE g1 >= 3 GROUP BY rel, trait, g1")
def twobytwo_generation(spark, sf_dir):
    return cor.pairs_by_generation(*_pairs(spark, sf_dir, "generation", "affected"))


@query("cross_trait_twobytwo", f"WITH {fx.SQL_CENS}, {_SQL_PAIRS}, x AS (SELECT rel, a.affected1 AS a1, b.affected2 AS a2 FROM pairs p JOIN cens a ON p.id1 = a.id JOIN cens b ON p.id2 = b.id UNION ALL SELECT 'self', affected1, affected2 FROM cens) SELECT rel, {_CELLS} FROM x GROUP BY rel")
def cross_trait(spark, sf_dir):
    return cor.cross_trait_counts(*_pairs(spark, sf_dir, "affected"))


_BVN = """({p1} * {p2} + asin({r}) / (2 * pi()) / 1200 * list_sum([CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
  * exp(-(h * h - 2 * h * k * sin(asin({r}) * i / 400) + k * k) / (2 * pow(cos(asin({r}) * i / 400), 2))) for i in range(0, 401)]))"""


def _tetrachoric_sql(cells: str, keys: str, at_least: int = 10, head: str = "") -> str:
    """The correlation in SQL: with the margins' thresholds, the likelihood is greatest where P11 is the observed share.

    Thresholds and correlation by bisection, P11 by the integral of the density over the correlation (Simpson's rule).
    """
    half = lambda lo, hi: f"(({lo} + {hi}) / 2)"
    step = lambda lo, hi, above: f"CASE WHEN {above} THEN {half(lo, hi)} ELSE {lo} END AS {lo}, CASE WHEN {above} THEN {hi} ELSE {half(lo, hi)} END AS {hi}"
    over = lambda c: f"1 - {phi_sql(half(f'{c}lo', f'{c}hi'))} > {'p1' if c == 'h' else 'p2'}"
    low = _BVN.format(p1="p1", p2="p2", r=half("rlo", "rhi")) + " < p11"
    d = "exp(-(h * h - 2 * r * h * k + k * k) / (2 * (1 - r * r))) / (2 * pi() * sqrt(1 - r * r))"
    return f"""{cells.replace('WITH ', 'WITH RECURSIVE ', 1)}{head},
shares AS (SELECT *, (n11 + n10) / n_pairs AS p1, (n11 + n01) / n_pairs AS p2, n11 / n_pairs AS p11 FROM counts),
usable AS MATERIALIZED (SELECT * FROM shares WHERE n_pairs >= {at_least} AND p1 > 0 AND p1 < 1 AND p2 > 0 AND p2 < 1),
edge_of AS (SELECT *, CAST(-7 AS DOUBLE) AS hlo, CAST(7 AS DOUBLE) AS hhi, CAST(-7 AS DOUBLE) AS klo, CAST(7 AS DOUBLE) AS khi, 0 AS n FROM usable
  UNION ALL SELECT * EXCLUDE (hlo, hhi, klo, khi, n), {step('hlo', 'hhi', over('h'))}, {step('klo', 'khi', over('k'))}, n + 1 FROM edge_of WHERE n < 55),
cut_at AS MATERIALIZED (SELECT * EXCLUDE (hlo, hhi, klo, khi, n), hlo AS h, klo AS k FROM edge_of WHERE n = 55),
walk AS (SELECT *, CAST(-0.999 AS DOUBLE) AS rlo, CAST(0.999 AS DOUBLE) AS rhi, 0 AS n FROM cut_at UNION ALL SELECT * EXCLUDE (rlo, rhi, n), {step('rlo', 'rhi', low)}, n + 1 FROM walk WHERE n < 45),
fitted AS (SELECT *, CASE WHEN n11 = 0 OR n00 = 0 THEN -0.999 WHEN n10 = 0 OR n01 = 0 THEN 0.999 ELSE {half('rlo', 'rhi')} END AS r FROM walk WHERE n = 45),
told AS (SELECT {keys}, r, pow({d}, 2) * n_pairs * (1 / greatest(f11, 1e-12) + 1 / greatest(p1 - f11, 1e-12) + 1 / greatest(p2 - f11, 1e-12) + 1 / greatest(1 - p1 - p2 + f11, 1e-12)) AS info FROM (SELECT *, {_BVN.format(p1='p1', p2='p2', r='r')} AS f11 FROM fitted))
SELECT c.*, round(r, 4) AS r, CASE WHEN info > 1e-4 AND least(n11, n10, n01, n00) > 0 THEN round(1 / sqrt(info), 4) END AS se FROM counts c LEFT JOIN told USING ({keys})"""


def _fitted(df):
    return _round(df, "r", "se", places=4)


_COUNTS = VALUES + ", counts AS (SELECT {keys}, " + _CELLS + " FROM pv {where} GROUP BY {by})"


@query("tetrachoric_by_pair", _tetrachoric_sql(_COUNTS.format(keys="rel, trait", where="", by="rel, trait"), "rel, trait"))
def tetrachoric_by_pair(spark, sf_dir):
    people, pairs = _pairs(spark, sf_dir, "affected")
    return _fitted(cor.with_tetrachoric(cor.two_by_two(cor.pair_values(people, pairs, "affected"), ["rel", "trait"])))


@query("tetrachoric_by_sex", _tetrachoric_sql(_COUNTS.format(keys="rel, trait, sex_1 AS sex", where="WHERE sex_1 = sex_2", by="rel, trait, sex_1"), "rel, trait, sex"))
def tetrachoric_by_sex(spark, sf_dir):
    return _fitted(cor.with_tetrachoric(cor.pairs_by_sex(*_pairs(spark, sf_dir, "sex", "affected"))))


_LIABILITY_R = ", CASE WHEN count(*) >= 10 THEN round(corr(l1, l2), 6) END AS liability_r"


@query("tetrachoric_by_generation", _tetrachoric_sql(_COUNTS.replace(_CELLS, _CELLS + _LIABILITY_R).format(keys="rel, trait, g1 AS generation", where="WHERE g1 >= 3", by="rel, trait, g1"), "rel, trait, generation"))
def tetrachoric_by_generation(spark, sf_dir):
    return _round(_fitted(cor.tetrachoric_by_generation(*_pairs(spark, sf_dir, "generation", "affected", "liability"))), "liability_r")


_CROSS = f"WITH {fx.SQL_CENS}, {_SQL_PAIRS}, x AS (SELECT rel, a.affected1 AS a1, b.affected2 AS a2 FROM pairs p JOIN cens a ON p.id1 = a.id JOIN cens b ON p.id2 = b.id UNION ALL SELECT 'self', affected1, affected2 FROM cens), counts AS (SELECT rel, {_CELLS} FROM x GROUP BY rel)"


@query("tetrachoric_cross_trait", _tetrachoric_sql(_CROSS, "rel"))
def tetrachoric_cross(spark, sf_dir):
    return _fitted(cor.with_tetrachoric(cor.cross_trait_counts(*_pairs(spark, sf_dir, "affected"))))


_SELF = f"WITH {fx.SQL_CENS}, x AS (SELECT generation, affected1 AS a1, affected2 AS a2 FROM cens WHERE generation >= 3), counts AS (SELECT generation, {_CELLS} FROM x GROUP BY generation)"


@query("tetrachoric_same_person_by_generation", _tetrachoric_sql(_SELF, "generation", 50))
def tetrachoric_same_person(spark, sf_dir):
    return _fitted(cor.same_person_by_generation(fx.censored(spark, sf_dir)))


@query("first_sib_pairs", f"""WITH {fx.SQL_LIAB}, k AS (SELECT mother, father, liability1, liability2, row_number() OVER (PARTITION BY mother, father ORDER BY id) AS nth FROM liab WHERE mother >= 0 AND twin = -1)
SELECT a.mother, a.father, t.trait, round(CASE WHEN t.trait = 1 THEN a.liability1 ELSE a.liability2 END, 6) AS a, round(CASE WHEN t.trait = 1 THEN b.liability1 ELSE b.liability2 END, 6) AS b
FROM k a JOIN k b ON a.mother = b.mother AND a.father = b.father AND a.nth = 1 AND b.nth = 2, (VALUES (1), (2)) t(trait)""")
def first_sib_pairs(spark, sf_dir):
    return _round(cor.first_sib_pairs(fx.liabilities(fx.pedigree(spark, sf_dir))), "a", "b")


_COHORT = VALUES + """, cohort AS (SELECT rel, trait, generation, count(*) AS n, corr(l1, l2) AS r FROM (
  SELECT rel, 1 AS trait, a.generation, a.liability1 AS l1, b.liability1 AS l2 FROM pairs p JOIN cens a ON p.id1 = a.id JOIN cens b ON p.id2 = b.id AND a.generation = b.generation WHERE rel IN ('MZ', 'FS')
  UNION ALL SELECT rel, 2, a.generation, a.liability2, b.liability2 FROM pairs p JOIN cens a ON p.id1 = a.id JOIN cens b ON p.id2 = b.id AND a.generation = b.generation WHERE rel IN ('MZ', 'FS')) GROUP BY ALL),
x AS (SELECT 1 AS trait, generation, A1 AS A, C1 AS C, E1 AS E FROM cens UNION ALL SELECT 2, generation, A2, C2, E2 FROM cens), v AS (SELECT trait, generation, var_samp(A) AS vA, var_samp(C) AS vC, var_samp(E) AS vE FROM x GROUP BY trait, generation),
w AS (SELECT trait, generation, max(r) FILTER (rel = 'MZ' AND n >= 10) AS r_mz, max(r) FILTER (rel = 'FS' AND n >= 10) AS r_fs, coalesce(max(n) FILTER (rel = 'MZ'), 0) AS n_mz, coalesce(max(n) FILTER (rel = 'FS'), 0) AS n_fs FROM cohort GROUP BY trait, generation)
SELECT trait, generation, round(vA / (vA + vC + vE), 6) AS h2, round(r_mz, 6) AS r_mz, round(r_fs, 6) AS r_fs, n_mz, n_fs, round(2 * (r_mz - r_fs), 5) AS falconer FROM v LEFT JOIN w USING (trait, generation)"""


@query("falconer_by_generation", _COHORT)
def falconer_by_generation(spark, sf_dir):
    people, pairs = _pairs(spark, sf_dir, "generation", "liability")
    out = _round(_round(cor.falconer_by_generation(people, pairs), "h2", "r_mz", "r_fs"), "falconer", places=5)
    return out.select("trait", "generation", "h2", "r_mz", "r_fs", "n_mz", "n_fs", "falconer")


@query("naive_h2_estimators", VALUES + """, c AS (SELECT rel, trait, CASE WHEN count(*) >= 10 THEN corr(l1, l2) END AS r FROM pv GROUP BY rel, trait),
w AS (SELECT trait, max(r) FILTER (rel = 'MZ') AS mz, max(r) FILTER (rel = 'FS') AS fs, max(r) FILTER (rel = 'MHS') AS m, max(r) FILTER (rel = 'PHS') AS p, max(r) FILTER (rel = '1C') AS c FROM c GROUP BY trait),
po AS (SELECT 1 AS trait, regr_slope(k.liability1, (m.liability1 + f.liability1) / 2) AS po FROM cens k JOIN cens m ON k.mother = m.id JOIN cens f ON k.father = f.id UNION ALL SELECT 2, regr_slope(k.liability2, (m.liability2 + f.liability2) / 2) FROM cens k JOIN cens m ON k.mother = m.id JOIN cens f ON k.father = f.id),
v AS (SELECT 1 AS trait, var_samp(A1) AS a, var_samp(C1) AS c, var_samp(E1) AS e FROM cens UNION ALL SELECT 2, var_samp(A2), var_samp(C2), var_samp(E2) FROM cens)
SELECT trait, round(2 * (mz - fs), 5) AS falconer, round(2 * fs, 5) AS sibs, round(po, 5) AS po, round(4 * (coalesce(m, p) + coalesce(p, m)) / 2, 5) AS half_sibs, round(8 * w.c, 5) AS cousins, round(v.a / (v.a + v.c + v.e), 5) AS realized FROM w JOIN po USING (trait) JOIN v USING (trait)""")
def naive_h2(spark, sf_dir):
    return _round(cor.naive_h2(*_pairs(spark, sf_dir, "liability")), "falconer", "sibs", "po", "half_sibs", "cousins", "realized", places=5)


@query("observed_vs_liability_h2", _PHI + f""", k AS (SELECT trait, avg(CAST(a AS DOUBLE)) AS k FROM (SELECT 1 AS trait, affected1 AS a FROM cens UNION ALL SELECT 2, affected2 FROM cens) GROUP BY trait),
o AS (SELECT trait, 2 * (max(phi) FILTER (rel = 'MZ') - max(phi) FILTER (rel = 'FS')) AS observed FROM phis GROUP BY trait)
SELECT trait, round(k, 5) AS prevalence, round(observed, 5) AS observed, round(observed * CASE WHEN k > 0 AND k < 1 THEN k * (1 - k) / pow(exp(-pow({ndtri_sql('k')}, 2) / 2) / sqrt(2 * pi()), 2) END, 5) AS liability FROM k LEFT JOIN o USING (trait)""")
def observed_vs_liability_h2(spark, sf_dir):
    return _round(cor.observed_and_liability_h2(*_pairs(spark, sf_dir, "affected")), "prevalence", "observed", "liability", places=5)


def _po_sql(by: str, column: str) -> str:
    keys = "trait" + by
    p = f"CASE WHEN z < 7 THEN 2 * (1 - {phi_sql('z')}) ELSE 0 END"
    part = lambda n: f"SELECT {n} AS trait, k.sex, k.generation, CAST(k.{column}{n} AS DOUBLE) AS y, (CAST(m.{column}{n} AS DOUBLE) + CAST(f.{column}{n} AS DOUBLE)) / 2 AS x FROM cens k JOIN cens m ON k.mother = m.id JOIN cens f ON k.father = f.id"
    return f"""WITH {fx.SQL_CENS}, po AS ({part(1)} UNION ALL {part(2)}),
g AS (SELECT {keys}, count(*) AS n, corr(x, y) AS r, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, var_pop(y) AS vy, var_pop(x) AS vx FROM po GROUP BY {keys})
SELECT {keys}, n, round(r, 6) AS r, round(r * r, 6) AS r2, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(sqrt((1 - r * r) * vy / ((n - 2) * vx)), 6) AS stderr, round({p}, 5) AS p FROM (SELECT *, abs(r) * sqrt((n - 2) / (1 - r * r)) * (1 - 1 / (4.0 * (n - 2))) AS z FROM g)"""


for _name, _by, _col in (("po_regression_by_generation", ("generation",), "liability"), ("po_regression_by_sex", ("sex",), "liability"), ("po_affected_regression", (), "affected")):

    def _po(spark, sf_dir, by=_by, col=_col):
        out = cor.parent_offspring(fx.censored(spark, sf_dir), by, col)
        return _round(_round(out, "r", "r2", "slope", "intercept", "stderr"), "p", places=5)

    query(_name, _po_sql("".join(f", {c}" for c in _by), _col))(_po)


@query("observed_h2_estimators", _PHI + """, w AS (SELECT trait, max(phi) FILTER (rel = 'MZ') AS mz, max(phi) FILTER (rel = 'FS') AS fs, max(phi) FILTER (rel = 'MHS') AS m, max(phi) FILTER (rel = 'PHS') AS p, max(phi) FILTER (rel = '1C') AS c FROM phis GROUP BY trait)
SELECT trait, round(2 * (mz - fs), 5) AS falconer, round(2 * fs, 5) AS sibs, round(4 * (coalesce(m, p) + coalesce(p, m)) / 2, 5) AS half_sibs, round(8 * c, 5) AS cousins FROM w""")
def observed_h2(spark, sf_dir):
    return _round(cor.observed_h2(cor.phi(*_pairs(spark, sf_dir, "affected"))), "falconer", "sibs", "half_sibs", "cousins", places=5)


@query("pooled_pair_corr", VALUES + ", c AS (SELECT rel, trait, CASE WHEN count(*) >= 10 THEN corr(l1, l2) END AS r FROM pv GROUP BY rel, trait) SELECT trait, CASE WHEN rel IN ('MO', 'FO') THEN 'PO' WHEN rel IN ('MHS', 'PHS') THEN 'HS' ELSE rel END AS kind, round(avg(r), 6) AS r FROM c GROUP BY ALL")
def pooled_corr(spark, sf_dir):
    return _round(cor.pooled(cor.liability_correlations(*_pairs(spark, sf_dir, "liability"))), "r")


@query("realized_h2_by_generation", f"WITH {fx.SQL_LIAB}, x AS (SELECT 1 AS trait, generation, A1 AS A, C1 AS C, E1 AS E FROM liab UNION ALL SELECT 2, generation, A2, C2, E2 FROM liab), v AS (SELECT trait, generation, var_samp(A) AS vA, var_samp(C) AS vC, var_samp(E) AS vE FROM x GROUP BY trait, generation) SELECT trait, generation, round(vA, 6) AS \"vA\", round(vC, 6) AS \"vC\", round(vE, 6) AS \"vE\", round(vA / (vA + vC + vE), 6) AS h2, round((vA + vC) / (vA + vC + vE), 6) AS broad_h2 FROM v")
def realized_h2(spark, sf_dir):
    return _round(cor.realized_h2(fx.liabilities(fx.pedigree(spark, sf_dir))), "vA", "vC", "vE", "h2", "broad_h2")


@query("mate_correlation_matrix", f"WITH {fx.SQL_LIAB}, c AS (SELECT DISTINCT mother, father FROM liab WHERE mother >= 0 AND father >= 0) SELECT count(*) AS n_couples, " + ", ".join(f"round(corr(m.liability{i}, f.liability{j}), 6) AS m{i}_f{j}" for i in (1, 2) for j in (1, 2)) + " FROM c JOIN liab m ON c.mother = m.id JOIN liab f ON c.father = f.id")
def mate_matrix(spark, sf_dir):
    return _round(cor.mate_correlations(fx.liabilities(fx.pedigree(spark, sf_dir))), "m1_f1", "m1_f2", "m2_f1", "m2_f2")
