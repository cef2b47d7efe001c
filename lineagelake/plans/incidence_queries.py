"""Queries on prevalence, incidence, mortality and censoring over the derived cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineagelake.operators import incidence as inc
from lineagelake.plans.registry import query
from lineagelake.sources import fixture as fx

AGE, WIN = fx.CENSOR_AGE, fx.WINDOWS

_LONG = ", ".join
_TRAITS = f"""WITH {fx.SQL_CENS},
tr AS (
  SELECT id, sex, generation, 1 AS trait, t1 AS t, t_observed1 AS t_observed, affected1 AS affected, age_censored1 AS age_censored, death_censored1 AS death_censored, death_age, A1 AS A, C1 AS C, E1 AS E, liability1 AS liability FROM cens
  UNION ALL
  SELECT id, sex, generation, 2, t2, t_observed2, affected2, age_censored2, death_censored2, death_age, A2, C2, E2, liability2 FROM cens),
trw AS (SELECT tr.*, lo, hi FROM tr JOIN windows w ON tr.generation = w.generation)
"""


def _round(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


@query("prevalence_by_generation", _TRAITS + "SELECT trait, generation, count(*) AS n, round(avg(CAST(affected AS DOUBLE)), 6) AS prevalence FROM tr GROUP BY trait, generation")
def prevalence_by_generation(spark, sf_dir):
    return _round(inc.prevalence(fx.censored(spark, sf_dir)), "prevalence")


@query("prevalence_grouping_sets", _TRAITS + "SELECT trait, sex, generation, count(*) AS n, round(avg(CAST(affected AS DOUBLE)), 6) AS prevalence FROM tr GROUP BY GROUPING SETS ((trait), (trait, sex), (trait, generation), (trait, sex, generation))")
def prevalence_sets(spark, sf_dir):
    return _round(inc.prevalence_grouping_sets(fx.censored(spark, sf_dir)), "prevalence")


_LIFE = f"""WITH {fx.SQL_CENS},
bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(8)),
life AS (
  SELECT bin, CAST(bin * 10 AS VARCHAR) || '-' || CAST(bin * 10 + 9 AS VARCHAR) AS age, count(*) FILTER (death_age >= bin * 10) AS alive,
         count(*) FILTER (death_age >= bin * 10 AND death_age < bin * 10 + 10 AND death_age < 80) AS died
  FROM bins, cens GROUP BY bin),
rates AS (SELECT *, CASE WHEN alive > 0 THEN died / alive ELSE 0.0 END AS rate FROM life)
"""


@query("mortality_lifetable", _LIFE + "SELECT bin, age, alive, died, round(rate, 6) AS rate FROM rates")
def mortality_lifetable(spark, sf_dir):
    return _round(inc.mortality(fx.censored(spark, sf_dir), AGE), "rate")


@query("survival_curve", _LIFE + "SELECT bin, age, round(rate, 6) AS rate, round(exp(sum(ln(1 - rate)) OVER (ORDER BY bin)), 6) AS survival, round(1 - exp(sum(ln(1 - rate)) OVER (ORDER BY bin)), 6) AS cumulative_mortality FROM rates")
def survival_curve(spark, sf_dir):
    return _round(inc.survival(inc.mortality(fx.censored(spark, sf_dir), AGE)), "rate", "survival", "cumulative_mortality")


def _curve_sql(by: str, points: int = 200) -> str:
    keys = "trait" + by
    join = " AND ".join(f"s.{k.strip()} = tr.{k.strip()}" for k in keys.split(","))
    return _TRAITS + f""", grid AS (SELECT CAST(range AS BIGINT) AS k, CAST(range AS DOUBLE) * (CAST(80.0 AS DOUBLE) / {points - 1}) AS age FROM range({points})),
marks AS (
  SELECT {keys}, CASE WHEN affected THEN t_observed END AS o, t FROM tr),
hist AS (
  SELECT {keys}, k, count(*) FILTER (kind = 'o') AS o, count(*) FILTER (kind = 't') AS t FROM (
    SELECT {keys}, 'o' AS kind, (SELECT min(k) FROM grid g WHERE g.age >= o) AS k FROM marks WHERE o IS NOT NULL
    UNION ALL SELECT {keys}, 't', (SELECT min(k) FROM grid g WHERE g.age >= t) FROM marks) GROUP BY {keys}, k),
sizes AS (SELECT {keys}, count(*) AS n FROM tr GROUP BY {keys}),
curve AS (
  SELECT {", ".join("s." + k.strip() for k in keys.split(","))}, g.k, g.age, s.n,
         sum(coalesce(h.o, 0)) OVER w / s.n AS observed, sum(coalesce(h.t, 0)) OVER w / s.n AS true_value
  FROM sizes s CROSS JOIN grid g LEFT JOIN hist h ON {" AND ".join(f"h.{k.strip()} = s.{k.strip()}" for k in keys.split(","))} AND h.k = g.k
  WINDOW w AS (PARTITION BY {", ".join("s." + k.strip() for k in keys.split(","))} ORDER BY g.k))
"""


for _name, _by in (("cif_overall", ()), ("cif_by_sex", ("sex",)), ("cif_by_sex_generation", ("sex", "generation"))):
    _sql = "".join(f", {c}" for c in _by)
    query(_name, _curve_sql(_sql) + f"SELECT trait{_sql}, k, round(age, 6) AS age, n, round(observed, 6) AS observed, round(true_value, 6) AS true_value FROM curve")(
        lambda spark, sf_dir, by=_by: _round(inc.cumulative_incidence(fx.censored(spark, sf_dir), AGE, by=by), "age", "observed", "true_value")
    )


@query("cif_half_target_age", _curve_sql("") + ", l AS (SELECT *, max_by(observed, k) OVER (PARTITION BY trait) AS last FROM curve) SELECT trait, round(min(age), 6) AS half_target_age FROM l WHERE observed >= last / 2 GROUP BY trait")
def half_target(spark, sf_dir):
    return _round(inc.half_target_age(inc.cumulative_incidence(fx.censored(spark, sf_dir), AGE)), "half_target_age")


@query("onset_quartiles", _curve_sql("") + ", l AS (SELECT *, max_by(observed, k) OVER (PARTITION BY trait) AS last FROM curve) SELECT trait, " + ", ".join(f"round(min(CASE WHEN last >= 1e-6 AND observed >= last * {p} / 100 THEN age END), 6) AS age_q{p}" for p in (25, 50, 75)) + " FROM l GROUP BY trait")
def onset_quartiles(spark, sf_dir):
    return _round(inc.onset_quartiles(inc.cumulative_incidence(fx.censored(spark, sf_dir), AGE)), "age_q25", "age_q50", "age_q75")


@query("joint_affection", f"WITH {fx.SQL_CENS} SELECT count(*) AS n, count(*) FILTER (affected1 AND affected2) AS \"both\", count(*) FILTER (affected1 AND NOT affected2) AS only1, count(*) FILTER (NOT affected1 AND affected2) AS only2, count(*) FILTER (NOT affected1 AND NOT affected2) AS neither, round(count(*) FILTER (affected1 AND affected2) / count(*), 4) AS co_affection FROM cens")
def joint_affection(spark, sf_dir):
    return inc.joint_affection(fx.censored(spark, sf_dir))


@query("joint_affection_by_sex", f"WITH {fx.SQL_CENS} SELECT sex, count(*) AS n, count(*) FILTER (affected1 AND affected2) AS \"both\", count(*) FILTER (affected1 AND NOT affected2) AS only1, count(*) FILTER (NOT affected1 AND affected2) AS only2, count(*) FILTER (NOT affected1 AND NOT affected2) AS neither, round(count(*) FILTER (affected1 AND affected2) / count(*), 4) AS co_affection FROM cens GROUP BY sex")
def joint_affection_by_sex(spark, sf_dir):
    return inc.joint_affection(fx.censored(spark, sf_dir), ("sex",))


@query("censor_apply", f"WITH {fx.SQL_CENS} SELECT id, death_age, " + ", ".join(f"age_censored{n}, t_observed{n}, death_censored{n}, affected{n}" for n in (1, 2)) + " FROM cens")
def censor_apply(spark, sf_dir):
    cols = [c for n in (1, 2) for c in (f"age_censored{n}", f"t_observed{n}", f"death_censored{n}", f"affected{n}")]
    return fx.censored(spark, sf_dir).select("id", "death_age", *cols)


@query("censor_confusion", _TRAITS + "SELECT trait, count(*) FILTER (t < 80 AND affected) AS tp, count(*) FILTER (t < 80 AND NOT affected) AS fn, count(*) FILTER (t >= 80 AND affected) AS fp, count(*) FILTER (t >= 80 AND NOT affected) AS tn, count(*) AS n FROM trw WHERE hi > lo GROUP BY trait")
def censor_confusion(spark, sf_dir):
    return inc.censor_confusion(fx.censored(spark, sf_dir), WIN, AGE)


@query("censor_cascade", _TRAITS + """SELECT trait, generation, count(*) AS true_cases, count(*) FILTER (t < lo) AS left_truncated, count(*) FILTER (t > hi) AS right_censored,
 count(*) FILTER (t >= lo AND t <= hi AND death_age < t) AS death_censored, count(*) FILTER (t >= lo AND t <= hi AND death_age >= t) AS observed,
 round(count(*) FILTER (t >= lo AND t <= hi AND death_age >= t) / count(*), 6) AS sensitivity FROM trw WHERE t < 80 GROUP BY trait, generation""")
def censor_cascade(spark, sf_dir):
    return _round(inc.censor_cascade(fx.censored(spark, sf_dir), WIN, AGE), "sensitivity")


@query("censor_windows", _TRAITS + """SELECT trait, generation, count(*) AS n, round(avg(CAST(affected AS DOUBLE)), 6) AS pct_affected, round(avg(CAST(t < lo AS DOUBLE)), 6) AS left_censored,
 round(avg(CAST(t > hi AS DOUBLE)), 6) AS right_censored, round(avg(CAST(death_censored AND NOT age_censored AS DOUBLE)), 6) AS death_only FROM trw GROUP BY trait, generation""")
def censor_windows(spark, sf_dir):
    return _round(inc.censor_windows(fx.censored(spark, sf_dir), WIN, AGE), "pct_affected", "left_censored", "right_censored", "death_only")


@query("person_years", f"""WITH {fx.SQL_CENS} SELECT c.generation, round(sum(greatest(least(death_age, hi) - lo, 0)), 1) AS person_years, count(*) FILTER (lo <= death_age AND death_age < hi) AS deaths,
 round(sum(greatest(least(t_observed1, death_age, hi) - lo, 0)), 1) AS trait1_years, round(sum(greatest(least(t_observed2, death_age, hi) - lo, 0)), 1) AS trait2_years
 FROM cens c JOIN windows w ON c.generation = w.generation WHERE hi > lo GROUP BY c.generation""")
def person_years(spark, sf_dir):
    return inc.person_years(fx.censored(spark, sf_dir), WIN, AGE)


@query("incidence_rate", _TRAITS + "SELECT trait, count(*) FILTER (affected) AS cases, round(sum(greatest(least(t_observed, death_age, hi) - lo, 0)), 3) AS years, round(count(*) FILTER (affected) * 1000.0 / sum(greatest(least(t_observed, death_age, hi) - lo, 0)), 6) AS rate_per_1000 FROM trw WHERE hi > lo GROUP BY trait")
def incidence_rate(spark, sf_dir):
    return _round(_round(inc.incidence_rate(fx.censored(spark, sf_dir), WIN, AGE), "rate_per_1000"), "years", places=3)


@query("onset_regression", _TRAITS + "SELECT trait, count(*) AS n, round(regr_slope(t_observed, liability), 6) AS slope, round(regr_intercept(t_observed, liability), 6) AS intercept, round(corr(liability, t_observed), 6) AS r FROM tr WHERE affected GROUP BY trait")
def onset_regression(spark, sf_dir):
    return _round(inc.onset_regression(fx.censored(spark, sf_dir)), "slope", "intercept", "r")


_m = ", ".join(f"round(avg({c}), 6) AS {c}_all, round(avg({c}) FILTER (affected), 6) AS {c}_affected, round(avg({c}) FILTER (NOT affected), 6) AS {c}_unaffected" for c in "ACE")
_ml = _m.split(", round(avg(C)")[0].replace("(A)", "(liability)").replace(" A_", " liability_")


@query("component_means_by_affection", _TRAITS + f"SELECT trait, generation, {_m}, round(avg(CAST(affected AS DOUBLE)), 6) AS prevalence FROM tr GROUP BY trait, generation")
def component_means(spark, sf_dir):
    out = inc.means_by_affection(fx.censored(spark, sf_dir), ("A", "C", "E"))
    return _round(out, *[c for c in out.columns if c not in ("trait", "generation")])


for _name, _by in (("liability_means_by_affection", ()), ("liability_means_by_generation", ("generation",)), ("liability_means_by_sex_generation", ("sex", "generation"))):
    _sql = "".join(f", {c}" for c in _by)

    def _means(spark, sf_dir, by=_by):
        out = inc.means_by_affection(fx.censored(spark, sf_dir), ("liability",), by)
        return _round(out, *[c for c in out.columns if c not in ("trait", *by)])

    query(_name, _TRAITS + f"SELECT trait{_sql}, {_ml}, round(avg(CAST(affected AS DOUBLE)), 6) AS prevalence FROM tr GROUP BY trait{_sql}")(_means)


@query("onset_histogram", _TRAITS + "SELECT trait, CAST(least(floor(t_observed * 50 / 80.0), 49) AS INTEGER) AS bin, count(*) FILTER (affected) AS affected, count(*) FILTER (death_censored) AS death_censored FROM tr WHERE affected OR death_censored GROUP BY ALL")
def onset_histogram(spark, sf_dir):
    return inc.onset_histogram(fx.censored(spark, sf_dir), AGE)
