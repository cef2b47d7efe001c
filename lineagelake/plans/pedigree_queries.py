"""Queries on the structure of the derived pedigree and its families."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineagelake.operators import family as fam
from lineagelake.plans.registry import query
from lineagelake.sources import fixture as fx

PED = f"WITH {fx.SQL_PED} "


def _round(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


@query("ped_generation_counts", PED + "SELECT generation, count(*) AS n FROM ped GROUP BY generation")
def generation_counts(spark, sf_dir):
    return fx.pedigree(spark, sf_dir).groupBy("generation").agg(F.count("*").alias("n"))


@query("ped_sex_ratio", PED + "SELECT generation, round(avg(CAST(sex AS DOUBLE)), 6) AS male_ratio FROM ped GROUP BY generation")
def sex_ratio(spark, sf_dir):
    return fx.pedigree(spark, sf_dir).groupBy("generation").agg(F.round(F.avg("sex"), 6).alias("male_ratio"))


@query("ped_people", PED + "SELECT id, generation, sex, mother, father, twin, household_id FROM ped")
def people(spark, sf_dir):
    return fx.pedigree(spark, sf_dir)


@query("family_size_summary", PED + """, f AS (SELECT mother, father, count(*) AS size FROM ped WHERE mother != -1 AND father != -1 GROUP BY mother, father)
SELECT count(*) AS n_families, round(avg(size), 6) AS mean, quantile_cont(size, 0.25) AS q1, quantile_cont(size, 0.5) AS median, quantile_cont(size, 0.75) AS q3,
 round(avg(CAST(size = 1 AS DOUBLE)), 6) AS size_1, round(avg(CAST(size = 2 AS DOUBLE)), 6) AS size_2, round(avg(CAST(size = 3 AS DOUBLE)), 6) AS size_3, round(avg(CAST(size >= 4 AS DOUBLE)), 6) AS size_4_plus,
 round(sum(CASE WHEN size > 1 THEN size ELSE 0 END) / sum(size), 6) AS with_full_sib FROM f""")
def family_size_summary(spark, sf_dir):
    return _round(fam.family_size_summary(fx.pedigree(spark, sf_dir)), "mean", "size_1", "size_2", "size_3", "size_4_plus", "with_full_sib")


@query("family_size_dist", PED + ", f AS (SELECT mother, father, count(*) AS size FROM ped WHERE mother != -1 AND father != -1 GROUP BY mother, father) SELECT size, count(*) AS n FROM f GROUP BY size")
def family_size_dist(spark, sf_dir):
    return fam.family_size_distribution(fx.pedigree(spark, sf_dir))


_KIDS = ", k AS (SELECT p, count(*) AS kids FROM (SELECT mother AS p FROM ped UNION ALL SELECT father FROM ped) WHERE p >= 0 GROUP BY p), o AS (SELECT sex, coalesce(kids, 0) AS kids FROM ped LEFT JOIN k ON id = p) "


@query("offspring_per_person", PED + _KIDS + "SELECT kids, count(*) AS n FROM o GROUP BY kids")
def offspring(spark, sf_dir):
    return fam.offspring_per_person(fx.pedigree(spark, sf_dir))


@query("offspring_per_person_by_sex", PED + _KIDS + "SELECT sex, kids, count(*) AS n FROM o GROUP BY sex, kids")
def offspring_by_sex(spark, sf_dir):
    return fam.offspring_per_person(fx.pedigree(spark, sf_dir), by_sex=True)


@query("mates_by_sex", PED + ", c AS (SELECT DISTINCT mother, father FROM ped WHERE mother >= 0 AND father >= 0), m AS (SELECT 0 AS sex, count(*) AS m FROM c GROUP BY mother UNION ALL SELECT 1, count(*) FROM c GROUP BY father) SELECT sex, count(*) AS n_parents, round(avg(m), 6) AS mean_mates, max(m) AS max_mates FROM m GROUP BY sex")
def mates(spark, sf_dir):
    return _round(fam.mates_by_sex(fx.pedigree(spark, sf_dir)), "mean_mates")


@query("parent_status", PED + """, ph AS (SELECT * FROM ped WHERE generation >= 3),
a AS (SELECT CAST(mother IN (SELECT id FROM ph) AS INTEGER) + CAST(father IN (SELECT id FROM ph) AS INTEGER) AS x, CAST(mother IN (SELECT id FROM ped) AS INTEGER) + CAST(father IN (SELECT id FROM ped) AS INTEGER) AS y FROM ph),
k AS (SELECT x AS n_parents FROM a UNION SELECT y FROM a)
SELECT n_parents, (SELECT count(*) FROM a WHERE x = n_parents) AS in_phenotype, (SELECT count(*) FROM a WHERE y = n_parents) AS in_pedigree FROM k""")
def parent_status(spark, sf_dir):
    ped = fx.pedigree(spark, sf_dir)
    return fam.parent_status(ped.filter("generation >= 3"), ped)


@query("family_size_by_parent_sex", PED + """, k AS (SELECT 'mother' AS parent, count(*) AS k FROM ped WHERE mother != -1 GROUP BY mother UNION ALL SELECT 'father', count(*) FROM ped WHERE father != -1 GROUP BY father)
SELECT parent, round(avg(k), 6) AS mean, quantile_cont(k, 0.5) AS median, round(stddev_samp(k), 6) AS std, count(*) AS n_parents FROM k GROUP BY parent""")
def family_size_by_parent_sex(spark, sf_dir):
    return _round(fam.family_size_by_parent_sex(fx.pedigree(spark, sf_dir)), "mean", "std")


_GP = """, g AS (SELECT k.generation, m.mother AS a, m.father AS b, f.mother AS c, f.father AS d FROM ped k JOIN ped m ON k.mother = m.id JOIN ped f ON k.father = f.id
 WHERE m.mother >= 0 AND m.father >= 0 AND f.mother >= 0 AND f.father >= 0),
h AS (SELECT *, len(list_distinct([a, b, c, d])) AS distinct_gp, CAST(a = c AS INTEGER) + CAST(b = d AS INTEGER) AS shared FROM g) """


@query("grandparent_links", PED + _GP + "SELECT generation, CAST(distinct_gp AS INTEGER) AS distinct_gp, count(*) AS n FROM h GROUP BY generation, distinct_gp")
def grandparent_links(spark, sf_dir):
    return fam.grandparent_links(fx.pedigree(spark, sf_dir))


@query("consanguinity_reconciliation", PED + _GP + "SELECT generation, CAST(sum(4 - distinct_gp) AS BIGINT) AS total_missing, CAST(sum(shared) AS BIGINT) AS explained_missing, count(*) FILTER (shared = 2) AS full_sib_matings, count(*) FILTER (shared = 1) AS half_sib_matings FROM h GROUP BY generation")
def consanguinity(spark, sf_dir):
    return fam.consanguinity(fx.pedigree(spark, sf_dir))
