"""Family structure statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def family_sizes(people: DataFrame) -> DataFrame:
    return people.filter("mother != -1 and father != -1").groupBy("mother", "father").agg(F.count("*").alias("size"))


def family_size_summary(people: DataFrame) -> DataFrame:
    """One row: number, mean, quartiles (linear interpolation), shares of sizes 1, 2, 3, 4+, children with a full sib."""
    q = F.percentile("size", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = family_sizes(people).agg(
        F.count("*").alias("n_families"), F.avg("size").alias("mean"), q.alias("q"), *[F.avg((F.col("size") == k).cast("double")).alias(f"size_{k}") for k in (1, 2, 3)],
        F.avg((F.col("size") >= 4).cast("double")).alias("size_4_plus"), (F.sum(F.when(F.col("size") > 1, F.col("size")).otherwise(0)) / F.sum("size")).alias("with_full_sib"),
    )
    return out.select("n_families", "mean", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "size_1", "size_2", "size_3", "size_4_plus", "with_full_sib")


def family_size_distribution(people: DataFrame) -> DataFrame:
    return family_sizes(people).groupBy("size").agg(F.count("*").alias("n"))


def offspring_per_person(people: DataFrame, by_sex: bool = False) -> DataFrame:
    """How many people have how many children, none included."""
    kids = people.select(F.explode(F.array("mother", "father")).alias("id")).filter("id >= 0").groupBy("id").agg(F.count("*").alias("kids"))
    out = people.select("id", "sex").join(kids, "id", "left").na.fill(0, ["kids"])
    return out.groupBy(*(["sex"] if by_sex else []), "kids").agg(F.count("*").alias("n"))


def mates_by_sex(people: DataFrame) -> DataFrame:
    """Mean and most distinct mates of those with children."""
    couples = people.filter("mother != -1 and father != -1").select("mother", "father").distinct()
    f = couples.groupBy("mother").agg(F.count("*").alias("m")).select(F.lit(0).alias("sex"), "m")
    m = couples.groupBy("father").agg(F.count("*").alias("m")).select(F.lit(1).alias("sex"), "m")
    return f.unionByName(m).groupBy("sex").agg(F.count("*").alias("n_parents"), F.avg("m").alias("mean_mates"), F.max("m").alias("max_mates"))


def parent_status(people: DataFrame, pedigree: DataFrame) -> DataFrame:
    """How many people have 0, 1 or 2 parents among the people, and in the whole pedigree."""

    def count(of: DataFrame, name: str) -> DataFrame:
        has = people.select("id", "mother", "father")
        for side in ("mother", "father"):
            has = has.join(of.select(F.col("id").alias(side), F.lit(1).alias(f"has_{side}")), side, "left")
        n = (F.coalesce("has_mother", F.lit(0)) + F.coalesce("has_father", F.lit(0))).alias("n_parents")
        return has.groupBy(n).agg(F.count("*").alias(name))

    return count(people, "in_phenotype").join(count(pedigree, "in_pedigree"), "n_parents", "full").na.fill(0)


def family_size_by_parent_sex(people: DataFrame) -> DataFrame:
    kids = people.filter("mother != -1").groupBy(F.col("mother").alias("p")).agg(F.count("*").alias("k")).withColumn("parent", F.lit("mother"))
    kids = kids.unionByName(people.filter("father != -1").groupBy(F.col("father").alias("p")).agg(F.count("*").alias("k")).withColumn("parent", F.lit("father")))
    return kids.groupBy("parent").agg(F.avg("k").alias("mean"), F.percentile("k", 0.5).alias("median"), F.stddev_samp("k").alias("std"), F.count("*").alias("n_parents"))


def grandparent_links(people: DataFrame) -> DataFrame:
    """Distinct grandparents of each person whose parents' parents are all known, and matings of relatives behind them."""
    p = people.select(F.col("id").alias("pid"), F.col("mother").alias("gm"), F.col("father").alias("gf"))
    kids = people.filter("mother >= 0 and father >= 0").select("id", "generation", "mother", "father")
    out = kids.join(p.select(F.col("pid").alias("mother"), F.col("gm").alias("a"), F.col("gf").alias("b")), "mother").join(p.select(F.col("pid").alias("father"), F.col("gm").alias("c"), F.col("gf").alias("d")), "father")
    out = out.filter("a >= 0 and b >= 0 and c >= 0 and d >= 0").withColumn("distinct_gp", F.size(F.array_distinct(F.array("a", "b", "c", "d"))))
    return out.groupBy("generation", "distinct_gp").agg(F.count("*").alias("n"))


def consanguinity(people: DataFrame) -> DataFrame:
    """Missing grandparents by generation, and how many of them matings of siblings explain."""
    p = people.select(F.col("id").alias("pid"), F.col("mother").alias("gm"), F.col("father").alias("gf"))
    kids = people.filter("mother >= 0 and father >= 0").select("id", "generation", "mother", "father")
    out = kids.join(p.select(F.col("pid").alias("mother"), F.col("gm").alias("a"), F.col("gf").alias("b")), "mother").join(p.select(F.col("pid").alias("father"), F.col("gm").alias("c"), F.col("gf").alias("d")), "father")
    out = out.filter("a >= 0 and b >= 0 and c >= 0 and d >= 0")
    shared = (F.col("a") == F.col("c")).cast("int") + (F.col("b") == F.col("d")).cast("int")
    missing = F.lit(4) - F.size(F.array_distinct(F.array("a", "b", "c", "d")))
    return out.groupBy("generation").agg(F.sum(missing).alias("total_missing"), F.sum(shared).alias("explained_missing"), F.count_if(shared == 2).alias("full_sib_matings"), F.count_if(shared == 1).alias("half_sib_matings"))
