"""Correlations and regressions over relatives and parents, and the estimators made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineagelake.functions.mathx import liability_scale, p_value, safe_corr
from lineagelake.functions.tetrachoric import tetrachoric

MIN_PAIRS = 10


def _values(people: DataFrame, *columns: str) -> DataFrame:
    rows = [F.struct(F.lit(n).alias("trait"), *[F.col(f"{c}{n}").alias(c) for c in columns]) for n in (1, 2)]
    return people.select("id", "sex", "generation", F.array(*rows).alias("v"))


def pair_values(people: DataFrame, pairs: DataFrame, *columns: str) -> DataFrame:
    """Pairs with both members' values, one row for each trait: columns c_1 and c_2, sex_1, sex_2, generation_1.

    Pairs that carry their members (p1, p2 of close_pairs, with the columns of both traits, and sex or generation) aren't joined.
    """
    if "p1" in pairs.columns:
        ends = [(p, c) for p in ("p1", "p2") for c in columns]
        traits = [F.struct(F.lit(n).alias("trait"), *[F.col(f"{p}.{c}{n}").alias(f"{c}_{p[1]}") for p, c in ends]) for n in (1, 2)]
        have = pairs.schema["p1"].dataType.names
        own = [F.col(f"p{k}.{c}").alias(f"{c}_{k}") for c, k in (("sex", 1), ("sex", 2), ("generation", 1)) if c in have]
        return pairs.select("rel", "id1", "id2", *own, F.inline(F.array(*traits)))
    v = _values(people, *columns)
    a = v.select(F.col("id").alias("id1"), F.col("sex").alias("sex_1"), F.col("generation").alias("generation_1"), F.col("v").alias("v1"))
    b = v.select(F.col("id").alias("id2"), F.col("sex").alias("sex_2"), F.col("v").alias("v2"))
    out = pairs.join(a, "id1").join(b, "id2")
    keys = ["rel", "id1", "id2", "sex_1", "sex_2", "generation_1"]
    out = out.select(*keys, F.explode(F.arrays_zip("v1", "v2")).alias("z"))
    return out.select(*keys, "z.v1.trait", *[F.col(f"z.v1.{c}").alias(f"{c}_1") for c in columns], *[F.col(f"z.v2.{c}").alias(f"{c}_2") for c in columns])


def _pair_correlations(people: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """(rel, trait, n_pairs, r), r null without variance; pairs that carry their members make one row for both traits."""
    x = lambda p, n: F.col(f"{p}.{column}{n}").cast("double")
    if "p1" in pairs.columns:
        both = pairs.groupBy("rel").agg(F.count("*").alias("n_pairs"), *[safe_corr(x("p1", n), x("p2", n)).alias(f"r{n}") for n in (1, 2)])
        return both.select("rel", F.inline(F.array(*[F.struct(F.lit(n).alias("trait"), "n_pairs", F.col(f"r{n}").alias("r")) for n in (1, 2)])))
    r = safe_corr(F.col(f"{column}_1").cast("double"), F.col(f"{column}_2").cast("double"))
    return pair_values(people, pairs, column).groupBy("rel", "trait").agg(F.count("*").alias("n_pairs"), r.alias("r"))


def liability_correlations(people: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pearson's r; 0 without variance, null with fewer than MIN_PAIRS pairs."""
    return _pair_correlations(people, pairs, "liability").withColumn("r", F.when(F.col("n_pairs") >= MIN_PAIRS, F.coalesce("r", F.lit(0.0))))


def phi(people: DataFrame, pairs: DataFrame) -> DataFrame:
    """Correlation of affection; null without variance or with fewer than MIN_PAIRS pairs."""
    return _pair_correlations(people, pairs, "affected").select("rel", "trait", "n_pairs", F.when(F.col("n_pairs") >= MIN_PAIRS, F.col("r")).alias("phi"))


def two_by_two(values: DataFrame, by: list[str], a: str = "affected_1", b: str = "affected_2") -> DataFrame:
    x, y = F.col(a), F.col(b)
    return values.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.count_if(x & y).alias("n11"), F.count_if(x & ~y).alias("n10"), F.count_if(~x & y).alias("n01"), F.count_if(~x & ~y).alias("n00"))


def with_tetrachoric(counts: DataFrame, at_least: int = MIN_PAIRS) -> DataFrame:
    """r and se of each row of counts; null below the least number of pairs or with an empty margin."""
    out = counts.withColumn("_t", tetrachoric(F.col("n11"), F.col("n10"), F.col("n01"), F.col("n00")))
    ok = (F.col("n_pairs") >= at_least) & ~F.isnan("_t.r")
    return out.select(*counts.columns, F.when(ok, F.col("_t.r")).alias("r"), F.when(ok, F.col("_t.se")).alias("se"))


def pairs_by_sex(people: DataFrame, pairs: DataFrame) -> DataFrame:
    return two_by_two(pair_values(people, pairs, "affected").filter("sex_1 = sex_2").withColumnRenamed("sex_1", "sex"), ["rel", "trait", "sex"])


def pairs_by_generation(people: DataFrame, pairs: DataFrame, last: int = 3) -> DataFrame:
    top = people.agg(F.max("generation")).first()[0] or 0
    kept = pair_values(people, pairs, "affected").filter(F.col("generation_1") >= max(1, top - last + 1)).withColumnRenamed("generation_1", "generation")
    return two_by_two(kept, ["rel", "trait", "generation"])


def tetrachoric_by_generation(people: DataFrame, pairs: DataFrame, last: int = 3) -> DataFrame:
    """Tetrachoric r and se of the last generations with, beside them, the same pairs' liability correlation."""
    fitted = with_tetrachoric(pairs_by_generation(people, pairs, last))
    top = people.agg(F.max("generation")).first()[0] or 0
    values = pair_values(people, pairs, "liability").filter(F.col("generation_1") >= max(1, top - last + 1)).withColumnRenamed("generation_1", "generation")
    r = values.groupBy("rel", "trait", "generation").agg(F.when(F.count("*") >= MIN_PAIRS, F.coalesce(safe_corr(F.col("liability_1"), F.col("liability_2")), F.lit(0.0))).alias("liability_r"))
    return fitted.join(r, ["rel", "trait", "generation"], "left")


#: People of a generation from which the traits of one person are correlated: fixed value.
MIN_PEOPLE = 50


def same_person_counts(people: DataFrame, last: int = 3) -> DataFrame:
    """2x2 of the two traits of one person, in each of the last generations after the founders'."""
    top = people.agg(F.max("generation")).first()[0] or 0
    return two_by_two(people.filter(F.col("generation") >= max(1, top - last + 1)), ["generation"], "affected1", "affected2")


def same_person_by_generation(people: DataFrame, last: int = 3) -> DataFrame:
    return with_tetrachoric(same_person_counts(people, last), MIN_PEOPLE)


def falconer_by_generation(people: DataFrame, pairs: DataFrame) -> DataFrame:
    """MZ and FS liability correlations within each cohort, 2 (r_MZ - r_FS), and the cohort's realised h2."""
    both = pair_values(people, pairs.filter("rel in ('MZ', 'FS')"), "liability").join(people.select(F.col("id").alias("id2"), F.col("generation").alias("generation_2")), "id2").filter("generation_1 = generation_2")
    r = both.groupBy("trait", F.col("generation_1").alias("generation"), "rel").agg(F.count("*").alias("n"), F.coalesce(safe_corr(F.col("liability_1"), F.col("liability_2")), F.lit(0.0)).alias("r"))
    pick = lambda rel, c: F.max(F.when((F.col("rel") == rel) & (F.col("n") >= MIN_PAIRS), F.col(c)))
    wide = r.groupBy("trait", "generation").agg(pick("MZ", "r").alias("r_mz"), pick("FS", "r").alias("r_fs"), *[F.coalesce(F.max(F.when(F.col("rel") == x, F.col("n"))), F.lit(0)).alias(f"n_{x.lower()}") for x in ("MZ", "FS")])
    return realized_h2(people).join(wide, ["trait", "generation"], "left").withColumn("falconer", 2 * (F.col("r_mz") - F.col("r_fs")))


def naive_h2(people: DataFrame, pairs: DataFrame) -> DataFrame:
    """Estimators from liability correlations that assume random mating, beside the realised h2, by trait."""
    seen = liability_correlations(people, pairs)
    slope = regression(_both_with_parents(people, "liability"), ["trait"]).select("trait", F.col("slope").alias("po"))
    rows = [F.struct(F.lit(n).alias("trait"), *[F.col(f"{c}{n}").alias(c) for c in "ACE"]) for n in (1, 2)]
    v = people.select(F.inline(F.array(*rows))).groupBy("trait").agg(*[F.var_samp(c).alias(f"v{c}") for c in "ACE"])
    real = v.select("trait", (F.col("vA") / (F.col("vA") + F.col("vC") + F.col("vE"))).alias("realized"))
    return real.join(observed_h2(seen, "r"), "trait", "left").join(slope, "trait", "left").select("trait", "falconer", "sibs", "po", "half_sibs", "cousins", "realized")


def observed_and_liability_h2(people: DataFrame, pairs: DataFrame) -> DataFrame:
    """By trait: prevalence, Falconer's h2 on the observed scale, and what it is on the liability scale (k (1 - k) / z^2)."""
    found = observed_h2(phi(people, pairs)).select("trait", F.col("falconer").alias("observed"))
    rows = [F.struct(F.lit(n).alias("trait"), F.col(f"affected{n}").alias("a")) for n in (1, 2)]
    k = people.select(F.inline(F.array(*rows))).groupBy("trait").agg(F.avg(F.col("a").cast("double")).alias("prevalence"))
    factor = liability_scale(F.col("prevalence"))
    return k.join(found, "trait", "left").select("trait", "prevalence", "observed", (F.col("observed") * factor).alias("liability"))


def first_sib_pairs(people: DataFrame, min_generation: int | None = None) -> DataFrame:
    """(mother, father, trait, a, b): liabilities of the first two full sibs of each family by id, without twins."""
    kids = people.filter("mother >= 0 and twin = -1")
    kids = kids if min_generation is None else kids.filter(F.col("generation") >= min_generation)
    w = Window.partitionBy("mother", "father").orderBy("id")
    two = kids.select("mother", "father", "liability1", "liability2", F.row_number().over(w).alias("nth")).filter("nth <= 2")
    cells = [F.max(F.when(F.col("nth") == k, F.col(f"liability{t}"))).alias(f"{c}{t}") for t in (1, 2) for k, c in ((1, "a"), (2, "b"))]
    wide = two.groupBy("mother", "father").agg(F.count("*").alias("n"), *cells).filter("n = 2")
    return wide.select("mother", "father", F.inline(F.array(*[F.struct(F.lit(t).alias("trait"), F.col(f"a{t}").alias("a"), F.col(f"b{t}").alias("b")) for t in (1, 2)])))


def cross_trait_counts(people: DataFrame, pairs: DataFrame) -> DataFrame:
    """Trait 1 of the first member against trait 2 of the second, by code; 'self' is the same person."""
    if "p1" in pairs.columns:
        cross = pairs.select("rel", F.col("p1.affected1").alias("affected_1"), F.col("p2.affected2").alias("affected_2"))
    else:
        a, b = people.select(F.col("id").alias("id1"), F.col("affected1").alias("affected_1")), people.select(F.col("id").alias("id2"), F.col("affected2").alias("affected_2"))
        cross = pairs.join(a, "id1").join(b, "id2").select("rel", "affected_1", "affected_2")
    own = people.select(F.lit("self").alias("rel"), F.col("affected1").alias("affected_1"), F.col("affected2").alias("affected_2"))
    return two_by_two(cross.unionByName(own), ["rel"])


def _with_parents(people: DataFrame, column: str) -> DataFrame:
    p = people.select(F.col("id").alias("p"), F.col(column).cast("double").alias("v"))
    kids = people.filter("mother >= 0 and father >= 0").select("id", "sex", "generation", F.col(column).cast("double").alias("y"), "mother", "father")
    return kids.join(p.select(F.col("p").alias("mother"), F.col("v").alias("m")), "mother").join(p.select(F.col("p").alias("father"), F.col("v").alias("f")), "father").withColumn("x", (F.col("m") + F.col("f")) / 2)


def regression(rows: DataFrame, by: list[str], x: str = "x", y: str = "y", least: int = MIN_PAIRS) -> DataFrame:
    """Least squares of y on x with r, r2, slope, intercept, standard error and p; null below `least` rows or without variance."""
    xc, yc = F.col(x), F.col(y)
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), safe_corr(xc, yc).alias("r"), F.covar_pop(x, y).alias("_c"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"), F.avg(x).alias("_mx"), F.avg(y).alias("_my")
    )
    ok = (F.col("n") >= least) & (F.col("_vx") > 1e-12)
    slope = F.try_divide(F.col("_c"), F.col("_vx"))
    out = out.withColumn("slope", F.when(ok, slope)).withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx")).withColumn("r", F.when(ok, F.coalesce("r", F.lit(0.0))))
    se = F.sqrt(F.try_divide((1 - F.col("r") * F.col("r")) * F.col("_vy"), (F.col("n") - 2) * F.col("_vx")))
    return out.select(*by, "n", "r", (F.col("r") * F.col("r")).alias("r2"), "slope", "intercept", se.alias("stderr"), p_value(F.col("r"), F.col("n")).alias("p"))


def parent_offspring(people: DataFrame, by: tuple[str, ...] = ("generation",), column: str = "liability") -> DataFrame:
    """Offspring on midparent, for both traits."""
    return regression(_both_with_parents(people, column), ["trait", *by])


def _both_with_parents(people: DataFrame, column: str) -> DataFrame:
    both = [_with_parents(people, f"{column}{n}").withColumn("trait", F.lit(n)) for n in (1, 2)]
    return both[0].unionByName(both[1])


def mate_correlations(people: DataFrame) -> DataFrame:
    """2x2 of mothers' and fathers' liabilities over distinct couples of non-founders."""
    couples = people.filter("mother >= 0 and father >= 0").select("mother", "father").distinct()
    m = people.select(F.col("id").alias("mother"), F.col("liability1").alias("m1"), F.col("liability2").alias("m2"))
    f = people.select(F.col("id").alias("father"), F.col("liability1").alias("f1"), F.col("liability2").alias("f2"))
    out = couples.join(m, "mother").join(f, "father")
    return out.agg(F.count("*").alias("n_couples"), *[safe_corr(F.col(f"m{i}"), F.col(f"f{j}")).alias(f"m{i}_f{j}") for i in (1, 2) for j in (1, 2)])


def observed_h2(correlations: DataFrame, value: str = "phi") -> DataFrame:
    """Falconer, siblings, half siblings and cousins from a (rel, trait, value) table."""
    r = {c: F.max(F.when(F.col("rel") == c, F.col(value))) for c in ("MZ", "FS", "MHS", "PHS", "1C")}
    halves = (F.coalesce(r["MHS"], r["PHS"]) + F.coalesce(r["PHS"], r["MHS"])) / 2
    return correlations.groupBy("trait").agg((2 * (r["MZ"] - r["FS"])).alias("falconer"), (2 * r["FS"]).alias("sibs"), (4 * halves).alias("half_sibs"), (8 * r["1C"]).alias("cousins"))


def pooled(correlations: DataFrame, value: str = "r") -> DataFrame:
    """MO with FO as PO, MHS with PHS as HS: equal weights, missing ones skipped."""
    kind = F.when(F.col("rel").isin("MO", "FO"), "PO").when(F.col("rel").isin("MHS", "PHS"), "HS").otherwise(F.col("rel"))
    return correlations.groupBy("trait", kind.alias("kind")).agg(F.avg(value).alias("r"))


def realized_h2(people: DataFrame) -> DataFrame:
    """Variance shares of the components by generation."""
    rows = [F.struct(F.lit(n).alias("trait"), *[F.col(f"{c}{n}").alias(c) for c in "ACE"]) for n in (1, 2)]
    out = people.select("generation", F.inline(F.array(*rows))).groupBy("trait", "generation").agg(*[F.var_samp(c).alias(f"v{c}") for c in "ACE"])
    total = F.col("vA") + F.col("vC") + F.col("vE")
    return out.select("trait", "generation", "vA", "vC", "vE", (F.col("vA") / total).alias("h2"), ((F.col("vA") + F.col("vC")) / total).alias("broad_h2"))
