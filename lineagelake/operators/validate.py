"""Validation of a pedigree against what it was made from: one table of checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineagelake.functions.mathx import safe_corr
from lineagelake.operators.correlations import mate_correlations, parent_offspring
from lineagelake.operators.kinship import effective_sizes
from lineagelake.operators.relatives import sibling_pairs

CHECK = "category string, name string, passed boolean, observed double, expected double, details string"


def OBS() -> Column:
    return F.col("observed")


def _row(df: DataFrame, category: str, name: str, observed: Column, expected: Column | None, passed: Column, details: str = "") -> DataFrame:
    """One aggregation, one check."""
    return df.agg(observed.cast("double").alias("observed")).select(
        F.lit(category).alias("category"), F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), "observed", (F.lit(None) if expected is None else expected).cast("double").alias("expected"), F.lit(details).alias("details")
    )




def structural(ped: DataFrame) -> DataFrame:
    """ids 0..n-1, parents known or -1, nobody their own parent, mothers female and fathers male, sex ratio near a half."""
    cat, zero = "structural", F.lit(0)
    ids = ped.select(F.col("id").alias("p"), F.col("sex").alias("psex"))
    out = [
        _row(ped, cat, "id_integrity", F.count("*") - F.count_if(F.col("id").between(0, ped.count() - 1)) + F.count("*") - F.countDistinct("id"), zero, OBS() == 0, "ids outside 0..n-1, or repeated"),
        _row(ped, cat, "no_self_parent", F.count_if((F.col("mother") == F.col("id")) | (F.col("father") == F.col("id"))), zero, OBS() == 0),
        _row(ped, cat, "sex_ratio", F.avg(F.col("sex").cast("double")), F.lit(0.5), OBS().between(0.45, 0.55)),
    ]
    for side, sex in (("mother", 0), ("father", 1)):
        known = ped.filter(F.col(side) != -1).select(F.col(side).alias("p")).join(ids, "p", "left")
        out.append(_row(known, cat, f"{side}_known", F.count_if(F.col("psex").isNull()), zero, OBS() == 0))
        out.append(_row(known, cat, f"{side}_sex", F.count_if(F.col("psex") != sex), zero, OBS() == 0))
    return _union(out)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def twins(ped: DataFrame, p_mztwin: float | None = None) -> DataFrame:
    """Twin links go both ways; co-twins share parents, sex and A; the rate is as configured."""
    cat = "twins"
    a = ped.filter("twin != -1")
    b = ped.select(F.col("id").alias("twin"), F.col("twin").alias("back"), *[F.col(c).alias(f"{c}_b") for c in ("mother", "father", "sex")], *([F.col(f"A{n}").alias(f"A{n}_b") for n in (1, 2)] if "A1" in ped.columns else []))
    both = a.join(b, "twin", "left")
    zero = F.lit(0)
    out = [
        _row(both, cat, "bidirectional", F.count_if(F.col("back").isNull() | (F.col("back") != F.col("id"))), zero, OBS() == 0),
        _row(both, cat, "same_parents", F.count_if((F.col("mother") != F.col("mother_b")) | (F.col("father") != F.col("father_b"))), zero, OBS() == 0),
        _row(both, cat, "same_sex", F.count_if(F.col("sex") != F.col("sex_b")), zero, OBS() == 0),
    ]
    if "A1" in ped.columns:
        out.append(_row(both, cat, "same_A", F.count_if((F.abs(F.col("A1") - F.col("A1_b")) > 1e-6) | (F.abs(F.col("A2") - F.col("A2_b")) > 1e-6)), zero, OBS() == 0))
    if p_mztwin is not None:
        out.append(_row(ped.filter("mother != -1"), cat, "rate", F.avg((F.col("twin") != -1).cast("double")), F.lit(p_mztwin), OBS() < max(0.01, 3 * p_mztwin)))
    return _union(out)


def half_sibs(ped: DataFrame) -> DataFrame:
    """Shares of half siblings among maternal sibling pairs and among people with siblings; informational, always passed."""
    fs, mhs, phs = sibling_pairs(ped)
    n = {name: p.count() for name, p in (("full", fs), ("maternal", mhs), ("paternal", phs))}
    either = lambda p: p.select(F.explode(F.array("id1", "id2")).alias("id")).distinct()
    some, half = either(fs.unionByName(mhs).unionByName(phs)).count(), either(mhs).count()
    details = f"full {n['full']}, maternal {n['maternal']}, paternal {n['paternal']} pairs"
    share = lambda a, b: a / b if b else None
    rows = [("half_sibs", "half_sib_pair_proportion", True, share(n["maternal"], n["full"] + n["maternal"]), None, details), ("half_sibs", "offspring_with_half_sib", True, share(half, some), None, f"{half} of {some} people with siblings")]
    return ped.sparkSession.createDataFrame(rows, CHECK)


def statistical(people: DataFrame, expected: dict[str, float]) -> DataFrame:
    """Founders' variances and correlations, C shared within a household and E not. expected: A1.. E2, rA, rC, rE."""
    founders, cat, out = people.filter("mother = -1"), "statistical", []
    for n in (1, 2):
        for c in "ACE":
            if f"{c}{n}" in expected:
                out.append(_row(founders, cat, f"variance_{c}{n}", F.var_samp(f"{c}{n}"), F.lit(expected[f"{c}{n}"]), F.abs(OBS() - expected[f"{c}{n}"]) <= 0.1))
        if all(f"{c}{n}" in expected for c in "ACE"):
            total = sum(expected[f"{c}{n}"] for c in "ACE")
            out.append(_row(founders, cat, f"variance_total{n}", F.var_samp(f"liability{n}"), F.lit(total), F.abs(OBS() - total) <= 0.15))
    for c in "ACE":
        if f"r{c}" in expected:
            r = F.coalesce(safe_corr(F.col(f"{c}1"), F.col(f"{c}2")), F.lit(0.0))
            out.append(_row(founders, cat, f"correlation_{c}", r, F.lit(expected[f"r{c}"]), F.abs(OBS() - expected[f"r{c}"]) <= 0.15))
    fs = sibling_pairs(people)[0]
    v = people.select("id", "C1", "E1")
    both = fs.join(v.withColumnsRenamed({"id": "id1", "C1": "Ca", "E1": "Ea"}), "id1").join(v.withColumnsRenamed({"id": "id2", "C1": "Cb", "E1": "Eb"}), "id2")
    out.append(_row(both, cat, "shared_C1", F.coalesce(safe_corr(F.col("Ca"), F.col("Cb")), F.lit(1.0)), F.lit(1.0), OBS() > 0.99))
    out.append(_row(both, cat, "unique_E1", F.coalesce(safe_corr(F.col("Ea"), F.col("Eb")), F.lit(0.0)), F.lit(0.0), F.abs(OBS()) < 0.1))
    return _union(out)


def _corr_se(r: Column, n: Column) -> Column:
    return F.when(n > 2, (1 - r * r) / F.sqrt(n - 2)).otherwise(F.lit(1.0))


def heritability(people: DataFrame, expected: dict[str, float] | None = None) -> DataFrame:
    """A equal in MZ twins and correlated a half in full sibs; Falconer's 2 (r_MZ - r_FS) near A's variance; regressions.

    Tolerances are max(4 SE, 0.05). expected: variances A1 and A2, for Falconer's check. Offspring on midparent, of A and
    of liability, is informational and needs over 100 offspring.
    """
    out, cat = [], "heritability"
    fs = sibling_pairs(people)[0]
    mz = people.filter("twin > id").select(F.col("id").alias("id1"), F.col("twin").alias("id2"))
    v = people.select("id", "A1", "A2", "liability1", "liability2")
    names = v.columns[1:]
    both = {}
    for kind, pairs in (("mz", mz), ("dz", fs)):
        own = pairs.join(v.withColumnsRenamed({"id": "id1", **{c: f"{c}a" for c in names}}), "id1").join(v.withColumnsRenamed({"id": "id2", **{c: f"{c}b" for c in names}}), "id2")
        both[kind] = own.agg(F.count("*").alias("n"), *[F.coalesce(safe_corr(F.col(f"{c}a"), F.col(f"{c}b")), F.lit(float("nan"))).alias(c) for c in names])
    for kind, goal in (("mz", 1.0), ("dz", 0.5)):
        room = F.greatest(4 * 0.75 / F.sqrt(F.greatest(F.col("n"), F.lit(1))), F.lit(0.05))
        for t in (1, 2):
            near = F.col(f"A{t}") > 0.99 if kind == "mz" else F.abs(F.col(f"A{t}") - goal) <= room
            out.append(both[kind].select(F.lit(cat).alias("category"), F.lit(f"{kind}_A{t}").alias("name"), (near | (F.col("n") < 10)).alias("passed"), F.nanvl(f"A{t}", F.lit(None).cast("double")).alias("observed"), F.lit(goal).alias("expected"), F.concat(F.col("n").cast("string"), F.lit(" pairs")).alias("details")))
    two = both["mz"].select(F.col("n").alias("nm"), *[F.col(f"liability{t}").alias(f"m{t}") for t in (1, 2)]).crossJoin(F.broadcast(both["dz"].select(F.col("n").alias("nd"), *[F.col(f"liability{t}").alias(f"d{t}") for t in (1, 2)])))  # one row each
    for t in (1, 2):
        goal = (expected or {}).get(f"A{t}")
        h2 = 2 * (F.col(f"m{t}") - F.col(f"d{t}"))
        se = 2 * F.sqrt(F.pow(_corr_se(F.col(f"m{t}"), F.col("nm")), F.lit(2)) + F.pow(_corr_se(F.col(f"d{t}"), F.col("nd")), F.lit(2)))
        few = (F.col("nm") < 10) | (F.col("nd") < 10) | F.isnan(f"m{t}") | F.isnan(f"d{t}")
        near = F.lit(True) if goal is None else F.abs(h2 - goal) < F.greatest(4 * se, F.lit(0.05))
        out.append(two.select(F.lit(cat).alias("category"), F.lit(f"falconer{t}").alias("name"), (few | near).alias("passed"), F.when(~few, h2).alias("observed"), F.lit(goal).cast("double").alias("expected"), F.concat(F.col("nm").cast("string"), F.lit(" MZ and "), F.col("nd").cast("string"), F.lit(" full sib pairs")).alias("details")))
    for column in ("A", "liability"):
        fit = parent_offspring(people, (), column)
        for t in (1, 2):
            row = fit.filter(F.col("trait") == t).agg(F.max("slope").alias("slope"), F.max("r2").alias("r2"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
            enough = F.col("n") > 100
            out.append(row.select(F.lit(cat).alias("category"), F.lit(f"parent_offspring_{column}{t}").alias("name"), F.lit(True).alias("passed"), F.when(enough, F.col("slope")).alias("observed"), F.lit(None).cast("double").alias("expected"), F.when(enough, F.format_string("r2 %.4f, %d offspring", F.col("r2"), F.col("n"))).otherwise(F.lit("too few offspring")).alias("details")))
    return _union(out)


def population(ped: DataFrame, n: int) -> DataFrame:
    cat = "population"
    sizes = ped.groupBy("generation").agg(F.count("*").alias("n"))
    kids = ped.filter("mother != -1").groupBy("mother").agg(F.count("*").alias("k"))
    return _union([
        _row(sizes, cat, "generation_sizes", F.count_if(F.col("n") != n), F.lit(0), OBS() == 0),
        _row(kids, cat, "offspring_per_mother", F.avg("k"), F.lit(2), F.abs(OBS() - 2) <= 1),
    ])


def assortative(people: DataFrame, r1: float = 0.0, r2: float = 0.0, cross: float | None = None) -> DataFrame:
    """Mates' correlations as configured, within max(0.1, 3 SE); across traits too, held to `cross` where it is known."""
    out = []
    m = mate_correlations(people)
    n = m.first()["n_couples"]
    room = max(0.1, 3 / max(1, n) ** 0.5)
    for name, column, goal in (("mate_r1", "m1_f1", r1), ("mate_r2", "m2_f2", r2), ("mate_r12", "m1_f2", cross), ("mate_r21", "m2_f1", cross)):
        passed = F.lit(True) if goal is None else F.coalesce(F.abs(OBS() - goal) <= room, F.lit(True))
        out.append(_row(m, "assortative", name, F.max(column), F.lit(goal), passed, f"{n} couples"))
    return _union(out)


def effective_size(estimates: DataFrame, expected: dict[str, float | None]) -> DataFrame:
    """Within 20 % of what is expected; passes where nothing is expected or an estimator has no estimate."""
    goals = estimates.sparkSession.createDataFrame([(k, None if v is None else float(v)) for k, v in expected.items()], "name string, expected double")
    both = goals.join(F.broadcast(estimates.select(F.col("estimator").alias("name"), F.col("ne").alias("observed"))), "name", "left")
    near = F.coalesce(F.abs(F.col("observed") / F.col("expected") - 1) < 0.2, F.lit(True))
    return both.select(F.lit("effective_size").alias("category"), "name", near.alias("passed"), "observed", "expected", F.lit("").alias("details"))


def variance_by_generation(people: DataFrame) -> DataFrame:
    """Means and population variances of the components and their sum, by trait and generation."""
    rows = [F.struct(F.lit(n).alias("trait"), *[F.col(f"{c}{n}").alias(c) for c in "ACE"]) for n in (1, 2)]
    long = people.select("generation", F.inline(F.array(*rows))).withColumn("total", F.col("A") + F.col("C") + F.col("E"))
    return long.groupBy("trait", "generation").agg(*[f(c).alias(f"{name}_{c}") for c in ("A", "C", "E", "total") for name, f in (("mean", F.avg), ("var", F.var_pop), ("sd", F.stddev_pop))])


def run_validation(people: DataFrame, expected: dict, n: int | None = None, p_mztwin: float | None = None, assort: tuple[float, float] = (0.0, 0.0), cross: float | None = None, sizes: dict[str, float | None] | None = None) -> DataFrame:
    """All checks as one table. sizes: expected effective sizes; without them these, the costliest, are left out."""
    parts = [structural(people), twins(people, p_mztwin), half_sibs(people), statistical(people, expected), heritability(people, expected), assortative(people, *assort, cross)]
    if sizes is not None:
        parts.append(effective_size(effective_sizes(people), sizes))
    return _union(parts + ([population(people, n)] if n else []))


def summary(checks: DataFrame) -> DataFrame:
    return checks.groupBy("category").agg(F.count("*").alias("checks"), F.count_if("passed").alias("passed"))
