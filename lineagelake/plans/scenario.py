"""A whole scenario: simulate, drop out, phenotype, censor, sample, and all statistics."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession

from lineagelake.config import phenotype_model, resolve
from lineagelake.operators import correlations as cor
from lineagelake.operators import family as fam
from lineagelake.operators import incidence as inc
from lineagelake.operators.censor import run_censor
from lineagelake.operators.checkpoints import cut
from lineagelake.operators.phenotypes import run_phenotype
from lineagelake.operators.relatives import count_pairs, extract_pairs
from lineagelake.operators.sampling import run_dropout, run_sample
from lineagelake.operators.simulate import Parameters, run_simulation
from lineagelake.operators.stores import StageStore


def pedigree_parameters(p: dict, seed: int) -> Parameters:
    """What alone decides about a scenario's pedigree; scenarios that agree on it share one."""
    return Parameters(
        n=p["N"], generations=p["G_ped"], burn_in=p["G_burn"], seed=seed, A=(p["A1"], p["A2"]), C=(p["C1"], p["C2"]), E=(p["E1"], p["E2"]), rA=p["rA"], rC=p["rC"], rE=p["rE"],
        mating_lambda=p["mating_lambda"], p_mztwin=p["p_mztwin"], assort=(p["assort1"], p["assort2"]), assort_matrix=p["assort_matrix"],
    )


def run_scenario(spark: SparkSession, scenario: dict | None = None, rep: int = 0, store: StageStore | None = None, scenarios: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    """pedigree, phenotype, censored and sample of one replicate.

    With a store, a pedigree that a run with the same parameters has made is read. drop_from names the scenario (of
    scenarios) whose pedigree this one takes; the other parameters stay its own.
    """
    p = resolve(scenario)
    seed = p["seed"] + rep
    source = p
    if p["drop_from"]:
        if p["drop_from"] not in (scenarios or {}):
            raise ValueError(f"drop_from names {p['drop_from']!r}, which isn't among the scenarios")
        source = resolve(scenarios[p["drop_from"]])
    sim = pedigree_parameters(source, source["seed"] + rep)
    full = run_simulation(spark, sim) if store is None else store.stage("pedigree", lambda: run_simulation(spark, sim), parameters=dataclasses.asdict(sim))
    ped = run_dropout(full, p["pedigree_dropout_rate"], seed)
    pheno = run_phenotype(ped, phenotype_model(p, 1), phenotype_model(p, 2), g_pheno=p["G_pheno"], seed=seed)
    cens = run_censor(pheno, p["gen_censoring"], p["censor_age"], p["death_scale"], p["death_rho"], seed)
    return {"full": full, "pedigree": ped, "phenotype": pheno, "censored": cens, "sample": run_sample(cens, p["N_sample"], p["case_ascertainment_ratio"], seed)}


def statistics(people: DataFrame, pedigree: DataFrame, windows: dict | None, censor_age: float, max_degree: int = 2) -> dict[str, DataFrame]:
    """Every statistic as a table of its own; the three on censoring only where there are windows."""
    pairs = cut(extract_pairs(pedigree, max_degree, sample=people))  # some fifteen tables are made from them
    phis = cor.phi(people, pairs)
    counts = cor.two_by_two(cor.pair_values(people, pairs, "affected"), ["rel", "trait"])
    curve = inc.cumulative_incidence(people, censor_age)
    out = {
        "prevalence": inc.prevalence_grouping_sets(people), "mortality": inc.mortality(people, censor_age), "cumulative_incidence": curve, "half_target_age": inc.half_target_age(curve),
        "cumulative_incidence_by_sex": inc.cumulative_incidence(people, censor_age, by=("sex",)), "cumulative_incidence_by_sex_generation": inc.cumulative_incidence(people, censor_age, by=("sex", "generation")),
        "joint_affection": inc.joint_affection(people), "joint_affection_by_sex": inc.joint_affection(people, ("sex",)), "onset_regression": inc.onset_regression(people),
        "person_years": inc.person_years(people, windows or {}, censor_age), "family_size": fam.family_size_summary(people), "offspring": fam.offspring_per_person(people, True), "mates": fam.mates_by_sex(people),
        "parent_status": fam.parent_status(people, pedigree), "pair_counts": count_pairs(pairs), "pair_counts_pedigree": count_pairs(extract_pairs(pedigree, max_degree)),
        "liability_correlations": cor.liability_correlations(people, pairs), "phi": phis, "tetrachoric": cor.with_tetrachoric(counts), "tetrachoric_by_sex": cor.with_tetrachoric(cor.pairs_by_sex(people, pairs)),
        "tetrachoric_by_generation": cor.tetrachoric_by_generation(people, pairs), "cross_trait_by_generation": cor.same_person_by_generation(people), "cross_trait": cor.with_tetrachoric(cor.cross_trait_counts(people, pairs)),
        "parent_offspring": cor.parent_offspring(people), "parent_offspring_by_sex": cor.parent_offspring(people, ("sex",)), "parent_offspring_affected": cor.parent_offspring(people, (), "affected"),
        "observed_h2": cor.observed_h2(phis), "mate_correlations": cor.mate_correlations(people),
    }
    if windows:
        out |= {"censoring_windows": inc.censor_windows(people, windows, censor_age), "censoring_confusion": inc.censor_confusion(people, windows, censor_age), "censoring_cascade": inc.censor_cascade(people, windows, censor_age)}
    return out
