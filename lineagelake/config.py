"""Scenario configuration: defaults, sections flattened to keys, and checks."""

from __future__ import annotations

from copy import deepcopy

#: Defaults by section: fixed values.
DEFAULTS = {
    "seed": 42, "replicates": 3, "folder": "base", "N": 100000, "G_ped": 6, "G_pheno": 3, "G_sim": 8, "standardize": "global", "plot_format": "png", "drop_from": None, "use_gene_drop": False,
    "pedigree": {"mating_lambda": 0.5, "p_mztwin": 0.02, "assort1": 0, "assort2": 0, "assort_matrix": None, "trait1": {"A": 0.5, "C": 0.0, "E": 0.5}, "trait2": {"A": 0.4, "C": 0.2, "E": 0.4}, "rA": 0.0, "rC": 0.0, "rE": 0.0},
    "phenotype": {
        "trait1": {"model": "frailty", "params": {"distribution": "weibull", "scale": 2160, "rho": 0.8}, "beta": 1.0, "beta_sex": 0.0},
        "trait2": {"model": "frailty", "params": {"distribution": "weibull", "scale": 333, "rho": 1.2}, "beta": 1.5, "beta_sex": 0.0},
    },
    "censoring": {"max_age": 80, "gen_censoring": {0: [80, 80], 1: [80, 80], 2: [80, 80], 3: [40, 80], 4: [0, 80], 5: [0, 45]}, "death_scale": 164, "death_rho": 2.73},
    "sampling": {"N_sample": 0, "case_ascertainment_ratio": 1, "pedigree_dropout_rate": 0},
    "analysis": {"max_degree": 2, "estimate_inbreeding": False},
    "tstrait": {"num_causal": 1000, "frac_causal": None, "maf_threshold": 0.01, "alpha": -0.5, "effect_mean": 0.0, "effect_var": 1.0, "trait_id": 0, "share_architecture": False},
}
RENAMED = {"max_age": "censor_age"}
FAMILIES = ("frailty", "cure_frailty", "adult", "first_passage")
DISTRIBUTIONS = ("weibull", "exponential", "gompertz", "lognormal", "loglogistic", "gamma")
NEEDS_PREVALENCE = ("adult", "cure_frailty")


def flatten(doc: dict) -> dict:
    """Sections to flat keys: pedigree.trait1.A -> A1, phenotype.trait2.beta -> beta2, tstrait.alpha -> tstrait_alpha."""
    out = {}
    for key, value in doc.items():
        if key not in DEFAULTS:
            raise ValueError(f"unknown configuration key {key!r}")
        if not isinstance(DEFAULTS[key], dict):
            out[key] = value
            continue
        for k, v in (value or {}).items():
            if k not in DEFAULTS[key]:
                raise ValueError(f"unknown configuration key {key}.{k}")
            if k in ("trait1", "trait2"):
                for name, x in (v or {}).items():
                    if name not in DEFAULTS[key][k]:
                        raise ValueError(f"unknown configuration key {key}.{k}.{name}")
                    prefix = "phenotype_" if name in ("model", "params") else ""
                    out[f"{prefix}{name}{k[-1]}"] = deepcopy(x)
            else:
                out[f"tstrait_{k}" if key == "tstrait" else RENAMED.get(k, k)] = deepcopy(v)
    return out


def resolve(scenario: dict | None = None, defaults: dict | None = None) -> dict:
    """Flat parameters: a scenario over the defaults, checked."""
    base = flatten(DEFAULTS if defaults is None else defaults)
    own = flatten(scenario or {})
    return validate({**base, **own})


def validate(p: dict) -> dict:
    for n in (1, 2):
        if p.get(f"E{n}") is None:
            raise ValueError(f"E{n} must be given")
        family, params = p[f"phenotype_model{n}"], p[f"phenotype_params{n}"] or {}
        if family not in FAMILIES:
            raise ValueError(f"phenotype model must be one of {FAMILIES}")
        if family in NEEDS_PREVALENCE and "prevalence" not in params:
            raise ValueError(f"{family} needs a prevalence")
        if family not in NEEDS_PREVALENCE and "prevalence" in params:
            raise ValueError(f"{family} takes no prevalence")
        if family in ("frailty", "cure_frailty") and params.get("distribution") not in DISTRIBUTIONS:
            raise ValueError(f"distribution must be one of {DISTRIBUTIONS}")
        if family == "adult" and params.get("method", "ltm") not in ("ltm", "cox"):
            raise ValueError("adult knows the methods ltm and cox")
        if family == "adult" and params.get("method", "ltm") == "ltm" and params.get("standardize_hazard") is not None:
            raise ValueError("adult ltm has no hazard: standardize_hazard doesn't apply")
    if not 0 < p["G_pheno"] <= p["G_ped"] <= p["G_sim"]:
        raise ValueError("generations must be G_pheno <= G_ped <= G_sim")
    if not 1 <= p["max_degree"] <= 5:
        raise ValueError("max_degree must be 1 to 5")
    p["G_burn"] = p["G_sim"] - p["G_ped"]
    p["gen_censoring"] = {int(g): (float(a), float(b)) for g, (a, b) in (p["gen_censoring"] or {}).items()}
    return p


def scenarios(doc: dict) -> dict[str, dict]:
    """A folder's document of scenarios -> flat parameters of each."""
    out = {}
    for name, scenario in doc.items():
        if name == "defaults":
            raise ValueError("defaults don't belong in a folder's file")
        out[name] = resolve(scenario)
    return out


def phenotype_model(p: dict, n: int):
    from lineagelake.operators.phenotypes import make_model

    family, params = p[f"phenotype_model{n}"], dict(p[f"phenotype_params{n}"] or {})
    common = {"beta": float(p[f"beta{n}"]), "beta_sex": float(p[f"beta_sex{n}"]), "standardize": p["standardize"]}
    hazard_mode = params.pop("standardize_hazard", None)
    if family == "adult":
        method = params.pop("method", "ltm")
        if hazard_mode is not None and method == "ltm":
            raise ValueError("adult ltm has no hazard: standardize_hazard doesn't apply")
        common["standardize"] = common["standardize"] if hazard_mode is None else hazard_mode
        return make_model(f"adult_{method}", prevalence=params["prevalence"], x0=params.get("cip_x0", 50.0), slope=params.get("cip_k", 0.2), **common)
    if family == "cure_frailty":  # its threshold and its hazard are standardised each in their own way
        return make_model(family, hazard=params.pop("distribution"), prevalence=params.pop("prevalence"), standardize_hazard=hazard_mode, params=params, **common)
    common["standardize"] = common["standardize"] if hazard_mode is None else hazard_mode
    if family == "first_passage":
        return make_model(family, params=params, **common)
    return make_model(family, hazard=params.pop("distribution"), params=params, **common)


def run_parameters(p: dict, rep: int = 0) -> dict:
    """What a run's sidecar file holds."""
    keys = ("seed", "N", "G_ped", "G_sim", "mating_lambda", "p_mztwin", "A1", "C1", "E1", "A2", "C2", "E2", "rA", "rC", "rE", "assort1", "assort2")
    out = {k: p[k] for k in keys} | {"rep": rep, "seed": p["seed"] + rep}
    return out | ({"assort_matrix": p["assort_matrix"]} if p.get("assort_matrix") is not None else {})
