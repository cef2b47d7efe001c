"""Registered queries against their SQL in DuckDB at the smallest scale."""

import collections
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
#: One of each family; the driver compares all of them.
NAMES = [
    "prevalence_grouping_sets", "mortality_lifetable", "survival_curve", "cif_by_sex", "onset_quartiles", "censor_apply", "censor_confusion", "censor_cascade", "censor_windows", "person_years", "incidence_rate", "joint_affection",
    "family_size_summary", "offspring_per_person", "mates_by_sex", "parent_status", "grandparent_links", "pairs_cousin", "pair_counts", "pair_counts_subsample", "relatives_features", "liability_corr_by_pair", "phi_by_pair",
    "twobytwo_by_pair_sex", "po_regression_by_generation", "mate_correlation_matrix", "pheno_threshold_per_generation", "frailty_weibull", "adult_cox", "sample_weighted", "dropout_relink", "gv_rescale", "inbreeding_by_generation",
    "ped_structural_checks", "rep_envelope", "events_daily", "rank_scores", "hazard_terms_gompertz", "normal_functions", "dempster_lerner_table", "adult_ltm", "first_passage", "frailty_lognormal", "hazard_terms_gamma", "quantile_normal_scores", "gene_drop_founders",
    "sample_allele_counts", "hill_overlapping", "long_term_contributions", "pair_counts_degree5", "tetrachoric_by_generation", "tetrachoric_same_person_by_generation", "first_sib_pairs", "falconer_by_generation", "naive_h2_estimators", "ped_twin_checks",
    "effective_sizes", "pair_kinship_listed", "mean_coancestry", "liability_corr_by_family", "twobytwo_by_family", "pair_counts_by_family", "allele_counts_by_sweep", "gv_over_edges", "verify_golden", "gv_from_store", "site_store_range", "frailty_gamma", "gv_with_noise", "observed_vs_liability_h2",
]


def plain(row):
    return tuple(None if v is None or v != v else round(float(v), 5) if isinstance(v, float) else int(v) if hasattr(v, "__index__") else str(v) for v in row)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert collections.Counter(map(plain, df.select(*cols).collect())) == collections.Counter(map(plain, want))


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries()["prevalence_grouping_sets"]
