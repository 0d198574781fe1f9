"""Queries against their DuckDB counterparts on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = """cln_coercion cln_profile cln_macro_fill cln_start_filter cln_macro_predictors cln_log_inputs jn_lagged_macro jn_cohort_self_join xs_normalise xs_decile xs_size_groups hz_forward_excess hz_diagnosis
wf_embargo wf_newey_west wf_window_ols wf_windows pf_measures pf_evaluate_groups pf_cohorts pf_rank_ic pf_best_group pf_p_values en_inverse_mse en_least_squares en_error_correlation
tc_turnover tc_buffer tc_net_returns tc_portfolios tc_portfolio_measures xs_impute cln_extremes pf_describe_groups pf_constructions pf_annual pf_best_group_sharpe pf_model_blocks en_components fa_benchmark fa_one_factor fa_alphas fa_absorbed_alpha jr_experiment_key jr_model_tables snk_append_new snk_append snk_append_writers cln_source_profiles cln_source_null_rates cln_source_overlap
ml_elastic_net_one ml_elastic_net_windows ml_elastic_net_coefficients ml_linear_one ml_model_sink""".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return c


def lines(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    relation = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    order = [relation.columns.index(c) for c in columns]
    assert lines(tuple(r[c] for c in columns) for r in df.collect()) == lines(tuple(r[i] for i in order) for r in relation.fetchall())


@pytest.mark.parametrize("name", "jn_models_wide jn_cohort_self_join xs_normalise xs_size_groups pf_rank_ic pf_evaluate_groups pf_describe_groups pf_group_bounds pf_annual tc_portfolios en_compare_methods cln_source_profiles".split())
def test_same_rows_in_small_tasks(spark, duck, sf, name, monkeypatch):
    from panelspark.sources import scratch

    monkeypatch.setattr(scratch, "TASK_BYTES", 1 << 13)
    test_same_rows(spark, duck, sf, name)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 2
