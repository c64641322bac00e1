from __future__ import annotations

import math

import pytest

from panelloom.plans import registry
from panelloom.plans.book import Book

duckdb = pytest.importorskip("duckdb")

#: One query of each kind; the driver compares all of them.
SOME = [
    "xs_pct_rank", "recursive_minmax", "ffill_limit1", "ratio_panel", "target_ma4", "estimation_windows", "block_ar1", "se_rho_block", "oos_r2_by_block", "dm_hac_stat_bw2", "rank_stability",
    "lowo_selection", "gap_fe_clustered", "interval_join_future", "pit_asof_query", "pit_asof_panel", "coverage_matrix", "gap_islands", "stratified_quotas", "io_coefficients", "weekly_weighted_tone",
    "signal_mom_plus_disagr", "signal_disagr_combined", "quintile_sort", "turnover", "sector_rotation", "max_drawdown",
    "bootstrap_interval", "block_bootstrap_interval", "sign_flip_p", "holm_p", "ljung_box", "variance_ratio", "bootstrap_sharpe", "split_performance", "csv_round_trip", "json_round_trip",
    "target_normal_quantiles", "probabilistic_sharpe", "volatility_scaled_grid", "top_n_sub_samples", "held_out_selection", "held_out_gain", "leak_test", "win_condition",
    "perturbed_rank_stability", "labelled_flows", "listed_actors", "expanded_registry", "sector_numbers", "not_cached",
    "company_facts_parsed", "first_tag_of_facts", "statements_parsed", "observations_parsed", "io_table_parsed", "nested_years_parsed", "sdmx_parsed", "day_first_parsed", "news_lines_parsed",
    "long_prices_parsed", "nearest_slots", "weekly_tone_windows", "mapped_intensities",
    "paired_t_stat", "dm_stat", "store_as_of", "store_legacy", "store_vintages", "store_selections", "registry_intensities", "registry_intensities_by_quarter", "uncovered_actors",
    "block_placebo_draws", "stratified_block_placebo", "split_half_of_blocks",
    "robustness_set", "candidate_blocks", "merged_block_gain", "late_filings_rerun", "causal_scaling_rerun", "noise_rerun", "zip_members_read", "workbook_flows", "html_constituents", "html_table_cells",
    "streamed_tone_weeks", "streamed_filter",
    "resumed_ingestion", "union_of_calendars", "sdmx_csv_parsed", "sdmx_compact_parsed", "firm_spending_intensities", "series_intensities", "registry_round_trip", "experiment_readiness",
    "signal_disagr_combined_small_gap", "timing_variants", "timing_correlations", "rank_ic", "strategy_table",
]


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def seen(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    return [columns[i] for i in order], sorted((str([plain(r[i]) for i in order]) for r in rows))


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, sf, db, name):
    got = registry.QUERIES[name](spark, sf)
    want = db.sql(registry.ORACLE_SQL[name])
    assert seen(got.columns, [tuple(r) for r in got.collect()]) == seen(want.columns, want.fetchall())


def test_every_query_has_a_stable_schema(spark, sf):
    for name in ("panel_quarter_mean", "capped_selection", "eight_architectures"):
        assert registry.QUERIES[name](spark, sf).columns


def test_flagship(spark, sf):
    assert registry.flagship(spark, sf).count() > 0


def test_names_are_used_once():
    b = Book()
    b.add("x", lambda s, d: None)
    with pytest.raises(ValueError):
        b.add("x", lambda s, d: None)


def test_window_forecasts_are_repeatable(spark, sf):
    a, b = (sorted(map(tuple, registry.QUERIES["placebo_test"](spark, sf).collect())) for _ in range(2))
    assert a == b
