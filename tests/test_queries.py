"""Queries against their SQL: a cross-section by default, all of them with ALL_QUERIES=1."""

import os

import pytest

from tablecare.queries import catalog
from tests.compare import compare, connect

SECTION = """agg_profile agg_missing agg_duplicates agg_iqr_outliers agg_leakage agg_order_corr qly_preprocess_report qly_assessment
qly_recommend prj_convert_dtype prj_event_search prj_flatten_json pln_replay cln_negative_prices cln_fill_by_group cln_ffill_bfill
cln_rare_other pln_auto_clean pln_preprocess fea_datetime fea_lag_rolling fea_ewm fea_row_stats fea_text_stats fst_time_travel fst_asof
drf_ks drf_chi2 drf_psi drf_page_hinkley met_classification met_auc_logloss met_mann_whitney met_mcnemar jon_knn win_leaderboard
win_keep_last_n win_rate_flag gov_verify_chain gov_erase txt_chunk txt_hybrid_search str_ingest str_tumbling str_zscore_state ens_voting""".split()
NAMES = sorted(catalog.ORACLES) if os.environ.get("ALL_QUERIES") else SECTION


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, sf, name):
    state, _, note = compare(spark, con, sf, catalog.QUERIES[name], catalog.ORACLES[name])
    assert state == "ok", note


LARGE = "agg_order_corr cln_ffill_bfill fea_lag_rolling fea_ewm str_ema drf_ks drf_page_hinkley met_auc_logloss win_keep_last_n fst_asof str_multi_window".split()


@pytest.mark.parametrize("name", LARGE)
def test_large_way_matches_sql(large, con, sf, name):
    state, _, note = compare(large, con, sf, catalog.QUERIES[name], catalog.ORACLES[name])
    assert state == "ok", note


def test_every_query_is_named_once_and_has_rows_or_sql():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) >= 226
