"""Registered queries against their DuckDB twins (a cross-section; ALL_QUERIES=1 runs every one)."""

import os

import oracle
import pytest

SF = "sf0.001"
SOME = ("entry_sensor_skill b3_simple a7_quarantine c1_tukey c4_trim_pct c5_c6_c7_thresholds c9_ice_outliers_by_pass c12_savgol c12_savgol_sets c13_running_median "
        "c20_drop_in_gaps d1_nearest d5_interpolate_proximity d10_daily_pair e2_gaps_without_ice e6_resolution_by_threshold f2_nse_variance "
        "f9_threshold_for_std f18_spearman g2_fit_curve g10_storage_discrete h2_window_ranges j5_pooled_km3 k2_k4_signed_ranks l3_weighted_stats "
        "m8_otsu n2_ecdf_area a8_processing_report a8_summary_totals b12_filter_counts d12_exclude_by_file_name f19_error_ratio g1_p_value h2_all_windows "
        "g14_variable_area k2_wilcoxon k3_filter_and_time_effect m9_water_levels m10_m12_water_series").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(f"{oracle.DATA}/{SF}"), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", list(oracle.entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SOME)
def test_matches_oracle(spark, con, name):
    ok, text = oracle.compare(spark, con, name, SF)
    assert ok, text


def test_common_keys_over_all_dates(spark, con):
    ok, text = oracle.compare(spark, con, "d14_common_keys_all_dates", SF)
    assert ok, text
    assert len(oracle.entry.queries()["d14_common_keys_all_dates"](spark, f"{oracle.DATA}/{SF}").collect()) == 5


def test_contract():
    q, o = oracle.entry.queries(), oracle.entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 140
