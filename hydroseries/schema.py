"""Table layouts.  Every layout is a plain StructType built from name groups."""

from __future__ import annotations

from pyspark.sql import types as T

# The column names of the daily lake table and of its side tables.
_DAILY_GROUPS: list[tuple[T.DataType, str]] = [
    (T.StringType(), "swot_lake_id gage_id data_source"),
    (T.DateType(), "date"),
    (T.DoubleType(), "stage stage_anomaly_swotdates stage_anomaly_alldates storage wsa"
                     " storage_anomaly_opt storage_anomaly_filt"),
    (T.DoubleType(), "swot_wse swot_wse_anomaly swot_wse_error swot_wse_abs_error swot_wse_error_alldates"
                     " swot_wsa swot_wsa_resid swot_wse_std swot_wse_u swot_wse_r_u"
                     " swot_area_total swot_area_detct swot_area_det_u swot_dark_frac swot_layovr_val"),
    (T.IntegerType(), "swot_quality_f swot_xovr_cal_q swot_partial_f swot_ice_clim_f swot_ice_dyn_f"
                      " swot_cycle_id swot_pass_id"),
    (T.StringType(), "swot_crid swot_continent_id"),
    (T.TimestampType(), "swot_time_str"),
    (T.DoubleType(), "swot_time_tai"),
    (T.StringType(), "swot_lake_name"),
    (T.DoubleType(), "swot_p_lat swot_p_lon swot_p_ref_area swot_p_ref_wse swot_p_storage"),
    (T.DoubleType(), "swot_dry_trop_c swot_wet_trop_c swot_iono_c swot_xovr_cal_c swot_pole_tide"
                     " swot_solid_tide swot_load_tidef swot_load_tideg swot_geoid_hght"),
    (T.DoubleType(), "s2_wsa s2_wsa_resid s2_coverage s2_ice"),
    (T.IntegerType(), "ice clim_ice adaptive_filter variable_area"),
    (T.DoubleType(), "swot_opt_dis swot_opt_con swot_filt_dis swot_filt_con"
                     " swots2_opt_dis swots2_opt_con swots2_filt_dis swots2_filt_con"
                     " s2_opt_dis s2_opt_con s2_filt_dis s2_filt_con"
                     " static_opt_dis static_opt_con static_filt_dis static_filt_con"),
    (T.DoubleType(), "s2_wsa_cor swot_xtrk_dist storage_anomaly swot_storage_anomaly"
                     " swots2_storage_anomaly s2_storage_anomaly static_area_storage_anomaly"),
]

DAILY = T.StructType([
    T.StructField(name, dtype) for dtype, names in _DAILY_GROUPS for name in names.split()
])

# Numbers that stand for "missing" in the raw files.
SENTINELS = {"storage": [-1233478766.52], "swot_ice_dyn_f": [-999]}

LAKE_MAPPING = T.StructType([
    T.StructField("swot_lake_id", T.StringType()),
    T.StructField("gage_id", T.StringType()),
    T.StructField("ref_area_swot", T.DoubleType()),
])
EXCLUDED = T.StructType([T.StructField("swot_lake_id", T.StringType())])
UNCERTAINTY_COMBOS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("model", "swot_filter", "temporal")]
    + [T.StructField(c, T.DoubleType()) for c in ("wse", "wse_temporal", "wse_filt", "wsa")]
)

# Start of the science era and the level error that gives a 0.1 m spread.
ERA_START = "2023-07-21"
IDEALIZED_THRESHOLD = 0.283
