"""Sources, projections, predicates and named filters (A, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import EV, OBS, ev, obs, query, rounded, shape, table, with_
from hydroseries.functions import filters as f
from hydroseries.functions import units as u
from hydroseries.functions.keyed import nan_to_null
from hydroseries.operators import adaptive as ad
from hydroseries.sources import daily as src

ERA = "1998-01-01"


def _filtered(name, mask, where):
    """Rows kept by a filter, summed per flag and status."""
    sql = shape(with_(OBS) + f"""
FINAL SELECT flag, status, count(*) AS n, sum(swot_wse_anomaly) AS total_level, avg(swot_wsa) AS mean_area
FROM obs WHERE {where} GROUP BY flag, status""", "flag status", "n", "total_level mean_area")

    @query(name, sql)
    def run(spark, d):
        return rounded(obs(spark, d).where(mask()).groupBy("flag", "status").agg(
            F.count(F.lit(1)).alias("n"), F.sum("swot_wse_anomaly").alias("total_level"),
            F.avg("swot_wsa").alias("mean_area")))


_SIMPLE = ("swot_xovr_cal_q < 2 AND swot_wse_u < 0.1 AND swot_wse_std < 0.4 AND swot_wse_anomaly > -50 "
           "AND swot_wse_anomaly < 50 AND swot_wse > 0")
_filtered("b1_era", lambda: f.era(start=ERA), f"date > DATE '{ERA}'")
_filtered("b1_era_inclusive", lambda: f.era(start=ERA, inclusive=True), f"date >= DATE '{ERA}'")
_filtered("b2_quality_flag", f.quality_flag, "swot_quality_f = 0")
_filtered("b3_simple", f.simple, _SIMPLE)
_filtered("b4_strict", f.strict, "swot_xovr_cal_q < 2 AND swot_wse_u < 0.05 AND swot_wse_std < 0.2 "
          "AND abs(swot_wse_anomaly) < 25 AND swot_partial_f = 0")
_filtered("b5_relaxed", f.relaxed, "swot_xovr_cal_q < 2 AND swot_wse_u < 0.2 AND swot_wse_std < 0.5 "
          "AND abs(swot_wse_anomaly) < 100 AND swot_partial_f = 0")
_filtered("b6_no_partial", f.no_partial, "swot_partial_f = 0")
_filtered("b7_coverage_99", lambda: f.coverage(99), "s2_coverage > 99 AND ice = 0")
_filtered("b8_coverage_95", lambda: f.coverage(95), "s2_coverage > 95 AND ice = 0")
_filtered("b9_no_ice", f.no_ice, "ice = 0")
_filtered("b10_wse_analysis", lambda: f.wse_analysis(start=ERA),
          f"date > DATE '{ERA}' AND {_SIMPLE} AND swot_partial_f = 0")
_filtered("b11_all_of", lambda: f.all_of(f.no_ice(), f.no_partial(), f.quality_flag()),
          "ice = 0 AND swot_partial_f = 0 AND swot_quality_f = 0")
_filtered("b13_idealized", lambda: f.idealized(0.03), "swot_wse_abs_error < 0.03")
_filtered("b14_adaptive", f.adaptive, "adaptive_filter = 0")
_filtered("b20_reasonable", lambda: f.reasonable("swot_wse_anomaly", 20), "abs(swot_wse_anomaly) <= 20")
_filtered("b22_version", lambda: f.version("PID0"), "swot_crid = 'PID0'")


_ALL = f"date > DATE '{ERA}' AND {_SIMPLE} AND swot_partial_f = 0"
_FILTERS = {
    "era": f"date > DATE '{ERA}'", "quality_flag": "swot_quality_f = 0", "simple": _SIMPLE,
    "strict": "swot_xovr_cal_q < 2 AND swot_wse_u < 0.05 AND swot_wse_std < 0.2 AND abs(swot_wse_anomaly) < 25 AND swot_partial_f = 0",
    "relaxed": "swot_xovr_cal_q < 2 AND swot_wse_u < 0.2 AND swot_wse_std < 0.5 AND abs(swot_wse_anomaly) < 100 AND swot_partial_f = 0",
    "no_partial": "swot_partial_f = 0", "coverage_99": "s2_coverage > 99 AND ice = 0", "coverage_95": "s2_coverage > 95 AND ice = 0", "no_ice": "ice = 0",
    "wse_analysis": _ALL, "wsa_analysis": _ALL, "elevation_area_analysis": _ALL, "idealized": "swot_wse_abs_error < 0.283", "adaptive": "adaptive_filter = 0",
}


@query("b12_filter_counts", shape(with_(OBS) + "\nFINAL SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS filter, '{f._CATALOGUE[n]}' AS description, count(*) FILTER (WHERE {e}) AS n FROM obs" for n, e in _FILTERS.items()) + ")", "filter description", "n"))
def _catalogue(spark, d):
    return rounded(f.filter_counts(obs(spark, d), ERA))


@query("b15_prepare", shape(with_(OBS) + """
FINAL SELECT crid_scenario, ice_condition, count(*) AS n, sum(abs(swot_xtrk_dist)) AS dist FROM (
 SELECT *, CASE WHEN swot_crid IN ('PIC2', 'PID0') THEN 'PIC2_or_PID0' ELSE 'early_versions' END AS crid_scenario,
 CASE WHEN swot_ice_clim_f >= 2 THEN 'ice-covered' ELSE 'ice-free' END AS ice_condition FROM obs)
GROUP BY crid_scenario, ice_condition""", "crid_scenario ice_condition", "n", "dist", 2))
def _prepare(spark, d):
    p = ad.prepare_adaptive(obs(spark, d), ["lake"], order=["o1", "o2", "o3", "o4"])
    return rounded(p.groupBy("crid_scenario", "ice_condition").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs("xtrk_dist")).alias("dist")), 2)


@query("b16_errors", shape(with_(OBS) + """
FINAL SELECT lake, count(e) AS n, avg(e) AS mean_error, max(abs(e)) AS max_abs FROM (
 SELECT lake, swot_wse_anomaly - stage_anomaly AS e FROM obs) GROUP BY lake""", "lake", "n", "mean_error max_abs"))
def _errors(spark, d):
    rows = u.with_errors(obs(spark, d).drop("swot_wse_error", "swot_wse_abs_error"), truth="stage_anomaly")
    return rounded(rows.groupBy("lake").agg(F.count("swot_wse_error").alias("n"), F.avg("swot_wse_error").alias("mean_error"),
                                            F.max("swot_wse_abs_error").alias("max_abs")))


@query("b17_pct_errors", shape(with_(OBS) + """
FINAL SELECT lake, count(p) AS n, avg(p) AS mean_pct, avg(abs(p)) AS mean_abs_pct, avg(abs(r)) AS mean_abs_residual FROM (
 SELECT lake, CASE WHEN wsa > 0 THEN swot_wsa - wsa END AS r,
 CASE WHEN wsa > 0 THEN (swot_wsa - wsa) / wsa * 100 END AS p FROM obs) GROUP BY lake""",
    "lake", "n", "mean_pct mean_abs_pct mean_abs_residual"))
def _pct(spark, d):
    rows = u.with_pct_errors(obs(spark, d))
    return rounded(rows.groupBy("lake").agg(
        F.count("wsa_percentage_error").alias("n"), F.avg("wsa_percentage_error").alias("mean_pct"),
        F.avg("wsa_abs_percentage_error").alias("mean_abs_pct"), F.avg("wsa_abs_residual").alias("mean_abs_residual")))


@query("b18_units", shape(with_(OBS) + """
FINAL SELECT lake, sum(storage / 1233.48) / 1000 AS kacft, sum(storage / 1233.48 * 1233.48 / 1e9) AS km3
FROM obs GROUP BY lake""", "lake", "", "kacft km3", 4))
def _units(spark, d):
    rows = obs(spark, d).withColumn("a", u.m3_to_acft("storage"))
    return rounded(rows.groupBy("lake").agg((F.sum("a") / 1000).alias("kacft"), F.sum(u.acft_to_km3("a")).alias("km3")), 4)


@query("b19_split_variant", shape(with_(OBS) + """
FINAL SELECT split_part(v, '_', 1) AS model, split_part(v, '_', 2) AS filter_type, split_part(v, '_', 3) AS temporal_type,
 count(*) AS n FROM (SELECT flag || '_' || status || '_' || swot_crid AS v FROM obs) GROUP BY ALL""",
    "model filter_type temporal_type", "n"))
def _split(spark, d):
    rows = obs(spark, d).select(F.concat_ws("_", "flag", "status", "swot_crid").alias("v"))
    return rounded(rows.select(*[c.alias(n) for n, c in u.split_variant("v").items()])
                   .groupBy("model", "filter_type", "temporal_type").agg(F.count(F.lit(1)).alias("n")))


@query("b21_drop_all_null", shape(with_(OBS) + """
FINAL SELECT flag, count(*) AS n, count(s2_wsa) AS n_area, count(ref) AS n_ref
FROM (SELECT flag, s2_wsa, swot_p_ref_area AS ref FROM obs) WHERE s2_wsa IS NOT NULL OR ref IS NOT NULL GROUP BY flag""",
    "flag", "n n_area n_ref"))
def _drop_all_null(spark, d):
    rows = src.drop_all_null(obs(spark, d), ["s2_wsa", "swot_p_ref_area"])
    return rounded(rows.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.count("s2_wsa").alias("n_area"),
                                            F.count("swot_p_ref_area").alias("n_ref")))


@query("a1_null_rules", shape(with_(OBS) + """
FINAL SELECT flag, count(v) AS n_kept, avg(v) AS mean_kept FROM (
 SELECT flag, CASE WHEN swot_wse_anomaly IN (-24.5, 24.5) THEN NULL ELSE swot_wse_anomaly END AS v FROM obs) GROUP BY flag""",
    "flag", "n_kept", "mean_kept"))
def _null_rules(spark, d):
    rows = src.null_sentinels(nan_to_null(obs(spark, d)), {"swot_wse_anomaly": [-24.5, 24.5]})
    return rounded(rows.groupBy("flag").agg(F.count("swot_wse_anomaly").alias("n_kept"),
                                            F.avg("swot_wse_anomaly").alias("mean_kept")))


@query("a2_key_from_file", shape(with_(EV) + """
FINAL SELECT lake_id, count(*) AS n FROM (SELECT CASE WHEN kind = 'click' THEN lake || '_x' ELSE
 regexp_extract('/a/' || lake || '_daily.csv', '([^/]+)_daily', 1) END AS lake_id FROM ev) GROUP BY lake_id""", "lake_id", "n"))
def _key(spark, d):
    rows = ev(spark, d).select(
        F.when(F.col("kind") == "click", F.concat(F.col("lake").cast("string"), F.lit("_x"))).alias("id"),
        F.concat(F.lit("/a/"), F.col("lake").cast("string"), F.lit("_daily.csv")).alias("file"))
    return rounded(rows.select(src.key_or_file_name("id", "file").alias("lake_id"))
                   .groupBy("lake_id").agg(F.count(F.lit(1)).alias("n")))


@query("a7_quarantine", shape(with_(EV) + """
FINAL SELECT lake, CASE WHEN n_sensor < 40 THEN 'too few sensor' WHEN n_truth < 20 THEN 'too few truth' ELSE 'ok' END AS reason,
 n AS n_rows FROM (SELECT lake, count(*) AS n, count(*) FILTER (WHERE sensor) AS n_sensor,
 count(*) FILTER (WHERE NOT sensor) AS n_truth FROM ev GROUP BY lake)""", "lake reason", "n_rows"))
def _quarantine(spark, d):
    rows = ev(spark, d).withColumn("s", F.when(F.col("sensor"), F.col("value"))).withColumn(
        "g", F.when(~F.col("sensor"), F.col("value")))
    ok, bad = src.quarantine(rows, "lake", [("too few sensor", "s", 40), ("too few truth", "g", 20)])
    good = ok.groupBy("lake").agg(F.lit("ok").alias("reason"), F.count(F.lit(1)).alias("n_rows"))
    return rounded(good.unionByName(bad.select("lake", "reason", "n_rows")))


@query("a8_processing_summary", shape(with_(OBS) + """
FINAL SELECT lake, count(*) AS n_rows, count(*) FILTER (WHERE swot_wse IS NOT NULL) AS n_level,
 count(*) FILTER (WHERE adaptive_filter = 0) AS n_accepted, count(s2_wsa) AS n_image, count(swot_p_ref_area) AS n_ref
FROM obs GROUP BY lake""", "lake", "n_rows n_level n_accepted n_image n_ref"))
def _summary(spark, d):
    return rounded(src.coverage_summary(obs(spark, d), "lake", {
        "n_level": F.col("swot_wse").isNotNull(), "n_accepted": f.adaptive(),
        "n_image": F.col("s2_wsa").isNotNull(), "n_ref": F.col("swot_p_ref_area").isNotNull()}))
