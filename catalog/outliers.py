"""Outlier rules, thresholds, smoothing, adaptive filter (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import EV, OBS, ORDER, TRUTH, ev, obs, query, rounded, shape, truth_daily, with_
from hydroseries.operators import adaptive as ad
from hydroseries.operators import cycles as cy
from hydroseries.operators import outliers as ol
from hydroseries.operators import smooth as sm
from hydroseries.operators import thresholds as th


def _fence(col: str, lo: float, hi: float, mult: float) -> str:
    return (f"fence AS (SELECT lake, ql - {mult} * (qh - ql) AS lb, qh + {mult} * (qh - ql) AS ub FROM (SELECT lake, "
            f"quantile_cont({col}, {lo}) AS ql, quantile_cont({col}, {hi}) AS qh FROM obs GROUP BY lake))")


@query("c1_tukey", shape(with_(OBS, _fence("swot_wsa", 0.25, 0.75, 0.3)) + """
FINAL SELECT o.lake, max(lb) AS lower_bound, max(ub) AS upper_bound, count(*) AS n, avg(swot_wsa) AS mean_area
FROM obs o JOIN fence f ON o.lake = f.lake WHERE swot_wsa BETWEEN lb AND ub GROUP BY o.lake""", "lake", "n", "lower_bound upper_bound mean_area"))
def tukey(spark, d):
    rows = ol.tukey(obs(spark, d), "lake", "swot_wsa", 0.3, keep_bounds=True)
    return rounded(rows.groupBy("lake").agg(F.max("lower_bound").alias("lower_bound"), F.max("upper_bound").alias("upper_bound"),
                                            F.count(F.lit(1)).alias("n"), F.avg("swot_wsa").alias("mean_area")))


@query("c2_tukey_low_null", shape(with_(OBS, _fence("swot_wsa", 0.25, 0.75, 0.3)) + """
FINAL SELECT o.lake, count(*) AS n_rows, count(CASE WHEN swot_wsa >= lb THEN swot_wsa END) AS n, avg(CASE WHEN swot_wsa >= lb THEN swot_wsa END) AS mean_area
FROM obs o JOIN fence f ON o.lake = f.lake GROUP BY o.lake""", "lake", "n_rows n", "mean_area"))
def tukey_low(spark, d):
    rows = ol.tukey(obs(spark, d), "lake", "swot_wsa", 0.3, side="low", action="null")
    return rounded(rows.groupBy("lake").agg(F.count(F.lit(1)).alias("n_rows"), F.count("swot_wsa").alias("n"), F.avg("swot_wsa").alias("mean_area")))


@query("c3_trim_abs", shape(with_(OBS) + """
FINAL SELECT lake, count(*) AS n, avg(p) AS mean_pct FROM (SELECT lake, swot_wsa - 50 AS p FROM obs)
WHERE abs(p) <= (SELECT quantile_cont(abs(swot_wsa - 50), 0.9) FROM obs) GROUP BY lake""", "lake", "n", "mean_pct"))
def trim_abs(spark, d):
    rows = ol.trim_abs(obs(spark, d).withColumn("p", F.col("swot_wsa") - 50), "p", 90)
    return rounded(rows.groupBy("lake").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_pct")))


@query("c3_trim_abs_keyed", shape(with_(OBS, "q AS (SELECT lake, quantile_cont(abs(swot_wse_error), 0.9) AS k FROM obs GROUP BY lake)") + """
FINAL SELECT o.lake, count(*) AS n, avg(swot_wse_error) AS mean_error FROM obs o JOIN q ON o.lake = q.lake
WHERE abs(swot_wse_error) <= k * (1 + 1e-12) GROUP BY o.lake""", "lake", "n", "mean_error"))
def trim_abs_keyed(spark, d):
    rows = ol.trim_abs(obs(spark, d), "swot_wse_error", 90, "lake")
    return rounded(rows.groupBy("lake").agg(F.count(F.lit(1)).alias("n"), F.avg("swot_wse_error").alias("mean_error")))


@query("c4_trim_pct", shape(with_(OBS, "q1 AS (SELECT quantile_cont(swot_wsa, 0.05) AS lo, quantile_cont(swot_wsa, 0.95) AS hi FROM obs)",
    "r1 AS (SELECT obs.* FROM obs, q1 WHERE swot_wsa BETWEEN lo AND hi)",
    "q2 AS (SELECT quantile_cont(swot_xtrk_dist * swot_wse, 0.05) AS lo, quantile_cont(swot_xtrk_dist * swot_wse, 0.95) AS hi FROM r1)") + """
FINAL SELECT flag, count(*) AS n, avg(swot_wsa) AS mean_area FROM r1, q2 WHERE swot_xtrk_dist * swot_wse BETWEEN lo AND hi GROUP BY flag""",
    "flag", "n", "mean_area"))
def trim_pct(spark, d):
    rows = ol.trim_pct(obs(spark, d).withColumn("w", F.col("swot_xtrk_dist") * F.col("swot_wse")), ["swot_wsa", "w"], 5, 95)
    return rounded(rows.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.avg("swot_wsa").alias("mean_area")))


PREP = """prep AS (SELECT *, swot_wse AS wse, swot_wse_std AS wse_std, swot_wse_u AS wse_u, swot_xtrk_dist AS xtrk_dist, swot_pass_id AS pass_id,
 swot_ice_clim_f AS ice_clim_f, swot_wsa AS area_total, CASE WHEN swot_crid IN ('PIC2', 'PID0') THEN 'PIC2_or_PID0' ELSE 'early_versions' END AS crid_scenario,
 CASE WHEN swot_ice_clim_f >= 2 THEN 'ice-covered' ELSE 'ice-free' END AS ice_condition,
 swot_xovr_cal_q < 1 AND (swot_quality_f < 1 OR (swot_quality_f = 1 AND swot_crid IN ('PIC2', 'PID0'))) AS cons FROM obs)"""


def _calibration(fallout: str) -> list[str]:
    """Threshold tables as oracle text, one CTE per filling level."""
    out = ["""tri AS (SELECT lake, crid_scenario, pass_id, ice_condition, max(CAST(cons AS INT)) AS c, max(CASE WHEN cons THEN wse_std END) AS s,
 max(CASE WHEN cons THEN wse_u END) AS u, min(CASE WHEN cons THEN abs(xtrk_dist) END) AS x FROM prep GROUP BY ALL)""",
           """grid AS (SELECT lake, crid_scenario, pass_id, pc, v.ice_condition FROM (SELECT lake, crid_scenario, pass_id, max(c) AS pc FROM tri GROUP BY ALL)
 CROSS JOIN (VALUES ('ice-free'), ('ice-covered'), ('both')) v(ice_condition))""",
           """l0 AS (SELECT g.*, CASE WHEN g.ice_condition = 'both' THEN CASE WHEN pc = 1 THEN 1 ELSE 2 END WHEN c IS NULL THEN 3 WHEN c = 1 THEN 1 ELSE 2 END AS grouping_scheme,
 CASE WHEN g.ice_condition = 'both' THEN max(s) OVER (PARTITION BY lake) ELSE max(s) OVER (PARTITION BY lake, ice_condition) END AS s,
 CASE WHEN g.ice_condition = 'both' THEN max(u) OVER (PARTITION BY lake) ELSE max(u) OVER (PARTITION BY lake, ice_condition) END AS u,
 CASE WHEN g.ice_condition = 'both' THEN min(x) OVER (PARTITION BY lake, pass_id) ELSE min(x) OVER (PARTITION BY lake, pass_id, ice_condition) END AS x
 FROM grid g LEFT JOIN tri USING (lake, crid_scenario, pass_id, ice_condition))"""]
    ice = {"s": [("ice_condition", "pass_id"), ("ice_condition", "crid_scenario"), ("ice_condition",)],
           "x": [("pass_id", "ice_condition"), ("pass_id", "crid_scenario"), ("pass_id",)]}
    ice["u"] = ice["s"]
    steps = [(m, lv, "<>") for m in "sux" for lv in ice[m]] + [(m, lv, "=") for m in "sux" for lv in (("pass_id",), ("crid_scenario",))]
    n = 0
    for m, level, side in steps:
        if fallout == "as_run" and len(level) == 1:
            continue
        f = "min" if m == "x" else "max"
        pool = m if fallout == "as_run" else f"CASE WHEN ice_condition {side} 'both' THEN {m} END"
        out.append(f"l{n + 1} AS (SELECT * REPLACE (CASE WHEN ice_condition {side} 'both' THEN coalesce({m}, {f}({pool}) OVER "
                   f"(PARTITION BY lake, {', '.join(level)})) ELSE {m} END AS {m}) FROM l{n})")
        n += 1
    out.append(f"thr AS (SELECT lake, crid_scenario, pass_id, ice_condition, s AS wse_std_threshold, u AS wse_u_threshold, x AS xtrk_dist_threshold, grouping_scheme FROM l{n})")
    return out


def _prep(spark, d):
    return ad.prepare_adaptive(obs(spark, d), ["lake"], order=ORDER)


def _calibrate(name, fallout):
    @query(name, shape(with_(OBS, PREP, *_calibration(fallout)) + "\nFINAL SELECT * FROM thr", "lake crid_scenario ice_condition",
                       "pass_id grouping_scheme", "wse_std_threshold wse_u_threshold xtrk_dist_threshold"))
    def run(spark, d):
        return rounded(th.calibrate_thresholds(_prep(spark, d), ["lake"], th.conservative(), fallout=fallout))


_calibrate("c5_c6_c7_thresholds", "documented")
_calibrate("c7_thresholds_as_run", "as_run")


@query("c8_apply_thresholds", shape(with_(OBS, PREP, *_calibration("documented"),
    """wide AS (SELECT lake, crid_scenario, pass_id, max(greatest(0, least(3, coalesce(wse_std_threshold, 3)))) FILTER (WHERE ice_condition = 'ice-free') AS s,
 max(greatest(0, least(0.5, coalesce(wse_u_threshold, 0.5)))) FILTER (WHERE ice_condition = 'both') AS ub,
 max(greatest(0, least(0.5, coalesce(wse_u_threshold, 0.5)))) FILTER (WHERE ice_condition = 'ice-free') AS uf,
 max(greatest(0, least(75000, coalesce(xtrk_dist_threshold, 0)))) FILTER (WHERE ice_condition = 'ice-covered') AS x FROM thr GROUP BY ALL)""") + """
FINAL SELECT lake, ice_condition, count(*) AS n, avg(wse_u) AS mean_u FROM prep JOIN wide USING (lake, crid_scenario, pass_id)
WHERE wse_std <= CASE WHEN ice_clim_f >= 1 THEN greatest(s, 0.3) ELSE s END
 AND wse_u <= CASE WHEN ice_clim_f >= 1 THEN greatest(CASE WHEN ice_clim_f >= 2 THEN uf ELSE ub END, 0.06) ELSE ub END
 AND (ice_clim_f < 2 OR abs(xtrk_dist) >= x) GROUP BY lake, ice_condition""", "lake ice_condition", "n", "mean_u"))
def apply_thresholds(spark, d):
    p = _prep(spark, d)
    thr = th.calibrate_thresholds(p, ["lake"], th.conservative())
    rows = th.apply_thresholds(p, thr, ["lake"], ice_min=(0.3, 0.06), rules_free=("ice-free", "both", "not apply"),
                               rules_ice=("ice-free", "ice-free", "ice-covered"))
    return rounded(rows.groupBy("lake", "ice_condition").agg(F.count(F.lit(1)).alias("n"), F.avg("wse_u").alias("mean_u")))


@query("c9_ice_outliers", shape(with_(OBS, PREP, """ref AS (SELECT lake, pass_id, crid_scenario, count(area_total) AS na, count(wse) AS nl,
 quantile_cont(area_total, 0.75) + 0.2 * (quantile_cont(area_total, 0.75) - quantile_cont(area_total, 0.25)) AS ua,
 quantile_cont(wse, 0.75) + 0.2 * (quantile_cont(wse, 0.75) - quantile_cont(wse, 0.25)) AS ul FROM prep WHERE ice_clim_f <= 1 GROUP BY ALL)""") + """
FINAL SELECT lake, ice_condition, count(*) AS n, avg(wse) AS mean_level FROM prep LEFT JOIN ref USING (lake, pass_id, crid_scenario)
WHERE ice_clim_f <= 1 OR ((na < 2 OR area_total <= ua) AND (nl < 2 OR wse <= ul)) GROUP BY lake, ice_condition""", "lake ice_condition", "n", "mean_level"))
def ice_outliers(spark, d):
    rows = ol.ice_outliers(_prep(spark, d), ["lake"], mult=0.2)
    return rounded(rows.groupBy("lake", "ice_condition").agg(F.count(F.lit(1)).alias("n"), F.avg("wse").alias("mean_level")))


@query("c9_ice_outliers_by_pass", shape(with_(OBS, PREP, """ref AS (SELECT lake, pass_id, min(wse) - 0 * (max(wse) - min(wse)) AS ll, max(wse) AS ul, count(wse) AS nl
 FROM prep WHERE ice_clim_f <= 1 GROUP BY ALL)""") + """
FINAL SELECT lake, count(*) AS n, avg(wse) AS mean_level FROM prep LEFT JOIN ref USING (lake, pass_id)
WHERE ice_clim_f <= 1 OR nl < 2 OR wse BETWEEN ll AND ul GROUP BY lake""", "lake", "n", "mean_level"))
def ice_outliers_pass(spark, d):
    rows = ol.ice_outliers(_prep(spark, d), ["lake"], by_crid=False, mult=0, lo=0, hi=1, used_q="both", filter_by="wse")
    return rounded(rows.groupBy("lake").agg(F.count(F.lit(1)).alias("n"), F.avg("wse").alias("mean_level")))


@query("c10_median_band", shape(with_(OBS, "q AS (SELECT lake, median(swot_wse_anomaly) AS m FROM obs GROUP BY lake)") + """
FINAL SELECT o.lake, count(*) AS n, avg(swot_wse_anomaly) AS mean_level FROM obs o JOIN q ON o.lake = q.lake
WHERE abs(swot_wse_anomaly - m) <= 12 GROUP BY o.lake""", "lake", "n", "mean_level"))
def median_band(spark, d):
    rows = ol.median_band(obs(spark, d), "lake", "swot_wse_anomaly", 12)
    return rounded(rows.groupBy("lake").agg(F.count(F.lit(1)).alias("n"), F.avg("swot_wse_anomaly").alias("mean_level")))


def _baseline_rounds() -> list[str]:
    """The five rounds written out; a round changes nothing for a stable key."""
    out = ["r0 AS (SELECT lake, value FROM ev WHERE value < 400)"]
    for i in range(1, 6):
        out.append(f"f{i} AS (SELECT lake, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.9) AS b FROM r{i - 1} GROUP BY lake)")
        out.append(f"t{i} AS (SELECT r.* FROM r{i - 1} r JOIN f{i} f ON r.lake = f.lake WHERE value >= a - (b - a) AND value <= b + (b - a))")
        out.append(f"m{i} AS (SELECT lake, median(value) AS m FROM t{i} GROUP BY lake)")
        out.append(f"r{i} AS (SELECT t.* FROM t{i} t JOIN m{i} m ON t.lake = m.lake WHERE abs(value - m) <= 120)")
    return out


@query("c11_baseline_tukey", shape(with_(EV, *_baseline_rounds()) + "\nFINAL SELECT lake, count(*) AS n, avg(value) AS mean_value FROM r5 GROUP BY lake", "lake", "n", "mean_value"))
def baseline(spark, d):
    rows, _ = ol.baseline_tukey(ev(spark, d), "lake", "value", F.col("value") < 400, mult=1, width=120)
    return rounded(rows.groupBy("lake").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")))


_GRID = """grid AS (SELECT lake, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM truth GROUP BY lake)"""
_LINE = """line AS (SELECT lake, date, row_number() OVER (PARTITION BY lake ORDER BY date) AS k, count(*) OVER (PARTITION BY lake) AS m,
 CASE WHEN d0 = date THEN v0 ELSE v0 + (v1 - v0) * date_diff('day', d0, date) / date_diff('day', d0, d1) END AS y FROM (
 SELECT lake, date, last_value(CASE WHEN truth IS NOT NULL THEN date END IGNORE NULLS) OVER p AS d0, last_value(truth IGNORE NULLS) OVER p AS v0,
 first_value(CASE WHEN truth IS NOT NULL THEN date END IGNORE NULLS) OVER q AS d1, first_value(truth IGNORE NULLS) OVER q AS v1
 FROM grid LEFT JOIN truth USING (lake, date) WINDOW p AS (PARTITION BY lake ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 q AS (PARTITION BY lake ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))"""


_ENDS = "([31, 9, -3, -5, 3], [9, 13, 12, 6, -5], [-3, 12, 17, 12, -3], [-5, 6, 12, 13, 9], [3, -5, -3, 9, 31])"
_NEAR = "near AS (SELECT *, greatest(least(k - 2, m - 4), 1) AS s, list(y) OVER (PARTITION BY lake ORDER BY date ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS ys FROM line)"


# Five days, a parabola: the known fractions for each place in the window. Three days lie on a parabola, two or four have no curve.
@query("c12_savgol", shape(with_(EV, TRUTH, _GRID, _LINE, _NEAR) + f"""
FINAL SELECT lake, date AS day, CASE WHEN m = 3 THEN y WHEN m >= 5 THEN list_dot_product(CAST(ys[least(k, 5) - (k - s):least(k, 5) - (k - s) + 4] AS DOUBLE[]),
 CAST({_ENDS.replace("(", "[").replace(")", "]")}[k - s + 1] AS DOUBLE[])) / 35 END AS smoothed FROM near""", "lake day", "", "smoothed"))
def savgol(spark, d):
    t = truth_daily(ev(spark, d))
    grid = t.groupBy("lake").agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    return rounded(sm.smooth(t, "lake", "date", "truth", "savgol", [{"window": 5, "order": 2}], at=grid).select("lake", "day", "smoothed"))


@query("c13_running_median", shape(with_(EV, TRUTH, _GRID, _LINE) + """
FINAL SELECT lake, date AS day, CASE WHEN m = 1 THEN y ELSE list_sort([coalesce(lag(y) OVER w, 0), y, coalesce(lead(y) OVER w, 0)])[2] END AS smoothed
FROM line WINDOW w AS (PARTITION BY lake ORDER BY date)""", "lake day", "", "smoothed"))
def running_median(spark, d):
    t = truth_daily(ev(spark, d))
    grid = t.groupBy("lake").agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    return rounded(sm.smooth(t, "lake", "date", "truth", "median", [{"window": 3}], at=grid).select("lake", "day", "smoothed"))


def _gram(order: str, half: str, i: str, t: str) -> str:
    """Weight of place ``i`` for a polynomial fit read at place ``t`` (places from the centre), by Gram polynomials."""
    def p(x: str) -> list[str]:
        p1 = f"({x} / {half})"
        p2 = f"((3 * {x} * {p1} - ({half} + 1)) / (2 * {half} - 1))"
        p3 = f"((5 * {x} * {p2} - (2 * {half} + 3) * {p1}) / (3 * ({half} - 1)))"
        return ["1", p1, p2, p3]
    w = f"(2 * {half})"
    scale = [f"1 / ({w} + 1)", f"3 * {w} / (({w} + 2) * ({w} + 1))", f"5 * {w} * ({w} - 1) / (({w} + 3) * ({w} + 2) * ({w} + 1))",
             f"7 * {w} * ({w} - 1) * ({w} - 2) / (({w} + 4) * ({w} + 3) * ({w} + 2) * ({w} + 1))"]
    terms = [f"{c} * {a} * {b}" for c, a, b in zip(scale, p(i), p(t), strict=True)]
    return " + ".join(terms[:3]) + f" + CASE WHEN {order} >= 3 THEN {terms[3]} ELSE 0 END"


_SETS = ["sets(curve, o, w0) AS (VALUES (0, 2, 11), (1, 2, 21), (2, 2, 31), (3, 3, 11), (4, 3, 21), (5, 3, 31))",
         """fit AS (SELECT line.*, curve, o, CASE WHEN w <= o THEN 5 ELSE w END AS w FROM (
 SELECT *, CASE WHEN w0 >= m THEN (m // 2) * 2 + 1 ELSE w0 END AS w FROM (SELECT DISTINCT lake, m FROM line), sets) JOIN line USING (lake, m))""",
         "placed AS (SELECT *, greatest(least(k - w // 2, m - w + 1), 1) AS s, CAST((w - 1) / 2 AS DOUBLE) AS h FROM fit)",
         f"""smo AS (SELECT a.lake, a.date, a.curve, CASE WHEN a.w <= a.m THEN sum(b.y * ({_gram('a.o', 'a.h', '(b.k - a.s - a.h)', '(a.k - a.s - a.h)')})) END AS smoothed
 FROM placed a JOIN line b ON a.lake = b.lake AND b.k BETWEEN a.s AND a.s + a.w - 1 GROUP BY a.lake, a.date, a.curve, a.w, a.m)"""]


@query("c12_savgol_sets", shape(with_(EV, TRUTH, _GRID, _LINE, *_SETS) + "\nFINAL SELECT lake, date AS day, curve, smoothed FROM smo SEMI JOIN truth USING (lake, date)",
                                "lake day", "curve", "smoothed"))
def savgol_sets(spark, d):
    return rounded(sm.smooth(truth_daily(ev(spark, d)), "lake", "date", "truth", "savgol"))


_CURVES = "cur AS (SELECT lake, date, c, v FROM (SELECT lake, date, min(swot_wsa) AS a, avg(swot_wsa) AS b, max(swot_wsa) AS c0 FROM obs GROUP BY lake, date) UNPIVOT (v FOR c IN (a, b, c0)))"


def _curves(spark, d):
    o = obs(spark, d)
    wide = o.groupBy("lake", F.col("date").alias("day")).agg(F.min("swot_wsa").alias("a"), F.avg("swot_wsa").alias("b"), F.max("swot_wsa").alias("c0"))
    return o, wide.unpivot(["lake", "day"], ["a", "b", "c0"], "curve", "smoothed")


@query("c18_envelope", shape(with_(OBS, _CURVES) + "\nFINAL SELECT lake, date AS day, min(v) AS bottom, max(v) AS top FROM cur GROUP BY lake, date", "lake day", "", "bottom top"))
def envelope(spark, d):
    return rounded(sm.envelope(_curves(spark, d)[1], "lake"))


@query("c18_signed_min_abs", shape(with_(OBS, _CURVES, """j AS (SELECT o.lake, o.o1, o.o2, o.o3, o.o4, v - wsa AS r, row_number() OVER (PARTITION BY o.lake, o.o1, o.o2, o.o3, o.o4
 ORDER BY abs(v - wsa), v - wsa) AS k FROM obs o JOIN cur c ON o.lake = c.lake AND o.date = c.date)""") + """
FINAL SELECT lake, count(*) AS n, avg(r) AS mean_residual, avg(abs(r)) AS mean_abs FROM j WHERE k = 1 GROUP BY lake""", "lake", "n", "mean_residual mean_abs"))
def signed(spark, d):
    o, curves = _curves(spark, d)
    rows = sm.signed_min_abs(curves, o, "lake", "date", "wsa")
    return rounded(rows.groupBy("lake").agg(F.count("residual").alias("n"), F.avg("residual").alias("mean_residual"), F.avg(F.abs("residual")).alias("mean_abs")))


@query("c19_zclip", shape(with_(OBS, "s AS (SELECT lake, avg(swot_wse_error) AS m, stddev_pop(swot_wse_error) AS sd, max(swot_wse_anomaly) - min(swot_wse_anomaly) AS rg FROM obs GROUP BY lake)") + """
FINAL SELECT o.lake, count(*) AS n, avg(swot_wse_error) AS mean_error FROM obs o JOIN s ON o.lake = s.lake
WHERE abs((swot_wse_error - m) / sd) < 0.7 OR abs(swot_wse_error) / rg < 0.0003 GROUP BY o.lake""", "lake", "n", "mean_error"))
def zclip(spark, d):
    rows = ol.zclip(obs(spark, d), "lake", "swot_wse_error", "swot_wse_anomaly", 0.7, 0.0003)
    return rounded(rows.groupBy("lake").agg(F.count(F.lit(1)).alias("n"), F.avg("swot_wse_error").alias("mean_error")))


@query("c20_drop_in_gaps", shape(with_(EV, "b AS (SELECT DISTINCT lake, date FROM ev WHERE kind = 'purchase')",
    "g AS (SELECT lake, date AS x, lead(date) OVER (PARTITION BY lake ORDER BY date) AS y FROM b)") + """
FINAL SELECT lake, count(*) AS n, avg(value) AS mean_value FROM ev WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.lake = ev.lake AND date_diff('day', x, y) > 3
 AND ev.date > x AND ev.date < y) GROUP BY lake""", "lake", "n", "mean_value"))
def drop_in_gaps(spark, d):
    e = ev(spark, d)
    rows = ol.drop_in_gaps(e, e.where("kind = 'purchase'"), "lake", "date", 3)
    return rounded(rows.groupBy("lake").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")))


@query("c21_accept_series", shape(with_(EV, "b AS (SELECT lake, date, date_diff('day', lag(date) OVER (PARTITION BY lake ORDER BY date), date) AS g FROM ev WHERE kind = 'purchase')") + """
FINAL SELECT lake, count(*) AS n_obs, coalesce(max(g), 0) AS max_gap, date_diff('day', min(date), max(date)) AS span_days,
 CASE WHEN count(*) >= 20 / 6 + 1 AND NOT coalesce(max(g) > 6, FALSE) AND date_diff('day', min(date), max(date)) >= 20 THEN 0 ELSE -1 END AS status
FROM b GROUP BY lake""", "lake", "n_obs max_gap span_days status"))
def accept(spark, d):
    out = ol.accept_series(ev(spark, d).where("kind = 'purchase'"), "lake", "date", max_gap=6, min_span=20)
    return rounded(out.withColumn("max_gap", F.coalesce("max_gap", F.lit(0))))


@query("c23_calibratable", shape(with_(OBS, PREP) + """
FINAL SELECT lake, count(wse) AS n_level, count(*) FILTER (WHERE cons) AS n_conservative,
 CASE WHEN count(wse) = 0 THEN 'no level' WHEN count(*) FILTER (WHERE cons) < 60 THEN 'too few conservative rows' ELSE 'ok' END AS reason
FROM prep GROUP BY lake""", "lake reason", "n_level n_conservative"))
def calibratable(spark, d):
    return rounded(th.calibratable(_prep(spark, d), ["lake"], th.conservative(), 60))


# The adaptive filter as recursive SQL: a round for all lakes that still change.
_MARKED = ["""okl AS (SELECT lake FROM prep GROUP BY lake HAVING count(wse) > 0 AND count(*) FILTER (WHERE cons) >= 5)""",
           """lim AS (SELECT lake, crid_scenario, pass_id, max(greatest(0, least(3, coalesce(wse_std_threshold, 3)))) FILTER (WHERE ice_condition = 'ice-free') AS s,
 max(greatest(0, least(0.5, coalesce(wse_u_threshold, 0.5)))) FILTER (WHERE ice_condition = 'ice-free') AS u FROM thr GROUP BY ALL)""",
           """marked AS (SELECT prep.*, wse_std <= CASE WHEN ice_clim_f >= 1 THEN greatest(coalesce(s, 3), 3) ELSE coalesce(s, 3) END
 AND wse_u <= CASE WHEN ice_clim_f >= 1 THEN greatest(coalesce(u, 0.5), 0.1) ELSE coalesce(u, 0.5) END AS passes
 FROM prep SEMI JOIN okl USING (lake) LEFT JOIN lim USING (lake, crid_scenario, pass_id))""",
           """src AS (SELECT lake, o1, o2, o3, o4, date, wse, area_total AS area, pass_id AS pass, ice_clim_f AS ice, passes,
 passes AND swot_xovr_cal_q < 2 AND swot_quality_f < 3 AS base_ok, passes AND swot_xovr_cal_q = 0 AND swot_quality_f = 0 AND ice_clim_f = 0 AS good FROM marked)""",
           f"""wt AS (SELECT w, t, list(CAST({_gram('3', 'h', '(i - h)', '(t - h)')} AS DOUBLE) ORDER BY i) AS ws FROM (
 SELECT w, CAST(t AS DOUBLE) AS t, CAST(i AS DOUBLE) AS i, (w - 1) / 2.0 AS h FROM range(5, 22, 2) a(w), range(21) b(t), range(21) c(i) WHERE t < w AND i < w) GROUP BY w, t)"""]


def _settled(name: str, start: str, base: str, z: float, spread: float, limit: int) -> str:
    """Rounds as one recursive table: rows of a lake stay in it with their round once ``done``."""
    return f"""{name} AS (SELECT *, count(*) OVER (PARTITION BY lake) AS cnt, 0 AS n, FALSE AS done FROM {start} UNION ALL (WITH
cur AS (SELECT * FROM {name} WHERE NOT done),
days AS (SELECT lake, date, first(wse ORDER BY o1, o2, o3, o4) AS f, last(wse ORDER BY o1, o2, o3, o4) AS l, count(*) AS c, min(wse) AS lo, max(wse) AS hi FROM cur WHERE {base} GROUP BY lake, date),
acc AS (SELECT lake, max(hi) - min(lo) AS reach FROM days GROUP BY lake HAVING sum(c) >= 365 / 95 + 1),
step AS (SELECT lake, date, l, reach, lead(f) OVER w AS nf, coalesce(date_diff('day', date, lead(date) OVER w), 1) AS far FROM days JOIN acc USING (lake) WINDOW w AS (PARTITION BY lake ORDER BY date)),
grid AS (SELECT lake, reach, date + CAST(i AS INT) AS date, CASE WHEN i = 0 THEN l ELSE l + (nf - l) * (i / far) END AS y, CASE WHEN i = 0 THEN 0 ELSE far END AS gap FROM (SELECT *, unnest(range(0, far)) AS i FROM step)),
line AS (SELECT *, row_number() OVER (PARTITION BY lake ORDER BY date) AS k, count(*) OVER (PARTITION BY lake) AS m,
 list(y) OVER (PARTITION BY lake ORDER BY date ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS near FROM grid),
placed AS (SELECT *, greatest(least(k - w // 2, m - w + 1), 1) AS s FROM (SELECT *, greatest(CASE WHEN 21 >= m THEN (m // 2) * 2 + 1 ELSE 21 END, 5) AS w FROM line) WHERE gap <= 95),
curve AS (SELECT lake, date, reach, CASE WHEN p.w <= m THEN list_dot_product(CAST(near[least(k, 21) - (k - s):least(k, 21) - (k - s) + p.w - 1] AS DOUBLE[]), ws) END AS v FROM placed p LEFT JOIN wt ON wt.w = p.w AND wt.t = k - s),
res AS (SELECT cur.*, v - wse AS r, reach FROM cur JOIN curve USING (lake, date)),
st AS (SELECT lake, avg(r) AS am, stddev_pop(r) AS sd, sum(abs(r)) AS sa FROM res GROUP BY lake),
clip AS (SELECT res.*, coalesce(abs((r - am) / CASE WHEN sa = 0 THEN 1 ELSE nullif(sd, 0) END) < {z}, FALSE) OR coalesce(abs(r) / nullif(reach, 0) < {spread}, FALSE) AS alive FROM res JOIN st USING (lake)),
ip AS (SELECT lake, pass, count(area) AS na, max(area) + 0.3 * (max(area) - min(area)) AS ua, count(wse) AS nl, max(wse) + 0.3 * (max(wse) - min(wse)) AS ul FROM clip WHERE alive AND ice <= 1 GROUP BY lake, pass),
ik AS (SELECT lake, count(area) AS kna, max(area) + 0.3 * (max(area) - min(area)) AS kua, count(wse) AS knl, max(wse) + 0.3 * (max(wse) - min(wse)) AS kul, max(wse) + 0.2 * (max(wse) - min(wse)) AS ku2 FROM clip WHERE alive AND ice <= 1 GROUP BY lake),
cold AS (SELECT clip.* REPLACE (alive AND (knl IS NULL OR ice <= 1 OR (CASE WHEN nl IS NULL THEN (kna < 2 OR area <= kua) AND (knl < 2 OR wse <= kul) ELSE (na < 2 OR area <= ua) AND (nl < 2 OR wse <= ul) END
 AND (knl < 2 OR wse <= ku2))) AS alive) FROM clip LEFT JOIN ip USING (lake, pass) LEFT JOIN ik USING (lake)),
fence AS (SELECT lake, q1 - 3 * (q9 - q1) AS f0, q9 + 3 * (q9 - q1) AS f1 FROM (SELECT lake, quantile_cont(wse, 0.1) AS q1, quantile_cont(wse, 0.9) AS q9 FROM cold WHERE alive GROUP BY lake)),
mid AS (SELECT lake, median(wse) AS me FROM cold JOIN fence USING (lake) WHERE alive AND wse BETWEEN f0 AND f1 GROUP BY lake),
kept AS (SELECT cold.*, count(*) OVER (PARTITION BY lake) AS after FROM cold LEFT JOIN fence USING (lake) LEFT JOIN mid USING (lake)
 WHERE locked OR (alive AND wse BETWEEN greatest(f0, me - 150) AND least(f1, me + 150)))
SELECT lake, o1, o2, o3, o4, date, wse, area, pass, ice, base_ok, locked, after AS cnt, n + 1 AS n, after >= cnt OR n + 1 = {limit} AS done FROM kept))"""


_ROW = "lake, o1, o2, o3, o4, date, wse, area, pass, ice, base_ok"
_ADAPTIVE = [*_MARKED, f"s1 AS (SELECT {_ROW}, FALSE AS locked FROM src WHERE passes)", _settled("r1", "s1", "base_ok", 2.576, 0.08, 40),
             "e1 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY lake) AS fin FROM r1 WHERE done) WHERE fin >= 365 / 95 + 1)",
             f"""s2 AS (SELECT {_ROW}, TRUE AS locked FROM e1 UNION ALL SELECT {_ROW}, FALSE AS locked FROM src SEMI JOIN e1 USING (lake) ANTI JOIN e1 USING (lake, o1, o2, o3, o4) WHERE good)""",
             _settled("r2", "s2", "TRUE", 3.5, 0.06, 5),
             "e2 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY lake) AS fin FROM r2 WHERE done) WHERE fin >= 365 / 95 + 1)",
             """codes AS (SELECT o.lake, CASE WHEN nw = 0 THEN -9 ELSE coalesce(a.n, -1) END AS n_round1, CASE WHEN nw = 0 THEN -9 WHEN a.n IS NULL THEN -2 ELSE coalesce(b.n, -1) END AS n_round2
 FROM (SELECT lake, count(swot_wse) AS nw FROM obs GROUP BY lake) o LEFT JOIN (SELECT lake, max(n) AS n FROM e1 GROUP BY lake) a USING (lake) LEFT JOIN (SELECT lake, max(n) AS n FROM e2 GROUP BY lake) b USING (lake))"""]


def _recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes)


@query("c22_adaptive_filter", shape(_recursive(OBS, PREP, *_calibration("documented"), *_ADAPTIVE) + """
FINAL SELECT c.lake, n_round1, n_round2, CASE WHEN n_round1 = -9 THEN 'no data' WHEN n_round2 > 0 THEN 'success' ELSE 'fail' END AS status, o1, o2, o4, date AS day, wse
FROM codes c LEFT JOIN e2 USING (lake)""", "lake status day", "n_round1 n_round2 o1 o2 o4", "wse"))
def adaptive(spark, d):
    rows, status = ad.adaptive_filter(obs(spark, d), "lake", "date", ORDER)
    return rounded(status.join(rows.select("lake", "o1", "o2", "o4", "day", "wse"), "lake", "left"))


@query("c24_adaptive_flag", shape(_recursive(OBS, PREP, *_calibration("documented"), *_ADAPTIVE) + """
FINAL SELECT lake, o1, o2, CASE WHEN e2.fin IS NOT NULL AND obs.date >= DATE '1996-01-01' THEN 0 ELSE 1 END AS adaptive_filter FROM obs LEFT JOIN e2 USING (lake, o1, o2, o3, o4)""",
                                  "lake", "o1 o2 adaptive_filter", ""))
def adaptive_flag(spark, d):
    return rounded(ad.with_adaptive_flag(obs(spark, d), "lake", "date", ORDER, start="1996-01-01").select("lake", "o1", "o2", "adaptive_filter"))


_CYC = ["prep2 AS (SELECT lake, swot_wse AS wse, swot_cycle_id AS cycle_id, swot_pass_id AS pass_id, swot_wsa AS area_total, date AS day, o1, o2, o3, o4 FROM obs)",
        "cm AS (SELECT lake, cycle_id, avg(wse) AS lv, stddev_samp(wse) AS sd, median(date_diff('day', DATE '1970-01-01', day)) AS mid FROM prep2 GROUP BY ALL)",
        "ver AS (SELECT lake, coalesce(median(sd) > stddev_samp(lv), FALSE) AS adjust FROM cm GROUP BY lake)",
        "pa AS (SELECT lake, pass_id, median(area_total) AS a FROM prep2 GROUP BY ALL)",
        "bp AS (SELECT lake, pass_id FROM pa QUALIFY row_number() OVER (PARTITION BY lake ORDER BY a DESC, pass_id) = 1)",
        "dep AS (SELECT *, wse - avg(wse) OVER (PARTITION BY lake) AS dp FROM prep2)",
        "pb AS (SELECT lake, pass_id, median(dp) AS b FROM dep GROUP BY ALL)",
        "adj AS (SELECT dep.*, adjust, CASE WHEN adjust THEN wse - b ELSE wse END AS wa FROM dep JOIN pb USING (lake, pass_id) JOIN ver USING (lake))",
        "fq AS (SELECT lake, quantile_cont(wa, 0.1) AS ql, quantile_cont(wa, 0.9) AS qh FROM adj GROUP BY lake)"]


def _cycle(spark, d):
    return obs(spark, d).select("lake", F.col("swot_wse").alias("wse"), F.col("swot_cycle_id").alias("cycle_id"), F.col("swot_pass_id").alias("pass_id"),
                             F.col("swot_wsa").alias("area_total"), F.col("date").alias("day"), *ORDER)


@query("c25_cycle_means", shape(with_(OBS, *_CYC) + "\nFINAL SELECT lake, cycle_id, lv AS cycle_level, mid AS mid_day FROM cm", "lake", "cycle_id", "cycle_level mid_day"))
def cycle_means(spark, d):
    return rounded(cy.cycle_means(_cycle(spark, d), "lake").drop("cycle_std"))


@query("c25_best_pass", shape(with_(OBS, *_CYC) + """
FINAL SELECT p.lake, count(*) AS n, avg(wse) AS mean_level FROM prep2 p JOIN ver USING (lake) JOIN bp ON bp.lake = p.lake
WHERE NOT adjust OR p.pass_id = bp.pass_id GROUP BY p.lake""", "lake", "n", "mean_level"))
def best_pass(spark, d):
    o = _cycle(spark, d)
    return rounded(cy.best_pass(o, cy.cycle_verdict(o, "lake")[1], "lake").groupBy("lake").agg(F.count(F.lit(1)).alias("n"), F.avg("wse").alias("mean_level")))


@query("c25_pass_bias", shape(with_(OBS, *_CYC) + """
FINAL SELECT lake, count(*) AS n, avg(wa) AS mean_level, stddev_samp(wa) AS spread FROM adj JOIN fq USING (lake)
WHERE NOT adjust OR wa BETWEEN ql - 3 * (qh - ql) AND qh + 3 * (qh - ql) GROUP BY lake""", "lake", "n", "mean_level spread"))
def pass_bias(spark, d):
    o = _cycle(spark, d)
    return rounded(cy.without_pass_bias(o, cy.cycle_verdict(o, "lake")[1], "lake").groupBy("lake").agg(F.count(F.lit(1)).alias("n"), F.avg("wse_adjusted").alias("mean_level"),
                                                           F.stddev_samp("wse_adjusted").alias("spread")))
