"""Curves and storage (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import EV, OBS, ORDER, obs, query, rounded, shape, with_
from catalog.timing import interp_sql
from hydroseries.operators import curves as cv
from hydroseries.operators import storage as st
from hydroseries.sources import daily as src

START, LIMIT = "1996-06-01", 0.04
MASK_SQL = {"opt": f"date > DATE '{START}' AND swot_wse_abs_error < {LIMIT}", "filt": f"date > DATE '{START}' AND adaptive_filter = 0"}
LONG = "mk AS (" + " UNION ALL ".join(f"SELECT *, '{k}' AS filter FROM obs WHERE {m}" for k, m in MASK_SQL.items()) + ")"


def mask():
    return st.masks("date", start=START, threshold=LIMIT)


def fit_sql(name: str, src: str, x: str, y: str, by: str = "lake, filter", quad_only: bool = False) -> str:
    """Least squares by solving the raw moments of centred values with regression aggregates."""
    lin = "FALSE" if quad_only else "(sing OR lsse - qsse <= 1e-12 * ww)"
    return f"""{name}_c AS (SELECT {by}, {x} - avg({x}) OVER g AS u, {y} - avg({y}) OVER g AS w, avg({x}) OVER g AS mx, avg({y}) OVER g AS my, count(*) OVER g AS n
 FROM ({src}) WHERE {x} IS NOT NULL AND {y} IS NOT NULL WINDOW g AS (PARTITION BY {by})),
{name}_s AS (SELECT {by}, any_value(mx) AS mx, any_value(my) AS my, any_value(n) AS n, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4, sum(u*w) AS t1, sum(u*u*w) AS t2, sum(w*w) AS ww
 FROM {name}_c WHERE n >= 3 GROUP BY {by}),
{name}_q AS (SELECT *, s2 <= 0 OR abs(s2*(s4 - s2*s2/n) - s3*s3) <= 1e-12*s2*s4 AS sing FROM {name}_s),
{name}_p AS (SELECT *, CASE WHEN s2 <= 0 THEN 0 ELSE t1/s2 END AS bl, CASE WHEN sing THEN 0 ELSE (s2*t2 - s3*t1) / (s2*(s4 - s2*s2/n) - s3*s3) END AS c FROM {name}_q),
{name}_r AS (SELECT *, CASE WHEN sing THEN bl ELSE (t1 - c*s3)/s2 END AS b, ww - bl*t1 AS lsse, ww - CASE WHEN sing THEN bl ELSE (t1 - c*s3)/s2 END*t1 - c*t2 AS qsse FROM {name}_p),
{name} AS (SELECT {by}, n, CASE WHEN s2 > 0 AND ww > 0 THEN t1/sqrt(s2*ww) END AS r, CASE WHEN {lin} THEN 'linear' ELSE 'quadratic' END AS model_type, sqrt(greatest(CASE WHEN {lin} THEN lsse ELSE qsse END, 0)/n) AS rmse,
 CASE WHEN {lin} THEN my - bl*mx ELSE my - c*s2/n - b*mx + c*mx*mx END AS c0, CASE WHEN {lin} THEN bl ELSE b - 2*c*mx END AS c1, CASE WHEN {lin} THEN 0 ELSE c END AS c2 FROM {name}_r)"""


def stable_fit_sql(name: str, src: str, x: str, y: str, by: str = "lake, filter", quad_only: bool = False) -> str:
    """The rule of ``fit_sql`` from parts at right angles; values are taken from the least one first, which is exact for equal ones."""
    lin = "FALSE" if quad_only else "(sing OR c*qw <= 1e-12 * ww)"
    return f"""{name}_a AS (SELECT {by}, {x} - min({x}) OVER g AS x1, {y} - min({y}) OVER g AS y1, min({x}) OVER g AS ax, min({y}) OVER g AS ay, count(*) OVER g AS n
 FROM ({src}) WHERE {x} IS NOT NULL AND {y} IS NOT NULL WINDOW g AS (PARTITION BY {by})),
{name}_c AS (SELECT *, x1 - avg(x1) OVER g AS u, y1 - avg(y1) OVER g AS w, avg(x1) OVER g AS dx, avg(y1) OVER g AS dy FROM {name}_a WINDOW g AS (PARTITION BY {by})),
{name}_s AS (SELECT {by}, any_value(ax + dx) AS mx, any_value(ay + dy) AS my, any_value(n) AS n, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4, sum(u*w) AS t1, sum(w*w) AS ww
 FROM {name}_c WHERE n >= 3 GROUP BY {by}),
{name}_o AS (SELECT {by}, sum(q*q) AS qq, sum(q*w) AS qw FROM (SELECT {by}, w, u*u - CASE WHEN s2 <= 0 THEN 0 ELSE s3/s2 END*u - s2/s.n AS q FROM {name}_c JOIN {name}_s s USING ({by})) GROUP BY {by}),
{name}_q AS (SELECT *, s2 <= 0 OR qq <= 1e-12*s4 AS sing FROM {name}_s JOIN {name}_o USING ({by})),
{name}_p AS (SELECT *, CASE WHEN s2 <= 0 THEN 0 ELSE t1/s2 END AS bl, CASE WHEN sing THEN 0 ELSE qw/qq END AS c FROM {name}_q),
{name}_r AS (SELECT *, CASE WHEN sing THEN bl ELSE bl - c*s3/s2 END AS b, ww - bl*t1 AS lsse, ww - bl*t1 - c*qw AS qsse FROM {name}_p),
{name} AS (SELECT {by}, n, CASE WHEN s2 > 0 AND ww > 0 THEN t1/sqrt(s2*ww) END AS r, CASE WHEN {lin} THEN 'linear' ELSE 'quadratic' END AS model_type, sqrt(greatest(CASE WHEN {lin} THEN lsse ELSE qsse END, 0)/n) AS rmse,
 CASE WHEN {lin} THEN my - bl*mx ELSE my - c*s2/n - b*mx + c*mx*mx END AS c0, CASE WHEN {lin} THEN bl ELSE b - 2*c*mx END AS c1, CASE WHEN {lin} THEN 0 ELSE c END AS c2 FROM {name}_r)"""


def above_sql(h: str, ref: str, c: str) -> str:
    return (f"CASE WHEN {h} <= {ref} THEN 0.0 ELSE ({c}0*({h}-{ref}) + {c}1*({h}*{h}-{ref}*{ref})/2 + {c}2*(({h}*{h}*{h}-{ref}*{ref}*{ref})/3 + ({h}-{ref})*({h}-{ref})*({h}-{ref})/(6*99*99))) * 1e6/1233.48 END")


SWOT_FIT = fit_sql("fa", "SELECT * FROM mk WHERE swot_partial_f = 0", "swot_wse_anomaly", "swot_wsa")
MATCH = """im AS (SELECT lake, date AS rdate, arg_min(s2_wsa, (o1, o2, o3, o4)) AS area, min((o1, o2, o3, o4)) AS o FROM obs WHERE s2_coverage > 99 AND ice = 0 AND s2_wsa IS NOT NULL GROUP BY lake, date),
md AS (SELECT d.lake, d.date, arg_min(area, (abs(date_diff('day', d.date, rdate)), o)) AS area FROM (SELECT DISTINCT lake, date FROM obs) d JOIN im ON d.lake = im.lake
 AND abs(date_diff('day', d.date, rdate)) <= 3 GROUP BY d.lake, d.date),
pairs AS (SELECT mk.lake, mk.filter, mk.swot_wse_anomaly AS h, md.area AS a FROM mk JOIN md ON mk.lake = md.lake AND mk.date = md.date)"""
S2_FIT = fit_sql("fb", "SELECT * FROM pairs", "h", "a")
STABLE_SWOT = stable_fit_sql("fa", "SELECT * FROM mk WHERE swot_partial_f = 0", "swot_wse_anomaly", "swot_wsa")
STABLE_S2 = stable_fit_sql("fb", "SELECT * FROM pairs", "h", "a")
STABLE_INV = stable_fit_sql("fi", "SELECT * FROM pairs", "a", "h", quad_only=True)


@query("g1_corr_test", shape(with_(OBS, "c AS (SELECT lake, count(*) AS n, corr(swot_wse_anomaly, swot_wsa) AS r FROM obs GROUP BY lake)") + """
FINAL SELECT lake, n, r, r * sqrt((n - 2) / (1 - r * r)) AS t_stat FROM c""", "lake", "n", "r t_stat"))
def corr_test(spark, d):
    return rounded(cv.corr_test(obs(spark, d), "lake", "swot_wse_anomaly", "swot_wsa").select("lake", "n", "r", "t_stat"))


# Two-sided p of Student's t for whole degrees of freedom, by its finite sums of powers of the cosine.
_STUDENT = """v AS (SELECT *, n - 2 AS nu, atan(abs(t_stat) / sqrt(n - 2)) AS th FROM (SELECT *, CASE WHEN n > 2 AND abs(r) < 1 THEN r * sqrt((n - 2) / (1 - r * r)) END AS t_stat FROM c)),
s AS (SELECT *, list_sum(list_transform(range(CASE WHEN nu % 2 = 0 THEN nu // 2 ELSE greatest(nu // 2, 0) END), lambda j: pow(cos(th), 2 * j + nu % 2)
 * exp(CASE WHEN nu % 2 = 0 THEN lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1) ELSE lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5) END))) AS powers FROM v),
p AS (SELECT *, CASE WHEN n = 2 THEN 1 WHEN abs(r) >= 1 THEN 0 WHEN nu % 2 = 0 THEN 1 - sin(th) * powers
 ELSE 1 - 2 / pi() * (th + sin(th) * coalesce(powers, 0)) END AS p_value FROM s)"""


@query("g1_p_value", shape(with_(OBS, "c AS (SELECT lake, count(*) AS n, corr(swot_wse_anomaly, swot_wsa) AS r FROM obs GROUP BY lake)", _STUDENT) + """
FINAL SELECT *, coalesce(p_value < 0.05, FALSE) AS significant FROM p WHERE n >= 2""", "lake significant", "n", "r t_stat p_value"))
def p_value(spark, d):
    return rounded(cv.corr_test(obs(spark, d), "lake", "swot_wse_anomaly", "swot_wsa"))


@query("g2_fit_curve", shape(with_(OBS, fit_sql("fx", "SELECT * FROM obs", "swot_wse_anomaly", "swot_wsa", "lake"))
                             + "\nFINAL SELECT * FROM fx", "lake model_type", "n", "r rmse c0 c1 c2", 5))
def fit(spark, d):
    return rounded(cv.fit_curve(obs(spark, d), "lake", "swot_wse_anomaly", "swot_wsa"), 5)


@query("g3_swot_curve", shape(with_(OBS, LONG, SWOT_FIT) + "\nFINAL SELECT * FROM fa", "lake filter model_type", "n", "r rmse c0 c1 c2", 5))
def swot_curve(spark, d):
    return rounded(st.swot_curve(obs(spark, d), "lake", mask()), 5)


@query("g4_s2_curve", shape(with_(OBS, LONG, MATCH, STABLE_S2) + "\nFINAL SELECT * FROM fb", "lake filter model_type", "n", "r rmse c0 c1 c2", 5))
def s2_curve(spark, d):
    return rounded(st.s2_curve(st.matched_areas(obs(spark, d), "lake", "date", ORDER, mask()), "lake"), 5)


@query("g5_inverse_curve", shape(with_(OBS, LONG, MATCH, STABLE_INV) + "\nFINAL SELECT * FROM fi", "lake filter model_type", "n", "r rmse c0 c1 c2", 4))
def inverse(spark, d):
    return rounded(st.inverse_curve(st.matched_areas(obs(spark, d), "lake", "date", ORDER, mask()), "lake"), 4)


# What could be computed per lake, and the totals over all lakes.
_LABELS = ("swot_opt", "swot_filt", "s2_opt", "s2_filt")
_REPORT = ["c AS (SELECT 'swot_' || filter AS label, lake, n, r, model_type FROM fa UNION ALL SELECT 's2_' || filter, lake, n, r, model_type FROM fb)", _STUDENT,
           "inp AS (SELECT lake, count(*) AS n_rows, count(swot_wse) AS n_level, count(*) FILTER (WHERE adaptive_filter = 0) AS n_accepted, count(s2_wsa) AS n_image, count(storage) AS n_gauge FROM obs GROUP BY lake)",
           "wide AS (SELECT lake, " + ", ".join(f"max(model_type) FILTER (WHERE label = '{x}') AS {x}_model, bool_or(coalesce(p_value < 0.05, FALSE)) FILTER (WHERE label = '{x}') AS {x}_significant" for x in _LABELS) + " FROM p GROUP BY lake)",
           "rep AS (SELECT * FROM inp LEFT JOIN wide USING (lake))"]


def _report(spark, d):
    o = obs(spark, d)
    return src.processing_summary(o, st.all_curves(o, "lake", "date", ORDER, mask()), "lake")


@query("a8_processing_report", shape(with_(OBS, LONG, STABLE_SWOT, MATCH, STABLE_S2, *_REPORT) + "\nFINAL SELECT * FROM rep", "lake " + " ".join(f"{x}_model {x}_significant" for x in _LABELS),
                                     "n_rows n_level n_accepted n_image n_gauge"))
def processing_report(spark, d):
    return rounded(_report(spark, d))


@query("a8_summary_totals", shape(with_(OBS, LONG, SWOT_FIT, MATCH, S2_FIT, *_REPORT) + "\nFINAL SELECT count(*) AS n_lakes, count(*) FILTER (WHERE n_accepted > 0) AS n_with_accepted, "
                                  + ", ".join(f"count(*) FILTER (WHERE {x}_significant) AS n_{x}_significant" for x in _LABELS) + " FROM rep",
                                  "", "n_lakes n_with_accepted " + " ".join(f"n_{x}_significant" for x in _LABELS)))
def summary_totals(spark, d):
    return rounded(src.summary_totals(_report(spark, d)))


@query("g6_predict", shape(with_(OBS, fit_sql("fx", "SELECT * FROM obs", "swot_wse_anomaly", "swot_wsa", "lake")) + """
FINAL SELECT o.lake, count(*) AS n, avg(c0 + c1 * swot_wse_anomaly + c2 * swot_wse_anomaly * swot_wse_anomaly - swot_wsa) AS bias,
 stddev_pop(c0 + c1 * swot_wse_anomaly + c2 * swot_wse_anomaly * swot_wse_anomaly) AS spread FROM obs o JOIN fx ON o.lake = fx.lake GROUP BY o.lake""", "lake", "n", "bias spread", 5))
def predict(spark, d):
    o = obs(spark, d)
    rows = cv.predict_at(o, cv.fit_curve(o, "lake", "swot_wse_anomaly", "swot_wsa"), "lake", "swot_wse_anomaly")
    return rounded(rows.groupBy("lake").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("predicted") - F.col("swot_wsa")).alias("bias"),
                                            F.stddev_pop("predicted").alias("spread")), 5)


@query("g7_storage_above", shape(with_(OBS, """tr AS (SELECT lake, swot_wse_anomaly AS h, list_transform(range(100), lambda i: -24.5 + (h + 24.5) * i / 99.0) AS p FROM obs),
 ar AS (SELECT lake, h, p, list_transform(p, lambda x: 40 + 1.5 * x + 0.02 * x * x) AS a FROM tr)""") + """
FINAL SELECT lake, avg(CASE WHEN h <= -24.5 THEN 0 ELSE list_sum(list_transform(range(99), lambda i: (a[i + 1] + a[i + 2]) / 2 * (p[i + 2] - p[i + 1]))) * 1e6 / 1233.48 END) / 1e6 AS mean_macft
FROM ar GROUP BY lake""", "lake", "", "mean_macft", 7))
def above(spark, d):
    v = st.storage_above(F.col("swot_wse_anomaly"), F.lit(-24.5), F.lit(40.0), F.lit(1.5), F.lit(0.02))
    return rounded(obs(spark, d).groupBy("lake").agg((F.avg(v) / 1e6).alias("mean_macft")), 7)


@query("g8_g9_storage_static", shape(with_(OBS, LONG, "rf AS (SELECT lake, filter, min(swot_wse_anomaly) AS ref FROM mk GROUP BY lake, filter)",
    "ra AS (SELECT lake, arg_min(swot_p_ref_area, (o1, o2, o3, o4)) AS ref_area FROM obs WHERE swot_p_ref_area IS NOT NULL GROUP BY lake)") + """
FINAL SELECT mk.lake, mk.filter, max(ref) AS ref, max(ref_area) AS ref_area, avg(ref_area * (swot_wse_anomaly - ref) * 1e6 / 1233.48) / 1000 AS mean_kacft
FROM mk JOIN rf ON mk.lake = rf.lake AND mk.filter = rf.filter JOIN ra ON mk.lake = ra.lake GROUP BY mk.lake, mk.filter""", "lake filter", "", "ref ref_area mean_kacft", 4))
def static(spark, d):
    from hydroseries.operators.accuracy import explode_filters
    o = obs(spark, d)
    rows = (explode_filters(o, mask()).join(st.reference_levels(o, "lake", mask()), ["lake", "filter"]).join(st.reference_area(o, "lake", ORDER), "lake"))
    v = st.storage_static(F.col("swot_wse_anomaly"), F.col("ref"), F.col("ref_area"))
    return rounded(rows.groupBy("lake", "filter").agg(F.max("ref").alias("ref"), F.max("ref_area").alias("ref_area"), (F.avg(v) / 1000).alias("mean_kacft")), 4)


PAR = """rf AS (SELECT lake, filter, min(swot_wse_anomaly) AS ref FROM mk GROUP BY lake, filter),
ra AS (SELECT lake, arg_min(swot_p_ref_area, (o1, o2, o3, o4)) AS ref_area FROM obs WHERE swot_p_ref_area IS NOT NULL GROUP BY lake),
par AS (SELECT rf.lake, rf.filter, ref, ref_area, fa.c0 AS ac0, fa.c1 AS ac1, fa.c2 AS ac2, fb.c0 AS bc0, fb.c1 AS bc1, fb.c2 AS bc2, fi.c0 AS ic0, fi.c1 AS ic1, fi.c2 AS ic2
 FROM rf LEFT JOIN ra ON rf.lake = ra.lake LEFT JOIN fa ON rf.lake = fa.lake AND rf.filter = fa.filter LEFT JOIN fb ON rf.lake = fb.lake AND rf.filter = fb.filter
 LEFT JOIN fi ON rf.lake = fi.lake AND rf.filter = fi.filter)"""
_TAGS = "tg AS (" + " UNION ALL ".join(f"SELECT *, '{k}' AS filter, ({m}) AS accepted FROM obs" for k, m in MASK_SQL.items()) + ")"
_IMG = "s2_coverage > 99 AND ice = 0 AND s2_wsa IS NOT NULL"
_INV = "(ic0 + ic1 * {a} + ic2 * {a} * {a})"
DIS = f"""dis AS (SELECT tg.*, ref, ref_area, ac0, ac1, ac2, bc0, bc1, bc2, ic0, ic1, ic2,
 CASE WHEN accepted THEN {above_sql('swot_wse_anomaly', 'ref', 'ac')} END AS swot_dis, CASE WHEN accepted THEN {above_sql('swot_wse_anomaly', 'ref', 'bc')} END AS swots2_dis,
 CASE WHEN {_IMG} THEN {above_sql(_INV.format(a='s2_wsa'), 'ref', 'bc')} END AS s2_dis, CASE WHEN accepted THEN ref_area * (swot_wse_anomaly - ref) * 1e6 / 1233.48 END AS static_dis
 FROM tg LEFT JOIN par ON tg.lake = par.lake AND tg.filter = par.filter)"""
_FILL = (interp_sql("SELECT lake || '|' || filter AS lake, date, swot_wse_anomaly AS v, (o1, o2, o3, o4) AS o FROM mk WHERE ice = 0",
                    "SELECT lake || '|' || filter AS lake, date FROM tg WHERE ice = 0", out="lv") + ",\n"
         + interp_sql("SELECT lake, date, s2_wsa AS v, (o1, o2, o3, o4) AS o FROM obs WHERE s2_coverage > 99 AND ice = 0 AND s2_wsa IS NOT NULL",
                      "SELECT lake, date FROM obs WHERE ice = 0",
                      "AND (NOT coalesce(longest > 30, FALSE) OR least(date_diff('day', d0, date), date_diff('day', date, d1)) <= 30)", True, "arf"))
CON = f"""fr AS (SELECT lake, date, min((o1, o2, o3, o4)) AS o FROM obs GROUP BY lake, date),
jn AS (SELECT dis.*, CASE WHEN fr.o = (dis.o1, dis.o2, dis.o3, dis.o4) THEN lv.value END AS lf, CASE WHEN fr.o = (dis.o1, dis.o2, dis.o3, dis.o4) THEN arf.value END AS af
 FROM dis JOIN fr ON dis.lake = fr.lake AND dis.date = fr.date LEFT JOIN lv ON lv.lake = dis.lake || '|' || dis.filter AND lv.date = dis.date LEFT JOIN arf ON arf.lake = dis.lake AND arf.date = dis.date),
con AS (SELECT *, coalesce(swot_dis, CASE WHEN lf IS NOT NULL THEN {above_sql('lf', 'ref', 'ac')} END) AS swot_con, coalesce(swots2_dis, CASE WHEN lf IS NOT NULL THEN {above_sql('lf', 'ref', 'bc')} END) AS swots2_con,
 coalesce(s2_dis, CASE WHEN af IS NOT NULL THEN {above_sql(_INV.format(a='af'), 'ref', 'bc')} END, CASE WHEN lf IS NOT NULL THEN {above_sql('lf', 'ref', 'bc')} END) AS s2_con,
 coalesce(static_dis, CASE WHEN lf IS NOT NULL THEN ref_area * (lf - ref) * 1e6 / 1233.48 END) AS static_con FROM jn)"""
_M = ("swot", "swots2", "s2", "static")
MED = ("md2 AS (SELECT lake, filter, " + ", ".join(f"median({m}_dis) AS m_{m}" for m in _M) + " FROM con WHERE accepted GROUP BY lake, filter),\nfin AS (SELECT con.lake, con.filter, "
       + ", ".join(f"{m}_{k} - coalesce(m_{m}, 0) AS {m}_{k}" for m in _M for k in ("dis", "con")) + " FROM con LEFT JOIN md2 ON con.lake = md2.lake AND con.filter = md2.filter)")
ALL = (OBS, LONG, STABLE_SWOT, MATCH, STABLE_S2, STABLE_INV, PAR, _TAGS, DIS)


def _summary_sql(src: str, cols) -> str:
    return f"SELECT lake, filter, {', '.join(f'count({c}) AS n_{c}, avg({c}) / 1000 AS {c}' for c in cols)} FROM {src} GROUP BY lake, filter"


def _summary(df, cols):
    aggs = [a for c in cols for a in (F.count(c).alias(f"n_{c}"), (F.avg(c) / 1000).alias(c))]
    return rounded(df.groupBy("lake", "filter").agg(*aggs), 3)


_D, _DC = [f"{m}_dis" for m in _M], [f"{m}_{k}" for m in _M for k in ("dis", "con")]


@query("g10_storage_discrete", shape(with_(*ALL) + "\nFINAL " + _summary_sql("dis", _D), "lake filter", " ".join(f"n_{c}" for c in _D), " ".join(_D), 3))
def discrete(spark, d):
    o = obs(spark, d)
    par = st.parameters(o, "lake", "date", ORDER, mask())
    return _summary(st.storage_discrete(o, par, "lake", mask()), _D)


@query("g11_g12_storage_anomalies", shape(with_(*ALL, _FILL, CON, MED) + "\nFINAL " + _summary_sql("fin", _DC), "lake filter", " ".join(f"n_{c}" for c in _DC), " ".join(_DC), 3))
def anomalies(spark, d):
    return _summary(st.storage_long(obs(spark, d), "lake", "date", ORDER, mask()), _DC)


@query("g13_gauge_anomaly", shape(with_(OBS, LONG, "gm AS (SELECT lake, median(storage) FILTER (WHERE filter = 'opt') AS a, median(storage) FILTER (WHERE filter = 'filt') AS b FROM mk WHERE storage >= 0 AND stage >= 0 GROUP BY lake)") + """
FINAL SELECT obs.lake, count(*) AS n, avg((storage - a) / 1233.48) AS storage_anomaly_opt, avg((storage - b) / 1233.48) AS storage_anomaly_filt FROM obs JOIN gm ON obs.lake = gm.lake
WHERE storage >= 0 AND stage >= 0 GROUP BY obs.lake""", "lake", "n", "storage_anomaly_opt storage_anomaly_filt", 4))
def gauge(spark, d):
    g = st.gauge_anomaly(obs(spark, d), "lake", mask())
    return rounded(g.groupBy("lake").agg(F.count("storage_anomaly").alias("n"), F.avg("storage_anomaly_opt").alias("storage_anomaly_opt"),
                                         F.avg("storage_anomaly_filt").alias("storage_anomaly_filt")), 4)


@query("g14_variable_area", shape(with_(OBS, LONG, SWOT_FIT, MATCH, S2_FIT, *_REPORT) + """
FINAL SELECT lake, CASE WHEN coalesce(swot_opt_significant, FALSE) OR coalesce(s2_opt_significant, FALSE) THEN 0 ELSE 1 END AS variable_area FROM rep""", "lake", "variable_area"))
def variable(spark, d):
    o = obs(spark, d)
    return rounded(st.variable_area(o, st.all_curves(o, "lake", "date", ORDER, mask()), "lake"))


@query("g15_storage_variants")
def variants(spark, d):
    return rounded(st.storage_variants(obs(spark, d), "lake", "date", ORDER, mask()), 2)
