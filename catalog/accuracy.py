"""Accuracy against truth (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import EV, OBS, ORDER, TRUTH, ev, obs, query, rounded, shape, truth_daily, with_
from catalog.timing import _D8, interp_sql
from hydroseries.functions import filters as f
from hydroseries.operators import accuracy as acc
from hydroseries.operators import interpolation as ip
from hydroseries.functions.units import with_pct_errors

SRC = "SELECT lake, date, swot_wse_anomaly AS v, (o1, o2, o3, o4) AS o FROM obs WHERE swot_wse_abs_error <= 0.02 AND ice = 0"
TGT = "SELECT lake, date FROM obs WHERE ice = 0 AND abs(stage_anomaly) <= 20"
DAILY = interp_sql(SRC, TGT) + """,
de AS (SELECT lake, date, value - s AS e, s FROM interp JOIN (SELECT lake, date, stage_anomaly AS s FROM obs WHERE ice = 0 AND abs(stage_anomaly) <= 20) USING (lake, date))"""
MASK = "swot_wse_abs_error <= 0.02"


@query("f1_nse_squares", shape(with_(OBS, interp_sql(SRC, "SELECT lake, date FROM obs WHERE ice = 0"), """syn AS (SELECT lake, count(*) AS n, sum((stage_anomaly - swot_wse_anomaly) ** 2) AS sq,
 var_pop(stage_anomaly) * count(*) AS tot FROM obs WHERE swot_wse_abs_error <= 0.02 AND ice = 0 GROUP BY lake)""",
    "dl AS (SELECT lake, sum((value - stage_anomaly) ** 2) AS sq, var_pop(stage_anomaly) * count(*) AS tot FROM interp JOIN (SELECT lake, date, stage_anomaly FROM obs WHERE ice = 0) USING (lake, date) GROUP BY lake)",
    "al AS (SELECT lake, count(*) FILTER (WHERE swot_wse_abs_error <= 0.02) AS n_filtered FROM obs GROUP BY lake)") + """
FINAL SELECT al.lake, n_filtered, coalesce(1 - dl.sq / dl.tot, -999) AS nse_daily, coalesce(1 - syn.sq / syn.tot, -999) AS nse_synoptic
FROM al LEFT JOIN syn USING (lake) LEFT JOIN dl USING (lake)""", "lake", "n_filtered", "nse_daily nse_synoptic"))
def nse_ss(spark, d):
    return rounded(acc.nse_ss(obs(spark, d), "lake", "date", "swot_wse_anomaly", "stage_anomaly", "stage_anomaly", F.expr(MASK), "ice", ORDER))


_VAR = f"""sv AS (SELECT lake, count(*) FILTER (WHERE {MASK}) AS n_obs, var_samp(stage_anomaly) FILTER (WHERE ice = 0 AND abs(stage_anomaly) <= 20) AS sa,
 var_samp(stage_anomaly) FILTER (WHERE ice = 0 AND {MASK} AND abs(stage_anomaly) <= 20) AS ss, var_samp(swot_wse_error) FILTER (WHERE ice = 0 AND {MASK}) AS es,
 sqrt(avg(swot_wse_error ** 2) FILTER (WHERE ice = 0 AND {MASK})) AS rmse_sel FROM obs GROUP BY lake),
dv AS (SELECT lake, var_samp(e) AS ea, sqrt(avg(e * e)) AS rmse_all FROM de GROUP BY lake)"""
_VAR_ARGS = ("date", "swot_wse_anomaly", "swot_wse_error", "stage_anomaly", "stage_anomaly")


@query("f2_nse_variance", shape(with_(OBS, DAILY, _VAR) + """
FINAL SELECT sv.lake, 1 - ea / sa AS nse_all, 1 - es / ss AS nse_sel, rmse_all, rmse_sel, n_obs FROM sv LEFT JOIN dv USING (lake)""", "lake", "n_obs", "nse_all nse_sel rmse_all rmse_sel"))
def nse_var(spark, d):
    return rounded(acc.nse_var(obs(spark, d), "lake", *_VAR_ARGS, F.expr(MASK), "ice", limit=20, order=ORDER))


@query("f4_snr", shape(with_(OBS, DAILY, _VAR) + """
FINAL SELECT sv.lake, sa / ea AS snr_all, sa / es AS snr_sel, sa AS signal_all, ss AS signal_sel, ea AS error_all, es AS error_sel, rmse_all, rmse_sel, n_obs
FROM sv LEFT JOIN dv USING (lake)""", "lake", "n_obs", "snr_all snr_sel signal_all signal_sel error_all error_sel rmse_all rmse_sel", 4))
def snr(spark, d):
    return rounded(acc.snr(obs(spark, d), "lake", *_VAR_ARGS, F.expr(MASK), "ice", limit=20, order=ORDER), 4)


_PSRC = "SELECT lake, date, swot_wsa AS v, (o1, o2, o3, o4) AS o FROM obs WHERE abs((swot_wsa - wsa) / wsa * 100) <= 4 AND ice = 0"
_PCT = interp_sql(_PSRC, "SELECT lake, date FROM obs WHERE ice = 0 AND abs(stage_anomaly) <= 20") + """,
pe AS (SELECT lake, (value - w) / w * 100 AS e FROM interp JOIN (SELECT lake, date, wsa AS w FROM obs WHERE ice = 0 AND abs(stage_anomaly) <= 20) USING (lake, date)),
pv AS (SELECT lake, var_samp(e) AS ea, sqrt(avg(e * e)) AS rmse_all FROM pe GROUP BY lake),
ps AS (SELECT lake, count(*) FILTER (WHERE k) AS n_obs, var_samp(wsa) FILTER (WHERE ice = 0 AND abs(stage_anomaly) <= 20) / (avg(wsa) FILTER (WHERE ice = 0 AND abs(stage_anomaly) <= 20)) ** 2 * 1e4 AS sa,
 var_samp(wsa) FILTER (WHERE ice = 0 AND k) / (avg(wsa) FILTER (WHERE ice = 0 AND k)) ** 2 * 1e4 AS ss, var_samp(p) FILTER (WHERE ice = 0 AND k) AS es, sqrt(avg(p * p) FILTER (WHERE ice = 0 AND k)) AS rmse_sel
 FROM (SELECT *, (swot_wsa - wsa) / wsa * 100 AS p, abs((swot_wsa - wsa) / wsa * 100) <= 4 AS k FROM obs) GROUP BY lake)"""


def _pct(spark, d):
    rows = with_pct_errors(obs(spark, d))
    return (rows, "lake", "date", "swot_wsa", "wsa_percentage_error", "wsa", "wsa", F.col("wsa_abs_percentage_error") <= 4)


@query("f3_nse_variance_area", shape(with_(OBS, _PCT) + "\nFINAL SELECT ps.lake, 1 - ea / sa AS nse_all, 1 - es / ss AS nse_sel, rmse_all, rmse_sel, n_obs FROM ps LEFT JOIN pv USING (lake)",
                                     "lake", "n_obs", "nse_all nse_sel rmse_all rmse_sel", 4))
def nse_area(spark, d):
    return rounded(acc.nse_var(*_pct(spark, d), ice="ice", percent=True, limit=20, order=ORDER, limit_on="stage_anomaly"), 4)


@query("f5_snr_area", shape(with_(OBS, _PCT) + """
FINAL SELECT ps.lake, sa / ea AS snr_all, sa / es AS snr_sel, sa AS signal_all, ss AS signal_sel, ea AS error_all, es AS error_sel, rmse_all, rmse_sel, n_obs FROM ps LEFT JOIN pv USING (lake)""",
    "lake", "n_obs", "snr_all snr_sel signal_all signal_sel error_all error_sel rmse_all rmse_sel", 3))
def snr_area(spark, d):
    return rounded(acc.snr(*_pct(spark, d), ice="ice", percent=True, limit=20, order=ORDER, limit_on="stage_anomaly"), 3)


@query("f6_summarize", shape(with_(OBS, "u AS (SELECT 'swot_wsa' AS metric, swot_wsa AS v FROM obs UNION ALL SELECT 'swot_wse_anomaly', swot_wse_anomaly FROM obs UNION ALL SELECT 's2_wsa', s2_wsa FROM obs)") + """
FINAL SELECT metric, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, quantile_cont(v, 0.25) AS q25, median(v) AS median, quantile_cont(v, 0.75) AS q75 FROM u GROUP BY metric""",
    "metric", "n", "mean std min max q25 median q75"))
def summarize(spark, d):
    return rounded(acc.summarize(obs(spark, d), ["swot_wsa", "swot_wse_anomaly", "s2_wsa"], ddof=1))


_SETS = "st AS (SELECT 'Full' AS subset, * FROM obs UNION ALL SELECT 'Target', * FROM obs WHERE swot_wse_abs_error <= 0.02)"
_SGAP = """sg AS (SELECT subset, date_diff('day', date, nd) AS g FROM (SELECT subset, lake, date, lead(date) OVER (PARTITION BY subset, lake ORDER BY date) AS nd FROM (SELECT DISTINCT subset, lake, date FROM st)) WHERE nd IS NOT NULL),
sgs AS (SELECT subset, avg(g) AS mean_gap, median(g) AS median_gap FROM sg GROUP BY subset)"""
_TAB = """tab AS (SELECT subset, count(*) AS n, avg(swot_wse_error) AS mean_error, avg(swot_wse_abs_error) AS mae, sqrt(avg(swot_wse_error ** 2)) AS rmse, stddev_samp(swot_wse_error) AS std_signed,
 stddev_samp(swot_wse_abs_error) AS std_abs, quantile_cont(swot_wse_abs_error, 0.68) AS p68, count(*) / (SELECT count(*) FROM obs) * 100 AS retention_pct FROM st GROUP BY subset)"""
_NUM = "mean_error mae rmse std_signed std_abs p68 retention_pct mean_gap median_gap"


@query("f7_error_table", shape(with_(OBS, _SETS, _SGAP, _TAB) + "\nFINAL SELECT * FROM tab JOIN sgs USING (subset)", "subset", "n", _NUM))
def error_table(spark, d):
    return rounded(acc.error_table(obs(spark, d), {"Full": F.lit(True), "Target": F.expr(MASK)}, "swot_wse_error", "swot_wse_abs_error", "lake", "date"))


@query("f8_accuracy_report", shape(with_(OBS, _SETS, _SGAP, _TAB, DAILY, """rs AS (SELECT subset, sum(dn) / sum(n) AS days_per_obs FROM (SELECT t.subset, a.lake, a.dn, count(*) AS n FROM
 (SELECT lake, count(*) AS dn FROM obs WHERE ice = 0 GROUP BY lake) a JOIN (SELECT * FROM st WHERE ice = 0) t ON t.lake = a.lake GROUP BY ALL HAVING count(*) >= 3) GROUP BY subset)""") + """
FINAL SELECT tab.*, mean_gap, median_gap, days_per_obs FROM tab JOIN sgs USING (subset) JOIN rs USING (subset) UNION ALL
SELECT 'Target-Daily', count(*), avg(e), avg(abs(e)), sqrt(avg(e * e)), stddev_samp(e), stddev_samp(abs(e)), quantile_cont(abs(e), 0.68), count(*) / (SELECT count(*) FROM obs) * 100, NULL, NULL,
 (SELECT days_per_obs FROM rs WHERE subset = 'Target') FROM de""", "subset", "n", _NUM + " days_per_obs"))
def report(spark, d):
    return rounded(acc.accuracy_report(obs(spark, d), "lake", "date", "swot_wse_anomaly", "swot_wse_error", "swot_wse_abs_error", "stage_anomaly", 0.02, "ice", limit=20, order=ORDER))


@query("f9_threshold_for_std", shape(with_(OBS, "x AS (SELECT abs(swot_wsa - wsa) AS a, swot_wsa - wsa AS e FROM obs)",
    "c AS (SELECT a, count(*) OVER w AS n, stddev_samp(e) OVER w AS s FROM x WINDOW w AS (ORDER BY a RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))") + """
FINAL SELECT a AS threshold, s AS achieved_std, n AS n_obs, abs(s - 1.0) < 0.005 AS success FROM c WHERE n >= 50 AND a BETWEEN 0.01 AND 20 ORDER BY abs(s - 1.0), a LIMIT 1""",
    "success", "n_obs", "threshold achieved_std", 5))
def threshold(spark, d):
    rows = obs(spark, d).withColumn("e", F.col("swot_wsa") - F.col("wsa")).withColumn("a", F.abs("e"))
    return rounded(acc.threshold_for_std(rows, "e", "a", 1.0, 0.01, 20), 5)


@query("f10_classify", shape(with_(OBS, "c AS (SELECT lake, count(*) FILTER (WHERE adaptive_filter = 0) AS n_kept, count(*) FILTER (WHERE adaptive_filter = 0 AND swot_wse_abs_error < 0.03) AS n_good_kept, count(*) FILTER (WHERE swot_wse_abs_error < 0.03) AS n_good FROM obs GROUP BY lake)") + """
FINAL SELECT *, n_good_kept / n_kept AS precision, n_good_kept / n_good AS recall, 2 * (n_good_kept / n_kept) * (n_good_kept / n_good) / (n_good_kept / n_kept + n_good_kept / n_good) AS f1 FROM c""",
    "lake", "n_kept n_good_kept n_good", "precision recall f1"))
def classify(spark, d):
    return rounded(acc.classify(obs(spark, d), f.adaptive(), F.col("swot_wse_abs_error") < 0.03, "lake"))


@query("f11_error_stats", shape(with_(OBS) + """
FINAL SELECT flag, count(*) AS n, avg(swot_wse_abs_error) AS mae, sqrt(avg(swot_wse_abs_error ** 2)) AS rmse, sqrt(avg(swot_wse_abs_error ** 2)) / (max(swot_wse_anomaly) - min(swot_wse_anomaly)) AS nrmse,
 stddev_samp(swot_wse_abs_error) AS std_abs, avg(swot_wse_error) AS mean_signed, stddev_samp(swot_wse_error) AS std_signed, median(swot_wse_abs_error) AS median_abs, quantile_cont(swot_wse_abs_error, 0.68) AS p68
FROM obs GROUP BY flag""", "flag", "n", "mae rmse nrmse std_abs mean_signed std_signed median_abs p68"))
def error_stats(spark, d):
    return rounded(acc.error_stats(obs(spark, d), "swot_wse_abs_error", "swot_wse_error", "swot_wse_anomaly", "flag"))


_LAKE = """CAST(count(*) AS BIGINT) AS n_obs, avg(swot_wse_abs_error) AS mae, sqrt(avg(swot_wse_abs_error ** 2)) AS rmse, quantile_cont(swot_wse_abs_error, 0.68) AS p68, stddev_pop(swot_wse_error) AS signed_std,
 CASE WHEN count(*) >= 3 THEN corr(swot_wse_anomaly, stage_anomaly) ** 2 END AS r2, count(*) FILTER (WHERE swot_wse_abs_error < 0.03) / count(*) AS precision,
 count(*) FILTER (WHERE swot_wse_abs_error < 0.03) / any_value(g) AS recall, (date_diff('day', min(date), max(date)) + 1) / count(*) AS days_per_obs"""
_GOOD = "gd AS (SELECT lake, count(*) FILTER (WHERE swot_wse_abs_error < 0.03) AS g FROM obs GROUP BY lake)"


@query("f12_per_lake_stats", shape(with_(OBS, _GOOD) + f"\nFINAL SELECT lake, {_LAKE} FROM obs JOIN gd USING (lake) WHERE adaptive_filter = 0 GROUP BY lake HAVING count(*) >= 2",
                                   "lake", "n_obs", "mae rmse p68 signed_std r2 precision recall days_per_obs"))
def per_lake(spark, d):
    return rounded(acc.per_lake_stats(obs(spark, d), "lake", "date", "swot_wse_abs_error", "swot_wse_error", "swot_wse_anomaly", "stage_anomaly",
                                      F.col("swot_wse_abs_error") < 0.03, f.adaptive()))


_FILTERS = {"simple": "swot_xovr_cal_q < 2 AND swot_wse_u < 0.1 AND swot_wse_std < 0.4 AND swot_wse_anomaly > -50 AND swot_wse_anomaly < 50 AND swot_wse > 0",
            "adaptive": "adaptive_filter = 0", "quality": "swot_quality_f = 0", "partial": "swot_partial_f = 0", "all": "swot_wse IS NOT NULL"}
_FK = "fk AS (" + " UNION ALL ".join(f"SELECT '{k}' AS filter, * FROM obs WHERE {m}" for k, m in _FILTERS.items()) + ")"
_FIG = ["mae", "rmse", "p68", "days_per_obs", "precision", "recall", "r2"]
_F13 = [OBS, _GOOD, _FK, f"lk AS (SELECT filter, lake, {_LAKE} FROM fk JOIN gd USING (lake) GROUP BY filter, lake HAVING count(*) >= 2)",
        "lw AS (SELECT filter, " + ", ".join(f"avg({m}) AS lake_{m}_mean, median({m}) AS lake_{m}_median, stddev_pop({m}) AS lake_{m}_std" for m in _FIG) + " FROM lk GROUP BY filter)",
        """pl AS (SELECT filter, count(*) AS n_kept, count(*) FILTER (WHERE swot_wse_abs_error < 0.03) AS n_good_kept, avg(swot_wse_abs_error) AS mae, sqrt(avg(swot_wse_abs_error ** 2)) AS rmse,
 stddev_samp(swot_wse_abs_error) AS error_std, avg(swot_wse_error) AS signed_mean, stddev_samp(swot_wse_error) AS signed_std, count(DISTINCT lake) AS n_keys_kept, median(swot_wse_abs_error) AS error_median,
 quantile_cont(swot_wse_abs_error, 0.68) AS p68 FROM fk GROUP BY filter)""",
        "tt AS (SELECT count(*) FILTER (WHERE swot_wse_abs_error < 0.03) AS n_good, max(swot_wse_anomaly) - min(swot_wse_anomaly) AS rg, count(DISTINCT lake) AS n_keys_attempted FROM obs)",
        "sp AS (SELECT filter, sum(s) / sum(n) AS days_per_obs FROM (SELECT filter, lake, date_diff('day', min(date), max(date)) + 1 AS s, count(*) AS n FROM fk GROUP BY filter, lake HAVING count(*) >= 2) GROUP BY filter)",
        interp_sql("SELECT filter || '|' || lake AS lake, date, swot_wse_anomaly AS v, (o1, o2, o3, o4) AS o FROM fk WHERE ice = 0", "SELECT x.filter || '|' || lake AS lake, date FROM obs CROSS JOIN (SELECT DISTINCT filter FROM fk) x WHERE ice = 0"),
        """tk AS (SELECT x.filter, x.filter || '|' || lake AS lake, date, stage_anomaly AS s FROM obs CROSS JOIN (SELECT DISTINCT filter FROM fk) x WHERE ice = 0),
 nd AS (SELECT filter, lake, 1 - sum((value - s) ** 2) / (var_pop(s) * count(*)) AS v FROM interp JOIN tk USING (lake, date) GROUP BY filter, lake),
 ns AS (SELECT filter, lake, 1 - sum(swot_wse_error ** 2) / (var_pop(stage_anomaly) * count(*)) AS v FROM (SELECT *, swot_wse_anomaly - stage_anomaly AS e2 FROM fk WHERE ice = 0) GROUP BY filter, lake HAVING count(*) >= 3),
 nw AS (SELECT filter, min(v) AS nse_daily_min, avg(v) AS nse_daily_mean, median(v) AS nse_daily_median, max(v) AS nse_daily_max FROM nd WHERE v > -990 GROUP BY filter),
 nv AS (SELECT filter, min(v) AS nse_synoptic_min, avg(v) AS nse_synoptic_mean, median(v) AS nse_synoptic_median, max(v) AS nse_synoptic_max FROM ns WHERE v > -990 GROUP BY filter)"""]
_F13_INT = "n_kept n_good_kept n_bad_kept n_good n_keys_kept n_keys_attempted"
_F13_NUM = ("mae rmse error_std signed_mean signed_std error_median p68 precision recall f1 nrmse key_success_pct days_per_obs "
            + " ".join(f"lake_{m}_{s}" for m in _FIG for s in ("mean", "median", "std")) + " "
            + " ".join(f"{a}_{s}" for a in ("nse_daily", "nse_synoptic") for s in ("min", "mean", "median", "max")))


def _compare(spark, d):
    return acc.compare_filters(obs(spark, d), {k: F.expr(m) for k, m in _FILTERS.items()}, "lake", "date", F.col("swot_wse_abs_error") < 0.03, ice="ice", order=ORDER)


@query("f13_compare_filters", shape(with_(*_F13) + """
FINAL SELECT *, n_kept - n_good_kept AS n_bad_kept, n_good_kept / n_kept AS precision, n_good_kept / n_good AS recall, 2 * (n_good_kept / n_kept) * (n_good_kept / n_good) / (n_good_kept / n_kept + n_good_kept / n_good) AS f1,
 rmse / rg AS nrmse, n_keys_kept / n_keys_attempted * 100 AS key_success_pct FROM pl, tt JOIN lw ON lw.filter = pl.filter JOIN sp ON sp.filter = pl.filter JOIN nw ON nw.filter = pl.filter JOIN nv ON nv.filter = pl.filter""".replace("SELECT *,", "SELECT pl.*, tt.*, lw.* EXCLUDE (filter), days_per_obs, nw.* EXCLUDE (filter), nv.* EXCLUDE (filter),"),
    "filter", _F13_INT, _F13_NUM, 5))
def compare(spark, d):
    return rounded(_compare(spark, d), 5)


@query("f14_best_filter", shape(with_(OBS, _FK, "m AS (SELECT filter, avg(swot_wse_abs_error) AS mae, sqrt(avg(swot_wse_abs_error ** 2)) AS rmse, count(*) AS n_kept FROM fk GROUP BY filter)") + """
FINAL SELECT 'mae' AS metric, arg_min(filter, mae) AS best FROM m UNION ALL SELECT 'rmse', arg_min(filter, rmse) FROM m UNION ALL SELECT 'n_kept', arg_max(filter, n_kept) FROM m""", "metric best"))
def best(spark, d):
    rows = acc.explode_filters(obs(spark, d), {k: F.expr(m) for k, m in _FILTERS.items()})
    table = rows.groupBy("filter").agg(F.avg("swot_wse_abs_error").alias("mae"), F.sqrt(F.avg(F.pow("swot_wse_abs_error", F.lit(2)))).alias("rmse"), F.count(F.lit(1)).alias("n_kept"))
    return rounded(acc.best(table, ["n_kept"], ["mae", "rmse"]))


@query("f15_basic_metrics", shape(with_(OBS) + """
FINAL SELECT lake, count(*) AS n, avg(abs(swot_wse_error)) AS mae, sqrt(avg(swot_wse_error ** 2)) AS rmse, stddev_pop(swot_wse_error) AS std_error, quantile_cont(abs(swot_wse_error), 0.68) AS p68 FROM obs GROUP BY lake""",
    "lake", "n", "mae rmse std_error p68"))
def basic(spark, d):
    return rounded(acc.basic_metrics(obs(spark, d), "swot_wse_error", "lake"))


_U = """u AS (SELECT 'optimal' AS subset, swot_wse_error AS error FROM obs WHERE swot_wse_abs_error <= 0.02 UNION ALL SELECT 'filtered', swot_wse_error FROM obs WHERE adaptive_filter = 0
 UNION ALL SELECT 'area', (swot_wsa - wsa) / wsa * 100 FROM obs WHERE swot_partial_f = 0 AND wsa > 0 UNION ALL SELECT 'static', (swot_p_ref_area - wsa) / wsa * 100 FROM obs WHERE wsa > 0 AND swot_p_ref_area IS NOT NULL
 UNION ALL SELECT 'optimal_daily', value - s FROM interp JOIN (SELECT lake, date, stage_anomaly AS s FROM obs WHERE ice = 0 AND abs(stage_anomaly) <= 20) USING (lake, date)),
uq AS (SELECT subset, quantile_cont(abs(error), 0.99) AS k FROM u GROUP BY subset),
ua AS (SELECT * FROM u UNION ALL SELECT subset || '_no_outliers', error FROM u JOIN uq USING (subset) WHERE abs(error) <= k)"""


@query("f16_input_uncertainties", shape(with_(OBS, interp_sql(SRC, TGT, "AND date_diff('day', d0, date) <= 60 AND date_diff('day', date, d1) <= 60", True), _U) + """
FINAL SELECT subset, count(*) AS n, avg(abs(error)) AS mae, sqrt(avg(error * error)) AS rmse, stddev_pop(error) AS std_error, quantile_cont(abs(error), 0.68) AS p68 FROM ua GROUP BY subset""",
    "subset", "n", "mae rmse std_error p68", 5))
def inputs(spark, d):
    o = obs(spark, d)
    rows = with_pct_errors(with_pct_errors(o), "swot_p_ref_area", "wsa", "st")
    daily = ip.daily_errors(o, "lake", "date", "swot_wse_anomaly", "stage_anomaly", F.expr(MASK), ice="ice", max_gap=60, limit=20, order=ORDER)
    specs = {"optimal": ("swot_wse_error", F.expr(MASK)), "filtered": ("swot_wse_error", f.adaptive()),
             "area": ("wsa_percentage_error", f.no_partial()), "static": ("st_percentage_error", F.lit(True))}
    return rounded(acc.input_uncertainties(rows, "lake", "date", specs, {"optimal_daily": daily}), 5)


@query("f17_rmse", shape(with_(OBS) + "\nFINAL SELECT lake, sqrt(avg((s2_wsa - wsa) ** 2)) AS rmse FROM obs WHERE s2_wsa IS NOT NULL GROUP BY lake", "lake", "", "rmse"))
def rmse(spark, d):
    return rounded(acc.rmse(obs(spark, d), "s2_wsa", "wsa", "lake"))


@query("f18_pearson", shape(with_(OBS) + "\nFINAL SELECT lake, count(*) AS n, corr(s2_wsa, swot_wse) AS coefficient FROM obs WHERE s2_wsa IS NOT NULL GROUP BY lake", "lake", "n", "coefficient"))
def pearson(spark, d):
    return rounded(acc.correlation(obs(spark, d), "s2_wsa", "swot_wse", "pearson", "lake"))


@query("f18_spearman", shape(with_(OBS, """r AS (SELECT lake, rank() OVER (PARTITION BY lake ORDER BY s2_wsa) + (count(*) OVER (PARTITION BY lake, s2_wsa) - 1) / 2 AS a,
 rank() OVER (PARTITION BY lake ORDER BY swot_wse) + (count(*) OVER (PARTITION BY lake, swot_wse) - 1) / 2 AS b FROM obs WHERE s2_wsa IS NOT NULL)""") + """
FINAL SELECT lake, count(*) AS n, corr(a, b) AS coefficient FROM r GROUP BY lake""", "lake", "n", "coefficient"))
def spearman(spark, d):
    return rounded(acc.correlation(obs(spark, d), "s2_wsa", "swot_wse", "spearman", "lake"))


def _tagged(spark, d):
    e = ev(spark, d)
    truth = truth_daily(e).select("lake", "date", F.col("truth").alias("value"))
    return ip.sampling_error(truth, e.where("kind = 'click'"), "lake", "date", "value", max_error=100).withColumn("label", F.lit("click"))


@query("f19_error_by_distance", shape(_D8 + """
FINAL SELECT 'click' AS label, distance AS day_bin, avg(abs_error) AS mean_error, stddev_pop(abs_error) AS std_error, count(*) AS n FROM serr WHERE distance > 0 AND distance <= 50 AND abs_error <= 100 GROUP BY distance""",
    "label", "day_bin n", "mean_error std_error"))
def by_distance(spark, d):
    return rounded(acc.error_by_distance(_tagged(spark, d), "label"))


@query("f19_error_overall", shape(_D8 + """
FINAL SELECT 'click' AS label, count(*) AS n, avg(abs_error) AS mean_error, stddev_pop(abs_error) AS std_error, median(abs_error) AS median_error, quantile_cont(abs_error, 0.95) AS p95_error FROM serr
WHERE distance > 0 AND distance <= 50 AND abs_error <= 100""", "label", "n", "mean_error std_error median_error p95_error"))
def overall(spark, d):
    return rounded(acc.error_overall(_tagged(spark, d), "label"))


@query("f19_error_ratio", shape(with_(OBS, "sd AS (SELECT flag, stddev_pop(swot_wse_abs_error) AS s FROM obs GROUP BY flag)", "ra AS (SELECT (SELECT s FROM sd WHERE flag = 'N') / (SELECT s FROM sd WHERE flag = 'A') AS ratio)") + """
FINAL SELECT 'A' AS base, 'N' AS compared, ratio, (ratio - 1) * 100 AS percent_higher FROM ra""", "base compared", "", "ratio percent_higher"))
def error_ratio(spark, d):
    return rounded(acc.error_ratio(acc.error_overall(obs(spark, d), "flag", "swot_wse_abs_error"), "flag", "A", "N"))
