"""Tables behind the figures (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import EV, OBS, ev, obs, query, rounded, shape, with_
from hydroseries.functions.units import log10_clip
from hydroseries.operators import tables as tb

_IN = "v BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)"


@query("n1_box_stats", shape(with_(EV, "q AS (SELECT kind, quantile_cont(value, 0.25) AS q25, median(value) AS median, quantile_cont(value, 0.75) AS q75 FROM ev GROUP BY kind)") + f"""
FINAL SELECT kind, count(*) AS n, avg(v) AS mean, any_value(q25) AS q25, any_value(median) AS median, any_value(q75) AS q75, min(v) FILTER (WHERE {_IN}) AS whisker_low, max(v) FILTER (WHERE {_IN}) AS whisker_high,
 count(*) FILTER (WHERE NOT ({_IN})) AS n_outliers FROM (SELECT ev.kind, value AS v, q25, median, q75 FROM ev JOIN q ON ev.kind = q.kind) GROUP BY kind""", "kind", "n n_outliers", "mean q25 median q75 whisker_low whisker_high"))
def boxes(spark, d):
    return rounded(tb.box_stats(ev(spark, d), "kind", "value"))


@query("n2_ecdf", shape(with_(OBS) + "\nFINAL SELECT v AS value, (SELECT count(*) FROM obs WHERE swot_wse_anomaly <= v) / (SELECT count(*) FROM obs) * 100 AS cdf_pct FROM (SELECT DISTINCT swot_wse_anomaly AS v FROM obs)", "", "", "value cdf_pct"))
def ecdf(spark, d):
    return rounded(tb.ecdf(obs(spark, d), "swot_wse_anomaly"))


@query("n2_ecdf_area", shape(with_(OBS) + "\nFINAL SELECT flag, swot_wsa AS value, max(c) AS cdf_pct FROM (SELECT flag, swot_wsa, cume_dist() OVER (PARTITION BY flag ORDER BY swot_wsa) * 100 AS c FROM obs) GROUP BY flag, swot_wsa", "flag", "", "value cdf_pct"))
def ecdf_area(spark, d):
    return rounded(tb.ecdf(obs(spark, d), "swot_wsa", "flag"))


@query("n3_histogram", shape(with_(OBS) + """
FINAL SELECT flag, bin, n, 0.0 + bin * 2.0 AS bin_low, 0.0 + (bin + 1) * 2.0 AS bin_high, n / (sum(n) OVER (PARTITION BY flag) * 2.0) AS density FROM (
 SELECT flag, least(floor(swot_wsa / 2.0), 49) AS bin, count(*) AS n FROM obs WHERE swot_wsa BETWEEN 0 AND 100 GROUP BY flag, bin)""", "flag", "bin n", "bin_low bin_high density"))
def histogram(spark, d):
    return rounded(tb.histogram(obs(spark, d), "swot_wsa", 0, 100, 50, "flag", True))


@query("n4_binned_mean", shape(with_(OBS) + "\nFINAL SELECT floor(swot_wsa / 5) AS bin, avg(swot_wse_abs_error) AS mean, stddev_pop(swot_wse_abs_error) AS std, count(*) AS n FROM obs GROUP BY bin HAVING count(*) >= 10", "", "bin n", "mean std"))
def binned(spark, d):
    return rounded(tb.binned_mean(obs(spark, d), "swot_wsa", "swot_wse_abs_error", 5))


@query("n5_log10_clip", shape(with_(OBS) + "\nFINAL SELECT lake, avg(log10(greatest(10, least(80, swot_wsa)))) AS mean_log FROM obs GROUP BY lake", "lake", "", "mean_log"))
def log10(spark, d):
    return rounded(obs(spark, d).groupBy("lake").agg(F.avg(log10_clip("swot_wsa", 10, 80)).alias("mean_log")))
