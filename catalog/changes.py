"""Change detection over time scales (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import EV, OBS, ev, obs, query, rounded, shape, with_
from hydroseries.functions.keyed import cut_lineage
from hydroseries.operators import changes as ch
from hydroseries.operators import tables as tb

N = 100
_LEN = ", ".join(f"({x})" for x in ch.LENGTHS)
WIN = f"""sp AS (SELECT lake, min(date) AS f, date_diff('day', min(date), max(date)) AS span FROM obs GROUP BY lake),
win AS (SELECT lake, length, sample, f, (7919 * sample + 104729 * length + 1299709 * lake + 42) % (span - length + 1) AS off FROM sp CROSS JOIN (VALUES {_LEN}) v(length)
 CROSS JOIN range({N}) r(sample) WHERE span - length > 0)"""
RNG = """ob2 AS (SELECT lake, date, swot_wsa AS tr, stage_anomaly AS lv, CASE WHEN flag = 'N' THEN swot_wse_anomaly END AS sl, CASE WHEN flag = 'N' THEN swot_area_total END AS ss FROM obs),
wr AS (SELECT w.lake, length, sample, any_value(off) AS "offset", CASE WHEN count(tr) >= 2 THEN max(tr) - min(tr) ELSE 0 END AS storage_range, CASE WHEN count(lv) >= 2 THEN max(lv) - min(lv) ELSE 0 END AS wse_range,
 count(ss) AS n_seen, CASE WHEN count(ss) >= 2 THEN max(sl) - min(sl) ELSE 0 END AS seen_wse_range, CASE WHEN count(ss) >= 2 THEN max(ss) - min(ss) ELSE 0 END AS seen_storage_range
 FROM win w JOIN ob2 o ON o.lake = w.lake AND o.date >= w.f + CAST(off AS INT) AND o.date < w.f + CAST(off + length AS INT) GROUP BY w.lake, length, sample)"""


def _rows(spark, d):
    return obs(spark, d).withColumns({"sl": F.when(F.col("flag") == "N", F.col("swot_wse_anomaly")), "ss": F.when(F.col("flag") == "N", F.col("swot_area_total"))})


def _ranges(spark, d):
    return ch.key_ranges(_rows(spark, d), "lake", "date", "swot_wsa", "stage_anomaly", "sl", "ss", n=N, number=F.col("lake"))


@query("h1_sample_windows", shape(with_(OBS, WIN) + '\nFINAL SELECT lake, length, sample, off AS "offset", f AS first_day FROM win', "lake first_day", 'length sample "offset"'))
def sample(spark, d):
    return rounded(ch.sample_windows(obs(spark, d), "lake", "date", n=N, number=F.col("lake")))


@query("h2_window_ranges", shape(with_(OBS, WIN, RNG) + "\nFINAL SELECT * FROM wr", "lake", 'length sample "offset" n_seen', "storage_range wse_range seen_wse_range seen_storage_range"))
def ranges(spark, d):
    return rounded(ch.single_ranges(_ranges(spark, d), "lake"))


_KINDS = "value, value * 2 AS height, CASE WHEN sensor THEN value * 2 END AS sl, CASE WHEN sensor THEN value END AS ss"


@query("h2_all_windows", shape(with_(EV, f"wv AS (SELECT lake, date, {_KINDS} FROM ev)", "sp AS (SELECT lake, min(date) AS f, date_diff('day', min(date), max(date)) AS span FROM wv GROUP BY lake)",
    'st AS (SELECT lake, f, length, unnest(range(0, span - length + 1)) AS "offset" FROM sp, (VALUES (3), (7), (14), (21)) l(length) WHERE span > length)',
    """jn AS (SELECT st.lake, length, "offset", max(value) - min(value) AS a, count(value) AS na, max(height) - min(height) AS b, count(height) AS nb, count(ss) AS n_seen, max(sl) - min(sl) AS c, max(ss) - min(ss) AS d
 FROM st JOIN wv ON wv.lake = st.lake AND date_diff('day', f, date) BETWEEN "offset" AND "offset" + length - 1 GROUP BY ALL)""") + """
FINAL SELECT lake, length, "offset" AS sample, "offset", CASE WHEN na >= 2 THEN a ELSE 0 END AS storage_range, CASE WHEN nb >= 2 THEN b ELSE 0 END AS wse_range, n_seen,
 CASE WHEN n_seen >= 2 THEN c ELSE 0 END AS seen_wse_range, CASE WHEN n_seen >= 2 THEN d ELSE 0 END AS seen_storage_range FROM jn""", "lake", 'length sample "offset" n_seen',
    "storage_range wse_range seen_wse_range seen_storage_range"))
def all_ranges(spark, d):
    rows = ev(spark, d).selectExpr("lake", "date", *_KINDS.split(", "))
    return rounded(ch.all_window_ranges(rows, "lake", "date", "value", "height", "sl", "ss", (3, 7, 14, 21)))


_PCT = """wp AS (SELECT *, CASE WHEN storage_range > 0 THEN seen_storage_range / storage_range * 100 ELSE 0 END AS percent_storage, CASE WHEN wse_range > 0 THEN seen_wse_range / wse_range * 100 ELSE 0 END AS percent_wse,
 CASE WHEN n_seen >= 2 AND storage_range > 0 THEN seen_storage_range / storage_range * 100 END AS percent_storage_v2 FROM wr)"""
_FIVE = ("storage_range", "wse_range", "n_seen", "seen_wse_range", "seen_storage_range")
_THREE = ("percent_storage", "percent_wse", "percent_storage_v2")
_TOT = ("storage_range", "seen_storage_range", "wse_range", "seen_wse_range")
_STATS = ("rs AS (SELECT lake, length, count(*) AS n_windows, count(percent_storage_v2) AS n_valid_percent, "
          + ", ".join(f"avg({c}) AS {c}_mean, median({c}) AS {c}_median, stddev_pop({c}) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max" for c in _FIVE)
          + ", avg(CAST(n_seen >= 2 AS INT)) * 100 AS pct_windows_2plus, avg(CAST(n_seen = 0 AS INT)) * 100 AS pct_windows_0, avg(CAST(n_seen = 1 AS INT)) * 100 AS pct_windows_1, "
          + ", ".join(f"avg({c}) AS {c}_mean, median({c}) AS {c}_median, stddev_pop({c}) AS {c}_std" for c in _THREE) + ", "
          + ", ".join(f"sum({c}) AS total_{c}" for c in _TOT) + " FROM wp GROUP BY lake, length)")
_S_INT = "length n_windows n_valid_percent n_seen_min n_seen_max"
_S_NUM = " ".join([f"{c}_{s}" for c in _FIVE for s in ("mean", "median", "std", "min", "max") if not (c == "n_seen" and s in ("min", "max"))]
                  + ["pct_windows_2plus", "pct_windows_0", "pct_windows_1"] + [f"{c}_{s}" for c in _THREE for s in ("mean", "median", "std")] + [f"total_{c}" for c in _TOT])


@query("h3_h4_range_stats", shape(with_(OBS, WIN, RNG, _PCT, _STATS) + "\nFINAL SELECT * FROM rs", "lake", _S_INT, _S_NUM, 5))
def stats(spark, d):
    return rounded(ch.range_stats(_ranges(spark, d), "lake"), 5)


@query("h5_range_summary", shape(with_(OBS, WIN, RNG, _PCT, _STATS) + """
FINAL SELECT length, sum(n_windows) * length AS total_days, sum(n_windows) AS total_windows, """ + ", ".join(f"sum(total_{c}) AS total_{c}" for c in _TOT) + """,
 sum(total_seen_storage_range) / sum(total_storage_range) * 100 AS overall_percent_storage, sum(total_seen_wse_range) / sum(total_wse_range) * 100 AS overall_percent_wse,
 sum(percent_storage_mean * n_windows) / sum(n_windows) AS avg_percent_storage, sum(percent_wse_mean * n_windows) / sum(n_windows) AS avg_percent_wse,
 sum(percent_storage_v2_mean * n_valid_percent) / sum(CASE WHEN percent_storage_v2_mean IS NOT NULL THEN n_valid_percent END) AS avg_percent_storage_v2,
 sum(pct_windows_2plus * n_windows) / 100 AS windows_with_2plus, count(*) AS n_keys FROM rs GROUP BY length""", "", "length total_days total_windows n_keys",
    " ".join(f"total_{c}" for c in _TOT) + " overall_percent_storage overall_percent_wse avg_percent_storage avg_percent_wse avg_percent_storage_v2 windows_with_2plus", 5))
def summary(spark, d):
    return rounded(ch.range_summary(ch.range_stats(_ranges(spark, d), "lake")), 5)


_BIN = [(0, 5, "a"), (5, 20, "b"), (20, 45, "c"), (45, 1e9, "d")]


@query("h6_bin_pivot", shape(with_(OBS, WIN, RNG, _PCT, _STATS) + """
FINAL SELECT f.row_bin,
 avg(percent_storage_mean) FILTER (WHERE length <= 30) AS "short", avg(percent_storage_mean) FILTER (WHERE length > 30 AND length <= 365) AS "mid", avg(percent_storage_mean) FILTER (WHERE length > 365) AS "long"
FROM (VALUES ('a', 0.0, 5.0), ('b', 5.0, 20.0), ('c', 20.0, 45.0), ('d', 45.0, 1e300)) AS f(row_bin, low, high)
LEFT JOIN rs ON percent_storage_mean < 500 AND wse_range_mean > f.low AND wse_range_mean <= f.high GROUP BY f.row_bin""", "row_bin", "", "short mid long"))
def pivot(spark, d):
    table = ch.range_stats(_ranges(spark, d), "lake")
    return rounded(ch.bin_pivot(table, "wse_range_mean", "length", "percent_storage_mean", ([0, 5, 20, 45, float("inf")], ["a", "b", "c", "d"]),
                                ([0, 30, 365, 1000], ["short", "mid", "long"])))


@query("h7_box_by_length", shape(with_(OBS, WIN, RNG, _PCT, "q AS (SELECT length, quantile_cont(percent_storage, 0.25) AS q25, median(percent_storage) AS median, quantile_cont(percent_storage, 0.75) AS q75 FROM wp GROUP BY length)") + """
FINAL SELECT wp.length, count(*) AS n, avg(percent_storage) AS mean, any_value(q25) AS q25, any_value(median) AS median, any_value(q75) AS q75,
 min(percent_storage) FILTER (WHERE percent_storage BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS whisker_low,
 max(percent_storage) FILTER (WHERE percent_storage BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS whisker_high,
 count(*) FILTER (WHERE percent_storage NOT BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS n_outliers FROM wp JOIN q ON wp.length = q.length GROUP BY wp.length""",
    "", "length n n_outliers", "mean q25 median q75 whisker_low whisker_high"))
def boxes(spark, d):
    rows = ch.single_ranges(_ranges(spark, d), "lake").select("length", ch.percent_observed("seen_storage_range", "storage_range").alias("percent_storage"))
    rows = cut_lineage(rows)  # read several times
    return rounded(tb.box_stats(rows, "length", "percent_storage"))
