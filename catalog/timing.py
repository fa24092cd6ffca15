"""Matching, interpolation and sampling frequency (D, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (EV, OBS, ORDER, TRUTH, ev, obs, query, rounded, shape, table, truth_daily, with_)
from hydroseries.functions.keyed import holds
from hydroseries.operators import accuracy as acc
from hydroseries.operators import gaps as gp
from hydroseries.operators import interpolation as ip
from hydroseries.operators import matching as mt


def interp_sql(src: str, tgt: str, keep: str = "", recount: bool = False, out: str = "interp") -> str:
    """Oracle text of the day-grain interpolation; ``src`` has (lake, date, v, o), ``tgt`` (lake, date)."""
    p = out
    body = f"""{p}_s AS (SELECT lake, date, count(*) AS ns, arg_min(v, o) AS vf, arg_max(v, o) AS vl FROM ({src}) GROUP BY lake, date),
{p}_t AS (SELECT lake, date, count(*) AS nt FROM ({tgt}) GROUP BY lake, date),
{p}_b AS (SELECT *, last_value(CASE WHEN ns > 0 THEN date END IGNORE NULLS) OVER past AS d0, last_value(vl IGNORE NULLS) OVER past AS v0,
 first_value(CASE WHEN ns > 0 THEN date END IGNORE NULLS) OVER fut AS d1, first_value(vf IGNORE NULLS) OVER fut AS v1
 FROM {p}_s FULL JOIN {p}_t USING (lake, date)
 WINDOW past AS (PARTITION BY lake ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 fut AS (PARTITION BY lake ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{p}_g AS (SELECT lake, max(gap) AS longest FROM (SELECT lake, date_diff('day', lag(date) OVER (PARTITION BY lake ORDER BY date), date) AS gap
 FROM {p}_s) GROUP BY lake),
{p}_c AS (SELECT *, sum(coalesce(ns, 0)) OVER (PARTITION BY lake) AS srcn,
 sum(CASE WHEN d0 IS NOT NULL AND d1 IS NOT NULL THEN coalesce(nt, 0) ELSE 0 END) OVER (PARTITION BY lake) AS tgtn FROM {p}_b),
{p}_k AS (SELECT c.*, sum(nt) OVER (PARTITION BY c.lake) AS leftn FROM {p}_c c LEFT JOIN {p}_g g ON c.lake = g.lake
 WHERE d0 IS NOT NULL AND d1 IS NOT NULL AND nt > 0 AND srcn >= 2 AND tgtn >= 2 {keep}),
{out} AS (SELECT lake, date, nt, d0, d1, CASE WHEN d0 = date THEN vl
 ELSE v0 + (v1 - v0) * date_diff('day', d0, date) / date_diff('day', d0, d1) END AS value FROM {p}_k {'WHERE leftn >= 2' if recount else ''})"""
    return body


SENSOR = "SELECT lake, date, value AS v, o1 AS o FROM ev WHERE sensor"
METRICS = "n mae rmse bias std_error pearson_r nse"
METRIC_SQL = """count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias,
 stddev_pop(e) AS std_error, CASE WHEN count(*) > 1 AND stddev_pop(p) > 0 AND stddev_pop(t) > 0 THEN corr(p, t) END AS pearson_r,
 CASE WHEN var_pop(t) > 0 THEN 1 - sum(e * e) / (var_pop(t) * count(*)) END AS nse"""


@query("entry_sensor_skill", shape(with_(EV, TRUTH, interp_sql(SENSOR, "SELECT lake, date FROM truth")) + f"""
FINAL SELECT lake, {METRIC_SQL} FROM (SELECT i.lake, i.value AS p, t.truth AS t, i.value - t.truth AS e
 FROM interp i JOIN truth t ON i.lake = t.lake AND i.date = t.date) GROUP BY lake""", "lake", "n", "mae rmse bias std_error pearson_r nse"))
def sensor_skill(spark, d):
    e = ev(spark, d)
    truth = truth_daily(e)
    days = ip.interpolate(e.where("sensor"), truth, "lake", "date", "value", order=["o1"])
    rows = ip.interpolation_error(days, truth, "lake", "date", "truth")
    return rounded(acc.metrics(rows, "lake", "truth", "value", p68=False))


def _near(left: str, right: str, tol: int, join: str) -> str:
    return f"""m AS (SELECT l.lake, l.date, r.value, r.date AS rdate, row_number() OVER (PARTITION BY l.lake, l.date
 ORDER BY abs(date_diff('day', l.date, r.date)), r.o) AS k FROM ({left}) l {join} JOIN ({right}) r
 ON l.lake = r.lake AND abs(date_diff('day', l.date, r.date)) <= {tol})"""


@query("d1_nearest", shape(with_(EV, TRUTH, _near("SELECT * FROM truth", "SELECT lake, date, value, o1 AS o FROM ev WHERE kind = 'purchase'", 3, "LEFT"))
                           + "\nFINAL SELECT lake, date, value AS matched, date_diff('day', date, rdate) AS shift FROM m WHERE k = 1",
                           "lake date", "shift", "matched"))
def nearest(spark, d):
    e = ev(spark, d)
    out = mt.nearest_join(truth_daily(e), e.where("kind = 'purchase'"), "lake", "date", "date", "value", tol=3, order=["o1"])
    return rounded(out.select("lake", "date", "matched", F.datediff("matched_day", "date").alias("shift")))


@query("d2_nearest_inner", shape(with_(OBS, """l AS (SELECT DISTINCT lake, date FROM obs WHERE flag = 'N')""",
       """m AS (SELECT l.lake, l.date, r.swot_wsa, row_number() OVER (PARTITION BY l.lake, l.date ORDER BY
 abs(date_diff('day', l.date, r.date)), r.o1, r.o2, r.o3, r.o4) AS k FROM l JOIN obs r ON l.lake = r.lake AND r.flag = 'A'
 AND r.date BETWEEN l.date - 1 AND l.date + 1)""") + """
FINAL SELECT lake, count(*) AS n, avg(swot_wsa) AS mean_area FROM m WHERE k = 1 GROUP BY lake""", "lake", "n", "mean_area"))
def nearest_inner(spark, d):
    o = obs(spark, d)
    left = o.where("flag = 'N'").select("lake", "date").distinct()
    out = mt.nearest_join(left, o.where("flag = 'A'"), "lake", "date", "date", "swot_wsa", tol=1, how="inner", order=ORDER)
    return rounded(out.groupBy("lake").agg(F.count(F.lit(1)).alias("n"), F.avg("matched").alias("mean_area")))


OBS_SRC = "SELECT lake, date, swot_wsa AS v, (o1, o2, o3, o4) AS o FROM obs WHERE flag = 'N' AND status = 'F' AND o2 <= 2"
OBS_TGT = "SELECT lake, date FROM obs WHERE flag = 'A'"


def _obs_interp(spark, d, **rules):
    return ip.interpolate_rows(obs(spark, d), "lake", "date", "swot_wsa", F.expr("flag = 'N' AND status = 'F' AND o2 <= 2"),
                               F.expr("flag = 'A'"), ORDER, **rules)


def _interp(name, keep="", recount=False, **rules):
    @query(name, shape(with_(OBS, interp_sql(OBS_SRC, OBS_TGT, keep, recount))
                       + "\nFINAL SELECT lake, date, nt AS n_target, value FROM interp", "lake date", "n_target", "value"))
    def run(spark, d):
        return rounded(_obs_interp(spark, d, **rules).select("lake", "date" if False else F.col("day").alias("date"), "n_target", "value"))


_interp("d3_interpolate")
_interp("d4_interpolate_either_side", "AND date_diff('day', d0, date) <= 30 AND date_diff('day', date, d1) <= 30", True,
        max_gap=30, gap_rule="either_side")
_interp("d5_interpolate_proximity", "AND (NOT coalesce(longest > 40, FALSE) OR least(date_diff('day', d0, date), date_diff('day', date, d1)) <= 40)",
        True, max_gap=40, gap_rule="proximity_if_long")


@query("d6_interpolation_error", shape(with_(OBS, interp_sql(OBS_SRC, OBS_TGT)) + """
FINAL SELECT lake, count(*) AS n, avg(value - w) AS mean_error, avg((value - w) / w * 100) AS mean_pct
FROM interp i JOIN (SELECT lake, date, wsa AS w FROM obs WHERE flag = 'A') t USING (lake, date) GROUP BY lake""", "lake", "n", "mean_error mean_pct"))
def interp_error(spark, d):
    days = _obs_interp(spark, d)
    truth = obs(spark, d).where("flag = 'A'")
    a = ip.interpolation_error(days, truth, "lake", "date", "wsa")
    return rounded(a.groupBy("lake").agg(F.count(F.lit(1)).alias("n"), F.avg("error").alias("mean_error"),
                                         F.avg(F.col("error") / F.col("truth") * 100).alias("mean_pct")))


@query("d7_daily_errors", shape(with_(OBS, interp_sql(
    "SELECT lake, date, swot_wse_anomaly AS v, (o1, o2, o3, o4) AS o FROM obs WHERE swot_wse_abs_error < 0.02 AND ice = 0",
    "SELECT lake, date FROM obs WHERE abs(stage_anomaly) <= 20 AND ice = 0",
    "AND date_diff('day', d0, date) <= 20 AND date_diff('day', date, d1) <= 20", True)) + """
FINAL SELECT lake, count(*) AS n, avg(value - s) AS mean_error, sqrt(avg((value - s) ** 2)) AS rmse
FROM interp JOIN (SELECT lake, date, stage_anomaly AS s FROM obs WHERE abs(stage_anomaly) <= 20 AND ice = 0) USING (lake, date)
GROUP BY lake""", "lake", "n", "mean_error rmse"))
def daily_errors(spark, d):
    rows = ip.daily_errors(obs(spark, d), "lake", "date", "swot_wse_anomaly", "stage_anomaly", F.expr("swot_wse_abs_error < 0.02"),
                           ice="ice", max_gap=20, limit=20, order=ORDER)
    return rounded(rows.groupBy("lake").agg(F.count(F.lit(1)).alias("n"), F.avg("error").alias("mean_error"),
                                            F.sqrt(F.avg(F.pow("error", F.lit(2)))).alias("rmse")))


_D8 = with_(EV, TRUTH, "clicks AS (SELECT DISTINCT lake, date FROM ev WHERE kind = 'click')",
            """pick AS (SELECT c.lake, c.date, t.truth AS v, row_number() OVER (PARTITION BY c.lake, c.date ORDER BY
 abs(date_diff('day', c.date, t.date)), t.date) AS k FROM clicks c JOIN truth t ON c.lake = t.lake AND abs(date_diff('day', c.date, t.date)) <= 1)""",
            interp_sql("SELECT lake, date, v, v AS o FROM pick WHERE k = 1", "SELECT lake, date FROM truth"),
            """serr AS (SELECT i.lake, i.date, abs(i.value - t.truth) AS abs_error,
 least(date_diff('day', d0, i.date), date_diff('day', i.date, d1)) AS distance FROM interp i JOIN truth t USING (lake, date))""")


@query("d8_sampling_error", shape(_D8 + "\nFINAL SELECT lake, date, abs_error, distance FROM serr WHERE distance > 0 AND distance <= 50 AND abs_error <= 100",
                                  "lake date", "distance", "abs_error"))
def sampling_error(spark, d):
    e = ev(spark, d)
    truth = truth_daily(e)
    rows = ip.sampling_error(truth.select("lake", "date", F.col("truth").alias("value")), e.where("kind = 'click'"), "lake", "date",
                             "value", max_error=100)
    return rounded(rows.withColumnRenamed("day", "date"))


@query("d9_error_vs_gap", shape(with_(EV, TRUTH, "joined AS (SELECT lake, date, o1, CASE WHEN sensor THEN value END AS v, CASE WHEN NOT sensor THEN value END AS tr, sensor FROM ev)",
    interp_sql("SELECT lake, date, v, o1 AS o FROM joined WHERE sensor", "SELECT lake, date FROM joined WHERE tr IS NOT NULL")) + """
FINAL SELECT days_since, count(*) AS n, avg(err) AS mean_error, avg(abs(err)) AS mean_abs FROM (
 SELECT date_diff('day', d0, date) AS days_since, value - tr AS err FROM interp JOIN (SELECT lake, date, tr FROM joined WHERE tr IS NOT NULL) USING (lake, date))
WHERE days_since > 0 AND days_since <= 50 GROUP BY days_since""", "", "days_since n", "mean_error mean_abs"))
def error_vs_gap(spark, d):
    e = ev(spark, d).withColumn("tr", F.when(~F.col("sensor"), F.col("value")))
    rows = ip.error_vs_gap(e, "lake", "date", "value", "tr", F.col("sensor"), order=["o1"])
    return rounded(rows.groupBy("days_since").agg(F.count(F.lit(1)).alias("n"), F.avg("error").alias("mean_error"),
                                                  F.avg(F.abs("error")).alias("mean_abs")))


_D10 = with_(EV, """od AS (SELECT lake, date, avg(value) AS a, avg(CASE WHEN kind = 'click' THEN value END) AS b FROM ev WHERE sensor GROUP BY lake, date)""",
  "gd AS (SELECT lake, date, avg(value) AS g FROM ev WHERE kind = 'error' GROUP BY lake, date)",
  """sp AS (SELECT o.lake, greatest(a0, g0) AS lo, least(a1, g1) AS hi FROM (SELECT lake, min(date) AS a0, max(date) AS a1 FROM od GROUP BY lake) o
 JOIN (SELECT lake, min(date) AS g0, max(date) AS g1 FROM gd GROUP BY lake) g ON o.lake = g.lake WHERE greatest(a0, g0) <= least(a1, g1))""",
  "grid AS (SELECT lake, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM sp)",
  "gaps AS (SELECT lake, date AS x, lead(date) OVER (PARTITION BY lake ORDER BY date) AS y FROM gd)",
  """alld AS (SELECT lake, date FROM grid UNION SELECT lake, date FROM od)""",
  """f AS (SELECT lake, date, a, b, last_value(CASE WHEN a IS NOT NULL THEN date END IGNORE NULLS) OVER p AS ad0, last_value(a IGNORE NULLS) OVER p AS av0,
 first_value(CASE WHEN a IS NOT NULL THEN date END IGNORE NULLS) OVER q AS ad1, first_value(a IGNORE NULLS) OVER q AS av1,
 last_value(CASE WHEN b IS NOT NULL THEN date END IGNORE NULLS) OVER p AS bd0, last_value(b IGNORE NULLS) OVER p AS bv0,
 first_value(CASE WHEN b IS NOT NULL THEN date END IGNORE NULLS) OVER q AS bd1, first_value(b IGNORE NULLS) OVER q AS bv1
 FROM alld LEFT JOIN od USING (lake, date) WINDOW p AS (PARTITION BY lake ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 q AS (PARTITION BY lake ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
  """kept AS (SELECT grid.lake, grid.date, g, ad0, av0, ad1, av1, bd0, bv0, bd1, bv1, row_number() OVER (PARTITION BY grid.lake ORDER BY grid.date) AS pos
 FROM grid JOIN f USING (lake, date) LEFT JOIN gd USING (lake, date) WHERE NOT EXISTS (SELECT 1 FROM gaps z WHERE z.lake = grid.lake
 AND date_diff('day', z.x, z.y) >= 6 AND grid.date > z.x AND grid.date < z.y))""",
  """gg AS (SELECT *, last_value(CASE WHEN g IS NOT NULL THEN pos END IGNORE NULLS) OVER p AS p0, last_value(g IGNORE NULLS) OVER p AS g0,
 first_value(CASE WHEN g IS NOT NULL THEN pos END IGNORE NULLS) OVER q AS p1, first_value(g IGNORE NULLS) OVER q AS g1 FROM kept
 WINDOW p AS (PARTITION BY lake ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 q AS (PARTITION BY lake ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")


def _fill_sql(v0, v1, here, width):
    return f"coalesce({v0} + ({v1} - {v0}) * {here} / nullif({width}, 0), {v0}, {v1})"


@query("d10_daily_pair", shape(_D10 + f"""
FINAL SELECT lake, date, {_fill_sql('av0', 'av1', "date_diff('day', ad0, date)", "date_diff('day', ad0, ad1)")} AS daily_level,
 {_fill_sql('bv0', 'bv1', "date_diff('day', bd0, date)", "date_diff('day', bd0, bd1)")} AS daily_filtered,
 {_fill_sql('g0', 'g1', '(pos - p0)', '(p1 - p0)')} AS daily_gauge FROM gg""", "lake date", "", "daily_level daily_filtered daily_gauge"))
def daily_pair(spark, d):
    e = ev(spark, d).withColumn("clicked", F.when(F.col("kind") == "click", F.col("value")))
    out = ip.daily_pair(e.where("sensor"), e.where("kind = 'error'"), "lake", "date", "value", "clicked", "date", "value", major_gap=6)
    return rounded(out.withColumnRenamed("day", "date"))


@query("d11_min_count", shape(with_(EV, "k AS (SELECT lake FROM ev GROUP BY lake HAVING count(*) FILTER (WHERE kind = 'purchase') >= 15)") + """
FINAL SELECT lake, count(*) AS n, avg(value) AS mean_value FROM ev WHERE lake IN (SELECT lake FROM k) GROUP BY lake""", "lake", "n", "mean_value"))
def min_count(spark, d):
    e = ev(spark, d).withColumn("p", F.when(F.col("kind") == "purchase", F.col("value")))
    return rounded(mt.min_count(e, "lake", "p", 15).groupBy("lake").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")))


@query("d12_exclude", shape(with_(OBS) + """
FINAL SELECT lake, count(*) AS n FROM obs WHERE lake NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY lake""", "lake", "n"))
def exclude(spark, d):
    bad = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("lake"))
    return rounded(mt.exclude(obs(spark, d), bad, "lake").groupBy("lake").agg(F.count(F.lit(1)).alias("n")))


@query("d12_exclude_by_file_name", shape(with_(OBS) + """
FINAL SELECT file, count(*) AS n FROM (SELECT 'site_' || lake || '_daily.csv' AS file, lake FROM obs) o
WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_acctbal < 0 AND contains(o.file, CAST(s_suppkey AS VARCHAR))) GROUP BY file""", "file", "n"))
def exclude_file(spark, d):
    bad = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("id"))
    rows = obs(spark, d).withColumn("file", F.concat(F.lit("site_"), F.col("lake").cast("string"), F.lit("_daily.csv")))
    return rounded(mt.exclude_by_substring(rows, bad, "file", "id").groupBy("file").agg(F.count(F.lit(1)).alias("n")))


@query("d13_size_class", shape(with_(OBS) + """
FINAL SELECT size_class, count(*) AS n, count(DISTINCT lake) AS n_lakes FROM (SELECT o.lake, CASE WHEN a < 1000 THEN 'small' WHEN a IS NOT NULL THEN 'large'
 ELSE 'unknown' END AS size_class FROM obs o LEFT JOIN (SELECT s_suppkey AS lake, s_acctbal AS a FROM supplier WHERE s_nationkey < 20) m ON o.lake = m.lake)
GROUP BY size_class""", "size_class", "n n_lakes"))
def size_class(spark, d):
    m = table(spark, d, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("lake"), F.col("s_acctbal").alias("a"))
    rows = mt.with_size(obs(spark, d), m, "lake", "a", 1000)
    return rounded(rows.groupBy("size_class").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lake").alias("n_lakes")))


@query("d14_common_keys", shape(with_(EV) + """
FINAL SELECT kind, count(*) AS n, count(DISTINCT lake) AS n_lakes FROM ev WHERE lake IN (SELECT lake FROM ev WHERE date < DATE '2024-01-03' GROUP BY lake
 HAVING count(DISTINCT kind) = 3 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY kind""", "kind", "n n_lakes"))
def common(spark, d):
    e = ev(spark, d)
    also = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("lake"))
    early = mt.common_keys(e.where("date < DATE '2024-01-03'"), "lake", "kind", 3, also)
    rows = e.join(early.select("lake").distinct(), "lake", "left_semi")
    return rounded(rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lake").alias("n_lakes")))


@query("d14_common_keys_all_dates", shape(with_(EV) + """
FINAL SELECT kind, count(*) AS n, count(DISTINCT lake) AS n_lakes FROM ev WHERE lake IN (SELECT lake FROM ev GROUP BY lake
 HAVING count(DISTINCT kind) = 5 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY kind""", "kind", "n n_lakes"))
def common_all_dates(spark, d):
    e = ev(spark, d)
    also = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("lake"))
    keys = mt.common_keys(e, "lake", "kind", 5, also)
    rows = e.join(keys.select("lake").distinct(), "lake", "left_semi")
    return rounded(rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lake").alias("n_lakes")))


@query("d15_merge", shape(with_(OBS) + """
FINAL SELECT a.flag, a.status, a.n, b.mean_u FROM (SELECT flag, status, count(*) AS n FROM obs GROUP BY flag, status) a
LEFT JOIN (SELECT flag, avg(swot_wse_u) AS mean_u FROM obs WHERE flag <> 'A' GROUP BY flag) b ON a.flag = b.flag""", "flag status", "n", "mean_u"))
def merge(spark, d):
    o = obs(spark, d)
    left = o.groupBy("flag", "status").agg(F.count(F.lit(1)).alias("n"))
    right = o.where("flag <> 'A'").groupBy("flag").agg(F.avg("swot_wse_u").alias("mean_u"))
    return rounded(mt.merge_on(left, right, "flag"))


@query("d16_attach_observed", shape(with_(OBS, """s AS (SELECT flag, lake, avg(swot_wse_error) AS err FROM obs GROUP BY flag, lake)""",
    "f AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY lake) AS k FROM s)") + """
FINAL SELECT status, m AS model, n, err FROM (SELECT status, CASE status WHEN 'O' THEN 'new' ELSE 'old' END AS m, count(*) AS n FROM obs GROUP BY status) c
LEFT JOIN (SELECT flag, err FROM f WHERE k = 1) x ON x.flag = CASE c.m WHEN 'new' THEN 'N' WHEN 'old' THEN 'A' END""", "status model", "n", "err"))
def observed(spark, d):
    o = obs(spark, d)
    cfg = (o.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
           .withColumn("flag", F.when(F.col("status") == "O", "new").otherwise("old")))
    summary = o.groupBy("flag", "lake").agg(F.avg("swot_wse_error").alias("err"))
    out = mt.attach_observed(cfg, summary, {"flag": {"new": "N", "old": "A"}}, ["lake"], ["err"])
    return rounded(out.withColumnRenamed("flag", "model"))


COMBOS = [{"model": "swot", "base": 10.0, "pct": 5.0}, {"model": "s2", "base": 20.0, "pct": 2.5}, {"model": "static", "base": 0.0, "pct": 8.0}]
COMBO_SQL = "combos AS (SELECT * FROM (VALUES ('swot', 10.0::DOUBLE, 5.0::DOUBLE), ('s2', 20.0, 2.5), ('static', 0.0, 8.0)) v(model, base, pct))"


@query("d17_combinations", shape(with_(OBS, COMBO_SQL) + """
FINAL SELECT lake, model, count(*) AS n, avg(swot_wsa * base + pct) AS mean_term FROM obs CROSS JOIN combos GROUP BY lake, model""",
    "lake model", "n", "mean_term"))
def combinations(spark, d):
    rows = mt.every_combination(obs(spark, d).select("lake", "swot_wsa"), COMBOS)
    return rounded(rows.groupBy("lake", "model").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("swot_wsa") * F.col("base") + F.col("pct")).alias("mean_term")))


_DAYS = "dd AS (SELECT DISTINCT lake, date FROM ev WHERE kind = 'purchase')"
_GAPS = "gg AS (SELECT lake, date AS day, lead(date) OVER (PARTITION BY lake ORDER BY date) AS next_day FROM dd)"


@query("e1_gaps", shape(with_(EV, _DAYS, _GAPS) + "\nFINAL SELECT lake, day, next_day, date_diff('day', day, next_day) AS gap_days FROM gg WHERE next_day IS NOT NULL",
                        "lake day next_day", "gap_days"))
def gaps(spark, d):
    return rounded(gp.gaps(ev(spark, d), "lake", "date", F.col("kind") == "purchase"))


@query("e2_gaps_without_ice", shape(with_(EV, _DAYS, _GAPS) + """
FINAL SELECT lake, day, next_day, date_diff('day', day, next_day) AS gap_days FROM gg WHERE next_day IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.lake = gg.lake AND iced AND ev.date BETWEEN gg.day AND gg.next_day)""", "lake day next_day", "gap_days"))
def gaps_ice(spark, d):
    return rounded(gp.gaps(ev(spark, d), "lake", "date", F.col("kind") == "purchase", F.col("iced")))


@query("e3_gap_summary", shape(with_(EV, _DAYS, _GAPS) + """
FINAL SELECT avg(g) AS mean_gap, count(*) AS n_gaps, median(g) AS median_gap FROM (SELECT date_diff('day', day, next_day) AS g FROM gg WHERE next_day IS NOT NULL)""",
    "", "n_gaps", "mean_gap median_gap"))
def gap_summary(spark, d):
    return rounded(gp.gap_summary(gp.gaps(ev(spark, d), "lake", "date", F.col("kind") == "purchase")))


@query("e4_long_gaps", shape(with_(EV, _DAYS) + """
FINAL SELECT lake, count(*) AS n_days, count(*) FILTER (WHERE g > 4) AS n_long FROM (SELECT lake,
 date_diff('day', lag(date) OVER (PARTITION BY lake ORDER BY date), date) AS g FROM dd) GROUP BY lake""", "lake", "n_days n_long"))
def long_gaps(spark, d):
    rows = gp.long_gaps(ev(spark, d).where("kind = 'purchase'"), "lake", "date", 4)
    return rounded(rows.groupBy("lake").agg(F.count(F.lit(1)).alias("n_days"), F.count_if("exceeds").alias("n_long")))


@query("e5_retention", shape(with_(OBS) + """
FINAL SELECT lake, count(*) FILTER (WHERE swot_wse_abs_error <= 0.03) AS n_kept, count(*) FILTER (WHERE ice = 0) AS n_baseline,
 count(*) FILTER (WHERE swot_wse_abs_error <= 0.03) / count(*) FILTER (WHERE ice = 0) * 100 AS retention_pct FROM obs GROUP BY lake""",
    "lake", "n_kept n_baseline", "retention_pct"))
def retention(spark, d):
    return rounded(gp.retention(obs(spark, d), F.expr("swot_wse_abs_error <= 0.03"), F.expr("ice = 0"), "lake"))


@query("e6_resolution_by_threshold", shape(with_(OBS, "t AS (SELECT * FROM (VALUES (0.01::DOUBLE), (0.03), (0.05), ('inf'::DOUBLE)) v(threshold))",
    """c AS (SELECT threshold, lake, count(*) AS days, count(*) FILTER (WHERE swot_wse_abs_error <= threshold AND swot_partial_f = 0) AS n
 FROM obs CROSS JOIN t WHERE ice = 0 GROUP BY threshold, lake)""") + """
FINAL SELECT threshold, sum(days) / sum(n) AS days_per_obs, count(*) AS n_keys, sum(n) AS n_obs FROM c WHERE n >= 3 GROUP BY threshold""",
    "threshold", "n_keys n_obs", "days_per_obs"))
def resolution(spark, d):
    return rounded(gp.resolution_by_threshold(obs(spark, d), "lake", "swot_wse_abs_error", [0.01, 0.03, 0.05, None],
                                              F.expr("ice = 0"), F.expr("swot_partial_f = 0")))


@query("e7_resolution_by_span", shape(with_(OBS) + """
FINAL SELECT sum(s) / sum(n) AS days_per_obs, count(*) AS n_keys FROM (SELECT lake, date_diff('day', min(date), max(date)) + 1 AS s, count(*) AS n
 FROM obs WHERE adaptive_filter = 0 GROUP BY lake HAVING count(*) >= 2)""", "", "n_keys", "days_per_obs"))
def resolution_span(spark, d):
    return rounded(gp.resolution_by_span(obs(spark, d).where("adaptive_filter = 0"), "lake", "date"))


@query("e7_span_per_key", shape(with_(EV) + """
FINAL SELECT lake, date_diff('day', min(date), max(date)) + 1 AS span_days, count(*) AS n_obs, (date_diff('day', min(date), max(date)) + 1) / count(*) AS days_per_obs
FROM ev WHERE kind = 'signup' GROUP BY lake HAVING count(*) >= 2""", "lake", "span_days n_obs", "days_per_obs"))
def span_key(spark, d):
    return rounded(gp.span_per_key(ev(spark, d).where("kind = 'signup'"), "lake", "date"))


@query("e8_key_success", shape(with_(EV) + """
FINAL SELECT count(*) AS n_attempted, sum(ok) AS n_success, avg(ok) * 100 AS success_pct FROM (
 SELECT lake, max(CASE WHEN value > 200 THEN 1 ELSE 0 END) AS ok FROM ev GROUP BY lake)""", "", "n_attempted n_success", "success_pct"))
def success(spark, d):
    return rounded(gp.key_success(ev(spark, d), "lake", F.col("value") > 200))
