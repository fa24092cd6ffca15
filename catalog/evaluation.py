"""Storage evaluation, significance and uncertainty (J, K, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import query, rounded, shape, table, with_
from hydroseries.functions.keyed import cut_lineage
from hydroseries.operators import accuracy as acc
from hydroseries.operators import evaluate as ev
from hydroseries.operators import significance as sg
from hydroseries.operators import uncertainty as un

B = "(l_extendedprice - 50000) * 100"
VEXPR = {
    "lake": "l_suppkey", "date": "CAST(l_shipdate AS DATE)", "flag": "l_returnflag", "acc_opt": "l_linenumber <= 5", "acc_filt": "l_quantity > 10",
    "image": "l_returnflag <> 'R'", "storage": "l_extendedprice * 100", "storage_anomaly": B, "storage_anomaly_opt": B, "storage_anomaly_filt": f"{B} + l_quantity * 100",
    "height": "l_quantity / 10", "level": "l_quantity - 25.5", "area": "l_extendedprice / 1000",
    "swot_opt_dis": f"{B} * (1 + l_discount)", "swot_opt_con": f"{B} * (1 + l_tax)", "swot_filt_dis": f"{B} * (1 - l_discount)", "swot_filt_con": f"{B} * (1 - l_tax)",
    "swots2_opt_dis": f"{B} + l_quantity * 9000", "swots2_opt_con": f"{B} - l_quantity * 9000", "swots2_filt_dis": f"{B} + l_quantity * 7000", "swots2_filt_con": f"{B} - l_quantity * 7000",
    "s2_opt_dis": f"CASE WHEN l_returnflag <> 'R' THEN {B} + l_partkey * 100 END", "s2_opt_con": f"{B} + l_partkey * 90",
    "s2_filt_dis": f"CASE WHEN l_returnflag <> 'R' THEN {B} - l_partkey * 100 END", "s2_filt_con": f"{B} - l_partkey * 90",
    "static_opt_dis": f"{B} * 2", "static_opt_con": f"{B} / 2", "static_filt_dis": f"{B} * l_discount * 10", "static_filt_con": f"{B} * l_tax * 10",
    "swot_storage_anomaly": f"{B} * (1 + l_discount)", "swots2_storage_anomaly": f"{B} + l_quantity * 9000", "static_area_storage_anomaly": f"{B} * 2",
    "s2_storage_anomaly": f"{B} + l_partkey * 100",
}
VOBS = "vo AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in VEXPR.items()) + " FROM lineitem)"


def masks():
    return {"opt": F.col("acc_opt"), "filt": F.col("acc_filt")}


def vobs(spark, d):
    return table(spark, d, "lineitem").selectExpr(*[f"{e} AS `{n}`" for n, e in VEXPR.items()])


PAIRS = "vp AS (" + " UNION ALL ".join(
    f"SELECT lake, '{m}_{k}_{x}' AS variant, '{m}' AS model, '{k}' AS filter_type, '{x}' AS temporal_type, storage_anomaly_{k} * 1233.48 / 1e9 AS observed, {m}_{k}_{x} * 1233.48 / 1e9 AS predicted "
    f"FROM vo WHERE {m}_{k}_{x} IS NOT NULL" + (f" AND acc_{k}" if x == "dis" and m != "s2" else "")
    for m in ("swot", "swots2", "s2", "static") for k in ("opt", "filt") for x in ("dis", "con")) + ")"
_V = "variant, model, filter_type, temporal_type"
_FIG = "mae rmse bias std_error p68_abs_error pearson_r nse"
MET = """count(*) AS n, avg(abs(p - o)) AS mae, sqrt(avg((p - o) ** 2)) AS rmse, avg(p - o) AS bias, stddev_pop(p - o) AS std_error, quantile_cont(abs(p - o), 0.68) AS p68_abs_error,
 CASE WHEN count(*) > 1 AND stddev_pop(o) > 0 AND stddev_pop(p) > 0 THEN corr(o, p) END AS pearson_r, CASE WHEN var_pop(o) > 0 THEN 1 - sum((p - o) ** 2) / (var_pop(o) * count(*)) END AS nse"""
PK = f"pk AS (SELECT lake, {_V}, {MET} FROM (SELECT *, observed AS o, predicted AS p FROM vp) GROUP BY lake, {_V} HAVING count(*) >= 2)"


def _per_key(spark, d, norm=False):
    return ev.evaluate_daily(vobs(spark, d), "lake", masks(), norm)


@query("j1_metrics_by_capacity", shape(with_(VOBS, f"c AS (SELECT lake, max(storage) - min(storage) AS cap FROM vo GROUP BY lake)", f"m AS (SELECT lake, {MET} FROM (SELECT lake, storage_anomaly / 1000 AS o, swot_storage_anomaly / 1000 AS p FROM vo) GROUP BY lake)") + """
FINAL SELECT lake, n, mae, rmse, bias, std_error, p68_abs_error, pearson_r, nse, mae / (cap / 1000) AS mae_norm, rmse / (cap / 1000) AS rmse_norm, bias / (cap / 1000) AS bias_norm, std_error / (cap / 1000) AS std_error_norm,
 p68_abs_error / (cap / 1000) AS p68_abs_error_norm FROM m JOIN c USING (lake)""", "lake", "n", _FIG + " mae_norm rmse_norm bias_norm std_error_norm p68_abs_error_norm", 5))
def by_capacity(spark, d):
    v = vobs(spark, d)
    cap = v.groupBy("lake").agg(((F.max("storage") - F.min("storage")) / 1000).alias("cap"))
    rows = v.join(cap, "lake").select("lake", "cap", (F.col("storage_anomaly") / 1000).alias("o"), (F.col("swot_storage_anomaly") / 1000).alias("p"))
    return rounded(acc.metrics(rows, "lake", "o", "p", capacity="cap"), 5)


@query("j3_variants_km3", shape(with_(VOBS, PAIRS, PK) + "\nFINAL SELECT * FROM pk", "lake variant model filter_type temporal_type", "n", _FIG))
def variants(spark, d):
    return rounded(_per_key(spark, d))


_SIZED = ("mae", "rmse", "bias", "std_error", "p68_abs_error")
PN = (f"pn AS (SELECT lake, {_V}, n, pearson_r, nse, w AS storage_range, " + ", ".join(f"round({c} / w * 100, 1) AS {c}" for c in _SIZED)
      + f" FROM pk JOIN (SELECT lake, variant, quantile_cont(observed, 0.99) - quantile_cont(observed, 0.01) AS w FROM vp GROUP BY lake, variant) USING (lake, variant))")


@query("j2_variants_percent", shape(with_(VOBS, PAIRS, PK, PN) + "\nFINAL SELECT * FROM pn", "lake variant model filter_type temporal_type", "n", _FIG + " storage_range"))
def variants_norm(spark, d):
    return rounded(_per_key(spark, d, True))


_ACROSS = ["mae", "rmse", "bias", "nse", "pearson_r", "r2", "std_error", "p68_abs_error"]


@query("j4_summarize_variants", shape(with_(VOBS, PAIRS, PK, "lg AS (" + " UNION ALL ".join(
    f"SELECT {_V}, '{m}' AS metric, {'pearson_r * pearson_r' if m == 'r2' else m} AS v FROM pk" for m in _ACROSS) + ")") + f"""
FINAL SELECT {_V}, metric, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, median(v) AS median FROM lg GROUP BY ALL""", "variant model filter_type temporal_type metric", "n", "mean std median"))
def across(spark, d):
    return rounded(ev.summarize_variants(_per_key(spark, d)))


def _pool_sql(src: str) -> str:
    return f"""pe AS ({src}),
pq AS (SELECT variant, quantile_cont(e, 0.01) AS a, quantile_cont(e, 0.99) AS b, count(DISTINCT lake) AS n_keys, count(*) AS n_obs FROM pe GROUP BY variant),
po AS (SELECT {_V}, any_value(n_keys) AS n_keys, any_value(n_obs) AS n_obs, count(*) AS n_robust, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias, stddev_pop(e) AS std_error,
 quantile_cont(abs(e), 0.68) AS p68_abs_error FROM pe JOIN pq USING (variant) WHERE e BETWEEN a AND b GROUP BY ALL)"""


_POOL = ("variant model filter_type temporal_type", "n_keys n_obs n_robust", "mae rmse bias std_error p68_abs_error")


@query("j5_pooled_km3", shape(with_(VOBS, PAIRS, _pool_sql("SELECT *, predicted - observed AS e FROM vp")) + "\nFINAL SELECT * FROM po", *_POOL))
def pooled(spark, d):
    return rounded(ev.pooled_metrics(ev.variant_pairs(vobs(spark, d), "lake", masks()), "lake"))


_RG = "rg AS (" + " UNION ALL ".join(f"SELECT lake, '{k}' AS filter_type, (quantile_cont(storage_anomaly_{k}, 0.99) - quantile_cont(storage_anomaly_{k}, 0.01)) * 1233.48 / 1e9 AS w FROM vo GROUP BY lake HAVING count(*) >= 10" for k in ("opt", "filt")) + ")"


@query("j6_pooled_percent", shape(with_(VOBS, PAIRS, _RG, _pool_sql("SELECT vp.*, (predicted - observed) / w * 100 AS e FROM vp JOIN rg USING (lake, filter_type) WHERE w > 1e-6")) + "\nFINAL SELECT * FROM po", *_POOL, 5))
def pooled_norm(spark, d):
    v = vobs(spark, d)
    parts = [ev.gauge_range(v.withColumn("_r", F.col(f"storage_anomaly_{k}") * 1233.48 / 1e9), "lake", "_r").withColumn("filter_type", F.lit(k)) for k in ("opt", "filt")]
    return rounded(ev.pooled_metrics(ev.variant_pairs(v, "lake", masks()), "lake", parts[0].unionByName(parts[1])), 5)


_CMP = {"swot": "swot_storage_anomaly", "swot_s2": "swots2_storage_anomaly", "static_area": "static_area_storage_anomaly"}
COMP = ["cp AS (" + " UNION ALL ".join([f"SELECT lake, '{k}' AS filter_type, '{m}' AS model, storage_anomaly / 1000 AS o, {c} / 1000 AS p FROM vo WHERE {a}" for k, a in (("optimal", "acc_opt"), ("adaptive", "acc_filt")) for m, c in _CMP.items()]
        + ["SELECT lake, 's2', 's2', storage_anomaly / 1000, s2_storage_anomaly / 1000 FROM vo WHERE image"]) + ")",
        "cap AS (SELECT lake, (max(storage) - min(storage)) / 1000 AS cap FROM vo GROUP BY lake)",
        f"cm AS (SELECT lake, filter_type, model, {MET} FROM cp GROUP BY ALL)",
        "cn AS (SELECT cm.*, " + ", ".join(f"{c} / cap AS {c}_norm" for c in _SIZED) + " FROM cm JOIN cap USING (lake) WHERE lake IN (SELECT lake FROM cm GROUP BY lake HAVING count(*) = 7))"]


def _compared(spark, d):
    v = vobs(spark, d)
    cols = [*_CMP.values(), "s2_storage_anomaly", "storage_anomaly", "storage"]
    v = v.withColumns({c: F.col(c) / 1000 for c in cols})
    return ev.compare_models(v, "lake", {"optimal": F.col("acc_opt"), "adaptive": F.col("acc_filt")}, F.col("image"))


@query("j7_compare_models", shape(with_(VOBS, *COMP) + "\nFINAL SELECT * FROM cn", "lake filter_type model", "n", _FIG + " " + " ".join(f"{c}_norm" for c in _SIZED), 5))
def compare(spark, d):
    return rounded(_compared(spark, d), 5)


_LAB = "CASE model WHEN 'swot' THEN 'SWOT' WHEN 'swot_s2' THEN 'SWOT + S2' WHEN 'static_area' THEN 'Static area' ELSE 'S2' END"
_SUM = ("mae_norm", "rmse_norm", "bias_norm", "r2", "nse")


@query("j8_j9_summary_table", shape(with_(VOBS, *COMP) + f"\nFINAL SELECT {_LAB} AS label, filter_type, count(*) AS n_keys, " + ", ".join(
    f"round(avg({c}), 3) AS {c}_mean, round(stddev_samp({c}), 3) AS {c}_std" for c in _SUM) + " FROM (SELECT *, pearson_r ** 2 AS r2 FROM cn) GROUP BY ALL", "label filter_type", "n_keys",
    " ".join(f"{c}_{s}" for c in _SUM for s in ("mean", "std"))))
def summary_table(spark, d):
    return rounded(ev.summary_table(_compared(spark, d)))


@query("k1_paired", shape(with_(VOBS) + """
FINAL SELECT lake, avg(area) FILTER (WHERE flag = 'A') AS "A", avg(area) FILTER (WHERE flag = 'N') AS "N", avg(area) FILTER (WHERE flag = 'R') AS "R" FROM vo GROUP BY lake
HAVING count(*) FILTER (WHERE flag = 'A') > 0 AND count(*) FILTER (WHERE flag = 'N') > 0 AND count(*) FILTER (WHERE flag = 'R') > 0""", "lake", "", "A N R"))
def paired(spark, d):
    return rounded(sg.paired(vobs(spark, d), "lake", "flag", ["A", "N", "R"], "area"))


_PAIRS = [("A", "N"), ("A", "R"), ("N", "R")]
RANKS = ["w AS (SELECT lake, flag, avg(area) AS area, avg(height) AS height FROM vo GROUP BY lake, flag)",
         "ok AS (SELECT lake FROM w GROUP BY lake HAVING count(*) = 3)",
         "df AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, x.flag AS group_a, y.flag AS group_b, x.{m} AS va, y.{m} AS vb FROM w x JOIN w y ON x.lake = y.lake AND x.flag < y.flag WHERE x.lake IN (SELECT lake FROM ok)" for m in ("area", "height")) + ")",
         "rk AS (SELECT *, va - vb AS d, rank() OVER (PARTITION BY metric, group_a, group_b ORDER BY abs(round(va - vb, 8))) + (count(*) OVER (PARTITION BY metric, group_a, group_b, abs(round(va - vb, 8))) - 1) / 2 AS r FROM df WHERE round(va - vb, 8) <> 0)",
         "sr AS (SELECT metric, group_a, group_b, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS w_minus, count(*) AS n_used FROM rk GROUP BY ALL)",
         "bs AS (SELECT metric, group_a, group_b, count(*) AS n_pairs, count(*) FILTER (WHERE round(va - vb, 8) = 0) AS n_zero, median(va) AS median_a, median(vb) AS median_b FROM df GROUP BY ALL)"]


@query("k2_k4_signed_ranks", shape(with_(VOBS, *RANKS) + "\nFINAL SELECT *, least(w_plus, w_minus) AS w FROM bs JOIN sr USING (metric, group_a, group_b)", "metric group_a group_b", "n_pairs n_zero n_used", "median_a median_b w_plus w_minus w"))
def ranks(spark, d):
    return rounded(sg.signed_ranks(vobs(spark, d), "lake", "flag", _PAIRS, ["area", "height"]).drop("tie_term"))


# Probabilities in SQL: the normal tail by Simpson's rule, the exact one by counting rank sums number by number.
_TAIL = ("CASE WHEN z > 8 THEN 0 ELSE 2 / sqrt(pi()) * 8 / 4000 / 3 * list_sum(list_transform(range(4001), "
         "lambda i: CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(z + i * 8.0 / 4000, 2)))) END")
_DIST = """dist AS (SELECT 0 AS n, 0 AS s, CAST(1 AS DOUBLE) AS w UNION ALL
 (SELECT n + 1, s, sum(w) FROM (SELECT n, s, w FROM dist UNION ALL SELECT n, s + n + 1, w FROM dist) WHERE n < 50 GROUP BY n, s))"""


def _tests(source: str, by: str, bound: float) -> list[str]:
    return [f"rk AS (SELECT *, round(va - vb, 8) AS d, rank() OVER (PARTITION BY {by} ORDER BY abs(round(va - vb, 8))) + (count(*) OVER (PARTITION BY {by}, abs(round(va - vb, 8))) - 1) / 2 AS r FROM {source} WHERE round(va - vb, 8) <> 0)",
            f"tt AS (SELECT {by}, CAST(sum(k * k * k - k) AS DOUBLE) AS tie_term FROM (SELECT {by}, abs(d), count(*) AS k FROM rk GROUP BY ALL) GROUP BY ALL)",
            f"sr AS (SELECT {by}, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS w_minus, count(*) AS n_used FROM rk GROUP BY ALL)",
            f"bs AS (SELECT {by}, count(*) AS n_pairs, count(*) FILTER (WHERE round(va - vb, 8) = 0) AS n_zero, median(va) AS median_a, median(vb) AS median_b FROM {source} GROUP BY ALL)",
            f"al AS (SELECT *, least(w_plus, w_minus) AS w, CAST(n_used AS DOUBLE) AS m FROM bs JOIN sr USING ({by}) JOIN tt USING ({by}))",
            "zs AS (SELECT *, abs(w - m * (m + 1) / 4) / sqrt(2 * nullif(m * (m + 1) * (2 * m + 1) / 24 - tie_term / 48, 0)) AS z FROM al)",
            f"""pv AS (SELECT *, CASE WHEN n_used <= 50 AND tie_term = 0 AND n_zero = 0
 THEN least(1, 2 * (SELECT sum(dist.w) FROM dist WHERE dist.n = zs.n_used AND dist.s <= zs.w) / power(2, m)) ELSE {_TAIL} END AS p_value, {bound!r} AS bonferroni_bound FROM zs)""",
            """done AS (SELECT *, CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE 'ns' END AS significance,
 p_value < bonferroni_bound AS passes_bonferroni FROM pv)"""]


_TESTED = "n_pairs n_zero n_used", "median_a median_b w_plus w_minus tie_term w p_value bonferroni_bound"


@query("k2_wilcoxon", shape("WITH RECURSIVE " + ",\n".join([VOBS, *RANKS[:3], _DIST, *_tests("df", "metric, group_a, group_b", 0.05 / 6)]) + "\nFINAL SELECT * FROM done",
                            "metric group_a group_b significance passes_bonferroni", *_TESTED))
def wilcoxon(spark, d):
    return rounded(sg.wilcoxon(vobs(spark, d), "lake", "flag", None, ["area", "height"], ["A", "N", "R"]))


_EFFECTS = "ef AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, '{a}' AS group_a, '{b}' AS group_b, x.{other} AS subset, x.{m} AS va, y.{m} AS vb FROM pk x JOIN pk y ON x.lake = y.lake AND x.{other} = y.{other} "
    f"WHERE x.model = 'swot' AND y.model = 'swot' AND x.{kind} = '{a}' AND y.{kind} = '{b}' AND x.{m} IS NOT NULL AND y.{m} IS NOT NULL"
    for m in ("mae", "rmse") for kind, other, a, b in (("filter_type", "temporal_type", "opt", "filt"), ("temporal_type", "filter_type", "dis", "con"))) + ")"


@query("k3_filter_and_time_effect", shape("WITH RECURSIVE " + ",\n".join([VOBS, PAIRS, PK, _EFFECTS, _DIST, *_tests("ef", "metric, group_a, group_b, subset", 0.05 / 2)]) + "\nFINAL SELECT * FROM done",
                                          "metric group_a group_b subset significance passes_bonferroni", *_TESTED))
def effects(spark, d):
    per_key = cut_lineage(ev.evaluate_daily(vobs(spark, d), "lake", masks(), models=["swot"], p68=False))  # read by each of the four tests
    return rounded(sg.filter_effect(per_key, "lake", ["mae", "rmse"]).unionByName(sg.time_effect(per_key, "lake", ["mae", "rmse"])))


@query("k5_per_model", shape(with_(VOBS, PAIRS, PK) + "\nFINAL SELECT model, 'mae' AS metric, count(*) AS n, avg(mae) AS mean, stddev_samp(mae) AS std, min(mae) AS min, max(mae) AS max, quantile_cont(mae, 0.25) AS q25, median(mae) AS median, quantile_cont(mae, 0.75) AS q75 FROM pk GROUP BY model",
                             "model metric", "n", "mean std min max q25 median q75"))
def per_model(spark, d):
    return rounded(acc.summarize(_per_key(spark, d), ["mae"], 1, "model"))


COMBOS = [un.combo("swot", "opt", "discrete", 0.1, 0, 0, 5), un.combo("swot", "opt", "daily", 0.1, 0.05, 0, 5),
          un.combo("swot", "filt", "discrete", 0.1, 0, 0.08, 6), un.combo("static", "filt", "daily", 0.12, 0.05, 0.08, 12)]
CB = "cb AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{c['model']}', '{c['swot_filter']}', '{c['temporal']}', {c['wse']}::DOUBLE, {c['wse_temporal']}::DOUBLE, {c['wse_filt']}::DOUBLE, {c['wsa_pct']}::DOUBLE)" for c in COMBOS) + ") v(model, swot_filter, temporal, b, t, f, p))"
PR = ["p1 AS (SELECT lake, cb.*, area, abs(height) AS h, area * (b + t + f) / 1000 AS sw, abs(height) / 1000 * area * p / 100 AS sa, 1 / greatest(abs(height), 0.1) AS height_weight FROM vo CROSS JOIN cb)",
      """p2 AS (SELECT *, sqrt(sw * sw + sa * sa) AS sigma_total, sw / (sw + sa) * 100 AS wse_total_pct, sa / (sw + sa) * 100 AS area_pct, area * b / 1000 / (sw + sa) * 100 AS wse_base_pct,
 area * t / 1000 / (sw + sa) * 100 AS wse_temporal_pct, area * f / 1000 / (sw + sa) * 100 AS wse_filt_pct FROM p1)"""]
_SH = ["wse_total_pct", "wse_base_pct", "wse_temporal_pct", "wse_filt_pct", "area_pct", "sigma_total"]


def _terms(spark, d, ranges=None):
    return un.propagate(vobs(spark, d), COMBOS, "lake", ranges, "height", "area", "level")


@query("l1_propagate", shape(with_(VOBS, CB, *PR) + "\nFINAL SELECT lake, model, swot_filter, temporal, count(*) AS n, avg(sw) * 1000 AS sigma_wse, avg(sa) * 1000 AS sigma_area, avg(sigma_total) * 1000 AS sigma_total, avg(height_weight) AS height_weight, "
                             + ", ".join(f"avg({c}) AS {c}" for c in _SH[:5]) + " FROM p2 GROUP BY ALL", "lake model swot_filter temporal", "n", "sigma_wse sigma_area sigma_total height_weight " + " ".join(_SH[:5])))
def propagate(spark, d):
    t = _terms(spark, d)
    return rounded(t.groupBy("lake", "model", "swot_filter", "temporal").agg(F.count(F.lit(1)).alias("n"), *[(F.avg(c) * 1000).alias(c) for c in ("sigma_wse", "sigma_area", "sigma_total")],
                                                                            F.avg("height_weight").alias("height_weight"), *[F.avg(c).alias(c) for c in _SH[:5]]))


_RG2 = "r2 AS (SELECT lake, filter_type AS swot_filter, w FROM rg WHERE w > 1e-6)"


def _norm_terms(spark, d):
    ranges = un.storage_reference(vobs(spark, d), "lake", {"opt": "storage_anomaly_opt", "filt": "storage_anomaly_filt"})
    return _terms(spark, d, ranges)


@query("l2_propagate_percent", shape(with_(VOBS, CB, *PR, _RG, _RG2) + """
FINAL SELECT lake, model, swot_filter, temporal, count(*) AS n, avg(w) AS storage_range, avg(round(sw / w * 100, 1)) AS sigma_wse_norm, avg(round(sa / w * 100, 1)) AS sigma_area_norm, avg(round(sigma_total / w * 100, 1)) AS sigma_total_norm,
 avg(wse_total_pct * b / (b + t + f)) AS wse_base_pct, avg(area_pct) AS area_pct FROM p2 JOIN r2 USING (lake, swot_filter) GROUP BY ALL""", "lake model swot_filter temporal", "n", "storage_range sigma_wse_norm sigma_area_norm sigma_total_norm wse_base_pct area_pct", 5))
def propagate_norm(spark, d):
    t = _norm_terms(spark, d)
    return rounded(t.groupBy("lake", "model", "swot_filter", "temporal").agg(F.count(F.lit(1)).alias("n"), F.avg("storage_range").alias("storage_range"),
                   *[F.avg(c).alias(c) for c in ("sigma_wse_norm", "sigma_area_norm", "sigma_total_norm", "wse_base_pct", "area_pct")]), 5)


WS = ["lg AS (" + " UNION ALL ".join(f"SELECT model, swot_filter, temporal, lake, '{c}' AS measure, {c} AS x, height_weight AS hw FROM p2" for c in _SH) + ")",
      "cu AS (SELECT *, sum(hw) OVER (PARTITION BY model, swot_filter, temporal, measure ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw, sum(hw) OVER (PARTITION BY model, swot_filter, temporal, measure) AS tw FROM lg)",
      "ws AS (SELECT model, swot_filter, temporal, measure, round(sum(x * hw) / sum(hw), 4) AS mean, round(min(x) FILTER (WHERE cw >= tw / 2), 4) AS median FROM cu GROUP BY ALL)"]


@query("l3_weighted_stats", shape(with_(VOBS, CB, *PR, *WS) + "\nFINAL SELECT * FROM ws", "model swot_filter temporal measure", "", "mean median", 4))
def weighted(spark, d):
    return rounded(un.weighted_stats(_terms(spark, d), ["model", "swot_filter", "temporal"], _SH, "height_weight"), 4)


_WIDE = "wd AS (SELECT model, swot_filter, temporal, " + ", ".join(f"max({s}) FILTER (WHERE measure = '{m}') AS {m}_{s}" for m in _SH for s in ("mean", "median")) + " FROM ws GROUP BY ALL)"
_OB = "ob AS (SELECT CASE flag WHEN 'N' THEN 'swot' ELSE 'static' END AS model, CASE flag WHEN 'N' THEN 'opt' ELSE 'filt' END AS swot_filter, 'daily' AS temporal, avg(height) / 1000 AS observed_mae, avg(level * level) / 10 AS observed_rmse FROM vo WHERE flag <> 'R' GROUP BY flag)"


def _summary(spark, d):
    v = vobs(spark, d).where("flag <> 'R'")
    observed = v.groupBy("flag").agg((F.avg("height") / 1000).alias("observed_mae"), (F.avg(F.col("level") * F.col("level")) / 10).alias("observed_rmse")).select(
        F.when(F.col("flag") == "N", "swot").otherwise("static").alias("model"), F.when(F.col("flag") == "N", "opt").otherwise("filt").alias("swot_filter"),
        F.lit("daily").alias("temporal"), "observed_mae", "observed_rmse")
    return un.attribution_summary(_terms(spark, d), "lake", observed=observed)


@query("l4_attribution_summary", shape(with_(VOBS, CB, *PR, *WS, _WIDE, _OB, "ct AS (SELECT model, swot_filter, temporal, count(*) AS n_obs, count(DISTINCT lake) AS n_keys FROM p2 GROUP BY ALL)") + """
FINAL SELECT *, CASE WHEN observed_mae > 0 THEN sigma_total_median / observed_mae END AS ratio_mae, CASE WHEN observed_rmse > 0 THEN sigma_total_median / observed_rmse END AS ratio_rmse
FROM ct JOIN wd USING (model, swot_filter, temporal) LEFT JOIN ob USING (model, swot_filter, temporal)""", "model swot_filter temporal", "n_obs n_keys",
    " ".join(f"{m}_{s}" for m in _SH for s in ("mean", "median")) + " observed_mae observed_rmse ratio_mae ratio_rmse", 4))
def summary(spark, d):
    return rounded(_summary(spark, d), 4)


@query("l5_decompose", shape(with_(VOBS, CB, *PR, *WS, _WIDE, "ob AS (SELECT avg(level * level) AS r FROM vo)") + """
FINAL SELECT f.model, f.temporal, round(r, 1) AS total_rmse, round(r * f.wse_base_pct_median / 100, 1) AS wse_component, round(r * f.area_pct_median / 100, 1) AS area_component, round(r * f.wse_filt_pct_median / 100, 1) AS filtering_component,
 CASE WHEN f.temporal = 'discrete' THEN 0 ELSE round(r * f.wse_temporal_pct_median / 100, 1) END AS temporal_component FROM wd f, ob WHERE f.swot_filter = 'filt' AND EXISTS (SELECT 1 FROM wd o WHERE o.swot_filter = 'opt' AND o.model = f.model AND o.temporal = f.temporal)""",
    "model temporal", "", "total_rmse wse_component area_component filtering_component temporal_component"))
def decompose(spark, d):
    v = vobs(spark, d)
    s = un.attribution_summary(_terms(spark, d), "lake")
    r = v.agg(F.avg(F.col("level") * F.col("level")).alias("observed_rmse"))
    s = s.withColumn("observed_rmse", r.select("observed_rmse").scalar())
    return rounded(un.decompose(s, "filt", "opt"))
