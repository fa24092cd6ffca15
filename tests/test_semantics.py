"""Hand-computed cases for the points where a careless rewrite gives other results."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroseries.functions import filters as f
from hydroseries.functions import orderstats as osx
from hydroseries.functions import special as sp
from hydroseries.functions.units import with_pct_errors
from hydroseries.operators import accuracy as acc
from hydroseries.operators import changes as ch
from hydroseries.operators import curves as cv
from hydroseries.operators import gaps as gp
from hydroseries.operators import interpolation as ip
from hydroseries.operators import matching as mt
from hydroseries.operators import outliers as ol
from hydroseries.operators import pixels as px
from hydroseries.operators import significance as sg
from hydroseries.operators import storage as st
from hydroseries.operators import uncertainty as un

D0 = dt.date(2024, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def series(spark, rows, cols="k string, date date, v double, o int"):
    return spark.createDataFrame([(k, day(n), float(v) if v is not None else None, i) for i, (k, n, v) in enumerate(rows)], cols)


def test_unknown_is_not_met_and_its_negation_is(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "x double")
    mask = f.all_of(F.nullif(F.col("x"), F.lit(float("nan"))) > 0)
    assert [r[0] for r in df.select(mask).collect()] == [True, False, False]
    assert df.where(~mask).count() == 2


def test_era_strict_and_inclusive(spark):
    df = spark.createDataFrame([(dt.date(2023, 7, d),) for d in (20, 21, 22)], "date date")
    assert [r[0] for r in df.select(f.era()).collect()] == [False, False, True]
    assert [r[0] for r in df.select(f.era(inclusive=True)).collect()] == [False, True, True]


def test_threshold_strict_and_inclusive(spark):
    df = spark.createDataFrame([(0.282,), (0.283,), (0.284,)], "swot_wse_abs_error double")
    assert [r[0] for r in df.select(f.idealized()).collect()] == [True, False, False]
    assert [r[0] for r in df.select(f.idealized(inclusive=True)).collect()] == [True, True, False]


def test_percent_error_needs_positive_truth(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 0.0), (2.0, None)], "swot_wsa double, wsa double")
    assert [r[0] for r in with_pct_errors(df).select("wsa_percentage_error").collect()] == [100.0, None, None]


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_are_exact_for_a_hot_key(spark, seed):
    rng = np.random.default_rng(seed)
    hot = np.concatenate([rng.standard_cauchy(4000), np.zeros(300), np.round(rng.normal(2300, 5, 3000), 2)])
    rows = [("hot", float(x)) for x in hot] + [(f"k{i}", float(x)) for i, x in enumerate(rng.normal(size=50))] + [("n", None), ("n", float("nan")), ("n", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in osx.quantiles(df, "k", "v", {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.68, "e": 1.0}).collect()}
    want = np.quantile(hot, [0, 0.01, 0.5, 0.68, 1])
    np.testing.assert_allclose([got["hot"][c] for c in "abcde"], want, rtol=1e-12, atol=1e-12)
    assert got["n"]["c"] == 7.0 and len(got) == 52


@pytest.mark.parametrize("kind", ["narrow", "tails", "ties", "scales"])
def test_quantiles_of_large_keys(spark, kind):
    rng = np.random.default_rng(8)
    n = 60_000
    x = {"narrow": 2300 + 0.4 * rng.random(n), "tails": rng.standard_cauchy(n) ** 3, "ties": np.round(rng.normal(size=n), 1),
         "scales": np.concatenate([rng.random(n // 2) * 1e-200, rng.random(n // 2) * 1e200 - 5e199])}[kind]
    df = spark.createDataFrame([("hot", float(v)) for v in x] + [("cold", 1.0), ("cold", 4.0)], "k string, v double").repartition(8)
    probs = {"a": 0.0, "b": 0.0001, "c": 0.25, "d": 0.5, "e": 0.9, "f": 0.99995, "g": 1.0}
    got = {r["k"]: r for r in osx.quantiles(df, "k", "v", probs).collect()}
    np.testing.assert_allclose([got["hot"][c] for c in probs], np.quantile(x, list(probs.values())), rtol=1e-9)
    assert got["cold"]["d"] == 2.5
    whole = osx.quantiles(df.where("k = 'hot'"), None, "v", probs).first()
    assert [whole[c] for c in probs] == [got["hot"][c] for c in probs]


def test_few_rows_of_a_large_key_are_ordered_together(spark):
    rng = np.random.default_rng(9)
    x = 2300 + 0.4 * rng.random(60_000)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    near = osx._intervals(df.select(F.col("v").alias("_v")), [], [0.5]).first()["_near"][0]
    assert ((x >= near["low"]) & (x <= near["high"])).sum() < 100
    rows = osx.ordered_totals(df, None, "v")
    assert rows.count() == len(np.unique(x))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_a" in plan and "windowspecdefinition(0" not in plan
    order = rows.orderBy("value").toPandas()
    assert (order["n_before"].to_numpy() == np.arange(len(order))).all()


def test_running_totals_follow_value_order(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=2000) * 10.0 ** rng.integers(-3, 4, 2000), 3)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    rows = sorted((r["value"], r["n_before"], r["n"]) for r in osx.ordered_totals(df, None, "v").collect())
    values, counts = np.unique(x, return_counts=True)
    assert [r[0] for r in rows] == list(values) and [r[2] for r in rows] == list(counts)
    assert [r[1] for r in rows] == list(np.concatenate([[0], np.cumsum(counts)[:-1]]))


def test_nearest_tie_takes_first_right_row(spark):
    left = series(spark, [("a", 10, 0)])
    right = series(spark, [("a", 8, 1), ("a", 12, 2), ("a", 8, 3), ("a", 30, 4)])
    out = mt.nearest_join(left, right, "k", "date", "date", "v", 3, order=["o"]).collect()
    assert len(out) == 1 and out[0]["matched"] == 1.0


def test_interpolation_uses_row_order_on_repeated_days(spark):
    src = series(spark, [("a", 0, 0), ("a", 0, 10), ("a", 4, 20), ("a", 4, 30)])
    tgt = series(spark, [("a", n, 0) for n in (-1, 0, 2, 4, 5)])
    got = {r["day"]: r["value"] for r in ip.interpolate(src, tgt, "k", "date", "v", ["o"]).collect()}
    assert got == {day(0): 10.0, day(2): 15.0, day(4): 30.0}


def test_gap_rules(spark):
    src = series(spark, [("a", 0, 0), ("a", 30, 1), ("a", 91, 2)])
    tgt = series(spark, [("a", n, 0) for n in (5, 29, 35, 60, 62, 90)])
    days = lambda **r: sorted((x["day"] - D0).days for x in ip.interpolate(src, tgt, "k", "date", "v", ["o"], **r).collect())
    assert days() == [5, 29, 35, 60, 62, 90]
    assert days(max_gap=30, gap_rule="either_side") == [5, 29]
    assert days(max_gap=29, gap_rule="proximity_if_long") == [5, 29, 35, 62, 90]
    assert days(max_gap=61, gap_rule="proximity_if_long") == [5, 29, 35, 60, 62, 90]


def test_gap_with_ice_at_an_endpoint_is_left_out(spark):
    rows = [("a", 0, 1), ("a", 5, 1), ("a", 9, 1), ("a", 20, 1)]
    df = series(spark, rows).withColumn("ice", F.col("date") == F.lit(day(5)))
    assert [r["gap_days"] for r in gp.gaps(df, "k", "date", F.lit(True), F.col("ice")).collect()] == [11]


def test_drop_in_gaps_keeps_edges(spark):
    base = series(spark, [("a", 0, 1), ("a", 96, 1), ("a", 191, 1)])
    ev = series(spark, [("a", n, 1) for n in (0, 1, 95, 96, 100, 191, 300)])
    kept = sorted((r["date"] - D0).days for r in ol.drop_in_gaps(ev, base, "k", "date", 95).collect())
    assert kept == [0, 96, 100, 191, 300]


def test_ice_outliers_reference_groups(spark):
    cols = "k string, pass_id int, crid_scenario string, ice_clim_f int, wse double, area_total double"
    free = [("a", 1, "x", 0, v, 1.0) for v in (1.0, 2.0, 3.0)] + [("a", 2, "x", 1, 50.0, 1.0), ("a", 2, "x", 1, 60.0, 1.0)]
    ice = [("a", 1, "x", 2, 40.0, 1.0), ("a", 2, "x", 2, 40.0, 1.0), ("a", 3, "x", 2, 40.0, 1.0), ("a", 1, "x", None, 2.0, 1.0), ("b", 1, "x", None, 9.0, 1.0), ("b", 1, "x", 2, 99.0, 1.0)]
    df = spark.createDataFrame(free + ice, cols)
    out = ol.ice_outliers(df, "k", True, False, 0, 0, 1, "upper", "wse")
    got = sorted((r["k"], r["pass_id"], r["wse"]) for r in out.where("ice_clim_f = 2 OR ice_clim_f IS NULL").collect())
    assert got == [("a", 2, 40.0), ("a", 3, 40.0), ("b", 1, 9.0), ("b", 1, 99.0)]
    with pytest.raises(ValueError):
        ol.tukey(df, "k", "wse", lo=0.9, hi=0.1)


def test_curve_on_high_levels_and_exact_line(spark):
    h = np.linspace(2299, 2301, 41)
    bowl = [("bowl", float(x), float(2 + 3 * (x - 2300) + 0.7 * (x - 2300) ** 2)) for x in h]
    line = [("line", float(x), 5 + 2 * float(x)) for x in range(10)]
    got = {r["k"]: r for r in cv.fit_curve(spark.createDataFrame(bowl + line, "k string, x double, y double"), "k", "x", "y", p_value=True).collect()}
    assert got["line"]["model_type"] == "linear" and got["bowl"]["model_type"] == "quadratic"
    assert got["line"]["c1"] == pytest.approx(2) and got["bowl"]["c2"] == pytest.approx(0.7, rel=1e-6)
    y = got["bowl"]["c0"] + 2300.5 * (got["bowl"]["c1"] + 2300.5 * got["bowl"]["c2"])
    assert y == pytest.approx(2 + 1.5 + 0.7 * 0.25, abs=1e-6) and got["bowl"]["significant"]


def test_storage_is_the_hundred_point_trapezoid(spark):
    df = spark.createDataFrame([(-2.0,), (0.3,), (4.0,), (None,)], "h double")
    got = [r[0] for r in df.select(st.storage_above(F.col("h"), F.lit(-1.0), F.lit(5.0), F.lit(2.0), F.lit(0.3))).collect()]
    for h, v in zip((0.3, 4.0), got[1:3]):
        x = np.linspace(-1, h, 100)
        assert v == pytest.approx(np.trapezoid(5 + 2 * x + 0.3 * x * x, x) * 1e6 / 1233.48, rel=1e-12)
    assert got[0] == 0.0 and got[3] is None


def test_spread_uses_the_stated_degrees_of_freedom(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "e double")
    assert acc.basic_metrics(df, "e").first()["std_error"] == 1.0
    assert acc.summarize(df, ["e"], 1).first()["std"] == pytest.approx(math.sqrt(2))


def test_missing_height_gives_no_shares_or_zero_shares(spark):
    df = spark.createDataFrame([("a", None, 10.0, 1.0)], "k string, h double, area double, level double")
    combo = [un.combo("swot", "opt", "discrete", 0.1, 0, 0, 5)]
    plain = un.propagate(df, combo, "k", None, "h", "area", "level").first()
    ranges = spark.createDataFrame([("a", "opt", 2.0)], "k string, swot_filter string, storage_range double")
    norm = un.propagate(df, combo, "k", ranges, "h", "area", "level").first()
    assert plain["wse_total_pct"] is None and norm["wse_total_pct"] == 0.0 and plain["height_weight"] is None


def test_signed_rank_known_values(spark):
    tails = spark.createDataFrame([(0.632, 10.0, 8.0, True), (0.0, 3.0, 0.0, True), (0.999, 5000.0, 1e6, False), (-0.01, 100_000.0, 2.4e9, False), (1.0, 9.0, 22.5, True), (0.5, 2.0, 1.0, True)], "r double, n double, w double, e boolean")
    got = tails.select(sp.pearson_p(F.col("r"), F.col("n")), sp.signed_rank_p(F.col("w"), F.col("n"), F.lit(0.0), F.col("e")), sp.log_gamma(F.col("n"))).collect()
    assert got[0][0] == pytest.approx(0.05, abs=5e-4) and got[0][1] == pytest.approx(0.048828125)
    assert [r[0] for r in got[1:3]] == pytest.approx([1.0, 0.0]) and got[3][0] == pytest.approx(math.erfc(math.sqrt(99_998 / (1 - 1e-4)) / 100 / math.sqrt(2)), rel=1e-3) and got[4][0] == 0 and got[5][0] == 1
    assert got[1][1] == 0.25 and got[4][1] == 1.0 and got[5][1] == 1.0
    z = abs(2.4e9 - 1e5 * (1e5 + 1) / 4) / math.sqrt(1e5 * (1e5 + 1) * (2e5 + 1) / 12)
    assert got[3][1] == pytest.approx(math.erfc(z), rel=1e-9, abs=1e-300)
    assert [r[2] for r in got] == pytest.approx([math.lgamma(x) for x in (10, 3, 5000, 100_000, 9, 2)], rel=1e-12)
    x = [0.0, 0.1, 1.0, 2.999, 3.0, 5.0, 12.0]
    erfc = spark.createDataFrame([(v,) for v in x], "x double").select(sp.erfc(F.col("x"))).collect()
    np.testing.assert_allclose([r[0] for r in erfc], [math.erfc(v) for v in x], rtol=1e-9)
    rows = [(i, c, float(v)) for i, (a, b) in enumerate([(125, 110), (115, 122), (130, 125), (140, 120), (140, 140), (115, 124), (140, 123), (125, 137), (140, 135), (135, 145)])
            for c, v in (("a", a), ("b", b))]
    out = sg.wilcoxon(spark.createDataFrame(rows, "id int, cat string, v double"), "id", "cat", [("a", "b")], ["v"]).first()
    assert (out["w"], out["n_used"], out["n_zero"]) == (18.0, 9, 1)
    assert out["w_plus"] + out["w_minus"] == 45.0 and out["significance"] == "ns"


def test_result_does_not_depend_on_shuffle_partitions(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(f"k{i % 7}", float(x)) for i, x in enumerate(rng.normal(size=500))], "k string, v double")
    seen = set()
    for n in ("1", "5", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(sorted((r["k"], r["q"]) for r in osx.quantiles(df, "k", "v", {"q": 0.3}).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(seen) == 1


def test_sliding_windows_equal_the_paired_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(k, day(int(n)), float(v) if i % 7 else None, float(v) * 2, float(v) if i % 3 == 0 else None) for k, span in (("a", 90), ("b", 12), ("c", 2))
            for i, (n, v) in enumerate(zip(rng.integers(0, span, 60), rng.normal(size=60)))]
    df = spark.createDataFrame(rows, "k string, date date, v double, h double, s double")
    lengths = (3, 7, 30)
    want = ch.window_ranges(df, ch.sample_windows(df, "k", "date", lengths, None), "k", "date", "v", "h", "h", "s")
    got = ch.all_window_ranges(df, "k", "date", "v", "h", "h", "s", lengths)
    key = lambda t: sorted(tuple(r[c] for c in sorted(want.columns)) for r in t.collect())
    assert key(got) == key(want) and got.count() > 100


def test_exclusion_finds_ids_anywhere_in_a_text(spark):
    texts = ["site_7420_daily.csv", "742", "x7421y", "ab", "", None, "é742é"]
    ids = ["742", "420_", "b", None, "longer than any of the texts here"]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "file string, _id int")
    left = mt.exclude_by_substring(df, spark.createDataFrame([(i,) for i in ids], "id string"), "file", "id").collect()
    assert {r["_id"] for r in left} == {i for i, t in enumerate(texts) if t is None or not any(x in t for x in ids if x)}
    assert mt.exclude_by_substring(df, spark.createDataFrame([], "id string"), "file", "id").count() == len(texts)


def test_buckets_are_merged_in_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(a), float(2000 - a), True) for k, low, high in (("narrow", 900, 1000), ("wide", 0, 2000)) for a in rng.uniform(low, high, 800)]
    df = spark.createDataFrame(rows, "k string, b3 double, b8 double, clear_mask boolean")
    got = {r["k"]: r["threshold"] for r in px.otsu(df, ("k",)).collect()}
    for k in ("narrow", "wide"):
        v = np.array([a - 1000 for kk, a, _, _ in rows if kk == k])
        width = 2
        while np.floor(v.max() / width) - np.floor(v.min() / width) >= 255:
            width *= 2
        bins = np.floor(v / width)
        best = max((((v[bins <= b] - v.mean()).sum() ** 2 / (bins <= b).sum() + ((v[bins > b] - v.mean()).sum() ** 2 / (bins > b).sum() if (bins > b).any() else 0), v[bins == b].mean()) for b in np.unique(bins)))
        assert got[k] == pytest.approx(best[1])
    assert width == 8
