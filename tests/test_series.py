"""Smoothing against its definition, and the adaptive filter on planted series."""

import dataclasses
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroseries.operators import adaptive as ad
from hydroseries.operators import smooth as sm

RNG = np.random.default_rng(11)
START = dt.date(2024, 1, 1)


def savgol_by_hand(y, window, order):
    """Polynomial fits of NumPy over each window; windows at the ends keep inside."""
    n = len(y)
    if window >= n:
        window = n // 2 * 2 + 1
    if window <= order:
        window = order + 2 if order % 2 else order + 3
    if window > n:
        return [None] * n
    out = []
    for i in range(n):
        a = min(max(i - window // 2, 0), n - window)
        x = np.arange(a, a + window) - i
        out.append(np.polyval(np.polyfit(x, y[a:a + window], order), 0))
    return out


def median_by_hand(y, window):
    n = len(y)
    window += window % 2 == 0
    if window >= n:
        window = n // 2 * 2 + 1
    padded = np.pad(y, window // 2)
    return [float(np.median(padded[i:i + window])) for i in range(n)]


def irregular():
    """Series of many lengths, with gaps and repeated days: key, day, value, row number."""
    rows = []
    for key, n, span in (("a", 60, 200), ("b", 1, 5), ("c", 2, 6), ("d", 3, 5), ("e", 9, 19), ("f", 9, 20), ("g", 20, 31), ("h", 25, 33), ("i", 2, 2), ("j", 4, 3)):
        days = np.sort(RNG.integers(0, span, n))
        rows += [(key, int(x), float(v), i) for i, (x, v) in enumerate(zip(days, RNG.normal(size=n), strict=True))]
    return rows


@pytest.mark.parametrize("method,by_hand", [("savgol", savgol_by_hand), ("median", median_by_hand)])
def test_smoothing_on_the_daily_grid(spark, method, by_hand):
    rows = irregular()
    table = spark.createDataFrame([(k, START + dt.timedelta(days=x), v, i) for k, x, v, i in rows], "k string, date date, v double, o int")
    wanted = [(k, START + dt.timedelta(days=x)) for k in "abcdefghij" for x in range(-3, 210)] + [("none", START)]
    sets = sm.default_sets(method)
    got = {(r["k"], (r["day"] - START).days, r["curve"]): r["smoothed"] for r in sm.smooth(table, "k", "date", "v", method, at=spark.createDataFrame(wanted, "k string, date date"), order=["o"]).collect()}
    assert len(got) == 10 * 213 * len(sets)
    for key in "abcdefghij":
        own = [(x, v) for k, x, v, _ in rows if k == key]
        days = np.array(sorted({x for x, _ in own}))
        first, last = ([next(v for x, v in seq if x == d) for d in days] for seq in (own, own[::-1]))
        grid = np.arange(days[0], days[-1] + 1)
        y = np.empty(len(grid))
        for i, d in enumerate(days):
            y[d - days[0]] = last[i]
            if i + 1 < len(days):
                gap = np.arange(d + 1, days[i + 1])
                y[gap - days[0]] = last[i] + (first[i + 1] - last[i]) * (gap - d) / (days[i + 1] - d)
        for c, params in enumerate(sets):
            line = by_hand(y, **params)
            for x in range(-3, 210):
                want = line[min(max(x - days[0], 0), len(grid) - 1)]
                assert got[key, x, c] == (want if want is None else pytest.approx(want, abs=1e-7)), (key, x, params)


def test_smoothing_shuffles_by_key_and_runs_no_python(spark):
    table = spark.createDataFrame([("a", START, 1.0)], "k string, date date, v double")
    plan = sm.smooth(table, "k", "date", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError):
        sm.smooth(table, "k", "date", "v", "wavelet")


def test_smooth_reduces_repeated_days(spark):
    y = np.cumsum(RNG.normal(size=60))
    rows = [("a", START + dt.timedelta(days=int(i)), float(v), i) for i, v in enumerate(y)] * 3
    df = spark.createDataFrame(rows, "k string, date date, v double, o int")
    got = sm.smooth(df, "k", "date", "v", "savgol", [{"window": 11, "order": 3}], order=["o"]).orderBy("day").collect()
    np.testing.assert_allclose([r["smoothed"] for r in got], savgol_by_hand(y, 11, 3), atol=1e-8)


def lake(name, n=40, spikes=(), seed=0, spans=800):
    rng = np.random.default_rng(seed)
    days = np.sort(rng.choice(spans, n, replace=False))
    level = 100 + 2 * np.sin(days / 58) + rng.normal(0, 0.05, n)
    for i in spikes:
        level[i] += 8
    return [(name, dt.date(2023, 8, 1) + dt.timedelta(days=int(x)), float(v), float(0.1), float(0.02), None, 0, 0, 0, "PIC2", int(i % 3), float(5 + v / 100), i)
            for i, (x, v) in enumerate(zip(days, level))]


COLS = ("lake string, date date, swot_wse double, swot_wse_std double, swot_wse_u double, swot_xtrk_dist double, swot_xovr_cal_q int, "
        "swot_quality_f int, swot_ice_clim_f int, swot_crid string, swot_pass_id int, swot_wsa double, row_no int")


SPIKES = (15, 52, 90, 127, 163)


def planted(spark):
    rows = lake("clean", seed=1) + lake("spiky", n=200, spikes=SPIKES, seed=2) + lake("thin", n=4, seed=3)
    rows += [("empty", dt.date(2024, 1, i + 1), None, 0.1, 0.02, None, 0, 0, 0, "PIC2", 1, 1.0, i) for i in range(6)]
    return spark.createDataFrame(rows, COLS)


def test_adaptive_filter_removes_planted_spikes(spark):
    rows, status = ad.adaptive_filter(planted(spark), "lake")
    kept = {(r["lake"], r["row_no"]) for r in rows.collect()}
    codes = {r["lake"]: (r["n_round1"], r["n_round2"], r["status"]) for r in status.collect()}
    assert not {("spiky", i) for i in SPIKES} & kept
    assert sum(k == "clean" for k, _ in kept) >= 30 and sum(k == "spiky" for k, _ in kept) >= 150
    assert codes["thin"] == (-1, -2, "fail") and codes["empty"] == (-9, -9, "no data") and codes["clean"][2] == "success"


def test_gaps_may_be_refused(spark):
    df = planted(spark).where("lake IN ('clean', 'spiky')")
    strict = dataclasses.replace(ad.Config(), allow_major_gap=False, max_gap=60, min_span=365)
    days = {k: sorted(r["date"].toordinal() for r in df.where(F.col("lake") == k).select("date").distinct().collect()) for k in ("clean", "spiky")}
    codes = {r["lake"]: r["n_round1"] for r in ad.adaptive_filter(df, "lake", cfg=strict)[1].collect()}
    for k, d in days.items():
        if max(np.diff(d)) > 60:
            assert codes[k] == -1
    assert codes["spiky"] > 0


def test_flag_column(spark):
    out = ad.with_adaptive_flag(planted(spark), "lake").groupBy("lake", "adaptive_filter").count().collect()
    got = {(r["lake"], r["adaptive_filter"]): r["count"] for r in out}
    assert got[("thin", 1)] == 4 and got[("empty", 1)] == 6 and got[("clean", 0)] >= 30
    assert sum(got.values()) == 250


def test_full_data_and_baseline_only(spark):
    df = planted(spark).where("lake = 'clean'")
    rows, status = ad.adaptive_filter(df, "lake", cfg=dataclasses.replace(ad.Config(), low_pass=False))
    assert rows.count() == 40 and status.first()["status"] == "heuristic baseline"
