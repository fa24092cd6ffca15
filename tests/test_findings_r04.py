"""One small case for each finding of round 4; each failed before."""

from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_input_errors_are_trimmed_strictly(spark):
    """a value above the percentile by rounding only is trimmed, as in the SQL."""
    from hydroseries.operators import accuracy as acc
    above = 0.09 + 2 ** -56
    assert above > 0.09
    rows = spark.createDataFrame([(1, v) for v in [0.01] * 50 + [0.09] * 45 + [above] * 5], "k int, e double")
    got = {r["subset"]: r["n"] for r in acc.input_uncertainties(rows, "k", None, {"a": ("e", F.lit(True))}, pct=90).collect()}
    assert got == {"a": 100, "a_no_outliers": 95}


def _written(spark):
    """Tables in the shared folder."""
    import os

    from hydroseries.functions.keyed import checkpoint_dir
    folder = checkpoint_dir(spark).removeprefix("file:")
    return {os.path.join(folder, n) for n in os.listdir(folder)}


def test_paired_tests_read_figures_of_one_model(spark):
    """the tests share one table of the figures of four variants, not all sixteen again and again."""
    import catalog.evaluation as ce
    before = _written(spark)
    out = ce.effects(spark, SMALL)
    written = [spark.read.parquet(p) for p in _written(spark) - before]
    figures = [t for t in written if "variant" in t.columns and "mae" in t.columns]
    assert out.count() == 8 and len(figures) == 1 and {r["model"] for r in figures[0].select("model").distinct().collect()} == {"swot"}
    assert "p68_abs_error" not in figures[0].columns


def test_figures_across_keys_are_worked_out_once(spark):
    """the summary reads figures of keys that were written once; pairs of a key are ordered in its own row, not by percentile buffers."""
    from catalog import evaluation as ce
    before = _written(spark)
    assert ce.across(spark, SMALL).count() == 128
    assert any({"variant", "p68_abs_error"} <= set(spark.read.parquet(p).columns) for p in _written(spark) - before)
    plan = ce._per_key(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "collect_list" in plan


def _plan(df):
    """The plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_ranges_move_days_not_windows(spark):
    """Days are shuffled by day and by key, whatever the lengths, and windows never; results equal a plain count over days."""
    from hydroseries.operators import changes as ch
    days = [0, 1, 4, 9, 10, 11, 25, 40]
    rows = spark.createDataFrame([(d, float(d * 7 % 11), None if d == 9 else float(d), float(d) if d % 2 else None) for d in days], "d int, v double, h double, s double")
    rows = rows.select((F.col("d") * 0 + 3).alias("lake"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).alias("date"), "v", "h", "s")
    out = ch.key_ranges(rows, "lake", "date", "v", "h", "h", "s", (3, 7, 39, 40), 50, number=F.col("lake"))
    plan = _plan(out)
    assert plan.count("Exchange") == 2 and "Join" not in plan
    one = {(r["length"], r["offset"]): r for r in ch.single_ranges(out, "lake").collect()}
    drawn = {(r["length"], r["offset"]) for r in ch.sample_windows(rows, "lake", "date", (3, 7, 39, 40), 50, number=F.col("lake")).collect()}

    def reach(values):
        values = [x for x in values if x is not None]
        return max(values) - min(values) if len(values) >= 2 else 0.0
    for length, offset in drawn:
        inside = [d for d in days if offset <= d < offset + length]
        assert ((length, offset) in one) == bool(inside)
        if inside:
            seen = [d for d in inside if d % 2]
            r = one[length, offset]
            assert (r["storage_range"], r["wse_range"], r["n_seen"]) == (reach([float(d * 7 % 11) for d in inside]), reach([None if d == 9 else float(d) for d in inside]), len(seen))
            assert r["seen_storage_range"] == reach([float(d) for d in seen]) and r["seen_wse_range"] == (reach([float(d) for d in seen if d != 9]) if len(seen) >= 2 else 0.0)
    assert {length for length, _ in one} == {3, 7, 39} and len(one) > 20
    stats = {r["length"]: r for r in ch.range_stats(out, "lake").collect()}
    assert stats[3]["n_windows"] == sum(1 for r in ch.single_ranges(out, "lake").where("length = 3").collect())


def test_anomalies_are_read_off_the_wide_rows(spark):
    """the long form writes no rows, and medians need no shuffle of volumes; they equal those of volumes worked out one by one."""
    from catalog.common import ORDER, obs
    from catalog.storage import mask
    from hydroseries.operators import storage as st
    rows = obs(spark, SMALL).cache()
    before = _written(spark)
    long = st.storage_long(rows, "lake", "date", ORDER, mask())
    assert max(spark.read.parquet(p).count() for p in _written(spark) - before) < rows.count() / 2
    par = st.parameters(rows, "lake", "date", ORDER, mask())
    plain = st.storage_discrete(rows, par, "lake", mask()).select("lake", "filter", "accepted", *ORDER, *[F.col(f"{m}_dis").alias(m) for m in st.MODELS])
    mid = plain.where("accepted").groupBy("lake", "filter").agg(*[F.median(m).alias(f"mid_{m}") for m in st.MODELS])
    want = plain.join(mid, ["lake", "filter"])
    both = long.join(want.drop("accepted"), ["lake", "filter", *ORDER])
    off = [F.max(F.abs(F.col(f"{m}_dis") - (F.col(m) - F.col(f"mid_{m}"))) / (1 + F.abs(F.col(m)))).alias(m) for m in st.MODELS]
    assert both.count() == long.count() and all(x is not None and x < 1e-9 for x in both.agg(*off).first())
