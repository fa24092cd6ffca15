"""One small case for each finding of round 3 that was settled last; each failed before."""

import os

from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def _written(spark):
    """Tables in the shared folder."""
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {os.path.join(folder, n) for n in os.listdir(folder)}


def test_variants_write_no_copies_of_the_rows(spark):
    """all sixteen columns equal those of the long form, without a table of the rows for each filter."""
    from catalog.common import ORDER, obs
    from catalog.storage import mask
    from hydroseries.functions.keyed import checkpoint_dir
    from hydroseries.operators import storage as st
    checkpoint_dir(spark)
    rows = obs(spark, SMALL)
    long = st.storage_long(rows, "lake", "date", ORDER, mask())
    before = _written(spark)
    wide = st.storage_variants(rows, "lake", "date", ORDER, mask())
    assert max(spark.read.parquet(p).count() for p in _written(spark) - before) < rows.count() / 2
    ids = ["lake", "date", *ORDER]
    apart = long.groupBy(*ids).agg(*[F.max(F.when(F.col("filter") == k, F.col(f"{m}_{x}"))).alias(f"{m}_{k}_{x}") for m in st.MODELS for k in st.FILTERS for x in st.TIMES])
    names = [*ids, *[f"{m}_{k}_{x}" for m in st.MODELS for k in st.FILTERS for x in st.TIMES]]
    assert wide.columns == names and wide.count() == rows.count()
    values = [*ids, *[F.round(c, 2).alias(c) for c in names[len(ids):]]]
    assert wide.select(values).exceptAll(apart.select(values)).isEmpty()


def test_curves_on_wanted_days_need_no_daily_rows(spark):
    """curves are worked out where rows lie, from one row per key, and equal those on the daily grid; rows without a day do no harm."""
    from hydroseries.operators import adaptive as ad
    from hydroseries.operators import smooth as sm
    days = [(k, d) for k in range(4) for d in range(0, 700, 7 + 3 * k) if (d * 31 + k) % 5 and not (k == 2 and 200 < d < 330)]
    rows = spark.createDataFrame([(k, d, i, 50.0 + (d * 37 % 101) / 7, (d + k) % 3 != 0) for i, (k, d) in enumerate(days)], "k int, d int, o int, wse double, base boolean")
    rows = rows.withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d"))).drop("d")
    lost = rows.where("k = 1").limit(1).withColumns({"day": F.lit(None).cast("date"), "o": F.lit(-1)})
    cfg = ad.Config()
    got = ad._lines(rows.unionByName(lost), F.col("base"), ["k"], ["o"], cfg)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Generate") == 1
    grid = sm.on_grid(sm.per_day(rows.where("base"), ["k"], "day", "wse", ["o"]), ["k"], cfg.method, list(cfg.params))
    wanted = rows.select("k", F.datediff("day", F.lit("1970-01-01")).alias("n")).distinct()
    want = grid.where(F.col("gap") <= cfg.max_gap).join(wanted, ["k", "n"])
    pick = lambda d: sorted((r["k"], r["n"], r["curves"][0]) for r in d.collect())
    assert pick(got) == pick(want) and len(pick(got)) > 150


def test_known_size_saves_the_pass_over_keys(spark):
    """where no key is large, quantiles are one aggregation and one small table."""
    from hydroseries.functions.keyed import checkpoint_dir
    from hydroseries.functions.orderstats import quantiles
    checkpoint_dir(spark)
    rows = spark.range(90).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    before = _written(spark)
    got = quantiles(rows, "k", "v", {"m": 0.5}, largest=30)
    assert len(_written(spark) - before) == 1 and {r["k"]: r["m"] for r in got.collect()} == {0: 43.5, 1: 44.5, 2: 45.5}


def test_best_pass_writes_no_rows(spark):
    """each option of the cycle adjustment does its own work only; the median day comes with the means."""
    from catalog.common import QUERIES
    import catalog.outliers  # noqa: F401
    from hydroseries.functions.keyed import checkpoint_dir
    from hydroseries.operators import cycles as cy
    checkpoint_dir(spark)
    before = _written(spark)
    assert QUERIES["c25_best_pass"](spark, SMALL).count() > 0
    assert max(spark.read.parquet(p).count() for p in _written(spark) - before) < 2000
    before = _written(spark)
    rows = spark.createDataFrame([(1, 1, 4.0, "2024-01-01"), (1, 1, 6.0, "2024-01-04"), (1, None, 9.0, "2024-01-04"), (1, 2, 5.0, None)], "k int, cycle_id int, wse double, day string")
    assert [tuple(r) for r in cy.cycle_means(rows, "k").select("cycle_id", "cycle_level", "mid_day").collect()] == [(1, 5.0, 19724.5)]
    assert _written(spark) == before


def test_skill_is_worked_out_once_for_its_summary(spark):
    """a summary reads its rows several times, so the interpolation below it must not run each time."""
    from catalog.accuracy import _compare
    from hydroseries.functions.keyed import checkpoint_dir
    checkpoint_dir(spark)
    out = _compare(spark, SMALL)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 5
