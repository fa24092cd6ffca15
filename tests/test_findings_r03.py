"""One small case for each finding of round 3 that was settled; each failed before."""

import random
import time

from pyspark.sql import functions as F


def test_key_named_like_an_inner_column(spark):
    """ice_outliers groups by ``_p``, a name that the quantiles used themselves."""
    from hydroseries.functions.orderstats import quantiles
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "_p string, v double")
    assert {r["_p"]: r["m"] for r in quantiles(rows, "_p", "v", {"m": 0.5}).collect()} == {"a": 2.0, "b": 5.0}


def test_few_large_keys_are_not_sent_to_few_tasks(spark):
    """Rows meet the intervals of a few large keys by broadcast; results stay exact beside small keys."""
    from hydroseries.functions import orderstats as o
    rows = spark.range(70_000).select(F.when(F.col("id") < 60_000, F.col("id") % 2).otherwise(2).alias("k"), F.pmod(F.col("id") * 7919, F.lit(65_537)).cast("double").alias("v"))
    plan = o._large_quantiles(rows.withColumnRenamed("v", "_v"), ["k"], [0.5], {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    got = {r["k"]: (r["a"], r["b"]) for r in o.quantiles(rows, "k", "v", {"a": 0.25, "b": 0.9}).collect()}
    want = {r["k"]: tuple(r["q"]) for r in rows.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.9))).alias("q")).collect()}
    assert got == want
    totals = o.ordered_totals(rows, "k", "v")
    assert totals.where("n_before + n > n_total").isEmpty()
    assert {r["k"]: r["c"] for r in totals.groupBy("k").agg(F.sum("n").alias("c")).collect()} == {0: 30_000, 1: 30_000, 2: 10_000}


def test_values_that_differ_by_rounding_share_the_limit(spark):
    """a difference in the last place of 0.06 must not decide whether a row stays."""
    from hydroseries.operators.outliers import trim_abs
    values = [0.08 - 0.02, 0.07 - 0.01, 0.09 - 0.03, 0.06, 0.06 + 1e-17, 0.1 - 0.04]
    rows = spark.createDataFrame([("x", v) for v in values], "k string, v double")
    assert trim_abs(rows, "v", 50, "k").count() == len(values)


def test_tail_probabilities_of_many_keys(spark):
    """3,000 probabilities within seconds (they took more than a minute)."""
    from hydroseries.functions.special import pearson_p
    rng = random.Random(1)
    rows = spark.createDataFrame([(rng.uniform(-0.2, 0.2), float(rng.randint(300, 900))) for _ in range(3000)], "r double, n double").repartition(4).cache()
    rows.count()
    start = time.time()
    assert rows.select(pearson_p(F.col("r"), F.col("n")).alias("p")).where("p >= 0 AND p <= 1").count() == 3000
    assert time.time() - start < 20


def test_rows_are_shuffled_before_they_are_expanded(spark):
    """sixteen columns are compared per key with one shuffle, which lies below the expansion."""
    from hydroseries.operators import evaluate as ev
    from hydroseries.operators.storage import FILTERS, MODELS, TIMES
    names = [f"{m}_{k}_{x}" for m in MODELS for k in FILTERS for x in TIMES]
    rows = spark.range(200).select((F.col("id") % 5).alias("lake"), *[F.col("id").cast("double").alias(f"storage_anomaly_{k}") for k in FILTERS],
                                   *[(F.col("id") * (1 + i / 10)).alias(n) for i, n in enumerate(names)])
    mask = {k: F.lit(True) for k in FILTERS}
    out = ev.evaluate_daily(rows, "lake", mask, True)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    apart = ev.evaluate_variants(ev.variant_pairs(rows, "lake", mask), "lake", True)
    pick = lambda d: sorted((r["lake"], r["variant"], r["n"], r["p68_abs_error"], r["storage_range"]) for r in d.collect())
    assert pick(out) == pick(apart) and len(pick(out)) == 80


def test_expanded_windows_are_not_broadcast(spark):
    """The plan takes expanded windows for small; they must not be collected for a broadcast."""
    from hydroseries.operators import changes as ch
    rows = spark.range(400).select((F.col("id") % 2).alias("lake"), F.expr("date_add(DATE '2020-01-01', CAST(id AS INT))").alias("date"), F.col("id").cast("double").alias("v"))
    out = ch.window_ranges(rows, ch.sample_windows(rows, "lake", "date", n=5), "lake", "date", "v", "v", "v", "v")
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("n_seen > length").isEmpty()


def test_differences_that_differ_by_rounding_are_ties(spark):
    """0.3 - 0.2, 0.2 - 0.1 and 0.1 - 0 are one tie, and 0.1 + 0.2 - 0.3 is no difference."""
    from hydroseries.operators.significance import signed_ranks
    pairs = [(0.3, 0.2), (0.2, 0.1), (0.1, 0.0), (0.1 + 0.2, 0.3)]
    rows = spark.createDataFrame([(i, c, v) for i, p in enumerate(pairs) for c, v in zip("ab", p)], "id int, c string, m double")
    got = signed_ranks(rows, "id", "c", [("a", "b")], ["m"]).first()
    assert (got["n_zero"], got["n_used"], got["w_plus"], got["tie_term"]) == (1, 3, 6.0, 24.0)


def test_equal_cuts_go_to_the_larger_value(spark):
    """pixels lie evenly around a middle, so both cuts are equally good; rounding must not choose."""
    from hydroseries.operators.pixels import otsu
    middle = [7.3 + 0.37 * i for i in range(60)]
    rows = spark.createDataFrame([(i, (1000 + m + x) / 2, (1000 - m - x) / 2, True) for i, m in enumerate(middle) for x in (-11.1, 0.0, 11.1)],
                                 "image int, b3 double, b8 double, clear_mask boolean")
    assert all(abs(r["threshold"] - middle[r["image"]]) < 1e-6 for r in otsu(rows, "image").collect())
