"""One small case for each finding of round 3 that was settled later; each failed before."""

from fractions import Fraction

from pyspark.sql import functions as F


def _exact(points):
    """c0, c1, c2 of the least-squares parabola in rational numbers."""
    xs, ys, n = [Fraction(x) for x, _ in points], [Fraction(y) for _, y in points], len(points)
    mx, my = sum(xs) / n, sum(ys) / n
    u, w = [x - mx for x in xs], [y - my for y in ys]
    s2, s3, t1 = sum(a * a for a in u), sum(a ** 3 for a in u), sum(a * b for a, b in zip(u, w))
    q = [a * a - s3 / s2 * a - s2 / n for a in u]
    c = sum(a * b for a, b in zip(q, w)) / sum(a * a for a in q)
    b = t1 / s2 - c * s3 / s2
    return [float(v) for v in (my - c * s2 / n - b * mx + c * mx * mx, b - 2 * c * mx, c)]


def test_equal_values_are_flat_wherever_their_rows_lie(spark):
    """The mean of equal numbers differs from them by rounding; that must not pass for a slope or a correlation."""
    from hydroseries.operators.curves import fit_curve
    cases = [(k, 10.0 + i, 0.1 + 0.7 * k) for k in range(40) for i in range(3 + k % 5)]
    rows = spark.createDataFrame(cases, "k int, h double, a double").repartition(5, "h")
    up, turned = fit_curve(rows, "k", "h", "a").collect(), fit_curve(rows, "k", "a", "h", degrees=(2,)).collect()
    assert all(r["r"] is None and r["model_type"] == "linear" and r["rmse"] == 0 and r["c1"] == r["c2"] == 0 for r in up)
    assert all(r["r"] is None and r["c1"] == r["c2"] == 0 for r in turned)


def test_parabola_of_values_close_to_each_other(spark):
    """coefficients keep their digits where most x lie close together."""
    from hydroseries.operators.curves import fit_curve
    points = [(61.0 + 0.0003 * i + 0.000075 * i * i, 3.0 * (i % 4) - 11.5 + 0.01 * i) for i in range(8)] + [(100.0, 7.25)]
    rows = spark.createDataFrame(points, "x double, y double").withColumn("k", F.lit(1)).repartition(3)
    got = fit_curve(rows, "k", "x", "y", degrees=(2,)).first()
    assert all(abs(got[c] - e) <= 1e-10 * abs(e) for c, e in zip(("c0", "c1", "c2"), _exact(points)))


def _pixels(spark):
    """Two scenes of a lake with land and water, and one of the other lake that is mostly cloud."""
    index = [-600 + 7 * (i % 23) for i in range(90)] + [300 + 5 * (i % 31) for i in range(60)]
    rows = [(lake, i, (1000 + v) / 2.0, (1000 - v) / 2.0, lake == 1 or i % 50 == 0) for lake in (1, 2) for i, v in enumerate(index)]
    out = spark.createDataFrame(rows, "lake_id int, i int, b3 double, b8 double, clear_mask boolean")
    return out.withColumns({"cloud_mask": ~F.col("clear_mask"), "area_m2": F.lit(1.0)}), index


def test_levels_need_no_row_for_each_bin(spark):
    """F2, F8: 200 rows for each image were sorted and spilled; the levels stay those of the definition."""
    from hydroseries.operators import pixels as px
    images, index = _pixels(spark)
    out = px.water_levels(images, "lake_id")
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["lake_id"]: r for r in out.collect()}
    for r in got.values():
        k, h = int((r["threshold"] + 1000) / 10), [0] * 200
        for v in index:
            h[min(int((v + 1000) // 10), 199)] += 1
        land, water = h[:k], h[k + 1:199]
        peak, far = land.index(max(land)), water.index(max(water)) + 1
        start = max(peak - 1, 1)

        def near(side, top):
            gaps = [abs(c - (top - (top - h[k]) * 0.9)) for c in side]
            return gaps.index(min(gaps))
        assert r["land_level"] == (near(land[start:k - 1], max(land)) + peak) * 10 - 995
        assert r["water_level"] == (near(water[:far], max(water)) + k) * 10 - 995


def test_coverage_leaves_out_images_not_pixels(spark):
    """pixels are not shuffled to meet their image's coverage; images below the limit are still left out."""
    from hydroseries.operators import pixels as px
    images, _ = _pixels(spark)
    out = px.water_series(images, ("lake_id",), 5)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 4
    assert [(r["lake_id"], r["coverage"]) for r in out.collect()] == [(1, 100.0)]
