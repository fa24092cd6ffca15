"""The tables behind box plots, distribution curves, histograms and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydroseries.functions.keyed import attach, known, names
from hydroseries.functions.orderstats import ordered_totals, quantiles


def box_stats(df: DataFrame, keys, value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (last values within ``reach`` quartile distances) and outlier count."""
    keys = names(keys)
    rows = df.where(known(value)).select(*keys, F.col(value).cast("double").alias("_v"))
    q = quantiles(rows, keys, "_v", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    joined = attach(rows, q, keys)
    width = (F.col("q75") - F.col("q25")) * reach
    inside = (F.col("_v") >= F.col("q25") - width) & (F.col("_v") <= F.col("q75") + width)
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), *[F.first(c).alias(c) for c in ("q25", "median", "q75")],
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"), F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))


def ecdf(df: DataFrame, value: str, keys=None) -> DataFrame:
    """Share (%) of values at or below each distinct value."""
    t = ordered_totals(df, keys, value)
    return t.select(*names(keys), "value", ((F.col("n_before") + F.col("n")) / F.col("n_total") * 100).alias("cdf_pct"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, keys=None, density: bool = False) -> DataFrame:
    """Equal bins between two bounds, the last one closed; with ``density`` the bars integrate to one."""
    keys = names(keys)
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - F.lit(float(low))) / F.lit(width)), F.lit(bins - 1))
    rows = df.where(known(value) & F.col(value).between(low, high))
    out = rows.groupBy(*keys, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    out = out.withColumns({"bin_low": F.lit(float(low)) + F.col("bin") * width, "bin_high": F.lit(float(low)) + (F.col("bin") + 1) * width})
    if density:
        total = F.sum("n").over(Window.partitionBy(*(keys or [F.lit(0)])))
        out = out.withColumn("density", F.col("n") / (total * width))
    return out


def binned_mean(df: DataFrame, x: str, y: str, width: float, min_n: int = 10, keys=None) -> DataFrame:
    """Mean of ``y`` per step of ``x``; thin bins are left out."""
    rows = df.where(known(x) & known(y))
    out = rows.groupBy(*names(keys), F.floor(F.col(x) / width).alias("bin")).agg(
        F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= min_n)
