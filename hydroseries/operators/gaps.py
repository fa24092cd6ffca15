"""How often a key is observed: gaps, retention, days per observation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroseries.functions.keyed import day, holds, known, names
from hydroseries.functions.orderstats import quantiles


def gaps(df: DataFrame, keys, t, valid: Column, exclude: Column | None = None) -> DataFrame:
    """Days to the next valid observation (only positive gaps).

    With ``exclude`` (an ice flag, say) a gap is left out when any flagged day lies
    in it, both ends included.
    """
    keys = names(keys)
    days = df.groupBy(*keys, day(t).alias("day")).agg(
        F.max(holds(valid).cast("int")).alias("_ok"),
        F.max(holds(exclude).cast("int") if exclude is not None else F.lit(0)).alias("_bad"))
    ordered = Window.partitionBy(*keys).orderBy("day")
    days = days.withColumn("_cum", F.sum("_bad").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    valid_days = days.where(F.col("_ok") == 1).select(
        *keys, "day", F.lead("day").over(ordered).alias("next_day"),
        (F.lead("_cum").over(ordered) - F.col("_cum") + F.col("_bad")).alias("_flagged"))
    return (valid_days.where(F.col("next_day").isNotNull() & (F.col("_flagged") == 0))
            .select(*keys, "day", "next_day", F.datediff("next_day", "day").alias("gap_days")))


def gap_summary(gap_rows: DataFrame, keys=None, column: str = "gap_days") -> DataFrame:
    keys = names(keys)
    mean = gap_rows.groupBy(*keys).agg(F.avg(column).alias("mean_gap"), F.count(F.lit(1)).alias("n_gaps"))
    mid = quantiles(gap_rows, keys, column, {"median_gap": 0.5})
    if keys:
        return mean.join(mid, keys)
    return mean.withColumn("median_gap", mid.select("median_gap").scalar())


def long_gaps(df: DataFrame, keys, t, limit: int = 95) -> DataFrame:
    """Flag per observed day: more than ``limit`` days since the previous one."""
    keys = names(keys)
    days = df.select(*keys, day(t).alias("day")).distinct()
    before = F.lag("day").over(Window.partitionBy(*keys).orderBy("day"))
    return days.select("*", holds(F.datediff("day", before) > limit).alias("exceeds"))


def retention(df: DataFrame, kept: Column, baseline: Column, keys=None, out: str = "retention_pct") -> DataFrame:
    n, base = F.count_if(holds(kept)), F.count_if(holds(baseline))
    return df.groupBy(*names(keys)).agg(
        n.alias("n_kept"), base.alias("n_baseline"),
        F.when(base > 0, n / base * 100).otherwise(F.lit(0.0)).alias(out))


def resolution_by_threshold(df: DataFrame, keys, abs_error, thresholds: Iterable[float | None],
                            free: Column | None = None, usable: Column | None = None, min_obs: int = 3) -> DataFrame:
    """Ice-free days per valid observation for a list of error limits (None = no limit).

    All limits are counted in one pass over the rows; only the per-key counts are
    spread over the limits.
    """
    keys, thresholds = names(keys), list(thresholds)
    free = F.lit(True) if free is None else holds(free)
    usable = F.lit(True) if usable is None else holds(usable)
    rows = df.where(free)

    def ok(limit):
        good = known(abs_error) & usable
        return good if limit is None else good & (F.col(abs_error) <= limit)

    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_days"), *[F.count_if(ok(x)).alias(f"_n{i}") for i, x in enumerate(thresholds)])
    items = F.array(*[F.struct(F.lit(float("inf") if x is None else float(x)).alias("threshold"),
                               F.col(f"_n{i}").alias("n")) for i, x in enumerate(thresholds)])
    long = counts.select("_days", F.explode(items).alias("_i")).select("_days", "_i.threshold", "_i.n")
    return (long.where(F.col("n") >= min_obs).groupBy("threshold")
            .agg((F.sum("_days") / F.sum("n")).alias("days_per_obs"), F.count(F.lit(1)).alias("n_keys"),
                 F.sum("n").alias("n_obs")))


def span_per_key(df: DataFrame, keys, t, min_obs: int = 2) -> DataFrame:
    keys = names(keys)
    out = df.groupBy(*keys).agg((F.datediff(F.max(day(t)), F.min(day(t))) + 1).alias("span_days"),
                                F.count(F.lit(1)).alias("n_obs"))
    return out.where(F.col("n_obs") >= min_obs).withColumn("days_per_obs", F.col("span_days") / F.col("n_obs"))


def resolution_by_span(df: DataFrame, keys, t, min_obs: int = 2) -> DataFrame:
    """Total observed span over total observations, pooled over keys."""
    return span_per_key(df, keys, t, min_obs).agg(
        (F.sum("span_days") / F.sum("n_obs")).alias("days_per_obs"), F.count(F.lit(1)).alias("n_keys"))


def key_success(df: DataFrame, keys, mask: Column) -> DataFrame:
    """Share of attempted keys with at least one accepted row."""
    per_key = df.groupBy(*names(keys)).agg(F.max(holds(mask).cast("int")).alias("_ok"))
    return per_key.agg(F.count(F.lit(1)).alias("n_attempted"), F.sum("_ok").alias("n_success"),
                       (F.avg("_ok") * 100).alias("success_pct"))
