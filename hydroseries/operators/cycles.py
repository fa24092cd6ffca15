"""Reducing differences between orbit passes within a cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries.functions.keyed import all_hold, attach, cut_lineage, day, holds, names
from hydroseries.functions.orderstats import quantiles
from hydroseries.operators.outliers import tukey


def cycle_means(df: DataFrame, keys, level="wse", cycle="cycle_id", t="day") -> DataFrame:
    """Option 1: mean level and median day of every cycle.

    One aggregation: a buffer of the median holds each calendar day of a cycle once, with its number of rows.
    """
    keys = names(keys)
    when = F.datediff(day(t), F.lit("1970-01-01"))
    found = df.groupBy(*keys, cycle).agg(F.avg(level).alias("cycle_level"), F.stddev_samp(level).alias("cycle_std"),
                                         F.percentile(when, F.lit(0.5)).cast("double").alias("mid_day"))
    return found.where(all_hold([F.col(c).isNotNull() for c in [*keys, cycle, "mid_day"]]))


def needs_adjustment(option1: DataFrame, keys) -> DataFrame:
    """Per key: the usual spread inside a cycle against the spread between cycles."""
    keys = names(keys)
    inner = quantiles(option1, keys, "cycle_std", {"intra_std": 0.5})
    outer = option1.groupBy(*keys).agg(F.stddev_samp("cycle_level").alias("inter_std"))
    return outer.join(inner, keys, "left").withColumn("adjust", holds(F.col("intra_std") > F.col("inter_std")))


def best_pass(df: DataFrame, verdict: DataFrame, keys, passes="pass_id", area="area_total") -> DataFrame:
    """Option 2: rows of the pass with the largest median area; all rows of keys whose cycles agree well."""
    keys = names(keys)
    few = attach(df, verdict.where("adjust").select(*keys), keys, "left_semi")
    areas = quantiles(few, [*keys, passes], area, {"_area": 0.5})
    best = areas.groupBy(*keys).agg(F.max_by(F.struct(F.col(passes).alias("p")), F.struct(F.col("_area"), -F.col(passes).cast("double"))).alias("_b"))
    judged = cut_lineage(verdict.select(*keys, "adjust").join(best.select(*keys, F.col("_b.p").alias("_best")), keys, "left"))
    return attach(df, judged, keys).where(~F.col("adjust") | holds(F.col(passes) == F.col("_best"))).select(*df.columns)


def without_pass_bias(df: DataFrame, verdict: DataFrame, keys, level="wse", passes="pass_id") -> DataFrame:
    """Option 3: rows with the pass bias removed in ``wse_adjusted``; keys whose cycles agree well keep their levels.

    The bias of a pass is its median level less the mean level of the key, so no row waits for that mean.
    """
    keys = names(keys)
    verdict = verdict.select(*keys, "adjust")
    mean = cut_lineage(df.groupBy(*keys).agg(F.avg(level).alias("_mean"), F.count(F.lit(1)).alias("_n")))
    largest = mean.agg(F.max("_n")).first()[0] or 0
    few = attach(df, verdict.where("adjust").select(*keys), keys, "left_semi")
    middle = quantiles(few, [*keys, passes], level, {"_mid": 0.5}, largest=largest)
    bias = cut_lineage(middle.join(mean, keys).select(*keys, passes, (F.col("_mid") - F.col("_mean")).alias("_bias")))
    adjusted = few.join(bias, [*keys, passes], "left").withColumn("wse_adjusted", F.col(level) - F.col("_bias"))
    changed = tukey(cut_lineage(adjusted.drop("_bias")), keys, "wse_adjusted", 3, 0.1, 0.9, largest=largest)
    calm = attach(df, verdict.where(~F.col("adjust")).select(*keys), keys, "left_semi")
    return changed.unionByName(calm.withColumn("wse_adjusted", F.col(level)))


def cycle_verdict(df: DataFrame, keys, level="wse", cycle="cycle_id", t="day") -> tuple[DataFrame, DataFrame]:
    """Cycle means and, per key, whether its passes need adjusting; both are written, as options 2 and 3 read them again."""
    option1 = cut_lineage(cycle_means(df, keys, level, cycle, t))
    return option1, cut_lineage(needs_adjustment(option1, keys))


def cycle_adjust(df: DataFrame, keys, level="wse", cycle="cycle_id", passes="pass_id", area="area_total",
                 t="day") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cycle means; rows of the best pass; rows with the pass bias removed.

    Keys whose cycles agree well keep all their rows unchanged in options 2 and 3.
    """
    keys = names(keys)
    option1, verdict = cycle_verdict(df, keys, level, cycle, t)
    return (option1.select(*keys, cycle, "cycle_level", "mid_day"), best_pass(df, verdict, keys, passes, area),
            without_pass_bias(df, verdict, keys, level, passes))
