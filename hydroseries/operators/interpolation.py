"""Linear interpolation in time, sampling error and daily pairs.

All ordered work happens on the day grain: rows are reduced to one row per
(key, day) with map-side combine, so a window over a key sees at most one row per
calendar day however many rows the key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroseries.functions.keyed import day, days_between, holds, known, names


def flag_rows(df: DataFrame, keys, t, v, source: Column, target: Column, order=None) -> DataFrame:
    """Rows marked as source (has a value to interpolate from) and/or target."""
    keys = names(keys)
    tie = F.struct(*[F.col(c) for c in (names(order) or [v])])
    is_source = holds(source) & known(v)
    return (df.select(*keys, day(t).alias("day"), F.when(is_source, F.col(v).cast("double")).alias("_v"),
                      F.when(is_source, tie).alias("_o"), is_source.cast("long").alias("_s"),
                      holds(target).cast("long").alias("_g"))
            .where(((F.col("_s") + F.col("_g")) > 0) & F.col("day").isNotNull()))


def _union_rows(src: DataFrame, tgt: DataFrame, keys: list[str], t, v, order) -> DataFrame:
    left = flag_rows(src, keys, t, v, F.lit(True), F.lit(False), order)
    tie_type = left.schema["_o"].dataType
    right = tgt.select(*keys, day(t).alias("day"), F.lit(None).cast("double").alias("_v"),
                       F.lit(None).cast(tie_type).alias("_o"), F.lit(0).cast("long").alias("_s"),
                       F.lit(1).cast("long").alias("_g")).where(F.col("day").isNotNull())
    return left.unionByName(right)


def day_brackets(rows: DataFrame, keys) -> DataFrame:
    """Per (key, day): neighbouring source days with their values, plus per-key counts."""
    keys = names(keys)
    grid = rows.groupBy(*keys, "day").agg(
        F.sum("_s").alias("n_source"), F.sum("_g").alias("n_target"),
        F.min_by("_v", "_o").alias("v_first"), F.max_by("_v", "_o").alias("v_last"))
    source_day = F.when(F.col("n_source") > 0, F.col("day"))
    past = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    future = Window.partitionBy(*keys).orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return grid.select(
        "*",
        F.last(source_day, ignorenulls=True).over(past).alias("prev_day"),
        F.last("v_last", ignorenulls=True).over(past).alias("prev_value"),
        F.last(source_day, ignorenulls=True).over(future).alias("next_day"),
        F.last("v_first", ignorenulls=True).over(future).alias("next_value"),
    )


def _line() -> Column:
    span = F.datediff("next_day", "prev_day")
    return (F.when(F.col("prev_day") == F.col("day"), F.col("v_last"))
            .when(span > 0, F.col("prev_value") + (F.col("next_value") - F.col("prev_value"))
                  * F.datediff("day", "prev_day") / span))


def interpolate_flagged(rows: DataFrame, keys, max_gap: int | None = None, gap_rule: str | None = None,
                        min_source: int = 2, min_target: int = 2, out: str = "value") -> DataFrame:
    """Interpolated value per (key, target day) inside the source span.

    ``gap_rule="either_side"`` drops targets more than ``max_gap`` days away from the
    previous or from the next source.  ``"proximity_if_long"`` acts only on keys with
    a source gap above ``max_gap`` and keeps targets within ``max_gap`` days of any
    source.
    """
    keys = names(keys)
    if gap_rule not in (None, "either_side", "proximity_if_long"):
        raise ValueError(f"unknown gap rule {gap_rule!r}")
    per_key = Window.partitionBy(*keys)
    ordered = Window.partitionBy(*keys).orderBy("day")
    b = day_brackets(rows, keys)
    in_span = F.col("prev_day").isNotNull() & F.col("next_day").isNotNull()
    targets = F.when(in_span, F.col("n_target")).otherwise(0)
    b = b.select("*", F.sum("n_source").over(per_key).alias("_src"), F.sum(targets).over(per_key).alias("_tgt"))
    before, after = F.datediff("day", "prev_day"), F.datediff("next_day", "day")
    keep = in_span & (F.col("n_target") > 0) & (F.col("_src") >= min_source) & (F.col("_tgt") >= min_target)
    if gap_rule == "either_side":
        keep = keep & (before <= max_gap) & (after <= max_gap)
    elif gap_rule == "proximity_if_long":
        earlier = F.lag("prev_day").over(ordered)
        step = F.when(F.col("n_source") > 0, F.datediff("day", earlier))
        b = b.withColumn("_step", step).withColumn("_long", F.max("_step").over(per_key))
        keep = keep & (~holds(F.col("_long") > max_gap) | (F.least(before, after) <= max_gap))
    kept = b.where(keep)
    if gap_rule:
        kept = kept.withColumn("_left", F.sum("n_target").over(per_key)).where(F.col("_left") >= min_target)
    return kept.select(*keys, "day", "n_target", _line().alias(out), "prev_day", "next_day")


def interpolate(src: DataFrame, tgt: DataFrame, keys, t, v, order=None, **rules) -> DataFrame:
    """Interpolate ``v`` of ``src`` onto the days of ``tgt`` (no extrapolation)."""
    keys = names(keys)
    return interpolate_flagged(_union_rows(src, tgt, keys, t, v, order), keys, **rules)


def interpolate_rows(df: DataFrame, keys, t, v, source: Column, target: Column, order=None, **rules) -> DataFrame:
    """Same, when sources and targets are rows of one table (a single scan)."""
    return interpolate_flagged(flag_rows(df, keys, t, v, source, target, order), keys, **rules)


def interpolation_error(interpolated: DataFrame, truth: DataFrame, keys, t, truth_value, percent: bool = False,
                        value: str = "value", out: str = "error") -> DataFrame:
    """Interpolated minus true value for every truth row on an interpolated day."""
    keys = names(keys)
    rows = truth.where(known(truth_value)).select(*keys, day(t).alias("day"), F.col(truth_value).alias("truth"))
    if percent:
        rows = rows.where(F.col("truth") > 0)
    joined = rows.join(interpolated, [*keys, "day"], "inner")
    err = F.col(value) - F.col("truth")
    return joined.withColumn(out, err / F.col("truth") * 100 if percent else err)


def daily_errors(df: DataFrame, keys, t, v, truth_value, accepted: Column, ice=None, max_gap: int = 60,
                 limit: float | None = 50, percent: bool = False, order=None) -> DataFrame:
    """Daily interpolation errors of all keys: sources accepted, targets with usable truth."""
    usable = known(truth_value)
    if limit is not None:
        usable = usable & (F.abs(F.col(truth_value)) <= limit)
    source = holds(accepted)
    if percent:
        usable = usable & (F.col(truth_value) > 0)
    if ice is not None:
        usable, source = usable & holds(F.col(ice) == 0), source & holds(F.col(ice) == 0)
    days = interpolate_rows(df, keys, t, v, source, usable, order, max_gap=max_gap, gap_rule="either_side")
    return interpolation_error(days, df.where(holds(usable)), keys, t, truth_value, percent)


def sampling_error(truth: DataFrame, observed: DataFrame, keys, t, v, tol: int = 1, order=None,
                   max_distance: int = 50, max_error: float = 10) -> DataFrame:
    """Error made by sampling the truth only at observed days and interpolating back."""
    from hydroseries.operators.matching import nearest_join

    keys = names(keys)
    samples = nearest_join(observed.select(*keys, day(t).alias("day")).distinct(), truth, keys, "day", t, v,
                           tol=tol, how="inner", out="sample", order=order)
    lines = interpolate(samples.select(*keys, F.col("day").alias(t), F.col("sample").alias(v)), truth, keys, t, v)
    rows = interpolation_error(lines, truth, keys, t, v)
    distance = F.least(F.datediff("day", "prev_day"), F.datediff("next_day", "day"))
    return (rows.select(*keys, "day", F.abs("error").alias("abs_error"), distance.alias("distance"))
            .where((F.col("distance") > 0) & (F.col("distance") <= max_distance)
                   & (F.col("abs_error") <= max_error)))


def error_vs_gap(df: DataFrame, keys, t, v, truth_value, accepted: Column, max_gap: int = 50, order=None) -> DataFrame:
    """Interpolation error against days since the last observation (1..``max_gap``)."""
    days = interpolate_rows(df, keys, t, v, accepted, known(truth_value), order)
    rows = interpolation_error(days, df, keys, t, truth_value)
    since = F.datediff("day", "prev_day")
    return rows.select(*names(keys), "day", since.alias("days_since"), "error").where((since > 0) & (since <= max_gap))


def daily_pair(df: DataFrame, gauge: DataFrame, keys, t, v, filtered, gauge_t, gauge_v,
               major_gap: int = 90) -> DataFrame:
    """Daily series of the raw level, the filtered level and the gauge on common days.

    Daily means are filled linearly over the span of the raw series with flat edges;
    days strictly inside a gauge gap of at least ``major_gap`` days are left out.
    """
    keys = names(keys)
    obs = df.groupBy(*keys, day(t).alias("day")).agg(F.avg(v).alias("a"), F.avg(filtered).alias("b"))
    ref = gauge.groupBy(*keys, day(gauge_t).alias("day")).agg(F.avg(gauge_v).alias("g"))
    both = obs.withColumn("_o", F.lit(1)).join(ref.withColumn("_r", F.lit(1)), [*keys, "day"], "full_outer")
    span = both.groupBy(*keys).agg(
        F.min(F.when(F.col("_o") == 1, F.col("day"))).alias("_a0"), F.max(F.when(F.col("_o") == 1, F.col("day"))).alias("_a1"),
        F.min(F.when(F.col("_r") == 1, F.col("day"))).alias("_g0"), F.max(F.when(F.col("_r") == 1, F.col("day"))).alias("_g1"))
    lo, hi = F.greatest("_a0", "_g0"), F.least("_a1", "_g1")
    grid = (span.where(F.col("_a0").isNotNull() & F.col("_g0").isNotNull() & (lo <= hi))
            .select(*keys, F.explode(F.sequence(lo, hi)).alias("day"), F.lit(1).alias("_grid")))
    full = grid.join(both, [*keys, "day"], "full_outer")
    past = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    future = Window.partitionBy(*keys).orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, 0)

    def edges(value: str) -> list[Column]:
        at = F.when(F.col(value).isNotNull(), F.col("day"))
        return [F.last(at, ignorenulls=True).over(past).alias(f"_{value}d0"),
                F.last(value, ignorenulls=True).over(past).alias(f"_{value}v0"),
                F.last(at, ignorenulls=True).over(future).alias(f"_{value}d1"),
                F.last(value, ignorenulls=True).over(future).alias(f"_{value}v1")]

    seen = F.when(F.col("_r") == 1, F.col("day"))
    wide = full.select("*", *edges("a"), *edges("b"),
                       F.last(seen, ignorenulls=True).over(past).alias("_rd0"),
                       F.last(seen, ignorenulls=True).over(future).alias("_rd1"))
    inside_gap = holds((F.datediff("_rd1", "_rd0") >= major_gap) & (F.col("day") > F.col("_rd0"))
                       & (F.col("day") < F.col("_rd1")))
    kept = wide.where((F.col("_grid") == 1) & ~inside_gap)
    # The gauge is filled by position on the kept days only, so it never bridges a removed gap by calendar time.
    kept = kept.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy("day")))
    at = F.when(F.col("g").isNotNull(), F.col("_pos"))
    kept = kept.select("*", F.last(at, ignorenulls=True).over(past).alias("_gp0"),
                       F.last("g", ignorenulls=True).over(past).alias("_gv0"),
                       F.last(at, ignorenulls=True).over(future).alias("_gp1"),
                       F.last("g", ignorenulls=True).over(future).alias("_gv1"))

    def fill(p0: Column, v0: str, p1: Column, v1: str, here: Column, width: Column) -> Column:
        between = F.col(v0) + (F.col(v1) - F.col(v0)) * here / F.nullif(width, F.lit(0))
        return F.coalesce(between, F.col(v0), F.col(v1))

    def by_day(value: str) -> Column:
        return fill(F.col(f"_{value}d0"), f"_{value}v0", F.col(f"_{value}d1"), f"_{value}v1",
                    F.datediff("day", f"_{value}d0"), F.datediff(f"_{value}d1", f"_{value}d0"))

    gauge_fill = fill(F.col("_gp0"), "_gv0", F.col("_gp1"), "_gv1", F.col("_pos") - F.col("_gp0"),
                      F.col("_gp1") - F.col("_gp0"))
    return kept.select(*keys, "day", by_day("a").alias("daily_level"), by_day("b").alias("daily_filtered"),
                       gauge_fill.alias("daily_gauge"))
