"""Outlier rules per key: fences, trims, median bands, ice-season checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroseries.functions.keyed import attach, cut_lineage, day, holds, known, names
from hydroseries.functions.orderstats import quantiles


def check_quantiles(lo: float, hi: float) -> None:
    if not 0 <= lo < hi <= 1:
        raise ValueError("quantiles must satisfy 0 <= lo < hi <= 1")


def tukey_bounds(df: DataFrame, keys, value: str, mult: float = 3, lo: float = 0.25, hi: float = 0.75, largest: int | None = None) -> DataFrame:
    """Fence per key: quantiles widened by ``mult`` times their distance; ``largest`` as in ``quantiles``."""
    check_quantiles(lo, hi)
    keys = names(keys)
    if (lo, hi) == (0, 1):
        q = df.where(known(value)).groupBy(*keys).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    else:
        q = quantiles(df, keys, value, {"_lo": lo, "_hi": hi}, largest=largest)
    width = F.col("_hi") - F.col("_lo")
    return q.select(*keys, (F.col("_lo") - mult * width).alias("lower_bound"), (F.col("_hi") + mult * width).alias("upper_bound"))


def tukey(df: DataFrame, keys, value: str, mult: float = 3, lo: float = 0.25, hi: float = 0.75,
          side: str = "both", action: str = "drop", keep_bounds: bool = False, largest: int | None = None) -> DataFrame:
    """Drop (or blank) values outside the fence; rows without a value are dropped too."""
    if side not in ("both", "low", "high") or action not in ("drop", "null"):
        raise ValueError("side is both, low or high; action is drop or null")
    keys = names(keys)
    joined = attach(df, tukey_bounds(df, keys, value, mult, lo, hi, largest), keys)
    inside = F.lit(True)
    if side in ("both", "low"):
        inside = inside & holds(F.col(value) >= F.col("lower_bound"))
    if side in ("both", "high"):
        inside = inside & holds(F.col(value) <= F.col("upper_bound"))
    if action == "drop":
        out = joined.where(inside & known(value))
    else:
        out = joined.withColumn(value, F.when(inside, F.col(value)))
    return out if keep_bounds else out.select(*df.columns)


def trim_abs(df: DataFrame, value: str, pct: float = 99, keys=None, slack: float = 1e-12) -> DataFrame:
    """Keep rows whose absolute value is at most its percentile; within ``slack`` rounding does not part equal values."""
    keys = names(keys)
    q = quantiles(df, keys, F.abs(F.col(value)), {"_limit": pct / 100})
    return attach(df.where(known(value)), q, keys, "left").where(F.abs(value) <= F.col("_limit") * (1 + slack)).select(*df.columns)


def trim_pct(df: DataFrame, cols: str | Sequence[str], lo: float = 1, hi: float = 99, keys=None) -> DataFrame:
    """Keep rows between two percentiles; several columns are trimmed one after the other."""
    keys = names(keys)
    out = df
    for i, c in enumerate(names(cols)):
        if i:
            out = cut_lineage(out)
        q = quantiles(out, keys, c, {"_p_lo": lo / 100, "_p_hi": hi / 100})
        out = (attach(out.where(known(c)), q, keys, "left")
               .where((F.col(c) >= F.col("_p_lo")) & (F.col(c) <= F.col("_p_hi"))).select(*df.columns))
    return out


def median_band(df: DataFrame, keys, value: str, width: float = 150) -> DataFrame:
    keys = names(keys)
    mid = quantiles(df, keys, value, {"_mid": 0.5})
    return attach(df, mid, keys).where(F.abs(F.col(value) - F.col("_mid")) <= width).select(*df.columns)


def baseline_tukey(df: DataFrame, keys, value: str, baseline: Column, mult: float = 3, lo: float = 0.1,
                   hi: float = 0.9, width: float = 150, rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Baseline filter, then fence and median band until nothing changes.

    One pass per round serves all keys; keys that did not shrink are set aside.
    Returns the kept rows and (key, n_rounds, status).
    """
    keys = names(keys)
    attempted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    kept = df.where(holds(baseline))
    active = cut_lineage(attach(kept, kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_before")), keys, "inner"))
    finished = []
    for n in range(1, rounds + 1):
        step = median_band(tukey(active, keys, value, mult, lo, hi), keys, value, width)
        counts = step.groupBy(*keys).agg(F.count(F.lit(1)).alias("_after"))
        state = attach(step, counts, keys, "inner").withColumn("_rounds", F.lit(n))
        state = cut_lineage(state.withColumn("_done", (F.col("_after") >= F.col("_before")) | (F.lit(n) == rounds)))
        finished.append(state.where("_done"))
        active = state.where("NOT _done").withColumn("_before", F.col("_after")).drop("_after", "_rounds", "_done")
        if n == rounds or active.isEmpty():
            break
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    done = out.groupBy(*keys).agg(F.max("_rounds").alias("_n"))
    status = attempted.join(done, keys, "left").select(
        *keys, F.coalesce("_n", F.lit(-1)).alias("n_rounds"),
        F.when(F.col("_n") > 0, "success").otherwise("fail").alias("status"))
    return out.select(*df.columns), status


def zclip(df: DataFrame, keys, residual: str, value: str, z: float = 2.576, spread: float = 0.08,
          spread_range: str | None = None) -> DataFrame:
    """Keep rows with a small z-score or a residual that is small against the value range.

    ``spread_range`` names a column that already holds the range to compare with.
    """
    keys = names(keys)
    stats = df.groupBy(*keys).agg(F.avg(residual).alias("_m"), F.stddev_pop(residual).alias("_s"),
                                  F.sum(F.abs(residual)).alias("_a"), (F.max(value) - F.min(value)).alias("_r"))
    scale = F.when(F.col("_a") == 0, F.lit(1.0)).otherwise(F.nullif(F.col("_s"), F.lit(0.0)))
    score = F.abs((F.col(residual) - F.col("_m")) / scale)
    reach = F.col(spread_range) if spread_range else F.col("_r")
    small = F.abs(F.col(residual)) / F.nullif(reach, F.lit(0.0)) < spread
    return attach(df, stats, keys).where(holds(score < z) | holds(small)).select(*df.columns)


def drop_in_gaps(ev: DataFrame, base: DataFrame, keys, t, limit: int = 95) -> DataFrame:
    """Drop rows strictly inside a baseline gap longer than ``limit`` days; rows without a time stay."""
    keys = names(keys)
    days = (base.select(*keys, day(t).alias("_day"), F.lit(1).alias("_b"))
            .unionByName(ev.select(*keys, day(t).alias("_day"), F.lit(0).alias("_b")))
            .where(F.col("_day").isNotNull()).groupBy(*keys, "_day").agg(F.max("_b").alias("_b")))
    at = F.when(F.col("_b") == 1, F.col("_day"))
    past = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    future = Window.partitionBy(*keys).orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, 0)
    inside = (days.select(*keys, "_day", F.last(at, True).over(past).alias("_p"), F.last(at, True).over(future).alias("_n"))
              .where((F.datediff("_n", "_p") > limit) & (F.col("_day") > F.col("_p")) & (F.col("_day") < F.col("_n")))
              .select(*keys, "_day"))
    return ev.withColumn("_day", day(t)).join(inside, [*keys, "_day"], "left_anti").select(*ev.columns)


def accept_series(df: DataFrame, keys, t, max_gap: int = 95, min_span: int = 365, allow_gaps: bool = False) -> DataFrame:
    """Per key: whether a series is long and dense enough to be used (status 0, else -1)."""
    keys = names(keys)
    days = df.groupBy(*keys, day(t).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.lag("_day").over(Window.partitionBy(*keys).orderBy("_day"))
    stats = days.withColumn("_gap", F.datediff("_day", before)).groupBy(*keys).agg(
        F.sum("_n").alias("n_obs"), F.max("_gap").alias("max_gap"), F.datediff(F.max("_day"), F.min("_day")).alias("span_days"))
    ok = F.col("n_obs") >= min_span / max_gap + 1
    if not allow_gaps:
        ok = ok & ~holds(F.col("max_gap") > max_gap) & (F.col("span_days") >= min_span)
    return stats.withColumn("status", F.when(ok, 0).otherwise(-1))


def keep_accepted(df: DataFrame, keys, t, **rules) -> DataFrame:
    keys = names(keys)
    ok = accept_series(df, keys, t, **rules).where("status = 0").select(*keys)
    return df.join(ok, keys, "left_semi")


def _ice_free_bounds(free: DataFrame, keys: list[str], grains: dict, measures: list[str], counted: tuple[str, str],
                     mult: float, lo: float, hi: float) -> DataFrame:
    """Counts and fences of ice-free rows at every comparison grain, in one pass over the rows."""
    area, level = counted
    places = F.array(*[F.struct(F.lit(g).alias("_grain"), p.alias("_p"), c.alias("_c")) for g, (p, c) in grains.items()])
    rows = free.select(*keys, *dict.fromkeys([area, level]), F.explode(places).alias("_g")).select(*keys, *dict.fromkeys([area, level]), "_g.*")
    by = [*keys, "_grain", "_p", "_c"]
    exact = (lo, hi) == (0, 1)
    ends = [f(F.when(known(m), F.col(m))).cast("double").alias(f"q{side}_{m}")
            for m in measures for side, f in (("l", F.min), ("h", F.max))] if exact else []
    out = rows.groupBy(*by).agg(F.count_if(known(area)).alias("na"), F.count_if(known(level)).alias("nl"), *ends)
    if not exact:
        long = rows.unpivot(by, measures, "_measure", "_x")
        q = quantiles(long, [*by, "_measure"], "_x", {"_l": lo, "_h": hi})
        wide = q.groupBy(*by).agg(*[F.max(F.when(F.col("_measure") == m, F.col(f"_{side}"))).alias(f"q{side}_{m}")
                                    for m in measures for side in ("l", "h")])
        out = out.join(wide, by, "left")
    bounds = []
    for m in measures:
        width = F.col(f"qh_{m}") - F.col(f"ql_{m}")
        bounds += [(F.col(f"ql_{m}") - mult * width).alias(f"lb_{m}"), (F.col(f"qh_{m}") + mult * width).alias(f"ub_{m}")]
    return out.select(*by, "na", "nl", *bounds)


def ice_outliers(df: DataFrame, keys, by_pass: bool = True, by_crid: bool = True, mult: float = 3, lo: float = 0.25,
                 hi: float = 0.75, used_q: str = "upper", filter_by: str = "both", ice="ice_clim_f", passes="pass_id",
                 crid="crid_scenario", area="area_total", level="wse") -> DataFrame:
    """Drop ice-season rows that are outliers against comparable ice-free rows.

    The comparison group is the same pass if the key has ice-free rows of that pass,
    and the same processing version likewise; all ice-free rows of the key otherwise.
    """
    check_quantiles(lo, hi)
    if used_q not in ("upper", "lower", "both") or filter_by not in ("area", "wse", "both"):
        raise ValueError("used_q is upper, lower or both; filter_by is area, wse or both")
    keys = names(keys)
    free = df.where(holds(F.col(ice) <= 1))
    measures = [m for m, used in ((area, filter_by in ("area", "both")), (level, filter_by in ("wse", "both"))) if used]

    p, c = (F.coalesce(F.col(x).cast("string"), F.lit("?")) for x in (passes, crid))
    grains = {"all": (F.lit("*"), F.lit("*")), **({"pass": (p, F.lit("*"))} if by_pass else {}),
              **({"crid": (F.lit("*"), c)} if by_crid else {}), **({"both": (p, c)} if by_pass and by_crid else {})}
    table = _ice_free_bounds(free, keys, grains, measures, (area, level), mult, lo, hi)
    rows = df
    for tag, (pk, ck) in grains.items():
        part = table.where(F.col("_grain") == tag).drop("_grain")
        fields = [f for f in part.columns if f not in (*keys, "_p", "_c")]
        part = part.select(*keys, "_p", "_c", *[F.col(f).alias(f"{f}_{tag}") for f in fields])
        rows = rows.withColumns({"_p": pk, "_c": ck}).join(part, [*keys, "_p", "_c"], "left").drop("_p", "_c")
    has_pass = F.col("na_pass").isNotNull() if by_pass else F.lit(False)
    has_crid = F.col("na_crid").isNotNull() if by_crid else F.lit(False)
    order = [("all", F.lit(True))]
    if by_pass and by_crid:
        order = [("both", has_pass & has_crid & F.col("na_both").isNotNull()), ("all", has_pass & has_crid),
                 ("pass", has_pass), ("crid", has_crid), *order]
    elif by_pass or by_crid:
        order = [("pass", has_pass) if by_pass else ("crid", has_crid), *order]

    def pick(name: str) -> Column:
        return F.coalesce(*[F.when(cond, F.struct(F.col(f"{name}_{tag}").alias("x"))) for tag, cond in order])["x"]

    n_area, n_level = pick("na"), pick("nl")

    def passes_check(m: str, n: Column) -> Column:
        low, high = pick(f"lb_{m}"), pick(f"ub_{m}")
        ok = F.lit(True)
        if used_q in ("lower", "both"):
            ok = ok & (F.col(m) >= low)
        if used_q in ("upper", "both"):
            ok = ok & (F.col(m) <= high)
        return ~known(m) | (n < 2) | holds(ok)

    checks = F.lit(True)
    for m in measures:
        checks = checks & passes_check(m, n_area if m == area else n_level)
    keep_ice = ((n_area < 2) & (n_level < 2)) | checks
    keep = F.col("na_all").isNull() | holds(F.col(ice) <= 1) | (holds(F.col(ice) > 1) & keep_ice)
    return rows.where(keep).select(*df.columns)
