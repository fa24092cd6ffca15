"""First-order propagation of level and area uncertainty into storage, and its attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries.functions.keyed import attach, known, names
from hydroseries.functions.orderstats import ordered_totals, quantiles
from hydroseries.functions.units import acft_to_km3
from hydroseries.operators.accuracy import with_quantiles
from hydroseries.operators.evaluate import gauge_range
from hydroseries.operators.matching import every_combination

SHARES = ("wse_total_pct", "wse_base_pct", "wse_temporal_pct", "wse_filt_pct", "area_pct")


def storage_reference(daily: DataFrame, keys, columns: dict[str, str]) -> DataFrame:
    """Storage range per key and filter in km³: the filter's own anomaly, else the base one, else storage about its mean.

    A column counts as available when any row of the table has a value in it.
    """
    keys = names(keys)
    base = [c for c in ("storage_anomaly", "storage") if c in daily.columns]
    present = daily.agg(*[F.count(c).alias(c) for c in dict.fromkeys([*columns.values(), *base]) if c in daily.columns])
    flags = {c: (present.select(F.col(c) > 0).scalar() if c in daily.columns else F.lit(False)) for c in dict.fromkeys([*columns.values(), *base])}
    items = []
    for k, c in columns.items():
        order = [x for x in (c, *base) if x in daily.columns]
        value = F.lit(None).cast("double")
        for x in reversed(order):
            value = F.when(flags[x], acft_to_km3(x)).otherwise(value)
        items.append(F.struct(F.lit(k).alias("swot_filter"), value.alias("_ref")))
    long = daily.select(*keys, F.explode(F.array(*items)).alias("_i")).select(*keys, "_i.*")
    return gauge_range(long, [*keys, "swot_filter"], "_ref").withColumnRenamed("range", "storage_range")


def propagate(daily: DataFrame, combos: Sequence[dict], keys, ranges: DataFrame | None = None, height="stage_anomaly_swotdates",
              area="wsa", level="swot_wse_anomaly", digits: int = 1) -> DataFrame:
    """Uncertainty terms of every observation under every combination.

    A combination has model, swot_filter, temporal, wse, wse_temporal, wse_filt (m) and
    wsa (%).  With ``ranges`` (key, swot_filter, storage_range in km³) the terms are also
    given in percent of the range, and observations without height get zero shares
    instead of none.
    """
    keys = names(keys)
    rows = every_combination(daily.where(known(level) & known(area)), [dict(c) for c in combos])
    if ranges is not None:
        rows = attach(rows, ranges, [*keys, "swot_filter"], "inner")
    a, h = F.col(area), F.abs(F.col(height))
    spread = F.col("wse") + F.col("wse_temporal") + F.col("wse_filt")
    rows = rows.withColumns({
        "wse_total_std": spread, "sigma_wse": F.abs(a * spread) / 1000, "sigma_area": h / 1000 * F.abs(a * F.col("wsa_pct")) / 100,
        "height_weight": F.when(h.isNotNull(), 1.0 / F.greatest(h, F.lit(0.1)))})
    rows = rows.withColumn("sigma_total", F.hypot("sigma_wse", "sigma_area"))
    linear = F.col("sigma_wse") + F.col("sigma_area")
    ok = F.col("sigma_total") > 0
    empty = F.lit(None).cast("double") if ranges is None else F.lit(0.0)

    def share(x):
        return F.when(ok, x / linear * 100).otherwise(empty)
    if ranges is None:
        parts = {f"{n}_pct": share(F.abs(a * F.col(c)) / 1000) for n, c in (("wse_base", "wse"), ("wse_temporal", "wse_temporal"), ("wse_filt", "wse_filt"))}
    else:
        total = F.col("wse_total_std")
        parts = {f"{n}_pct": share(F.col("sigma_wse")) * F.when(total > 0, F.col(c) / total).otherwise(0.0)
                 for n, c in (("wse_base", "wse"), ("wse_temporal", "wse_temporal"), ("wse_filt", "wse_filt"))}
    rows = rows.withColumns({"wse_total_pct": share(F.col("sigma_wse")), "area_pct": share(F.col("sigma_area")), **parts})
    if ranges is not None:
        rows = rows.withColumns({f"{c}_norm": F.round(F.col(c) / F.col("storage_range") * 100, digits) for c in ("sigma_wse", "sigma_area", "sigma_total")})
    return rows


def combo(model: str, swot_filter: str, temporal: str, wse: float, wse_temporal: float, wse_filt: float, wsa: float) -> dict:
    return {"model": model, "swot_filter": swot_filter, "temporal": temporal, "wse": float(wse), "wse_temporal": float(wse_temporal),
            "wse_filt": float(wse_filt), "wsa_pct": float(wsa)}


def weighted_stats(df: DataFrame, keys, values: Sequence[str], weight: str | None, digits: int = 4) -> DataFrame:
    """Weighted (or plain) mean and median of several columns, one row per (key, measure)."""
    keys = names(keys)
    by = [*keys, "measure"]
    w = F.col(weight) if weight else F.lit(1.0)
    long = (df.select(*keys, w.alias("_w"), *[F.col(v).cast("double").alias(v) for v in values])
            .unpivot([*keys, "_w"], list(values), "measure", "_x").where(known("_x") & F.col("_w").isNotNull()))
    mean = long.groupBy(*by).agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("mean"))
    if weight:
        # Only bins around the half are ordered; the slack covers sums added up in another order.
        near = lambda off, here, total: (off <= total * (0.5 + 1e-9)) & (off + here >= total * (0.5 - 1e-9))
        totals = ordered_totals(long, by, "_x", {"w": F.col("_w")}, "_x", near)
        reached = F.col("w_before") + F.col("w") >= F.col("w_total") / 2
        mid = totals.groupBy(*by).agg(F.coalesce(F.min(F.when(reached, F.col("_x"))), F.max("_x")).alias("median"))
    else:
        mid = quantiles(long, by, "_x", {"median": 0.5})
    return mean.join(mid, by).select(*by, F.round("mean", digits).alias("mean"), F.round("median", digits).alias("median"))


def attribution_summary(terms: DataFrame, keys, weighted: bool = True, total: str = "sigma_total", digits: int = 4,
                        observed: DataFrame | None = None) -> DataFrame:
    """One row per combination: counts, mean and median shares, total, and ratios to observed errors.

    ``observed`` has model, swot_filter, temporal, observed_mae and observed_rmse.
    """
    by = ["model", "swot_filter", "temporal"]
    counts = terms.groupBy(*by).agg(F.count(F.lit(1)).alias("n_obs"), F.count_distinct(*names(keys)).alias("n_keys"))
    measures = [*SHARES, total]
    stats = weighted_stats(terms, by, measures, "height_weight" if weighted else None, digits)
    wide = stats.groupBy(*by).agg(*[F.max(F.when(F.col("measure") == m, F.col(s))).alias(f"{m}_{s}") for m in measures for s in ("mean", "median")])
    out = counts.join(wide, by, "left")
    if observed is None:
        return out
    out = out.join(observed, by, "left")
    ratio = lambda c: F.when(F.col(c) > 0, F.col(f"{total}_median") / F.col(c))
    return out.withColumns({"ratio_mae": ratio("observed_mae"), "ratio_rmse": ratio("observed_rmse")})


def decompose(summary: DataFrame, filtered: str = "adaptive", optimal: str = "optimal") -> DataFrame:
    """Observed RMSE of each filtered row split by its median shares, where an optimal row exists."""
    have = summary.where(F.col("swot_filter") == optimal).select("model", "temporal").distinct()
    rows = summary.where(F.col("swot_filter") == filtered).join(have, ["model", "temporal"], "left_semi")

    def part(c):
        return F.round(F.col("observed_rmse") * F.coalesce(F.col(c), F.lit(0.0)) / 100, 1)
    return rows.select("model", "temporal", F.round("observed_rmse", 1).alias("total_rmse"), part("wse_base_pct_median").alias("wse_component"),
                       part("area_pct_median").alias("area_component"), part("wse_filt_pct_median").alias("filtering_component"),
                       F.when(F.col("temporal") == "discrete", 0.0).otherwise(part("wse_temporal_pct_median")).alias("temporal_component"))
