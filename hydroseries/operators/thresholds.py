"""Self-calibrating quality thresholds per key, processing version, pass and ice state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroseries.functions.keyed import holds, known, names

STATES = ("ice-free", "ice-covered", "both")
RULES = ("ice-free", "ice-covered", "both", "not apply")
NEW_VERSIONS = ("PIC2", "PID0")


def crid_scenario(crid="crid") -> Column:
    return F.when(holds(F.col(crid).isin(*NEW_VERSIONS)), "PIC2_or_PID0").otherwise("early_versions")


def ice_condition(flag="ice_clim_f") -> Column:
    return F.when(holds(F.col(flag) >= 2), "ice-covered").otherwise("ice-free")


def conservative(xovr="xovr_cal_q", quality="quality_f", crid="crid") -> Column:
    return holds(F.col(xovr) < 1) & (holds(F.col(quality) < 1)
                                     | (holds(F.col(quality) == 1) & holds(F.col(crid).isin(*NEW_VERSIONS))))


def calibratable(df: DataFrame, keys, mask: Column, least: int = 5) -> DataFrame:
    """Keys with levels and enough conservative rows, with the reason for the others."""
    n, ok = F.count_if(known("wse")), F.count_if(holds(mask))
    return df.groupBy(*names(keys)).agg(
        n.alias("n_level"), ok.alias("n_conservative"),
        F.when(n == 0, "no level").when(ok < least, "too few conservative rows").otherwise("ok").alias("reason"))


def calibrate_thresholds(df: DataFrame, keys, conservative_rows: Column, by_crid=(False, False, False),
                         by_pass=(False, False, True), by_ice=(True, True, True), fallout: str = "documented") -> DataFrame:
    """Threshold table: max level spread, max level uncertainty, min cross-track distance.

    Rows are reduced to one per (key, version, pass, ice state) first; everything after
    that works on a table whose groups are bounded by passes and states.  Missing
    thresholds are filled from wider groups; ``fallout="as_run"`` skips the levels
    with a single grouping column.
    """
    if fallout not in ("documented", "as_run"):
        raise ValueError(f"unknown fallout {fallout!r}")
    keys = names(keys)
    ok = holds(conservative_rows)
    triples = df.groupBy(*keys, "crid_scenario", "pass_id", ice_condition().alias("ice_condition")).agg(
        F.max(ok.cast("int")).alias("_cons"), F.max(F.when(ok & known("wse_std"), F.col("wse_std"))).alias("_std"),
        F.max(F.when(ok & known("wse_u"), F.col("wse_u"))).alias("_u"),
        F.min(F.when(ok & known("xtrk_dist"), F.abs("xtrk_dist"))).alias("_x"))
    pair = [*keys, "crid_scenario", "pass_id"]
    grid = (triples.groupBy(*pair).agg(F.max("_cons").alias("_pair_cons"))
            .withColumn("ice_condition", F.explode(F.array(*[F.lit(s) for s in STATES]))))
    # A pass may be unknown (NULL) and still form a group of its own.
    right = triples.select(*[F.col(c).alias(f"r_{c}") for c in [*pair, "ice_condition"]], "_cons", "_std", "_u", "_x")
    same = F.lit(True)
    for c in [*pair, "ice_condition"]:
        same = same & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    base = grid.join(right, same, "left").drop(*[f"r_{c}" for c in [*pair, "ice_condition"]])
    both = F.col("ice_condition") == "both"
    scheme = (F.when(both, F.when(F.col("_pair_cons") == 1, 1).otherwise(2))
              .when(F.col("_cons").isNull(), 3).when(F.col("_cons") == 1, 1).otherwise(2))
    out = base.withColumn("grouping_scheme", scheme)

    specs = [("_std", "wse_std_threshold", F.max), ("_u", "wse_u_threshold", F.max), ("_x", "xtrk_dist_threshold", F.min)]
    for i, (src, name, reduce) in enumerate(specs):
        shared = [*keys, *(["crid_scenario"] if by_crid[i] else []), *(["pass_id"] if by_pass[i] else [])]
        own = [*shared, *(["ice_condition"] if by_ice[i] else [])]
        out = out.withColumn(name, F.when(both, reduce(src).over(Window.partitionBy(*shared)))
                             .otherwise(reduce(src).over(Window.partitionBy(*own))))

    def fill(df_: DataFrame, name: str, reduce, level: list[str], for_both: bool) -> DataFrame:
        if fallout == "as_run":
            if len(level) == 1:
                return df_
            pool = F.col(name)
        else:
            pool = F.when(both if for_both else ~both, F.col(name))
        wider = reduce(pool).over(Window.partitionBy(*keys, *level))
        return df_.withColumn(name, F.when(both if for_both else ~both, F.coalesce(F.col(name), wider)).otherwise(F.col(name)))

    ice_levels = {"wse_std_threshold": [["ice_condition", "pass_id"], ["ice_condition", "crid_scenario"], ["ice_condition"]],
                  "wse_u_threshold": [["ice_condition", "pass_id"], ["ice_condition", "crid_scenario"], ["ice_condition"]],
                  "xtrk_dist_threshold": [["pass_id", "ice_condition"], ["pass_id", "crid_scenario"], ["pass_id"]]}
    for _, name, reduce in specs:
        for level in ice_levels[name]:
            out = fill(out, name, reduce, level, False)
        for level in (["pass_id"], ["crid_scenario"]):
            out = fill(out, name, reduce, level, True)
    return out.select(*pair, "ice_condition", *[n for _, n, _ in specs], "grouping_scheme")


def _check_rules(rules: Sequence[str]) -> None:
    if len(rules) != 3 or any(r not in RULES for r in rules):
        raise ValueError(f"three rules out of {RULES} are needed")


def threshold_mask(rows_with: DataFrame, bounds, ice_min, rules_free, rules_ice) -> Column:
    metrics = [("wse_std", "_std", max), ("wse_u", "_u", max), ("xtrk_dist", "_x", min)]
    free = ~holds(F.col("ice_clim_f") >= 2)
    keep = F.lit(True)
    for i, (value, short, default) in enumerate(metrics):
        def chosen(rule: str) -> Column:
            if rule == "not apply":
                return F.lit(None).cast("double")
            return F.coalesce(F.col(f"{short}_{rule}"), F.lit(float(default(bounds[i]))))
        limit = F.when(free, chosen(rules_free[i])).otherwise(chosen(rules_ice[i]))
        if i < 2:
            limit = F.when(holds(F.col("ice_clim_f") >= 1) & limit.isNotNull(), F.greatest(limit, F.lit(float(ice_min[i])))).otherwise(limit)
            good = known(value) & holds(F.col(value) <= limit)
        else:
            good = known(value) & holds(F.abs(value) >= limit)
        applies = F.when(free, F.lit(rules_free[i] != "not apply")).otherwise(F.lit(rules_ice[i] != "not apply"))
        keep = keep & (~applies | good)
    return keep


def with_threshold_mask(df: DataFrame, thr: DataFrame, keys, bounds=((0, 3), (0, 0.5), (0, 75000)), ice_min=(3, 0.1),
                        rules_free=("ice-free", "ice-free", "not apply"),
                        rules_ice=("ice-free", "ice-free", "not apply"), out: str = "passes") -> DataFrame:
    """Mark rows that meet every applied threshold of their key, version and pass."""
    _check_rules(rules_free)
    _check_rules(rules_ice)
    keys = names(keys)
    cols = [("wse_std_threshold", "_std", bounds[0], 1), ("wse_u_threshold", "_u", bounds[1], 1), ("xtrk_dist_threshold", "_x", bounds[2], 0)]
    aggs = []
    for state in STATES:
        for name, short, limit, side in cols:
            value = F.coalesce(F.col(name), F.lit(float(limit[side])))
            clipped = F.greatest(F.lit(float(limit[0])), F.least(F.lit(float(limit[1])), value))
            aggs.append(F.max(F.when(F.col("ice_condition") == state, clipped)).alias(f"{short}_{state}"))
    # As text keys, so that an unknown pass matches itself.
    wide = thr.groupBy(*keys, "crid_scenario", F.coalesce(F.col("pass_id").cast("string"), F.lit("")).alias("_pass")).agg(*aggs)
    rows = df.withColumn("_pass", F.coalesce(F.col("pass_id").cast("string"), F.lit("")))
    rows = rows.join(wide, [*keys, "crid_scenario", "_pass"], "left")
    return rows.withColumn(out, threshold_mask(rows, bounds, ice_min, rules_free, rules_ice)).select(*df.columns, out)


def apply_thresholds(df: DataFrame, thr: DataFrame, keys, **rules) -> DataFrame:
    return with_threshold_mask(df, thr, keys, out="_passes", **rules).where("_passes").select(*df.columns)
