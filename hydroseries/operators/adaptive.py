"""Self-calibrating level filter.

Calibration, marking and counting are Spark aggregations.  The rounds of a key depend on each
other, those of different keys do not: a round is a set of Spark steps over all keys that still
change, whatever their size.  It needs per-key aggregates and a curve at day grain; the rows of a
key are never gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroseries.functions.keyed import attach, cut_lineage, day, holds, known, names
from hydroseries.functions.orderstats import quantiles
from hydroseries.operators import thresholds as th
from hydroseries.operators.outliers import accept_series
from hydroseries.operators.smooth import nearest_residual, on_days

# Column names used inside the filter, by daily-table name.
RENAME = {
    "swot_wse": "wse", "swot_wse_std": "wse_std", "swot_wse_u": "wse_u", "swot_xtrk_dist": "xtrk_dist",
    "swot_xovr_cal_q": "xovr_cal_q", "swot_quality_f": "quality_f", "swot_ice_clim_f": "ice_clim_f",
    "swot_partial_f": "partial_f", "swot_crid": "crid", "swot_pass_id": "pass_id", "swot_cycle_id": "cycle_id",
}


@dataclass(frozen=True)
class Config:
    bounds: tuple = ((0, 3), (0, 0.5), (0, 75000))
    ice_min: tuple = (3, 0.1)
    rules_free: tuple = ("ice-free", "ice-free", "not apply")
    rules_ice: tuple = ("ice-free", "ice-free", "not apply")
    by_crid: tuple = (False, False, False)
    by_pass: tuple = (False, False, True)
    by_ice: tuple = (True, True, True)
    fallout: str = "documented"
    allow_major_gap: bool = True
    max_gap: int = 95
    min_span: int = 365
    full_data: bool = False
    second_round: bool = True
    low_pass: bool = True
    method: str = "savgol"
    params: tuple = ({"window": 21, "order": 3},)
    z: tuple = (2.576, 3.5)
    spread: tuple = (0.08, 0.06)
    rounds: tuple = (40, 5)
    min_conservative: int = 5
    band: float = 150


def prepare_adaptive(df: DataFrame, keys, t: str = "date", order=("row_no",)) -> DataFrame:
    """Rows with a level, under the filter's own names, with version group and ice state."""
    keys, order = names(keys), names(order)
    have = set(df.columns)
    cols = [F.col(src).alias(dst) if src in have else F.lit(None).cast("double").alias(dst) for src, dst in RENAME.items()]
    areas = [F.col(c) for c in ("swot_wsa", "swot_area_total") if c in have]
    area = F.coalesce(*areas) if areas else F.lit(None).cast("double")
    out = df.select(*keys, day(t).alias("day"), *[c for c in order if c not in keys], *cols, area.alias("area_total"))
    return (out.where(known("wse")).withColumn("crid_scenario", th.crid_scenario()).withColumn("ice_condition", th.ice_condition()))


def _series_ok(rows: DataFrame, keys: list[str], cfg: Config) -> DataFrame:
    """Keys whose rows are enough (and gap free and long enough when gaps are not allowed)."""
    return (accept_series(rows, keys, "day", cfg.max_gap, cfg.min_span, cfg.allow_major_gap)
            .where("status = 0").select(*keys))


def _lines(rows: DataFrame, base: Column, keys: list[str], ids: list[str], cfg: Config) -> DataFrame:
    """(key, n, curves, reach): the smoothed curves of accepted series of ``base`` rows on every day of ``rows`` that may be judged.

    One day-grain table serves all rules on the series itself: number of rows, gaps, span and the
    range of levels. Days strictly inside a longer gap are left out.
    """
    v, o = F.when(base, F.col("wse")), F.when(base, F.struct(*ids))
    days = rows.groupBy(*keys, F.datediff("day", F.lit("1970-01-01")).alias("n")).agg(
        F.min_by(v, o).alias("first"), F.max_by(v, o).alias("last"), F.count_if(base).alias("_rows"), F.min(v).alias("_low"), F.max(v).alias("_high"))
    level = [F.col(c).cast("double").alias(c) for c in ("first", "last")]
    series = days.groupBy(*keys).agg(
        F.sum("_rows").alias("_all"), (F.max("_high") - F.min("_low")).alias("reach"),
        F.sort_array(F.collect_list(F.when((F.col("_rows") > 0) & F.col("n").isNotNull(), F.struct("n", *level)))).alias("_days"), F.collect_list("n").alias("_want"))
    ok = F.col("_all") >= cfg.min_span / cfg.max_gap + 1
    if not cfg.allow_major_gap:
        jump = F.array_max(F.transform("_days", lambda x, i: F.get("_days", i + F.lit(1))["n"] - x["n"]))
        span = F.element_at("_days", F.lit(-1))["n"] - F.get("_days", F.lit(0))["n"]
        ok = ok & ~holds(jump > cfg.max_gap) & F.when(F.size("_days") > 0, span >= cfg.min_span)
    return on_days(series.where(ok), keys, cfg.method, list(cfg.params), cfg.max_gap, "reach")


def _ice_limits(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Largest area and level that rows of the ice season may have, from ice-free rows: one row per key.

    ``_of`` has the limits of each pass, ``_area`` and ``_wse`` those of the key and ``_level`` its
    narrower one; fewer than two values set no limit. Neither ice rule drops an ice-free row, so both
    compare with the same rows.
    """
    value = {m: F.when(known(m), F.col(m)) for m in ("area_total", "wse")}
    one = rows.where(holds(F.col("ice_clim_f") <= 1)).groupBy(*keys, F.coalesce(F.col("pass_id").cast("string"), F.lit("?")).alias("_pass")).agg(
        *[f(v).alias(f"{t}_{m}") for m, v in value.items() for t, f in (("n", F.count), ("a", F.min), ("b", F.max))])

    def limit(m: str, mult: float, n: Column, a: Column, b: Column) -> Column:
        return F.when(n >= 2, b + mult * (b - a)).otherwise(F.lit(float("inf")))

    def of_pass(m: str, mult: float) -> Column:
        return limit(m, mult, *[F.col(f"{t}_{m}") for t in "nab"])

    def of_key(m: str, mult: float) -> Column:
        return limit(m, mult, F.sum(f"n_{m}"), F.min(f"a_{m}"), F.max(f"b_{m}"))
    # The first rule compares area and level by pass, the second the level over all passes.
    own = F.struct(of_pass("area_total", 0.3).alias("area"), of_pass("wse", 0.3).alias("wse"))
    return one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_pass", own))).alias("_of"), of_key("area_total", 0.3).alias("_area"),
                                  of_key("wse", 0.3).alias("_wse"), of_key("wse", 0.2).alias("_level"))


def _under_ice() -> Column:
    """Whether a row of the ice season stays within the limits of comparable ice-free rows."""
    own = F.try_element_at("_of", F.coalesce(F.col("pass_id").cast("string"), F.lit("?")))
    free = F.col("ice_clim_f") <= 1
    small = ~known("area_total") | holds(F.col("area_total") <= F.coalesce(own["area"], F.col("_area")))
    low = ~known("wse") | holds((F.col("wse") <= F.col("_level")) & (F.col("wse") <= F.coalesce(own["wse"], F.col("_wse"))))
    return F.col("_level").isNull() | holds(free) | (holds(~free) & small & low)


def _judged(rows: DataFrame, keys: list[str], ids: list[str], cfg: Config, stage: int) -> DataFrame:
    """Rows of accepted series with ``alive``: within the spread around the curve and, under ice, not above ice-free rows."""
    base = F.col("base_ok") if stage == 0 else F.lit(True)
    found = rows.withColumn("n", F.datediff("day", F.lit("1970-01-01"))).join(_lines(rows, base, keys, ids, cfg), [*keys, "n"])
    found = found.withColumn("residual", nearest_residual(F.col("curves"), F.col("wse"))).select(*rows.columns, "residual", "reach")
    found = cut_lineage(found)
    stats = found.groupBy(*keys).agg(F.avg("residual").alias("_m"), F.stddev_pop("residual").alias("_s"), F.sum(F.abs("residual")).alias("_a"))
    scale = F.when(F.col("_a") == 0, F.lit(1.0)).otherwise(F.nullif(F.col("_s"), F.lit(0.0)))
    near = holds(F.abs((F.col("residual") - F.col("_m")) / scale) < cfg.z[stage])
    small = holds(F.abs("residual") / F.nullif(F.col("reach"), F.lit(0.0)) < cfg.spread[stage])
    clipped = attach(found, stats, keys, "inner").withColumn("alive", near | small).select(*rows.columns, "alive")
    joined = attach(clipped, _ice_limits(clipped.where("alive"), keys), keys)
    return joined.select(*rows.columns, (F.col("alive") & _under_ice()).alias("alive")).where("alive OR locked")


def _band(judged: DataFrame, keys: list[str], cfg: Config, largest: int) -> DataFrame:
    """(key, _lo, _hi): the fence of levels, cut to a band around the median of what is inside the fence."""
    alive = judged.where("alive").select(*keys, "wse")
    q = quantiles(alive, keys, "wse", {"_q1": 0.1, "_q9": 0.9}, largest=largest)
    width = F.col("_q9") - F.col("_q1")
    fence = q.select(*keys, (F.col("_q1") - 3 * width).alias("_f0"), (F.col("_q9") + 3 * width).alias("_f1"))
    inside = attach(alive, fence, keys).where(F.col("wse").between(F.col("_f0"), F.col("_f1"))).select(*keys, "wse")
    return fence.join(quantiles(inside, keys, "wse", {"_mid": 0.5}, largest=largest), keys).select(
        *keys, F.greatest("_f0", F.col("_mid") - cfg.band).alias("_lo"), F.least("_f1", F.col("_mid") + cfg.band).alias("_hi"))


def _settle(rows: DataFrame, keys: list[str], ids: list[str], cfg: Config, stage: int) -> DataFrame:
    """Rounds over the frontier of keys that still shrink; rows of settled keys with ``n_round``.

    A round writes the rows of the frontier with their residuals and once they are judged, and small
    tables with one row for each of its keys: limits of levels and the number of rows that stay.
    Short plans between them cost less than one long plan that is planned anew after each of its
    stages. A key whose number no longer falls
    is settled; a key without rows or without an accepted series is gone.
    """
    settled, columns = [], rows.columns
    counts = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_before")))
    largest = counts.agg(F.max("_before")).first()[0] or 0
    for n in range(1, cfg.rounds[stage] + 1):
        judged = cut_lineage(_judged(rows, keys, ids, cfg, stage))
        limits = _band(judged, keys, cfg, largest)
        left = attach(judged, limits, keys).where(F.col("locked") | holds(F.col("wse").between(F.col("_lo"), F.col("_hi")) & F.col("alive")))
        state = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_after"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        done = (F.col("_after") >= F.col("_before")) | F.lit(n == cfg.rounds[stage])
        state = cut_lineage(state.join(counts, keys).withColumn("_done", done).drop("_before"))

        def of(part: DataFrame, judged: DataFrame = judged) -> DataFrame:
            stays = F.col("locked") | holds(F.col("wse").between(F.col("_lo"), F.col("_hi")) & F.col("alive"))
            return attach(judged, part, keys, "inner").where(stays).select(*columns)

        settled.append(of(state.where("_done")).withColumn("n_round", F.lit(n)))
        moving = state.where("NOT _done")
        if n == cfg.rounds[stage] or moving.isEmpty():
            break
        rows, counts = of(moving), moving.select(*keys, F.col("_after").alias("_before"))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    out = cut_lineage(out)
    return out.join(_series_ok(out, keys, cfg), keys, "left_semi")


def adaptive_filter(df: DataFrame, keys, t: str = "date", order=("row_no",), cfg: Config | None = None,
                    conservative: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted rows (key, order columns, level) and a status row per key.

    ``order`` names the columns that identify a row within its key.  Codes: -9 no
    level, -2 not run, -1 abandoned, otherwise the number of rounds.
    """
    cfg = cfg or Config()
    keys, ids = names(keys), [c for c in names(order) if c not in names(keys)]
    attempted = df.groupBy(*keys).agg(F.count_if(known("swot_wse")).alias("n_level"))
    cons = th.conservative() if conservative is None else holds(conservative)
    prepared = prepare_adaptive(df, keys, t, order)
    judged = th.calibratable(prepared, keys, cons, cfg.min_conservative)
    usable = prepared.join(judged.where("reason = 'ok'").select(*keys), keys, "left_semi")
    thr = th.calibrate_thresholds(usable, keys, cons, cfg.by_crid, cfg.by_pass, cfg.by_ice, cfg.fallout)
    marked = th.with_threshold_mask(usable, thr, keys, cfg.bounds, cfg.ice_min, cfg.rules_free, cfg.rules_ice)
    rows = cut_lineage(marked.select(
        *keys, *ids, "day", "wse", "area_total", "pass_id", "ice_clim_f", "passes",
        (F.col("passes") & holds(F.col("xovr_cal_q") < 2) & holds(F.col("quality_f") < 3)).alias("base_ok"),
        (F.col("passes") & holds(F.col("xovr_cal_q") == 0) & holds(F.col("quality_f") == 0) & holds(F.col("ice_clim_f") == 0)).alias("good")))
    start = rows if cfg.full_data and cfg.low_pass else rows.where("passes")
    if not cfg.low_pass:
        status = attempted.select(*keys, F.lit(-2).alias("n_round1"), F.lit(-2).alias("n_round2"),
                                  F.lit("heuristic baseline").alias("status"))
        return start.select(*keys, *ids, "day", "wse"), status

    start, extra = start.drop("passes", "good"), rows.where("good").drop("passes", "good")
    one = cut_lineage(_settle(start.withColumn("locked", F.lit(False)), keys, ids, cfg, 0))
    codes = one.groupBy(*keys).agg(F.max("n_round").alias("n_round1")).withColumn("n_round2", F.lit(-2))
    result = one
    if cfg.second_round:
        codes = cut_lineage(codes.drop("n_round2"))
        extra = extra.join(codes.select(*keys), keys, "left_semi").join(one.select(*keys, *ids), [*keys, *ids], "left_anti")
        both = one.drop("n_round").withColumn("locked", F.lit(True)).unionByName(extra.withColumn("locked", F.lit(False)))
        result = cut_lineage(_settle(both, keys, ids, cfg, 1))
        second = result.groupBy(*keys).agg(F.max("n_round").alias("n_round2"))
        codes = codes.join(second, keys, "left").withColumn("n_round2", F.coalesce("n_round2", F.lit(-1)))
    result = result.select(*keys, *ids, "day", "wse")
    last = F.col("n_round2") if cfg.second_round else F.col("n_round1")
    status = (attempted.join(codes, keys, "left")
              .withColumn("n_round1", F.when(F.col("n_level") == 0, -9).otherwise(F.coalesce("n_round1", F.lit(-1))))
              .withColumn("n_round2", F.when(F.col("n_level") == 0, -9).otherwise(F.coalesce("n_round2", F.lit(-2))))
              .select(*keys, "n_round1", "n_round2",
                      F.when(F.col("n_level") == 0, "no data").when(last > 0, "success").otherwise("fail").alias("status")))
    return result, status


def with_adaptive_flag(df: DataFrame, keys, t: str = "date", order=("row_no",), start: str = "2023-07-21",
                       least: int = 5, cfg: Config | None = None) -> DataFrame:
    """The table with ``adaptive_filter``: 0 for accepted rows on or after ``start``, else 1."""
    keys, ids = names(keys), [c for c in names(order) if c not in names(keys)]
    dense = df.groupBy(*keys).agg(F.count_if(known("swot_wse")).alias("_n")).where(F.col("_n") >= least).select(*keys)
    rows, _ = adaptive_filter(df.join(dense, keys, "left_semi"), keys, t, order, cfg)
    marks = rows.select(*keys, *ids, F.lit(0).alias("_ok"))
    base = df.drop("adaptive_filter").join(marks, [*keys, *ids], "left")
    flag = F.when((F.col("_ok") == 0) & holds(day(t) >= F.lit(start).cast("date")), 0).otherwise(1)
    return base.withColumn("adaptive_filter", flag).drop("_ok")
