"""Named observation filters.  Each returns a boolean Column that is never NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroseries.functions.keyed import all_hold, col, holds
from hydroseries.schema import ERA_START, IDEALIZED_THRESHOLD


def era(t="date", start: str = ERA_START, inclusive: bool = False) -> Column:
    limit = F.lit(start).cast("date")
    return holds(col(t) >= limit if inclusive else col(t) > limit)


def quality_flag(flag="swot_quality_f") -> Column:
    return holds(col(flag) == 0)


def simple(xovr="swot_xovr_cal_q", u="swot_wse_u", std="swot_wse_std", anomaly="swot_wse_anomaly",
           level="swot_wse") -> Column:
    return all_hold([col(xovr) < 2, col(u) < 0.1, col(std) < 0.4,
                     (col(anomaly) > -50) & (col(anomaly) < 50), col(level) > 0])


def _graded(xovr, u, std, anomaly, partial, max_u, max_std, max_anomaly) -> Column:
    return all_hold([col(xovr) < 2, col(u) < max_u, col(std) < max_std,
                     F.abs(col(anomaly)) < max_anomaly, col(partial) == 0])


def strict(xovr="swot_xovr_cal_q", u="swot_wse_u", std="swot_wse_std", anomaly="swot_wse_anomaly",
           partial="swot_partial_f") -> Column:
    return _graded(xovr, u, std, anomaly, partial, 0.05, 0.2, 25)


def relaxed(xovr="swot_xovr_cal_q", u="swot_wse_u", std="swot_wse_std", anomaly="swot_wse_anomaly",
            partial="swot_partial_f") -> Column:
    return _graded(xovr, u, std, anomaly, partial, 0.2, 0.5, 100)


def no_partial(flag="swot_partial_f") -> Column:
    return holds(col(flag) == 0)


def no_ice(flag="ice") -> Column:
    return holds(col(flag) == 0)


def coverage(minimum: float = 99, cover="s2_coverage", ice="ice") -> Column:
    return all_hold([col(cover) > minimum, col(ice) == 0])


def wse_analysis(t="date", **cols) -> Column:
    """Era, simple quality and complete detection together."""
    partial = cols.pop("partial", "swot_partial_f")
    start = cols.pop("start", ERA_START)
    return all_of(era(t, start), simple(**cols), no_partial(partial))


wsa_analysis = wse_analysis
elevation_area_analysis = wse_analysis


def all_of(*masks: Column) -> Column:
    return all_hold(masks)


def idealized(t: float = IDEALIZED_THRESHOLD, abs_error="swot_wse_abs_error", inclusive: bool = False) -> Column:
    return holds(col(abs_error) <= t if inclusive else col(abs_error) < t)


def adaptive(flag="adaptive_filter") -> Column:
    """Accepted by the stored adaptive flag (0 = accepted)."""
    return holds(col(flag) == 0)


def accepted(kind: str, t="date", start: str = ERA_START, abs_error="swot_wse_abs_error",
             flag="adaptive_filter", threshold: float = IDEALIZED_THRESHOLD) -> Column:
    """The two observation sets used for storage: truth-based ``opt``, self-calibrated ``filt``."""
    if kind == "opt":
        return all_of(era(t, start), idealized(threshold, abs_error))
    if kind == "filt":
        return all_of(era(t, start), adaptive(flag))
    raise ValueError(f"unknown filter kind {kind!r}")


def reasonable(value, limit: float = 50) -> Column:
    return holds(F.abs(col(value)) <= limit)


def version(tag: str = "PID0", crid="swot_crid") -> Column:
    return holds(col(crid) == tag)


_CATALOGUE = {
    "era": "observations after the start of the science era",
    "quality_flag": "mission quality flag is zero",
    "simple": "crossover, uncertainty, spread, anomaly and level limits",
    "strict": "tight limits and complete detection",
    "relaxed": "wide limits and complete detection",
    "no_partial": "complete detection only",
    "coverage_99": "image covers more than 99 % of the lake, no ice",
    "coverage_95": "image covers more than 95 % of the lake, no ice",
    "no_ice": "day is free of ice",
    "wse_analysis": "era, simple and complete detection (levels)",
    "wsa_analysis": "era, simple and complete detection (areas)",
    "elevation_area_analysis": "era, simple and complete detection (level-area pairs)",
    "idealized": "level error against truth is below the threshold",
    "adaptive": "accepted by the self-calibrating filter",
}


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_CATALOGUE.items()), "filter string, description string")


def catalogue_map(start: str = ERA_START) -> dict[str, Column]:
    """The filters themselves, by catalogue name and on the standard columns."""
    return {
        "era": era(start=start), "quality_flag": quality_flag(), "simple": simple(), "strict": strict(),
        "relaxed": relaxed(), "no_partial": no_partial(), "coverage_99": coverage(99),
        "coverage_95": coverage(95), "no_ice": no_ice(), "wse_analysis": wse_analysis(start=start),
        "wsa_analysis": wsa_analysis(start=start), "elevation_area_analysis": elevation_area_analysis(start=start),
        "idealized": idealized(), "adaptive": adaptive(),
    }


def filter_counts(df: DataFrame, start: str = ERA_START) -> DataFrame:
    """(filter, description, n): how many rows each filter of the catalogue keeps, in one pass."""
    masks = catalogue_map(start)
    counts = df.agg(*[F.count_if(m).alias(n) for n, m in masks.items()]).unpivot([], list(masks), "filter", "n")
    text = F.create_map(*[F.lit(x) for pair in _CATALOGUE.items() for x in pair])
    return counts.select("filter", F.element_at(text, F.col("filter")).alias("description"), "n")
