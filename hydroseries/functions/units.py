"""Unit conversions, error columns and other one-line projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.functions.keyed import col, holds

# Fixed value: cubic metres in one acre-foot.
M3_PER_ACFT = 1233.48


def acft_to_m3(c) -> Column:
    return col(c) * F.lit(M3_PER_ACFT)


def m3_to_acft(c) -> Column:
    return col(c) / F.lit(M3_PER_ACFT)


def acft_to_km3(c) -> Column:
    return col(c) * F.lit(M3_PER_ACFT) / F.lit(1e9)


def km3_to_acft(c) -> Column:
    return col(c) * F.lit(1e9) / F.lit(M3_PER_ACFT)


def with_errors(df: DataFrame, estimate="swot_wse_anomaly", truth="stage_anomaly_swotdates",
                error="swot_wse_error", abs_error="swot_wse_abs_error") -> DataFrame:
    """Signed and absolute error; columns that exist already are kept where they have a value."""
    signed = col(estimate) - col(truth)
    if error in df.columns:
        signed = F.coalesce(F.col(error), signed)
    out = df.withColumn(error, signed)
    magnitude = F.abs(F.col(error))
    if abs_error in df.columns:
        magnitude = F.coalesce(F.col(abs_error), magnitude)
    return out.withColumn(abs_error, magnitude)


def with_pct_errors(df: DataFrame, estimate="swot_wsa", truth="wsa", prefix="wsa") -> DataFrame:
    """Residual and percent error, defined only where the truth is positive."""
    usable = holds(col(truth) > 0)
    residual = F.when(usable, col(estimate) - col(truth))
    percent = residual / col(truth) * 100
    return df.withColumns({
        f"{prefix}_residual": residual,
        f"{prefix}_abs_residual": F.abs(residual),
        f"{prefix}_percentage_error": percent,
        f"{prefix}_abs_percentage_error": F.abs(percent),
    })


def split_variant(c) -> dict[str, Column]:
    parts = F.split(col(c), "_")
    return {"model": parts[0], "filter_type": parts[1], "temporal_type": parts[2]}


def log10_clip(c, low: float, high: float) -> Column:
    """log10 of a value pulled into [low, high]; NULL stays NULL."""
    return F.when(col(c).isNotNull(), F.log10(F.greatest(F.lit(low), F.least(F.lit(high), col(c)))))
