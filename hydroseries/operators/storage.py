"""From level and area to storage anomalies: all models, filters and time modes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.functions import filters as f
from hydroseries.functions.keyed import attach, cut_lineage, day, holds, known, names
from hydroseries.functions.orderstats import quantiles, rank_value, together
from hydroseries.functions.units import M3_PER_ACFT
from hydroseries.operators import interpolation as ip
from hydroseries.operators.accuracy import explode_filters
from hydroseries.operators.curves import fit_curve, predict, with_significance
from hydroseries.operators.matching import nearest_join

MODELS = ("swot", "swots2", "s2", "static")
FILTERS = ("opt", "filt")
TIMES = ("dis", "con")
POINTS = 100


def storage_above(h: Column, ref: Column, c0: Column, c1: Column, c2: Column) -> Column:
    """Volume between a reference level and ``h`` under an area curve, in acre-feet.

    Equals the trapezoid rule on 100 equal points; zero at or below the reference.
    """
    d = h - ref
    volume = (c0 * d + c1 * (h * h - ref * ref) / 2
              + c2 * ((h * h * h - ref * ref * ref) / 3 + d * d * d / (6 * (POINTS - 1) ** 2)))
    return F.when(h <= ref, F.lit(0.0)).otherwise(volume * 1e6 / M3_PER_ACFT)


def storage_static(h: Column, ref: Column, area: Column) -> Column:
    return area * (h - ref) * 1e6 / M3_PER_ACFT


def masks(t="date", **rules) -> dict[str, Column]:
    return {k: f.accepted(k, t, **rules) for k in FILTERS}


def image_mask() -> Column:
    return f.coverage(99) & known("s2_wsa")


def swot_curve(daily: DataFrame, keys, mask: dict[str, Column], p_value: bool = False) -> DataFrame:
    """Area against level of complete, accepted observations, per filter."""
    rows = explode_filters(daily.where(f.no_partial()), mask)
    return fit_curve(rows, [*names(keys), "filter"], "swot_wse_anomaly", "swot_wsa", p_value=p_value)


def matched_areas(daily: DataFrame, keys, t, order, mask: dict[str, Column], tol: int = 3) -> DataFrame:
    """(key, filter, level, area): accepted levels with the nearest image area within ``tol`` days, written once for all curves."""
    levels = daily.where(known("swot_wse_anomaly"))
    pairs = nearest_join(levels, daily.where(image_mask()), keys, t, t, "s2_wsa", tol, "inner", "s2_matched", order)
    return cut_lineage(explode_filters(pairs, mask).select(*names(keys), "filter", "swot_wse_anomaly", "s2_matched"))


def s2_curve(matched: DataFrame, keys, p_value: bool = False) -> DataFrame:
    return fit_curve(matched, [*names(keys), "filter"], "swot_wse_anomaly", "s2_matched", p_value=p_value)


def inverse_curve(matched: DataFrame, keys) -> DataFrame:
    """Level as a parabola of the image area."""
    return fit_curve(matched, [*names(keys), "filter"], "s2_matched", "swot_wse_anomaly", degrees=(2,))


def reference_levels(daily: DataFrame, keys, mask: dict[str, Column]) -> DataFrame:
    rows = explode_filters(daily.where(known("swot_wse_anomaly")), mask)
    return rows.groupBy(*names(keys), "filter").agg(F.min("swot_wse_anomaly").alias("ref"))


def reference_area(daily: DataFrame, keys, order) -> DataFrame:
    rows = daily.where(known("swot_p_ref_area"))
    return rows.groupBy(*names(keys)).agg(F.min_by("swot_p_ref_area", F.struct(*names(order))).alias("ref_area"))


def parameters(daily: DataFrame, keys, t, order, mask: dict[str, Column]) -> DataFrame:
    """Everything a key needs per filter: reference level and area, three curves."""
    keys = names(keys)
    by = [*keys, "filter"]

    def named(c: DataFrame, tag: str) -> DataFrame:
        return c.select(*by, *[F.col(x).alias(f"{tag}_{x}") for x in ("c0", "c1", "c2")])
    matched = matched_areas(daily, keys, t, order, mask)
    return (reference_levels(daily, keys, mask).join(reference_area(daily, keys, order), keys, "left")
            .join(named(swot_curve(daily, keys, mask), "a"), by, "left")
            .join(named(s2_curve(matched, keys), "b"), by, "left").join(named(inverse_curve(matched, keys), "i"), by, "left"))


def _volumes(level: Column, tag: str = "") -> dict[str, Column]:
    """Volumes of a level by the parameters whose columns begin with ``tag``."""
    ref = F.col(f"{tag}ref")
    return {"swot": storage_above(level, ref, *[F.col(f"{tag}a_c{i}") for i in range(3)]),
            "swots2": storage_above(level, ref, *[F.col(f"{tag}b_c{i}") for i in range(3)]),
            "static": storage_static(level, ref, F.col(f"{tag}ref_area"))}


def _image_volume(area: Column, tag: str = "") -> Column:
    level = predict(area, *[f"{tag}i_c{i}" for i in range(3)])
    return storage_above(level, F.col(f"{tag}ref"), *[F.col(f"{tag}b_c{i}") for i in range(3)])


def _discrete(level: Column, seen: Column, image: Column, area: Column, tag: str = "") -> dict[str, Column]:
    out = {m: F.when(seen, v) for m, v in _volumes(level, tag).items()}
    return {**out, "s2": F.when(image, _image_volume(area, tag))}


def _continuous(found: dict[str, Column], level: Column, area: Column, tag: str = "") -> dict[str, Column]:
    """Discrete volumes where there are any, else those of the filled level or image area."""
    filled = _volumes(level, tag)
    out = {m: F.coalesce(found[m], F.when(level.isNotNull(), filled[m])) for m in ("swot", "swots2", "static")}
    out["s2"] = F.coalesce(found["s2"], F.when(area.isNotNull(), _image_volume(area, tag)), F.when(level.isNotNull(), filled["swots2"]))
    return out


def storage_discrete(daily: DataFrame, par: DataFrame, keys, mask: dict[str, Column]) -> DataFrame:
    """Storage on observation days, one row per (row, filter) with a column per model."""
    keys = names(keys)
    tags = F.array(*[F.struct(F.lit(k).alias("filter"), holds(m).alias("accepted")) for k, m in mask.items()])
    rows = daily.select("*", F.explode(tags).alias("_t")).select(*daily.columns, "_t.*")
    rows = attach(rows, par, [*keys, "filter"])
    seen = F.col("accepted") & known("swot_wse_anomaly")
    out = _discrete(F.col("swot_wse_anomaly"), seen, image_mask(), F.col("s2_wsa"))
    return rows.withColumns({f"{m}_dis": out[m] for m in MODELS})


def _fills(daily: DataFrame, keys: list[str], t, order: list[str], mask: dict[str, Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First row of every (key, day); filled level of every (key, filter, day); filled image area of every (key, day)."""
    free = f.no_ice()
    source = explode_filters(daily.where(free & known("swot_wse_anomaly")), mask)
    tags = F.explode(F.array(*[F.lit(k) for k in mask]))
    targets = daily.where(free).select(*keys, t).withColumn("filter", tags)
    levels = ip.interpolate(source, targets, [*keys, "filter"], t, "swot_wse_anomaly", order, out="level_fill")
    areas = ip.interpolate_rows(daily, keys, t, "s2_wsa", f.coverage(99), free, order, max_gap=30,
                                gap_rule="proximity_if_long", out="area_fill")
    first = daily.groupBy(*keys, day(t).alias("day")).agg(F.min(F.struct(*order)).alias("_first"))
    return first, levels.select(*keys, "filter", "day", "level_fill"), areas.select(*keys, "day", "area_fill")


def gauge_anomaly(daily: DataFrame, keys, mask: dict[str, Column]) -> DataFrame:
    """Gauge storage minus its median on accepted days, acre-feet; NULL where storage or stage is not usable.

    Adds ``storage_anomaly`` (as for ``opt``), ``storage_anomaly_opt`` and ``storage_anomaly_filt``.
    """
    keys = names(keys)
    usable = holds(F.col("storage") >= 0) & holds(F.col("stage") >= 0)
    rows = explode_filters(daily.where(usable), mask)
    mid = quantiles(rows, [*keys, "filter"], "storage", {"_mid": 0.5})
    wide = mid.groupBy(*keys).agg(*[F.max(F.when(F.col("filter") == k, F.col("_mid"))).alias(f"_mid_{k}") for k in mask])
    out = attach(daily, wide, keys)
    value = {k: F.when(usable, (F.col("storage") - F.col(f"_mid_{k}")) / M3_PER_ACFT) for k in mask}
    return out.withColumns({"storage_anomaly": value["opt"], **{f"storage_anomaly_{k}": v for k, v in value.items()}}).drop(
        *[f"_mid_{k}" for k in mask])


def all_curves(daily: DataFrame, keys, t, order, mask: dict[str, Column]) -> DataFrame:
    """Both kinds of curve for both filters with their significance, labelled ``kind_filter``."""
    keys = names(keys)
    a = swot_curve(daily, keys, mask).withColumn("kind", F.lit("swot"))
    b = s2_curve(matched_areas(daily, keys, t, order, mask), keys).withColumn("kind", F.lit("s2"))
    return with_significance(a.unionByName(b)).withColumn("label", F.concat_ws("_", "kind", "filter"))


def variable_area(daily: DataFrame, curves: DataFrame, keys) -> DataFrame:
    """0 when either curve of the truth-based filter is significant, else 1 (one row per key)."""
    keys = names(keys)
    sig = curves.where("filter = 'opt'").groupBy(*keys).agg(F.max(F.col("significant").cast("int")).alias("_s"))
    return (daily.select(*keys).distinct().join(sig, keys, "left")
            .select(*keys, F.when(F.col("_s") == 1, 0).otherwise(1).alias("variable_area")))


def storage_long(daily: DataFrame, keys, t, order, mask: dict[str, Column] | None = None) -> DataFrame:
    """One row per (row, filter): discrete and continuous anomalies of the four models, from the columns of ``storage_variants``."""
    mask = mask or masks(t)
    ids = [*names(keys), t, *[c for c in names(order) if c not in (*names(keys), t)]]
    found = [f"{m}_{x}" for m in MODELS for x in TIMES]
    sides = [F.struct(F.lit(k).alias("filter"), F.col(f"_is_{k}").alias("accepted"), *[F.col(f"{m}_{k}_{x}").alias(f"{m}_{x}") for m in MODELS for x in TIMES]) for k in mask]
    rows = _variants(daily, keys, t, order, mask).select(*ids, F.explode(F.array(*sides)).alias("_s"))
    return rows.select(*ids, "_s.filter", "_s.accepted", *[f"_s.{c}" for c in found])


def storage_variants(daily: DataFrame, keys, t, order, mask: dict[str, Column] | None = None) -> DataFrame:
    """The sixteen columns model × filter × time for every row, the values of ``storage_long`` side by side.

    A row is moved once to its day's fills and once to its key's parameters, with nothing on it but
    its own level, area and marks: parameters, volumes and copies for each filter are not shuffled.
    """
    mask = mask or masks(t)
    ids = [*names(keys), t, *[c for c in names(order) if c not in (*names(keys), t)]]
    return _variants(daily, keys, t, order, mask).select(*ids, *[f"{m}_{k}_{x}" for m in MODELS for k in mask for x in TIMES])


def _medians(usable: DataFrame, par: DataFrame, keys: list[str], mask: dict[str, Column]) -> DataFrame:
    """Per key the medians of the discrete volumes of its accepted rows, one column for each filter and model.

    Levels and areas of a key that is not large are arrays of its row: its eight volumes are worked out there and never moved.
    """
    def of(row, k: str) -> dict[str, Column]:
        return _discrete(row("_h"), row("_h").isNotNull(), row("_area").isNotNull(), row("_area"), f"{k}_")
    parts = []
    for rows, small in together(usable, keys):
        if small:
            own = rows.groupBy(*keys).agg(F.collect_list(F.struct("_h", "_area", *[f"_is_{k}" for k in mask])).alias("_u"))
            own = own.join(par, keys)

            def middle(k: str, m: str) -> Column:
                values = F.transform(F.filter("_u", lambda x: x[f"_is_{k}"]), lambda x: of(lambda c: x[c], k)[m])
                return rank_value(F.sort_array(F.filter(values, known)), 0.5)
            parts.append(own.select(*keys, *[middle(k, m).alias(f"{k}_{m}_mid") for k in mask for m in MODELS]))
        else:
            slots = F.array(*[F.struct(F.lit(f"{k}_{m}").alias("slot"), F.when(F.col(f"_is_{k}"), v).alias("_v")) for k in mask for m, v in of(F.col, k).items()])
            long = attach(rows, par, keys, "inner").select(*keys, F.explode(slots).alias("_s")).select(*keys, "_s.*").where(known("_v"))
            mid = quantiles(long, [*keys, "slot"], "_v", {"_mid": 0.5})
            parts.append(mid.groupBy(*keys).agg(*[F.max(F.when(F.col("slot") == f"{k}_{m}", F.col("_mid"))).alias(f"{k}_{m}_mid") for k in mask for m in MODELS]))
    return reduce(DataFrame.unionByName, parts)


def _variants(daily: DataFrame, keys, t, order, mask: dict[str, Column]) -> DataFrame:
    """The columns of ``storage_variants`` and ``_is_<filter>``: whether the filter accepts a row."""
    keys, order = names(keys), names(order)
    ids = [*keys, t, *[c for c in order if c not in (*keys, t)]]
    par = parameters(daily, keys, t, order, mask)
    sides = [F.max(F.when(F.col("filter") == k, F.col(c))).alias(f"{k}_{c}") for k in mask for c in par.columns if c not in (*keys, "filter")]
    par = cut_lineage(par.groupBy(*keys).agg(*sides))
    marks = {k: holds(m) for k, m in mask.items()}
    raw = daily.select(*ids, day(t).alias("day"), F.when(known("swot_wse_anomaly"), F.col("swot_wse_anomaly")).alias("_h"),
                       F.when(image_mask(), F.col("s2_wsa")).alias("_area"), *[m.alias(f"_is_{k}") for k, m in marks.items()])

    def discrete(k: str) -> dict[str, Column]:
        return _discrete(F.col("_h"), F.col(f"_is_{k}") & F.col("_h").isNotNull(), F.col("_area").isNotNull(), F.col("_area"), f"{k}_")
    usable = raw.where(" OR ".join(f"_is_{k}" for k in mask)).where("_h IS NOT NULL OR _area IS NOT NULL").select(*keys, "_h", "_area", *[f"_is_{k}" for k in mask])
    par = cut_lineage(par.join(_medians(usable, par, keys, mask), keys, "left"))

    first, levels, areas = _fills(daily, keys, t, order, mask)
    levels = levels.groupBy(*keys, "day").agg(*[F.max(F.when(F.col("filter") == k, F.col("level_fill"))).alias(f"_fill_{k}") for k in mask])
    at = [*keys, "day"]
    rows = attach(raw.join(first, at, "left").join(levels, at, "left").join(areas, at, "left").withColumn("_is_first", F.col("_first") == F.struct(*order)).drop("_first"), par, keys)
    out = []
    for k in mask:
        dis = discrete(k)
        con = _continuous(dis, F.when(F.col("_is_first"), F.col(f"_fill_{k}")), F.when(F.col("_is_first"), F.col("area_fill")), f"{k}_")
        out += [(v - F.coalesce(F.col(f"{k}_{m}_mid"), F.lit(0.0))).alias(f"{m}_{k}_{x}") for x, values in (("dis", dis), ("con", con)) for m, v in values.items()]
    return rows.select(*ids, *[f"_is_{k}" for k in mask], *out)
