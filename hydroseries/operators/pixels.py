"""Classified image pixels to water area and ice series.

One row per pixel and scene.  Every step reduces pixels by image with partial
aggregation; nothing gathers the pixels of an image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroseries.functions.keyed import attach, day, holds, names

IMAGE = ("lake_id", "day", "orbit", "spacecraft")
MISSING = -999.0


def scenes(px: DataFrame, start: str | None = None, end: str | None = None, max_cloud: float = 50, ice_season: bool = False) -> DataFrame:
    out = px.where(F.col("scene_cloud_pct") < max_cloud)
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col("ts") < F.lit(end).cast("timestamp"))
    if ice_season:
        out = out.where(F.month("ts").isin(11, 12, 1, 2, 3, 4, 5))
    return out


def join_cloud(px: DataFrame, clouds: DataFrame, on=("scene_id", "x", "y"), order=("cloud_prob",)) -> DataFrame:
    """Reflectance with the first matching cloud probability; unmatched pixels are dropped."""
    first = clouds.groupBy(*on).agg(F.min_by("cloud_prob", F.struct(*order)).alias("cloud_prob"))
    return px.drop("cloud_prob").join(first, list(on))


def masks(px: DataFrame, threshold: float = 50) -> DataFrame:
    return px.withColumns({"cloud_mask": holds(F.col("cloud_prob") >= threshold), "clear_mask": holds(F.col("cloud_prob") < threshold)})


def mosaic(px: DataFrame, order=("scene_id",), place=("x", "y")) -> DataFrame:
    """One value per pixel of a day, orbit and spacecraft: the last scene lies on top."""
    rows = px.withColumn("day", day("ts"))
    by = [*IMAGE, *place]
    rest = [c for c in rows.columns if c not in by]
    top = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_p"))
    return top.select(*by, "_p.*")


def coverage(images: DataFrame, image=IMAGE) -> DataFrame:
    """Share of clear pixels per image in whole percent."""
    return images.groupBy(*image).agg(F.round(F.count_if("clear_mask") / F.count(F.lit(1)) * 100).alias("coverage"))


def covered(images: DataFrame, above: float, image=IMAGE) -> DataFrame:
    return attach(images, coverage(images, image).where(F.col("coverage") > above), list(image), "inner")


def ndwi(green="b3", infrared="b8") -> Column:
    g, i = F.col(green).cast("double"), F.col(infrared).cast("double")
    return F.when(g + i != 0, (g - i) / (g + i) * 1000)


def ndwi_mean(images: DataFrame, image=IMAGE) -> DataFrame:
    return images.where("clear_mask").groupBy(*image).agg(F.avg(ndwi()).alias("ndwi_mean"))


def otsu(images: DataFrame, image=IMAGE, width: float = 2, most: int = 255) -> DataFrame:
    """Threshold that separates the two index classes best, from the histogram of clear pixels.

    Buckets are ``width`` wide; an image whose values need more than ``most`` of them gets
    neighbours merged in pairs until they suffice, so its width is doubled as often as needed.
    Cuts whose scores agree to three decimals are one tie, which goes to the larger value.
    """
    image = names(image)
    rows = images.where("clear_mask").select(*image, ndwi().alias("_v")).where("_v IS NOT NULL")
    fine = rows.groupBy(*image, F.floor(F.col("_v") / width).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_s"))
    one = Window.partitionBy(*image)

    def at(x: Column, k: Column) -> Column:
        return F.floor(x / F.pow(F.lit(2.0), k))
    ends = fine.select("*", F.min("_bin").over(one).alias("_a"), F.max("_bin").over(one).alias("_z"))
    times = F.get(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: at(F.col("_z"), k) - at(F.col("_a"), k) < most), F.lit(0))
    bins = ends.groupBy(*image, at(F.col("_bin"), times).alias("_bin")).agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    ordered = Window.partitionBy(*image).orderBy("_bin")
    upto, whole = ordered.rowsBetween(Window.unboundedPreceding, 0), ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    b = bins.select(*image, (F.col("_s") / F.col("_n")).alias("_mean"), F.sum("_n").over(upto).alias("an"), F.sum("_s").over(upto).alias("asum"),
                    F.sum("_n").over(whole).alias("tn"), F.sum("_s").over(whole).alias("tsum"))
    mean, rest = F.col("tsum") / F.col("tn"), F.col("tn") - F.col("an")
    a_dev = F.col("asum") / F.col("an") - mean
    b_dev = F.when(rest > 0, (F.col("tsum") - F.col("asum")) / rest - mean).otherwise(0.0)
    between = F.col("an") * a_dev * a_dev + rest * b_dev * b_dev
    return b.groupBy(*image).agg(F.max_by("_mean", F.struct(F.round(between, 3), F.col("_mean"))).alias("threshold"))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once: inside a lambda a plain column would be worked out for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _first_near(side: Column, top: Column, at: Column) -> Column:
    """Place, from 0, of the first count nearest to one tenth of the way from ``at`` up to ``top``."""
    gaps = F.transform(side, lambda c: F.abs(c - (top - (top - at) * 0.9)))
    return _let(gaps, lambda g: F.array_position(g, F.array_min(g)).cast("int") - 1)


def water_levels(images: DataFrame, image=IMAGE) -> DataFrame:
    """Index values that stand for no and full water, from the peaks on both sides of the threshold.

    Works on a histogram of 200 fixed bins per image, held as one array of its row.  On each side
    the level is the first bin whose count is nearest to one tenth of the way from the count at the
    threshold up to the peak; places are counted from the peak (land) and from the
    threshold (water). An image whose threshold leaves no bin on one side keeps its row without
    levels.
    """
    image = names(image)
    every = otsu(images, image).select(*image, (F.round(F.col("threshold") / 10) * 10).alias("threshold"))
    thr = every.withColumn("k", ((F.col("threshold") + 1000) / 10).cast("int")).where("k >= 1 AND k < 198")
    inside = images.select(*image, ndwi().alias("_v")).where("_v >= -1000 AND _v <= 1000")
    bins = inside.groupBy(*image, F.least(F.floor((F.col("_v") + 1000) / 10), F.lit(199)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    seen = bins.groupBy(*image).agg(F.map_from_entries(F.collect_list(F.struct("b", F.col("n").cast("double")))).alias("_seen"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.coalesce(F.try_element_at(F.col("_seen"), i), F.lit(0.0)))
    # Bin b is element b + 1; the land lies below bin k, the water above it up to bin 198.
    k = F.col("k")
    near = _let(counts, lambda h: _let(
        F.struct(F.get(h, k).alias("at"), F.slice(h, F.lit(1), k).alias("land"), F.slice(h, k + 2, 198 - k).alias("water")), lambda p: _let(
            F.struct(F.array_max(p["land"]).alias("land_top"), F.array_max(p["water"]).alias("water_top")), lambda top: _let(
                F.struct((F.array_position(p["land"], top["land_top"]).cast("int") - 1).alias("peak"), F.array_position(p["water"], top["water_top"]).cast("int").alias("far")), lambda m: F.struct(
                    m["peak"].alias("peak"),
                    _first_near(F.slice(p["land"], F.greatest(m["peak"] - 1, F.lit(1)) + 1, F.greatest(k - 1 - F.greatest(m["peak"] - 1, F.lit(1)), F.lit(0))),
                                top["land_top"], p["at"]).alias("land"),
                    _first_near(F.slice(p["water"], F.lit(1), m["far"]), top["water_top"], p["at"]).alias("water"))))))
    rows = thr.join(seen, image, "left").select(*image, "k", near.alias("_m")).select(
        *image, "k", F.col("_m.peak").alias("_peak"), F.col("_m.land").alias("_nl"), F.col("_m.water").alias("_nw"))
    li = F.col("_nl") + F.col("_peak")
    wi = F.col("_nw") + k
    levels = rows.where("_nl IS NOT NULL AND _nw IS NOT NULL").select(
        *image, (li * 10 - 1000 + 5).cast("double").alias("land_level"), (wi * 10 - 1000 + 5).cast("double").alias("water_level"))
    return every.join(levels, image, "left")


def water_fraction(images: DataFrame, image=IMAGE, cuts=(25, 50, 60, 75)) -> DataFrame:
    """Water fraction (%) of every pixel and the masks at the usual cuts."""
    rows = attach(images, water_levels(images, image), list(image))
    span = F.nullif(F.col("water_level") - F.col("land_level"), F.lit(0.0))
    rows = rows.withColumn("water_fraction", (ndwi() - F.col("land_level")) / span * 100)
    return rows.withColumns({f"water_{c}": holds(F.col("water_fraction") >= c) for c in cuts})


def water_area(fractions: DataFrame, image=IMAGE, cuts=(25, 50)) -> DataFrame:
    """Area of each mask and of clouds per image; -999 when the mask is empty."""
    def area(mask):
        return F.coalesce(F.sum(F.when(F.col(mask), F.col("area_m2"))), F.lit(MISSING))
    return fractions.groupBy(*image).agg(*[area(f"water_{c}").alias(f"water_area_{c}") for c in cuts], area("cloud_mask").alias("cloud_area"),
                                         area("clear_mask").alias("clear_area"))


def water_series(images: DataFrame, image=IMAGE, min_coverage: float = 5) -> DataFrame:
    """Areas of images with enough clear pixels.

    An image's areas depend on its own pixels alone, so whole images are left out at the end, where
    each is one row, instead of joining all pixels with their image's coverage first.
    """
    enough = coverage(images, image).where(F.col("coverage") > min_coverage)
    return water_area(water_fraction(images, image), image).join(enough, list(image))


def ice_fraction(images: DataFrame, image=IMAGE, threshold: float = 975) -> DataFrame:
    """Ice and water pixels among the clear ones and the ice share in whole percent."""
    ice, water = F.count_if(F.col("clear_mask") & (F.col("b4") >= threshold)), F.count_if(F.col("clear_mask") & (F.col("b4") < threshold))
    return images.groupBy(*image).agg(ice.alias("ice_pixels"), water.alias("water_pixels"),
                                      F.when(ice + water > 0, F.round(ice / (ice + water) * 100)).alias("ice_pct"))


def ice_series(images: DataFrame, image=IMAGE, min_coverage: float = 0) -> DataFrame:
    good = covered(images, min_coverage, image)
    return ice_fraction(good, image).join(coverage(images, image), list(image))
