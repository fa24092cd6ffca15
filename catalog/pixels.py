"""Pixel operators (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import query, rounded, shape, table, with_
from hydroseries.operators import pixels as px

PEXPR = {"lake_id": "l_suppkey", "scene_id": "l_orderkey", "ts": "CAST(CONCAT(CAST(year(l_shipdate) AS VARCHAR(4)), '-0', CAST(1 + l_linenumber AS VARCHAR(4)), '-01') AS TIMESTAMP)", "orbit": "1", "spacecraft": "l_linestatus", "x": "CAST(l_quantity AS INT)", "y": "l_linenumber",
         "o4": "l_partkey", "b2": "l_quantity * 10", "b3": "CASE WHEN l_returnflag = 'N' THEN 1500 + l_quantity * 20 ELSE 400 + l_quantity * 5 END",
         "b8": "CASE WHEN l_returnflag = 'N' THEN 300 + l_discount * 3000 ELSE 2000 + l_discount * 4000 END", "b4": "l_extendedprice / 50", "cloud_prob": "l_tax * 1000", "area_m2": "l_quantity * 2",
         "scene_cloud_pct": "l_discount * 700"}
PX = "px AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in PEXPR.items()) + " FROM lineitem)"
MK = "mk AS (SELECT *, CAST(ts AS DATE) AS day, cloud_prob >= 50 AS cloud_mask, cloud_prob < 50 AS clear_mask FROM px)"
IM = "lake_id, day, orbit, spacecraft"
KEEP = "lake_id day spacecraft"


def pixels(spark, d):
    return table(spark, d, "lineitem").selectExpr(*[f"{e} AS `{n}`" for n, e in PEXPR.items()])


def images(spark, d):
    return px.masks(pixels(spark, d)).withColumn("day", F.to_date("ts"))


@query("m1_scenes", shape(with_(PX) + "\nFINAL SELECT spacecraft, count(*) AS n, avg(b4) AS mean_b4 FROM px WHERE scene_cloud_pct < 50 AND ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '2000-01-01' AND month(ts) IN (11, 12, 1, 2, 3, 4, 5) GROUP BY spacecraft",
                          "spacecraft", "n", "mean_b4"))
def scenes(spark, d):
    rows = px.scenes(pixels(spark, d), "1996-01-01", "2000-01-01", ice_season=True)
    return rounded(rows.groupBy("spacecraft").agg(F.count(F.lit(1)).alias("n"), F.avg("b4").alias("mean_b4")))


@query("m2_join_cloud", shape(with_(PX, "cl AS (SELECT scene_id, x, y, cloud_prob, o4 FROM px WHERE spacecraft = 'O')", "f AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY scene_id, x, y ORDER BY o4, cloud_prob) = 1)") + """
FINAL SELECT lake_id, count(*) AS n, avg(f.cloud_prob) AS mean_prob FROM px JOIN f ON px.scene_id = f.scene_id AND px.x = f.x AND px.y = f.y GROUP BY lake_id""", "lake_id", "n", "mean_prob"))
def join_cloud(spark, d):
    p = pixels(spark, d)
    rows = px.join_cloud(p, p.where("spacecraft = 'O'").select("scene_id", "x", "y", "cloud_prob", "o4"), order=("o4", "cloud_prob"))
    return rounded(rows.groupBy("lake_id").agg(F.count(F.lit(1)).alias("n"), F.avg("cloud_prob").alias("mean_prob")))


@query("m3_masks", shape(with_(PX, MK) + "\nFINAL SELECT lake_id, count(*) FILTER (WHERE cloud_mask) AS n_cloud, count(*) FILTER (WHERE clear_mask) AS n_clear FROM mk GROUP BY lake_id", "lake_id", "n_cloud n_clear"))
def masks(spark, d):
    return rounded(images(spark, d).groupBy("lake_id").agg(F.count_if("cloud_mask").alias("n_cloud"), F.count_if("clear_mask").alias("n_clear")))


@query("m4_mosaic", shape(with_(PX, MK, f"mo AS (SELECT * FROM mk QUALIFY row_number() OVER (PARTITION BY {IM}, x, y ORDER BY scene_id DESC, o4 DESC, b4 DESC) = 1)") + f"\nFINAL SELECT {IM}, count(*) AS n, avg(b4) AS mean_b4 FROM mo GROUP BY {IM}",
                          KEEP, "orbit n", "mean_b4"))
def mosaic(spark, d):
    rows = px.mosaic(px.masks(pixels(spark, d)), order=("scene_id", "o4", "b4"))
    return rounded(rows.groupBy(*px.IMAGE).agg(F.count(F.lit(1)).alias("n"), F.avg("b4").alias("mean_b4")))


_COV = f"cv AS (SELECT {IM}, round(count(*) FILTER (WHERE clear_mask) / count(*) * 100) AS coverage FROM mk GROUP BY {IM})"


@query("m5_coverage", shape(with_(PX, MK, _COV) + "\nFINAL SELECT * FROM cv WHERE coverage > 5", KEEP, "orbit", "coverage"))
def coverage(spark, d):
    return rounded(px.coverage(images(spark, d)).where("coverage > 5"))


_ND = "nd AS (SELECT *, CASE WHEN b3 + b8 <> 0 THEN (b3 - b8) / (b3 + b8) * 1000 END AS v FROM mk)"


@query("m6_m7_ndwi_mean", shape(with_(PX, MK, _ND) + f"\nFINAL SELECT {IM}, avg(v) AS ndwi_mean FROM nd WHERE clear_mask GROUP BY {IM}", KEEP, "orbit", "ndwi_mean"))
def ndwi_mean(spark, d):
    return rounded(px.ndwi_mean(images(spark, d)))


_OTSU = f"""wd AS (SELECT *, list_filter([2, 4, 8, 16, 32, 64, 128, 256], lambda w: floor(hi / w) - floor(lo / w) < 255)[1] AS w
 FROM (SELECT {IM}, min(v) AS lo, max(v) AS hi FROM nd WHERE clear_mask AND v IS NOT NULL GROUP BY {IM})),
bn AS (SELECT {IM}, floor(v / w) AS bin, count(*) AS n, sum(v) AS s FROM nd JOIN wd USING ({IM}) WHERE clear_mask AND v IS NOT NULL GROUP BY {IM}, bin),
ac AS (SELECT *, s / n AS m, sum(n) OVER w AS an, sum(s) OVER w AS asum, sum(n) OVER z AS tn, sum(s) OVER z AS ts FROM bn WINDOW w AS (PARTITION BY {IM} ORDER BY bin), z AS (PARTITION BY {IM})),
sc AS (SELECT *, an * (asum / an - ts / tn) ** 2 + CASE WHEN tn > an THEN (tn - an) * ((ts - asum) / (tn - an) - ts / tn) ** 2 ELSE 0 END AS bss FROM ac),
ot AS (SELECT {IM}, m AS threshold FROM sc QUALIFY row_number() OVER (PARTITION BY {IM} ORDER BY round(bss, 3) DESC, m DESC) = 1)"""


@query("m8_otsu", shape(with_(PX, MK, _ND, _OTSU) + "\nFINAL SELECT * FROM ot", KEEP, "orbit", "threshold"))
def otsu(spark, d):
    return rounded(px.otsu(images(spark, d)))


# Levels by definition: counts of the 200 bins as a list, the slices on both sides of the threshold's bin, the first nearest place.
def _levels(where: str = "TRUE") -> str:
    return f"""th AS (SELECT *, CAST(round(threshold / 10) * 10 AS DOUBLE) AS t FROM ot),
kk AS (SELECT *, CAST((t + 1000) / 10 AS INT) AS k FROM th),
hb AS (SELECT {IM}, least(CAST(floor((v + 1000) / 10) AS INT), 199) AS b, count(*) AS c FROM nd WHERE v BETWEEN -1000 AND 1000 AND {where} GROUP BY ALL),
hl AS (SELECT {IM}, list(coalesce(c, 0) ORDER BY i) AS h FROM (SELECT {IM}, i FROM kk, range(200) r(i)) LEFT JOIN (SELECT {IM}, b AS i, c FROM hb) USING ({IM}, i) GROUP BY {IM}),
sl AS (SELECT *, h[1:k] AS land, h[k + 2:199] AS water, h[k + 1] AS mid FROM kk JOIN hl USING ({IM}) WHERE k >= 1 AND k < 198),
pk AS (SELECT *, list_max(land) AS lm, list_max(water) AS wm, list_position(land, list_max(land)) - 1 AS la, list_position(water, list_max(water)) - 1 AS wa FROM sl),
cu AS (SELECT *, list_transform(land[greatest(la - 1, 1) + 1:len(land) - 1], lambda c: abs(c - (lm - (lm - mid) * 0.9))) AS ld,
 list_transform(water[1:least(wa + 1, 199)], lambda c: abs(c - (wm - (wm - mid) * 0.9))) AS wd FROM pk),
lv AS (SELECT {IM}, (list_position(ld, list_min(ld)) - 1 + la) * 10 - 995 AS land_level, (list_position(wd, list_min(wd)) - 1 + k) * 10 - 995 AS water_level FROM cu WHERE len(ld) > 0 AND len(wd) > 0),
wl AS (SELECT {IM}, t AS threshold, land_level, water_level FROM th LEFT JOIN lv USING ({IM}))"""


_AREA = f"""fr AS (SELECT nd.*, (v - land_level) / nullif(water_level - land_level, 0) * 100 AS f FROM nd LEFT JOIN wl USING ({IM})),
ar AS (SELECT {IM}, coalesce(sum(area_m2) FILTER (WHERE f >= 25), -999) AS water_area_25, coalesce(sum(area_m2) FILTER (WHERE f >= 50), -999) AS water_area_50,
 coalesce(sum(area_m2) FILTER (WHERE cloud_mask), -999) AS cloud_area, coalesce(sum(area_m2) FILTER (WHERE clear_mask), -999) AS clear_area FROM fr GROUP BY {IM})"""
_AREAS = "water_area_25 water_area_50 cloud_area clear_area"


@query("m9_water_levels", shape(with_(PX, MK, _ND, _OTSU, _levels()) + "\nFINAL SELECT * FROM wl", KEEP, "orbit", "threshold land_level water_level"))
def water_levels(spark, d):
    return rounded(px.water_levels(images(spark, d)))


@query("m10_water_area", shape(with_(PX, MK, _ND, _OTSU, _levels(), _AREA) + "\nFINAL SELECT * FROM ar", KEEP, "orbit", _AREAS))
def water_area(spark, d):
    return rounded(px.water_area(px.water_fraction(images(spark, d))))


@query("m10_m12_water_series", shape(with_(PX, "mk0 " + MK.split(" ", 1)[1], _COV.replace("FROM mk", "FROM mk0"), f"mk AS (SELECT mk0.* FROM mk0 SEMI JOIN (SELECT * FROM cv WHERE coverage > 5) USING ({IM}))",
                                           _ND, _OTSU, _levels(), _AREA) + f"\nFINAL SELECT ar.*, coverage FROM ar JOIN cv USING ({IM})", KEEP, "orbit", _AREAS + " coverage"))
def water_series(spark, d):
    return rounded(px.water_series(images(spark, d)))


@query("m11_m12_ice_series", shape(with_(PX, MK, _COV) + f"""
FINAL SELECT {IM}, i AS ice_pixels, w AS water_pixels, CASE WHEN i + w > 0 THEN round(i / (i + w) * 100) END AS ice_pct, coverage FROM (SELECT {IM}, count(*) FILTER (WHERE clear_mask AND b4 >= 975) AS i,
 count(*) FILTER (WHERE clear_mask AND b4 < 975) AS w FROM mk GROUP BY {IM}) JOIN cv USING ({IM}) WHERE coverage > 0""", KEEP, "orbit ice_pixels water_pixels", "ice_pct coverage"))
def ice_series(spark, d):
    return rounded(px.ice_series(images(spark, d)))
