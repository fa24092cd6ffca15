import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroseries import schema
from hydroseries.functions import filters
from hydroseries.operators import pixels as px
from hydroseries.sources import daily as src


def write(path, text):
    path.write_text(text)
    return str(path)


def test_files_with_other_column_orders(spark, tmp_path):
    write(tmp_path / "11_daily.csv", "date,swot_lake_id,swot_wse,storage,swot_quality_f\n2024-01-01,11,5.5,-1233478766.52,0.0\n2024-01-01,11,NaN,7,\n")
    write(tmp_path / "22_daily.csv", "swot_quality_f,swot_wse,extra,date\n1.0,6.5,zzz,2024-02-01 00:00:00\n")
    df = src.read_daily(spark, str(tmp_path / "*_daily.csv"))
    assert df.columns == [*schema.DAILY.names, "row_no"] and len(schema.DAILY.names) == 83
    got = [(r["swot_lake_id"], r["date"], r["swot_wse"], r["storage"], r["swot_quality_f"]) for r in df.orderBy("swot_lake_id", "row_no").collect()]
    assert got == [("11", dt.date(2024, 1, 1), 5.5, None, 0), ("11", dt.date(2024, 1, 1), None, 7.0, None), ("22", dt.date(2024, 2, 1), 6.5, None, 1)]


def test_combined_file_is_the_fallback(spark, tmp_path):
    one = write(tmp_path / "all.csv", "swot_lake_id,date,swot_wse\n7,2024-01-01,1\n")
    assert src.read_daily(spark, str(tmp_path / "none" / "*.csv"), combined=one).first()["swot_lake_id"] == "7"
    assert src.read_daily(spark, str(tmp_path / "none" / "*.csv")).count() == 0


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.23456), ("b", dt.date(2024, 2, 1), 2.0)], "swot_lake_id string, date date, v double")
    src.write_daily(df, str(tmp_path / "daily"), buckets=4)
    assert spark.read.parquet(str(tmp_path / "daily")).drop("bucket").count() == 2
    src.write_table(df.coalesce(1), str(tmp_path / "csv"), decimals=2)
    assert sorted(r["v"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == ["1.23", "2.00"]
    with pytest.raises(Exception):
        src.write_daily(df, str(tmp_path / "daily"))
    side = src.read_side(spark, str(tmp_path / "csv"), schema.EXCLUDED)
    assert sorted(r[0] for r in side.collect()) == ["a", "b"]


def test_catalogue_names_its_filters(spark):
    assert {r["filter"] for r in filters.catalogue(spark).collect()} == set(filters.catalogue_map())


def reference_levels(values, thr):
    """The two levels from a dense 200-bin count list, step by step."""
    c = np.zeros(200)
    for v in values:
        c[min(int((v + 1000) // 10), 199)] += 1
    k = int((thr + 1000) / 10)
    land, water = c[:k], c[k + 1:-1]
    lm, wm = land.max(), water.max()
    li, wi = int(land.argmax()), int(water.argmax())
    s = max(li - 1, 1)
    l2, w2 = np.abs(land[s:-1] - (lm - (lm - c[k]) * 0.9)), np.abs(water[:min(wi + 1, 199)] - (wm - (wm - c[k]) * 0.9))
    return (l2.argmin() + li) * 10 - 1000 + 5, (w2.argmin() + k) * 10 - 1000 + 5


def test_water_levels_on_two_peaks(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(-400, 90, 3000), rng.normal(350, 80, 2000)])
    v = np.clip(v, -990, 990)
    rows = [(1, float(1000 + x), float(1000 - x)) for x in v]
    df = (spark.createDataFrame(rows, "lake_id int, b3 double, b8 double").withColumns(
        {"day": F.lit(dt.date(2024, 1, 1)), "orbit": F.lit(1), "spacecraft": F.lit("A"), "clear_mask": F.lit(True), "cloud_mask": F.lit(False), "area_m2": F.lit(100.0)}))
    row = px.water_levels(df).first()
    assert -200 < row["threshold"] < 200
    assert (row["land_level"], row["water_level"]) == reference_levels([(r[1] - r[2]) / (r[1] + r[2]) * 1000 for r in rows], row["threshold"])
    area = px.water_area(px.water_fraction(df)).first()
    assert 1900 * 100 < area["water_area_50"] < 2100 * 100 and area["cloud_area"] == -999.0


def test_water_peak_next_to_the_upper_edge(spark):
    """A threshold near 970 leaves one bin for water (980 to 990), whose peak must still give a level."""
    from hydroseries.operators import pixels as px
    import pandas as pd

    # (g - i) / (g + i) * 1000 = value for g + i = 2000
    values = [962] * 60 + [964] * 30 + [972] * 10 + [985] * 100
    df = spark.createDataFrame(pd.DataFrame({"b3": [1000 + v for v in values], "b8": [1000 - v for v in values]})).selectExpr(
        "'s' AS lake_id", "DATE'2024-01-01' AS day", "b3", "b8", "true AS clear_mask")
    row = px.water_levels(df, ["lake_id", "day"]).first()
    assert row is not None and row.threshold == 970
