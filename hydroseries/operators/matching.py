"""Joins in time and by key: nearest match, minimum counts, exclusions, size classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.functions.keyed import attach, day, holds, known, names


def nearest_join(left: DataFrame, right: DataFrame, keys, t, right_t, value, tol: int = 3, how: str = "left",
                 out: str = "matched", order=None) -> DataFrame:
    """Value of the nearest right row within ``tol`` days; ties go to the first right row.

    Right rows are reduced to one per (key, day), spread over the days they can serve
    and reduced again to the best candidate per (key, day).  The join itself is an
    equality on key and day, so it never pairs all rows of a key.
    """
    keys = names(keys)
    tie = F.struct(*[F.col(c) for c in (names(order) or [right_t, value])])
    per_day = (right.where(known(value)).select(*keys, day(right_t).alias("_rday"), F.col(value).alias("_v"), tie.alias("_o"))
               .groupBy(*keys, "_rday").agg(F.min("_o").alias("_o"), F.min_by("_v", "_o").alias("_v")))
    offsets = F.array(*[F.lit(i) for i in range(-tol, tol + 1)])
    spread = per_day.select("*", F.explode(offsets).alias("_off"))
    best = (spread.select(*keys, F.date_sub("_rday", F.col("_off")).alias("_day"), F.abs("_off").alias("_dist"), "_o", "_v", "_rday")
            .groupBy(*keys, "_day")
            .agg(F.min_by(F.struct(F.col("_v").alias("v"), F.col("_rday").alias("d")), F.struct("_dist", "_o")).alias("_m"))
            .select(*keys, "_day", F.col("_m.v").alias(out), F.col("_m.d").alias(f"{out}_day")))
    rows = left.withColumn("_day", day(t))
    return rows.join(best, [*keys, "_day"], how).drop("_day")


def min_count(df: DataFrame, keys, value, n: int = 5) -> DataFrame:
    """Rows of keys with at least ``n`` known values."""
    keys = names(keys)
    enough = df.groupBy(*keys).agg(F.count_if(known(value)).alias("_n")).where(F.col("_n") >= n).select(*keys)
    return df.join(enough, keys, "left_semi")


def exclude(df: DataFrame, ids: DataFrame, keys) -> DataFrame:
    return df.join(ids.select(*names(keys)).distinct(), names(keys), "left_anti")


def exclude_by_substring(df: DataFrame, ids: DataFrame, key: str, id_col: str) -> DataFrame:
    """Drop rows whose ``key`` text holds a listed id anywhere, as ``contains`` would find it.

    Every distinct text is cut into its substrings of the lengths that ids have, so that the test
    is an equality join; it costs one row for each place of a text and length of an id. Rows
    without a text stay.
    """
    listed = ids.select(F.col(id_col).cast("string").alias("_id")).where("_id IS NOT NULL").distinct()
    lengths = listed.agg(F.collect_set(F.length("_id")).alias("_lengths"))
    texts = attach(df.select(F.col(key).alias("_text")).where("_text IS NOT NULL").distinct(), lengths, None)
    at = F.length("_text")
    cut = F.flatten(F.transform("_lengths", lambda n: F.when(n <= at, F.transform(F.sequence(F.lit(1), at - n + F.lit(1)), lambda i: F.substring(F.col("_text"), i, n)))
                                .otherwise(F.array().cast("array<string>"))))
    found = texts.select("_text", F.explode(F.array_distinct(cut)).alias("_part")).join(listed, F.col("_part") == F.col("_id"), "left_semi")
    return df.join(found.select("_text").distinct(), F.col(key) == F.col("_text"), "left_anti")


def with_size(df: DataFrame, mapping: DataFrame, keys, area, limit: float = 1.0) -> DataFrame:
    """Size class per key: small below ``limit``, else large; unknown when not mapped."""
    keys = names(keys)
    sizes = mapping.groupBy(*keys).agg(F.first(area, ignorenulls=True).alias("_area"))
    label = (F.when(F.col("_area") < limit, "small").when(F.col("_area").isNotNull(), "large").otherwise("unknown"))
    return df.join(sizes, keys, "left").withColumn("size_class", label).drop("_area")


def common_keys(df: DataFrame, keys, category, n: int, also: DataFrame | None = None) -> DataFrame:
    """Rows of keys present in all ``n`` categories (and in ``also``)."""
    keys = names(keys)
    found = (df.groupBy(*keys).agg(F.count_distinct(F.col(category)).alias("_n")).where(F.col("_n") == n).select(*keys))
    if also is not None:
        found = found.intersect(also.select(*keys))
    return df.join(found, keys, "left_semi")


def merge_on(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, names(on), "left")


def attach_observed(cfg: DataFrame, summary: DataFrame, labels: dict[str, dict[str, str]], order, values) -> DataFrame:
    """First summary row whose columns equal the mapped labels of a configuration row."""
    keys = list(labels)
    first = (summary.groupBy(*keys)
             .agg(F.min_by(F.struct(*names(values)), F.struct(*names(order))).alias("_s"))
             .select(*keys, *[F.col("_s")[c].alias(c) for c in names(values)]))
    mapped = cfg
    for c, table in labels.items():
        lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
        mapped = mapped.withColumn(f"_{c}", lookup[F.col(c)])
    renamed = first.select(*[F.col(c).alias(f"_{c}") for c in keys], *names(values))
    return mapped.join(renamed, [f"_{c}" for c in keys], "left").drop(*[f"_{c}" for c in keys])


def every_combination(df: DataFrame, combos: list[dict]) -> DataFrame:
    """Each row once per configuration; the list is literal, so no join is needed."""
    literal = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in combos])
    return df.select("*", F.explode(literal).alias("_c")).select(*df.columns, "_c.*")
