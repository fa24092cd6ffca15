"""Reading and writing of the daily lake table and its side tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroseries.functions.keyed import holds, known, names
from hydroseries.schema import DAILY, SENTINELS

FILE_KEY = r"([^/]+?)(?:_daily)?\.csv[^/]*$"


def key_or_file_name(key: str, file: str, pattern: str = r"([^/]+?)_daily") -> Column:
    """The key column, or the part of the file name that carries it."""
    return F.coalesce(F.col(key), F.nullif(F.regexp_extract(F.col(file), pattern, 1), F.lit("")))


def null_sentinels(df: DataFrame, sentinels: Mapping[str, Sequence[float]] = SENTINELS) -> DataFrame:
    present = {c: v for c, v in sentinels.items() if c in df.columns}
    return df.withColumns({c: F.when(~holds(F.col(c).isin(*v)), F.col(c)) for c, v in present.items()})


def drop_all_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(how="all", subset=list(cols))


def read_daily(spark: SparkSession, paths: str | Sequence[str], combined: str | None = None,
               schema: T.StructType = DAILY, key: str = "swot_lake_id") -> DataFrame:
    """One table from many per-lake CSV files whose columns come in different orders.

    Several CSV files under one header would be matched by position, so files are
    grouped by their header first and each group is read with its own column order.
    Missing columns become NULL, blanks and NaN become NULL, sentinels become NULL.
    ``combined`` names a single file that is read when ``paths`` matches nothing.
    """
    paths = names(paths)
    found = _list_files(spark, paths)
    if not found and combined is not None:
        found = _list_files(spark, [combined])
    if not found:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("row_no", T.LongType())]))
    types = {f.name: f.dataType for f in schema.fields}
    parts = []
    for header, files in _group_by_header(spark, found).items():
        columns = [c.strip().strip('"').lstrip("﻿") for c in header.split(",")]
        text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        raw = (spark.read.schema(text).option("header", True).option("enforceSchema", False).csv(files)
               .withColumn("_file", F.col("_metadata.file_path"))
               .withColumn("row_no", F.monotonically_increasing_id()))
        if key not in columns:
            raw = raw.withColumn(key, F.lit(None).cast("string"))
        raw = raw.withColumn(key, F.coalesce(F.col(key), F.regexp_extract("_file", FILE_KEY, 1)))
        typed = [_typed(c, types[c]).alias(c) for c in dict.fromkeys([*columns, key]) if c in types]
        parts.append(raw.select(*typed, "row_no"))
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    missing = [F.lit(None).cast(t).alias(c) for c, t in types.items() if c not in table.columns]
    return null_sentinels(table.select("*", *missing)).select(*types, "row_no")


def _typed(name: str, dtype: T.DataType) -> Column:
    raw = F.trim(F.col(f"`{name}`"))
    clean = F.when(~F.lower(raw).isin("", "nan", "none", "nat", "null"), raw)
    if isinstance(dtype, T.IntegerType):
        return clean.cast("double").cast("int")
    if isinstance(dtype, T.DateType):
        return F.to_date(F.substring(clean, 1, 10))
    return clean.cast(dtype)


def _list_files(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """Expand path patterns on whatever file system they live on."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out: list[str] = []
    for p in patterns:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        status = path.getFileSystem(conf).globStatus(path)
        out += [s.getPath().toString() for s in (status or [])]
    return sorted(out)


def _group_by_header(spark: SparkSession, files: Sequence[str]) -> dict[str, list[str]]:
    """Header line → files.  The header is the line at offset zero of a file."""
    first = (spark.read.text(list(files), wholetext=False)
             .select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("i"))
             .groupBy("file").agg(F.min_by("value", "i").alias("header")))
    groups = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return {r["header"]: r["files"] for r in groups.collect()}


def read_side(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A side table with a fixed layout; columns are matched by name."""
    raw = spark.read.option("header", True).csv(path)
    have = set(raw.columns)
    return raw.select(*[(_typed(f.name, f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
                        for f in schema.fields])


def write_daily(df: DataFrame, path: str, key: str = "swot_lake_id", buckets: int = 256) -> None:
    """Parquet, cut into key buckets so that one lake is found in one folder.

    Rows of a bucket are spread over writer tasks by day as well, so a bucket that
    holds a large lake is written by several tasks.
    """
    bucketed = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    (bucketed.repartition("bucket", F.year("date"), F.month("date"))
     .sortWithinPartitions("bucket", key, "date")
     .write.mode("errorifexists").partitionBy("bucket").parquet(path))


def write_table(df: DataFrame, path: str, fmt: str = "csv", decimals: int | None = None) -> None:
    """Result table as CSV or Parquet; ``decimals`` fixes the printed digits of doubles."""
    out = df
    if decimals is not None and fmt == "csv":
        doubles = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
        out = df.withColumns({c: F.format_string(f"%.{decimals}f", F.col(c)) for c in doubles})
    writer = out.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def quarantine(df: DataFrame, keys, rules: Sequence[tuple[str, str, int]]) -> tuple[DataFrame, DataFrame]:
    """Split keys by (reason, column, least number of known values) rules.

    Returns the rows of good keys, and one row per bad key with the first reason.
    """
    keys = names(keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"),
                                   *[F.count_if(known(c)).alias(f"_n{i}") for i, (_, c, _) in enumerate(rules)])
    reason = F.coalesce(*[F.when(F.col(f"_n{i}") < least, F.lit(text)) for i, (text, _, least) in enumerate(rules)])
    judged = counts.withColumn("reason", reason)
    bad = judged.where(F.col("reason").isNotNull()).select(*keys, "reason", "n_rows")
    return df.join(bad.select(*keys), keys, "left_anti"), bad


def coverage_summary(df: DataFrame, keys, masks: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*names(keys)).agg(F.count(F.lit(1)).alias("n_rows"),
                                        *[F.count_if(holds(m)).alias(n) for n, m in masks.items()])


def processing_summary(daily: DataFrame, curves: DataFrame, key: str = "swot_lake_id") -> DataFrame:
    """What could be computed per lake: inputs present, curve types, significance."""
    inputs = coverage_summary(daily, key, {
        "n_level": F.col("swot_wse").isNotNull(), "n_accepted": F.col("adaptive_filter") == 0,
        "n_image": F.col("s2_wsa").isNotNull(), "n_gauge": F.col("storage").isNotNull()})
    wide = (curves.groupBy(key).pivot("label", ["swot_opt", "swot_filt", "s2_opt", "s2_filt"])
            .agg(F.first("model_type").alias("model"), F.first("significant").alias("significant")))
    return inputs.join(wide, key, "left")


def summary_totals(summary: DataFrame) -> DataFrame:
    flags = [c for c in summary.columns if c.endswith("_significant")]
    return summary.agg(F.count(F.lit(1)).alias("n_lakes"), F.count_if(F.col("n_accepted") > 0).alias("n_with_accepted"),
                       *[F.count_if(holds(F.col(c))).alias(f"n_{c}") for c in flags])
