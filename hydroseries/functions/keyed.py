"""Small helpers shared by all keyed operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def names(cols: str | Iterable[str] | None) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def holds(cond: Column) -> Column:
    """A mask that is never NULL: an unknown comparison counts as not met."""
    return F.coalesce(cond, F.lit(False))


def all_hold(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, [holds(c) for c in conds], F.lit(True))


def known(c: str | Column) -> Column:
    """True where a number is present (neither NULL nor NaN)."""
    return col(c).isNotNull() & ~F.isnan(col(c).cast("double"))


def nan_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    wanted = set(names(cols)) if cols is not None else set(df.columns)
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats & wanted else F.col(c) for c in df.columns
    ])


def attach(df: DataFrame, stats: DataFrame, keys: str | Iterable[str] | None, how: str = "left") -> DataFrame:
    """Put per-key statistics next to the rows they belong to.

    ``stats`` has one row per key.  The join is left to adaptive execution: it is
    broadcast only when its measured size is under the session's limit, and
    otherwise a hot key on the row side is split by the skew-join rule.  Without
    keys ``stats`` is a single row and travels as a scalar subquery.
    """
    keys = names(keys)
    if keys:
        return df.join(stats, keys, how)
    row = stats.select(F.struct(*stats.columns).alias("_row")).scalar()
    out = df.withColumn("_row", row)
    return out.select(*df.columns, *[F.col("_row")[c].alias(c) for c in stats.columns])


def day(t: str | Column) -> Column:
    return F.to_date(col(t))


def days_between(later: str | Column, earlier: str | Column) -> Column:
    return F.datediff(col(later), col(earlier))


def tie(order: Iterable[str]) -> Column:
    """Sort key that makes "first row" well defined."""
    return F.struct(*[F.col(c) for c in names(order)])


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; without one this is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows, written once to a table in the shared folder and read back.

    Survives the loss of executors. Unlike a checkpoint the plan runs once, later plans read only
    the columns they need, and the table's size is known, so that a small one is broadcast.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
