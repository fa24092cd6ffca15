"""Views of the test tables as daily observation tables, in Spark and in DuckDB SQL.

``obs`` reads ``lineitem`` as lake observations (supplier = lake, ship date = day);
``events`` is read as a sensor (click, view) next to a truth series (the other types).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

ORDER = ["o1", "o2", "o3", "o4"]


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Column expressions of the observation view; the same text is valid in both engines.
OBS_EXPR = {
    "lake": "l_suppkey",
    "date": "CAST(l_shipdate AS DATE)",
    "o1": "l_orderkey", "o2": "l_linenumber", "o3": "l_extendedprice", "o4": "l_partkey",
    "swot_wse": "l_quantity + 100",
    "swot_wse_anomaly": "l_quantity - 25.5",
    "swot_wse_error": "l_discount - l_tax",
    "swot_wse_abs_error": "abs(l_discount - l_tax)",
    "stage_anomaly": "l_quantity - 25.5 - (l_discount - l_tax)",
    "stage": "l_quantity",
    "storage": "l_extendedprice * 1000",
    "swot_wse_u": "l_discount",
    "swot_wse_std": "l_tax * 5",
    "swot_xovr_cal_q": "l_linenumber - 1",
    "swot_quality_f": "CASE WHEN l_returnflag = 'N' THEN 0 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END",
    "swot_partial_f": "CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END",
    "swot_crid": "CASE WHEN l_linestatus = 'O' THEN 'PID0' ELSE 'PGC0' END",
    "swot_ice_clim_f": "CASE WHEN l_returnflag = 'R' THEN 2 WHEN l_linenumber = 1 THEN 1 ELSE 0 END",
    "swot_pass_id": "l_linenumber",
    "swot_cycle_id": "year(CAST(l_shipdate AS DATE)) * 12 + month(CAST(l_shipdate AS DATE))",
    "swot_xtrk_dist": "l_extendedprice",
    "swot_area_total": "l_extendedprice / 1000",
    "swot_wsa": "l_extendedprice / 1000",
    "wsa": "l_extendedprice / 1000 * (1 + l_tax - l_discount)",
    "s2_wsa": "CASE WHEN l_returnflag <> 'A' THEN l_extendedprice / 1000 END",
    "s2_coverage": "l_quantity * 2",
    "ice": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
    "adaptive_filter": "CASE WHEN l_linenumber <= 5 THEN 0 ELSE 1 END",
    "swot_p_ref_area": "CASE WHEN l_linenumber > 2 THEN CAST(50 AS DOUBLE) + l_linenumber END",
    "flag": "l_returnflag",
    "status": "l_linestatus",
}


def obs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*[f"{e} AS `{n}`" for n, e in OBS_EXPR.items()])


OBS = "obs AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in OBS_EXPR.items()) + " FROM lineitem)"


def ev(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "user_id AS lake", "CAST(ts AS DATE) AS date", "event_id AS o1", "value", "event_type AS kind",
        "event_type IN ('click', 'view') AS sensor", "event_type = 'error' AS iced")


EV = ("ev AS (SELECT user_id AS lake, CAST(ts AS DATE) AS date, event_id AS o1, value, event_type AS kind, "
      "event_type IN ('click', 'view') AS sensor, event_type = 'error' AS iced FROM events)")


def truth_daily(e: DataFrame) -> DataFrame:
    return e.where("NOT sensor").groupBy("lake", "date").agg(F.avg("value").alias("truth"))


TRUTH = "truth AS (SELECT lake, date, avg(value) AS truth FROM ev WHERE NOT sensor GROUP BY lake, date)"


def off_tie(digits: int) -> float:
    """Averages of two-decimal data often end on a rounding tie; this moves both engines off it."""
    return 0.033 * 10.0 ** -digits


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers as bigint: the form both engines are compared in."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("double", "float"):
            out.append(F.round(F.col(f.name) + F.lit(off_tie(digits)), digits).alias(f.name))
        elif kind in ("integer", "short", "byte", "long") or kind.startswith("decimal"):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def shape(sql: str, keep: str = "", ints: str = "", nums: str = "", digits: int = 6) -> str:
    """Wrap an oracle body so that its output has the same form as ``rounded``."""
    body, _, tail = sql.rpartition("\nFINAL ")
    cols = ([c for c in keep.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
            + [f"round(CAST({c} AS DOUBLE) + {off_tie(digits):.12f}, {digits}) + 0 AS {c}" for c in nums.split()])
    return f"{body}\nSELECT {', '.join(cols)} FROM ({tail}) AS final_rows"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


# Quantile helper for oracle text.
def qc(p: float, e: str) -> str:
    return f"quantile_cont({e}, {p})"
