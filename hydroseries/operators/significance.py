"""Paired tests between methods over the same keys."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries.functions.keyed import known, names
from hydroseries.functions.orderstats import ordered_totals, quantiles
from hydroseries.functions.special import signed_rank_p


#: Decimals of a difference. Averages carry rounding in their last places, which must not part ties.
DIGITS = 8


def paired(df: DataFrame, ids, category: str, categories: Sequence[str], value: str) -> DataFrame:
    """One row per id with a column per category; ids lacking a category are dropped."""
    wide = df.groupBy(*names(ids)).pivot(category, list(categories)).agg(F.avg(value))
    return wide.na.drop(subset=list(categories))


def signed_ranks(df: DataFrame, ids, category: str, pairs: Sequence[tuple[str, str]], metrics: Sequence[str], complete: bool = True) -> DataFrame:
    """Signed-rank sums of every pair and metric (one row each), ties sharing their mean rank.

    ``complete`` keeps only ids that have every category for the metric.
    """
    ids = names(ids)
    cats = sorted({c for p in pairs for c in p})
    cells = [F.avg(F.when(F.col(category) == c, F.col(m))).alias(f"{m}|{c}") for m in metrics for c in cats]
    wide = df.groupBy(*ids).agg(*cells)
    items = []
    for m in metrics:
        whole = F.lit(True)
        for c in cats:
            whole = whole & known(F.col(f"{m}|{c}"))
        for a, b in pairs:
            va, vb = F.col(f"{m}|{a}"), F.col(f"{m}|{b}")
            ok = whole if complete else known(va) & known(vb)
            items.append(F.when(ok, F.struct(F.lit(m).alias("metric"), F.lit(a).alias("group_a"), F.lit(b).alias("group_b"), va.alias("va"), vb.alias("vb"))))
    rows = wide.select(F.explode(F.array_compact(F.array(*items))).alias("_i")).select("_i.*").withColumn("d", F.round(F.col("va") - F.col("vb"), DIGITS))
    by = ["metric", "group_a", "group_b"]
    base = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("d") == 0).alias("n_zero"))
    for v, out in (("va", "median_a"), ("vb", "median_b")):
        base = base.join(quantiles(rows, by, v, {out: 0.5}), by)
    ranks = ordered_totals(rows.where("d <> 0"), by, F.abs(F.col("d")), {"n": F.lit(1), "up": F.when(F.col("d") > 0, 1).otherwise(0)})
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    n = F.col("n").cast("double")
    sums = ranks.groupBy(*by).agg(F.sum(rank * F.col("up")).alias("w_plus"), F.sum(rank * (F.col("n") - F.col("up"))).alias("w_minus"),
                                  F.sum(n * n * n - n).alias("tie_term"), F.sum("n").alias("n_used"))
    return base.join(sums, by).withColumn("w", F.least("w_plus", "w_minus"))


def wilcoxon(df: DataFrame, ids, category: str, pairs: Sequence[tuple[str, str]] | None, metrics: Sequence[str], categories: Sequence[str] = (),
             complete: bool = True, alpha: float = 0.05, exact_up_to: int = 50) -> DataFrame:
    """Two-sided signed-rank tests with stars and the Bonferroni bound; pairs without any difference are left out.

    Up to ``exact_up_to`` differences without ties or zeros the distribution of rank sums is
    counted out; otherwise it is the normal one, corrected for ties.
    """
    pairs = list(pairs or combinations(sorted(categories), 2))
    sums = signed_ranks(df, ids, category, pairs, metrics, complete)
    exact = (F.col("n_used") <= exact_up_to) & (F.col("tie_term") == 0) & (F.col("n_zero") == 0)
    out = sums.withColumn("p_value", signed_rank_p(F.col("w"), F.col("n_used"), F.col("tie_term"), exact))
    p, bound = F.col("p_value"), alpha / (len(pairs) * len(metrics))
    return out.withColumns({"significance": F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns"),
                            "bonferroni_bound": F.lit(bound), "passes_bonferroni": p < bound})


def filter_effect(per_key: DataFrame, ids, metrics, model: str = "swot") -> DataFrame:
    """Truth-based against self-calibrated filter, separately for discrete and continuous values."""
    parts = [wilcoxon(per_key.where((F.col("model") == model) & (F.col("temporal_type") == x)), ids, "filter_type", [("opt", "filt")], metrics)
             .withColumn("subset", F.lit(x)) for x in ("dis", "con")]
    return parts[0].unionByName(parts[1])


def time_effect(per_key: DataFrame, ids, metrics, model: str = "swot") -> DataFrame:
    parts = [wilcoxon(per_key.where((F.col("model") == model) & (F.col("filter_type") == k)), ids, "temporal_type", [("dis", "con")], metrics)
             .withColumn("subset", F.lit(k)) for k in ("opt", "filt")]
    return parts[0].unionByName(parts[1])
