"""How much of the true change over a window is seen, for windows of many lengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroseries.functions.keyed import col, day, known, names

# Window lengths in days.
LENGTHS = (3, 7, 14, 21, 30, 45, 60, 90, 120, 180, 270, 365, 455, 545, 635, 725)


def _number(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1_000_003))


def _offset(sample: Column, length: Column, number: Column, seed: int, free: Column) -> Column:
    mixed = F.lit(7919) * sample + F.lit(104729) * length + F.lit(1299709) * number + F.lit(seed)
    return F.pmod(mixed, free + 1).cast("int")


def sample_windows(ts: DataFrame, keys, t, lengths: Sequence[int] = LENGTHS, n: int | None = 100, seed: int = 42,
                   number: Column | None = None) -> DataFrame:
    """Start days of ``n`` windows per length (all starts when ``n`` is None).

    Offsets come from arithmetic on sample, length, key number and seed, so a rerun or
    another engine draws the same windows.  A length needs to be shorter than the span.
    """
    keys = names(keys)
    number = _number(keys) if number is None else number
    span = ts.groupBy(*keys).agg(F.min(day(t)).alias("first_day"), F.max(day(t)).alias("_last"))
    span = span.withColumn("_free", F.datediff("_last", "first_day"))
    rows = span.select("*", F.explode(F.array(*[F.lit(x) for x in lengths])).alias("length"))
    rows = rows.withColumn("_free", F.col("_free") - F.col("length")).where(F.col("_free") > 0)
    if n is None:
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_free"))).alias("sample")).withColumn("offset", F.col("sample"))
    else:
        rows = (rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample"))
                .withColumn("offset", _offset(F.col("sample"), F.col("length"), number, seed, F.col("_free"))))
    return rows.select(*keys, "length", "sample", "first_day", "offset")


_PARTS = ("truth", "level", "seen_level", "seen_storage")


def _by_day(ts: DataFrame, keys: list[str], t, truth: str, level: str, seen_level: str, seen_storage: str) -> DataFrame:
    """One row per key and day: number of seen values, and number and limits of each kind of value."""
    seen = known(seen_storage)
    parts = {"truth": (truth, known(truth)), "level": (level, known(level)), "seen_level": (seen_level, seen & known(seen_level)),
             "seen_storage": (seen_storage, seen)}
    return ts.groupBy(*keys, day(t).alias("_day")).agg(
        F.count_if(seen).alias("_seen"),
        *[f(F.when(ok, F.col(c))).alias(f"_{side}_{n}") for n, (c, ok) in parts.items() for side, f in (("lo", F.min), ("hi", F.max))],
        *[F.count_if(ok).alias(f"_n_{n}") for n, (c, ok) in parts.items()])


def all_window_ranges(ts: DataFrame, keys, t, truth: str, level: str, seen_level: str, seen_storage: str, lengths: Sequence[int] = LENGTHS) -> DataFrame:
    """``window_ranges`` of every window: each length from each calendar day on that leaves room for it.

    Windows slide over the days of a key, which are sorted once; no window is paired with its
    days. ``sample`` is the offset.
    """
    keys = names(keys)
    days = _by_day(ts, keys, t, truth, level, seen_level, seen_storage).where("_day IS NOT NULL")
    key = Window.partitionBy(*keys)
    days = days.select("*", F.lead("_day").over(key.orderBy("_day")).alias("_next"), F.min("_day").over(key).alias("_first"), F.max("_day").over(key).alias("_last"))
    # A day without rows is a start too.
    i = F.explode(F.sequence(F.lit(0), F.coalesce(F.datediff("_next", "_day"), F.lit(1)) - F.lit(1)))
    values = ["_seen", *[f"_{x}_{n}" for n in _PARTS for x in ("lo", "hi", "n")]]
    days = days.withColumn("_i", i).select(*keys, (F.datediff("_day", "_first") + F.col("_i")).alias("offset"), F.datediff("_last", "_first").alias("_span"),
                                           (F.col("_i") == 0).cast("int").alias("_real"), *[F.when(F.col("_i") == 0, F.col(c)).alias(c) for c in values])
    found = []
    for length in lengths:
        w = key.orderBy("offset").rangeBetween(0, length - 1)

        def reach(n: str, w=w) -> Column:
            return F.when(F.sum(f"_n_{n}").over(w) >= 2, F.max(f"_hi_{n}").over(w) - F.min(f"_lo_{n}").over(w)).otherwise(F.lit(0.0))
        n_seen = F.sum("_seen").over(w)
        found.append(F.struct(F.lit(length).alias("length"), F.max("_real").over(w).alias("_any"), reach("truth").alias("storage_range"), reach("level").alias("wse_range"), n_seen.alias("n_seen"),
                              F.when(n_seen >= 2, reach("seen_level")).otherwise(0.0).alias("seen_wse_range"), F.when(n_seen >= 2, reach("seen_storage")).otherwise(0.0).alias("seen_storage_range")))
    rows = days.select(*keys, "offset", "_span", F.array(*found).alias("_w")).select(*keys, "offset", "_span", F.explode("_w").alias("_w")).select(*keys, "offset", "_span", "_w.*")
    rows = rows.where((F.col("_any") == 1) & (F.col("_span") > F.col("length")) & (F.col("offset") + F.col("length") <= F.col("_span")))
    return rows.select(*keys, "length", F.col("offset").alias("sample"), "offset", "storage_range", "wse_range", "n_seen", "seen_wse_range", "seen_storage_range")


def _day_arrays(ts: DataFrame, keys: list[str], t, *values: str) -> DataFrame:
    """One row per key, whose arrays answer any window of days by a few lookups.

    ``_first``, ``_last``, ``_size``: limits and number of days with rows; ``_place``: number of the first such day at or after each calendar
    day; ``_r_*``: running counts; ``_lo_*`` and ``_hi_*``: limits of 1, 2, 4, … days in a row.
    """
    daily = _by_day(ts, keys, t, *values).where("_day IS NOT NULL")
    sofar = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    limits = [f"_{x}_{n}" for n in _PARTS for x in ("lo", "hi")]
    counts = {"_r_seen": "_seen", **{f"_r_{n}": f"_n_{n}" for n in _PARTS}}
    gap = F.coalesce(F.datediff("_day", F.lag("_day").over(Window.partitionBy(*keys).orderBy("_day"))), F.lit(1))
    daily = daily.select(*keys, "_day", gap.alias("_gap"), *limits, *[F.sum(c).over(sofar).alias(r) for r, c in counts.items()])
    one = daily.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_day", "_gap", *limits, *counts))).alias("_d"), F.min("_day").alias("_first"), F.max("_day").alias("_last"))

    def field(c: str) -> Column:
        # A plain field of the array would be taken out anew at each lookup.
        return F.transform("_d", lambda x: x[c])
    one = one.select(*keys, "_first", "_last", F.size("_d").alias("_size"), F.transform("_d", lambda x, i: F.array_repeat(i, x["_gap"])).alias("_place"),
                     *[field(c).alias(c) for c in (*limits, *counts)])
    # Limits are needed up to the span of a key.
    steps = F.filter(F.array(*[F.lit(2 ** i) for i in range(17)]), lambda h: h * 2 <= F.col("_size"))

    def doubled(c: str) -> Column:
        pick = F.least if c.startswith("_lo") else F.greatest

        def merge(done: Column, half: Column) -> Column:
            last = F.element_at(done, F.lit(-1))
            return F.concat(done, F.array(F.transform(last, lambda x, i: pick(x, F.get(last, i + half)))))
        return F.aggregate(steps, F.array(F.col(c)), merge)
    return one.select(*keys, "_first", "_last", "_size", F.flatten("_place").alias("_place"), *counts, *[doubled(c).alias(c) for c in limits])


def _found(windows: Column) -> Column:
    """Windows (length, sample, offset from the key's first day) with their ranges; empty ones are left out."""
    def at(d: Column) -> Column:
        return F.coalesce(F.get("_place", F.greatest(d, F.lit(0)).cast("int")), F.col("_size"))
    w = F.transform(windows, lambda x: F.struct(x["length"].alias("length"), x["sample"].alias("sample"), x["offset"].alias("offset"),
                                                at(x["at"]).alias("i"), at(x["at"] + x["length"]).alias("j")))
    w = F.transform(F.filter(w, lambda x: x["j"] > x["i"]), lambda x: F.struct(
        *[x[c].alias(c) for c in ("length", "sample", "offset", "i", "j")], F.floor(F.log2(x["j"] - x["i"] + F.lit(0.5))).cast("int").alias("k")))
    # Two runs of 2^k days cover a window; the second one ends with it.
    w = F.transform(w, lambda x: F.struct(*[x[c].alias(c) for c in ("length", "sample", "offset", "i", "j", "k")],
                                          (x["j"] - F.get(F.lit([2 ** i for i in range(17)]), x["k"])).alias("h")))

    def count(x: Column, n: str) -> Column:
        return F.get(f"_r_{n}", x["j"] - F.lit(1)) - F.coalesce(F.get(f"_r_{n}", F.nullif(x["i"], F.lit(0)) - F.lit(1)), F.lit(0))

    def limit(x: Column, side: str, n: str) -> Column:
        row = F.get(f"_{side}_{n}", x["k"])
        return (F.least if side == "lo" else F.greatest)(F.get(row, x["i"]), F.get(row, x["h"]))

    def reach(x: Column, n: str) -> Column:
        return F.when(count(x, n) >= 2, limit(x, "hi", n) - limit(x, "lo", n)).otherwise(F.lit(0.0))

    def ranges(x: Column) -> Column:
        enough = count(x, "seen") >= 2
        return F.struct(x["length"].alias("length"), x["sample"].alias("sample"), x["offset"].alias("offset"), reach(x, "truth").alias("storage_range"),
                        reach(x, "level").alias("wse_range"), count(x, "seen").alias("n_seen"), F.when(enough, reach(x, "seen_level")).otherwise(F.lit(0.0)).alias("seen_wse_range"),
                        F.when(enough, reach(x, "seen_storage")).otherwise(F.lit(0.0)).alias("seen_storage_range"))
    return F.transform(w, ranges)


def window_ranges(ts: DataFrame, windows: DataFrame, keys, t, truth: str, level: str, seen_level: str, seen_storage: str) -> DataFrame:
    """Ranges inside each window; fewer than two values count as no change; empty windows are left out.

    The days and the windows of a key are arrays of its row; no window is paired with its days.
    """
    keys = names(keys)
    own = windows.groupBy(*keys).agg(F.collect_list(F.struct("length", "sample", "offset", "first_day")).alias("_w"))
    days = _day_arrays(ts, keys, t, truth, level, seen_level, seen_storage).hint("merge").join(own.hint("merge"), keys)
    placed = F.transform("_w", lambda x: F.struct(x["length"].alias("length"), x["sample"].alias("sample"), x["offset"].alias("offset"),
                                                  (x["offset"] + F.datediff(x["first_day"], F.col("_first"))).alias("at")))
    return days.select(*keys, F.explode(_found(placed)).alias("_w")).select(*keys, "_w.*")


def key_ranges(ts: DataFrame, keys, t, truth: str, level: str, seen_level: str, seen_storage: str, lengths: Sequence[int] = LENGTHS, n: int = 100,
               seed: int = 42, number: Column | None = None) -> DataFrame:
    """``window_ranges`` of the windows of ``sample_windows``: one row per (key, length) with an array ``windows``.

    Days are shuffled by day and by key, however many lengths there are; windows are drawn inside a key's row.
    """
    keys = names(keys)
    number = _number(keys) if number is None else number
    days = _day_arrays(ts, keys, t, truth, level, seen_level, seen_storage)
    span = F.datediff("_last", "_first")

    def drawn(length: Column) -> Column:
        def one(sample: Column) -> Column:
            offset = _offset(sample, length, number, seed, span - length)
            return F.struct(length.alias("length"), sample.alias("sample"), offset.alias("offset"), offset.alias("at"))
        return F.struct(length.alias("length"), _found(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)).alias("windows"))
    wanted = F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: span > x)
    return days.select(*keys, F.explode(F.transform(wanted, drawn)).alias("_l")).select(*keys, "_l.*").where("size(windows) > 0")


def single_ranges(per_key: DataFrame, keys) -> DataFrame:
    """The windows of ``key_ranges``, one row each."""
    return per_key.select(*names(keys), F.explode("windows").alias("_w")).select(*names(keys), "_w.*")


def percent_observed(seen: str | Column, true: str | Column) -> Column:
    return F.when(col(true) > 0, col(seen) / col(true) * 100).otherwise(F.lit(0.0))


def range_stats(per_key: DataFrame, keys) -> DataFrame:
    """All window statistics per (key, length), from the windows of ``key_ranges``; these are an array of the row, so nothing is sorted or moved."""
    by = [*names(keys), "length"]
    ranges = ("storage_range", "wse_range", "n_seen", "seen_wse_range", "seen_storage_range")
    rows = per_key.select(*by, F.transform("windows", lambda x: x.withField("percent_storage", percent_observed(x["seen_storage_range"], x["storage_range"])).withField(
        "percent_wse", percent_observed(x["seen_wse_range"], x["wse_range"]))).alias("_w"))
    strict = F.filter("_w", lambda x: (x["n_seen"] >= 2) & (x["storage_range"] > 0))
    shares = ("percent_storage", "percent_wse")
    rows = rows.select(*by, *[F.sort_array(F.col("_w")[c]).alias(c) for c in (*ranges, *shares)], F.sort_array(strict["percent_storage"]).alias("percent_storage_v2"))
    every = (*ranges, *shares, "percent_storage_v2")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumns({f"_sum_{c}": total(c) for c in every})
    rows = rows.withColumns({f"{c}_mean": F.col(f"_sum_{c}") / F.nullif(F.size(c), F.lit(0)) for c in every})
    n = F.size("n_seen")

    def middle(c: str) -> Column:
        half = F.size(c) - F.lit(1)
        return (F.get(c, F.floor(half / 2).cast("int")) + F.get(c, F.ceil(half / 2).cast("int"))) / 2

    def spread(c: str) -> Column:
        return F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + (x - F.col(f"{c}_mean")) * (x - F.col(f"{c}_mean"))) / F.nullif(F.size(c), F.lit(0)))

    def share(ok) -> Column:
        return F.size(F.filter("n_seen", ok)) / n * 100
    out = [n.alias("n_windows"), F.size("percent_storage_v2").alias("n_valid_percent")]
    for c in ranges:
        out += [F.col(f"{c}_mean"), middle(c).alias(f"{c}_median"), spread(c).alias(f"{c}_std"), F.array_min(c).alias(f"{c}_min"), F.array_max(c).alias(f"{c}_max")]
    out += [share(lambda x: x >= 2).alias("pct_windows_2plus"), share(lambda x: x == 0).alias("pct_windows_0"), share(lambda x: x == 1).alias("pct_windows_1")]
    for c in (*shares, "percent_storage_v2"):
        out += [F.col(f"{c}_mean"), middle(c).alias(f"{c}_median"), spread(c).alias(f"{c}_std")]
    return rows.select(*by, *out, *[F.col(f"_sum_{c}").alias(f"total_{c}") for c in ("storage_range", "seen_storage_range", "wse_range", "seen_wse_range")])


def range_summary(stats: DataFrame) -> DataFrame:
    """Per length: ratio of totals and means weighted by the number of windows."""
    def ratio(a, b):
        return F.when(F.sum(b) > 0, F.sum(a) / F.sum(b) * 100).otherwise(F.lit(0.0))

    def weighted(v, w):
        return F.sum(F.col(v) * F.col(w)) / F.sum(F.when(known(v), F.col(w)))
    return stats.groupBy("length").agg(
        (F.sum("n_windows") * F.col("length")).alias("total_days"), F.sum("n_windows").alias("total_windows"),
        *[F.sum(f"total_{c}").alias(f"total_{c}") for c in ("storage_range", "seen_storage_range", "wse_range", "seen_wse_range")],
        ratio("total_seen_storage_range", "total_storage_range").alias("overall_percent_storage"),
        ratio("total_seen_wse_range", "total_wse_range").alias("overall_percent_wse"),
        weighted("percent_storage_mean", "n_windows").alias("avg_percent_storage"), weighted("percent_wse_mean", "n_windows").alias("avg_percent_wse"),
        weighted("percent_storage_v2_mean", "n_valid_percent").alias("avg_percent_storage_v2"),
        (F.sum(F.col("pct_windows_2plus") * F.col("n_windows")) / 100).alias("windows_with_2plus"), F.count(F.lit(1)).alias("n_keys"))


def right_closed(c: str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Bin (e0, e1], (e1, e2], …; values at or below the first edge get NULL."""
    x = F.col(c)
    out = F.when(x <= edges[0], F.lit(None).cast("string"))
    for high, label in zip(edges[1:], labels):
        out = out.when(x <= high, F.lit(label))
    return out


# Bins of level range (m) and window length (days).
WSE_BINS = ([0, 0.1, 0.2, 0.5, 1.0, 2.0, float("inf")], ["0-10", "10-20", "20-50", "50-100", "100-200", ">200"])
TIME_BINS = ([0, 7, 14, 30, 60, 90, 180, 365, 1000], ["7", "14", "30", "60", "90", "180", "365", ">365"])


def bin_pivot(df: DataFrame, row: str, column: str, value: str, row_bins=WSE_BINS, col_bins=TIME_BINS, cap: float = 500) -> DataFrame:
    """Mean of ``value`` per cell of two binned columns, as a table with fixed rows and columns; cells without values are null."""
    cells = df.where(F.col(value) < cap).select(right_closed(row, *row_bins).alias("row_bin"), right_closed(column, *col_bins).alias("_c"), value)
    table = cells.where(F.col("row_bin").isNotNull()).groupBy("row_bin").pivot("_c", list(col_bins[1])).agg(F.avg(value))
    every = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(label) for label in row_bins[1]])).alias("row_bin"))
    return every.join(table, "row_bin", "left")
