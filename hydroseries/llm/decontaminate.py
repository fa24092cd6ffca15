"""Benchmark decontamination: a broadcast hash set of test n-grams against every window of the documents.

Windows are hashed word by word inside Spark expressions; a hash that occurs in the benchmark
is verified on the words themselves. Nothing but hits and one row per document is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.llm.words import WORD, words

#: Most windows that are broadcast (about 150 bytes each); a larger benchmark is joined by hash.
BROADCAST_WINDOWS = 1_000_000


def _doubled(df: DataFrame, longest: int) -> DataFrame:
    """``df`` with h1, h2, h4, ...: hashes of so many words from each word of ``w`` on (those that run past the end are of no use)."""
    df, size = df.withColumn("h1", F.transform("w", lambda x: F.xxhash64(x))), 1
    while 2 * size <= longest:
        df = df.withColumn(f"h{2 * size}", F.zip_with(f"h{size}", F.slice(f"h{size}", F.lit(size + 1), F.size(f"h{size}")), lambda a, b: F.xxhash64(a, b)))
        size *= 2
    return df


def _hashes(length: int) -> Column:
    """Hashes of the windows of ``length`` words, put together from powers of two."""
    powers = [1 << k for k in reversed(range(length.bit_length())) if length >> k & 1]
    out, at = F.col(f"h{powers[0]}"), powers[0]
    for p in powers[1:]:
        out = F.zip_with(out, F.slice(f"h{p}", F.lit(at + 1), F.size("w")), lambda a, b: F.xxhash64(a, b))
        at += p
    return F.when(F.size("w") >= length, F.slice(out, F.lit(1), F.greatest(F.size("w") - F.lit(length - 1), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(len, h, win, items): every distinct window of the items (item_id, text); an item of fewer words, but not none, is one window."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(size)))
    hashed = F.lit(None).cast("array<bigint>")
    for n in range(1, size + 1):
        hashed = F.when(F.col("len") == n, _hashes(n)).otherwise(hashed)
    at = _doubled(items, size).select("item_id", "w", "len", F.posexplode(hashed).alias("at", "h"))
    return (at.select("item_id", "len", "h", F.slice("w", F.col("at") + F.lit(1), F.col("len")).alias("win"))
            .groupBy("len", "h", "win").agg(F.collect_set("item_id").alias("items")))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_hash, n_words, places (distinct (at, len), words from 1), items (distinct item ids).

    A null text has no words. Rows that repeat both doc_id and text each get the same result; a
    null doc_id is a value like others. Items with a null id hit words but have no id to list.
    """
    windows = benchmark_windows(benchmark, size)
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())  # at most ``size`` numbers
    wanted = windows.select(F.col("h").alias("hash"), "win", "items")
    small = windows.count() <= BROADCAST_WINDOWS
    read = _doubled(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w")), size)
    # One more row per document, at place 0, stands for the document itself; then come the windows of each length in turn.
    own = F.array(F.lit(0).cast("long"))
    every = read.select("doc_id", "text_hash", "w", F.size("w").alias("n"), F.posexplode(F.concat(own, *[_hashes(n) for n in lengths])).alias("at", "h"))
    place, before = F.struct(F.col("at"), F.lit(0).alias("len")), F.lit(0)
    for n in lengths:
        place = F.when(F.col("at") > before, F.struct((F.col("at") - before).alias("at"), F.lit(n).alias("len"))).otherwise(place)
        before = before + F.greatest(F.col("n") - F.lit(n - 1), F.lit(0))
    every = every.select("doc_id", "text_hash", "w", "n", "h", place.alias("p")).select("doc_id", "text_hash", "w", "n", "h", "p.at", "p.len")
    if small:
        # Equality of the words is written as two orders, so that the hash alone is the key of the join.
        window = F.slice("w", F.greatest("at", F.lit(1)), F.col("len"))
        met = every.join(F.broadcast(wanted), (F.col("h") == F.col("hash")) & (window <= F.col("win")) & (window >= F.col("win")), "left")
    else:
        cut = every.withColumn("w", F.slice("w", F.greatest("at", F.lit(1)), F.col("len")))
        met = cut.join(wanted, (F.col("h") == F.col("hash")) & (F.col("w") == F.col("win")), "left")
    met = met.where((F.col("at") == 0) | F.col("win").isNotNull())
    is_doc = F.col("at") == 0
    found = met.groupBy("doc_id", "text_hash").agg(
        F.max("n").alias("n_words"), F.count(F.when(is_doc, 1)).alias("copies"),
        F.collect_set(F.when(~is_doc, F.struct("at", "len"))).alias("places"), F.collect_set(F.when(~is_doc, F.col("items"))).alias("items"))
    return found.select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), "places", F.array_distinct(F.flatten("items")).alias("items"),
                        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")


def hit_words(places: Column) -> Column:
    """Distinct word numbers inside any place."""
    return F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p["at"], p["at"] + p["len"] - F.lit(1)))))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Per row: doc_id, n_words, n_hit (words inside an occurrence), n_items, items_sha256, contaminated."""
    ids = F.sort_array(F.transform("items", lambda i: i.cast("string")))
    n_hit = F.size(hit_words(F.col("places"))).cast("long")
    return hits(docs, benchmark, size).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents without any hit, all columns as they were."""
    bad = hits(docs, benchmark, size).where(F.size("places") > 0).select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__bad_id")) & (F.xxhash64("text") == F.col("__bad_hash")), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """All documents; words inside an occurrence, and what stands before each of them, are cut from the text."""
    bad = (hits(docs, benchmark, size).where(F.size("places") > 0)
           .select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash"), hit_words(F.col("places")).alias("__cut")).distinct())
    joined = docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__bad_id")) & (F.xxhash64("text") == F.col("__bad_hash")), "left")
    either = WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    pieces = F.regexp_extract_all("text", F.lit(either), F.lit(0))
    gaps = F.split("text", either)
    kept = F.transform(pieces, lambda word, i: F.when(~F.array_contains("__cut", (i + F.lit(1)).cast("int")), F.concat(F.get(gaps, i), word)).otherwise(F.lit("")))
    rest = F.concat(F.array_join(kept, ""), F.get(gaps, F.size(gaps) - F.lit(1)))
    return joined.withColumn("text", F.when(F.col("__cut").isNull(), F.col("text")).otherwise(rest)).select(*docs.columns)


#: The same in DuckDB, by definition.
PLAIN_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0))),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
