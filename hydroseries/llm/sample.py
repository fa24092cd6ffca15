"""A bounded sample of rows to fit a classifier on, brought to the driver."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int, where: Column | None = None) -> list:
    """At most ``rows`` rows (text, y) for each value of ``label``, of at most ``chars`` characters each, chosen by the hash of doc_id.

    Ids are chosen first from the small label table, so that only the texts of that bounded
    set are read out; the set is small enough to be broadcast by its count.
    """
    ids = labels.where(F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("y"))
    ids = ids.where(where) if where is not None else ids
    drawn = None
    for y in (0, 1):
        part = ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        drawn = part if drawn is None else drawn.union(part)
    found = docs.where(F.length("text") <= chars).select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    read, out = sorted(found.collect(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"])), []
    for y in (0, 1):
        out += [r for r in read if r["y"] == y][:rows]
    return out
