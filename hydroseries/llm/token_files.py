"""Token counts of documents in flat, unindexed token files, by a scan for separators.

A token file is nothing but identifiers, one after the other, with an end-of-document
identifier after each document. Files are cut into blocks without regard to documents. Every
block is searched for separators at once; a prefix scan over the blocks' separator counts
numbers the documents, and the pieces of a document that crosses blocks are added up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydroseries.llm.store import Store

#: Tokens of a block, and blocks of a file that are numbered together before the files' groups are.
BLOCK_TOKENS, GROUP = 1 << 18, 1024


def read_files(spark: SparkSession, path: str, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (file, block, data) of flat token files below ``path``, which writers cut at 1 GB at most."""
    width = np.dtype(dtype).itemsize * block_tokens

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                whole = content.as_buffer()
                for k, at in enumerate(range(0, max(len(whole), 1), width)):
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([k], pa.int64()), pa.array([whole[at:at + width].to_pybytes()], pa.binary())],
                                                     ["file", "block", "data"])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cut, "file string, block long, data binary")


def write_blocks(docs: DataFrame, ranks: str, pattern: str, eod: int, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents (doc_id, text) as blocks (file, block, data, ids) of one token file for each partition; ``ids`` names the documents that end in a block.

    ``ranks``: file of a byte-pair vocabulary. A null text is empty: its document is a separator alone.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        file, block = str(TaskContext.get().partitionId()), 0
        tokens, ends = np.zeros(0, dtype), []  # of what is not yet a whole block: tokens, and (place after the separator, id)

        def whole(n: int) -> pa.RecordBatch:
            nonlocal tokens, ends, block
            out = pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([tokens[:n].tobytes()], pa.binary()),
                                              pa.array([[i for p, i in ends if p <= n]], pa.list_(pa.int64()))], ["file", "block", "data", "ids"])
            tokens, ends, block = tokens[n:], [(p - n, i) for p, i in ends if p > n], block + 1
            return out

        for batch in batches:
            fresh, size = [tokens], len(tokens)
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encoding.encode_ordinary(text or ""), eod], dtype)
                fresh.append(ids)
                size += len(ids)
                ends.append((size, i))
                if size >= block_tokens:
                    tokens = np.concatenate(fresh)
                    while len(tokens) >= block_tokens:
                        yield whole(block_tokens)
                    fresh, size = [tokens], len(tokens)
            tokens = np.concatenate(fresh)
        if len(tokens):
            yield whole(len(tokens))
    return docs.select("doc_id", "text").mapInArrow(run, "file string, block long, data binary, ids array<long>")


def scan(blocks: DataFrame, eod: int, dtype: str = "<u2") -> DataFrame:
    """Per block: separators, tokens before the first (all, if there is none), tokens after the last, and lengths of what lies between.

    Other columns than file, block and data are passed on.
    """
    carried = [f for f in blocks.schema.fields if f.name not in ("file", "block", "data")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for content in batch.column(2):
                at = np.flatnonzero(np.frombuffer(content.as_buffer(), dtype) == eod) if content.is_valid else np.zeros(0, np.int64)
                size = len(content.as_buffer()) // np.dtype(dtype).itemsize if content.is_valid else 0
                found.append((len(at), int(at[0]), size - 1 - int(at[-1]), np.diff(at) - 1) if len(at) else (0, size, 0, at))
            columns = [pa.array([f[j] for f in found], pa.int64()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array([f[3] for f in found], pa.list_(pa.int64())), *batch.columns[3:]],
                                             ["file", "block", "separators", "head", "tail", "inner", *(f.name for f in carried)])
    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in carried)
    return blocks.select("file", "block", "data", *(f.name for f in carried)).mapInArrow(
        run, f"file string, block long, separators long, head long, tail long, inner array<long>{kept}")


def number(scanned: DataFrame) -> DataFrame:
    """``scanned`` with ``before``: the separators of the file in all earlier blocks, by a prefix scan over groups of blocks and then inside them."""
    group = F.floor(F.col("block") / GROUP).alias("group")
    sums = scanned.groupBy("file", group).agg(F.sum("separators").alias("n"))
    earlier = lambda *key: Window.partitionBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("file", "group", F.coalesce(F.sum("n").over(earlier("file").orderBy("group")), F.lit(0)).alias("start"))
    inside = scanned.select("file", "block", group, "separators").withColumn(
        "within", F.coalesce(F.sum("separators").over(earlier("file", "group").orderBy("block")), F.lit(0)))
    places = inside.join(starts, ["file", "group"]).select("file", "block", (F.col("start") + F.col("within")).alias("before"))
    return scanned.join(places, ["file", "block"])


def token_counts(numbered: DataFrame) -> DataFrame:
    """(file, doc_no, n_tokens, closed): every document of every file, separators not counted; what follows the last separator is a document that is not closed."""
    inner = numbered.select("file", "before", F.posexplode("inner").alias("k", "n_tokens")).select(
        "file", (F.col("before") + F.col("k") + 1).alias("doc_no"), "n_tokens", F.lit(True).alias("closed"))
    some = F.col("separators") > 0
    ends = numbered.select("file", F.explode(F.array(
        F.struct(F.col("before").alias("doc_no"), F.col("head").alias("n"), some.alias("closed")),
        F.struct((F.col("before") + F.col("separators")).alias("doc_no"), F.when(some, F.col("tail")).otherwise(0).alias("n"), F.lit(False).alias("closed")))).alias("e"))
    across = ends.groupBy("file", "e.doc_no").agg(F.sum("e.n").alias("n_tokens"), F.max("e.closed").alias("closed")).where("closed OR n_tokens > 0")
    return inner.union(across.select("file", "doc_no", "n_tokens", "closed"))


def count_documents(docs: DataFrame, ranks: str, pattern: str, eod: int) -> DataFrame:
    """doc_id, n_tokens of every row of ``docs`` (doc_id, text): documents are put into flat token blocks, which are then scanned as files are."""
    scanned = Store(docs).keep(scan(write_blocks(docs, ranks, pattern, eod), eod))
    numbered = number(scanned)
    names = numbered.select("file", "before", F.posexplode("ids").alias("k", "doc_id")).select("file", (F.col("before") + F.col("k")).alias("doc_no"), "doc_id")
    return names.join(token_counts(numbered), ["file", "doc_no"]).select("doc_id", "n_tokens")
