"""Approximate nearest neighbours by counting collisions of query-centred windows.

Each of a few dozen random projections is one sorted array of a block of vectors. A query
starts with a narrow window around its own place in every array and widens it step by step
(virtual rehashing); a vector that lies in enough windows is verified on the original
vectors. A query is done when its k-th best verified distance is within the radius that the
windows stand for. Blocks of all rows meet blocks of queries; the best of each are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Window width in units of the radius, factor between radii, the first radius and the share of projections in which a vector must collide.
#: A vector at the radius itself collides with probability 0.683 and is verified with probability 0.95 from 128 projections.
WIDTH, GROWTH, FIRST, SHARE = 2.0, 1.06, 0.2, 0.615


#: Parts into which the ranks of a projection are cut; windows are widened to whole parts. Queries searched at a time.
PARTS, TOGETHER = 128, 64


class SortedArrays:
    """Sorted projections of unit vectors.

    For each projection and each of PARTS + 1 marks along it a row of bits says which vectors lie before
    the mark. A window between two marks is then one exclusive or, and the windows of all projections
    are added up in binary, 64 vectors at a time.
    """

    def __init__(self, vectors: np.ndarray, projections: int, seed: int):
        self.vectors, self.length = vectors, np.sqrt((vectors * vectors).sum(1))
        axes = np.random.default_rng(seed).normal(size=(vectors.shape[1], projections))
        self.axes, n = axes, len(vectors)
        places = ((vectors / self.length[:, None]) @ axes).T
        order = np.argsort(places, axis=1, kind="stable")
        self.places = np.take_along_axis(places, order, 1)
        rank = np.empty((projections, n), np.int32)
        np.put_along_axis(rank, order, np.arange(n, dtype=np.int32)[None, :], 1)
        self.marks = np.unique(np.linspace(0, n, PARTS + 1).astype(np.int64))
        self.before = np.zeros((projections, len(self.marks), -(-n // 64) * 8), np.uint8)
        for k, mark in enumerate(self.marks):
            bits = np.packbits(rank < mark, axis=1, bitorder="little")
            self.before[:, k, :bits.shape[1]] = bits
        self.before = self.before.view(np.uint64)

    def collided(self, at: np.ndarray, half: np.ndarray, need: int) -> np.ndarray:
        """Bits (queries x vectors) of what lies in at least ``need`` windows of ``half`` on either side of ``at``."""
        planes: list[list[np.ndarray]] = [[] for _ in range(len(self.places).bit_length() + 1)]

        def add(bits: np.ndarray, weight: int) -> None:
            planes[weight].append(bits)
            if len(planes[weight]) == 3:
                x, y, z = planes[weight]
                both = x ^ y
                planes[weight] = [both ^ z]
                add((x & y) | (both & z), weight + 1)

        for i, places in enumerate(self.places):
            low = np.searchsorted(self.marks, np.searchsorted(places, at[:, i] - half), "right") - 1
            high = np.searchsorted(self.marks, np.searchsorted(places, at[:, i] + half, "right"))
            add(self.before[i, high] ^ self.before[i, low], 0)
        total = []
        for weight in range(len(planes)):
            while len(planes[weight]) == 2:
                x, y = planes[weight]
                planes[weight] = [x ^ y]
                add(x & y, weight + 1)
            total.append(planes[weight][0] if planes[weight] else np.zeros((len(at), self.before.shape[2]), np.uint64))
        more, same = np.zeros_like(total[0]), np.full_like(total[0], 2**64 - 1)
        for weight in reversed(range(len(total))):
            if need >> weight & 1:
                same &= total[weight]
            else:
                more |= same & total[weight]
                same &= ~total[weight]
        return more | same

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, cosines) of what each query verified; rows where ``own`` says so are the query itself."""
        out = []
        for start in range(0, len(queries), TOGETHER):
            out += self._search(queries[start:start + TOGETHER], own[start:start + TOGETHER], k)
        return out

    def _search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        (m, n), number = self.places.shape, len(queries)
        need = int(np.ceil(SHARE * m))
        length = np.sqrt((queries * queries).sum(1))
        at = (queries / length[:, None]) @ self.axes
        mine = [len(o) for o in own]
        # Windows only grow with the step, so the first step that can have k rows is found by halving.
        reach = np.maximum(at.max(1) - self.places[:, 0].min(), self.places[:, -1].max() - at.min(1))
        last = np.maximum(0, np.ceil(np.log(np.maximum(2 * reach / WIDTH, FIRST) / FIRST) / np.log(GROWTH)).astype(np.int64) + 1)
        low, high = np.zeros(number, np.int64), last.copy()
        while (low < high).any():
            middle = (low + high) // 2
            found = np.bitwise_count(self.collided(at, WIDTH * FIRST * GROWTH**middle / 2, need)).sum(1)
            enough = found >= np.minimum(k + np.array(mine), n)
            high, low = np.where(enough, middle, high), np.where(enough, low, np.minimum(middle + 1, high))
        step, open_ = low, np.arange(number)
        seen = np.zeros((number, n), bool)
        for q in range(number):
            seen[q, own[q]] = True
        rows_, scores = [[] for _ in range(number)], [[] for _ in range(number)]
        while len(open_):
            radius = FIRST * GROWTH**step[open_]
            bits = np.unpackbits(self.collided(at[open_], WIDTH * radius / 2, need).view(np.uint8), axis=1, count=n, bitorder="little").view(bool)
            left = []
            for q, r, hit in zip(open_.tolist(), radius.tolist(), bits, strict=True):
                rows = np.flatnonzero(hit & ~seen[q])
                seen[q, rows] = True
                rows_[q].append(rows)
                scores[q].append((self.vectors[rows] * queries[q]).sum(1) / (self.length[rows] * length[q]))
                near = sum(int((np.sqrt(np.maximum(2 - 2 * s, 0)) <= r).sum()) for s in scores[q])
                if near < k and not seen[q].all():
                    left.append(q)
            open_ = np.array(left, np.int64)
            step[open_] += 1
        return [(np.concatenate(r), np.concatenate(c)) for r, c in zip(rows_, scores, strict=True)]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def usable(vector: Column) -> Column:
    """Not null, not empty, every component finite, not all zero."""
    v = vector.cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, projections: int = 128, block_rows: int = 16_384, query_rows: int = 2_048, seed: int = 13) -> DataFrame:
    """The ``k`` nearest of each query by cosine: query_id, rank, vec_id, score.

    ``vectors``: vec_id, embedding. Queries are the rows whose vec_id is divisible by ``every``;
    a query's own vec_id is no candidate. Ties go to the smaller vec_id. Vectors that are null,
    zero or hold null or non-finite components take no part, nor do rows without vec_id; vectors
    of another length than the query's are no candidates. If a query's vec_id is repeated, its
    smallest vector is searched for; repeated candidates are listed as often as they occur.
    Block sizes bound the memory of a task and change nothing else.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("dim", F.size("v"))
    asked = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-rows.count() // block_rows))
    asked_blocks = max(1, -(-asked.count() // query_rows))
    queries = asked.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    left = rows.withColumn("block", part(blocks)).withColumn("asked", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asked_blocks - 1).cast("long"))))
    right = queries.withColumn("asked", part(asked_blocks)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def cell(data: pa.Table, ask: pa.Table) -> pa.Table:
        if not data.num_rows or not ask.num_rows:
            return kinds.empty_table()
        ids, query_ids = data["vec_id"].to_numpy(), ask["vec_id"].to_numpy()
        q = _matrix(ask["v"])
        arrays, out = SortedArrays(_matrix(data["v"]), projections, seed), []
        for start in range(0, len(q), 256):
            here = query_ids[start:start + 256]
            own = [np.flatnonzero(ids == i) for i in here]
            for i, (found, score) in zip(here, arrays.search(q[start:start + 256], own, k), strict=True):
                best = np.lexsort((ids[found], -score))[:k]
                out.append((np.full(len(best), i), ids[found][best], score[best]))
        return pa.table([np.concatenate([o[j] for o in out]) for j in range(3)], schema=kinds)

    key = ["dim", "block", "asked"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(cell, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
