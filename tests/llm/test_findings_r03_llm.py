"""Tests of the findings of round 3 on the training-data operators."""

import numpy as np
from pyspark.sql import functions as F
from test_llm import by_id, plain_components, table

from hydroseries.llm import near_dups, neighbours


def edited(rng, base, most):
    w = list(base)
    for p in rng.choice(len(w), int(rng.integers(1, most)), replace=False):
        w[p] = f"n{rng.integers(0, 30)}"
    return " ".join(w)


def test_large_group_of_near_copies_is_exact(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 400, 150)]
    texts = [edited(rng, base, 9) for _ in range(700)] + [" ".join(f"u{k}_{i}" for i in range(40)) for k in range(40)]
    got = by_id(near_dups.near_duplicates(table(spark, texts), words=3, percent=85))
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == plain_components(texts, 3, 85)


def test_blocks_give_one_candidate_a_member_first(spark):
    """A group of n members has n * (n - 1) / 2 pairs above the limit; the best ones are at most two for each member and block."""
    bits = [(i, i % 7) for i in range(600)]
    few = spark.createDataFrame(bits, "rep long, comp long").select(
        F.lit(1).cast("long").alias("node"), F.lit(600).cast("long").alias("size"), "rep", "comp", F.array(F.lit(1).cast("long")).alias("homes"),
        F.lit(100).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("lonely"), *[F.lit(-(2**62) - j).cast("long").alias(b) for j, b in enumerate(near_dups.BITS)])
    assert near_dups._compared(few, 85, best=False).distinct().count() == sum(1 for i in range(600) for j in range(i) if i % 7 != j % 7)
    best = near_dups._compared(few, 85, best=True)
    assert 0 < best.count() <= 3 * 2 * 600
    far = few.withColumn(near_dups.BITS[0], F.when(F.col("rep") % 7 == 0, F.lit(-1).cast("long")).otherwise(F.col(near_dups.BITS[0])))
    for b in near_dups.BITS:  # all bits differ: no candidate, though the absolute values of -1 and 0 differ by one bit only
        far = far.withColumn(b, F.when(F.col("rep") % 7 == 0, F.lit(-1).cast("long")).otherwise(F.lit(0).cast("long")))
    assert near_dups._compared(far.where("comp < 2"), 85, best=False).count() == 0


def test_classes_without_room_for_a_link_are_left_out(spark):
    held = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 12), (2, 13)], "rep long, shingle int")
    assert {r.rep: r.lonely for r in near_dups._lonely(held, "rep", "lonely").collect()} == {1: 1, 2: 2}
    rows = spark.createDataFrame([(100, 15, 100, 0), (100, 16, 100, 0), (100, 10, 100, 10)], "n_shingles long, lonely long, n_shingles_2 long, lonely_2 long")
    assert [r[0] for r in rows.select(near_dups._may_link(85)).collect()] == [True, False, True]
    assert [r[0] for r in rows.select(near_dups._may_link(85, "_2")).collect()] == [False, False, False]


def test_windows_are_counted_by_bits():
    """Every vector that lies in enough windows is found, and what is found lies at most one part outside of them."""
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(1000, 12)), rng.normal(size=(5, 12))
    arrays = neighbours.SortedArrays(v, 32, 4)
    unit, at = v / np.linalg.norm(v, axis=1)[:, None], (q / np.linalg.norm(q, axis=1)[:, None]) @ arrays.axes
    places = unit @ arrays.axes
    for half in (0.3, 0.8, 9.0):
        bits = np.unpackbits(arrays.collided(at, np.full(5, half), 20).view(np.uint8), axis=1, count=1000, bitorder="little").astype(bool)
        rank = np.argsort(np.argsort(places, axis=0), axis=0)
        for i in range(5):
            inside = np.abs(places - at[i]) <= half
            assert bits[i][inside.sum(1) >= 20].all()
            low, high = (places < at[i] - half).sum(0), (places <= at[i] + half).sum(0)
            assert not bits[i][((rank >= low - 9) & (rank < high + 9)).sum(1) < 20].any()
