"""MinHash near-duplicates by a chosen-path set similarity join.

Every document is its set of word shingles; equal sets form one class. Classes walk down
random trees: a node sends its members on by the values of a few chosen minwise tokens, so
that similar documents meet and others part. Small nodes are compared exhaustively. In a
large node two leaders are compared with every member, which joins groups of copies without
all their pairs; the members go on to deeper nodes, and a node stops as soon as all its members
are known to hang together. Every link is confirmed on the full sets.

A shingle that no other class holds is in no intersection. A class with more such shingles than a
link leaves room for has no links: it is left out, first by a fixed quarter of all shingles, then, in
large nodes, by all shingles of their members. Both bounds are exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroseries.llm.blocks import LOWER, MULTIPLIERS, NOT_SPACE, mix, run_hashes, text_blocks, word_runs
from hydroseries.llm.store import Store


#: Tokens by which similarity is estimated and deeper nodes branch, as bytes of so many numbers.
POSITIONS = 128
BYTES = [f"s{j}" for j in range(POSITIONS // 8)]
#: Tokens of one bit by which members of large nodes are estimated once more, and by how much the estimate
#: may fall below the limit: four standard deviations at a similarity of 0.85, 3.7 at 0.8.
FINE, FINE_SLACK = 1024, 0.07
BITS = [f"t{j}" for j in range(FINE // 64)]
#: Members of a node that are compared with as many others in one group.
BLOCK = 512
#: Slots of the filter that keeps most texts without a candidate out of the shuffle.
SLOTS = 1 << 23


def document_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has one, a text of none has none."""
    data = LOWER[data]
    starts, ends, row = word_runs(data, offsets, NOT_SPACE)
    word, rows = run_hashes(data, starts, ends), len(offsets) - 1
    total = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(total)[:-1])).astype(np.int64)

    def fold(at: np.ndarray, size: int) -> np.ndarray:
        value = np.full(len(at), size, np.uint64)
        for j in range(size):
            value = value * np.uint64(MULTIPLIERS[2]) + word[at + j]
        return mix(value)

    at = np.flatnonzero(row[:len(row) - words + 1] == row[words - 1:]) if len(row) >= words else np.zeros(0, np.int64)
    value = fold(at, words)
    size = np.maximum(total - words + 1, 0)
    begin = np.concatenate(([0], np.cumsum(size)))
    out = []
    for i in range(rows):
        part = np.sort(value[begin[i]:begin[i + 1]]) if size[i] else fold(first[i:i + 1], int(total[i])) if total[i] else value[:0]
        out.append(part[np.concatenate(([True], part[1:] != part[:-1]))] if len(part) > 1 else part)
    return out


def _scan(words: int, roots: int, seed: int):
    """Minwise tokens of each set: ``roots`` of 32 bits for the first level, then POSITIONS of 8 bits, eight to a number; and 32 bits of a quarter of its shingles."""
    multipliers = np.random.default_rng(seed).integers(1, 2**63, roots + POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    names = ["doc_id", "n_shingles", "f1", "f2", "roots", "some", *BYTES]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches):
            sets = document_sets(data, offsets, words)
            size = np.array([len(x) for x in sets], np.int64)
            full = np.flatnonzero(size)
            flat = np.concatenate(sets) if len(full) else np.zeros(0, np.uint64)
            at = np.concatenate(([0], np.cumsum(size[full])[:-1])).astype(np.int64)
            one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            token = np.zeros((len(sets), roots + POSITIONS), np.uint32)
            if len(full):
                one[full] = np.add.reduceat(mix(flat + np.uint64(MULTIPLIERS[0])), at)
                two[full] = np.add.reduceat(mix(flat ^ np.uint64(MULTIPLIERS[1])), at)
                for k, m in enumerate(multipliers):
                    token[full, k] = np.minimum.reduceat(((flat * m) >> np.uint64(32)).astype(np.uint32), at)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * roots), pa.array(token[:, :roots].copy().view(np.int32).ravel()))
            packed = mix(token[:, roots:].astype(np.uint64)).astype(np.uint8).view(np.int64)
            low = [x[:np.searchsorted(x, np.uint64(1 << 62))] for x in sets]  # sets are sorted
            ends = np.concatenate(([0], np.cumsum([len(x) for x in low]))).astype(np.int32)
            some = pa.ListArray.from_arrays(pa.array(ends), pa.array((np.concatenate(low) >> np.uint64(30)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists, some,
                                              *[pa.array(packed[:, j].copy()) for j in range(len(BYTES))]], names)
    return scan, "doc_id long, n_shingles long, f1 long, f2 long, roots array<int>, some array<int>, " + ", ".join(f"{b} long" for b in BYTES)


def _full_sets(words: int, seed: int):
    """Sets of (rep, text, crowd), and FINE tokens of one bit, 64 to a number, of those in a crowd (others: null)."""
    multipliers = np.random.default_rng(seed + 1).integers(1, 2**63, FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches):
            found = document_sets(data, offsets, words)
            size = np.array([len(x) for x in found], np.int64)
            ends, flat = np.concatenate(([0], np.cumsum(size))), np.concatenate(found)
            crowd = rows.column(2).to_numpy(zero_copy_only=False).astype(bool) & (size > 0)
            token = np.zeros((len(found), FINE), np.uint8)
            if crowd.any():
                here = np.concatenate([x for x, c in zip(found, crowd, strict=True) if c])
                at = np.concatenate(([0], np.cumsum(size[crowd])[:-1])).astype(np.int64)
                for k, m in enumerate(multipliers):
                    token[crowd, k] = mix(np.minimum.reduceat(here * m, at)).astype(np.uint8) & 1
            packed = np.packbits(token, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64))), rows.column(2),
                                              *[pa.array(packed[:, j].copy(), mask=~crowd) for j in range(len(BITS))]], ["rep", "shingles", "crowd", *BITS])
    return sets, "rep long, shingles array<long>, crowd boolean, " + ", ".join(f"{b} long" for b in BITS)


def _lonely(held: DataFrame, by: str, name: str) -> DataFrame:
    """(by, name): how many of the rows (by, shingle) have a shingle that no other ``by`` has."""
    alone = held.groupBy("shingle").agg(F.min(by).alias(by), F.max(by).alias("__other")).where(F.col(by) == F.col("__other"))
    return alone.groupBy(by).agg(F.count(F.lit(1)).alias(name))


def _may_link(percent: int, other: str = "") -> Column:
    """Whether lonely shingles leave room for a link: with any class, or with that of the columns with suffix ``other``."""
    size, alone, size_2, alone_2 = F.col("n_shingles"), F.col("lonely"), F.col("n_shingles" + other), F.col("lonely" + other)
    both = F.least(size - alone, size_2 - alone_2)
    union = F.greatest(size + alone_2, size_2 + alone) if other else size
    return F.lit(100) * both >= F.lit(percent) * union


def _wanted_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text, crowd) of ``wanted`` (doc_id, crowd); a bitmap of at most SLOTS / 64 rows keeps other texts from being shuffled."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    place = lambda df: df.withColumn("__slot", slot).withColumn("__word", F.floor(F.col("__slot") / 64).cast("int")).withColumn("__bit", F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("__slot", F.lit(64)).cast("int")))
    filled = place(wanted).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    texts = place(docs.select("doc_id", "text")).join(F.broadcast(filled), "__word").where(F.col("__bits").bitwiseAND(F.col("__bit")) != 0)
    return texts.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "text", "crowd")


def _agreement(other: str) -> Column:
    """Number of positions where the tokens of a row and those of the same row's columns with suffix ``other`` agree."""
    differ = F.lit(0)
    for b in BYTES:
        x = F.col(b).bitwiseXOR(F.col(b + other))
        for k in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return F.lit(POSITIONS) - differ


def _compared(few: DataFrame, percent: int, best: bool) -> DataFrame:
    """Candidates (a, b) between components of each node, every pair of blocks of BLOCK members in a group of its own.

    ``few``: node, size, rep, comp, homes, n_shingles, lonely and BITS. A pair that shares several
    nodes is compared in the first of them only. With ``best`` each member has only its most alike one.
    """
    count_ = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = few.withColumn("mine", F.pmod(F.xxhash64("rep"), count_).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), count_ - 1)))
    dealt = dealt.select("node", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "mine", "rep", "comp", "homes", "n_shingles", "lonely", *BITS)

    def compare(table: pa.Table) -> pa.Table:
        whole = table.combine_chunks()
        get = lambda name: whole[name].to_numpy()
        rep, comp, mine, size, alone = (get(c) for c in ("rep", "comp", "mine", "n_shingles", "lonely"))
        node, i, j = (whole[c][0].as_py() for c in ("node", "i", "j"))
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        near = comp[left][:, None] != comp[right][None, :]
        if i == j:
            near &= np.triu(np.ones(near.shape, bool), 1)
        homes = whole["homes"].combine_chunks() if isinstance(whole["homes"], pa.ChunkedArray) else whole["homes"]
        homes = homes.combine_chunks() if isinstance(homes, pa.ChunkedArray) else homes
        home, owner = homes.flatten().to_numpy(), np.repeat(np.arange(len(rep)), homes.value_lengths().to_numpy())
        before = home < node
        _, where, times = np.unique(home[before], return_inverse=True, return_counts=True)
        if (times > 1).any():
            column, shared = np.cumsum(times > 1) - 1, (times > 1)[where]
            at = np.zeros((len(rep), int((times > 1).sum())), np.float32)
            at[owner[before][shared], column[where[shared]]] = 1
            near &= at[left] @ at[right].T == 0
        both = np.minimum((size - alone)[left][:, None], (size - alone)[right][None, :])
        union = np.maximum(size[left][:, None] + alone[right][None, :], size[right][None, :] + alone[left][:, None])
        near &= 100 * both >= percent * union
        x, y = np.nonzero(near)
        x, y, differ = left[x], right[y], np.zeros(len(x), np.uint16)
        for b in BITS:
            bits = get(b).view(np.uint64)  # of a negative number, the bits of its absolute value would be counted
            differ += np.bitwise_count(bits[x] ^ bits[y])
        alike = np.flatnonzero(1 - differ * (2 / FINE) >= percent / 100 - FINE_SLACK)
        if best:
            alike = alike[np.argsort(differ[alike], kind="stable")]
            alike = alike[np.unique(np.concatenate([np.unique(side[alike], return_index=True)[1] for side in (x, y)]))]
        one, two = rep[x[alike]], rep[y[alike]]
        return pa.table({"a": np.minimum(one, two), "b": np.maximum(one, two)})

    return dealt.groupBy("node", "i", "j").applyInArrow(compare, "a long, b long")


def _byte(position: Column) -> Column:
    """The 8-bit token at a position from 0."""
    number = F.get(F.array(*BYTES), F.floor(position / 8).cast("int"))
    return F.call_function("shiftrightunsigned", number, F.pmod(position, F.lit(8)).cast("int") * 8).bitwiseAND(F.lit(255))


def components(links: DataFrame, store: Store) -> DataFrame:
    """(rep, comp): the smallest id reachable over links (a, b).

    Labels spread to neighbours and then jump to the label of their label, so the rounds grow
    with the logarithm of the longest chain. A label is always an id of the same component.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.select(F.col("a").alias("rep")).distinct().withColumn("comp", F.col("rep"))

    def spread(labels: DataFrame) -> DataFrame:
        near = both.join(labels.select(F.col("rep").alias("a"), "comp"), "a").groupBy(F.col("b").alias("rep")).agg(F.min("comp").alias("near"))
        return labels.join(near, "rep").select("rep", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))

    while True:
        step = store.keep(spread(labels))
        jump = step.select(F.col("rep").alias("comp"), F.col("comp").alias("next"))
        labels = step.join(jump, "comp", "left").select("rep", F.least("comp", F.coalesce("next", "comp")).alias("comp"))
        if step.where("comp < old").isEmpty():
            return step.select("rep", "comp")


def merged(comp: DataFrame, links: DataFrame, store: Store) -> DataFrame:
    """``comp`` (rep, comp) with further links (a, b): these are looked at between components only, each once."""
    own = lambda side: F.coalesce(f"comp_{side}", side)
    sides = links
    for side in ("a", "b"):
        sides = sides.join(comp.select(F.col("rep").alias(side), F.col("comp").alias(f"comp_{side}")), side, "left")
    between = store.keep(sides.select(F.least(own("a"), own("b")).alias("a"), F.greatest(own("a"), own("b")).alias("b")).where("a < b").distinct())
    if between.isEmpty():
        return comp
    joined = components(between, store)
    old = comp.join(joined.select(F.col("rep").alias("comp"), F.col("comp").alias("next")), "comp", "left").select("rep", F.coalesce("next", "comp").alias("comp"))
    return store.keep(old.union(joined.join(comp, "rep", "left_anti").select("rep", "comp")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, trees: int = 4, tokens: int = 2, small: int = 24,
                    middle: int = 4096, depth: int = 3, slack: float = 0.12, seed: int = 7) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked where ``100 * intersection >= percent * union`` of their shingle
    sets. A pair of similarity s meets in one tree with probability 1 - (1 - s)^tokens a level;
    Nodes of up to ``small`` members are compared exhaustively at the first level. What is left of larger
    ones, once the leaders' links have joined most copies and members without a link are out, is compared
    exhaustively, in blocks, where it has up to ``middle`` members, and goes down otherwise. ``trees`` independent trees are built (at 0.85 and the defaults a pair that parts in small
    nodes of the first level is missed once in four million). ``slack`` is how far the estimate
    from POSITIONS tokens may fall below the limit (nearly four standard deviations) before a
    pair is not confirmed on full sets; between blocks the FINE tokens of one bit, with FINE_SLACK, do that. Nodes that ``depth`` levels have not parted are compared
    exhaustively between their components.

    A null or wordless text has an empty set and no links. A row without doc_id takes no part:
    its component_id is null and it is kept. Rows that share a doc_id are each
    judged by their own text. Other columns are ignored.
    """
    store, least = Store(docs), max(1, int(POSITIONS * (percent / 100 - slack)))
    scan, schema = _scan(words, trees * tokens, seed)
    rows = store.keep(docs.select("doc_id", "text").mapInArrow(scan, schema))
    same, carried = ["n_shingles", "f1", "f2"], ["roots", *BYTES]
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    alone = _lonely(full.select("f1", F.explode("some").alias("shingle")), "f1", "lonely")
    classes = store.keep(full.groupBy(*same).agg(
        F.min("doc_id").alias("rep"), F.first(F.struct(*carried)).alias("of")).join(alone, "f1", "left").select(*same, "rep", "of.*", F.coalesce("lonely", F.lit(0)).alias("lonely")))
    open_ = classes.where(_may_link(percent))
    signed = open_.select("rep", "n_shingles", "lonely", *BYTES)

    def children(parents: DataFrame) -> DataFrame:
        """Every member of a node goes to one child for each of the tokens that the node chooses."""
        places = [F.pmod(F.xxhash64("node", F.lit(j)), F.lit(POSITIONS)) for j in range(tokens)]
        return parents.select("rep", F.explode(F.array(*[F.xxhash64("node", place, _byte(place)) for place in places])).alias("node"))

    comp = sets = tested = crowd = None

    def fresh(candidates: DataFrame) -> DataFrame:
        nonlocal tested
        pairs = store.keep(candidates.distinct() if tested is None else candidates.distinct().join(tested, ["a", "b"], "left_anti"))
        tested = pairs if tested is None else tested.union(pairs)
        return pairs

    def confirm(pairs: DataFrame) -> None:
        nonlocal comp
        found = store.keep(pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
                           .join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
                           .withColumn("both", F.size(F.array_intersect("sa", "sb")))
                           .where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b"))
        comp = components(found, store) if comp is None else merged(comp, found, store)

    frontier = open_.select("rep", F.explode(F.array(*[F.xxhash64(F.lit(k), F.get("roots", F.lit(k))) for k in range(trees * tokens)])).alias("node"))
    for level in count(1):
        if comp is not None:
            frontier = frontier.join(comp, "rep", "left").select("rep", "node", F.coalesce("comp", "rep").alias("comp"))
        else:
            frontier = frontier.withColumn("comp", F.col("rep"))
        drawn = F.struct(F.xxhash64("rep", "node"), "rep")
        nodes = (frontier.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high"),
                                              F.min(drawn).alias("first"), F.max(drawn).alias("last"))
                 .where("low < high").select("node", "size", F.col("first.rep").alias("first"), F.col("last.rep").alias("last")))
        live = store.keep(frontier.join(nodes, "node").join(signed, "rep"))
        is_small = (F.col("size") <= (small if level == 1 else middle)) if level <= depth + 1 else F.lit(True)
        few, many = live.where(is_small), live.where(~is_small)
        # A pair that shares several small nodes is compared in the first of them only.
        few = few.withColumn("homes", F.collect_set("node").over(Window.partitionBy("rep")))
        told = ["n_shingles", "lonely", *BYTES]
        renamed = [F.col(b).alias(f"{b}_2") for b in told]
        alike = _may_link(percent, "_2") & (_agreement("_2") >= least)
        if level == 1:
            other = few.select("node", F.col("rep").alias("rep_2"), F.col("comp").alias("comp_2"), F.col("homes").alias("homes_2"), *renamed)
            first_home = F.array_min(F.array_intersect("homes", "homes_2"))
            close = few.join(other, "node").where((F.col("rep") < F.col("rep_2")) & (F.col("comp") != F.col("comp_2")) & alike & (F.col("node") == first_home)).select(
                F.col("rep").alias("a"), F.col("rep_2").alias("b"))
        else:
            close = _compared(few, percent, best=True)
        lead = many.where("rep = first OR rep = last").select("node", F.col("rep").alias("rep_2"), F.col("comp").alias("comp_2"), *renamed)
        stars = many.join(lead, "node").where((F.col("comp") != F.col("comp_2")) & alike).select(
            F.least("rep", "rep_2").alias("a"), F.greatest("rep", "rep_2").alias("b"))
        pairs = fresh(close.union(stars))
        if sets is None:
            wanted = store.keep(pairs.select(F.col("a").alias("doc_id"), F.lit(False).alias("crowd")).union(pairs.select("b", F.lit(False))).union(many.select("rep", F.lit(True)))
                                .groupBy("doc_id").agg(F.max("crowd").alias("crowd")))
            sets = store.keep(_wanted_texts(docs, wanted).mapInArrow(*_full_sets(words, seed)))
        confirm(pairs)
        if level > 1:  # the best pairs have joined most components; what still lies apart is compared in full
            apart = few.drop("comp").join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
            confirm(fresh(_compared(apart, percent, best=False)))
        if many.isEmpty():
            break
        if crowd is None:
            held = sets.where("crowd")
            alone = _lonely(held.select("rep", F.explode("shingles").alias("shingle")), "rep", "lonely")
            # A doc_id that stands for several texts has several sets: its shingles are not counted as those of one.
            one = held.groupBy("rep").agg(F.count(F.lit(1)).alias("__sets")).where("__sets = 1").join(alone, "rep").drop("__sets")
            crowd = signed.drop("lonely").join(held.select("rep", *BITS), "rep").join(one, "rep", "left").withColumn("lonely", F.coalesce("lonely", F.lit(0)))
            signed = store.keep(crowd.where(_may_link(percent)))
            frontier = many.join(signed.select("rep"), "rep", "left_semi").select("rep", "node")
        else:
            frontier = children(many)

    ends = classes.select(*same, "rep").join(comp, "rep", "left").select(*same, F.coalesce("comp", "rep").alias("component_id"))
    found = rows.select("doc_id", *same).join(ends, same, "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", alone.alias("component_id"), F.coalesce(F.col("doc_id") == alone, F.lit(True)).alias("kept"))


#: The same by definition, for small inputs: all pairs of sets, then the smallest id reachable.
PLAIN_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i:i + {words} - 1], ' ')) END) AS s FROM w),
one AS (SELECT min(doc_id) AS rep, list_sort(s) AS s FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
e AS (SELECT rep, unnest(s) AS g FROM one),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN one x ON x.rep = a JOIN one y ON y.rep = b WHERE 100 * n >= {percent} * (len(x.s) + len(y.s) - n)),
d AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT rep AS x, rep AS y FROM one UNION SELECT r.x, d.b FROM r JOIN d ON d.a = r.y),
c AS (SELECT x AS rep, min(y) AS c FROM r GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.c, s.doc_id) AS component_id, s.doc_id = coalesce(c.c, s.doc_id) AS kept
FROM s LEFT JOIN one ON one.s = list_sort(s.s) LEFT JOIN c USING (rep)
"""


def plain_sql(words: int, percent: int) -> str:
    return PLAIN_SQL.replace("{words}", str(words)).replace("{percent}", str(percent))
