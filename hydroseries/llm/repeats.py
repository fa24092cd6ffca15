"""Substring dedup by recompression.

Words are the first symbols of a text. A round replaces each maximal run of one symbol by a new
symbol, then each pair of neighbours whose first is of the left and whose second is of the right
half of the alphabet. Names and halves are hashes of what they stand for, the same in every text
and task, so a round needs no table of names; what a name hides is never trusted but compared
again at the end. Equal substrings get equal symbols except near their ends: a symbol is safe
inside a window of words if all words that its parsing looked at lie in the window. The safe
symbol of the highest level (of several, the one with the smallest name) is the anchor of a window, with
all words that its parsing looked at: it depends on the window's words alone, so windows that are equal have equal anchors. Every word is a safe
symbol of level 0, so every window has an anchor.

Spark then settles the names in two rounds over all texts:

1. anchors: which of them stand in more than one text (a sum over all texts, no pairs);
2. windows with such an anchor, as 96-bit hashes of their words: the smallest document of each.

Texts with equal words are one text in both rounds, and every copy but the first loses all words
at once. A text is shuffled once, to meet its shared anchors; texts without any are not looked at
again. A common anchor or window is summed before it is shuffled and split by the skew join after.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries.llm.blocks import MULTIPLIERS, NOT_SPACE, mix, text_blocks, word_runs
from hydroseries.llm.store import Store

#: Rounds over pairs, and after how many of them runs are replaced again. A run looks at both of its
#: neighbours, so every round of runs makes safe symbols rarer. Inside 13 words, symbols of a third
#: level are safe too seldom to make anchors rarer.
ROUNDS, RUN_EVERY = 2, 3
#: Bits of an anchor that are kept. Two anchors that meet in them only leave a window to the next round.
ANCHOR = np.uint64((1 << 48) - 1)

NO_WORDS = hashlib.sha256(b"").hexdigest()


@lru_cache(maxsize=4)
def _powers(multiplier: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2 ** ``bits`` powers of an odd number and of its inverse, modulo 2 ** 64."""
    both = []
    for m in (multiplier, pow(multiplier, -1, 1 << 64)):
        power = np.full(1 << bits, m, np.uint64)
        power[0] = 1
        both.append(np.cumprod(power))
    return both[0], both[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, multiplier: int = MULTIPLIERS[0]) -> np.ndarray:
    """64-bit hashes of byte runs: one running sum over the block, of which each word takes its part."""
    power, back = _powers(multiplier, max(21, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * power[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(MULTIPLIERS[1]))


def levels(names: np.ndarray, rows: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols of every level from 0 on: names, and the words from ``first`` to before ``stop`` that their parsing looked at.

    ``rows`` says of which text a word is. Symbols whose parsing looked at the end of a text are
    left out of the result.
    """
    first = np.arange(len(names))
    stop, inside = first + 1, np.ones(len(names), bool)
    out = [(names, first, stop)]
    for r in range(1, rounds + 1):
        if not len(names):
            break
        salt = np.uint64(r * MULTIPLIERS[2] & 0xFFFFFFFFFFFFFFFF)
        if r % RUN_EVERY == 1:
            # Runs: one symbol for each, which looks at both neighbours of the run.
            head = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (rows[1:] != rows[:-1])))
            tail = np.append(head[1:], len(names))
            size = (tail - head).astype(np.uint64)
            left, right = np.maximum(head - 1, 0), np.minimum(tail, len(names) - 1)
            own = rows[head]
            inside = inside[head] & inside[left] & inside[right] & (head > 0) & (tail < len(names)) & (rows[left] == own) & (rows[right] == own)
            first, stop = first[left], stop[right]
            names = np.where(size > 1, mix(names[head] ^ (size * np.uint64(MULTIPLIERS[0]) + salt)), names[head])
            rows = own
        # Pairs of a left and a right symbol; a symbol that stays alone looks at the neighbour it could have joined.
        n = len(names)
        is_right = (mix(names + salt) >> np.uint64(63)).astype(bool)
        same = rows[1:] == rows[:-1]
        pair = np.append(~is_right[:-1] & is_right[1:] & same, False)
        keep = np.flatnonzero(~np.append(False, pair[:-1]))
        before, after = np.maximum(keep - 1, 0), np.minimum(keep + 1, n - 1)
        linked = np.where(is_right[keep], np.append(False, same)[keep], np.append(same, False)[keep])
        inside = inside[keep] & linked & np.where(is_right[keep], inside[before], inside[after])
        first, stop = np.where(is_right[keep], first[before], first[keep]), np.where(is_right[keep], stop[keep], stop[after])
        names = np.where(pair[keep], mix(names[keep] * np.uint64(MULTIPLIERS[0]) + mix(names[after] ^ salt)), names[keep])
        rows = rows[keep]
        out.append((names[inside], first[inside], stop[inside]))
    return out


def anchors(names: np.ndarray, rows: np.ndarray, size: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``size`` words of one text, and their anchors: a hash of all words that the parsing of the chosen symbol looked at."""
    starts = np.arange(max(len(names) - size + 1, 0))
    starts = starts[rows[starts] == rows[starts + size - 1]]
    found = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return starts, found
    # Sums of powers, so that any range of words has its hash at once; the multiplier is odd and so has an inverse.
    power, back = _powers(MULTIPLIERS[0], max(21, int(len(names)).bit_length()))
    total = np.append(np.uint64(0), np.cumsum(mix(names) * power[:len(names)]))
    left = np.arange(len(starts))
    for name, first, stop in reversed(levels(names, rows, rounds)):
        fits = stop - first <= size
        name, first, stop = name[fits], first[fits], stop[fits]
        at = starts[left]
        low, high = np.searchsorted(first, at, "left"), np.searchsorted(stop, at + size, "right")
        has = low < high
        low, high, here = low[has], high[has], left[has]
        best, pick, k = name[low], low.copy(), 1
        more = np.flatnonzero(low + k < high)
        while len(more):
            other = name[low[more] + k]
            less = other < best[more]
            best[more[less]] = other[less]
            pick[more[less]] += k - (pick[more[less]] - low[more[less]])
            k += 1
            more = more[low[more] + k < high[more]]
        a, b = first[pick], stop[pick]
        found[here] = mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64)) & ANCHOR
        left = left[~has]
        if not len(left):
            break
    return starts, found


def window_hashes(names: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` names from each start on, put together from powers of two."""
    powers = [names]
    while 2 << (len(powers) - 1) <= size:
        h, step = powers[-1], 1 << (len(powers) - 1)
        powers.append(mix(h[:len(h) - step] * np.uint64(MULTIPLIERS[0]) + h[step:]) if len(h) > step else h[:0])
    out, at = np.zeros(len(starts), np.uint64), 0
    for k in reversed(range(len(powers))):
        if size >> k & 1:
            out = mix(out * np.uint64(MULTIPLIERS[1]) + powers[k][starts + at])
            at += 1 << k
    return out


def _double(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, size: int, names: np.ndarray) -> np.ndarray:
    """Two independent hashes of the words of each window, of 64 and 32 bits, one row for each."""
    other = word_hashes(data, starts, ends, MULTIPLIERS[2])
    return np.stack([window_hashes(names, at, size), window_hashes(other, at, size) >> np.uint64(32)], 1)


def read_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, words_sha): the words joined by one space as a digest."""
    kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("words_sha", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_blocks(batches):
            raw = data.tobytes()
            words = [raw[a:b].split() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, words), pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).digest() for w in words], pa.binary())], schema=kind)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, words_sha binary")


def text_anchors(docs: DataFrame, size: int, rounds: int = ROUNDS) -> DataFrame:
    """(doc, anchor): the distinct anchors of all windows of each text with a doc_id."""
    kind = pa.schema([("doc", pa.int64()), ("anchor", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_blocks(batches):
            starts, ends, rows = word_runs(data, offsets, NOT_SPACE)
            at, found = anchors(word_hashes(data, starts, ends), rows, size, rounds)
            if not len(at):
                continue
            of = rows[at]
            turn = np.append(True, (found[1:] != found[:-1]) | (of[1:] != of[:-1]))
            of, found = of[turn], found[turn]
            order = np.lexsort((found, of))
            of, found = of[order], found[order]
            first = np.append(True, (found[1:] != found[:-1]) | (of[1:] != of[:-1]))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(ids[of[first]], pa.int64()), pa.array(found[first].view(np.int64))], schema=kind)

    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc long, anchor long")


def _windows(texts: DataFrame, size: int, rounds: int, later: bool = False) -> DataFrame:
    """(doc_id, a, b): distinct windows of each text (doc_id, text, shared) whose anchor is one of ``shared``; with ``later``, one that also stands in a smaller document."""
    kind = pa.schema([("doc_id", pa.int64()), ("a", pa.int64()), ("b", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_blocks(batches):
            starts, ends, rows = word_runs(data, offsets, NOT_SPACE)
            names = word_hashes(data, starts, ends)
            at, found = anchors(names, rows, size, rounds)
            if not len(at):
                continue
            shared = batch.column(2)
            counts = shared.value_lengths().to_numpy(zero_copy_only=False)
            own, of = shared.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.repeat(np.arange(len(counts)), counts)
            if later:
                own, of = own[own > ANCHOR], of[own > ANCHOR]
            mine = _in_row(of, own & ANCHOR)
            at = at[np.isin(_in_row(rows[at], found), mine)]
            both = _double(data, starts, ends, at, size, names)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[rows[at]]
            order = np.lexsort((both[:, 1], both[:, 0], ids))
            ids, both = ids[order], both[order]
            one = np.append(True, (ids[1:] != ids[:-1]) | (both[1:] != both[:-1]).any(1)) if len(ids) else np.zeros(0, bool)
            ids, both = ids[one], both[one]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(both[:, 0].view(np.int64)), pa.array(both[:, 1].astype(np.uint32).view(np.int32))], schema=kind)

    return texts.mapInArrow(run, "doc_id long, a long, b int")


def _in_row(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One number for a value in a row (equal ones for equal pairs; two pairs may meet, which only keeps a window for the next round)."""
    return mix(values + rows.astype(np.uint64) * np.uint64(MULTIPLIERS[0]))


def _cut(texts: DataFrame, size: int) -> DataFrame:
    """Texts (doc_id, text, a, b: hashes of windows that start in a smaller document) without their covered words: doc_id, words_sha, n_removed, kept_sha, kept."""
    kind = pa.schema([("doc_id", pa.int64()), ("words_sha", pa.binary()), ("n_removed", pa.int64()), ("kept_sha", pa.binary()), ("kept", pa.large_string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_blocks(batches):
            starts, ends, rows = word_runs(data, offsets, NOT_SPACE)
            names = word_hashes(data, starts, ends)
            first = np.arange(max(len(names) - size + 1, 0))
            at = first[rows[first] == rows[first + size - 1]]
            both = _double(data, starts, ends, at, size, names)
            counts = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            known = [batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3)]
            two = np.dtype([("row", np.int64), ("a", np.uint64), ("b", np.uint64)])
            have, want = np.zeros(len(at), two), np.zeros(len(known[0]), two)
            have["row"], have["a"], have["b"] = rows[at], both[:, 0], both[:, 1]
            want["row"], want["a"], want["b"] = np.repeat(np.arange(len(counts)), counts), known[0].astype(np.int64).view(np.uint64), known[1].astype(np.int32).view(np.uint32)
            place = at[np.isin(have, want)]
            edge = np.bincount(place, minlength=len(names) + 1) - np.bincount(place + size, minlength=len(names) + 1)
            stays = np.cumsum(edge)[:len(names)] == 0
            heads = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            raw, out = data.tobytes(), []
            for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                words, mask = raw[a:b].split(), stays[heads[k]:heads[k + 1]].tolist()
                kept = b" ".join(compress(words, mask))
                out.append((hashlib.sha256(b" ".join(words)).digest(), len(mask) - sum(mask), hashlib.sha256(kept).digest(), kept))
            digest, removed, kept_sha, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(removed, pa.int64()), pa.array(kept_sha, pa.binary()), pa.array(kept, pa.binary()).cast(pa.string()).cast(pa.large_string())], schema=kind)

    return texts.mapInArrow(run, "doc_id long, words_sha binary, n_removed long, kept_sha binary, kept string")


def _found(docs: DataFrame, size: int, rounds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows (doc_id, n_words, words_sha); the smallest document of texts with equal words, where it has copies; the texts that lose some words."""
    if size < 2:
        raise ValueError("a window has two words at least")
    read = Store(docs).keep(read_texts(docs))
    long = read.where((F.col("n_words") >= size) & F.col("doc_id").isNotNull())
    texts = long.groupBy("words_sha").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    # The first text of each class alone. All joins of texts are by doc_id, so that one shuffle serves all of what follows.
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(texts.select("first_id").distinct(), F.col("doc_id") == F.col("first_id"), "left_semi")
    each = text_anchors(whole, size, rounds)
    shared = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("low")).where("n > 1").select(F.col("anchor").alias("common"), "low")
    # A bit above the anchor says that a smaller document has it too: only then can a window be covered.
    marked = F.col("anchor") + F.when(F.col("doc") > F.col("low"), F.lit(int(ANCHOR) + 1)).otherwise(F.lit(0))
    own = each.join(shared, F.col("anchor") == F.col("common")).groupBy("doc").agg(F.collect_set(marked).alias("shared"))
    near = whole.join(own, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "shared")
    lowest = _windows(near, size, rounds).groupBy("a", "b").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("a").alias("a1"), F.col("b").alias("b1"), "low")
    late = _windows(near, size, rounds, later=True).join(lowest, (F.col("a") == F.col("a1")) & (F.col("b") == F.col("b1")) & (F.col("doc_id") > F.col("low")))
    seen = late.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    cut = _cut(whole.join(seen, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "a", "b"), size)
    return read, texts.where("first_id < last_id").select(F.col("words_sha").alias("copied"), "first_id"), cut.where("n_removed > 0")


def removed_words(docs: DataFrame, size: int = 13, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept (the words that stay, joined by one space; null where none is removed) and kept_sha256.

    A word goes if it lies in a window of ``size`` words that also starts in a document with a
    smaller doc_id; windows are judged on the input. A null text has no words. A text shorter than
    a window stays whole. Rows of one doc_id do not count against each other; a row with a null
    doc_id is neither smaller nor larger than another, so it stays whole and removes nothing.
    """
    read, copied, cut = _found(docs, size, rounds)
    cut = cut.groupBy(F.col("doc_id").alias("cut_id"), F.col("words_sha").alias("cut_sha")).agg(F.max("n_removed").alias("n_cut"), F.max("kept").alias("kept"), F.max("kept_sha").alias("kept_sha"))
    rows = (read.join(copied, F.col("words_sha") == F.col("copied"), "left")
            .join(cut, (F.col("doc_id") == F.col("cut_id")) & (F.col("words_sha") == F.col("cut_sha")), "left"))
    whole = F.coalesce((F.col("doc_id") > F.col("first_id")) & F.col("copied").isNotNull(), F.lit(False))
    kept = F.when(whole, F.lit("")).otherwise(F.col("kept"))
    return rows.select("doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0))).cast("long").alias("n_removed"), kept.alias("kept"),
                       F.when(whole, F.lit(NO_WORDS)).otherwise(F.lower(F.hex(F.coalesce("kept_sha", "words_sha")))).alias("kept_sha256"))


def digests(docs: DataFrame, size: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of ``removed_words``."""
    return removed_words(docs, size).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The same in DuckDB, by definition.
PLAIN_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS low FROM g GROUP BY g HAVING count(*) > 1),
c AS (SELECT r, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (g) WHERE doc_id > low),
k AS (SELECT r, list(DISTINCT p) AS gone FROM c GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  CASE WHEN gone IS NULL THEN sha256(array_to_string(w, ' ')) ELSE sha256(coalesce(array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda p: CASE WHEN NOT list_contains(gone, p) THEN w[p] END), lambda x: x IS NOT NULL), ' '), '')) END AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
