"""Toxicity from subword bags: embeddings of words and of their character n-grams, averaged, into a linear softmax.

A text is scored by passages of a few words, as a few insults get lost in the mean of a long
text: the score is that of its most toxic passage. Embeddings and softmax are trained jointly
in NumPy, from a start at the log odds of each n-gram. Since the softmax is linear in the mean, a trained model folds into one number for
each n-gram bucket, and scoring is a sum over the characters of a batch. A misspelt word that
was never seen shares most of its n-grams with the word that was.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.llm.blocks import LOWER, MULTIPLIERS, byte_set, mix, run_hashes, text_blocks, word_runs
from hydroseries.llm.sample import labelled_sample

#: Hash buckets of the vectors, and lengths of n-grams in characters, with a mark on either side of a word.
BUCKETS, GRAMS = 1 << 18, (4, 5, 6)
#: Words of a passage, and passages of at most so many words start at every half of it.
PASSAGE = 2
#: Every labelled text is scored for the calibration by a model learnt from the other parts.
FOLDS = 4
_WORD = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


class Model(NamedTuple):
    weight: np.ndarray  # of each bucket: its vector times the softmax
    bias: float
    scale: float  # calibration of the logit of the most toxic passage
    shift: float


def word_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word and of its n-grams, and the word each belongs to. A character of several bytes is one letter of an n-gram."""
    n = ends - starts
    buckets = [(run_hashes(data, starts, ends) % np.uint64(BUCKETS)).astype(np.int32)]
    words = [np.arange(len(starts), dtype=np.int32)]
    size = n + 2  # with a mark at either end
    at = np.concatenate(([0], np.cumsum(size)))
    marked = np.full(int(at[-1]), 1, np.uint8)
    within = np.arange(int(n.sum())) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
    marked[within + np.repeat(at[:-1] + 1, n)] = data[within + np.repeat(starts, n)]
    head = np.flatnonzero((marked & 0xC0) != 0x80)  # first bytes of the characters
    word = np.repeat(np.arange(len(starts), dtype=np.int32), size)[head]
    letter = marked[head].astype(np.uint64)
    width = np.diff(head, append=len(marked))
    for k in range(1, 4):
        longer = np.flatnonzero(width > k)
        letter[longer] = letter[longer] << np.uint64(8) | marked[head[longer] + k]
    value = np.zeros(len(letter), np.uint64)
    for k in range(max(GRAMS)):
        value[:len(value) - k] = value[:len(value) - k] * np.uint64(MULTIPLIERS[0]) + letter[k:]
        if k + 1 in GRAMS and len(letter) > k:
            whole = np.flatnonzero(word[:len(word) - k] == word[k:])
            buckets.append((mix(value[whole] + np.uint64(k)) % np.uint64(BUCKETS)).astype(np.int32))
            words.append(word[whole])
    return np.concatenate(buckets), np.concatenate(words)


def _passages(row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and row of the passages; they overlap by half."""
    total = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(total)[:-1])).astype(np.int64)
    half = PASSAGE // 2
    count = np.where(total > 0, np.maximum((total - half + half - 1) // half, 1), 0)
    of = np.repeat(np.arange(rows), count)
    step = np.arange(int(count.sum())) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
    begin = first[of] + step * half
    return begin, np.minimum(begin + PASSAGE, first[of] + total[of]), of


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return LOWER[np.frombuffer(b"".join(raw), np.uint8)], np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def _top(value: np.ndarray, of: np.ndarray, rows: int, empty: float) -> np.ndarray:
    best = np.full(rows, -np.inf)
    np.maximum.at(best, of, value)
    return np.where(np.isinf(best), empty, best)


def train(texts: list[str], y: np.ndarray, dim: int = 8, epochs: int = 20, rate: float = 0.05, least: int = 3, decay: float = 1e-4, seed: int = 5) -> Model:
    """Vectors and softmax fitted together by Adam; each text learns through its most toxic passage. ``y``: 0 or 1.

    Buckets that fewer than ``least`` texts hold stay at nothing, so that no text is learnt by heart.
    """
    data, offsets = _flat(texts)
    starts, ends, row = word_runs(data, offsets, _WORD)
    _, unique, word = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
    bucket, owner = word_grams(data, starts[unique], ends[unique])
    order = np.argsort(owner, kind="stable")
    bucket, owner = bucket[order], owner[order]
    begin_of = np.searchsorted(owner, np.arange(len(unique) + 1))
    # In how many texts each bucket occurs: pairs of text and word first, then their buckets.
    pairs = np.unique(row.astype(np.int64) * len(unique) + word)
    spread = np.bincount(bucket, np.bincount(pairs % len(unique), minlength=len(unique))[owner], BUCKETS)
    size = np.maximum(np.diff(begin_of), 1)
    begin, end, of = _passages(row, len(texts))
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.5, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    used = np.unique(bucket)
    rare = spread[used] < least
    place = np.searchsorted(used, bucket)
    part = vectors[used]
    # A start that knows which n-grams stand in toxic texts more often, as a passage found by chance would teach nothing.
    toxic = np.bincount(bucket, np.bincount(pairs % len(unique), y[pairs // len(unique)], len(unique))[owner], BUCKETS)[used]
    odds = np.log((toxic + 1) / (y.sum() + 1)) - np.log((spread[used] - toxic + 1) / ((1 - y).sum() + 1))
    part += odds[:, None].astype(np.float32) * (softmax[:, 1] - softmax[:, 0]) / ((softmax[:, 1] - softmax[:, 0]) ** 2).sum()
    part[rare] = 0
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (part, softmax, bias)]
    has = np.bincount(of, minlength=len(texts)) > 0
    first_of = np.searchsorted(of, np.arange(len(texts)))
    share = np.where(y == 1, 0.5 / max(1, int((y[has] == 1).sum())), 0.5 / max(1, int((y[has] == 0).sum()))) * len(texts) / 2
    for epoch in range(epochs):
        gram = part @ (softmax[:, 1] - softmax[:, 0])
        scalar = np.add.reduceat(gram[place], begin_of[:-1]) / size
        running = np.concatenate(([0], np.cumsum(scalar[word])))
        logit = (running[end] - running[begin]) / (end - begin)
        # The most toxic passage of each text.
        rank = np.lexsort((logit, of))
        last = np.searchsorted(of[rank], np.arange(len(texts)), "right") - 1
        pick = rank[last[has]]
        length = end[pick] - begin[pick]
        inside = np.repeat(begin[pick], length) + np.arange(int(length.sum())) - np.repeat(np.concatenate(([0], np.cumsum(length)[:-1])), length)
        w = word[inside]
        mean_word = np.repeat(np.arange(len(pick)), length)
        grams = size[w]
        flat = np.repeat(begin_of[w], grams) + np.arange(int(grams.sum())) - np.repeat(np.concatenate(([0], np.cumsum(grams)[:-1])), grams)
        share_of = np.repeat(1.0 / (grams * length[mean_word]), grams).astype(np.float32)
        text_of = np.repeat(mean_word, grams)
        here = place[flat]
        hidden = np.stack([np.bincount(text_of, part[here, d] * share_of, len(pick)) for d in range(dim)], 1).astype(np.float32)
        z = hidden @ softmax + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        want = np.stack([1 - y[has], y[has]], 1)
        delta = ((p - want) * share[has][:, None] / len(pick)).astype(np.float32)
        back = delta @ softmax.T
        grad = np.stack([np.bincount(here, back[text_of, d] * share_of, len(part)) for d in range(dim)], 1).astype(np.float32) + decay * part
        grad[rare] = 0
        for x, g, (m, v) in zip((part, softmax, bias), (grad, hidden.T @ delta + 1e-4 * softmax, delta.sum(0)), moments, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            x -= rate * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.999 ** (epoch + 1))) + 1e-8)
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = part @ (softmax[:, 1] - softmax[:, 0])
    model = Model(weight, float(bias[1] - bias[0]), 1.0, 0.0)
    return model


def logits(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Logit of the most toxic passage of each text; without words, that of the bias alone."""
    rows = len(offsets) - 1
    data = LOWER[data]
    starts, ends, row = word_runs(data, offsets, _WORD)
    if not len(starts):
        return np.full(rows, min(model.bias, 0.0) - 2.0)
    bucket, owner = word_grams(data, starts, ends)
    scalar = np.bincount(owner, model.weight[bucket], len(starts)) / np.bincount(owner, minlength=len(starts))
    running = np.concatenate(([0], np.cumsum(scalar)))
    begin, end, of = _passages(row, rows)
    return _top((running[end] - running[begin]) / (end - begin) + model.bias, of, rows, min(model.bias, 0.0) - 2.0)


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Scale and shift of the logit by Platt's method on logits ``x`` of texts whose model has not seen them."""
    middle, width = float(np.median(x)), float(x.std()) or 1.0
    x, a, b = np.clip((x - middle) / width, -5, 5), 1.0, 0.0
    want = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w, e = p * (1 - p) + 1e-3, p - want
        h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1]])
        step = np.linalg.solve(h, np.array([(e * x).sum() + 0.1 * a, e.sum()]))
        a, b = np.array([a, b]) - step / max(1.0, np.abs(step).max() / 0.5)
    a, b = a / width, b - a * middle / width
    return model._replace(scale=max(float(a), 1e-3), shift=float(b))


def cross_fit(texts: list[str], y: np.ndarray) -> Model:
    """A model from all texts, calibrated by logits that each part of them gets from a model of the other parts."""
    part, x = np.arange(len(texts)) % FOLDS, np.zeros(len(texts))
    for k in range(FOLDS):
        rest = train([t for t, p in zip(texts, part, strict=True) if p != k], y[part != k])
        x[part == k] = logits(rest, *_flat([t for t, p in zip(texts, part, strict=True) if p == k]))
    # Passages of unseen texts look less sure than those of texts that were learnt.
    return calibrate(train(texts, y), x, y)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 1500, chars: int = 20_000, where: Column | None = None) -> Model:
    """A model from at most ``rows`` texts of each label, of at most ``chars`` characters; all of them are learnt from.

    ``labels`` has doc_id and toxic; rows where ``where`` is not true are never looked at. Without
    two texts of either label the model knows nothing and scores every text 0.
    """
    drawn = labelled_sample(docs, labels, "toxic", rows, chars, where)
    texts, y = [r["text"] for r in drawn], np.array([r["y"] for r in drawn], np.float64)
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 1.0, -50.0)
    return cross_fit(texts, y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, score from 0 to 1. A null or empty text gets the score of no words."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, block_bytes=1 << 20):
            x = np.clip(model.scale * logits(model, data, offsets) + model.shift, -50, 50)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(1 / (1 + np.exp(-x)))], ["doc_id", "score"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns as they were."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, block_bytes=1 << 20):
            x = np.clip(model.scale * logits(model, data, offsets) + model.shift, -50, 50)
            yield rows.filter(pa.array(1 / (1 + np.exp(-x)) < threshold))
    return docs.mapInArrow(run, docs.schema)


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(n))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out (never learnt from), score, predicted (score >= threshold)."""
    model = fit(docs, labels, where=remainder(3) != 1)
    return score(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
