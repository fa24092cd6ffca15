"""Quality by positive-unlabelled learning.

Trusted positives and unlabelled web text are all that is learnt from. A small network on
plain statistics of a text minimises the non-negative unbiased risk: the risk of positives,
weighted by the class prior, plus that of unlabelled text as negatives less the share that
positives have in it, which is kept from falling below nothing. The prior is estimated from
the two samples: where a first model is most sure, unlabelled text holds nothing but positives.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.llm.blocks import LOWER, NOT_SPACE, run_hashes, text_blocks, word_runs

_CLASSES = ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("lower", b"abcdefghijklmnopqrstuvwxyz"), ("digit", b"0123456789"), ("stop", b".,;:?'-"), ("shout", b"!"), ("bar", b"|"), ("mark", b"*#$%&@~^_=+<>{}[]\\/"), ("break", b"\n")
FEATURES = ("words", *(name for name, _ in _CLASSES), "word_length", "distinct", "repeat", "pairs", "marked_end")


class Model(NamedTuple):
    middle: np.ndarray
    width: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    prior: float


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; zeros for an empty one."""
    rows = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    out = np.zeros((rows, len(FEATURES)))
    for j, (_, chars) in enumerate(_CLASSES):
        table = np.zeros(256, bool)
        table[list(chars)] = True
        running = np.concatenate(([0], np.cumsum(table[data])))
        out[:, 1 + j] = np.log1p(100 * (running[offsets[1:]] - running[offsets[:-1]]) / size)
    starts, ends, row = word_runs(data, offsets, NOT_SPACE)
    if not len(starts):
        return out
    total = np.bincount(row, minlength=rows)
    n = np.maximum(total, 1)
    word = run_hashes(LOWER[data], starts, ends)
    pair = word[:-1] * np.uint64(31) + word[1:]
    same_row = row[1:] == row[:-1]
    k = 1 + len(_CLASSES)
    out[:, 0] = np.log1p(total)
    out[:, k] = np.bincount(row, np.minimum(ends - starts, 40), rows) / n
    out[:, k + 1] = _distinct(word, row, rows) / n ** 0.8
    out[:, k + 2] = np.bincount(row[1:], (word[1:] == word[:-1]) & same_row, rows) / n
    out[:, k + 3] = _distinct(pair[same_row], row[1:][same_row], rows) / np.maximum(n - 1, 1)
    last = data[ends - 1]
    plain = (last >= 0x80) | ((LOWER[last] >= 0x61) & (LOWER[last] <= 0x7A)) | np.isin(last, list(b".,;:?0123456789\"')"))
    out[:, k + 4] = np.bincount(row, ~plain, rows) / n
    return out


def _distinct(value: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    order = np.lexsort((value, row))
    v, r = value[order], row[order]
    first = np.ones(len(v), bool)
    first[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r, first, rows)


def _flat(texts: list[str]) -> np.ndarray:
    out = []
    for k in range(0, len(texts), 200):
        raw = [t.encode() for t in texts[k:k + 200]]
        out.append(statistics(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _logit(m: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    z = np.clip((x - m.middle) / m.width, -6, 6)
    h = np.maximum(z @ m.w1 + m.b1, 0)
    return z, h, h @ m.w2 + m.b2[0]


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 60, hidden: int = 24, batch: int = 256, rate: float = 0.005, seed: int = 9) -> Model:
    """Minimise the non-negative risk with the logistic loss by Adam."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    m = Model(both.mean(0), both.std(0) + 1e-6, rng.normal(0, (2 / both.shape[1]) ** 0.5, (both.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1), prior)
    weights = [m.w1, m.b1, m.w2, m.b2]
    moments, t = [[np.zeros_like(w), np.zeros_like(w)] for w in weights], 0
    steps = max(1, max(len(positive), len(unlabelled)) // batch)
    for _ in range(epochs):
        for _ in range(steps):
            p, u = positive[rng.integers(0, len(positive), batch)], unlabelled[rng.integers(0, len(unlabelled), batch)]
            zp, hp, fp = _logit(m, p)
            zu, hu, fu = _logit(m, u)
            sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            if negative >= 0:
                gp, gu = (prior * (sp - 1) - prior * sp) / batch, su / batch
            else:  # the part below nothing is climbed back
                gp, gu = prior * sp / batch, -su / batch
            grads = [np.zeros_like(w) for w in weights]
            for z, h, g in ((zp, hp, gp), (zu, hu, gu)):
                back = g[:, None] * m.w2 * (h > 0)
                for k, part in enumerate((z.T @ back, back.sum(0), h.T @ g, np.array([g.sum()]))):
                    grads[k] += part
            t += 1
            for w, g, (a, b) in zip(weights, grads, moments, strict=True):
                g = g + 1e-4 * w
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return m


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """Share of positives in unlabelled text: the least ratio of both samples' shares above a score, each with its sampling error.

    The scores are those of a model that tells the samples apart, on the halves it has not seen.
    """
    half_p, half_u = len(positive) // 2, len(unlabelled) // 2
    m = train(positive[:half_p], unlabelled[:half_u], 0.5, epochs=20)
    p, u = np.sort(_logit(m, positive[half_p:])[2]), np.sort(_logit(m, unlabelled[half_u:])[2])
    share_p = 1 - np.arange(len(p)) / len(p)
    share_u = 1 - np.searchsorted(u, p) / len(u)
    error = np.sqrt(np.log(4 / confidence) / 2)
    ratio = (share_u + error / len(u) ** 0.5) / share_p + error / len(p) ** 0.5 / share_p
    best = int(np.argmin(ratio))
    return float(np.clip(share_u[best] / share_p[best], 0.05, 0.98))


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(n))


def fit(docs: DataFrame, labels: DataFrame, rows: int = 3000, chars: int = 20_000, where: Column | None = None) -> Model | None:
    """A model from at most ``rows`` trusted positives and ``rows`` unlabelled texts of at most ``chars`` characters, chosen by the hash of doc_id.

    ``labels`` has doc_id and quality; rows where ``where`` is not true are never looked at.
    Without texts in either sample there is no model.
    """
    seen = docs.select("doc_id", "text").where((F.length("text") <= chars) & F.col("doc_id").isNotNull())
    ids = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id")
    if where is not None:
        seen, ids = seen.where(where), ids.where(where)
    def texts(chosen: DataFrame) -> list:
        """Ids first; they are few enough to be broadcast, and only their texts are read out."""
        return seen.join(F.broadcast(chosen.distinct()), "doc_id").select("text").limit(rows).collect()

    positive = texts(ids.join(seen.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    unlabelled = texts(seen.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(rows))
    if len(positive) < 8 or len(unlabelled) < 8:
        return None
    p, u = _flat([r["text"] for r in positive]), _flat([r["text"] for r in unlabelled])
    return train(p, u, estimate_prior(p, u))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, score from 0 to 1 (0.5 without a model). A null text is scored as an empty one."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches):
            s = 1 / (1 + np.exp(-_logit(model, statistics(data, offsets))[2])) if model is not None else np.full(rows.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(s)], ["doc_id", "score"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out (never learnt from), score, predicted (score >= threshold)."""
    model = fit(docs, labels, where=remainder(5) != 0)
    return score(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
