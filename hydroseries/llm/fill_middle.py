"""Fill-in-the-middle transformation by a learned rank index.

A cut is given in code points, a text is stored in bytes. The byte offsets of all code points of
a text are a rising sequence; it is approximated by straight segments whose error stays within a
bound, and what the line misses is kept as a residual of one byte per code point (none where a
segment is exact, as in plain ASCII). A cut is then predicted by its segment and corrected by its
residual: no text is decoded or searched. The index can be kept beside the documents, so that
every further draw of cuts (another seed) only reads it.

Nothing is shuffled: rows are handled in Arrow batches, some megabytes of text at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroseries.llm.blocks import text_blocks

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Largest error of a segment; a residual is one signed byte.
BOUND = 120
#: Code points looked at together when a segment is grown.
STEP = 1 << 14

INDEX = "ranks: array<long>, starts: array<long>, slopes: array<double>, places: array<long>, residuals: binary, n: long"


def fit(offsets: np.ndarray, bound: int = BOUND) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments over rising ``offsets`` (one for each rank): first ranks, first offsets, slopes, places of their residuals (-1: all are zero) and the residuals.

    A segment starts exactly on its first offset; it grows while some slope keeps every offset of
    it within ``bound``, which is the narrowing cone of slopes seen from its start.
    """
    ranks, slopes, places, residuals, start, kept = [], [], [], [], 0, 0
    while start < len(offsets):
        low, high, at, stop = -np.inf, np.inf, start + 1, len(offsets)
        while at < len(offsets):
            here = offsets[at:at + STEP]
            run = np.arange(at - start, at - start + len(here))
            rise = (here - offsets[start]).astype(np.float64)
            lows = np.maximum.accumulate((rise - bound) / run)
            highs = np.minimum.accumulate((rise + bound) / run)
            np.maximum(lows, low, out=lows)
            np.minimum(highs, high, out=highs)
            fits = int(np.searchsorted(lows > highs, True)) if lows[-1] > highs[-1] else len(here)
            if fits:
                low, high = lows[fits - 1], highs[fits - 1]
            if fits < len(here):
                stop = at + fits
                break
            at += len(here)
        if low == -np.inf:
            slope = 0.0
        else:
            slope = 1.0 if low <= 1 <= high else (low + high) / 2  # a text without long characters has no residuals at all
        miss = offsets[start:stop] - offsets[start] - np.rint(slope * np.arange(stop - start)).astype(np.int64)
        ranks.append(start)
        slopes.append(slope)
        if miss.any():
            places.append(kept)
            residuals.append(miss.astype(np.int8))
            kept += len(miss)
        else:
            places.append(-1)
        start = stop
    ranks = np.array(ranks, np.int64)
    return ranks, offsets[ranks], np.array(slopes), np.array(places, np.int64), np.concatenate(residuals) if residuals else np.zeros(0, np.int8)


def look_up(index: tuple, wanted: np.ndarray) -> np.ndarray:
    """Offsets of the given ranks: the segment's line, corrected by the residual."""
    ranks, starts, slopes, places, residuals = index
    seg = np.searchsorted(ranks, wanted, "right") - 1
    run = wanted - ranks[seg]
    out = starts[seg] + np.rint(slopes[seg] * run).astype(np.int64)
    stored = places[seg] >= 0
    out[stored] += residuals[(places[seg] + run)[stored]]
    return out


def boundaries(data: np.ndarray) -> np.ndarray:
    """Byte offsets of all code points of UTF-8 ``data``, and its end."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)).astype(np.int64)


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:doc_id``; a null id counts as an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def build_index(docs: DataFrame, text: str = "text", name: str = "fim_index") -> DataFrame:
    """All rows and columns of ``docs`` with a column ``name``: the index of the text (struct of segments, residuals and the number of code points).

    A null text has the index of an empty one. An existing column ``name`` is replaced.
    """
    kept = [c for c in docs.columns if c != name]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, text):
            found = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                whole = boundaries(data[a:b])
                ranks, starts, slopes, places, residuals = fit(whole)
                found.append({"ranks": ranks, "starts": starts, "slopes": slopes, "places": places, "residuals": residuals.tobytes(), "n": len(whole) - 1})
            kind = pa.struct([("ranks", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("slopes", pa.list_(pa.float64())),
                              ("places", pa.list_(pa.int64())), ("residuals", pa.binary()), ("n", pa.int64())])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, kind)], [*rows.schema.names, name])

    rows = docs.select(*[docs[c] for c in kept])
    kind = T.StructType.fromDDL(INDEX)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, kind)]))


def arrange(parts: tuple[bytes, bytes, bytes], form: str) -> bytes:
    """Prefix, middle and suffix as the ``form`` orders them."""
    p, s, m = (x.encode() for x in MARKS)
    prefix, middle, suffix = parts
    if form == "psm":
        return b"".join((p, prefix, s, suffix, m, middle))
    if form == "spm":
        return b"".join((s, suffix, p, prefix, m, middle))
    return prefix + middle + suffix


def restore(output: bytes, form: str) -> bytes:
    """The text of an output. Marks do not occur in a text that is cut, nor across the edge of a part and a mark."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in MARKS)
    first, second = (p, s) if form == "psm" else (s, p)
    one = output[len(first):].split(second, 1)
    two = one[1].split(m, 1)
    prefix, suffix = (one[0], two[0]) if form == "psm" else (two[0], one[0])
    return prefix + two[1] + suffix


def _pieces(batches: Iterable[pa.RecordBatch], indexed: bool, plain_from: int, spm_below: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Rows of some megabytes, each with (form, n, prefix, middle in code points, output, text). The columns are: text, four draws and, if indexed, the index."""
    marks = [m.encode() for m in MARKS]
    for rows, data, offsets in text_blocks(batches, "text"):
        h = np.array([rows.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5)], np.int64)
        if not indexed:
            # One index over the boundaries of all texts of the block: text k has the ranks from heads[k] on.
            whole = boundaries(data)
            index, heads = fit(whole), np.searchsorted(whole, offsets)
            n = np.diff(heads)
        else:
            own = rows.column(5)
            n = own.field("n").to_numpy()
        cut_a, cut_b = h[0] % (n + 1), h[1] % (n + 1)
        low, high = np.minimum(cut_a, cut_b), np.maximum(cut_a, cut_b)
        if not indexed:
            at_low, at_high = look_up(index, heads[:-1] + low), look_up(index, heads[:-1] + high)
        else:
            at_low, at_high = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for k, x in enumerate(own):
                one = (np.array(x["ranks"].as_py(), np.int64), np.array(x["starts"].as_py(), np.int64), np.array(x["slopes"].as_py()),
                       np.array(x["places"].as_py(), np.int64), np.frombuffer(x["residuals"].as_py(), np.int8))
                at_low[k], at_high[k] = look_up(one, np.array([low[k], high[k]])) + offsets[k]
        raw, out = data.tobytes(), []
        for k in range(rows.num_rows):
            a, b = int(offsets[k]), int(offsets[k + 1])
            text = raw[a:b]
            if not text or h[2][k] % 100 >= plain_from or any(m in text for m in marks):
                out.append(("plain", int(n[k]), None, None, text, text))
                continue
            form = "spm" if h[3][k] % 100 < spm_below else "psm"
            parts = raw[a:at_low[k]], raw[at_low[k]:at_high[k]], raw[at_high[k]:b]
            out.append((form, int(n[k]), int(low[k]), int(high[k] - low[k]), arrange(parts, form), text))
        yield rows, out


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, index: str | None = None) -> DataFrame:
    """doc_id, form (plain, psm or spm), prefix_chars, middle_chars and output (the text to train on) of every row of ``docs`` (doc_id, text).

    ``index`` names the column that ``build_index`` made, if there is one. A null text is empty,
    an empty text and one that holds a mark stay plain; a null doc_id draws like an empty id.
    Repeated rows give equal results; other columns are not read.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])
    plain_from, indexed = 100 - plain_percent, index is not None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, out in _pieces(batches, indexed, plain_from, spm_percent):
            cols = list(zip(*out, strict=True))
            ids = rows.column(rows.num_columns - 1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0]), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()),
                                              pa.array(cols[4], pa.binary()).cast(pa.string()).cast(pa.large_string())], schema=kind)

    return _chosen(docs, seed, index).mapInArrow(run, "doc_id long, form string, prefix_chars long, middle_chars long, output string")


def digests(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, index: str | None = None) -> DataFrame:
    """Per row: doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256, the digest of the text rebuilt from the output and its form; odd rows as in ``transform``."""
    kind = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
                      ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
    plain_from, indexed = 100 - plain_percent, index is not None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, out in _pieces(batches, indexed, plain_from, spm_percent):
            form, n, prefix, middle, output, _ = zip(*out, strict=True)
            ids = rows.column(rows.num_columns - 1)
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in output]),
                pa.array([hashlib.sha256(restore(x, f)).hexdigest() for x, f in zip(output, form, strict=True)])], schema=kind)

    return _chosen(docs, seed, index).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def _chosen(docs: DataFrame, seed: int, index: str | None) -> DataFrame:
    more = [F.col(index).alias("index")] if index else []
    return docs.select("text", *[h.alias(f"h{k}") for k, h in enumerate(draws(F.col("doc_id"), seed), 1)], *more, F.col("doc_id").cast("long").alias("doc_id"))


#: The same in DuckDB, by definition.
PLAIN_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM f
"""
