"""Secret scan: fixed patterns, and a small character convolutional network over every other candidate.

A candidate is a long token, a key block or a credential in an address, also where it overlaps
a fixed pattern: both are reported then. The network sees the candidate and the characters around it. It is trained on
labelled findings: real findings of a bounded sample of the corpus (base patterns are
positive, tokens of ordinary text that no known format fits are negative) and findings made by a seeded generator for
formats that the sample may lack. Its scores are calibrated on findings kept back, and the
threshold is the largest one that keeps a wanted recall there.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed patterns with the least length of the group that counts; kinds in the order in which they are listed.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
#: The same matches of the hex kind, found faster.
_HEX = re.compile(r"[0-9a-f]{16,}")
_KEYWORD = re.compile(r"passw(?:or)?d|secret|token|api_?key", re.I | re.A)
#: Other candidates, each in a pass of its own: tokens of 20 or more characters, key blocks, credentials in an address.
CANDIDATES = (re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}"), re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), re.compile(r"(?<=://)[^\s:/@]*+:[^\s/@]++(?=@)"))
#: Tokens that may be keys of the generator's formats; found in the corpus, nobody says whether they are.
_FORMATS = re.compile(r"(?:ghp_|sk_live_|xoxb-|eyJ|AIza)[A-Za-z0-9]{10,}|^[0-9A-F]{20,}$|^(?=.*[a-z])(?=.+[A-Z])[A-Za-z0-9+/]{20,64}={0,2}$")
KINDS = ("assign", "access", "hex", "model")
#: Characters of a candidate and on either side of it that the network sees.
INSIDE, AROUND = 40, 16
WIDTH = INSIDE + 2 * AROUND
ALPHABET = {c: i + 1 for i, c in enumerate(string.ascii_lowercase + string.digits + string.ascii_uppercase + "+/_.=-:'\"@ \n")}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping for each kind; matches with too short a group are dropped."""
    out = []
    if _KEYWORD.search(text):
        out += [(m.start(), m.end(), 0) for m in BASE[0][1].finditer(text) if len(m[2]) >= BASE[0][3]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in BASE[1][1].finditer(text) if m.end() - m.start() >= BASE[1][3]]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Other candidates, less those that lie within one span taken."""
    tokens, blocks, credentials = CANDIDATES
    found = [m.span() for m in tokens.finditer(text)]
    if "PRIVATE KEY" in text:
        found += [m.span() for m in blocks.finditer(text)]
    if "://" in text:
        found += [m.span() for m in credentials.finditer(text)]
    found = sorted(set(found))
    if not found or not taken:
        return found
    starts, ends = np.array([s[0] for s in taken]), np.maximum.accumulate(np.array([s[1] for s in taken]))
    return [(a, b) for a, b in found if (k := int(np.searchsorted(starts, a, "right"))) == 0 or ends[k - 1] < b]


def harmless(text: str, spans: list[tuple[int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Those candidates that may serve as negatives: tokens that overlap nothing taken and that no format of the generator fits."""
    plain = [(a, b) for a, b in spans if not CANDIDATES[1].fullmatch(text, a, b) and not _FORMATS.search(text[a:b])]
    inside = [m.span() for m in CANDIDATES[2].finditer(text)] + [s[:2] for s in taken]
    return [(a, b) for a, b in plain if not any(c < b and a < d for c, d in inside)]


def picture(text: str, start: int, end: int) -> list[int]:
    """Numbers of the characters of a candidate (its first and last ones, if long) and around it."""
    body = text[start:end] if end - start <= INSIDE else text[start:start + INSIDE // 2] + text[end - INSIDE // 2:end]
    left, right = text[max(0, start - AROUND):start].rjust(AROUND, "\n"), text[end:end + AROUND].ljust(AROUND, "\n")
    return [ALPHABET.get(c, 0) for c in left + body.ljust(INSIDE, "\n") + right]


class Network(NamedTuple):
    embed: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    scale: float
    shift: float
    threshold: float


SPAN = 5  # characters that a filter sees


def _forward(parts: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, ...]:
    embed, filters, filter_bias, out, out_bias = parts
    e = embed[x]
    windows = np.lib.stride_tricks.sliding_window_view(e, SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - SPAN + 1, -1)
    h = np.maximum(windows @ filters + filter_bias, 0)
    where = h.argmax(1)
    top = np.take_along_axis(h, where[:, None], 1)[:, 0]
    pooled = np.concatenate([top, h.mean(1)], 1)
    return windows, h, where, pooled, pooled @ out + out_bias[0]


def train(x: np.ndarray, y: np.ndarray, epochs: int = 20, batch: int = 64, rate: float = 3e-3, seed: int = 11) -> list[np.ndarray]:
    """Embedding, convolution and output weights by Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    d, f = 8, 24
    parts = [rng.normal(0, 0.3, (len(ALPHABET) + 1, d)), rng.normal(0, (2 / (SPAN * d)) ** 0.5, (SPAN * d, f)), np.zeros(f), rng.normal(0, 0.2, 2 * f), np.zeros(1)]
    moments, t = [[np.zeros_like(p), np.zeros_like(p)] for p in parts], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at:at + batch]
            windows, h, where, pooled, z = _forward(parts, x[rows])
            delta = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            back = delta[:, None] * parts[3][None, :]
            grad_h = np.repeat(back[:, None, f:] / h.shape[1], h.shape[1], 1)
            np.put_along_axis(grad_h, where[:, None], np.take_along_axis(grad_h, where[:, None], 1) + back[:, None, :f], 1)
            grad_h *= h > 0
            flat = grad_h.reshape(-1, f)
            grad_w = (flat @ parts[1].T).reshape(len(rows), h.shape[1], SPAN, d)
            grad_e = np.zeros((len(rows), WIDTH, d))
            for k in range(SPAN):
                grad_e[:, k:k + h.shape[1]] += grad_w[:, :, k]
            embed = np.stack([np.bincount(x[rows].ravel(), grad_e[:, :, j].ravel(), len(parts[0])) for j in range(d)], 1)
            grads = [embed, windows.reshape(-1, SPAN * d).T @ flat, flat.sum(0), pooled.T @ delta + 1e-3 * parts[3], np.array([delta.sum()])]
            t += 1
            for p, g, (m, v) in zip(parts, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return parts


def probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    z = np.concatenate([_forward(list(net[:5]), x[k:k + 256])[4] for k in range(0, len(x), 256)]) if len(x) else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -30, 30)))


def made_findings(texts: list[str], number: int, seed: int = 3) -> list[tuple[list[int], int]]:
    """Labelled findings from a seeded generator, set between words of ``texts``: keys of common formats, and harmless long tokens."""
    rng = np.random.default_rng(seed)
    letters, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    draw = lambda chars, n: "".join(chars[i] for i in rng.integers(0, len(chars), n))
    words = [w for t in texts[:200] for w in t.split()[:200] if not base_spans(w) and not candidates(w, [])] or ["the", "of", "and", "key", "value", "for"]
    word = lambda: words[int(rng.integers(0, len(words)))]
    pick = lambda *x: x[int(rng.integers(0, len(x)))]
    some = lambda: pick(draw(string.ascii_lowercase, int(rng.integers(2, 12))), word().lower().strip(":/@"), draw(letters, int(rng.integers(3, 90))), "-".join(draw(string.ascii_lowercase, int(rng.integers(3, 9))) for _ in range(2)))
    # Candidates of this kind stand in an address, and any word may be a password there.
    address = lambda: (pick("https", "http", "ftp", "db", "postgres", "redis") + "://", f"{some()}:{some()}", "@" + pick("host", draw(string.ascii_lowercase, 6), word().lower()))
    secret = (lambda: "ghp_" + draw(letters, 36), lambda: "sk_live_" + draw(letters, 24), lambda: "xoxb-" + draw(string.digits, 12) + "-" + draw(letters, 24),
              lambda: "eyJ" + draw(letters, 40), lambda: draw(letters + "+/", int(rng.integers(24, 64))), lambda: "AIza" + draw(letters + "_-", 35),
              lambda: "-----BEGIN RSA PRIVATE KEY-----", lambda: draw(hexes.upper(), 40),
              lambda: draw(string.ascii_letters, int(rng.integers(20, 40))), lambda: "sk_live_" + draw(hexes, 24) + "-" + draw(letters, 4), *[address] * 4)
    plain = (lambda: "-".join(word().lower() for _ in range(4)) + "-" + draw(string.digits, 2), lambda: "/".join(word() for _ in range(4)) + draw(string.digits, 1),
                lambda: word() * 3 + draw(string.digits, 1), lambda: draw(string.digits, 8) + "-" + draw(string.digits, 4) + "_" + word() + word(),
                lambda: "_".join(word().upper() for _ in range(4)) + draw(string.digits, 1), lambda: "=" * 4 + word() + "-" * 20 + draw(string.digits, 1),
                lambda: "".join(word() for _ in range(5)), lambda: "-_/+"[int(rng.integers(0, 4))] * int(rng.integers(20, 80)), lambda: "//" + "/".join(word().lower() for _ in range(5)),
             lambda: "-".join(word().lower() for _ in range(6)))
    out = []
    for k in range(number):
        y = k % 2
        makers = secret if y else plain
        body = makers[(k // 2) % len(makers)]()
        before, body, after = body if isinstance(body, tuple) else ("", body, "")
        before = f"{word()} {word()} {before}"
        text, start = f"{before}{body}{after} {word()} {word()}", len(before)
        out.append((picture(text, start, start + len(body)), y))
    return out


def fit(docs: DataFrame, rows: int = 600, chars: int = 20_000, recall: float = 0.98, made: int = 4000) -> Network:
    """A network from labelled findings in at most ``rows`` texts of at most ``chars`` characters (chosen by the hash of doc_id) and ``made`` made ones.

    ``recall`` of the positive findings kept back (every fourth) must stay above the threshold.
    """
    short = docs.where((F.length("text") <= chars) & F.col("doc_id").isNotNull())
    drawn = short.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # ids first, few enough to be broadcast
    texts = [r["text"] for r in short.select("doc_id", "text").join(F.broadcast(drawn.distinct()), "doc_id").limit(rows).collect()]
    found = []
    for t in texts:
        taken = base_spans(t)
        found += [(picture(t, a, b), 1) for a, b, _ in taken]
        found += [(picture(t, a, b), 0) for a, b in harmless(t, candidates(t, taken), taken)]
    found = found[:4 * made] + made_findings(texts, made)
    x, y = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.float64)
    back = np.random.default_rng(1).permutation(len(x)) % 4 == 3
    parts = train(x[~back], y[~back])
    net = Network(*parts, 1.0, 0.0, 0.5)
    z, want = _forward(parts, x[back])[4], y[back]
    a, b = 1.0, 0.0
    for _ in range(300):  # Platt's calibration, by plain descent
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        a, b = a - 0.02 * ((p - want) * z).mean(), b - 0.02 * (p - want).mean()
    net = net._replace(scale=float(max(a, 0.05)), shift=float(b))
    positive = np.sort(probabilities(net, x[back])[want == 1])
    return net._replace(threshold=float(min(positive[int((1 - recall) * len(positive))], 0.9)) if len(positive) else 0.9)


def scan_text(text: str, net: Network) -> list[tuple[int, int, int]]:
    """All spans (start, end, kind) of a text, by start, then kind."""
    taken = base_spans(text)
    more = candidates(text, taken)
    if more:
        p = probabilities(net, np.array([picture(text, a, b) for a, b in more], np.int64))
        taken = sorted([*taken, *((a, b, 3) for (a, b), q in zip(more, p, strict=True) if q >= net.threshold)], key=lambda s: (s[0], s[2]))
    return taken


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every stretch of overlapping spans replaced by one mark."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, spans as an array of (kind, start, end) in code points, end exclusive. A null text is empty."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in scan_text(t or "", net)] for t in batch.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redacted(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced and ``n_chars``, if it is there, counted anew for the rows that change; nulls stay."""
    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else redact(t, s) if (s := scan_text(t, net)) else t)

    out = docs.withColumn("__clean", clean("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__clean") != F.col("text"), F.length("__clean").cast("long")).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("__clean")).select(*docs.columns)


def report(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, comma-joined), n_model."""
    found = scan(docs, net)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(said(F.filter("spans", lambda s: s["kind"] != "model")), 256).alias("base_sha256"),
                        said(F.col("spans")).alias("spans"), count("model"))
