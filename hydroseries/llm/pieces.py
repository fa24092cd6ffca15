"""SentencePiece encoding for merge-type vocabularies, and decoding.

A text is cut where no piece of the vocabulary can span; equal parts are encoded once per
task. Of all adjacent symbol pairs that form a piece, the one with the best score is merged
first, the leftmost of equals: long parts keep such pairs on an agenda, short parts go through
the same order side by side in arrays. Every new part of a batch is checked against the
library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Parts up to so many characters are encoded side by side.
SHORT = 32
#: Parts remembered by a task.
REMEMBERED = 600_000
#: Characters of text that are worked on at a time.
BLOCK_CHARS = 2_000_000
SPACE = "▁"
#: Numbers of characters that no piece holds go down from here; END fills short rows.
FOREIGN, END = -10, -9


class Vocabulary:
    """Symbols, pair table and byte pieces of a model. Symbols that only occur inside pieces get numbers after the pieces."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        sp = self.library
        self.size = sp.vocab_size()
        plain = {sp.id_to_piece(i): i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in plain):
            raise ValueError("a piece spans a word start; texts can't be cut there")
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(self.size) if sp.is_byte(i)}
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        extra = sorted({c for p in plain for c in p}.difference(plain))
        number = plain | {c: self.size + k for k, c in enumerate(extra)}
        self.extra, self.width = extra, self.size + len(extra)
        #: Numbers of symbols and of pairs of them.
        self.kind = np.int32 if self.width ** 2 < 2**31 else np.int64
        self.char = np.full(0x110000, -1, self.kind)
        for s, i in number.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        keys, ids = [], []
        for piece, i in plain.items():
            for k in range(1, len(piece)):
                if piece[:k] in number and piece[k:] in number:
                    keys.append(number[piece[:k]] * self.width + number[piece[k:]])
                    ids.append(i)
        order = np.argsort(keys)
        self.keys, self.merged = np.array(keys, self.kind)[order], np.array(ids, self.kind)[order]
        self.pair = dict(zip(keys, ids, strict=True))
        self.score = np.array([sp.get_score(i) for i in range(self.size)], np.float32)
        # Cuts: around letters, and around line breaks, where no piece joins them to anything else.
        inner = [p.lstrip(SPACE) for p in plain]
        if not any(re.search(r"[^\W\d_][\W\d_]|[\W\d_][^\W\d_]|.\n|\n.", p, re.S) for p in inner):
            self.parts = re.compile(r" *[^\W\d_]+|\n| *[^ \n]+?(?=[^\W\d_\n]|[ \n]|$)| +")
        else:
            self.parts = re.compile(r" *[^ ]+| +")

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores (-inf: no piece) and numbers of the pieces that pairs form."""
        key = np.where((left >= 0) & (right >= 0), left * self.width + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        piece = self.merged[at]
        return np.where(self.keys[at] == key, self.score[piece], np.float32(-np.inf)), piece

    def symbols(self, text: str) -> np.ndarray:
        """One number a character; a character that no piece holds gets a negative one of its own."""
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(self.kind)
        number = self.char[code]
        return np.where(number < 0, FOREIGN - code, number)

    def ids(self, symbols: Iterable[int]) -> tuple[int, ...]:
        """Ids of final symbols; a character that is no piece becomes bytes."""
        out: list[int] = []
        for s in symbols:
            if 0 <= s < self.size:
                out.append(s)
            elif self.bytes:
                out += [self.bytes[b] for b in (chr(FOREIGN - s) if s < 0 else self.extra[s - self.size]).encode()]
            else:
                out.append(self.unknown)
        return tuple(out)


def encode_long(v: Vocabulary, part: str) -> tuple[int, ...]:
    """One part by an agenda of adjacent pairs, best score first, then leftmost."""
    symbol, size = v.symbols(part).tolist(), len(part)
    length = [1] * size
    left, right = list(range(-1, size - 1)), [*range(1, size), -1]
    agenda: list[tuple[float, int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and symbol[i] >= 0 and symbol[j] >= 0 and (piece := v.pair.get(symbol[i] * v.width + symbol[j])) is not None:
            heapq.heappush(agenda, (-v.score[piece], i, j, piece, length[i] + length[j]))

    for i in range(size - 1):
        offer(i, i + 1)
    while agenda:
        _, i, j, piece, both = heapq.heappop(agenda)
        if not length[i] or right[i] != j or length[i] + length[j] != both:
            continue
        symbol[i], length[i], length[j] = piece, both, 0
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(left[i], i)
        offer(i, right[i])
    return v.ids(s for s, n in zip(symbol, length, strict=True) if n)


def encode_short(v: Vocabulary, parts: list[str]) -> list[tuple[int, ...]]:
    """Parts of at most SHORT characters: one merge of every part at a time."""
    out: list[tuple[int, ...]] = [()] * len(parts)
    order = sorted(range(len(parts)), key=list(map(len, parts)).__getitem__)
    for start in range(0, len(order), 20_000):
        rows = np.array(order[start:start + 20_000])
        here = [parts[k] for k in rows]
        length = np.array(list(map(len, here)))
        symbol = np.full((len(rows), int(length.max()) + 1), END, v.kind)
        symbol[np.arange(symbol.shape[1]) < length[:, None]] = v.symbols("".join(here))
        score, piece = v.look_up(symbol[:, :-1], symbol[:, 1:])
        while len(rows):
            best = score.argmax(1)
            line = np.arange(len(rows))
            live = ~np.isneginf(score[line, best])
            if not live.all():
                done = ~live
                ready, size = symbol[done], length[done]
                odd = (((ready < 0) & (ready != END)) | (ready >= v.size)).any(1)
                for k, s, n, o in zip(rows[done].tolist(), ready.tolist(), size.tolist(), odd.tolist(), strict=True):
                    out[k] = v.ids(s[:n]) if o else tuple(s[:n])
                rows, symbol, score, piece, best, length = rows[live], symbol[live], score[live], piece[live], best[live], length[live]
                if not len(rows):
                    break
                line = np.arange(len(rows))
            length = length - 1
            symbol[line, best] = piece[line, best]
            keep = np.arange(symbol.shape[1] - 1)
            keep = keep + (keep > best[:, None])
            symbol = np.take_along_axis(symbol, keep, 1)
            keep = keep[:, :-1]
            score, piece = np.take_along_axis(score, keep, 1), np.take_along_axis(piece, keep, 1)
            for at in (best - 1, best):
                ok = np.flatnonzero((at >= 0) & (at < score.shape[1]))
                where = at[ok]
                score[ok, where], piece[ok, where] = v.look_up(symbol[ok, where], symbol[ok, where + 1])
    return out


def library_ids(v: Vocabulary, parts: list[str]) -> list[list[int]]:
    """The library's ids of parts; it puts a space before a text, so parts without one stand behind a line break."""
    led = [p[:1] == " " and len(p) > 1 for p in parts]
    own = [p[1:] if x else "\n" + p for p, x in zip(parts, led, strict=True)]
    lead = len(v.library.encode("\n"))
    return [ids if x else ids[lead:] for x, ids in zip(led, v.library.encode(own, num_threads=1), strict=True)]


def _encoder(model: str, check: bool, digests: bool):
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(model)
        known: dict[str, tuple[int, ...]] = {}  # tuples of numbers, which the garbage collector leaves alone
        spoken: dict[str, str] = {}
        names = [str(i) for i in range(v.size)]
        end = [v.end]
        for batch in batches:
            texts, start = [t or "" for t in batch.column(1).to_pylist()], 0
            while start < len(texts):
                stop, room = start, BLOCK_CHARS
                while stop < len(texts) and (stop == start or room > 0):
                    room -= len(texts[stop])
                    stop += 1
                cut = [v.parts.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts[start:stop]]
                if len(known) > REMEMBERED:
                    known, spoken = {}, {}
                new = list({p for parts in cut for p in parts}.difference(known))
                short = [p for p in new if len(p) <= SHORT]
                # In a normalised text a space is written as SPACE.
                known.update(zip(short, encode_short(v, [p.replace(" ", SPACE) for p in short]), strict=True))
                known.update((p, encode_long(v, p.replace(" ", SPACE))) for p in new if len(p) > SHORT)
                if check and new:
                    wrong = [p for p, ids in zip(new, library_ids(v, new), strict=True) if known[p] != tuple(ids)]
                    if wrong:
                        raise ValueError(f"{len(wrong)} parts differ from the library, such as {wrong[0]!r}")
                ids = [list(chain.from_iterable(map(known.__getitem__, parts))) + end for parts in cut]
                text = v.library.decode(ids, num_threads=1)
                columns = [batch.column(0).slice(start, stop - start), pa.array([len(x) for x in ids], pa.int64())]
                if digests:
                    spoken.update((p, " ".join([names[i] for i in known[p]])) for p in new)
                    said = (" ".join(chain(map(spoken.__getitem__, parts), (str(v.end),))) for parts in cut)
                    columns += [pa.array([hashlib.sha256(s.encode()).hexdigest() for s in said]), pa.array([hashlib.sha256(s.encode()).hexdigest() for s in text])]
                else:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(text, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])])
                start = stop
    return encode


def encode(docs: DataFrame, model: str, check: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids (an end id last), decoded. A null text is empty: its only id is the end id."""
    return docs.select("doc_id", "text").mapInArrow(_encoder(model, check, False), "doc_id long, n_tokens long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model: str, check: bool = True) -> DataFrame:
    """The same with ids and decoded text as SHA-256 of the ids in decimal, joined by one space, and of the text in UTF-8."""
    return docs.select("doc_id", "text").mapInArrow(_encoder(model, check, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
