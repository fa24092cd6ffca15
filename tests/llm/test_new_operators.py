"""Substring dedup, fill-in-the-middle and the conversation trie against brute force, on odd little tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest

from hydroseries.llm import fill_middle, prefix_trie, repeats

SF = "sf0.001"
DOCS = "doc_id long, text string, lang string, doc string, anchor string, mark string, h1 string, seen string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, "d", "a", "m", "h", "s") for i, t in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", ["op11_substring_dedup", "op12_fill_in_middle", "op13_conversation_trie"])
def test_twins(spark, con, name):
    ok, text = oracle.compare(spark, con, name, SF)
    assert ok, text


# Substring dedup ---------------------------------------------------------------------------------

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def dedup_by_hand(rows, size):
    first = {}
    for i, text in rows:
        w = SPACES.findall(text or "")
        for k in range(len(w) - size + 1):
            if i is not None:
                g = tuple(w[k:k + size])
                first[g] = min(i, first.get(g, i))
    out = []
    for i, text in rows:
        w = SPACES.findall(text or "")
        gone = {p for k in range(len(w) - size + 1) if i is not None and first[tuple(w[k:k + size])] < i for p in range(k, k + size)}
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return sorted(out, key=repr)


def odd_texts():
    rng = random.Random(5)
    vocabulary = ["a", "b", "été", "x" * 90, "c d", "nul\x00"] + [f"w{i}" for i in range(20)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two three"), (5, "a " * 40), (6, "a " * 55), (7, "a b " * 30), (8, "b a b " * 25), (9, passage), (10, passage), (10, passage),
            (11, passage.replace(" ", "\n")), (None, passage), (None, passage + " end"), (12, "x " + passage), (13, passage[:200]), (14, " ".join(passage.split()[3:40])), (0, passage[100:])]
    for i in range(60):
        parts = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            at = rng.randrange(40)
            parts[rng.randrange(len(parts) + 1):1] = passage.split()[at:at + rng.choice([11, 12, 13, 14, 20])]
        rows.append((100 + i // 2, " ".join(parts)))
    long = " ".join(f"q{rng.randrange(50_000)}" for _ in range(30_000))
    return rows + [(500, long), (501, "start " + long[:150_000] + " middle " + long[100_000:])]


@pytest.mark.parametrize("size", [13, 5, 2])
def test_substring_dedup(spark, size):
    rows = odd_texts()
    got = repeats.digests(docs_of(spark, rows), size).collect()
    assert sorted((tuple(r) for r in got), key=repr) == dedup_by_hand(rows, size)


def test_substring_dedup_text_and_empty_table(spark):
    rows = [(1, "k " * 3 + "one two three four five"), (2, "zero  one two\nthree four five six")]
    kept = {r.doc_id: r.kept for r in repeats.removed_words(docs_of(spark, rows), 4).collect()}
    assert kept == {1: None, 2: "zero six"}
    assert repeats.digests(docs_of(spark, [])).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    for alphabet in (2, 5, 1000):
        passage = rng.integers(0, alphabet, 60).astype(np.uint64)
        names = np.concatenate([rng.integers(0, alphabet, 37).astype(np.uint64), passage, rng.integers(0, alphabet, 11).astype(np.uint64), passage, passage[:5]])
        rows = np.zeros(len(names), np.int64)
        rows[97:] = 1
        at, found = repeats.anchors(names, rows, 13)
        anchor = dict(zip(at.tolist(), found.tolist(), strict=True))
        for k in range(48):
            assert anchor[37 + k] == anchor[108 + k]
        assert all(rows[a] == rows[a + 12] for a in at)


def test_symbols_of_equal_inner_parts_are_equal():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 6, 300).astype(np.uint64)
    left, right = (np.concatenate([rng.integers(0, 6, 50).astype(np.uint64), passage, rng.integers(0, 6, 50).astype(np.uint64)]) for _ in range(2))
    for (a, fa, sa), (b, fb, sb) in zip(repeats.levels(left, np.zeros(400, int), 4), repeats.levels(right, np.zeros(400, int), 4), strict=True):
        inner = lambda n, f, s: set(zip(n.tolist(), f.tolist(), s.tolist(), strict=True))
        one, two = ({x for x in inner(*t) if 50 <= x[1] and x[2] <= 350} for t in ((a, fa, sa), (b, fb, sb)))
        assert one == two and one


# Fill-in-the-middle ------------------------------------------------------------------------------

def fim_by_hand(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text
    if h4 % 100 < 20:
        return i, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return i, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def fim_rows():
    rng = random.Random(9)
    signs = "ab <>PSMé€😀́\n\x00"
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(80)))) for i in range(150)]
    mixed = "".join(rng.choice("aé€😀") * rng.randrange(1, 3000) for _ in range(400))
    return rows + [(1000, None), (1001, ""), (1001, ""), (None, "né"), (1002, "x<M>y"), (1003, "<P"), (1004, mixed), (1005, "é" * 300_000), (1006, "plain ascii " * 200_000), (-7, "negative")]


def test_fill_in_middle(spark):
    rows = fim_rows()
    got = sorted((tuple(r) for r in fill_middle.digests(docs_of(spark, rows)).collect()), key=repr)
    want = [fim_by_hand(*r) for r in rows]
    assert got == sorted(((*w[:5], sha(w[5]), sha(t or "")) for w, (_, t) in zip(want, rows, strict=True)), key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fill_middle.digests(docs_of(spark, [])).count() == 0


def test_stored_index_gives_the_same_cuts(spark):
    rows = fim_rows()[:80] + [(2000, "aé" * 900)]
    indexed = fill_middle.build_index(docs_of(spark, rows))
    assert indexed.columns[:-1] == docs_of(spark, []).columns
    for seed in (1, 2):
        a = sorted((tuple(r) for r in fill_middle.transform(docs_of(spark, rows), seed).collect()), key=repr)
        b = sorted((tuple(r) for r in fill_middle.transform(indexed, seed, index="fim_index").collect()), key=repr)
        assert a == b
    assert [tuple(r) for r in fill_middle.transform(docs_of(spark, [(5, "né")])).select("form", "prefix_chars", "middle_chars", "output").collect()] == [fim_by_hand(5, "né")[2:]]


@pytest.mark.parametrize("bound", [1, 7, 120])
def test_rank_index_is_exact(bound):
    rng = np.random.default_rng(bound)
    for parts in ([1] * 5000, [4] * 3000, rng.integers(1, 5, 50_000), np.repeat(rng.integers(1, 5, 300), 100), [2], []):
        offsets = np.append(0, np.cumsum(parts)).astype(np.int64)
        index = fill_middle.fit(offsets, bound)
        assert (fill_middle.look_up(index, np.arange(len(offsets))) == offsets).all()
        assert np.abs(index[4].astype(int)).max(initial=0) <= bound + 1
    assert len(fill_middle.fit(np.arange(100_000))[0]) == 1 and len(fill_middle.fit(np.arange(100_000))[4]) == 0


# Conversation trie -------------------------------------------------------------------------------

def trie_by_hand(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in turns.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    sums = {}
    for path in sorted(members, key=len, reverse=True):
        below = [sums[p] for p in children[path]]
        words = len(SPACES.findall(path[-1][1])) if path else 0
        sums[path] = (sum(x[0] for x in below) if below else 1, sum(x[1] for x in below) + (len(members[path]) - 1) * words)
    out = []
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(full[c]) == len(path)))
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(children[path]), *sums[path], sha(ends)))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
CONVS = "conv_id long, turn long, role string, text string, path string, key string, h int, tokens int"


def trie_of(spark, rows):
    table = spark.createDataFrame([(*r, "p", "k", 1, 2) for r in rows], CONVS)
    return prefix_trie.trie(prefix_trie.shared_heads(prefix_trie.ordered_turns(table)))


def conversations(seed, n):
    rng = random.Random(seed)
    rows = [(None, 1, "user", "lost"), (5, None, None, None), (5, 1, "user", "hi there"), (7, 1, None, ""), (7, 1, None, ""), (8, 2, "a", "bc"), (9, 2, "ab", "c")]
    for c in range(10, 10 + n):
        if c in (21, 22):
            continue  # a first conversation that is absent, and one without turns
        for t in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
            rows.append((c, t if rng.random() < 0.97 else None, ("user", "assistant")[t % 2], rng.choice(["hello", "good day to you", "x\ny  z", "", None]) if t < 3 else rng.choice("abc")))
    deep = [(c, t, "user", f"turn {t}" if t < 120 or c % 2 else f"other {t}") for c in (300, 301, 302, 303) for t in range(150 - c % 3)]
    return rows + deep


def test_trie(spark):
    for seed, n in ((1, 30), (2, 150)):
        rows = conversations(seed, n)
        # Repeated (conv_id, turn) pairs stand in the order of role, then of a digest: keep those out of the comparison.
        seen = Counter((r[0], r[1]) for r in rows if r[1] is None)
        rows = [r for r in rows if seen[(r[0], r[1])] <= 1]
        got = trie_of(spark, rows)
        assert got.columns == COLUMNS
        assert sorted((tuple(r) for r in got.collect()), key=repr) == trie_by_hand(rows)


def test_trie_of_copies_and_nothing(spark):
    rows = [(c, t, "user", f"{t} same words") for c in range(2500) for t in range(3)]
    assert sorted((tuple(r) for r in trie_of(spark, rows).collect()), key=repr) == trie_by_hand(rows)
    assert trie_of(spark, []).count() == 0
    table = spark.createDataFrame([], CONVS)
    assert prefix_trie.ordered_turns(table).count() == 0


def test_repeated_turns_have_one_order(spark):
    rows = [(1, 1, "b", "x"), (1, 1, "a", "y"), (1, 1, "a", "y"), (1, None, "z", "w")]
    tables = [spark.createDataFrame([(*x, "p", "k", 1, 2) for x in r], CONVS) for r in (rows, rows[::-1])]
    one, two = (sorted(map(tuple, prefix_trie.trie(prefix_trie.ordered_turns(t)).collect()), key=repr) for t in tables)
    assert one == two and len(one) == 5


def test_ranges_are_merged(spark):
    rows = conversations(3, 400)
    turns = prefix_trie.ordered_turns(spark.createDataFrame([(*r, "p", "k", 1, 2) for r in rows], CONVS))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = sorted(map(tuple, prefix_trie.trie(turns).collect()), key=repr)
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert many == sorted(map(tuple, prefix_trie.trie(turns).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
