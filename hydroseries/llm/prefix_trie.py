"""Prefix trie of conversations by truncation peeling.

A conversation is the path of its turns. Peeling starts at the greatest depth: conversations that
end there are the first nodes; then, depth by depth, the last turn is stripped from every
surviving node, the survivors meet the conversations that end one turn earlier, and equal paths
are merged. Counts and sums of a subtree are complete at the moment its node is found, so nodes
are discovered and aggregated in one pass.

How it is spread: conversations with equal paths are merged first, so that copies cost nothing
later. The distinct paths are dealt out in the order of paths (a range of paths is a range of
tasks, so a very common beginning is split over many tasks), and each task peels its own range.
Only nodes that lie on the first or the last path of a range can reach into another range: they
are at most twice the depth in number for each task. Their parts are merged and peeled in the same
way, and what hangs below them is told the name of its parent by a join.

A path is identified by the chained SHA-256 of its turns, cut to 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.llm.store import Store

#: Conversation ids that agree without so many last bits are listed together: at most 1,024.
BUCKET_BITS = 10
#: Bytes of a path's name.
NAME = 16

NODE = "key binary, parent binary, conv_id long, depth long, tokens long, n_convs long, n_children long, n_leaves long, below long, ends_sha256 string, whole boolean, known_parent long"


def _name(*parts: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 2 * NAME))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns (name, n_words) in the order of ``turn``, null first, then role, then name.

    A null role or text is empty. Rows without conv_id are no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The length of the role stands before it, so that role and text cannot be split in two ways.
    name = _name(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    n_words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct(F.col("turn"), role.alias("role"), name.alias("name"), n_words.cast("long").alias("n_words")).alias("t"))
    turns = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["name"].alias("name"), t["n_words"].alias("n_words"))).alias("turns"))


def shared_heads(turns: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Conversations rebuilt: the first h = crc32(conv_id) % ``heads`` turns of the first conversation of the ``group``, then the own turns after the first h."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    first = turns.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("lent"))
    both = turns.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(first, "base", "left")
    lent = F.slice(F.coalesce("lent", F.array().cast("array<struct<name:binary,n_words:bigint>>")), F.lit(1), F.col("h"))
    return both.select("conv_id", F.concat(lent, F.slice("turns", F.col("h") + F.lit(1), F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns"))


def distinct_paths(turns: DataFrame) -> DataFrame:
    """(path, tokens, conv_id, n_convs, ends_sha256): one row for each distinct conversation.

    ``path`` has the chained name of every prefix, the last one of the whole; ``ends_sha256`` is
    of the conversation ids in numerical order. The ids of one path come in lists of neighbouring
    ids and run through one hash, so any number of copies needs little memory.
    """
    chain = F.aggregate("turns", F.array().cast("array<binary>"), lambda done, t: F.concat(
        done, F.array(_name(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(b"")), t["name"]))))
    rows = turns.select("conv_id", chain.alias("path"), F.transform("turns", lambda t: t["n_words"]).alias("tokens"))
    rows = rows.select("conv_id", "path", "tokens", F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(b"")).alias("key"), F.shiftright("conv_id", BUCKET_BITS).alias("bucket"))
    lists = rows.groupBy("key", "bucket").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"), F.first("path").alias("path"), F.first("tokens").alias("tokens"))
    listed = lists.select("key", "bucket", "path", "tokens", F.array_min("ids").alias("low"), F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, now = None, None, None
        for batch in batches:
            done = []
            for row in zip(*(batch.column(k) for k in (0, 2, 3, 4, 5, 6)), strict=True):
                if (this := row[0].as_py()) != key:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    key, digest, now = this, hashlib.sha256(), [row[1], row[2], row[3].as_py(), 0]
                else:
                    digest.update(b",")
                digest.update(row[5].as_buffer())
                now[3] += row[4].as_py()
            yield table(done)
        yield table([(*now, digest.hexdigest())] if now is not None else [])

    kind = pa.schema([("path", pa.list_(pa.binary())), ("tokens", pa.list_(pa.int64())), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("ends_sha256", pa.string())])

    def table(done: list) -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in cols[0]], kind.field(0).type), pa.array([x.as_py() for x in cols[1]], kind.field(1).type),
                                           *[pa.array(c, f.type) for c, f in zip(cols[2:], list(kind)[2:], strict=True)]], schema=kind)

    return (listed.repartition("key").sortWithinPartitions("key", "bucket")
            .mapInArrow(run, "path array<binary>, tokens array<long>, conv_id long, n_convs long, ends_sha256 string"))


EMPTY = hashlib.sha256(b"").hexdigest()


def peel(names: np.ndarray, heads: np.ndarray, tokens: np.ndarray, conv: np.ndarray, n: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes of distinct paths in the order of paths. ``names`` and ``tokens`` hold all paths one after the other, path k from heads[k] to heads[k + 1].

    ``parent`` is the conv_id of the parent where that is whole (``parent_told``). Nodes on the first or the last path are marked as not ``whole``; their ``n_children``,
    ``n_leaves`` and ``below`` leave out children of the same sort.
    """
    length, last = np.diff(heads), len(heads) - 2
    by_end = np.argsort(length, kind="stable")
    first_of = np.searchsorted(length[by_end], np.arange(int(length.max()) + 2))
    out: dict[str, list] = {k: [] for k in ("at", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "below", "ends", "whole")}
    above, made = [], 0
    # Survivors: a path each, with its sums; ``gain`` is what whole subtrees have saved, ``whole`` says that the node cannot go on in another range.
    none = np.zeros(0, np.int64)
    alive = {"row": none, "conv": none, "n": none, "leaves": none, "gain": none, "whole": none.astype(bool), "seen": none.astype(bool), "id": none}
    for d in range(int(length.max()), -1, -1):
        new = by_end[first_of[d]:first_of[d + 1]]
        zero = np.zeros(len(new), np.int64)
        ended = {"row": new, "conv": conv[new], "n": n[new], "leaves": zero, "gain": zero, "whole": zero == 1, "seen": zero == 1, "id": zero - 1}
        merged = {k: np.concatenate([ended[k], alive[k]]) for k in alive}
        order = np.argsort(merged["row"], kind="stable")
        merged = {k: v[order] for k, v in merged.items()}
        row = merged["row"]
        # Stripped to d turns, equal paths are neighbours.
        key = names[heads[row] + d - 1] if d else np.zeros(len(row), names.dtype)
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        top = row[cut]
        total, conv_id = np.add.reduceat(merged["n"], cut), np.minimum.reduceat(merged["conv"], cut)
        counted = merged["seen"] & merged["whole"]
        n_children = np.add.reduceat(counted.astype(np.int64), cut)
        leaves = np.add.reduceat(np.where(counted, merged["leaves"], 0), cut)
        below = np.add.reduceat(np.where(counted, merged["gain"], 0), cut)
        has_more = np.add.reduceat(merged["seen"].astype(np.int64), cut) > 0
        whole = np.ones(len(cut), bool)
        for edge in (0, last):
            if length[edge] >= d:
                whole &= (key[cut] != names[heads[edge] + d - 1]) if d else False
        leaves = np.where(whole & ~has_more, 1, leaves)
        word = tokens[heads[top] + d - 1] if d else np.zeros(len(top), np.int64)
        gain = below + (total - 1) * word
        here = np.full(len(cut), -1, np.int64)
        place = np.searchsorted(cut, np.flatnonzero(~merged["seen"]), "right") - 1
        here[place] = row[~merged["seen"]]
        for k, v in (("at", top), ("depth", np.full(len(cut), d)), ("conv_id", conv_id), ("n_convs", total), ("n_children", n_children), ("n_leaves", leaves), ("below", below),
                     ("ends", np.where(here >= 0, ends[here], EMPTY)), ("whole", whole)):
            out[k].append(v)
        of_group = np.cumsum(np.isin(np.arange(len(row)), cut)) - 1
        told = merged["seen"] & whole[of_group]
        above.append((merged["id"][told], conv_id[of_group[told]]))
        alive = {"row": top, "conv": conv_id, "n": total, "leaves": leaves, "gain": gain, "whole": whole, "seen": np.ones(len(cut), bool), "id": made + np.arange(len(cut))}
        made += len(cut)
    parent = np.full(made, -1, np.int64)
    parent_told = np.zeros(made, bool)
    for ids, conv_ids in above:
        parent[ids], parent_told[ids] = conv_ids, True
    return {k: np.concatenate(v) for k, v in out.items()} | {"parent": parent, "parent_told": parent_told}


def _peeled(paths: DataFrame) -> DataFrame:
    """Nodes of each range of paths."""
    kind = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("tokens", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                      ("n_leaves", pa.int64()), ("below", pa.int64()), ("ends_sha256", pa.string()), ("whole", pa.bool_()), ("known_parent", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [b for b in batches if b.num_rows]
        if not read:
            return
        rows = pa.Table.from_batches(read).combine_chunks()
        path, tokens = rows.column(0).combine_chunks(), rows.column(1).combine_chunks()
        path, tokens = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (path, tokens))
        heads = np.append(0, np.cumsum(path.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
        flat = path.flatten()
        names = np.frombuffer(b"".join(flat.to_pylist()), f"V{NAME}")
        ends = np.array(rows.column(4).to_pylist(), object)
        x = peel(names, heads, tokens.flatten().to_numpy(zero_copy_only=False), rows.column(2).to_numpy(), rows.column(3).to_numpy(), ends)
        at = heads[x["at"]] + x["depth"] - 1
        word = tokens.flatten().to_numpy(zero_copy_only=False)
        for a in range(0, len(at), 20_000):
            s = slice(a, a + 20_000)
            deep, place = x["depth"][s], at[s]
            key = [names[p].tobytes() if d else b"" for p, d in zip(place, deep, strict=True)]
            parent = [names[p - 1].tobytes() if d > 1 else (b"" if d else None) for p, d in zip(place, deep, strict=True)]
            count = [int(word[p]) if d else 0 for p, d in zip(place, deep, strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(key, pa.binary()), pa.array(parent, pa.binary()), pa.array(x["conv_id"][s]), pa.array(deep), pa.array(count, pa.int64()), pa.array(x["n_convs"][s]), pa.array(x["n_children"][s]),
                pa.array(x["n_leaves"][s]), pa.array(x["below"][s]), pa.array(x["ends"][s], pa.string()), pa.array(x["whole"][s]), pa.array(x["parent"][s], mask=~x["parent_told"][s])], schema=kind)

    return paths.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(run, NODE)


def _edges(parts: DataFrame) -> DataFrame:
    """Nodes on the edges of ranges: their parts merged, then peeled from the deepest on. They are at most twice the depth for each range."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "below")]
    merged = (parts.groupBy("depth", "key", "parent")
              .agg(F.min("conv_id").alias("conv_id"), F.max("tokens").alias("tokens"), *sums, F.max(F.when(F.col("ends_sha256") != EMPTY, F.col("ends_sha256"))).alias("ends_sha256")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = [f for f in frames if len(f)]
        if not read:
            return
        rows = pd.concat(read, ignore_index=True)
        conv, below, up = {}, None, []
        for _, level in sorted(rows.groupby("depth"), key=lambda x: -x[0]):
            level = level.set_index("key")
            if below is not None:
                level[["n_children", "n_leaves", "below"]] = level[["n_children", "n_leaves", "below"]].add(below.reindex(level.index), fill_value=0).astype("int64")
            level.loc[level["n_children"] == 0, "n_leaves"] = 1
            gain = level["below"] + (level["n_convs"] - 1) * level["tokens"]
            below = pd.DataFrame({"parent": level["parent"], "n_children": 1, "n_leaves": level["n_leaves"], "below": gain}).groupby("parent").sum()
            conv |= dict(zip(level.index, level["conv_id"], strict=True))
            up.append(level.reset_index())
        out = pd.concat(up, ignore_index=True)
        out["ends_sha256"], out["whole"] = out["ends_sha256"].fillna(EMPTY), True
        out["known_parent"] = out["parent"].map(conv).astype("Int64")
        yield out[["key", "parent", "conv_id", "depth", "tokens", "n_convs", "n_children", "n_leaves", "below", "ends_sha256", "whole", "known_parent"]]

    return merged.repartition(1).mapInPandas(run, NODE)


def trie(turns: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``turns`` (conv_id, turns: array of (name, n_words)).

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens (words that need not be read again in the subtree) and ends_sha256.
    A conversation without turns is a member of the root. An empty table has no node. A conv_id
    that comes twice counts twice.
    """
    store = Store(turns)
    nodes = store.keep(_peeled(store.keep(distinct_paths(turns))))
    edges = store.keep(_edges(nodes.where("NOT whole")))
    # The parent of a whole node is whole in the same range, or lies on an edge.
    whole, cols = nodes.where("whole"), ["conv_id", "depth", "known_parent", "n_convs", "n_children", "n_leaves", "tokens", "below", "ends_sha256"]
    names = edges.select(F.col("key").alias("above"), F.col("conv_id").alias("above_conv_id"))
    hanging = whole.where("known_parent IS NULL").drop("known_parent").join(names, F.col("parent") == F.col("above")).withColumn("known_parent", F.col("above_conv_id"))
    told = whole.where("known_parent IS NOT NULL").select(*cols).union(hanging.select(*cols)).union(edges.select(*cols)).withColumnRenamed("known_parent", "parent_conv_id")
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("below") + (F.col("n_convs") - 1) * F.col("tokens")).alias("saved_tokens"), "ends_sha256")


#: The same in DuckDB, by definition.
PLAIN_SQL = r"""
WITH RECURSIVE b(i, k, v) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM b WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM b WHERE k = 8),
o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT c, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda s, x: xor(s >> 8, tab[CAST(xor(s, x) & 255 AS BIGINT) + 1])), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM o), crc),
r AS (SELECT c.c, o.role, o.text, o.k FROM c JOIN o ON o.c = c.c - c.c % 20 AND o.k <= c.h UNION ALL SELECT c.c, o.role, o.text, o.k FROM c JOIN o USING (c) WHERE o.k > c.h),
n AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY k) AS d FROM r),
p AS (SELECT c, d, string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY c ORDER BY d) AS path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM n),
e AS (SELECT c, 0 AS d, '' AS path, 0 AS w, CAST(NULL AS VARCHAR) AS up FROM c UNION ALL SELECT c, d, path, w, coalesce(lag(path) OVER (PARTITION BY c ORDER BY d), '') FROM p),
l AS (SELECT c, max(d) AS d FROM e GROUP BY c),
v AS (SELECT e.path, any_value(up) AS up, e.d, min(e.c) AS conv_id, count(*) AS n_convs, any_value(w) AS w, coalesce(string_agg(CAST(l.c AS VARCHAR), ',' ORDER BY l.c), '') AS ends
  FROM e LEFT JOIN l ON l.c = e.c AND l.d = e.d GROUP BY e.path, e.d),
k AS (SELECT up, count(*) AS n_children FROM v WHERE d > 0 GROUP BY up),
m AS (SELECT DISTINCT a.path, z.path AS sub FROM e a JOIN e z ON a.c = z.c AND z.d >= a.d),
s AS (SELECT m.path, count(*) FILTER (WHERE k.up IS NULL) AS n_leaves, sum((v.n_convs - 1) * v.w) AS saved FROM m JOIN v ON v.path = m.sub LEFT JOIN k ON k.up = v.path GROUP BY m.path)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, t.conv_id AS parent_conv_id, CAST(v.n_convs AS BIGINT) AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN s USING (path) LEFT JOIN k ON k.up = v.path LEFT JOIN v t ON v.d > 0 AND t.path = v.up
"""
