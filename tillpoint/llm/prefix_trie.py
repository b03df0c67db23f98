"""Conversation prefix trie (operator 11) with Z-fast tries.

A node is a distinct sequence of first turns. A turn is hashed to 128 bits with all
turns before it, so that a conversation is a string of such signatures (its path), the
signature at depth d names the node, and paths sort like the trie's leaves.

1. Equal paths are one row with a count. Rows are sorted by path over range partitions,
   so a very common first turn is spread over many of them like any other prefix.
2. Each partition inserts its rows in batches of at most BATCH turns into a Z-fast trie:
   a compacted node is stored under its handle, the signature at the two-fattest depth
   of its edge, and a conversation's exit node is found by fat binary search, in about
   log(length) look-ups. The edges are then expanded into nodes with their share of
   every sum, and the batch's trie is dropped: a task holds one batch.
3. The shares add up by node. For sums over distinct nodes a node counts in the first
   batch that has it: the sorted neighbours of a batch's first and last path tell which
   nodes were there before and whether its last path goes on. Partitions learn this from
   two integers each, collected by the driver.

Defined results: rows without a conv_id are left out; null roles and texts are empty; of
equal turn numbers the lesser role, then the lesser MD5 of (role, text) comes first;
repeated rows are further turns; an empty table has no node, not even a root. One
conversation's signatures (20 bytes a turn, no text) form one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import col, cut, prepare, stored, table

SIG = 16
#: Conversations whose number is a multiple of GROUP lend their first turns (fewer than HEADS).
GROUP, HEADS = 20, 4
BATCH = 1 << 18
CHUNK = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def fattest(lo: int, hi: int) -> int:
    """The number in (lo, hi] that is divisible by the greatest power of two."""
    return hi & (-1 << ((lo ^ hi).bit_length() - 1))


class Node:
    """A compacted node: the turns (start, end] of ``path``, below ``parent``."""

    __slots__ = ("path", "loads", "start", "end", "kids", "parent", "n", "least", "leaves", "words", "fresh")

    def __init__(self, path: bytes, loads: np.ndarray, start: int, end: int, parent):
        self.path, self.loads, self.start, self.end, self.parent = path, loads, start, end, parent
        self.kids: dict[bytes, Node] = {}
        self.n, self.least, self.leaves, self.words, self.fresh = 0, None, 0, 0, 0

    def at(self, depth: int) -> bytes:
        return self.path[SIG * (depth - 1) : SIG * depth]


class ZFastTrie:
    def __init__(self):
        self.root = Node(b"", np.zeros(0, np.int64), 0, 0, None)
        self.handles: dict[bytes, Node] = {}
        self.nodes = [self.root]

    def _handle(self, x: Node) -> bytes:
        return x.at(fattest(x.start, x.end))

    def exit(self, path: bytes) -> tuple[Node, int]:
        """The exit node of a path, and how many turns they have in common: the node's
        end, or a place on its edge."""
        n = len(path) // SIG
        sig = lambda d: path[SIG * (d - 1) : SIG * d]
        node, lo, hi = self.root, 0, n
        while lo < hi:
            f = fattest(lo, hi)
            x = self.handles.get(sig(f))
            if x is None:
                hi = f - 1
            elif x.end <= n and x.at(x.end) == sig(x.end):
                node, lo = x, x.end
            else:
                node, lo, hi = x, f, min(x.end, n)
                break
        else:
            x = node.kids.get(sig(lo + 1)) if lo < n else None
            if x is None:
                return node, lo
            node, lo, hi = x, lo + 1, min(x.end, n)
        while lo < hi:  # on the edge: the last depth with equal signatures
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if node.at(mid) == sig(mid) else (lo, mid - 1)
        return node, lo

    def _add(self, path, loads, start, end, parent) -> Node:
        x = Node(path, loads, start, end, parent)
        parent.kids[x.at(start + 1)] = x
        self.handles[self._handle(x)] = x
        self.nodes.append(x)
        return x

    def insert(self, path: bytes, loads: np.ndarray, n: int, least: int) -> Node:
        """The node of a path with ``n`` conversations, ``least`` their least number."""
        x, d = self.exit(path)
        if d < x.end:  # the edge is cut; the upper part takes over the parent's link
            del self.handles[self._handle(x)]
            upper = self._add(x.path, x.loads, x.start, d, x.parent)
            x.start, x.parent = d, upper
            upper.kids[x.at(d + 1)] = x
            self.handles[self._handle(x)] = x
            x = upper
        if d < len(path) // SIG:
            x = self._add(path, loads, d, len(path) // SIG, x)
        x.n += n
        x.least = least if x.least is None else min(x.least, least)
        return x

    def expand(self, old: int, first: bytes, open_end: Node | None):
        """Rows (sig, parent sig, depth, n, least, children, leaves, saved) of all nodes.
        The first ``old`` turns of ``first`` (-1: not even the root) are in an earlier
        batch; ``open_end`` goes on in a later one."""
        known = lambda x, d: d == 0 or (x.path[: SIG * d] == first[: SIG * d])
        for x in sorted(self.nodes, key=lambda x: -x.end):
            seen = min(old, x.end) if known(x, min(old, x.end)) else -1  # depths up to here are not fresh
            x.leaves += not x.kids and x is not open_end
            kids = sum(not (y.start + 1 <= old and known(y, y.start + 1)) for y in x.kids.values())
            for d in range(x.end, x.start, -1):
                w = int(x.loads[d - 1])
                x.words += x.n * w
                x.fresh += w if d > seen else 0
                yield x.at(d), x.at(d - 1) if d > 1 else b"", d, x.n, x.least, kids, x.leaves, x.words - x.fresh
                kids = int(d > seen)
            if x is self.root:
                yield b"", None, 0, x.n, x.least, kids, x.leaves, x.words - x.fresh
            else:
                p = x.parent
                p.n += x.n
                p.least = x.least if p.least is None else min(p.least, x.least)
                p.leaves, p.words, p.fresh = p.leaves + x.leaves, p.words + x.words, p.fresh + x.fresh


def common_turns(a: bytes, b: bytes) -> int:
    x, y = (np.frombuffer(p[: min(len(a), len(b))], np.uint8).reshape(-1, SIG) for p in (a, b))
    differ = np.flatnonzero((x != y).any(axis=1))
    return int(differ[0]) if len(differ) else len(x)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, syms, loads): each conversation's turns (hash of role and text, number
    of words) after its first turns were replaced by its group head's."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("sym"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int").alias("words"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "sym", "words"))).alias("turns"))
    own = own.select("conv_id", F.transform("turns", lambda t: F.struct(t["sym"].alias("sym"), t["words"].alias("words"))).alias("turns"))
    heads = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, HEADS - 1).alias("lent"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    met = own.withColumn("head", F.col("conv_id") - F.col("conv_id") % GROUP).join(heads, "head", "left")
    lent = F.slice(F.coalesce("lent", F.array().cast("array<struct<sym:binary,words:int>>")), F.lit(1), h)
    seq = F.concat(lent, F.slice("turns", h + 1, F.size("turns")))
    return met.select("conv_id", seq.alias("t")).select("conv_id", F.col("t.sym").alias("syms"), F.col("t.words").alias("loads"))


def paths(seqs: DataFrame) -> DataFrame:
    """(conv_id, sig, path, loads): signatures chained over the turns; loads as 32-bit
    integers in bytes."""
    schema = pa.schema([("conv_id", pa.int64()), ("sig", pa.binary()), ("path", pa.binary()), ("loads", pa.binary())])

    def run(batches):
        for b in batches:
            out = []
            for conv_id, syms, loads in zip(col(b, "conv_id").to_pylist(), col(b, "syms").to_pylist(), col(b, "loads").to_pylist()):
                sig, path = b"", []
                for s in syms:
                    sig = hashlib.blake2b(sig + s, digest_size=SIG).digest()
                    path.append(sig)
                out.append((conv_id, sig, b"".join(path), np.array(loads, np.int32).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return seqs.mapInArrow(run, "conv_id long, sig binary, path binary, loads binary")


def borders(ranged: DataFrame) -> dict[int, tuple[int, bool]]:
    """For each range partition with rows: how many first turns its first path has in
    common with the path before it (-1: there is none), and whether the path after its
    last one goes on from it."""
    ends = pa.schema([("pid", pa.int32()), ("first", pa.binary()), ("last", pa.binary())])

    def edges(batches):
        first = last = None
        for b in batches:
            if b.num_rows:
                p = col(b, "path")
                first, last = p[0].as_py() if first is None else first, p[-1].as_py()
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary())], schema=ends)

    def compare(batches):
        for b in batches:
            rows = list(zip(*(col(b, c).to_pylist() for c in ("before", "first", "last", "after"))))
            yield pa.RecordBatch.from_pydict({"pid": col(b, "pid"), "old": pa.array([-1 if x is None else common_turns(x, f) for x, f, _, _ in rows], pa.int32()), "open": [y is not None and y.startswith(z) for _, _, z, y in rows]})

    order = Window.orderBy("pid")  # one row a partition
    near = ranged.select("path").mapInArrow(edges, "pid int, first binary, last binary").select("*", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    return {r.pid: (r.old, r.open) for r in near.mapInArrow(compare, "pid int, old int, open boolean").collect()}


def shares(ranged: DataFrame, batch: int = BATCH) -> DataFrame:
    """Each batch's nodes with its share of their sums, from one Z-fast trie a batch."""
    at = borders(ranged)
    schema = pa.schema([("sig", pa.binary()), ("parent", pa.binary()), *[(c, pa.int64()) for c in ("depth", "n", "least", "children", "leaves", "saved")]])

    def run(batches):
        pid = TaskContext.get().partitionId()
        old, goes_on = at.get(pid, (-1, False))
        held, size, last = [], 0, None

        def flush(after: bytes | None):
            trie = ZFastTrie()
            for path, loads, n, least in held:
                end = trie.insert(path, np.frombuffer(loads, np.int32).astype(np.int64), n, least)
            on = goes_on if after is None else after.startswith(held[-1][0])
            out = []
            for row in trie.expand(old, held[0][0], end if on else None):
                out.append(row)
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

        for b in batches:
            for row in zip(*(col(b, c).to_pylist() for c in ("path", "loads", "n", "least"))):
                if size >= batch:
                    yield from flush(row[0])
                    old, last = common_turns(held[-1][0], row[0]), held[-1][0]
                    held, size = [], 0
                held.append(row)
                size += len(row[0]) // SIG + 1
        if held:
            yield from flush(None)

    return ranged.mapInArrow(run, "sig binary, parent binary, depth long, n long, least long, children long, leaves long, saved long")


def ends(found: DataFrame) -> DataFrame:
    """(sig, ends_sha256) of the conversations that end at a node. A node's sorted ids
    are joined in chunks by many tasks; one task hashes the chunks as they come."""
    chunk = pa.schema([("sig", pa.binary()), ("first", pa.int64()), ("ids", pa.binary())])
    done = pa.schema([("sig", pa.binary()), ("ends_sha256", pa.string())])

    def join(batches):
        for b in batches:
            now, ids, out = None, [], []
            for sig, conv_id in zip(col(b, "sig").to_pylist(), col(b, "conv_id").to_pylist()):
                if sig != now or len(ids) >= CHUNK:
                    if ids:
                        out.append((now, ids[0], ",".join(map(str, ids)).encode()))
                    now, ids = sig, []
                ids.append(conv_id)
            if ids:
                out.append((now, ids[0], ",".join(map(str, ids)).encode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), chunk)], schema=chunk)

    def digest(batches):
        now, h = None, None
        for b in batches:
            out = []
            for sig, ids in zip(col(b, "sig").to_pylist(), col(b, "ids").to_pylist()):
                if sig != now:
                    if h is not None:
                        out.append((now, h.hexdigest()))
                    now, h = sig, hashlib.sha256(ids)
                else:
                    h.update(b"," + ids)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), done)], schema=done)
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], schema=done)

    chunks = found.select("sig", "conv_id").orderBy("sig", "conv_id").mapInArrow(join, "sig binary, first long, ids binary")
    return chunks.repartition("sig").sortWithinPartitions("sig", "first").mapInArrow(digest, "sig binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, batch: int = BATCH) -> DataFrame:
    """The trie's nodes, one row each, for rows (conv_id, turn, role, text)."""
    prepare(conversations.sparkSession)
    found = stored(paths(rebuilt(conversations)), "trie-paths")
    distinct = found.groupBy("path", "loads").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    ranged = cut(distinct.orderBy("path"))
    merged = shares(ranged, batch).groupBy("sig", "parent", "depth").agg(F.min("least").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")])
    nodes = stored(merged, "trie-nodes")
    above = nodes.select(F.col("sig").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(above, "parent", "left").join(ends(found), "sig", "left")
    return full.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def op11(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(struct_pack(role := role, text := text)
    ORDER BY turn NULLS FIRST, role, md5(concat(length(role), ':', role, text))) AS t
  FROM turns GROUP BY conv_id),
bits AS (
  SELECT conv_id, flatten([[(ascii(CAST(conv_id AS VARCHAR)[i]) >> j) & 1 FOR j IN range(8)]
    FOR i IN range(1, length(CAST(conv_id AS VARCHAR)) + 1)]) AS b
  FROM own),
lent AS (
  SELECT conv_id, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST(x AS BIGINT) FOR x IN b]),
    lambda c, x: xor(c >> 1, CASE WHEN (xor(c, x) & 1) = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 4 AS BIGINT) AS h
  FROM bits),
seqs AS (
  SELECT o.conv_id, list_concat(coalesce(g.t[1:h], []), o.t[h + 1:len(o.t)]) AS s
  FROM own o JOIN lent USING (conv_id) LEFT JOIN own g ON g.conv_id = o.conv_id - o.conv_id % 20),
prefixes AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM seqs),
nodes AS (
  SELECT s[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = len(s)) AS ends
  FROM prefixes GROUP BY 1, 2),
family AS (
  SELECT x.*, y.conv_id AS parent_conv_id FROM nodes x
  LEFT JOIN nodes y ON x.depth > 0 AND y.depth = x.depth - 1 AND y.p = x.p[1:x.depth - 1]),
kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
own_sums AS (
  SELECT f.*, coalesce(k.n, 0) AS n_children,
    CASE WHEN f.depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(f.p[f.depth].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM family f LEFT JOIN kids k ON k.p = f.p),
up AS (SELECT p, n_children, saved, unnest(range(0, depth + 1)) AS d FROM own_sums),
sums AS (
  SELECT p[1:d] AS p, CAST(count(*) FILTER (WHERE n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM up GROUP BY 1)
SELECT o.conv_id, o.depth, o.parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens,
  sha256(coalesce(o.ends, '')) AS ends_sha256
FROM own_sums o JOIN sums s ON s.p = o.p
"""
