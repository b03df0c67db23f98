"""Substring dedup (operator 9) with suffix automata of reference shards.

A window is ``SPAN`` consecutive words of one text. Every word covered by a window
whose word sequence also starts anywhere else (the same text included) is removed.

The corpus is its own reference, so one broadcast automaton of it has no size bound;
instead the reference is cut into shards that meet their documents by a key, and each
shard's automaton lives only in the task that streams the documents' passages over it:

1. Anchors. A window's anchor is its least-hashed run of GRAM words (leftmost on a
   tie). Equal windows have equal anchors at the same place in the window, so a
   window can only repeat if its anchor does. The consecutive windows of one anchor
   form a passage; each window lies in exactly one passage.
2. Anchors are counted over all documents. Passages of anchors seen twice or more are
   cut out of their texts; equal passages of an anchor become one with a count.
3. The distinct passages of an anchor are one reference shard. Its suffix automaton
   (with occurrence counts) is built, the passages stream over it, and the matching
   statistics, taken over strings that occur at least twice, say which windows repeat.
4. An anchor with more than SHARD distinct passages (a very common passage in ever
   different surroundings) is not put into one task: its passages' windows are
   counted one by one, by a 128-bit hash and the anchor. Both ways give the same.
5. The passages' verdicts go back to their documents, and the maximal spans of
   covered words are cut.

Defined results: a null or empty text has no words; repeated rows repeat each other
(all their windows occur twice); a text of fewer than SPAN words keeps all words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import col, prepare, slices, stored, table, texts

SPAN = 35
GRAM = 8
SHARD = 2000


def passages(lists: list[list[bytes]], span: int = SPAN) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, first window, number of windows) of every passage."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    total, width = int(sizes.sum()), span - min(GRAM, span) + 1
    gram = min(GRAM, span)
    if total < span:
        return (np.zeros(0, np.int64),) * 4
    flat = np.empty(total, object)
    flat[:] = [w for ws in lists for w in ws]
    ids, words = pd.factorize(flat)
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)[ids]
    g = np.zeros(total - gram + 1, np.uint64)
    for j in range(gram):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(g)]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    value, place, size = g, np.arange(len(g)), 1
    while size < width:  # least of ``size`` runs from each place on, leftmost on a tie
        step = min(size, width - size)
        left, right = value[: len(value) - step], value[step:]
        first = left <= right
        value = np.where(first, left, right)
        place = np.where(first, place[: len(place) - step], place[step:])
        size += step
    doc = np.repeat(np.arange(len(lists)), sizes)
    at = np.flatnonzero(doc[: total - span + 1] == doc[span - 1 :])
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    anchor = place[at]
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (np.diff(at) != 1))))
    starts = np.cumsum(sizes) - sizes
    d = doc[at[new]]
    return d, g[anchor[new]].view(np.int64), at[new] - starts[d], np.diff(np.append(new, len(at)))


class Automaton:
    """Suffix automaton of several word sequences, with weighted occurrence counts."""

    def __init__(self):
        self.next, self.link, self.len, self.count = [{}], [-1], [0], [0]

    def _state(self, size: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.len.append(size)
        self.count.append(0)
        return len(self.len) - 1

    def add(self, words: list, weight: int) -> None:
        last = 0
        nxt, link, length = self.next, self.link, self.len
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
            else:
                cur = None if q is not None else self._state(length[last] + 1, {}, 0)
                p = last
                if cur is not None:
                    while p >= 0 and w not in nxt[p]:
                        nxt[p][w] = cur
                        p = link[p]
                    q = nxt[p][w] if p >= 0 else None
                if q is None:
                    link[cur] = 0
                elif length[q] == length[p] + 1:
                    if cur is not None:
                        link[cur] = q
                else:
                    clone = self._state(length[p] + 1, dict(nxt[q]), link[q])
                    while p >= 0 and nxt[p].get(w) == q:
                        nxt[p][w] = clone
                        p = link[p]
                    link[q] = clone
                    if cur is None:
                        cur = clone
                    else:
                        link[cur] = clone
                last = q if cur is None else cur
            self.count[last] += weight

    def settle(self) -> None:
        """Counts of all occurrences, from the ends of the added sequences."""
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def statistics(self, words: list, least: int = 2):
        """At each word, the length of the longest string ending there that occurs
        ``least`` times or more."""
        nxt, link, length, count = self.next, self.link, self.len, self.count
        v = n = 0
        for w in words:
            while True:
                u = nxt[v].get(w)
                if u is not None and count[u] >= least:
                    v, n = u, n + 1
                    break
                if not v:
                    n = 0
                    break
                v = link[v]
                n = length[v]
            yield n


def shard_masks(group: list[tuple[bytes, int]], span: int = SPAN) -> list[int]:
    """For each distinct passage (text, count) of one anchor, bit i is set if its
    window i occurs twice or more."""
    if len(group) == 1:
        text, n = group[0]
        return [(1 << (text.count(b" ") + 2 - span)) - 1 if n > 1 else 0]
    lists = [t.split(b" ") for t, _ in group]
    sam = Automaton()
    for ws, (_, n) in zip(lists, group):
        sam.add(ws, n)
    sam.settle()
    return [sum(1 << (j + 1 - span) for j, n in enumerate(sam.statistics(ws)) if n >= span) for ws in lists]


KEY = ["doc_id", "th"]


def _anchors(rows: DataFrame, span: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("h", pa.int64()), ("first", pa.int32())])

    def run(batches):
        for b in slices(batches):
            d, h, first, _ = passages([t.split() for t in texts(b)], span)
            at = pa.array(d)
            yield pa.RecordBatch.from_arrays([col(b, "doc_id").take(at), col(b, "th").take(at), pa.array(h), pa.array(first.astype(np.int32))], schema=schema)

    return rows.mapInArrow(run, "doc_id long, th long, h long, first int")


def _cut(flagged: DataFrame, span: int, with_text: bool) -> DataFrame:
    """The passages of repeated anchors: (h, sid, passage, n) combined in each slice,
    or (h, sid, doc_id, th, first) one a place."""
    fields = [("h", pa.int64()), ("sid", pa.int64()), *([("passage", pa.binary()), ("n", pa.int64())] if with_text else [("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int32())])]
    schema = pa.schema(fields)

    def run(batches):
        for b in slices(batches):
            lists = [t.split() for t in texts(b)]
            wanted = [set(x) for x in col(b, "firsts").to_pylist()]
            ids, ths = col(b, "doc_id").to_pylist(), col(b, "th").to_pylist()
            combined: dict = {}
            places = []
            for d, h, first, n in zip(*(x.tolist() for x in passages(lists, span))):
                if first not in wanted[d]:
                    continue
                text = b" ".join(lists[d][first : first + n + span - 1])
                sid = xxhash.xxh64_intdigest(text) - (1 << 63)
                if with_text:
                    combined[h, sid, text] = combined.get((h, sid, text), 0) + 1
                else:
                    places.append((h, sid, ids[d], ths[d], first))
            out = [(*k, n) for k, n in combined.items()] if with_text else places
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return flagged.mapInArrow(run, "h long, sid long, passage binary, n long" if with_text else "h long, sid long, doc_id long, th long, first int")


def _by_shard(distinct: DataFrame, span: int) -> DataFrame:
    """(h, sid, mask) by one automaton an anchor; each anchor's rows come together."""
    schema = pa.schema([("h", pa.int64()), ("sid", pa.int64()), ("mask", pa.int64())])

    def run(batches):
        h_now, sids, group, out = None, [], [], []

        def close():
            for sid, mask in zip(sids, shard_masks(group, span)):
                if mask:
                    out.append((h_now, sid, mask))

        for b in batches:
            for h, sid, text, n in zip(col(b, "h").to_pylist(), col(b, "sid").to_pylist(), col(b, "passage").to_pylist(), col(b, "n").to_pylist()):
                if h != h_now:
                    if group:
                        close()
                    h_now, sids, group = h, [], []
                sids.append(sid)
                group.append((text, n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=schema)
                out = []
        if group:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=schema)

    return distinct.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, sid long, mask long")


def _by_window(distinct: DataFrame, span: int) -> DataFrame:
    """(h, sid, mask) by counting single windows: for anchors with many passages."""
    schema = pa.schema([("h", pa.int64()), ("sid", pa.int64()), ("bit", pa.int64()), ("w", pa.binary()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            for h, sid, text, n in zip(col(b, "h").to_pylist(), col(b, "sid").to_pylist(), col(b, "passage").to_pylist(), col(b, "n").to_pylist()):
                ws = text.split(b" ")
                m = len(ws) - span + 1
                w = [xxhash.xxh128_digest(b" ".join(ws[i : i + span])) for i in range(m)]
                yield pa.RecordBatch.from_arrays([pa.array([h] * m), pa.array([sid] * m), pa.array([1 << i for i in range(m)]), pa.array(w, pa.binary()), pa.array([n] * m)], schema=schema)

    windows = distinct.mapInArrow(run, "h long, sid long, bit long, w binary, n long")
    twice = stored(windows.groupBy("h", "w").agg(F.sum("n").alias("n")).where("n > 1").select("h", "w"), "substring-windows")
    return windows.join(twice, ["h", "w"], "left_semi").groupBy("h", "sid").agg(F.bit_or("bit").alias("mask"))


def spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, th, text, cuts: array of (first, mask)) of the texts with repeats."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("th", F.xxhash64("text"))
    anchors = stored(_anchors(rows, span), "substring-anchors")
    # written: a join right above the count could not split a hot anchor's rows
    twice = stored(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "substring-repeated")
    refs = anchors.join(twice, "h", "left_semi").groupBy(*KEY).agg(F.collect_set("first").alias("firsts"))
    refs = refs.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "firsts")
    flagged = stored(rows.join(refs, rows.doc_id.eqNullSafe(refs.d) & (rows.th == refs.t)).select("doc_id", "th", "text", "firsts"), "substring-flagged")
    distinct = stored(_cut(flagged, span, True).groupBy("h", "sid", "passage").agg(F.sum("n").alias("n")), "substring-passages")
    large = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > SHARD).select("h")
    masks = _by_shard(distinct.join(large, "h", "left_anti"), span).unionByName(_by_window(distinct.join(large, "h", "left_semi"), span))
    cuts = _cut(flagged, span, False).join(masks, ["h", "sid"]).groupBy(*KEY).agg(F.collect_set(F.struct("first", "mask")).alias("cuts"))
    cuts = cuts.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "cuts")
    return flagged.join(cuts, flagged.doc_id.eqNullSafe(cuts.d) & (flagged.th == cuts.t)).select("doc_id", "th", "text", "cuts")


def covered(n_words: int, cuts: list[tuple[int, int]], span: int = SPAN) -> np.ndarray:
    """Which words the repeated windows cover."""
    edge = np.zeros(n_words + 1, np.int64)
    for first, mask in cuts:
        while mask:
            i = (mask & -mask).bit_length() - 1
            edge[first + i] += 1
            edge[first + i + span] -= 1
            mask &= mask - 1
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Texts with repeats after the cut: (doc_id, th, n_words, n_removed, kept_text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(batches):
        for b in slices(batches):
            out = []
            for doc_id, th, t, cuts in zip(col(b, "doc_id").to_pylist(), col(b, "th").to_pylist(), texts(b), col(b, "cuts").to_pylist()):
                ws = t.split()
                gone = covered(len(ws), [(c["first"], c["mask"]) for c in cuts], span)
                kept = b" ".join([ws[i] for i in np.flatnonzero(~gone)])
                out.append((doc_id, th, len(ws), int(gone.sum()), kept.decode()))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return spans(docs, span).mapInArrow(run, "doc_id long, th long, n_words long, n_removed long, kept_text string")


def _digests(rows: DataFrame) -> DataFrame:
    """(doc_id, th, n_words, kept_sha256) of every row as it is."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for b in slices(batches):
            lists = [t.split() for t in texts(b)]
            yield pa.RecordBatch.from_arrays([col(b, "doc_id"), col(b, "th"), pa.array([len(ws) for ws in lists], pa.int64()), pa.array([hashlib.sha256(b" ".join(ws)).hexdigest() for ws in lists])], schema=schema)

    return rows.mapInArrow(run, "doc_id long, th long, n_words long, kept_sha256 string")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut_docs = remove_repeats(docs).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("sha")).distinct()
    rows = _digests(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th")))
    out = rows.join(cut_docs, rows.doc_id.eqNullSafe(cut_docs.d) & (rows.th == cut_docs.t), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("sha", "kept_sha256").alias("kept_sha256"))
