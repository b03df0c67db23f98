"""LM scoring (operator 8) with a probabilistic suffix tree over words.

Tokens are a text's words, A-Z lower-cased, then one end. The root is the smoothed
unigram model (c + 0.1) / (N + 0.1 (V + 1)) over all training tokens. A context is a
run of up to MAX_DEPTH words; contexts and their counted next words are all runs seen
LEAST times or more in training, so the model grows with the corpus. A context
stays in the tree if its next-word distribution diverges from its longest kept
suffix's: the log likelihood it gains on its own occurrences must exceed its
description length, half of ln N for each probability. Next-word distributions are
smoothed: counted words get n / (c + GAMMA), and the rest backs off to the suffix,
scaled to sum to one. A token is scored in the state of the longest kept suffix of
the words before it.

Spark does the counting. Texts become blocks (words by 64-bit hash against the block's
own list). A run is a 64-bit key. Order by order, a block deals its distinct runs to
shards by key (a run at most once a block, so a common one is no large group; the
number of shards grows with the corpus), and each shard answers each block with its
runs' training totals, in the order in which they came. The answers lie in files of the
shared folder, which the later passes read in place: only runs and places are shuffled.
Only runs whose shorter runs are counted go on. Each counted run is summed up by one block only: with a context's
next words counted, the blocks deal their parts of its divergence test to the shards
by the context's key, beside the next order's runs, and the shards add them up and
answer every block that has the context whether it stays. Totals and contexts kept
give a block all its probabilities: the tree is nowhere in one place.

Defined results: a null or empty text is the end alone; without training rows every
probability is 1 and every score 0; repeated rows count as often as they come.
"""

from __future__ import annotations

import math
import pickle
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.binary_output import file_system
from tillpoint.llm.common import col, fold, prepare, scratch_dir, slices, stored, table, texts

LEAST = 2
MAX_DEPTH = 3
GAMMA = 2.0
BLOCK_BYTES = 8 << 20
SMOOTH = 0.1
SHARD_TOKENS = 1 << 21
_TURN = np.uint64(0x9E3779B97F4A7C15)


def _pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def _unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _joined(batches):
    """Batches put together as long as a block holds them."""
    held, size = [], 0
    for b in batches:
        if held and size + b.nbytes > BLOCK_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def blocks(docs: DataFrame, folder: str) -> DataFrame:
    """(block, train_tokens, path, start, size, words): documents as places in the
    block's list of words, written to a file of the task's own attempt in the shared
    ``folder``, so that the passes over a block read it in place and shuffle the answers
    only; ``words`` has the list as sorted hashes, with training counts."""
    schema = pa.schema([("block", pa.int64()), ("train_tokens", pa.int64()), ("path", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("words", pa.binary())])

    def run(batches):
        base, k, start, file = TaskContext.get().partitionId() << 32, 0, 0, None
        path = f"{folder}/part-{base >> 32:07d}-{uuid.uuid4().hex}.bin"
        digest, found = xxhash.xxh64_intdigest, []
        for b in slices(_joined(batches), max_bytes=BLOCK_BYTES):
            if file is None:
                fs, place = file_system(path)
                fs.create_dir(place.rpartition("/")[0], recursive=True)
                file = fs.open_output_stream(place)
            lists = [t.lower().split() for t in texts(b)]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists)) + 1
            flat = np.empty(int(sizes.sum()), object)
            flat[:] = [w for ws in lists for w in (*ws, b"")]  # the end is the empty word
            ids, words = pd.factorize(flat)
            hashes, _, places = _distinct(np.fromiter(map(digest, words), np.uint64, len(words)))
            ids = places[ids]
            held = np.array(col(b, "held_out").to_pylist(), bool)
            counts = np.bincount(ids[np.repeat(~held, sizes)], minlength=len(hashes))
            data = _pack(col(b, "doc_id").to_pylist(), held, sizes, _narrow(ids))
            file.write(data)
            found.append((base + k, int(sizes[~held].sum()), path, start, len(data), _pack(_planes(hashes), _narrow(counts))))
            k, start = k + 1, start + len(data)
        if file is not None:
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 10) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "block long, train_tokens long, path string, start long, size long, words binary")


def _payloads(rows: pa.Table):
    """(block, payload) of rows of :func:`blocks`."""
    for block, path, start, size in zip(*(rows[c].to_pylist() for c in ("block", "path", "start", "size"))):
        fs, place = file_system(path)
        with fs.open_input_file(place) as file:
            file.seek(start)
            yield block, file.read(size)


class Tree:
    """The model in one place, for small inputs (tests compare :func:`score` with it):
    runs by order and the states kept. Run k of order n is (run of order n - 1) *
    width + symbol in ``keys[n]``, sorted; symbols are places in ``symbols``."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray, n_train: int, n_known: int):
        self.symbols, self.width = symbols, max(1, len(symbols))
        self.n_train = n_train
        self.root = (counts + SMOOTH) / (n_train + SMOOTH * (n_known + 1))
        self.keys = {1: np.arange(len(symbols), dtype=np.int64)}
        self.counts = {1: counts}

    def tokens(self, table_of: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Symbol places of a block's tokens, -1 for words that are not frequent."""
        if not len(self.symbols):
            return np.full(len(dense), -1, np.int64)
        at = np.searchsorted(self.symbols, table_of)
        at = np.where((at < len(self.symbols)) & (self.symbols[np.minimum(at, len(self.symbols) - 1)] == table_of) & (table_of != 0), at, -1)
        return at[dense].astype(np.int64)

    def find(self, order: int, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Places of the runs (before, last) among ``keys[order]``, -1 if absent."""
        keys = self.keys.get(order)
        if keys is None or not len(keys):
            return np.full(len(last), -1, np.int64)
        key = np.where((before >= 0) & (last >= 0), before * self.width + last, -1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[at] == key) & (key >= 0), at, -1)

    def runs(self, tok: np.ndarray, first: np.ndarray, upto: int) -> dict[int, np.ndarray]:
        """For each order the run that ends at each token (-1: none); ``first`` marks
        the first token of each text."""
        out = {1: tok}
        for n in range(2, upto + 1):
            before = np.append(-1, out[n - 1][:-1])
            before[first] = -1
            out[n] = self.find(n, before, tok)
        return out

    def candidates(self, tok: np.ndarray, first: np.ndarray, order: int) -> np.ndarray:
        """Keys of the runs of ``order`` whose shorter runs are frequent, one a token."""
        runs = self.runs(tok, first, order - 1)
        before = np.append(-1, runs[order - 1][:-1])
        before[first] = -1
        ok = (before >= 0) & (tok >= 0) & (runs[order - 1] >= 0)
        return before[ok] * self.width + tok[ok]

    def add(self, order: int, keys: np.ndarray, counts: np.ndarray) -> None:
        at = np.argsort(keys)
        self.keys[order], self.counts[order] = keys[at], counts[at]

    def grow(self) -> None:
        """Divergence tests, shortest contexts first. State 0 is the root; state s has
        parent[s], alpha[s] (log10) and the next words in ``next`` (sorted keys state *
        width + symbol) with log10 P - log10 P_root in ``gain``."""
        self.state = {n: np.zeros(len(k), np.int64) for n, k in self.keys.items()}
        self.parent, self.alpha = [0], [0.0]
        prob: list[dict[int, float]] = [{}]
        scale = [1.0]  # alpha itself
        price = 0.5 * math.log(max(self.n_train, 2))

        def p(state: int, x: int) -> float:
            f = 1.0
            while state and x not in prob[state]:
                f, state = f * scale[state], self.parent[state]
            return f * (prob[state][x] if state else self.root[x])

        for order in range(1, MAX_DEPTH + 1):
            longer = self.keys.get(order + 1)
            if longer is None or not len(longer):
                break
            ctx = longer // self.width
            edges = np.flatnonzero(np.diff(ctx, prepend=-1, append=-1))
            for lo, hi in zip(edges, edges[1:]):
                c = int(ctx[lo])
                xs, ns = (longer[lo:hi] % self.width).tolist(), self.counts[order + 1][lo:hi]
                total = float(self.counts[order][c])
                suffix = 0
                for n in range(order - 1, 0, -1):  # longest kept proper suffix
                    s = self._suffix(order, c, n)
                    if s >= 0 and self.state[n][s]:
                        suffix = int(self.state[n][s])
                        break
                old = [p(suffix, x) for x in xs]
                new = [float(n) / (total + GAMMA) for n in ns]
                rest, rest_old = 1 - sum(new), max(1 - sum(old), 1e-12)
                gain = sum(float(n) * math.log(a / b) for n, a, b in zip(ns, new, old)) + max(0.0, total - float(ns.sum())) * math.log(rest / rest_old)
                if gain <= price * (len(xs) + 1):
                    continue
                self.state[order][c] = len(self.parent)
                self.parent.append(suffix)
                prob.append(dict(zip(xs, new)))
                scale.append(rest / rest_old)
                self.alpha.append(math.log10(rest / rest_old))
        flat = sorted((s * self.width + x, math.log10(v) - math.log10(self.root[x])) for s, row in enumerate(prob) for x, v in row.items())
        self.next = np.array([k for k, _ in flat], np.int64)
        self.gain = np.array([g for _, g in flat])
        self.parent, self.alpha = np.array(self.parent), np.array(self.alpha)

    def _suffix(self, order: int, run: int, n: int) -> int:
        """The run of the last n symbols of a run, -1 if it is not frequent."""
        symbols, k, r = [], order, run
        while k > 1:
            key = int(self.keys[k][r])
            symbols.append(key % self.width)
            r, k = key // self.width, k - 1
        symbols.append(r)
        symbols = symbols[::-1][-n:]
        r = symbols[0]
        for k, x in enumerate(symbols[1:], 2):
            keys = self.keys[k]
            at = int(np.searchsorted(keys, r * self.width + x))
            if at == len(keys) or keys[at] != r * self.width + x:
                return -1
            r = at
        return r

    def adjust(self, tok: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 of P(token | longest kept suffix) / P_root(token) of every token."""
        orders = [n for n in self.state if n <= MAX_DEPTH]
        runs = self.runs(tok, first, max(orders))
        state = np.zeros(len(tok), np.int64)
        for n in sorted(orders):
            if len(self.state[n]):
                s = np.where(runs[n] >= 0, self.state[n][np.maximum(runs[n], 0)], 0)
                state = np.where(s > 0, s, state)
        state = np.append(0, state[:-1])
        state[first] = 0
        out = np.zeros(len(tok))
        at = np.flatnonzero(state)
        while len(at):
            key = np.where(tok[at] >= 0, state[at] * self.width + tok[at], -1)
            place = np.minimum(np.searchsorted(self.next, key), len(self.next) - 1)
            hit = self.next[place] == key
            out[at] += np.where(hit, self.gain[place], self.alpha[state[at]])
            state[at] = np.where(hit, 0, self.parent[state[at]])
            at = at[state[at] > 0]
        return out


def _first(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _split(shard: np.ndarray):
    """(shard, its places, ascending) for every shard that has some."""
    at = np.argsort(shard, kind="stable")  # of 16 bits: a radix sort
    edges = np.flatnonzero(np.diff(shard[at].astype(np.int64), prepend=-1, append=-1))
    for lo, hi in zip(edges, edges[1:]):
        yield int(shard[at[lo]]), at[lo:hi]


def _mix(numbers: np.ndarray) -> np.ndarray:
    """Numbers as 64-bit keys, one to one."""
    x = numbers.astype(np.uint64) + np.uint64(1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _planes(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as byte planes of their steps, which compress better."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def _keys(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


_PARTS = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("ord", pa.int32()), ("payload", pa.binary())])
_PARTS_DDL = "block long, shard long, ord int, payload binary"
_PLACES = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("n_known", pa.int64())])
_PLACES_DDL = "block long, shard long, file string, start long, size long, n_known long"


def _rows(out: list, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * len(schema), schema)], schema=schema)


def _distinct(keys: np.ndarray):
    """The distinct keys, sorted, a place of each and each key's number among them."""
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    # places in the low bits: a plain sort is several times faster than an argsort
    at = (np.sort(keys & ~low | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    if (keys[at][1:] < keys[at][:-1]).any():  # keys that differ in the low bits only
        at = np.argsort(keys)
    new = np.append(True, np.diff(keys[at]) != 0)[: len(keys)]
    inverse = np.empty(len(keys), np.int32)
    inverse[at] = np.cumsum(new) - 1
    return keys[at[new]], at[new], inverse


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in the smallest type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max()) if len(counts) else 0))


class View:
    """A block's runs up to an order. For each order: the tokens at which one ends
    (``at``), the distinct keys (``own``, sorted; words: by hash) and their shards, the
    token's key among them (``inverse``; for every token ``slot``, -1: none), a place in
    ``at`` of each (``where``), and, as far as the shards have answered, training totals
    (``total``), the rank among the counted runs of the shard (``rank``), whether the block is the one to sum the run up (``once``), ln alpha of the contexts
    kept (``alpha``, else NaN) and ln P of the run's last word in the longest kept
    suffix of its context (``p``, of counted runs)."""

    def __init__(self, payload: bytes, told: dict, shards: int, upto: int, scale: float):
        self.doc_ids, self.held, self.sizes, ids = _unpack(payload)
        self.first, self.shards, self.told, self.scale = _first(self.sizes), shards, told, scale
        self.at, self.own, self.inverse, self.where, self.total, self.once, self.slot = ({} for _ in range(7))
        self.shard, self.rank, self.alpha, self.p = ({} for _ in range(4))
        kind = np.min_scalar_type(shards)
        # the words are in the order of the shards, which have answered for all of them
        sizes = [(s, len(told[1, s][0])) for n, s in sorted(told) if n == 1]
        self.shard[1] = np.repeat(np.array([s for s, _ in sizes], kind), [k for _, k in sizes])
        self.at[1], self.inverse[1] = np.arange(len(ids)), ids.astype(np.int32)
        counted = self._answered(1, len(ids))
        self.own[1] = _mix(self.rank[1] * shards + self.shard[1])
        last = key = self.own[1][ids]
        for n in range(2, upto + 1):
            key = np.append(np.uint64(0), key[:-1]) * _TURN + last
            key = (key ^ (key >> np.uint64(29))) * _TURN + np.uint64(n)
            before = np.append(False, counted[:-1])
            before[self.first] = False
            self.at[n] = np.flatnonzero(before & counted)
            self.own[n], self.where[n], self.inverse[n] = _distinct(key[self.at[n]])
            self.shard[n] = ((self.own[n] >> np.uint64(40)) % np.uint64(shards)).astype(kind)
            counted = self._answered(n, len(ids))

    def _answered(self, n: int, tokens: int) -> np.ndarray:
        """Tokens at which a counted run of order n ends."""
        said, self.rank[n] = np.zeros((2, len(self.shard[n])), np.int64)
        for shard, x in _split(self.shard[n]):
            if (n, shard) in self.told:
                said[x], steps = self.told[n, shard]
                self.rank[n][x[said[x] >= 2 * LEAST]] = np.cumsum(steps, dtype=np.int64)
        self.total[n], self.once[n] = said >> 1, (said & 1).astype(bool)
        self.slot[n] = np.full(tokens, -1, np.int32)
        self.slot[n][self.at[n]] = self.inverse[n]
        place = self.counted(n)
        self.p[n], self.alpha[n] = np.full((2, len(said)), np.nan)
        if n == 1:
            self.p[1] = np.log((self.total[1] + SMOOTH) / self.scale)
        else:
            ctx, suf = self.around(n, place)
            new = np.log(self.total[n][place]) - np.log(self.total[n - 1][ctx] + GAMMA)
            self.p[n][place] = np.where(np.isnan(self.alpha[n - 1][ctx]), self.p[n - 1][suf], new)
        if n <= MAX_DEPTH and any(k == -n for k, _ in self.told):
            for shard, x in _split(self.shard[n][place]):
                if (-n, shard) in self.told:
                    self.alpha[n][place[x]] = self.told[-n, shard][0]
        counted = np.zeros(tokens, bool)
        counted[self.at[n]] = (self.total[n] >= LEAST)[self.inverse[n]]
        return counted

    def counted(self, n: int) -> np.ndarray:
        return np.flatnonzero(self.total[n] >= LEAST)

    def around(self, n: int, runs: np.ndarray):
        """The places of the contexts and of the suffixes of runs of order n."""
        t = self.at[n][self.where[n][runs]]
        return self.slot[n - 1][t - 1], self.slot[n - 1][t]

    def offer(self, n: int):
        """(shard, payload): the runs of order n with their training counts."""
        own = self.own[n]
        counts = _narrow(np.bincount(self.inverse[n][np.repeat(~self.held, self.sizes)[self.at[n]]], minlength=len(own)))
        for shard, x in _split(self.shard[n]):
            yield shard, _pack(_planes(own[x]), counts[x])

    def tests(self, n: int):
        """(shard, payload): the counted contexts of order n, by steps of their rank in the
        shard, the number of next words of each to be summed up here, the totals of those that have some, and for each
        such word its total and ln P in the longest kept suffix."""
        place = self.counted(n)
        parts = list(_split(self.shard[n][place]))
        spot = np.zeros(len(self.own[n]), np.int64)
        spot[place[np.concatenate([np.zeros(0, np.int64), *(x for _, x in parts)])]] = np.arange(len(place))
        mine = np.flatnonzero(self.once[n + 1] & (self.total[n + 1] >= LEAST))
        ctx, suf = self.around(n + 1, mine)
        at = np.argsort(spot[ctx])
        counts, old = self.total[n + 1][mine][at], self.p[n][suf[at]]
        words = np.bincount(spot[ctx], minlength=len(place))
        ends = np.cumsum(words)
        lo = 0
        for shard, x in parts:
            w, hi = words[lo : lo + len(x)], lo + len(x)
            rows = slice(ends[lo] - words[lo], ends[hi - 1])
            yield shard, _pack(_narrow(np.diff(self.rank[n][place[x]], prepend=0)), _narrow(w), _narrow(self.total[n][place[x[w > 0]]]), _narrow(counts[rows]), old[rows])
            lo = hi

    def adjust(self) -> np.ndarray:
        """ln of P(token | longest kept suffix) / P_root(token) of every token."""
        out = np.zeros(len(self.slot[1]))
        root = self.p[1][self.slot[1]]
        for n in range(1, MAX_DEPTH + 1):
            slot = np.append(-1, self.slot[n][:-1])
            slot[self.first] = -1
            a = np.append(self.alpha[n], np.nan)[slot]
            p = np.append(self.p[n + 1], np.nan)[self.slot[n + 1]]
            out = np.where(np.isnan(a), out, np.where(np.isnan(p), a + out, p - root))
        return out


def _told(found: pa.Table, folder: str) -> dict:
    """By order and shard the answers at the places that a block's rows name."""
    fs, top = file_system(folder)
    told = {}
    for shard, name, start, size in zip(*(found[c].to_pylist() for c in ("shard", "file", "start", "size"))):
        with fs.open_input_file(f"{top}/{name}") as file:
            file.seek(start)
            told |= {(n, shard): part for n, part in _unpack(file.read(size))}
    return told


def _offer_words(shards: int):
    """A block's words for the shards, dealt by ranges of the hash."""

    def run(batches):
        for b in batches:
            out = []
            for block, data in zip(col(b, "block").to_pylist(), col(b, "words").to_pylist()):
                planes, counts = _unpack(data)
                own = _keys(planes)
                shard = ((own >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.min_scalar_type(shards))
                out += [(block, s, 1, _pack(_planes(own[x]), counts[x])) for s, x in _split(shard)]
            yield from _rows(out, _PARTS).to_batches()

    return run


def _offer(order: int, shards: int, scale: float, folder: str):
    """A block's runs of ``order`` for the shards, and its part of the tests of the
    contexts two orders shorter, whose next words have been counted."""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for block, data in _payloads(rows):
            v = View(data, _told(found, folder), shards, min(order, MAX_DEPTH + 1), scale)
            if order <= MAX_DEPTH + 1:
                out += [(block, shard, order, part) for shard, part in v.offer(order)]
            if order > 2:
                out += [(block, shard, 2 - order, part) for shard, part in v.tests(order - 2)]
        return _rows(out, _PARTS)

    return run


def _totals(data: list, order: int) -> list:
    """To each block its runs' training totals (0 under LEAST, words apart), doubled,
    plus 1 in one block that has the run, and the steps of the counted ones' ranks."""
    keys, where, inverse = _distinct(np.concatenate([_keys(k) for k, _ in data]))
    total = np.bincount(inverse, weights=np.concatenate([n for _, n in data])).astype(np.int64)
    total[total < (1 if order == 1 else LEAST)] = 0
    rank = np.cumsum(total >= LEAST) - 1
    answer = 2 * total[inverse]
    answer[where] += total > 0
    cuts = np.cumsum([len(n) for _, n in data])[:-1]
    return [(a, np.diff(rank[x[a >= 2 * LEAST]], prepend=0)) for a, x in zip(np.split(answer, cuts), np.split(inverse, cuts))]


def _kept(data: list, price: float) -> list:
    """To each block ln alpha of its contexts, NaN where one does not stay."""
    sizes = [len(x[0]) for x in data]
    inverse = np.concatenate([np.cumsum(x[0], dtype=np.int64) for x in data])
    words = np.concatenate([x[1] for x in data])
    total, n, old = (np.concatenate([x[k] for x in data]).astype(float) for k in range(2, 5))
    context = np.zeros(int(inverse.max()) + 1)
    context[inverse[words > 0]] = total
    at = np.repeat(inverse, words)
    own, n, mass, words = (np.bincount(at, weights=w, minlength=len(context)) for w in (n * (np.log(n) - old), n, np.exp(old), np.ones(len(at))))
    alpha = np.log((1 - n / (context + GAMMA)) / np.maximum(1 - mass, 1e-12))
    gain = own - n * np.log(context + GAMMA) + np.maximum(0, context - n) * alpha
    alpha[(words == 0) | ~(gain > price * (words + 1))] = np.nan
    return np.split(alpha[inverse], np.cumsum(sizes)[:-1])


def _count(price: float, folder: str):
    """One shard: its answers to each block, written to a file of the task's own attempt
    in the shared ``folder``; the rows have their places."""

    def run(offered: pa.Table) -> pa.Table:
        blocks, shard, orders, payloads = (offered[c].to_pylist() for c in ("block", "shard", "ord", "payload"))
        told, known = {}, {}
        for order in sorted(set(orders), reverse=True):
            rows = [i for i, n in enumerate(orders) if n == order]
            data = [_unpack(payloads[i]) for i in rows]
            for i, part in zip(rows, _totals(data, order) if order > 0 else _kept(data, price)):
                if order > 0:
                    known[blocks[i]] = int((part[0] & 1).sum())
                    told.setdefault(blocks[i], []).append((order, tuple(map(_narrow, part))))
                elif not np.isnan(part).all():
                    told.setdefault(blocks[i], []).append((order, (part,)))
        name, start, out = f"{uuid.uuid4().hex}.bin", 0, []
        fs, top = file_system(folder)
        fs.create_dir(top, recursive=True)
        with fs.open_output_stream(f"{top}/{name}") as file:
            for block, parts in told.items():
                data = _pack(*parts)
                file.write(data)
                out.append((block, shard[0], name, start, len(data), known.get(block, 0)))
                start += len(data)
        return _rows(out, _PLACES)

    return run


def _gone(df: DataFrame) -> None:
    """Deletes a stored table that no later step reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def score(docs: DataFrame) -> DataFrame:
    """Base and tree scores of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    prepare(spark)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")  # each pass is stored, its shuffle files can go
    try:
        return _score(docs)
    finally:
        spark.conf.set(_CLEANUP, before)


def _score(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    folder = f"{scratch_dir(spark)}/pst-{uuid.uuid4().hex}"
    data = stored(blocks(docs, folder), "pst-words")
    n_train = int(data.agg(F.sum("train_tokens")).first()[0] or 0)
    shards = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_train // SHARD_TOKENS)
    count = _count(0.5 * math.log(max(n_train, 2)), folder)
    offered = data.select("block", "words").mapInArrow(_offer_words(shards), _PARTS_DDL)
    counted = stored(offered.groupBy("shard").applyInArrow(count, _PLACES_DDL), "pst-counted")
    scale = n_train + SMOOTH * (int(counted.agg(F.sum("n_known")).first()[0] or 0) + 1)
    words, data = data, stored(data.drop("train_tokens", "words"), "pst-blocks")
    _gone(words)
    told = counted.drop("n_known")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a number of its own: rows of places are few bytes, which Spark would put in one task
    by_block = lambda df: df.repartition(tasks, "block").groupBy("block")
    for order in range(2, MAX_DEPTH + 3):
        offered = by_block(data).cogroup(by_block(told)).applyInArrow(_offer(order, shards, scale, folder), _PARTS_DDL)
        told = told.unionByName(stored(offered.groupBy("shard").applyInArrow(count, _PLACES_DDL), "pst-counted").drop("n_known"))
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        tables = [out.empty_table()]
        for _, payload in _payloads(rows):
            v = View(payload, _told(found, folder), shards, MAX_DEPTH + 1, scale)
            c = v.total[1][v.inverse[1]]
            base = np.add.reduceat(np.log10((c + SMOOTH) / scale), v.first)
            known = np.add.reduceat((c > 0).astype(np.int64), v.first)
            extra = np.add.reduceat(v.adjust(), v.first) / math.log(10)
            tables.append(pa.Table.from_arrays([pa.array(v.doc_ids, pa.int64()), pa.array(v.held), pa.array(v.sizes), pa.array(known), pa.array(np.full(len(known), n_train)), pa.array(base), pa.array(base + extra)], schema=out))
        return pa.concat_tables(tables)

    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_block(data).cogroup(by_block(told)).applyInArrow(run, ddl)


def op8(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
