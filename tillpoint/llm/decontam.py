"""Benchmark decontamination (operator 6) by latent semantic retrieval.

1. Terms are the benchmark's words. Their document frequencies are counted over all
   blocks of ``BLOCK`` words of all documents (one pass, sums by Spark).
2. The benchmark's TF-IDF passages get a randomised SVD: partitions of the benchmark
   add up their share of A'(A G) for a Gaussian G, and of (A Q)'(A Q) for the
   orthonormal basis Q; the driver only sees terms x (RANK + OVERSAMPLE) numbers.
   Term frequencies are binary, so that a repeated word cannot drown the others.
3. Passages longer than a window are cut into pieces of one block that overlap by half,
   and retrieved by piece; shorter ones are one piece.
   Every window of two blocks of every whole document is folded into the latent space
   and compared with every piece by cosine; COSINE or more makes a candidate, and so
   does a window that holds CONTAINED of the piece's weight, whatever else it holds. The
   window's length is taken before folding: what the space does not hold counts
   against it, so a window of common words alone is near no passage. Terms of
   more than COMMON_DF of all blocks are left out of the product, and each piece's
   limit is lowered by what its own could add at most. A block of the benchmark has at
   most RANK pieces (or one passage), and the space as many dimensions as pieces, so it
   holds each exactly: no candidate is lost, and most
   words need no vector. What is found gets its full cosine.
4. A candidate is checked on its words: the longest common subsequence of passage and
   a stretch of the window (widened by the passage's length on both sides) covers LCS_ALONE of the
   passage, or LCS_WITH_ANSWER of it at a cosine of PARAPHRASE_COSINE or more while the
   answer (the ``answer`` column, else the passage's last ANSWER_WORDS words) is found
   as well, which catches paraphrases.

The benchmark is a stated query set: it is taken in blocks of at most ITEMS pieces
and ITEM_WORDS words, each a pass over the documents, so what is broadcast stays bounded. Documents
are never shuffled. Case (A-Z) and ASCII punctuation do not count.

Defined results: null or empty texts and passages match nothing; repeated rows give
repeated pairs; no benchmark, no pairs.
"""

from __future__ import annotations

import string
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import col, prepare, slices, table, texts

BLOCK = 48
RANK = 256
OVERSAMPLE = 16
COSINE = 0.35
CONTAINED = 0.6
PARAPHRASE_COSINE = 0.45
COMMON_DF = 0.05
LCS_ALONE = 0.75
LCS_WITH_ANSWER = 0.5
ANSWER_FOUND = 0.75
ANSWER_WORDS = 8
ITEMS = RANK  # so that the space holds every passage exactly
ITEM_WORDS = 200_000
_PLAIN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_PLAIN).split()


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, one bit a word of ``a``."""
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = where.get(w)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def closest(a: list, region: list) -> tuple[int, list]:
    """The stretch of one and a half lengths of ``a`` in the region that shares the
    longest common subsequence with it (a longer one would share common words by
    chance), and that length."""
    size, step = len(a) + len(a) // 2 + 1, max(1, len(a) // 4)
    stretches = [region[i : i + size] for i in range(0, max(1, len(region) - size + step), step)]
    return max(((lcs(a, s), s) for s in stretches), key=lambda x: x[0])


def pieces(ws: list) -> list[tuple[int, list]]:
    """(place in the passage, words) of what a passage is retrieved by."""
    if len(ws) <= 2 * BLOCK:
        return [(0, ws)]
    starts = [*range(0, len(ws) - BLOCK, BLOCK // 2), len(ws) - BLOCK]
    return [(i, ws[i : i + BLOCK]) for i in starts]


def _flat(raw: list[bytes], vocab: dict[bytes, int]):
    """(words per text, term id or -1 of every word, block number of every word,
    first block of each text)."""
    lists = [words_of(t) for t in raw]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    terms = np.concatenate([np.fromiter(map(vocab.get, ws, repeat(-1)), np.int32, len(ws)) for ws in lists]) if lists else np.zeros(0, np.int32)
    blocks = -(-sizes // BLOCK)
    first = np.concatenate(([0], np.cumsum(blocks)))
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(terms)) - np.repeat(starts, sizes)
    return lists, terms, np.repeat(first[:-1], sizes) + place // BLOCK, first


def frequencies(docs: DataFrame, vocab: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """(number of blocks, blocks with each term) over all documents."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocab)
    n_terms = len(vocab)

    def run(batches):
        vocab, total, df = shared.value, 0, np.zeros(n_terms, np.int64)
        for b in slices(batches):
            _, terms, block, first = _flat(texts(b), vocab)
            hit = np.flatnonzero(terms >= 0)
            pairs = np.unique(block[hit] * np.int64(n_terms) + terms[hit])
            df += np.bincount(pairs % n_terms, minlength=n_terms)
            total += int(first[-1])
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": [-1, *at.tolist()], "n": [total, *df[at].tolist()]}, schema=pa.schema([("term", pa.int64()), ("n", pa.int64())]))

    out, total = np.zeros(n_terms, np.int64), 0
    for r in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r.term < 0:
            total = r.n
        else:
            out[r.term] = r.n
    return total, out


def _tfidf(ws: list[bytes], vocab: dict[bytes, int], idf: np.ndarray) -> np.ndarray:
    v = np.zeros(len(idf))
    at = [vocab[w] for w in set(ws) if w in vocab]
    v[at] = idf[at]
    return v / (np.linalg.norm(v) or 1.0)


def _summed(passages: DataFrame, shared, vector_rows) -> np.ndarray:
    """Sum over all partitions of the matrix ``vector_rows(batch rows)`` gives."""
    schema = pa.schema([("row", pa.int64()), ("v", pa.list_(pa.float64()))])

    def run(batches):
        total = None
        for b in batches:
            m = vector_rows(texts(b), shared.value)
            total = m if total is None else total + m
        if total is not None:
            at = np.flatnonzero(np.abs(total).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at].tolist(), schema.field("v").type)], schema=schema)

    parts = passages.select("text").mapInArrow(run, "row long, v array<double>")
    cells = parts.select("row", F.posexplode("v").alias("j", "x")).groupBy("row", "j").agg(F.sum("x").alias("x"))
    rows = cells.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("v")).select("row", F.transform("v", lambda c: c["x"]).alias("v")).collect()
    return {r.row: r.v for r in rows}


def latent_space(passages: DataFrame, vocab: dict[bytes, int], idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """terms x rank: the leading right singular vectors of the TF-IDF passages."""
    sc = passages.sparkSession.sparkContext
    width = min(rank + OVERSAMPLE, len(vocab))
    gauss = np.random.default_rng(7).standard_normal((len(vocab), width))

    def assemble(found: dict, height: int) -> np.ndarray:
        m = np.zeros((height, width))
        for i, v in found.items():
            m[i] = v
        return m

    def sketch(raw, model):
        vocab, idf, basis = model
        a = np.array([_tfidf(words_of(t), vocab, idf) for t in raw])
        return a.T @ (a @ basis)

    def gram(raw, model):
        vocab, idf, basis = model
        p = np.array([_tfidf(words_of(t), vocab, idf) for t in raw]) @ basis
        return p.T @ p

    z = assemble(_summed(passages, sc.broadcast((vocab, idf, gauss)), sketch), len(vocab))
    q, _ = np.linalg.qr(z)
    values, turn = np.linalg.eigh(assemble(_summed(passages, sc.broadcast((vocab, idf, q)), gram), width))
    order = np.argsort(-values)[:rank]
    return q @ turn[:, order[values[order] > 1e-9]]


class Matcher:
    """Candidate search and checks for one block of the benchmark."""

    def __init__(self, items: list[tuple], vocab: dict[bytes, int], idf: np.ndarray, space: np.ndarray):
        self.ids = [i for i, _, _ in items]
        self.words = [words_of(t) for _, t, _ in items]
        self.answers = [words_of(a) if a else w[-ANSWER_WORDS:] for (_, _, a), w in zip(items, self.words)]
        self.vocab = vocab
        self.terms = (idf[:, None] * space).astype(np.float32)
        self.squares = idf**2
        self.active = idf >= -np.log(COMMON_DF)
        cuts = [(k, i, piece) for k, ws in enumerate(self.words) for i, piece in pieces(ws)]
        self.item_of, self.offset = [k for k, _, _ in cuts], [i for _, i, _ in cuts]
        self.sets = [set(piece) for _, _, piece in cuts]
        sets = [np.array([vocab[w] for w in ws]) for ws in self.sets]
        self.length = np.array([np.sqrt(self.squares[at].sum()) for at in sets])

        left_out = np.array([np.sqrt(self.squares[at[~self.active[at]]].sum()) for at in sets]) / np.maximum(self.length, 1e-12)
        self.limit = COSINE - left_out
        self.share = CONTAINED - left_out**2 - 1e-4  # the product is in single precision
        lat = np.array([self.terms[at].sum(0) for at in sets])
        norm = np.linalg.norm(lat, axis=1, keepdims=True)
        self.items = (lat / np.where(norm > 1e-9, norm, np.inf)).astype(np.float32)

    def find(self, raw: list[bytes]) -> list[dict[int, tuple[float, float, bool]]]:
        """For each text {item index: (cosine, common share, answer found)}, leaks only."""
        lists, terms, block, first = _flat(raw, self.vocab)
        n_blocks = int(first[-1])
        out: list[dict] = [{} for _ in raw]
        hit = np.flatnonzero(terms >= 0)
        if not len(hit):
            return out
        width = len(self.terms)
        pairs = np.unique(block[hit] * np.int64(width) + terms[hit])  # a term counts once a block
        square = np.append(np.bincount(pairs // width, weights=self.squares[pairs % width], minlength=n_blocks), 0.0)
        pairs = pairs[self.active[pairs % width]]
        vec = np.zeros((n_blocks + 1, self.terms.shape[1]), np.float32)
        at, lo = np.unique(pairs // width, return_index=True)
        step = 1 << 16  # hits gathered at once
        ends = np.append(lo[1:], len(pairs))
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(ends, lo[i] + step, side="right")))
            part = self.terms[pairs[lo[i] : ends[j - 1]] % width]
            vec[at[i:j]] = np.add.reduceat(part, lo[i:j] - lo[i], axis=0)
            i = j
        text_of = np.repeat(np.arange(len(raw)), np.diff(first))
        same = np.append(text_of[1:] == text_of[:-1], False)
        window = vec[:-1] + vec[1:] * same[:, None]
        norm = np.sqrt(square[:-1] + square[1:] * same)[:, None]
        product = window @ self.items.T
        near_enough = (product >= self.limit * norm) & (norm > 1e-9) | (product >= self.share * self.length) & (product > 0)
        checked: dict = {}
        for w, piece in np.argwhere(near_enough):
            d, item = int(text_of[w]), self.item_of[piece]
            mine, ws = self.words[item], lists[d]
            begin = int(w - first[d]) * BLOCK
            weight = float(self.squares[[self.vocab[x] for x in self.sets[piece].intersection(ws[begin : begin + 2 * BLOCK])]].sum())
            cosine = weight / max(norm[w, 0] * self.length[piece], 1e-12)
            if cosine < COSINE and weight < CONTAINED * self.length[piece] ** 2:
                continue
            # pieces that put the passage at the same place of the text have one check,
            # whose region holds that place whichever of them comes first
            place = (d, item, (begin - self.offset[piece]) // BLOCK)
            if place not in checked:
                checked[place] = closest(mine, ws[max(0, begin - len(mine)) : begin + 2 * BLOCK + len(mine)])
            common, near = checked[place]
            share = common / len(mine)
            if share < LCS_WITH_ANSWER:
                continue
            answer = self.answers[item]
            found = bool(answer) and lcs(answer, near) >= ANSWER_FOUND * len(answer)
            if share >= LCS_ALONE or (found and cosine >= PARAPHRASE_COSINE):
                out[d][item] = max(out[d].get(item, (0.0, 0.0, False)), (cosine, share, found), key=lambda x: (x[1], x[2], x[0]))
        return out


def matchers(docs: DataFrame, benchmark: DataFrame):
    """One matcher a block of the benchmark."""
    prepare(docs.sparkSession)
    has_answer = "answer" in benchmark.columns
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text"), (F.col("answer").cast("string") if has_answer else F.lit(None).cast("string")).alias("answer")).where("text is not null").orderBy("item_id")
    block, size, n_pieces = [], 0, 0

    def build(items):
        vocab: dict[bytes, int] = {}
        for _, t, _ in items:
            for w in words_of(t.encode()):
                vocab.setdefault(w, len(vocab))
        total, df = frequencies(docs, vocab)
        idf = np.log((total + 1) / (df + 1))
        cuts = [(b" ".join(piece).decode(),) for _, t, _ in items for _, piece in pieces(words_of(t.encode()))]
        passages = docs.sparkSession.createDataFrame(cuts, "text string")
        return Matcher([(i, t.encode(), (a or "").encode()) for i, t, a in items], vocab, idf, latent_space(passages, vocab, idf, len(cuts)))

    for r in rows.toLocalIterator():
        ws = words_of(r.text.encode())
        n, k = len(ws), len(pieces(ws))
        if not n:
            continue
        if block and (size + n > ITEM_WORDS or n_pieces + k > ITEMS):
            yield build(block)
            block, size, n_pieces = [], 0, 0
        block.append((r.item_id, r.text, r.answer))
        size, n_pieces = size + n, n_pieces + k
    if block:
        yield build(block)


PAIRS = "doc_id long, item_id long, cosine double, common_share double, answer_found boolean"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark passage that it leaks."""
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("common_share", pa.float64()), ("answer_found", pa.bool_())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], PAIRS)
    for matcher in matchers(docs, benchmark):
        shared = spark.sparkContext.broadcast(matcher)

        def run(batches, shared=shared):
            m = shared.value
            for b in slices(batches, max_bytes=2 << 20):
                got = [(i, m.ids[k], *v) for i, found in zip(col(b, "doc_id").to_pylist(), m.find(texts(b))) for k, v in sorted(found.items())]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*got), schema)], schema=schema)

        out = out.unionByName(rows.mapInArrow(run, PAIRS))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no benchmark passage, all columns as they are."""
    spark = docs.sparkSession
    for matcher in matchers(docs, benchmark):
        shared = spark.sparkContext.broadcast(matcher)

        def run(batches, shared=shared):
            for b in slices(batches, max_bytes=2 << 20):
                yield b.filter(pa.array([not found for found in shared.value.find(texts(b))]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
