"""Toxicity (operator 5): a linear-chain CRF over the words of a text.

Two states (clean, toxic); a word's emission is the sum of the hashed weights of its
byte n-grams and of the word itself, transitions are learned. Document labels become
token labels by the n-grams and words that appear in toxic documents and (nearly) never
in clean ones, at counts where chance explains few of them (:func:`tied`); the CRF is
then trained on those tagged tokens by gradient steps on its exact likelihood, in one
task on the bounded sample. Scoring runs forward-backward over
every whole text and aggregates the marginals: the odds of one toxic word
and of two different ones, calibrated to a probability. Words with a marginal of 0.5 or more are the
offending spans, given with code point offsets into the original text.

Defined results: a null or empty text scores like a text without toxic words and
has no span; without a toxic and a clean training row every score is 0.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import bounded_sample, byte_buffer, col, fold, prepare, slices, table, texts

#: Bounded training sample: at most so many labelled documents of each class, of at
#: most so many characters each.
SAMPLE = {0: 1200, 1: 600}
SAMPLE_CHARS = 8_000
GRAMS = (3, 4, 6, 8)
#: Of the features taken as toxic at one count, chance explains at most this share.
FALSE_SHARE = 0.2
BITS = 21
EPOCHS = 30
FOLDS = 3
BACKGROUND = 0.1
#: L2 weight for each toxic text of the sample, and the least one.
L2 = 0.12
L2_LEAST = 3.0
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def grams_by_length(words: list[bytes]):
    """(word index, feature index) of the whole words, then of every byte n-gram of
    every word, one n-gram length at a time; a word's edges count as a character."""
    if not words:
        return
    whole = pd.util.hash_array(np.array(words, object), categorize=False)
    yield np.arange(len(words)), (whole >> np.uint64(64 - BITS)).astype(np.int32)
    buf = byte_buffer(words)
    space = buf == 32
    before = np.concatenate(([0], np.cumsum(space, dtype=np.int32)))
    owner = before[1:] - 1
    h = np.zeros(len(buf), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        size = len(buf) - n + 1
        if size <= 0:
            return
        h = h[:size]
        h *= np.uint64(0x100000001B3)
        h += buf[n - 1 :]
        h += np.uint64(1)
        if n in GRAMS:
            at = np.flatnonzero(before[n - 1 : n - 1 + size] == before[1 : 1 + size])  # no edge inside
            yield owner[at], (((h[at] + np.uint64(n)) * _MULT) >> np.uint64(64 - BITS)).astype(np.int32)


def emissions(n_words: int, grams, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each word's n-grams, one n-gram length at a time."""
    out = np.zeros(n_words)
    for w, f in grams:
        out += np.bincount(w, weights=weights[f], minlength=n_words)[:n_words]
    return out


def tokenise(batch_texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(word ids in text order, distinct words, words per text), lower-cased."""
    lists = [t.decode("utf-8", "replace").lower().encode().split() for t in batch_texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for ws in lists for w in ws]
    ids, uniques = pd.factorize(flat)
    return ids, list(uniques), sizes


class Chain:
    """Sequences laid out by step: the words at step t of all texts with more than
    t words lie together, longest text first, so one step is one array operation."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        lengths = sizes[self.order]
        steps = int(lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-lengths, -np.arange(steps), side="left")
        self.off = np.concatenate(([0], np.cumsum(self.active)))
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        rank = np.empty(len(sizes), np.int64)
        rank[self.order] = np.arange(len(sizes))
        step = np.arange(int(sizes.sum())) - starts[doc]
        self.place = self.off[step] + rank[doc]  # text order -> step order
        self.doc = doc

    def marginals(self, e: np.ndarray, trans: np.ndarray, start: float):
        """P(toxic) of each word, and the normalised forward and backward pairs."""
        psi = np.empty(len(e))
        psi[self.place] = np.exp(np.clip(e, -30, 30))
        t00, t01, t10, t11 = np.exp(trans).ravel()
        fwd, bwd = np.empty(len(e)), np.empty(len(e))  # P(state 1) and its odds-free backward share
        p = None
        for t, n in enumerate(self.active):
            lo = self.off[t]
            s = psi[lo : lo + n]
            if t == 0:
                a1, a0 = s * np.exp(start), 1.0
            else:
                q = p[:n]
                a1, a0 = s * ((1 - q) * t01 + q * t11), (1 - q) * t00 + q * t10
            p = a1 / (a0 + a1)
            fwd[lo : lo + n] = p
        steps = len(self.active)
        b = np.zeros(0)
        for t in range(steps - 1, -1, -1):
            n, lo = self.active[t], self.off[t]
            now = np.full(n, 0.5)
            if t + 1 < steps and (m := self.active[t + 1]):
                s1 = psi[self.off[t + 1] : self.off[t + 1] + m] * b
                s0 = 1 - b
                b1, b0 = t10 * s0 + t11 * s1, t00 * s0 + t01 * s1
                now[:m] = b1 / (b0 + b1)
            b = now
            bwd[lo : lo + n] = b
        post = fwd * bwd / (fwd * bwd + (1 - fwd) * (1 - bwd))
        return post, fwd, bwd, psi


def distinct_rows(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Without copies and near copies: a text that shares three of its eight least
    hashes of long words with an earlier one says nothing new about the labels."""
    seen, out = {}, []
    for text, label in sample:
        least = sorted(zlib.crc32(w) for w in set((text or "").encode().split()) if len(w) > 5)[:8]
        earlier = [seen[h] for h in least if h in seen]
        if least and max((earlier.count(d) for d in set(earlier)), default=0) >= 3:
            continue
        for h in least:
            seen.setdefault(h, len(out))
        out.append((text, label))
    return out


def tied(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Which features are tied to toxic documents, from the documents of each kind that
    hold them. A feature is pure if at least 98 of 100 are toxic. The pure features with
    a total of t documents are taken if chance explains few of them: of all features
    with that total, a share of at most exp(-llr / 2) (``share`` to the power t, without
    a clean document) is pure by chance. So the limit follows the number of labels and
    of features, and the clean documents alone decide how low it goes."""
    total = toxic + clean
    size = int(total.max(initial=0)) + 1
    pure = (total > 0) & (toxic >= 0.98 * total)
    t = np.arange(1, size)
    spare = np.floor(0.02 * t)  # clean documents that a pure feature may have
    a = t - spare
    llr = a * np.log(a / (t * share)) + np.where(spare > 0, spare * np.log(np.maximum(spare, 1) / (t * (1 - share))), 0)
    chance = np.where(a > t * share, np.exp(-llr), 1.0) * np.bincount(total.astype(np.int64), minlength=size)[1:]
    found = np.bincount(total[pure].astype(np.int64), minlength=size)[1:]
    good = np.concatenate(([False], (found > 0) & (chance <= FALSE_SHARE * found)))
    return pure & good[total.astype(np.int64)]


def token_labels(ids, n_words, grams, doc, toxic_doc) -> np.ndarray:
    """1 for words of toxic documents that are, or hold, a feature :func:`tied` to them;
    every length of n-grams is judged by itself."""
    pairs = np.unique(doc * np.int64(n_words) + ids)
    p_doc, p_word = pairs // n_words, pairs % n_words
    edges = np.searchsorted(p_doc, np.arange(len(toxic_doc) + 1))
    word_bad = np.zeros(n_words, bool)
    for w, f in grams:  # one n-gram length at a time; words lie in order
        first = np.searchsorted(w, np.arange(n_words + 1))
        g1, g0 = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
        for d in range(len(toxic_doc)):
            mine = p_word[edges[d] : edges[d + 1]]
            if len(mine):
                (g1 if toxic_doc[d] else g0)[np.concatenate([f[first[x] : first[x + 1]] for x in mine])] += 1
        word_bad[w[tied(g1, g0, toxic_doc.mean())[f]]] = True
    return (word_bad[ids] & (toxic_doc[doc] > 0)).astype(float)


def train(sample: list[tuple[str, int]]) -> dict | None:
    """Fit on (text, toxic) rows: Adam on the CRF's likelihood with an L2 term. The
    verdict over a text's words is calibrated on texts that the chain did not see (each
    fold scored by a chain of the others), so that words which clean texts can hold by
    chance do not count as they do in the texts that named them."""
    sample = distinct_rows(sample)
    model = fit_chain(sample)
    if model is None:
        return None
    turn = [zlib.crc32((text or "").encode()) % FOLDS for text, _ in sample]
    evidence, truth = [], []
    for k in range(FOLDS):
        other = fit_chain([r for r, t in zip(sample, turn) if t != k])
        mine = [r for r, t in zip(sample, turn) if t == k]
        if other is not None and mine:
            evidence.append(evidence_of([(text or "").encode() for text, _ in mine], other)[0])
            truth += [1.0 * (label == 1) for _, label in mine]
    if not evidence or min(truth) == max(truth):  # too few rows to hold some out
        evidence = [evidence_of([(text or "").encode() for text, _ in sample], model)[0]]
        truth = [1.0 * (label == 1) for _, label in sample]
    return model | {"verdict": calibrate(np.concatenate(evidence), np.array(truth))}


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (none negative) of the evidence and an intercept: logistic regression by
    Newton steps. A weight that turns negative is 0 from then on."""
    x = np.column_stack([x, np.ones(len(x))])
    w, free = np.zeros(x.shape[1]), np.ones(x.shape[1], bool)
    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ w)))
        v = p * (1 - p) / len(x) + 1e-9
        h = (x * v[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(h[np.ix_(free, free)], (x.T @ ((y - p) / len(x)) - 1e-3 * w)[free])
        w += np.clip(step, -0.5, 0.5)
        below = (w < 0) & (np.arange(len(w)) < len(w) - 1)
        w[below], free[below] = 0.0, False
    return w


def fit_chain(sample: list[tuple[str, int]]) -> dict | None:
    """The CRF of (text, toxic) rows; None without a row of each kind or without words."""
    y_doc = np.array([1.0 * (t == 1) for _, t in sample])
    if not len(sample) or y_doc.min() == y_doc.max():
        return None
    ids, words, sizes = tokenise([(t or "").encode() for t, _ in sample])
    if not len(ids):
        return None
    chain = Chain(sizes)
    grams, n_words = list(grams_by_length(words)), len(words)
    del words
    y = token_labels(ids, n_words, grams, chain.doc, y_doc)
    l2 = np.float32(max(L2_LEAST, L2 * y_doc.sum()))
    weights, trans = np.zeros(1 << BITS, np.float32), np.zeros((2, 2))
    bias, start = -4.0, 0.0
    m1, m2 = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    gold_place = np.empty(len(y))
    gold_place[chain.place] = y
    later = np.arange(chain.off[1] if len(chain.off) > 1 else 0, len(y))
    step_of = np.repeat(np.arange(len(chain.active)), chain.active)
    prev = later - chain.active[step_of[later] - 1]
    for it in range(1, EPOCHS + 1):
        word_e = emissions(n_words, grams, weights) + bias
        post, fwd, bwd, psi = chain.marginals(word_e[ids], trans, start)
        miss = gold_place - post
        by_word = np.bincount(ids, weights=miss[chain.place], minlength=n_words)
        g = -l2 * weights
        for w, f in grams:
            g += np.bincount(f, weights=by_word[w], minlength=1 << BITS).astype(np.float32)
        m1 += 0.1 * (g - m1)
        m2 += 0.01 * (g * g - m2)
        weights += 0.15 / (1 - 0.9**it) * m1 / (np.sqrt(m2 / (1 - 0.99**it)) + 1e-3)
        a, s, b = fwd[prev], psi[later], bwd[later]
        x = np.exp(trans)
        xi = np.stack([(1 - a) * (1 - b) * x[0, 0], (1 - a) * s * b * x[0, 1], a * (1 - b) * x[1, 0], a * s * b * x[1, 1]])
        xi /= xi.sum(0)
        seen = np.bincount((2 * gold_place[prev] + gold_place[later]).astype(int), minlength=4)
        trans += (0.5 * (seen - xi.sum(1)) / (np.maximum(seen, xi.sum(1)) + 10)).reshape(2, 2)
        bias += 0.3 * miss.sum() / (y.sum() + post.sum() + 10)
    return {"weights": weights, "trans": trans, "bias": float(bias), "start": float(start)}


def doc_evidence(post: np.ndarray, doc: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Two log-odds a text, within -12 and 12: that it holds a toxic word, and that it
    holds two different ones, each word by its largest marginal. The background of
    marginals under BACKGROUND is left out: over thousands of words it would add up to a
    toxic verdict that no word supports."""
    at = np.flatnonzero(post >= BACKGROUND)
    at = at[np.lexsort((-post[at], ids[at], doc[at]))]
    first = np.ones(len(at), bool)
    first[1:] = (doc[at[1:]] != doc[at[:-1]]) | (ids[at[1:]] != ids[at[:-1]])
    at = at[first]
    p = np.minimum(post[at], 1 - 1e-9)
    none = np.exp(np.bincount(doc[at], weights=np.log1p(-p), minlength=n))
    one = none * np.bincount(doc[at], weights=p / (1 - p), minlength=n)
    odds = lambda miss: np.clip(np.log(np.maximum(1 - miss, 1e-12)) - np.log(np.maximum(miss, 1e-12)), -12, 12)
    return np.column_stack([odds(none), odds(none + one)])


def evidence_of(batch_texts: list[bytes], model: dict) -> tuple[np.ndarray, np.ndarray, Chain]:
    """Evidence of each text, and each word's marginal in text order."""
    ids, words, sizes = tokenise(batch_texts)
    chain = Chain(sizes)
    e = emissions(len(words), grams_by_length(words), model["weights"]) + model["bias"] if len(words) else np.zeros(0)
    post = chain.marginals(e[ids], model["trans"], model["start"])[0][chain.place] if len(ids) else np.zeros(0)
    return doc_evidence(post, chain.doc, ids, len(sizes)), post, chain


def score_texts(batch_texts: list[bytes], model: dict) -> tuple[np.ndarray, np.ndarray, Chain]:
    """Document scores, and each word's marginal in text order."""
    x, post, chain = evidence_of(batch_texts, model)
    w = model["verdict"]
    return 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))), post, chain


def fit(docs: DataFrame, labels: DataFrame, held_out_mod: int | None = 5) -> dict | None:
    """Train on a bounded sample of the labelled documents outside the held-out
    fold. The sample holds whole texts; only ids travel until it is chosen. One task
    fits the model (its input is the size of SAMPLE at most); the driver gets weights."""
    prepare(docs.sparkSession)
    seen = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if held_out_mod:
        seen = seen.where(fold(F.col("doc_id"), held_out_mod) != 0)
    seen = seen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = docs.where(F.length("text").between(1, SAMPLE_CHARS)).select("doc_id")
    chosen = bounded_sample(seen.join(short, "doc_id", "left_semi"), "toxic", SAMPLE, 5)
    ids = {r.doc_id: r.toxic for r in chosen.collect()}  # the size of SAMPLE at most
    if not ids:
        return None
    rows = docs.where(F.col("doc_id").isin(list(ids))).where(F.length("text").between(1, SAMPLE_CHARS)).groupBy("doc_id").agg(F.min("text").alias("text"))

    def run(batches):
        sample = [(text, ids[i]) for b in batches for i, text in zip(col(b, "doc_id").to_pylist(), col(b, "text").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(sorted(sample)))], pa.binary())], names=["model"])

    return pickle.loads(rows.repartition(1).mapInArrow(run, "model binary").first().model)


OUT = "doc_id long, held_out boolean, score double, predicted int, n_spans int, spans array<struct<begin:int,end:int,text:string>>"


def score(docs: DataFrame, model: dict | None, held_out_mod: int = 5, spans: bool = True) -> DataFrame:
    """Score and spans of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # 8 MB of weights at any input size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold(F.col("doc_id"), held_out_mod) == 0).alias("held_out"))

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_spans", pa.int32()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("text", pa.string())])))])

    def run(batches):
        model = shared.value
        for b in slices(batches):
            raw = texts(b)
            if model is None:
                s, found = np.zeros(len(raw)), [[]] * len(raw)
            else:
                s, post, chain = score_texts(raw, model)
                found = [[] for _ in raw]
                hot = np.flatnonzero(post >= 0.5)
                starts = np.searchsorted(chain.doc, np.arange(len(raw)))
                for d in np.unique(chain.doc[hot]):
                    words = list(_WORD.finditer(raw[d].decode("utf-8", "replace")))
                    at = hot[chain.doc[hot] == d] - starts[d]
                    found[d] = [{"begin": words[i].start(), "end": words[i].end(), "text": words[i].group()} for i in at if i < len(words)]
            n = [len(x) for x in found]
            yield pa.RecordBatch.from_arrays([col(b, "doc_id"), col(b, "held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(n, pa.int32()), pa.array(found if spans else [[]] * len(n), schema.field("spans").type)], schema=schema)

    return rows.mapInArrow(run, OUT)


def without_toxic(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of ``docs`` not predicted toxic, all columns as they are."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in slices(batches):
            yield b if model is None else b.filter(pa.array(score_texts(texts(b), model)[0] < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
