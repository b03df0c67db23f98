"""Quality rules (operator 2): base rules plus gradient-boosted trees.

Statistics of every whole text are exact: words, their code points, symbols, repeated
lines, and words inside 5-word windows that the text holds twice or more (windows are
compared through exact ids of ever longer runs, no hashes). Trees are boosted on
logistic loss over binned statistics; on the features of MONOTONE a split is allowed
only if more of the statistic lowers the verdict, and children inherit bounds, so the
whole model is monotonic in them. The trees are flattened into numpy node arrays and
scored one level at a time for all rows of a slice.

Training data: labels of at most TRAIN_PER_CLASS documents of each quality.

Defined results: a null or empty text has no words and fails the base rules; without
both classes among the labels, every text that passes the base rules is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import bounded_sample, col, prepare, slices, table, texts

TRAIN_PER_CLASS = 3000
TREES, DEPTH, RATE, BINS, LAMBDA = 40, 3, 0.25, 32, 5.0
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "mark_share", "line_words")
#: Features of which more never raises the verdict.
MONOTONE = ("symbol_share", "dup_line_share", "repeat_share")


def _bytes_in(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SPACE = _bytes_in(b" \t\n\x0b\x0c\r")
_SYMBOL = _bytes_in(b"#*$%&|<>")
_UPPER = _bytes_in(bytes(range(65, 91)))
_DIGIT = _bytes_in(b"0123456789")
_MARK = _bytes_in(b"!?;:()[]{}\"'-_/\\=+~^@")


def _per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[edges[1:]] - total[edges[:-1]]


def repeated_words(ids: np.ndarray, doc: np.ndarray, n_docs: int, width: int = WINDOW) -> np.ndarray:
    """Words of each text inside a ``width``-word window that the text holds twice."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    run, size = ids.astype(np.int64), 1
    while size < width:  # exact ids of runs of 2, 4, ... words, then of ``width``
        step = min(size, width - size)
        run = pd.factorize(run[: len(run) - step] * np.int64(len(ids) + 1) + run[step:])[0]
        size += step
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    which = pd.factorize(run[at] * np.int64(n_docs) + doc[at])[0]
    twice = at[np.bincount(which, minlength=1)[which] > 1]
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + width, -1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n_docs)


def statistics(raw: list[bytes]) -> dict[str, np.ndarray]:
    lists = [t.split() for t in raw]
    n_words = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.empty(int(n_words.sum()), object)
    flat[:] = [w for ws in lists for w in ws]
    ids = pd.factorize(flat)[0].astype(np.int64)
    doc = np.repeat(np.arange(len(raw)), n_words)
    edges = np.concatenate(([0], np.cumsum([len(t) for t in raw], dtype=np.int64)))
    buf = np.frombuffer(b"".join(raw), np.uint8)
    dup, lines = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
    for i, t in enumerate(raw):
        full = [x for x in t.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        lines[i] = len(full)
        dup[i] = len(full) - len(set(full))
    pairs = pd.factorize(doc * np.int64(len(ids) + 1) + ids)[1]
    return {
        "n_words": n_words,
        "word_chars": _per_text(((buf & 0xC0) != 0x80) & ~_SPACE[buf], edges),
        "n_symbols": _per_text(_SYMBOL[buf], edges),
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(ids, doc, len(raw)),
        "n_lines": lines,
        "n_distinct": np.bincount(pairs // (len(ids) + 1), minlength=len(raw)),
        "n_upper": _per_text(_UPPER[buf], edges),
        "n_digits": _per_text(_DIGIT[buf], edges),
        "n_marks": _per_text(_MARK[buf], edges),
    }


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.column_stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / chars, s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
        s["n_repeat_words"] / words, s["n_distinct"] / words, s["n_upper"] / chars, s["n_digits"] / chars, s["n_marks"] / chars, s["n_words"] / np.maximum(s["n_lines"], 1),
    ])


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


class Trees:
    """Boosted trees as node arrays: feature (-1 at a leaf), threshold, left child
    (the right one follows it) and value."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.feature, self.threshold, self.left, self.value, self.roots = [], [], [], [], []
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
        sign = [-1 if name in MONOTONE else 0 for name in FEATURES]
        self.start = float(np.log(y.mean() / (1 - y.mean())))
        f = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            self.roots.append(self._new())
            self._grow(self.roots[-1], np.arange(len(y)), 0, -np.inf, np.inf, g, h, binned, cuts, sign)
            self._freeze()
            f = self.start + self.raw(x)
        self._freeze()

    def _new(self) -> int:
        for a, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, 0), (self.value, 0.0)):
            a.append(v)
        return len(self.feature) - 1

    def _grow(self, node, rows, depth, low, high, g, h, binned, cuts, sign):
        gs, hs = g[rows].sum(), h[rows].sum()
        self.value[node] = RATE * float(np.clip(gs / (hs + LAMBDA), low, high))
        if depth == DEPTH or len(rows) < 20:
            return
        best = (1e-6, None)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            gb = np.cumsum(np.bincount(binned[rows, j], weights=g[rows], minlength=len(c) + 1))[:-1]
            hb = np.cumsum(np.bincount(binned[rows, j], weights=h[rows], minlength=len(c) + 1))[:-1]
            lv = np.clip(gb / (hb + LAMBDA), low, high)
            rv = np.clip((gs - gb) / (hs - hb + LAMBDA), low, high)
            gain = gb * gb / (hb + LAMBDA) + (gs - gb) ** 2 / (hs - hb + LAMBDA) - gs * gs / (hs + LAMBDA)
            ok = (hb > 1) & (hs - hb > 1) & ((rv <= lv) if sign[j] < 0 else True)
            k = int(np.where(ok, gain, -1).argmax())
            if ok[k] and gain[k] > best[0]:
                best = (gain[k], (j, k, lv[k], rv[k]))
        if best[1] is None:
            return
        j, k, lv, rv = best[1]
        mid = (lv + rv) / 2
        bounds = ((mid, high), (low, mid)) if sign[j] < 0 else ((low, high), (low, high))
        left = self._new()
        self._new()
        self.feature[node], self.threshold[node], self.left[node] = j, float(cuts[j][k]), left
        goes = binned[rows, j] <= k
        self._grow(left, rows[goes], depth + 1, *bounds[0], g, h, binned, cuts, sign)
        self._grow(left + 1, rows[~goes], depth + 1, *bounds[1], g, h, binned, cuts, sign)

    def _freeze(self) -> None:
        self.arrays = tuple(np.array(a) for a in (self.feature, self.threshold, self.left, self.value))

    def raw(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, value = self.arrays
        node = np.tile(np.array(self.roots), (len(x), 1))  # rows x trees
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            j = feature[node]
            right = x[rows, np.maximum(j, 0)] > threshold[node]
            node = np.where(j >= 0, left[node] + right, node)
        return value[node].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.start + self.raw(x))))


def fit(docs: DataFrame, labels: DataFrame) -> Trees | None:
    prepare(docs.sparkSession)
    seen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = bounded_sample(seen, "quality", {0: TRAIN_PER_CLASS, 1: TRAIN_PER_CLASS}, 2)  # 2 x TRAIN_PER_CLASS at most
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        for b in slices(batches):
            x = features(statistics(texts(b)))
            yield pa.RecordBatch.from_arrays([col(b, "doc_id").cast(pa.int64()), col(b, "quality").cast(pa.int32()), pa.array(list(x), schema.field("x").type)], schema=schema)

    got = sorted((r.doc_id, r.quality, r.x) for r in rows.mapInArrow(run, "doc_id long, quality int, x array<double>").collect())
    y = np.array([q for _, q, _ in got], float)
    return Trees(np.array([x for _, _, x in got]), y) if len(y) and y.min() < y.max() else None


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: Trees | None) -> DataFrame:
    """The statistics, base verdict and verdict of every row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # TREES x 2^(DEPTH + 1) nodes at most
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])

    def run(batches):
        model = shared.value
        for b in slices(batches):
            s = statistics(texts(b))
            failed = base_failed(s)
            score = np.ones(len(failed)) if model is None else model.score(features(s))
            yield pa.RecordBatch.from_arrays([col(b, "doc_id"), *[pa.array(s[c], pa.int64()) for c in COUNTS], pa.array(failed), pa.array(~failed & (score >= 0.5)), pa.array(score)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
