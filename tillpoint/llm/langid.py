"""Language identification (operator 1) with a blended-spectrum string kernel.

The kernel of two texts is the number of character n-grams (n = 1 to 3, hashed to
``1 << BITS`` values) present in both, normalised to 1 on the diagonal. Landmarks (a
fixed number of training texts a language) give a Nyström feature map K_mm^(-1/2) k;
one-versus-rest kernel ridge regression is solved on it in closed form. A text's
n-gram presence rows, restricted to n-grams that landmarks have, times the landmark
matrix is its kernel row; times the folded Nyström and ridge weights its scores: two
matrix products a batch.

Training data: every learned language has its texts, at most TRAIN_PER_LANG of at most
TRAIN_CHARS characters (about TRAIN_TOTAL in all, with many languages fewer each, at
least two). A language with too few of them adds whole longer texts, at most
LONG_PER_LANG (about LONG_TOTAL in all, at least two). LANDMARKS texts a language are
landmarks, at most LANDMARKS_TOTAL in all, spread over the languages: the landmark
matrix has at most ``1 << BITS`` rows and LANDMARKS_TOTAL columns whatever the input
(some 10 MB for a few languages). The weights have one column a language.

Defined results: ``und`` and score 0 for a null text, a text without a letter, or
without training rows; a tie goes to the first language in code point order. Case,
digits and punctuation do not count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import col, fold, prepare, row_hash, slices, table, texts

GRAMS = (1, 2, 3)
BITS = 18
TRAIN_PER_LANG, TRAIN_TOTAL = 150, 6000
TRAIN_CHARS = 4000
LONG_PER_LANG, LONG_TOTAL = 20, 200
LANDMARKS, LANDMARKS_TOTAL = 32, 200
RIDGE = 1e-2
FEW_LANGS = 100_000  # up to so many learned values their counts are broadcast
_LETTER = regex.compile(r"\p{L}")
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def grams(text: str) -> np.ndarray:
    """Sorted distinct hashed n-grams of the text's letters, words apart."""
    plain = " " + _NOT_LETTERS.sub(" ", text.lower()) + " "
    c = np.frombuffer(plain.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    present = np.zeros(1 << BITS, bool)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :]
        if n in GRAMS:
            present[((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)] = True
    return np.flatnonzero(present)


class Classifier:
    """Landmark matrix and folded weights; built from (text grams, language) rows."""

    def __init__(self, rows: list[tuple[np.ndarray, str]]):
        self.langs = sorted({lang for _, lang in rows})
        per = {lang: [g for g, x in rows if x == lang] for lang in self.langs}
        each = max(1, min(LANDMARKS, LANDMARKS_TOTAL // len(self.langs)))
        marks = [g for lang in self.langs for g in per[lang][:each]]
        marks = marks[:: -(-len(marks) // LANDMARKS_TOTAL)]  # more languages than landmarks
        self.columns = np.full(1 << BITS, -1, np.int32)
        used = np.unique(np.concatenate(marks))
        self.columns[used] = np.arange(len(used))
        self.marks = np.zeros((len(used), len(marks)), np.float32)
        for j, g in enumerate(marks):
            self.marks[self.columns[g], j] = 1 / np.sqrt(len(g))
        kmm = self.kernel(marks).astype(np.float64)
        values, vectors = np.linalg.eigh((kmm + kmm.T) / 2)
        root = vectors / np.sqrt(np.maximum(values, 1e-6))
        phi = self.kernel([g for g, _ in rows]).astype(np.float64) @ root
        y = np.array([[1.0 if lang == x else 0.0 for x in self.langs] for _, lang in rows])
        n_of = np.array([len(per[lang]) for _, lang in rows], float)
        w = 1 / n_of  # each language weighs the same
        phi1 = np.hstack([phi, np.ones((len(phi), 1))])
        solved = np.linalg.solve(phi1.T @ (phi1 * w[:, None]) + RIDGE * np.eye(phi1.shape[1]), phi1.T @ (y * w[:, None]))
        self.weights = (root @ solved[:-1]).astype(np.float32)
        self.bias = solved[-1].astype(np.float32)

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel rows of the given n-gram sets against all landmarks."""
        rows = max(1, (8 << 20) // max(1, len(self.marks)))
        out = np.zeros((len(sets), self.marks.shape[1]), np.float32)
        for lo in range(0, len(sets), rows):
            part = sets[lo : lo + rows]
            x = np.zeros((len(part), len(self.marks)), np.float32)
            for i, g in enumerate(part):
                at = self.columns[g]
                x[i, at[at >= 0]] = 1 / np.sqrt(max(1, len(g)))
            out[lo : lo + rows] = x @ self.marks
        return out

    def predict(self, sets: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
        scores = self.kernel(sets) @ self.weights + self.bias
        best = scores.argmax(1)
        return [self.langs[i] for i in best], np.clip(scores[np.arange(len(best)), best], 0, 1)


def _sample(keys: DataFrame) -> DataFrame:
    """(doc_id, lang, long) of the training texts: the least hashes of each language.
    Rows that cannot be among them (by four times the expected hash) go before the
    window, so a frequent language is no large group."""
    sizes = keys.groupBy("lang").agg(F.count_if(~F.col("long")).alias("n_short"), F.count_if("long").alias("n_long"))
    n_langs = max(1, sizes.count())
    if n_langs <= FEW_LANGS:  # one short row a language; rows go before any shuffle
        sizes = F.broadcast(sizes)
    short, long = (max(2, min(a, b // n_langs)) for a, b in ((TRAIN_PER_LANG, TRAIN_TOTAL), (LONG_PER_LANG, LONG_TOTAL)))
    limit = F.when(~F.col("long"), short).when(F.col("n_short") < short, long).otherwise(0)
    share = (row_hash(F.col("doc_id"), 1).cast("double") + 2.0**63) / 2.0**64
    size = F.when(F.col("long"), F.col("n_long")).otherwise(F.col("n_short"))
    near = keys.join(sizes, "lang").withColumns({"limit": limit, "h": share}).where((F.col("limit") > 0) & (F.col("h") < (4.0 * F.col("limit") + 20) / size))
    order = Window.partitionBy("lang", "long").orderBy("h", "doc_id")
    return near.withColumn("r", F.row_number().over(order)).where("r <= limit").select("doc_id", "lang", "long").distinct()


def fit(docs: DataFrame, held_out_rest: int | None = 1) -> Classifier | None:
    """Train on a bounded sample of rows with a language outside the held-out fold."""
    prepare(docs.sparkSession)
    rows = docs.where("lang is not null").where(F.length("text") >= 1)
    if held_out_rest is not None:
        rows = rows.where(fold(F.col("doc_id"), 3) != held_out_rest)
    rows = rows.select("doc_id", "lang", F.col("text").cast("string").alias("text"), (F.length("text") > TRAIN_CHARS).alias("long"))
    sample = rows.join(F.broadcast(_sample(rows.drop("text"))), ["doc_id", "lang", "long"])
    sample = sample.select("lang", row_hash(F.col("doc_id"), 1).alias("h"), "text")
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("grams", pa.binary())])

    def run(batches):
        for b in batches:
            keep = [(lang, h, grams(t.decode("utf-8", "replace")).astype("<i4").tobytes()) for lang, h, t in zip(col(b, "lang").to_pylist(), col(b, "h").to_pylist(), texts(b)) if _LETTER.search(t.decode("utf-8", "replace"))]
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*keep), schema)], schema=schema)

    got = sample.mapInArrow(run, "lang string, h long, grams binary").distinct().collect()
    got = sorted({(r.lang, r.h, bytes(r.grams)) for r in got})
    return Classifier([(np.frombuffer(g, "<i4"), lang) for lang, _, g in got]) if got else None


def identify(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        model = shared.value
        for b in slices(batches, max_bytes=1 << 20):
            raw = [t.decode("utf-8", "replace") for t in texts(b)]
            at = [i for i, t in enumerate(raw) if _LETTER.search(t)] if model is not None else []
            lang, score = ["und"] * len(raw), np.zeros(len(raw))
            if at:
                names, s = model.predict([grams(raw[i]) for i in at])
                for i, name in zip(at, names):
                    lang[i] = name
                score[at] = s
            yield pa.RecordBatch.from_arrays([col(b, "doc_id"), col(b, "held_out"), pa.array(lang, pa.string()), pa.array(score)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, fit(docs))
