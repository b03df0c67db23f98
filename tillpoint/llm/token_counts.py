"""Token counts (operator 10) by dynamic programming shared along a trie.

A text's pre-tokens are its words, each with the vocabulary's word mark in front. A
pre-token's tokens are those of its best segmentation under a unigram model whose
piece probabilities follow the vocabulary's order (Zipf: the piece of rank r has
weight 1 / (r + 1)); a character that no piece covers costs its UTF-8 bytes as byte
tokens. Of equally likely segmentations the one with fewer tokens counts.

The distinct pre-tokens of a slice of texts are visited in sorted order, which walks
their trie depth first: the forward score of a prefix (best log probability and its
number of tokens) is computed once, however many pre-tokens share it, and each
pre-token's count is kept at its terminal. A bounded cache holds pre-tokens that come
again in later slices. Texts are never shuffled.

Defined results: a null or empty text has no word and no token.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import col, prepare, slices, table, texts

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
CACHE_WORDS = 400_000
#: Log probability of one byte token.
BYTE = -15.0


class Unigram:
    def __init__(self, pieces: list[str]):
        """``pieces`` in the vocabulary's order."""
        total = math.log(sum(1 / (r + 1) for r in range(len(pieces))) or 1.0)
        self.logp: dict[str, float] = {}
        for r, p in enumerate(pieces):
            self.logp.setdefault(p, -math.log(r + 1) - total)
        # lengths of the pieces that end in given two characters, to try only those
        ends: dict[str, set[int]] = {}
        for p in self.logp:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {k: tuple(sorted(v)) for k, v in ends.items()}

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of each of the distinct ``words`` (marks included)."""
        out = [0] * len(words)
        logp, lengths = self.logp, self.lengths
        best, tokens, before = [0.0], [0], ""
        for i in sorted(range(len(words)), key=words.__getitem__):
            w = words[i]
            shared = 0
            for a, b in zip(before, w):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for j in range(shared, len(w)):
                one = logp.get(w[j])
                if one is None:
                    n = len(w[j].encode("utf-8", "replace"))
                    top, least = best[j] + n * BYTE, tokens[j] + n
                else:
                    top, least = best[j] + one, tokens[j] + 1
                if j:
                    for size in lengths.get(w[j - 1 : j + 1], ()):
                        s = j + 1 - size
                        if s < 0:
                            break
                        p = logp.get(w[s : j + 1])
                        if p is not None:
                            p += best[s]
                            if p > top or (p == top and tokens[s] + 1 < least):
                                top, least = p, tokens[s] + 1
                best.append(top)
                tokens.append(least)
            out[i] = tokens[len(w)]
            before = w
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Unigram:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return Unigram([sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))])


_CACHE: dict[tuple[str, bytes], int] = {}


def word_counts(words: list[bytes], path: str) -> np.ndarray:
    if len(_CACHE) > CACHE_WORDS:
        _CACHE.clear()
    found = [_CACHE.get((path, w)) for w in words]
    missing = [i for i, x in enumerate(found) if x is None]
    for i, n in zip(missing, load(path).counts([MARK + words[i].decode("utf-8", "replace") for i in missing])):
        found[i] = _CACHE[path, words[i]] = n
    return np.array(found, np.int64)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    vocab = vocabulary or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        for b in slices(batches, max_bytes=8 << 20):
            lists = [t.split() for t in texts(b)]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.empty(int(sizes.sum()), object)
            flat[:] = [w for ws in lists for w in ws]
            ids, uniques = pd.factorize(flat)
            n = np.concatenate(([0], np.cumsum(word_counts(list(uniques), vocab)[ids]))) if len(ids) else np.zeros(1, np.int64)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([col(b, "doc_id"), pa.array(sizes), pa.array(n[ends] - n[ends - sizes])], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op10(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
