"""Phrase mining against plain counts."""

import collections
import random
import re

import numpy as np
import pytest

from tillpoint.llm import collocations

LOWER = {i: i + 32 for i in range(65, 91)}


def plain(rows, top=collocations.TOP):
    f = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    f[lang or "und"][tuple(w[i:i + size])] += 1
    out = []
    for lang, c in f.items():
        n, best = sum(v for p, v in c.items() if len(p) == 1), []
        for p, a in c.items():
            if len(p) == 1 or a < 10 or any(len(q) == 3 and p in (q[:2], q[1:]) and b >= 10 and 100 * b >= 50 * a for q, b in c.items() if len(p) == 2):
                continue
            s, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            best.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def sample():
    rnd = random.Random(4)
    vocab = [f"w{k}" for k in range(14)] + ["Été", "ÄB", "NEW", "york", " ", "a b"]
    rows = []
    for k in range(160):
        text = "".join(rnd.choice(vocab) + rnd.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ". "]) for _ in range(40))
        rows.append((text + " New York City " * (k % 3), rnd.choice(["en", "de", None])))
    return rows + [("x x x x x x x x x x x x x x", "en"), (None, "en"), ("", None), (" ,.; ", "de"), ("rare words here", "xx"), ("the end " * 3000, "fr"), ("tie one, tie two. " * 12, "it")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k % 9 else None, *r) for k, r in enumerate(sample())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS n", "'x' AS phrase", "3 AS shard").repartition(4)


def test_phrases_equal_plain_counts(docs):
    got = collocations.phrases(docs)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(sample())
    assert sorted(tuple(r) for r in got.collect()) == want
    assert {x[0] for x in want} >= {"en", "de", "und", "fr", "it"} and "new york" not in {x[2] for x in want}


def test_local_supports_lose_no_phrase(docs):
    """What the shards find holds every frequent phrase, for even and uneven shards."""
    from pyspark.sql import functions as F
    rows = docs.where("text is not null").withColumn("lang", F.lit("l"))
    for spread in (F.col("doc_id") % 4, F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)):
        cut = rows.withColumn("shard", F.coalesce(spread, F.lit(0)).cast("int"))
        sizes = {r.shard: r.b for r in cut.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
        support = [9 * sizes.get(s, 0) // sum(sizes.values()) + 1 for s in range(4)]
        assert sum(s - 1 for s in support) <= 9
        pairs = collocations.frequent(collocations.local_counts(cut), support)
        bits = collocations.bit_table(pairs, False)
        found = collocations.exact_counts(cut, bits).where("size = 2")
        every = collocations.exact_counts(cut, np.full_like(bits, 2**64 - 1)).where("size = 2")
        assert sorted(found.collect()) == sorted(every.collect()) and found.count() > 20


def test_top_and_empty(spark, docs):
    got = sorted(tuple(r) for r in collocations.phrases(docs, 3).collect())
    assert got == plain(sample(), 3)
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.phrases(none).collect() == []
