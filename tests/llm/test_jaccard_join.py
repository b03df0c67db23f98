"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import sentence
from tillpoint.llm import jaccard_join as jj

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def links(rows):
    sets = [(d, grams(t)) for d, t in rows]
    return [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y)]


def classes(rows):
    comp = {d: d for d, _ in rows}
    found = links(rows)
    while True:
        before = dict(comp)
        for a, b in found:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            return comp


def edited(text, k, rnd):
    w = text.split()
    for i in rnd.sample(range(len(w)), k):
        w[i] = f"new{rnd.randrange(10**6)}"
    return " ".join(w)


def corpus():
    rnd = random.Random(9)
    base = [sentence(s, 60 + 7 * s) for s in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(12, 90):  # near copies of a few texts, beyond and below the limit
        rows.append((k, edited(base[k % 4], rnd.choice([0, 1, 1, 2, 3]), rnd)))
    line = sentence(77, 30)
    for k in range(90, 120):  # a common line in texts that are otherwise unlike
        rows.append((k, f"{sentence(k, 4 + k % 9)}\n{line}"))
    rows += [(120, None), (121, ""), (122, " \t\n"), (123, "one two"), (124, "ONE  two"), (125, "one two three"), (126, base[5].upper()),
             (127, base[6]), (127, base[7]), (None, base[8]), (None, "no id"), (128, base[8]), (129, "x " * 4000), (130, "X " * 12)]
    return rows


def test_components_equal_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS n", "1 AS gram", "2 AS label").repartition(3)
    got = jj.jaccard_components(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    comp = classes(rows)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((d, len(grams(t)), None if d is None else comp[d])) for d, t in rows)
    assert comp[7] == comp[127] == 6 and comp[126] == 5 and comp[124] == 123 and comp[125] == 125
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jj.jaccard_components(none).collect() == []


@pytest.mark.parametrize("marked", [False, True])
def test_no_link_is_lost_by_prefixes_and_bounds(spark, marked):
    """Blocks over columns hold every link between distinct sets, in any column order."""
    rows = [(d, t) for d, t in {tuple(sorted(grams(t))): (d, t) for d, t in corpus() if d is not None and grams(t)}.values()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hot = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if marked:  # some shingles last, as if they were frequent
        g = np.unique(jj.incidence([t.encode() for _, t in rows])[1])[::3]
        hot = (g, np.arange(len(g)) % 5 + 1)
    found = jj.prefixes(docs, docs.select("doc_id"), hot)
    columns = found.where("gram is not null").withColumn("label", F.col("doc_id"))
    pairs = jj.open_pairs(columns, found.where("gram is null"), size=7)
    want = sorted((min(p), max(p)) for p in links(rows))
    possible = {(r.doc_id, r.hub) for r in pairs.collect()}
    assert set(want) <= possible and len(want) > 50
    assert sorted((min(r), max(r)) for r in jj.verify(pairs, docs).collect()) == want


def test_block_product_and_sketch():
    rnd = np.random.default_rng(1)
    left = [np.unique(rnd.integers(0, 60, n).astype(np.uint64)) for n in (0, 5, 30, 60)]
    right = [np.unique(rnd.integers(0, 60, n).astype(np.uint64)) for n in (1, 40, 50)]
    assert jj.overlaps(left, right).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]
    wide = [np.unique(rnd.integers(0, 2**63, n).astype(np.uint64)) for n in (100, 300)]
    near = np.concatenate((wide[1][:-7], rnd.integers(0, 2**63, 9).astype(np.uint64)))
    for a, b, most in ((wide[0], wide[1], 400), (wide[1], near, 16)):
        assert int(np.bitwise_count(jj.sketch(a) ^ jj.sketch(b)).sum()) <= most
        assert jj.differing(jj.wide_sketch(a), jj.wide_sketch(b)) <= most
    assert jj.differing(jj.wide_sketch(wide[0]), jj.wide_sketch(wide[1])) > 100


def test_hub_partners_are_split(spark, monkeypatch):
    """A hub with more partners than a task takes: its row goes to each of them."""
    monkeypatch.setattr(jj, "MEMBERS", 3)
    base = sentence(1, 100)
    rnd = random.Random(1)
    rows = [(0, base)] + [(k, edited(base, k % 4, rnd)) for k in range(1, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = spark.createDataFrame([(k, 0) for k in range(1, 40)], "doc_id long, hub long")
    got = {r.doc_id for r in jj.verify(pairs, docs).collect()}
    assert got == {max(p) for p in links(rows) if 0 in p}
