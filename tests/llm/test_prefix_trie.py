"""The prefix trie against a plain version, and the Z-fast trie against scans."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from tillpoint.llm import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    own = collections.defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            own[conv_id].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    members = collections.defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        words = len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * words
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if seqs[c] == p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(seed=5):
    rnd = random.Random(seed)
    rows = []
    for c in range(130):
        if c in (40, 41):  # 40 is the head of a group and not there
            continue
        n = rnd.choice([0, 1, 2, 3, 5, 7]) if c != 77 else 90
        rows += [(c, t, rnd.choice(["user", "bot", None]) if t % 2 else "user", rnd.choice(["hi", "a b", "", None, "é x y"]) if t else "the same  first\tturn") for t in range(n)]
        if c % 10 == 3:  # a copy, and one that goes on
            rows += [(c + 1000, *r[1:]) for r in rows if r[0] == c]
            rows += [(c + 2000, *r[1:]) for r in rows if r[0] == c] + [(c + 2000, 999, "user", "more")]
    return rows + [(5, None, "x", "null turn"), (6, 1, "user", "tie"), (6, 1, "user", "tie"), (6, 1, "bot", "tie"), (None, 1, "user", "no id"), (300, 2, None, None)]


@pytest.mark.parametrize("batch", [1, 25, prefix_trie.BATCH])
def test_nodes_equal_a_plain_version(spark, batch):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n", "'x' AS sig", "2 AS depth").repartition(5)
    got = prefix_trie.prefix_trie(df, batch)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(none).collect() == []
    only_null = spark.createDataFrame([(None, 1, "u", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(only_null).collect() == []


def path_of(symbols):
    sig, out = b"", []
    for s in symbols:
        sig = hashlib.blake2b(sig + s.encode(), digest_size=prefix_trie.SIG).digest()
        out.append(sig)
    return b"".join(out)


def test_two_fattest_numbers():
    for lo in range(40):
        for hi in range(lo + 1, 60):
            assert prefix_trie.fattest(lo, hi) == max(range(lo + 1, hi + 1), key=lambda x: x & -x)


def test_exit_nodes_and_handles():
    """After every insertion the exit node is the one a scan over all nodes finds, and
    every compacted node is under its handle."""
    import numpy as np
    rnd = random.Random(2)
    for _ in range(40):
        trie, seen = prefix_trie.ZFastTrie(), []
        for k in range(25):
            s = [rnd.choice("ab") for _ in range(rnd.randrange(0, 14))]
            p = path_of(s)
            want = max([prefix_trie.common_turns(p, q) for q in seen], default=0)
            node, d = trie.exit(p)
            assert d == want and node.path[:16 * d] == p[:16 * d] and node.start < d <= node.end or d == 0 == want
            trie.insert(p, np.ones(len(s), np.int64), 1, k)
            seen.append(p)
        assert {trie._handle(x): x for x in trie.nodes if x is not trie.root} == trie.handles
        assert all(len(x.kids) != 1 or x.n or x is trie.root for x in trie.nodes)
