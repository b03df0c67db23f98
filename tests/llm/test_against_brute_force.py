"""The ten operators against plain versions of what they compute."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.conftest import sentence
from tillpoint.llm import binary_output, decontam, langid, mixing, quality, simhash, substring, suffix_tree, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RND = random.Random(11)


def shuffled(words, k):
    """The words with k of them replaced."""
    out = list(words)
    for i in RND.sample(range(len(out)), k):
        out[i] = f"new{RND.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus(make):
    """Copies, near copies, shared passages and unlike texts."""
    base = [sentence(s, 70 + s) for s in range(30)]
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(base)]
    for i in range(30, 60):
        rows.append((i, " ".join(shuffled(base[i % 6].split(), RND.choice([0, 1, 2, 5]))), "en", f"s{i % 4}"))
    shared = sentence(99, 45)
    for i in range(60, 75):
        rows.append((i, f"{sentence(i, 20)}\n{shared}\t{sentence(i + 200, 25)}", "en", None))
    rows += [(75, "a a a a a " * 20, "en", "s0"), (76, "A b C", "en", "s1"), (77, "", "en", "s1"), (78, None, "en", "s2")]
    return make(rows)


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def test_simhash_components(spark, corpus):
    import xxhash
    docs = texts_of(corpus)
    fp = {}
    for d, t in docs.items():
        ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        grams = [" ".join(ws[i:i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fp[d] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    comp = {d: d for d in docs}
    for _ in docs:
        for a in docs:
            for b in docs:
                if (fp[a] ^ fp[b]).bit_count() <= 2:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(corpus.select("doc_id", "text")).collect()}
    assert got == {d: (fp[d], comp[d]) for d in docs} and len(set(comp.values())) < len(docs)


@pytest.mark.parametrize("design", [10, 10**6, 10**9])
def test_simhash_candidates_miss_no_link(spark, design):
    """Any plan finds every pair within two bits."""
    rnd = random.Random(3)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    fps += [f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for f in fps[:30]]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    n, both = simhash.bit_counts(df)
    steps = simhash.plan(n, both, 2, design)
    near = {r.fp % (1 << 64) for r in simhash.candidates(df, steps).collect()}
    linked = {a for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2}
    assert linked <= near and n == len(fps)


def test_substring_dedup(spark, corpus):
    lists = {d: t.encode().split() for d, t in texts_of(corpus).items()}
    count = collections.Counter(tuple(ws[i:i + 35]) for ws in lists.values() for i in range(len(ws) - 34))
    want = {}
    for d, ws in lists.items():
        hit = np.zeros(len(ws), bool)
        for i in range(len(ws) - 34):
            if count[tuple(ws[i:i + 35])] > 1:
                hit[i:i + 35] = True
        if hit.any():
            want[d] = (len(ws), int(hit.sum()), b" ".join(w for w, h in zip(ws, hit) if not h).decode())
    for shard in (substring.SHARD, 1):  # one automaton an anchor, and every anchor window by window
        before, substring.SHARD = substring.SHARD, shard
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(corpus.select("doc_id", "text")).collect()}
        substring.SHARD = before
        assert got == want
    assert want[75][1] == 100 and len(want) > 20


def test_automaton_counts_and_statistics():
    rnd = random.Random(1)
    for _ in range(60):
        seqs = [[rnd.choice("ab") for _ in range(rnd.randrange(1, 9))] for _ in range(3)]
        weights = [rnd.randrange(1, 3) for _ in seqs]
        sam = substring.Automaton()
        for s, w in zip(seqs, weights):
            sam.add(s, w)
        sam.settle()
        occ = collections.Counter()
        for s, w in zip(seqs, weights):
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1):
                    occ[tuple(s[i:j])] += w
        for s in seqs:
            want = [max([n for n in range(1, j + 2) if occ[tuple(s[j + 1 - n:j + 1])] >= 2], default=0) for j in range(len(s))]
            assert list(sam.statistics(s)) == want


def test_quality_statistics(spark, corpus):
    got = {r.doc_id: r for r in quality.judge(corpus, None).collect()}
    for d, t in texts_of(corpus).items():
        ws = WORD.findall(t)
        lines, dup = set(), 0
        for x in t.split("\n"):
            if WORD.search(x):
                dup += x in lines
                lines.add(x)
        grams = collections.Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
        hit = {j for i in range(len(ws) - 4) if grams[tuple(ws[i:i + 5])] > 1 for j in range(i, i + 5)}
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit))
        assert r.base_failed == (len(ws) < 10 or 100 * len(hit) > 20 * len(ws)) and r.kept == (not r.base_failed)


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((2000, len(quality.FEATURES)))
    y = ((x[:, 2] < 0.3) & (x[:, 1] > 0.2)).astype(float)
    trees = quality.Trees(x, y)
    assert ((trees.score(x) >= 0.5) == (y > 0)).mean() > 0.97
    for name in quality.MONOTONE:
        j = quality.FEATURES.index(name)
        low, high = x[:300].copy(), x[:300].copy()
        high[:, j] = low[:, j] + rng.random(300)
        assert (trees.score(high) <= trees.score(low) + 1e-12).all()


def test_mix_takes_near_targets_and_splits_exactly(spark, corpus):
    base = mixing.sized(corpus).persist()
    before = mixing.SHARD_WORDS, mixing.BLOCK_WORDS
    mixing.SHARD_WORDS, mixing.BLOCK_WORDS = 500, 60
    drawn, sources = mixing.mix(base)
    rows, goal = drawn.collect(), {r.skey: r for r in sources.collect()}
    again = mixing.mix(base)[0].collect()
    mixing.SHARD_WORDS, mixing.BLOCK_WORDS = before
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    taken, copies = collections.Counter(), collections.Counter()
    for r in rows:
        taken[r.skey] += r["size"]
        copies[r.doc_id] += 1
    biggest = max(r["size"] for r in rows)
    assert max(copies.values()) <= 2 and len({r.shard for r in rows}) > 8
    for k, r in goal.items():
        assert abs(taken[k] - r.target) <= biggest and r.target <= 2 * r.source_size + 1e-9
    # water filling by rounds
    names = sorted(goal)
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    left, open_ = 1.5 * sum(r.source_size for r in goal.values()), set(names)
    want = {}
    while open_:
        level = left / sum(weight[k] for k in open_)
        over = [k for k in open_ if weight[k] * level > 2 * goal[k].source_size]
        for k in over or list(open_):
            want[k] = 2 * goal[k].source_size if over else weight[k] * level
            left -= want[k]
            open_.discard(k)
    assert {k: r.target for k, r in goal.items()} == pytest.approx(want)


def test_mix_has_small_plans(spark, corpus, monkeypatch):
    """The driver holds a step's plan and what it broadcasts."""
    joins, levels, real = [], [], mixing.stored

    def plan(df):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        joins.append(text.count("Join "))
        levels.append(text.count("Generate explode"))

    def stored(df, label):
        plan(df)
        return real(df, label)

    monkeypatch.setattr(mixing, "stored", stored)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 200)
    plan(mixing.mix(mixing.sized(corpus))[0])
    assert max(joins) <= 4 and max(levels) <= 2


def test_mix_has_few_plans(spark, make, monkeypatch):
    """Every scan, shuffle and broadcast of a step costs the driver blocks of its own."""
    rows = [(i, sentence(i, 20 + i * 7 % 90), "en", "abc"[i % 3]) for i in range(90)]
    base, steps, real = mixing.sized(make(rows)).persist(), [], mixing.stored

    def plan(df):
        text = df._jdf.queryExecution().executedPlan().toString()
        text = text.split("== Initial Plan ==")[0]
        steps.append(text.count("Exchange ") + text.count("Scan parquet"))

    def stored(df, label):
        plan(df)
        return real(df, label)

    monkeypatch.setattr(mixing, "stored", stored)
    plan(mixing.mix(base)[0])
    assert len(steps) <= 6 and sum(steps) <= 30, steps


@pytest.mark.parametrize("long", [700, 290, 150])
def test_mix_with_one_unit_of_most_of_a_source(spark, make, long):
    """Small documents fill what a long one, wherever it is in the permutation, cannot."""
    for first in (0, 3):
        rows = [(first, " ".join(["w"] * long), "en", "b")]
        rows += [(i, "x y z", "en", "b") for i in range(10, 110)]
        rows += [(1000 + i, " ".join(["v"] * 40), "en", "a") for i in range(58)]
        drawn, sources = mixing.mix(mixing.sized(make(rows)))
        goal = {r.skey: r.target for r in sources.collect()}
        taken = collections.Counter()
        for r in drawn.collect():
            taken[r.skey] += r["size"]
        for k, target in goal.items():
            rest = target % sum(len(t.split()) for _, t, _, s in rows if "0" + s == k)
            assert abs(taken[k] - target) < (3 if k == "0b" and long > rest else 150)


def test_fill_takes_what_fits(spark):
    units = spark.createDataFrame([("0a", i, n, n, i) for i, n in enumerate([500, 90, 60, 30, 20, 7, 3, 1])] + [("0b", None, 50, 50, 1), ("0b", 4, 2, 2, 2)], "skey string, doc_id long, size long, words long, h long")
    state = spark.createDataFrame([("0a", 8, 400.0, 150.5), ("0b", 2, 60.0, 51.0), ("0c", 1, 9.0, 9.0)], "skey string, n_units long, rest double, gap double")
    got = collections.defaultdict(list)
    for r in mixing.fill(units, state, True).collect():
        got[r.skey].append((r.words, r["at"]))
    words = [w for w, _ in got["0a"]]
    assert len(set(words)) == len(words) and not [w for w in {500, 90, 60, 30, 20, 7, 3, 1} - set(words) if w <= 150.5 - sum(words)]
    assert all(249.5 <= at and at + w <= 400 for w, at in got["0a"]) and len(got["0b"]) == 1 and set(got) == {"0a", "0b"}


def test_splitting_tree_is_hypergeometric(spark):
    """Exact totals at every node; means of many draws near the expected share."""
    goal = spark.createDataFrame([(0, 300), (1, 40), (2, 0), (3, 1)], "idx int, quota long")
    leaf = [r for r in mixing.leaves(goal, 5).collect()]
    total = collections.Counter()
    for r in leaf:
        total[r.idx] += r.q
    assert total == {0: 300, 1: 40, 2: 0, 3: 1}
    sizes = collections.Counter()
    for r in leaf:
        sizes[r.shard] += r.q
    assert max(sizes.values()) - min(sizes.values()) <= 1
    spans = sorted((r.idx, r.start, r.start + r.q) for r in leaf if r.q)
    assert all(a[2] == b[1] for a, b in zip(spans, spans[1:]) if a[0] == b[0])
    share = [r.q for r in leaf if r.idx == 1]
    assert 0 < np.var(share) < 3  # about 40 * 341/32/341 * ... of a random draw, not an even deal


def test_token_files(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = corpus.unionByName(spark.createDataFrame([
        (100, "I'm can't <|endoftext|> <|ENDOFTEXT|> naïve ÉCOLE, 3.5% é ﬁ  x日本語 don't.", "en", "s", 1),
        (101, "word. word, word., .,. 's S'S ΑΣ. straße İ", "en", "s", 1)], corpus.schema))
    from tillpoint.llm.common import scratch_dir
    manifest = binary_output.write_records(odd.select("doc_id", "text"), f"{scratch_dir(spark)}/records-test-{RND.random()}")
    got = binary_output.read_records(manifest).collect()
    start, bad = 0, []
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(texts_of(odd))
    for d, t in sorted(texts_of(odd).items()):
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4")
        r = next(r for r in got if r.doc_id == d)
        if (r.start, r.n_tokens, r.ids_crc32) != (start, len(ids), zlib.crc32(ids.tobytes())):
            bad.append(d)
        start += len(ids)
    assert bad == []
    part = manifest.orderBy("seq").first()
    order = list(range(part.n_records))
    RND.shuffle(order)
    by_place = [binary_output.read_at(part.path, i) for i in order]  # shuffled reads
    assert sorted(d for d, _ in by_place) == sorted(texts_of(odd))[:part.n_records]


def test_damaged_records_are_noticed(tmp_path):
    import io
    record = binary_output.frame(7, np.arange(50), 2)
    doc_id, ids = binary_output.read_record(io.BytesIO(record))
    assert doc_id == 7 and ids.tolist() == list(range(50))
    for at in (0, 9, 30, len(record) - 1):
        broken = bytearray(record)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            binary_output.read_record(io.BytesIO(bytes(broken)))
    with pytest.raises(ValueError):
        binary_output.read_record(io.BytesIO(record[:-3]))


def test_lm_scores(spark, corpus):
    got = {r.doc_id: r for r in suffix_tree.score(corpus.select("doc_id", "text")).collect()}
    lists = {d: t.encode().lower().split() + [b""] for d, t in texts_of(corpus).items()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in lists}
    c = collections.Counter(w for d, ws in lists.items() if not held[d] for w in ws)
    total, v = sum(c.values()), len(c)
    for d, ws in lists.items():
        r = got[d]
        want = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(c[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(want)
    assert sum(r.score - r.base_score for r in got.values()) > 0  # copies and passages are predictable


def test_lm_scores_keep_every_repeated_run(spark, make):
    """On a corpus of over 100,000 training tokens, runs seen two or three times count
    as they do on a small one, and all scores are those of the tree in one place."""
    rnd = random.Random(21)
    phrases = [[f"p{i}x{j}" for j in range(6)] for i in range(40)]
    rows = []
    for d in range(260):
        ws = [f"w{int(rnd.paretovariate(0.7)) % 3000}" for _ in range(800)]
        for i in (d % 40, d % 37, d % 39):
            if d < 60:
                ws[100 * i % 700:100 * i % 700] = phrases[i]
        rows.append((d, " ".join(ws)))
    got = {r.doc_id: r for r in suffix_tree.score(make(rows).select("doc_id", "text")).collect()}
    lists = {d: t.lower().split() + [""] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in lists}
    count = collections.Counter(w for d, ws in lists.items() if not held[d] for w in ws)
    total = sum(count.values())
    assert total > 150_000 and all(r.train_tokens == total for r in got.values())
    known = sorted(w for w, n in count.items() if n >= 2)
    at = {w: i for i, w in enumerate(known)}
    tree = suffix_tree.Tree(np.arange(1, len(known) + 1), np.array([count[w] for w in known], float), total, len(count))
    tok = {d: np.array([at.get(w, -1) for w in ws], np.int64) for d, ws in lists.items()}
    zero = np.array([0])
    for order in range(2, suffix_tree.MAX_DEPTH + 2):
        keys, n = np.unique(np.concatenate([tree.candidates(tok[d], zero, order) for d in tok if not held[d]]), return_counts=True)
        tree.add(order, keys[n >= 2], n[n >= 2].astype(float))
    tree.grow()
    for d in lists:
        assert got[d].score - got[d].base_score == pytest.approx(tree.adjust(tok[d], zero).sum(), abs=1e-6)
    assert sum(got[d].score > got[d].base_score for d in range(60)) > 40


def test_suffix_tree_is_a_distribution(spark):
    """Next-word probabilities of every state sum to one (with the unknown word)."""
    rnd = random.Random(2)
    words = [rnd.choice("abcd") for _ in range(4000)]
    for i in range(0, 4000, 5):
        words[i:i + 3] = ["a", "b", "c"]
    symbols = np.arange(1, 5)
    counts = np.array([words.count(w) for w in "abcd"], float)
    tree = suffix_tree.Tree(symbols, counts, 4000, 4)
    tok = np.array(["abcd".index(w) for w in words[:4000]], np.int64)
    first = np.array([0])
    for order in range(2, suffix_tree.MAX_DEPTH + 2):
        keys, n = np.unique(tree.candidates(tok, first, order), return_counts=True)
        tree.add(order, keys, n.astype(float))
    tree.grow()
    assert len(tree.parent) > 3  # contexts were kept
    unknown = 0.1 / (4000 + 0.5)
    for context in ("a", "b", "ab", "ca", "cab", "dab"):
        p = []
        for w in range(4):
            seq = np.array(["abcd".index(x) for x in context] + [w], np.int64)
            p.append(tree.root[w] * 10 ** tree.adjust(seq, first)[-1])
        rest = unknown * 10 ** tree.adjust(np.array(["abcd".index(x) for x in context] + [-1], np.int64), first)[-1]
        assert sum(p) + rest == pytest.approx(1.0)


def test_token_counts(spark):
    import public_tokenizers
    model = token_counts.load(public_tokenizers.path("piece_bpe_32k.model"))
    words = ["▁the", "▁there", "▁thereafter", "▁zzzqqq", "▁日本x", "▁", "▁naïve", "▁aaaaaaaaaaaa"]

    def plain(w):
        best = [(0.0, 0)] + [None] * len(w)
        for j in range(1, len(w) + 1):
            options = []
            for s in range(j):
                p = model.logp.get(w[s:j])
                if p is not None:
                    options.append((-(best[s][0] + p), best[s][1] + 1))
                elif s == j - 1:
                    n = len(w[s].encode())
                    options.append((-(best[s][0] + n * token_counts.BYTE), best[s][1] + n))
            cost, n = min(options)
            best[j] = (-cost, n)
        return best[-1][1]

    assert model.counts(words) == [plain(w) for w in words]
    assert model.counts(words[::-1]) == [plain(w) for w in words[::-1]]
    df = spark.createDataFrame([(1, "the there the"), (2, "naïve")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.token_counts(df).collect()}
    assert got == {1: (3, 2 * plain("▁the") + plain("▁there")), 2: (1, plain("▁naïve"))}


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_kernel_is_normalised_and_matches_sets():
    a, b = langid.grams("Hello hello world"), langid.grams("hello there")
    model = langid.Classifier([(a, "x"), (b, "y")])
    k = model.kernel([a, b])
    assert k[0, 0] == pytest.approx(1) and k[1, 1] == pytest.approx(1)
    assert k[0, 1] == pytest.approx(len(np.intersect1d(a, b)) / math.sqrt(len(a) * len(b)))


def test_chain_matches_enumeration():
    rng = np.random.default_rng(4)
    sizes = np.array([4, 1, 3, 4])
    chain = toxicity.Chain(sizes)
    e, trans, start = rng.normal(size=12), rng.normal(size=(2, 2)), 0.3
    post = chain.marginals(e, trans, start)[0][chain.place]
    at = 0
    for n in sizes:
        w = {}
        for y in range(1 << n):
            bits = [y >> i & 1 for i in range(n)]
            s = start * bits[0] + sum(e[at + i] for i in range(n) if bits[i]) + sum(trans[bits[i - 1], bits[i]] for i in range(1, n))
            w[y] = math.exp(s)
        for i in range(n):
            assert post[at + i] == pytest.approx(sum(v for y, v in w.items() if y >> i & 1) / sum(w.values()))
        at += n


def test_toxicity_learns_spans(spark):
    rnd = random.Random(6)
    pool = [f"{a}{b}" for a in ("lor", "mip", "sut", "ven", "dol") for b in ("em", "sum", "ta", "ri", "or", "an")]
    rows = []
    for i in range(900):
        ws = [rnd.choice(pool) for _ in range(40)]
        if i % 3 == 0:
            ws[rnd.randrange(40)] = rnd.choice(["vilebeast", "Rottenhag", "vilehag"])
        rows.append((" ".join(ws), int(i % 3 == 0)))
    model = toxicity.train(rows[:700])
    scores, post, chain = toxicity.score_texts([t.encode() for t, _ in rows[700:]], model)
    assert ((scores >= 0.5) == np.array([y for _, y in rows[700:]], bool)).mean() == 1.0
    df = spark.createDataFrame([(1, "lorem rottenhag, mipta"), (2, "lorem mipta"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert got[1].predicted == 1 and [(s.begin, s.end, s.text) for s in got[1].spans] == [(6, 16, "rottenhag,")]
    assert got[2].predicted == 0 == got[3].predicted and got[3].n_spans == 0


def test_toxicity_finds_varied_words_and_spares_clean_texts():
    """Compound words, each in some six toxic texts and by chance in a clean one."""
    rnd = random.Random(16)
    pool = [f"{a}{b}{c}" for a in ("lor", "mip", "sut", "ven", "dol", "kra") for b in ("em", "sum", "ta", "ri", "or", "an") for c in ("", "ba", "ke", "nu")]
    bad = [f"gräm{b}{c}" for b in ("lich", "keit", "ung", "heit", "zu") for c in ("er", "en", "tz", "pf", "sch", "ou", "el", "st", "re", "it", "al", "un")]
    rows = []
    for i in range(1000):
        ws = [rnd.choice(pool) for _ in range(60)]
        if i % 8 == 0:
            for at in rnd.sample(range(60), 4):
                ws[at] = rnd.choice(bad)
        elif i % 50 == 1:
            ws[7] = rnd.choice(bad)
        rows.append((" ".join(ws), int(i % 8 == 0)))
    model = toxicity.train(rows[:700])
    hit = toxicity.score_texts([t.encode() for t, _ in rows[700:]], model)[0] >= 0.5
    truth = np.array([y for _, y in rows[700:]], bool)
    assert hit[truth].mean() >= 0.9 and hit[~truth].mean() < 0.02


def test_toxicity_learns_from_eleven_labels():
    rnd = random.Random(17)
    pool = ["".join(rnd.choice("abdeiklmnorstu") for _ in range(7)) for _ in range(2000)]
    rows = []
    for i in range(160):
        ws = [rnd.choice(pool) for _ in range(50)]
        if i % 8 == 0:
            for at in rnd.sample(range(50), 4):
                ws[at] = rnd.choice(["vilebeast", "rottenhag", "gruntling", "smearpot"])
        rows.append((" ".join(ws), int(i % 8 == 0)))
    assert sum(y for _, y in rows[:88]) == 11
    model = toxicity.train(rows[:88])
    hit = toxicity.score_texts([t.encode() for t, _ in rows[88:]], model)[0] >= 0.5
    truth = np.array([y for _, y in rows[88:]], bool)
    assert hit[truth].all() and not hit[~truth].any()


def test_lcs():
    rnd = random.Random(8)
    for _ in range(200):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randrange(8))] for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert decontam.lcs(a, b) == d[-1][-1]


def test_decontamination_finds_copies_and_paraphrases(spark, make):
    items = [(i, sentence(300 + i, 40)) for i in range(12)]
    rows, want = [], set()
    for i in range(60):
        text = sentence(i, 150)
        if i % 5 == 0:
            ws = items[i % 12][1].upper().split()
            if i % 10 == 0:  # a paraphrase: every seventh word changed
                ws = [w if k % 7 else "other" for k, w in enumerate(ws)]
            text = f"{text}. {', '.join(ws)}! {sentence(i + 500, 30)}"
            want.add((i, i % 12))
        rows.append((i, text))
    found = decontam.leaks(make(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    before, decontam.ITEM_WORDS = decontam.ITEM_WORDS, 100  # many blocks of the benchmark
    blocks = decontam.leaks(make(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    decontam.ITEM_WORDS = before
    assert {(r.doc_id, r.item_id) for r in blocks} == want


def test_decontamination_of_many_passages(spark, make):
    """With more passages than dimensions, each passage keeps its whole length in the
    space, and exact copies in documents of the passages' own words and copies without
    a fifth of the words are found."""
    rnd = random.Random(31)
    pool = [f"w{i}" for i in range(4000)]
    words = lambda n: [pool[int(4000 * rnd.random() ** 2)] for _ in range(n)]
    items = {i: words(rnd.randrange(25, 60)) for i in range(700)}
    rows, want = [], set()
    for i, ws in items.items():
        copy = ws if i % 2 else [w for w in ws if rnd.random() > 0.2]
        if i % 2 or len(copy) >= 0.77 * len(ws):
            want.add((i, i))
        rows.append((i, " ".join(words(90) + copy + words(90))))
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items.items()], "item_id long, text string")
    for m in decontam.matchers(make(rows), bench):
        latent = [np.linalg.norm(m.terms[[m.vocab[w] for w in set(ws)]].sum(0)) for ws in m.words]
        assert latent == pytest.approx(list(m.length), rel=1e-3)
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(make(rows), bench).collect()}
    assert len([x for x in want - found if x[0] % 2]) <= 0.01 * len(items)
    assert len(want - found) <= 0.02 * len(items)


@pytest.mark.parametrize("n", [15, 60, 97, 600, 1000, 5000])
def test_decontamination_of_verbatim_copies(spark, make, n):
    """Copies at any place of a text, among rarer words of other passages, are found."""
    rnd = random.Random(n)
    items = {i: [f"{'c' if rnd.random() < 0.7 else 'r'}{rnd.randrange(300)}" for _ in range(n)] for i in range(6)}
    items |= {i: [f"rare{i}x{j}" for j in range(90)] for i in range(6, 9)}
    rows = []
    for d in range(6):
        around = items[6 + d % 3]
        at = 10 + 7 * d
        rows.append((d, " ".join(around[:at] + items[d] + around[at:])))
    rows += [(100 + d, " ".join(rnd.choice(["c1", "c2", "z"]) + str(rnd.randrange(30)) for _ in range(300))) for d in range(40)]
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items.items()], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(make(rows), bench).collect()}
    assert {(d, d) for d in range(6)} <= found and {d for d, _ in found} <= set(range(6))


def test_pipeline_decisions(spark, tmp_path):
    import corpus_pipeline
    from tillpoint.llm.common import stored, table

    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, folder), name)
        assert out.columns == docs.columns
        sizes.append(out.count())
        docs = out
    assert sizes[3] <= sizes[2] <= sizes[1] <= sizes[0] and sizes[3] > 0.7 * sizes[0]
    records = corpus_pipeline.run(spark, folder).collect()
    assert len(records) == sizes[4]
