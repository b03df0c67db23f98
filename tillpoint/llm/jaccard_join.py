"""N-gram Jaccard join (operator 13) as a blocked sparse matrix product.

The corpus is a sparse 0/1 matrix A, one row a distinct shingle set and one column a
shingle; two sets link when 100 * |x & y| >= 80 * |x | y|. The entries of A A^T that can
reach this are computed block by block, the others are discarded by bounds on sizes:

1. Sets. Equal sets are one row (the class' least doc_id), so copies are never paired.
2. Columns in one global order: frequent shingles last (found by counts of bounded
   blocks, added up over the corpus; at most HOT of them, the most frequent). Of two
   linked sets, one of the first n - ceil(0.8 n) + 1 shingles of either is in both, so
   only these prefixes are dealt out by shingle; columns with one row fall away.
3. Bounds. Sizes n, m need 80 * max <= 100 * min, and the symmetric difference is at
   most (n + m) / 9. A parity sketch of a set differs in no more bits than the set
   itself, so pairs beyond that are discarded without looking at the sets: by 256 bits
   first, then by two to four bits a shingle (the wider sketch of a pair is folded).
4. Product. The rows of a column meet its hub, the most central one: a block of rows is
   multiplied with the hub's row, overlaps are accumulated and compared. What links gets
   a common label. Then only pairs of different labels are open: a column that still has
   several labels is cut into blocks of BLOCK rows, all block pairs are compared by
   sizes and sketches, and what is left goes through the product. A column of near
   copies mostly collapses to one label at its hub, so that its pairs are not made; no
   pair of different labels is left out. Equal columns are taken once.
5. Components over the links, by stars; the labels go back to all documents.

Defined results: a null, empty or blank text has no shingle and is linked with nothing;
with fewer than five words the whole sequence is the one shingle. Rows of one doc_id are
one document in the graph. A row without a doc_id links nothing; its component is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import col, cut, prepare, slices, stored, table, texts
from tillpoint.llm.components import components

WIDTH = 5
#: A link: PART * intersection >= SHARE * union.
SHARE, PART = 80, 100
#: Most shingles that are ordered last, the counts that make one of them, and the
#: shingles that a task counts at a time (32 MB).
HOT, HOT_LOCAL, HOT_TOTAL, COUNTED = 1 << 20, 3, 32, 1 << 22
BLOCK = 512
#: Rows of a hub's column that meet it in one task.
MEMBERS = 256
#: Pairs that a task of the block step holds before it passes them on (16 MB).
PAIRS = 1 << 20
SKETCH = ["s0", "s1", "s2", "s3"]
#: Ids are let through a bit table of so many bits (16 MB).
ID_BITS = 27

_LOWER_SPACE = bytes(32 if 9 <= i <= 13 else i + 32 if 65 <= i <= 90 else i for i in range(256))


def word_ids(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(text, word number) of every word of the texts, and the distinct words."""
    split = pc.split_pattern(pa.array([t.translate(_LOWER_SPACE) for t in lists], pa.large_binary()), pattern=b" ")
    sizes = np.diff(split.offsets.to_numpy())
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(lists)), sizes)
    if b"" in words:
        full = ids != words.index(b"")
        ids, doc = ids[full], doc[full]
    return doc, ids, words


def by_text(d: np.ndarray) -> np.ndarray:
    """Stable order by text number (radix sort while 16 bits hold it)."""
    return np.argsort(d.astype(np.uint16) if len(d) and d.max() < 1 << 16 else d, kind="stable")


def incidence(lists: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of every distinct shingle of every text, ordered by both."""
    doc, ids, words = word_ids(lists)
    sizes = np.bincount(doc, minlength=len(lists))
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)[ids]
    n = max(len(h) - width + 1, 0)
    g = np.zeros(n, np.uint64)
    for j in range(width):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    inside = doc[:n] == doc[width - 1 :] if n else np.zeros(0, bool)
    starts = np.cumsum(sizes) - sizes
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    whole = np.array([xxhash.xxh64_intdigest(h[starts[d] : starts[d] + sizes[d]].tobytes(), 1) for d in short], np.uint64)
    d, g = np.concatenate((doc[:n][inside], short)), np.concatenate((g[inside], whole))
    order = np.argsort(g)
    order = order[by_text(d[order])]
    d, g = d[order], g[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
    return d[new], g[new]


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parities of the shingles that fall on each of 256 bits, as four words."""
    bits = np.bincount((grams >> np.uint64(8)).astype(np.int64) & 255, minlength=256) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def wide_sketch(grams: np.ndarray) -> bytes:
    """Parities on the least power of two of bits that is twice the size or more."""
    width = max(256, 1 << max(2 * len(grams) - 1, 1).bit_length())
    return np.packbits((np.bincount((grams >> np.uint64(16)).astype(np.int64) & (width - 1), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two wide sketches differ, at the width of the narrower one."""
    x, y = sorted((np.frombuffer(s, np.uint64) for s in (a, b)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The block of A A^T for the rows of ``left`` and ``right``: each shared column
    adds one to the cells of its rows."""
    lg, rg = np.concatenate(left), np.concatenate(right)
    lr = np.repeat(np.arange(len(left)), [len(x) for x in left])
    rr = np.repeat(np.arange(len(right)), [len(x) for x in right])
    order = np.argsort(rg, kind="stable")
    rg, rr = rg[order], rr[order]
    lo, hi = np.searchsorted(rg, lg, "left"), np.searchsorted(rg, lg, "right")
    n = hi - lo
    at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    cells = np.repeat(lr, n) * len(right) + rr[at]
    return np.bincount(cells, minlength=len(left) * len(right)).reshape(len(left), len(right))


def linked(overlap, n, m):
    """Whether sets of n and m shingles with this overlap link."""
    return PART * overlap >= SHARE * (n + m - overlap)


def scan(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row a document (doc_id, n, key: 128-bit hash of the set), and rows of
    frequent shingles (gram, df) from blocks of COUNTED shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("gram", pa.int64()), ("df", pa.int64())])

    def frequent(parts):
        g, c = np.unique(np.concatenate(parts), return_counts=True)
        g, c = g[c >= HOT_LOCAL], c[c >= HOT_LOCAL]
        none = pa.nulls(len(g))
        return pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(g.view(np.int64)), pa.array(c)], schema=schema)

    def run(batches):
        parts, size = [], 0
        for b in slices(batches):
            lists = texts(b)
            d, g = incidence(lists, width)
            n = np.bincount(d, minlength=len(lists))
            ends = np.cumsum(n)
            keys = [xxhash.xxh128_digest(g[e - k : e].tobytes()) for e, k in zip(ends, n)]
            none = pa.nulls(len(lists)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([col(b, "doc_id"), pa.array(n), pa.array(keys, pa.binary()), none, none], schema=schema)
            parts.append(g)
            size += len(g)
            if size >= COUNTED:
                yield frequent(parts)
                parts, size = [], 0
        if parts:
            yield frequent(parts)

    return docs.mapInArrow(run, "doc_id long, n long, key binary, gram long, df long")


def frequent_grams(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The at most HOT shingles that are ordered last, and their counts."""
    total = found.where("gram is not null").groupBy("gram").agg(F.sum("df").alias("df")).where(F.col("df") >= HOT_TOTAL)
    rows = total.orderBy(F.desc("df"), "gram").limit(HOT).toArrow()
    gram, df = rows["gram"].to_numpy().astype(np.int64).view(np.uint64), rows["df"].to_numpy().astype(np.int64)
    order = np.argsort(gram)
    return gram[order], df[order]


def id_bits(ids: DataFrame, column: str = "doc_id") -> np.ndarray:
    """Bit table of fixed size of a column (its low ID_BITS bits), or-ed on the
    executors. It lets through every value of the column, and some others."""
    low = F.col(column).bitwiseAND(F.lit((1 << ID_BITS) - 1))
    bit = F.expr("shiftleft(1L, CAST(low & 63 AS INT))")
    rows = ids.select(low.alias("low")).select(F.shiftright("low", 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (ID_BITS - 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["bit"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def _let_through(batch: pa.RecordBatch, bits: np.ndarray, column: str = "doc_id") -> pa.RecordBatch:
    batch = batch.filter(pc.is_valid(col(batch, column)))
    low = col(batch, column).to_numpy().astype(np.int64) & ((1 << ID_BITS) - 1)
    return batch.filter(pa.array((bits[low >> 6] >> (low & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))


def prefixes(docs: DataFrame, ids: DataFrame, hot: tuple[np.ndarray, np.ndarray], width: int = WIDTH) -> DataFrame:
    """For the texts of ``ids`` (and some others): an entry (gram, doc_id) for each of
    the first n - ceil(0.8 n) + 1 shingles, and a row (doc_id, n, s0..s3) with the size
    and the sketch."""
    # at most 8 MB each, and 2^ID_BITS bits
    grams, counts, wanted = (docs.sparkSession.sparkContext.broadcast(x) for x in (*hot, id_bits(ids)))
    facts = ["n", *SKETCH]
    schema = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in facts], ("wide", pa.binary())])

    def run(batches):
        hot_g, hot_n = grams.value, counts.value
        for b in slices(_let_through(x, wanted.value) for x in batches):
            lists, ids_of = texts(b), col(b, "doc_id")
            d, g = incidence(lists, width)
            n = np.bincount(d, minlength=len(lists))
            if not len(lists):
                continue
            parts = np.split(g, np.cumsum(n)[:-1])
            sk = np.array([sketch(p) for p in parts]).view(np.int64)
            wide = pa.array([wide_sketch(p) for p in parts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(n)).cast(pa.int64()), ids_of, pa.array(n), *[pa.array(np.ascontiguousarray(sk[:, j])) for j in range(len(SKETCH))], wide], schema=schema)
            if len(hot_g):
                at = np.minimum(np.searchsorted(hot_g, g), len(hot_g) - 1)
                order = np.argsort(np.where(hot_g[at] == g, hot_n[at], 0), kind="stable")
                order = order[by_text(d[order])]
                d, g = d[order], g[order]
            place = np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n)
            first = place < (n - (SHARE * n + PART - 1) // PART + 1)[d]
            none = pa.nulls(int(first.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(g[first].view(np.int64)), ids_of.take(pa.array(d[first])), *[none] * len(facts), pa.nulls(len(none), pa.binary())], schema=schema)

    return docs.mapInArrow(run, "gram long, doc_id long, " + ", ".join(f"{c} long" for c in facts) + ", wide binary")


def only(entries: DataFrame, columns: DataFrame) -> DataFrame:
    """The entries of the given columns: a bit table drops most others before rows move."""
    wanted = entries.sparkSession.sparkContext.broadcast(id_bits(columns, "gram"))

    def run(batches):
        for b in batches:
            yield _let_through(b, wanted.value, "gram")

    return entries.mapInArrow(run, entries.schema).join(columns, "gram", "left_semi")


def one_of_equal(columns: DataFrame) -> DataFrame:
    """(gram): the least of all columns with the same rows (told by their number and two
    hashes added up), without columns of one row. The shingles of a passage that the
    same documents share are one column."""
    marks = [F.bit_xor(F.xxhash64("doc_id", F.lit(k))).alias(f"m{k}") for k in (1, 2)]
    each = columns.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"), *marks).where("rows > 1")
    return each.groupBy("rows", "m1", "m2").agg(F.min("gram").alias("gram")).select("gram")


def rows_of(docs: DataFrame, ids: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, grams): the matrix rows of the texts of ``ids`` (and some others)."""
    wanted = docs.sparkSession.sparkContext.broadcast(id_bits(ids))
    schema = pa.schema([("doc_id", pa.int64()), ("grams", pa.binary())])

    def run(batches):
        for b in slices(_let_through(x, wanted.value) for x in batches):
            lists = texts(b)
            d, g = incidence(lists, width)
            parts = np.split(g, np.cumsum(np.bincount(d, minlength=len(lists)))[:-1])
            yield pa.RecordBatch.from_arrays([col(b, "doc_id"), pa.array([p.tobytes() for p in parts], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, grams binary")


def _differ(a: str, b: str) -> Column:
    """Number of sketch bits in which rows with the given column prefixes differ."""
    return sum((F.bit_count(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))) for s in SKETCH), F.lit(0))


def _possible(a: str, b: str) -> Column:
    """Size and sketch bounds of a pair of rows with the given column prefixes."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return (SHARE * F.greatest(n, m) <= PART * F.least(n, m)) & ((PART + SHARE) * _differ(a, b) <= (PART - SHARE) * (n + m))


def verify(pairs: DataFrame, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The pairs (doc_id, hub) of ``docs`` that link. A hub's partners are split over tasks of about
    MEMBERS rows, each of which gets the hub's row."""
    parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts"))
    asks = pairs.join(parts, "hub").select("doc_id", "hub", (F.pmod(F.xxhash64("doc_id"), "parts")).cast("long").alias("part"), F.lit(1).alias("side"))
    own = parts.select(F.col("hub").alias("doc_id"), "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"))
    asks = asks.unionByName(own)
    met = asks.join(rows_of(docs, asks, width), "doc_id")
    schema = pa.schema([("doc_id", pa.int64()), ("hub", pa.int64())])

    def run(batches):
        key, hubs, ids, rows = None, [], [], []

        def product():
            both = overlaps(rows, hubs)
            n, m = np.array([len(x) for x in rows]), np.array([len(x) for x in hubs])
            good = linked(both, n[:, None], m[None, :]).any(axis=1)
            out = np.array(ids)[good]
            return pa.RecordBatch.from_arrays([pa.array(out), pa.array(np.full(len(out), key[0]))], schema=schema)

        for b in batches:
            for hub, part, side, doc_id, grams in zip(*(col(b, c).to_pylist() for c in ("hub", "part", "side", "doc_id", "grams"))):
                if (hub, part) != key or len(rows) >= MEMBERS:
                    if rows:
                        yield product()
                    ids, rows = [], []
                if (hub, part) != key:
                    key, hubs = (hub, part), []
                if side:
                    ids.append(doc_id)
                    rows.append(np.frombuffer(grams, np.uint64))
                else:
                    hubs.append(np.frombuffer(grams, np.uint64))
        if rows:
            yield product()

    grouped = met.select("hub", "part", "side", "doc_id", "grams").repartition("hub", "part").sortWithinPartitions("hub", "part", "side", "doc_id")
    return grouped.mapInArrow(run, "doc_id long, hub long")


def _facts(facts: DataFrame, prefix: str) -> DataFrame:
    return facts.select(F.col("doc_id").alias(f"{prefix}id"), *[F.col(c).alias(f"{prefix}{c}") for c in ["n", *SKETCH]])


def hub_pairs(columns: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, hub): the possible pairs of a row with the most central row (most
    shingles in several rows' prefixes) of each of its columns."""
    heads = columns.groupBy("gram").agg(F.min(F.struct("rank", "doc_id")).alias("h")).select("gram", F.col("h.doc_id").alias("hub"))
    met = columns.join(heads, "gram").where("doc_id != hub").select("doc_id", "hub").distinct()
    full = met.join(_facts(facts, "a_"), F.col("doc_id") == F.col("a_id")).join(_facts(facts, "b_"), F.col("hub") == F.col("b_id"))
    return screen(full.where(_possible("a_", "b_")).select("doc_id", "hub"), facts)


def screen(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs (doc_id, hub) whose wide sketches leave a link possible."""
    sides = [facts.select(F.col("doc_id").alias(f"{p}id"), F.col("n").alias(f"{p}n"), F.col("wide").alias(f"{p}wide")) for p in ("a_", "b_")]
    full = pairs.join(sides[0], F.col("doc_id") == F.col("a_id")).join(sides[1], F.col("hub") == F.col("b_id"))

    def run(batches):
        for b in batches:
            differ = np.array([differing(x, y) for x, y in zip(col(b, "a_wide").to_pylist(), col(b, "b_wide").to_pylist())], np.int64)
            size = col(b, "a_n").to_numpy() + col(b, "b_n").to_numpy()
            near = pa.array((PART + SHARE) * differ <= (PART - SHARE) * size)
            yield b.select(["doc_id", "hub"]).filter(near)

    return full.select("doc_id", "hub", "a_n", "b_n", "a_wide", "b_wide").mapInArrow(run, "doc_id long, hub long")


def open_pairs(columns: DataFrame, facts: DataFrame, size: int = BLOCK) -> DataFrame:
    """(doc_id, hub): all possible pairs of different labels that share a column, by
    comparing blocks of rows; columns of one label have none."""
    several = columns.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
    several = several.select("gram", F.ceil(F.col("rows") / size).cast("long").alias("parts"))
    rows = columns.join(several, "gram").withColumn("mine", F.pmod(F.xxhash64("doc_id"), "parts"))
    rows = rows.select("gram", "doc_id", "label", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    rows = rows.select("gram", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "doc_id", "label")
    full = rows.join(_facts(facts, ""), F.col("doc_id") == F.col("id")).drop("id")
    schema = pa.schema([("doc_id", pa.int64()), ("hub", pa.int64())])

    def run(batches):
        key, held, met = None, [], []

        def close():
            cells = np.array(held, np.int64)
            one = key[1] == key[2]
            x, y = (cells, cells) if one else (cells[cells[:, 0] == 0], cells[cells[:, 0] == 1])
            for lo in range(0, len(x), 128):
                p = x[lo : lo + 128]
                n, m = p[:, 3][:, None], y[:, 3][None, :]
                good = (p[:, 2][:, None] != y[:, 2][None, :]) & (SHARE * np.maximum(n, m) <= PART * np.minimum(n, m))
                if one:
                    good &= p[:, 1][:, None] < y[:, 1][None, :]
                differ = np.zeros(good.shape, np.int64)
                for k in range(4, 4 + len(SKETCH)):
                    differ += np.bitwise_count(p[:, k].view(np.uint64)[:, None] ^ y[:, k].view(np.uint64)[None, :])
                a, b = np.nonzero(good & ((PART + SHARE) * differ <= (PART - SHARE) * (n + m)))
                if len(a):
                    met.append(np.stack((np.minimum(p[a, 1], y[b, 1]), np.maximum(p[a, 1], y[b, 1])), axis=1))

        def distinct():
            """Two rows share many columns: one pair for all that this task has met."""
            pairs = np.unique(np.concatenate(met), axis=0)
            met.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], schema=schema)

        for b in batches:
            names = ("gram", "i", "j", "side", "doc_id", "label", "n", *SKETCH)
            for gram, i, j, *cells in zip(*(col(b, c).to_pylist() for c in names)):
                if (gram, i, j) != key:
                    if held:
                        close()
                    key, held = (gram, i, j), []
                    if sum(map(len, met)) > PAIRS:
                        yield distinct()
                held.append(cells)
        if held:
            close()
        if met:
            yield distinct()

    grouped = full.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j")
    pairs = grouped.mapInArrow(run, "doc_id long, hub long")
    return screen(pairs.distinct(), facts)


def similarity_links(docs: DataFrame, ids: DataFrame, hot: tuple[np.ndarray, np.ndarray], width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """For the texts of ``ids`` (doc_id; distinct sets) in ``docs``: links (a, b) that
    join exactly the documents which all links join, and their components (node, root)."""
    found = stored(prefixes(docs, ids, hot, width), "jaccard-prefix")
    facts = stored(found.where("gram is null").drop("gram").join(ids, "doc_id", "left_semi"), "jaccard-facts")
    entries = found.where("gram is not null").select("gram", "doc_id")
    shared = stored(entries.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram"), "jaccard-columns")
    columns = stored(only(entries, shared).join(ids, "doc_id", "left_semi").distinct(), "jaccard-entries")
    columns = columns.join(one_of_equal(columns), "gram", "left_semi")
    rank = columns.groupBy("doc_id").agg((-F.count(F.lit(1))).alias("rank"))
    columns = stored(columns.join(rank, "doc_id"), "jaccard-ranked")
    edges = cut(verify(cut(hub_pairs(columns, facts)), docs, width).select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
    roots = cut(components(edges))
    rest = cut(open_pairs(_labelled(columns, roots), facts))
    if rest.isEmpty():
        return edges, roots
    more = verify(rest, docs, width).select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    # a component is now a star around its root
    edges = cut(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return edges, cut(components(edges))


def _labelled(columns: DataFrame, labels: DataFrame) -> DataFrame:
    named = columns.join(labels, F.col("doc_id") == F.col("node"), "left")
    return named.withColumn("label", F.coalesce("root", "doc_id")).drop("node", "root")


def jaccard_components(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stored(scan(rows, width), "jaccard-scan")
    each = found.where("key is not null").select("doc_id", "n", "key")
    classes = stored(each.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    reps = stored(classes.select(F.col("rep").alias("doc_id")).distinct(), "jaccard-reps")
    edges, roots = similarity_links(rows, reps, frequent_grams(found), width)
    # a doc_id with several texts ties the classes of all of them together
    twice = each.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id")
    tied = cut(each.where("n > 0").join(twice, "doc_id", "left_semi").join(classes, "key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    if not tied.isEmpty():
        roots = cut(components(edges.unionByName(tied)))
    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("root", "rep").alias("component_id"))
    linked_rows = each.where("n > 0").join(named, "key", "left")
    empty = each.where("n = 0").join(roots, F.col("doc_id") == F.col("node"), "left").withColumn("component_id", F.coalesce("root", "doc_id"))
    out = ["doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")]
    return linked_rows.select(*out).unionByName(empty.select(*out))


def op13(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP13_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [w]
    ELSE [w[i:i + 4] FOR i IN range(1, len(w) - 3)] END) AS g
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
meet AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM meet JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 100 * shared >= 80 * (s.n + t.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sizes
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.m, w.doc_id) AS component_id
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id
LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id) c ON c.doc_id = w.doc_id
"""
