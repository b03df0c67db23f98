"""Phrase collocation mining (operator 12) by SON partitioning.

Per language, phrases of two and three words that occur SUPPORT times or more, each
scored at its weakest cut:

1. Shards. Documents fall into SHARDS shards by a hash. A shard with the share p of all
   bytes has the local support floor((SUPPORT - 1) * p) + 1. A phrase below it in every
   shard occurs at most SUPPORT - 1 times in all, so no frequent phrase is lost.
2. Each shard is mined completely, level by level: its pairs are counted, then the
   triples both of whose pairs are frequent in the shard. A shard is a distributed
   table, not a task: blocks of texts add up their occurrences, the rest is a grouped
   sum over 64-bit phrase codes.
3. The shards' frequent phrases are united in a bit table of fixed size (2^BITS), which
   every task gets. A code that falls on another's bit only adds a candidate.
4. All occurrences of candidates are counted over the whole corpus, by language and by
   the phrase itself, and SUPPORT is applied to these exact counts.
5. Cuts are scored in exact decimals: 10^6 a^2 / (l r) is at most 10^6.

Defined results: a null text has no words; a null language is ``und``; words that are
not separated by blanks or tabs, and pieces of one word, form no phrase; an empty table
has no phrases. Repeated rows count as often as they are there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import col, prepare, slices, stored, table, texts

SUPPORT = 10
#: A candidate goes if it lies in a longer one with at least this many hundredths of it.
INSIDE = 50
TOP = 2000
SHARDS = 4
BITS = 27
BLOCK_BYTES = 8 << 20

#: A-Z to lower case, tabs to blanks, piece ends to \n.
_PIECES = bytes(32 if i == 9 else 10 if 10 <= i <= 13 or chr(i) in ".,;:!?" else i + 32 if 65 <= i <= 90 else i for i in range(256))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


class Block:
    """Words of a block of texts: ``ids`` into ``words`` (a piece end is a word of its
    own), ``doc`` the text, and the places where a run of 2 or 3 words starts."""

    def __init__(self, batch: pa.RecordBatch):
        ready = [t.translate(_PIECES).replace(b"\n", b" \n ") for t in texts(batch)]
        split = pc.split_pattern(pa.array(ready, pa.large_binary()), pattern=b" ")
        sizes = np.diff(split.offsets.to_numpy())
        coded = split.flatten().dictionary_encode()
        self.words = coded.dictionary
        known = self.words.to_pylist()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(ready)), sizes)
        if b"" in known:
            full = ids != known.index(b"")
            ids, doc = ids[full], doc[full]
        self.ids, self.doc = ids, doc
        self.word = ids != (known.index(b"\n") if b"\n" in known else -1)
        self.pair = self.word[:-1] & self.word[1:] & (doc[:-1] == doc[1:])
        self.triple = self.pair[:-1] & self.pair[1:]
        langs = [x if x is not None else "und" for x in col(batch, "lang").to_pylist()]
        self.names = sorted(set(langs))
        self.lang = np.array([self.names.index(x) for x in langs], np.int64)[doc] if len(doc) else np.zeros(0, np.int64)
        seeds = np.array([xxhash.xxh64_intdigest(x.encode(), 7) for x in self.names], np.uint64)
        h = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64)
        self.h, self.seed = h[ids], seeds[self.lang]
        self.shard = col(batch, "shard").to_numpy().astype(np.uint64)[doc] if len(doc) else np.zeros(0, np.uint64)

    def pair_codes(self) -> np.ndarray:
        """Codes of all neighbouring words; two free low bits."""
        return _mix((self.seed[:-1] + self.h[:-1]) * _ODD[0] + self.h[1:]) << np.uint64(2)

    def triple_codes(self) -> np.ndarray:
        return _mix(((self.seed[:-2] + self.h[:-2]) * _ODD[0] + self.h[1:-1]) * _ODD[1] + self.h[2:]) << np.uint64(2)


def _in_shard(codes: np.ndarray) -> np.ndarray:
    """Bit of a code with its shard: each shard has a part of the table."""
    return ((codes >> np.uint64(2)) & np.uint64((1 << BITS) // SHARDS - 1)) + (codes & np.uint64(SHARDS - 1)) * np.uint64((1 << BITS) // SHARDS)


def _anywhere(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(2)) & np.uint64((1 << BITS) - 1)


def _test(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def local_counts(docs: DataFrame, pairs: np.ndarray | None = None) -> DataFrame:
    """(code, n): occurrences of pairs by shard, or, given the table of the shards'
    frequent pairs, of the triples made of them."""
    table_of = None if pairs is None else docs.sparkSession.sparkContext.broadcast(pairs)
    schema = pa.schema([("code", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for b in slices(batches, max_bytes=BLOCK_BYTES):
            block = Block(b)
            codes = block.pair_codes() | block.shard[:-1] if len(block.ids) > 1 else np.zeros(0, np.uint64)
            if table_of is None:
                codes = codes[block.pair]
            elif len(block.ids) > 2:
                good = _test(table_of.value, _in_shard(codes))
                codes = (block.triple_codes() | block.shard[:-2])[block.triple & good[:-1] & good[1:]]
            else:
                codes = codes[:0]
            u, n = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], schema=schema)

    return docs.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, support: list[int]) -> DataFrame:
    """The codes that reach their shard's local support."""
    shard = F.col("code").bitwiseAND(F.lit(SHARDS - 1))
    least = F.element_at(F.array(*[F.lit(s) for s in support]), (shard + 1).cast("int"))
    return counts.where(F.col("n") >= least).select("code")


def bit_table(codes: DataFrame, by_shard: bool) -> np.ndarray:
    """The codes' bits as 2^(BITS - 6) words, or-ed on the executors."""
    part = (1 << BITS) // SHARDS
    low = F.shiftrightunsigned("code", 2)
    at = low.bitwiseAND(F.lit(part - 1)) + F.col("code").bitwiseAND(F.lit(SHARDS - 1)) * part if by_shard else low.bitwiseAND(F.lit((1 << BITS) - 1))
    bit = F.expr("shiftleft(1L, CAST(at & 63 AS INT))")
    rows = codes.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["bit"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def exact_counts(docs: DataFrame, candidates: np.ndarray) -> DataFrame:
    """(lang, phrase, size, n): all words, and all phrases that reach SUPPORT."""
    table_of = docs.sparkSession.sparkContext.broadcast(candidates)
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("n", pa.int64())])

    def run(batches):
        for b in slices(batches, max_bytes=BLOCK_BYTES):
            block = Block(b)
            if not len(block.ids):
                continue
            width, ids, lang = np.int64(len(block.words)), block.ids, block.lang

            def rows(size, first, n):
                """One row for each distinct phrase, told by its first place."""
                parts = [block.words.take(pa.array(ids[first + k])) for k in range(size)]
                text = pc.binary_join_element_wise(*parts, pa.scalar(b" ", parts[0].type)) if size > 1 else parts[0]
                names = pa.array(block.names, pa.string()).take(pa.array(lang[first]))
                return pa.RecordBatch.from_arrays([names, text.cast(pa.large_string()).cast(pa.string()), pa.array(np.full(len(n), size, np.int32)), pa.array(n)], schema=schema)

            def distinct(exact, at):
                _, first, n = np.unique(exact, return_index=True, return_counts=True)
                return at[first], n

            at = np.flatnonzero(block.word)
            yield rows(1, *distinct(lang[at] * width + ids[at], at))
            pair = block.pair.copy()
            pair[pair] = _test(table_of.value, _anywhere(block.pair_codes()[pair]))
            at = np.flatnonzero(pair)
            yield rows(2, *distinct((lang[at] * width + ids[at]) * width + ids[at + 1], at))
            if len(ids) > 2:
                triple = block.triple.copy()
                triple[triple] = _test(table_of.value, _anywhere(block.triple_codes()[triple]))
                at = np.flatnonzero(triple)
                _, lead = np.unique((lang[at] * width + ids[at]) * width + ids[at + 1], return_inverse=True)
                yield rows(3, *distinct(lead * width + ids[at + 2], at))

    found = docs.mapInArrow(run, "lang string, phrase string, size int, n long").groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    return found.where((F.col("size") == 1) | (F.col("n") >= SUPPORT))


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of every candidate at its weakest cut."""
    words = F.split("phrase", " ")
    cand = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), words.alias("w"))
    cuts = cand.select("lang", "phrase", "size", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    join = lambda lo, n: F.concat_ws(" ", F.slice("w", lo, n))
    sides = cuts.select("lang", "phrase", "size", "a", "k", F.posexplode(F.array(join(F.lit(1), F.col("k")), join(F.col("k") + 1, F.col("size") - F.col("k")))).alias("side", "part"))
    met = sides.join(counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"])
    both = met.groupBy("lang", "phrase", "size", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    number = lambda c: f"CAST({c} AS DECIMAL(18, 0))"
    score = F.expr(f"({number(1000000)} * {number('a')} * {number('a')}) div ({number('l')} * {number('r')})")
    weakest = both.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return weakest.select("lang", "phrase", "size", "a", "c.l", "c.r", "c.score")


def phrases(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` collocations."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int").alias("shard")).where("text is not null")
    sizes = {r.shard: r.b for r in rows.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).collect()}  # SHARDS rows
    total = max(sum(sizes.values()), 1)
    support = [(SUPPORT - 1) * sizes.get(s, 0) // total + 1 for s in range(SHARDS)]
    pairs = stored(frequent(local_counts(rows), support), "phrases-pairs")
    triples = stored(frequent(local_counts(rows, bit_table(pairs, True)), support), "phrases-triples")
    candidates = bit_table(pairs, False) | bit_table(triples, False)
    counts = stored(exact_counts(rows, candidates), "phrases-counts")
    n = counts.where("size = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    frequents = counts.where(F.col("n") >= SUPPORT)
    cand = scored(frequents)
    longer = frequents.where("size = 3").select("lang", "n", F.split("phrase", " ").alias("w"))
    inner = longer.select("lang", "n", F.explode(F.array(F.concat_ws(" ", F.slice("w", 1, 2)), F.concat_ws(" ", F.slice("w", 2, 2)))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longest"))
    left = cand.join(most, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longest") < INSIDE * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # a plain row_number limit: Spark cuts every task's rows by it before they move if
    # ``top`` is within spark.sql.optimizer.windowGroupLimitThreshold
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (
  SELECT lang, size, unnest([array_to_string(w[i:i + size - 1], ' ') FOR i IN range(1, len(w) - size + 2)]) AS phrase
  FROM words CROSS JOIN (VALUES (1), (2), (3)) s(size) WHERE len(w) >= size),
f AS (SELECT lang, size, phrase, count(*) AS n FROM runs GROUP BY ALL),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM cand),
parts AS (
  SELECT c.lang, c.size, c.phrase, c.a, c.k, x.n AS l, y.n AS r,
    CAST((1000000::HUGEINT * c.a * c.a) // (x.n::HUGEINT * y.n) AS BIGINT) AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:c.size], ' ')),
weakest AS (
  SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(n) AS longest FROM (
    SELECT lang, a AS n, array_to_string(w[1:2], ' ') AS phrase FROM cand WHERE size = 3
    UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM cand WHERE size = 3) GROUP BY ALL),
ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank
  FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase
  WHERE i.longest IS NULL OR 100 * i.longest < 50 * w.a)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score
FROM ranked r JOIN total t ON t.lang = r.lang WHERE r.rank <= 2000
"""
