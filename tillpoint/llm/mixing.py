"""Mixing sources to target weights (operator 3), with DataFrame functions only.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share
150 % of all words; a target stops at twice its source's words and the excess is
shared again by weight (water filling over the sources' table, one row a source).

Draw: each source's documents are permuted by a hash and cut into blocks of about
``block_words`` words. A target of f whole sources and a rest takes every block f
times, then the permutation's prefix that fits the rest (of the documents that are no
larger than it), then the one document that fits the remaining gap best. While others fit into what is left, further prefixes are
taken of those of at most half of it, each with the largest one that still fits. The
query op3 keeps to its SQL: there the first document too large for what is left ends
the prefix, and nothing is taken after the best one. Repeated rows of one document are one unit, taken
together. So no document is taken more than twice and a source's words miss its
target by less than one document.

Splitting tree: the root holds each source's exact number of drawn blocks. A node
gives its left half of the output shards a multivariate hypergeometric draw of its
blocks (one conditional hypergeometric variate a source, by inversion around the
mean) and the right half the rest. At the leaves each shard knows, for each source,
how many blocks and which disjoint range of the permuted sequence are its own; it
takes them and shuffles its documents locally. Nothing is sampled or dropped, and
the hash-derived variates make reruns agree.

Hot sources: sums are combined before the shuffle, and prefix sums run in hash
buckets of about 4,096 documents plus one offset a bucket.

Plans stay small and few, as the driver holds them and what they broadcast: each step
is stored, units carry what is known of their source, and a bucket's offset meets its
units in their window instead of a join.

Defined results: a null text has size 0; a null source is a source of its own, last;
documents of size 0 are drawn like others, which adds no word; no words at all: all
targets are 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import SPACE_CLASS, stored, table

WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 1 << 14
SHARD_WORDS = 1 << 20
BUCKET_UNITS = 4096
#: Up to so many sources (a few MB) the one-row-a-source tables are broadcast, so that
#: a hot source's documents stay where they are; beyond it joins shuffle and split.
FEW_SOURCES = 50_000
SEED = "mix"


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Orders like the source's code points, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def order_hash(doc_id: Column) -> Column:
    """60 bits that fix a document's place in its source's permutation."""
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, skey, size) of every row; the only step that reads texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("skey"), n_words(F.col("text").cast("string")).alias("size"))


def targets(units: DataFrame) -> DataFrame:
    """One row a source: idx, source_size, target (whole sources, ``passes``, and a
    ``rest``), and the units it has."""
    per = units.groupBy("skey").agg(F.sum("words").alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    by_name, by_ratio = Window.orderBy("skey"), Window.orderBy("ratio", "idx")
    everything = Window.partitionBy(F.lit(1))
    per = per.withColumn("idx", F.row_number().over(by_name) - 1)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("idx") % len(WEIGHTS) + 1).cast("int")).cast("long"))
    per = per.withColumn("ratio", 2 * F.col("source_size") / F.col("w")).withColumn("total", F.sum("source_size").over(everything))
    per = per.withColumn("capped", F.coalesce(F.sum(2 * F.col("source_size")).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.withColumn("weights", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    level = (3 * F.col("total") - 2 * F.col("capped")) / (2 * F.col("weights"))
    first = F.when(level <= F.col("ratio"), F.struct("ratio", "idx", "capped", "weights"))
    per = per.withColumn("free", F.min(first).over(everything))
    free = F.col("free.ratio").isNotNull() & (F.struct("ratio", "idx") >= F.struct("free.ratio", "free.idx"))
    target = F.when(free, (3 * F.col("total") - 2 * F.col("free.capped")) * F.col("w") / (2 * F.col("free.weights"))).otherwise(2.0 * F.col("source_size"))
    per = per.select("skey", "idx", "source_size", "n_units", target.cast("double").alias("target"))
    per = per.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    return per.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))


def per_source(few: bool):
    """How a one-row-a-source table is joined."""
    return F.broadcast if few else (lambda df: df)


def prefix_sums(rows: DataFrame, sums: dict[str, str]) -> DataFrame:
    """``rows`` (units with their source's ``n_units``) with, for each of ``sums`` (new
    column: summed one), the sum over the units before them in their source's
    permutation. A bucket's offsets are a row of their own, the first of its window."""
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_units") / BUCKET_UNITS))
    rows = rows.withColumn("bucket", F.floor(F.col("h") / F.lit(float(1 << 60)) * buckets).cast("long"))
    totals = rows.groupBy("skey", "bucket").agg(*[F.sum(c).alias(c) for c in sums.values()])
    ahead = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("skey", "bucket", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in sums.values()], F.lit(0).alias("unit"))
    both = rows.withColumn("unit", F.lit(1)).unionByName(offsets, allowMissingColumns=True)
    inside = Window.partitionBy("skey", "bucket").orderBy("unit", "h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumns({name: F.sum(c).over(inside) for name, c in sums.items()}).where("unit = 1").drop("unit", "bucket")


def same_unit(other: str) -> Column:
    return F.struct("doc_id", "size").eqNullSafe(F.struct(f"{other}.doc_id", f"{other}.size"))


def fill(left: DataFrame, state: DataFrame | None, few: bool) -> DataFrame | None:
    """(skey, doc_id, size, words, h, at) of the units taken of ``left`` for the gaps of
    ``state`` (skey, n_units, rest, gap; None if ``left`` has them), ``at`` being their
    place in the rest; None if no unit fits. A gap of which a round leaves more than half
    has no unit of at most half of it left, so the rounds are few."""
    side, unit, more = per_source(few), ["skey", "doc_id", "size", "words", "h"], None
    left = left if state is None else left.join(side(state), "skey")
    pool = stored(left.where("words > 0 and words <= gap").select(*unit, "n_units", "rest", "gap"), "mix-left")
    while not pool.isEmpty():
        half = prefix_sums(pool.withColumn("part", F.expr("if(2 * words <= gap, words, 0L)")), {"ahead": "part"})
        rows = stored(half.withColumn("at", F.expr("if(2 * words <= gap and ahead + words <= gap, rest - gap + ahead, null)")).drop("part", "ahead"), "mix-fill")
        lack = rows.groupBy("skey").agg((F.max("gap") - F.expr("coalesce(sum(words) filter (where at is not null), 0)")).alias("lack"))
        fits = rows.where("at is null").join(side(lack), "skey").where("words <= lack")
        one = fits.groupBy("skey").agg(F.max("lack").alias("lack"), F.min(F.struct(-F.col("words"), "h", "doc_id", "size", "words", (F.col("rest") - F.col("lack")).alias("at"))).alias("one"))
        one = stored(one, "mix-one")
        got = rows.where("at is not null").select(*unit, "at").unionByName(one.select("skey", *[F.col(f"one.{c}") for c in (*unit[1:], "at")]))
        more = got if more is None else more.unionByName(got)
        rows = rows.where("at is null").join(side(one), "skey").where(~same_unit("one")).withColumn("gap", F.col("lack") - F.col("one.words"))
        pool = stored(rows.where("words <= gap").select(*unit, "n_units", "rest", "gap"), "mix-left")
    return more


def draws(units: DataFrame, goal: DataFrame, few: bool, whole: bool) -> tuple[DataFrame, DataFrame]:
    """(units with ``ks``: the numbers of the drawn blocks they belong to; sources
    with ``quota``: how many numbers there are)."""
    side, own = per_source(few), ["skey", "idx", "n_units", "passes", "rest", "source_size"]
    rows = units.join(side(goal.select(own)), "skey").withColumn("part", F.expr("if(words <= rest, words, 0L)"))
    rows = stored(prefix_sums(rows, {"before": "words", "ahead": "part"}).drop("part"), "mix-placed")
    ahead = "ahead" if whole else "before"
    fits = (F.col("words") <= F.col("rest")) & (F.col(ahead) + F.col("words") <= F.col("rest"))
    gap = rows.groupBy("skey").agg((F.max("rest") - F.coalesce(F.sum(F.when(fits, F.col("words"))), F.lit(0))).alias("gap"))
    miss = F.abs(F.col("words") - F.col("gap"))
    short = rows.where(~fits).join(side(gap), "skey").where(miss < F.col("gap"))
    best = F.min(F.struct(miss.alias("miss"), "h", "doc_id", "size", "words")).alias("best")
    state = stored(short.groupBy("skey").agg(F.max("gap").alias("gap"), best), "mix-best")
    rows = rows.join(side(state), "skey", "left")
    chosen = same_unit("best") & F.col("best").isNotNull() & ~fits
    more = None
    if whole:
        more = fill(rows.where(~fits & ~chosen).withColumn("gap", F.col("gap") - F.col("best.words")), None, few)
    rows = rows.withColumn("at", F.when(fits & (F.col("rest") > 0), F.col(ahead)))
    if more is not None:
        more = more.select(F.col("skey").alias("k"), F.struct("doc_id", "size").alias("u"), F.col("at").alias("filled"))
        rows = rows.join(more, (F.col("skey") == F.col("k")) & F.struct("doc_id", "size").eqNullSafe(F.col("u")), "left")
        rows = rows.withColumn("at", F.coalesce("at", "filled"))
    block = F.floor(F.col("before") / BLOCK_WORDS)
    blocks = F.floor(F.col("source_size") / BLOCK_WORDS) + 1
    last = F.col("passes") * blocks + F.floor(F.col("rest") / BLOCK_WORDS) + 1
    again = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("passes") - 1, F.lit(0))), lambda p: p * blocks + block)).otherwise(F.array().cast("array<bigint>"))
    once = F.when(F.col("at").isNotNull(), F.array(F.col("passes") * blocks + F.floor(F.col("at") / BLOCK_WORDS))).when(chosen, F.array(last)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("skey", "idx", "doc_id", "size", "h", F.concat(again, once).alias("ks"))
    goal = goal.withColumn("quota", F.when(F.col("source_size") > 0, last + 1).otherwise(F.lit(0)).cast("long"))
    return rows, goal.select("skey", "idx", "source_size", "target", "quota")


#: One node: for each source a hypergeometric variate (pop blocks of which k are the
#: source's, n to draw), by inversion over ten deviations around the mean. The
#: weights follow from the ratio of neighbouring probabilities, so no gamma function.
_SPLIT = """
aggregate(sequence(0, size(q) - 1),
  named_struct('left', cast(array() as array<bigint>),
               'pop', aggregate(q, 0L, (a, x) -> a + x),
               'n', aggregate(q, 0L, (a, x) -> a + x) div 2),
  (s, j) -> aggregate(array(named_struct('k', q[j],
      'lo', greatest(0L, s.n - (s.pop - q[j])), 'hi', least(q[j], s.n),
      'mid', cast(floor(s.n * (q[j] / greatest(s.pop, 1L))) as bigint),
      'wide', cast(ceil(10 * sqrt(greatest(0D, s.n * (q[j] / greatest(s.pop, 1L)) * (1 - q[j] / greatest(s.pop, 1L)) * ((s.pop - s.n) / greatest(s.pop - 1L, 1L))))) + 12 as bigint))),
    s, (z, r) -> aggregate(array(sequence(greatest(r.lo, least(r.mid - r.wide, r.hi)), greatest(greatest(r.lo, least(r.mid - r.wide, r.hi)), least(r.hi, r.mid + r.wide)))),
      s, (z2, xs) -> aggregate(array(aggregate(xs, named_struct('p', 1D, 'sum', 0D),
          (w, x) -> named_struct('p', w.p * ((r.k - x) * ((s.n - x) * 1D)) / ((x + 1) * (greatest(s.pop - r.k - s.n + x + 1, 1L) * 1D)), 'sum', w.sum + w.p), w -> w.sum)),
        s, (z3, total) -> aggregate(array(xs[0] + aggregate(xs, named_struct('p', 1D, 'sum', 0D, 'n', 0L),
            (w, x) -> named_struct('p', w.p * ((r.k - x) * ((s.n - x) * 1D)) / ((x + 1) * (greatest(s.pop - r.k - s.n + x + 1, 1L) * 1D)), 'sum', w.sum + w.p,
               'n', w.n + if(w.sum + w.p <= total * (((xxhash64('mix', node, j) & 9007199254740991L) + 0.5D) / 9007199254740992D), 1L, 0L)), w -> least(w.n, size(xs) - 1L))),
          s, (z4, got) -> named_struct('left', concat(s.left, array(got)), 'pop', s.pop - r.k, 'n', s.n - got))))),
  s -> array(named_struct('node', 2 * node, 'q', s.left, 'start', start),
             named_struct('node', 2 * node + 1, 'q', zip_with(q, s.left, (a, b) -> a - b), 'start', zip_with(start, s.left, (a, b) -> a + b))))
"""


def leaves(goal: DataFrame, depth: int) -> DataFrame:
    """(idx, shard, start, q): for each shard and source the range of the source's
    drawn blocks that is the shard's own."""
    root = goal.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "quota"))), lambda s: s["quota"]).alias("q"))
    nodes = root.where(F.size("q") > 0).select(F.lit(1).cast("long").alias("node"), "q", F.transform("q", lambda x: x * 0).alias("start"))
    for level in range(depth):
        nodes = nodes.select(F.explode(F.expr(_SPLIT)).alias("s")).select("s.*")
        if level % 6 == 5:  # the nodes spread over tasks
            nodes = nodes.repartition("node")
        if level % 2 or level == depth - 1:  # a lineage cut: a plan of many levels is large
            nodes = stored(nodes, "mix-tree")
    flat = nodes.select((F.col("node") - (1 << depth)).alias("shard"), F.posexplode(F.arrays_zip("q", "start")).alias("idx", "s"))
    return flat.select("idx", "shard", F.col("s.start").alias("start"), F.col("s.q").alias("q"))


def mix(base: DataFrame, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """(drawn copies: skey, doc_id, size, shard, place; sources: skey, source_size,
    target) for ``base`` as :func:`sized` gives it. ``place`` orders a shard's
    documents: its local shuffle."""
    units = base.groupBy("skey", "doc_id", "size").agg((F.count(F.lit(1)) * F.col("size")).alias("words")).withColumn("h", order_hash(F.col("doc_id")))
    units = stored(units, "mix-units")
    goal = stored(targets(units), "mix-targets")
    n_sources, words = goal.agg(F.count(F.lit(1)), F.sum("target")).first()
    rows, quotas = draws(units, goal, n_sources <= FEW_SOURCES, whole)
    depth = max(0, math.ceil(math.log2(max(1.0, (words or 0.0) / SHARD_WORDS))))
    shares = leaves(quotas, depth).where("q > 0").select("idx", "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("q") - 1)).alias("k"))
    copies = rows.select("idx", "skey", "doc_id", "size", F.explode("ks").alias("k"))
    drawn = copies.join(shares, ["idx", "k"]).select("skey", "doc_id", "size", "shard", F.xxhash64(F.lit(SEED), "doc_id", "k").alias("place"))
    return drawn, quotas.select("skey", "source_size", "target")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each row of ``docs`` as often as it was drawn."""
    drawn, _ = mix(sized(docs))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r")).withColumns({"k": source_key(F.col("r.source")), "s": n_words(F.col("r.text").cast("string")), "d": F.col("r.doc_id").cast("long")})
    on = keyed.d.eqNullSafe(drawn.doc_id) & (keyed.k == drawn.skey) & (keyed.s == drawn["size"])
    return keyed.join(drawn, on).select("r.*")


def op3(spark, sf_dir: str) -> DataFrame:
    base = stored(sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), "mix-sized")
    drawn, sources = mix(base, whole=False)  # as OP3_SQL has it
    taken = drawn.groupBy("skey", "doc_id", "size").agg(F.sum("size").alias("taken")).select(F.col("skey").alias("k"), F.col("doc_id").alias("d"), F.col("size").alias("s"), "taken")
    rows = base.join(taken, (base.skey == taken.k) & base.doc_id.eqNullSafe(taken.d) & (base["size"] == taken.s), "left")
    rows = rows.select("skey", "doc_id", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    few = sources.count() <= FEW_SOURCES
    return rows.join(per_source(few)(sources), "skey").select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = """
WITH base AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
units AS (
  SELECT skey, doc_id, size, CAST(n * size AS BIGINT) AS words,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM (SELECT skey, doc_id, size, count(*) AS n FROM base GROUP BY skey, doc_id, size)),
sums AS (SELECT skey, CAST(sum(words) AS BIGINT) AS source_size FROM units GROUP BY skey),
per AS (SELECT skey, source_size, row_number() OVER (ORDER BY skey) - 1 AS idx FROM sums),
weighted AS (SELECT *, [3, 1, 2][CAST(idx % 3 + 1 AS BIGINT)] AS w, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM per),
ordered AS (
  SELECT *, 2 * source_size / w AS ratio,
         CAST(coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped,
         CAST(sum(w) OVER (ORDER BY 2 * source_size / w, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights FROM weighted),
free AS (SELECT ratio, idx, capped, weights FROM ordered WHERE (3 * total - 2 * capped) / (2 * weights) <= ratio ORDER BY ratio, idx LIMIT 1),
goal AS (
  SELECT o.skey, o.source_size,
         CASE WHEN f.idx IS NOT NULL AND (o.ratio > f.ratio OR (o.ratio = f.ratio AND o.idx >= f.idx))
              THEN CAST((3 * o.total - 2 * f.capped) * o.w AS DOUBLE) / (2 * f.weights) ELSE 2.0 * o.source_size END AS target
  FROM ordered o LEFT JOIN free f ON TRUE),
draw AS (
  SELECT u.*, g.source_size, CAST(g.target AS DOUBLE) AS target,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS passes,
         coalesce(sum(u.words) OVER (PARTITION BY u.skey ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM units u JOIN goal g USING (skey)),
rested AS (SELECT *, target - passes * source_size AS rest FROM draw),
fitted AS (SELECT *, before + words <= rest AS fits FROM rested),
gapped AS (SELECT *, rest - coalesce(sum(words) FILTER (fits) OVER (PARTITION BY skey), 0) AS gap FROM fitted),
best AS (
  SELECT skey, doc_id, size FROM gapped WHERE NOT fits AND abs(words - gap) < gap
  QUALIFY row_number() OVER (PARTITION BY skey ORDER BY abs(words - gap), h, doc_id NULLS FIRST, size) = 1),
copies AS (
  SELECT d.skey, d.doc_id, d.size, d.source_size, d.target,
         passes + CASE WHEN (fits AND rest > 0) OR b.skey IS NOT NULL THEN 1 ELSE 0 END AS times
  FROM gapped d LEFT JOIN best b ON d.skey = b.skey AND d.doc_id IS NOT DISTINCT FROM b.doc_id AND d.size = b.size)
SELECT x.doc_id, x.size, c.source_size, c.target, CAST(c.times * x.size AS BIGINT) AS taken
FROM base x JOIN copies c ON x.skey = c.skey AND x.doc_id IS NOT DISTINCT FROM c.doc_id AND x.size = c.size
"""
