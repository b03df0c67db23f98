"""SimHash near-duplicates (operator 4) by the generalised pigeonhole principle.

Fingerprints have 64 bits; two documents are linked when theirs differ in at most
``distance`` (2) bits. The bits are grouped into parts so that correlated bits lie
together (else several parts would say the same thing), and part i gets its own
threshold T_i >= -1 with sum(T_i) = distance - parts + 1: of two fingerprints within
the distance, at least one part differs in at most T_i bits. A dynamic programme
picks the number of parts and the thresholds with the least estimated cost, from bit
frequencies counted over all distinct fingerprints.

Probe: a fingerprint stays a candidate when, in some part, another distinct
fingerprint lies within T_i (its part value, or the value with T_i bits flipped, is
taken). Verify: two fingerprints differ in at most two bits exactly when some
64-bit value is within one bit of both. Candidates therefore meet at their 65
values within one bit, and all that meet are linked to the least among them: at
most 65 rows a candidate and 65 members a meeting, so a large group of near copies
is never expanded into pairs, and no link is lost. Components follow from stars.

Defined results: a null or empty text has fingerprint zero and is linked like any
other; equal fingerprints are one class; a component of rows without a doc_id has
a null component_id.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tillpoint.llm.common import col, prepare, slices, stored, table, texts
from tillpoint.llm.components import components

SHINGLE_WORDS = 3
DISTANCE = 2
SEED = 42
#: The plan is made for at least so many fingerprints: a smaller input would get wide
#: parts whose candidates grow with the square of the input.
DESIGN = 1 << 24


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """SimHash of a text's word shingles, repeats included."""
    words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s : e - 1], SEED) for s, e in zip([0, *ends], ends[width - 1 :])]
    h = np.array(hashes, dtype=">u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(t, width) for t in texts(b)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([col(b, "doc_id"), pa.array(fp.view(np.int64))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(number of fingerprints, 64 x 64 counts of two bits being set together)."""

    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            h = col(b, "fp").to_numpy().astype(np.int64).astype(">i8")
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_pydict({"bit": list(range(64)), "n": [n] * 64, "both": total.astype(np.int64).tolist()})

    parts = fps.select("fp").mapInArrow(run, "bit long, n long, both array<long>")
    rows = parts.groupBy("bit").agg(F.sum("n").alias("n"), *[F.sum(F.col("both")[j]).alias(f"b{j}") for j in range(64)]).collect()
    both = np.zeros((64, 64))
    n = 0
    for r in rows:  # 64 rows at any input size
        both[r.bit] = [r[f"b{j}"] for j in range(64)]
        n = r.n
    return n, both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal size; a part grows by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, out = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        part = [max(free, key=lambda j: (corr[j, list(free)].sum(), -j))]
        free.discard(part[0])
        while len(part) < size:
            best = max(free, key=lambda j: (corr[j, part].mean(), -j))
            part.append(best)
            free.discard(best)
        out.append(sorted(part))
    return out


def plan(n: int, both: np.ndarray, distance: int = DISTANCE, design: int | None = None) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of least estimated cost for ``design`` fingerprints with the
    bit statistics of the given ones: rows probed, and 65 rows for each fingerprint
    expected to have a candidate partner in the part."""
    design = design or n
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    best = (math.inf, [])
    for parts in range(1, distance + 3):
        groups = group_bits(n, both, parts)
        cost = []
        for bits in groups:
            within = np.zeros(distance + 1)
            within[0] = 1.0
            for j in bits:  # distribution of the number of differing bits
                within = within * (1 - differ[j]) + np.concatenate(([0.0], within[:-1])) * differ[j]
            row = {-1: 0.0}
            for t in range(distance + 1):
                probes = sum(math.comb(len(bits), k) for k in range(t + 1))
                partners = max(design - 1, 0) * within[: t + 1].sum()
                row[t] = design * (probes + 65 * -math.expm1(-partners))
            cost.append(row)
        # states: sum of the thresholds so far -> (cost, thresholds)
        states = {0: (0.0, [])}
        for row in cost:
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in states.items():
                for t, more in row.items():
                    new = (c + more, [*ts, t])
                    if s + t not in step or new < step[s + t]:
                        step[s + t] = new
            states = step
        found = states.get(distance - parts + 1)
        if found and found[0] < best[0]:
            best = (found[0], list(zip(groups, found[1])))
    return [(bits, t) for bits, t in best[1] if t >= 0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mask(bits) -> int:
    return _signed(sum(1 << j for j in bits))


def _flips(value: Column, bits: list[int], upto: int) -> Column:
    masks = [_mask(c) for k in range(1, upto + 1) for c in itertools.combinations(bits, k)]
    return F.array(*[value.bitwiseXOR(F.lit(m)) for m in masks])


def candidates(fps: DataFrame, steps: list[tuple[list[int], int]]) -> DataFrame:
    """Distinct ``fp`` with another one within the threshold of some part."""
    found = None
    for bits, threshold in steps:
        part = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        taken = fps.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
        rows = fps.select("fp", part.alias("part")).join(taken.where("n > 1").select("part"), "part", "left_semi").select("fp")
        if threshold > 0:
            probes = fps.select("fp", F.explode(_flips(part, bits, threshold)).alias("part"))
            rows = rows.unionAll(probes.join(taken.select("part"), "part", "left_semi").select("fp"))
        found = rows if found is None else found.unionAll(rows)
    return found.distinct()


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints within two bits."""
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << j))) for j in range(64)])
    met = fps.select("fp", F.explode(near).alias("v")).groupBy("v").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return met.select(F.array_min("all").alias("b"), F.explode("all").alias("a")).where("a != b").select("a", "b").distinct()


def classes_of(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, component_id, root) of every row of ``docs`` (doc_id, text); ``root``
    is a fingerprint that names the component, also where ids are used twice."""
    rows = stored(fingerprints(docs, width), "simhash-fp")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-class")
    n, both = bit_counts(classes)
    if n < 2:
        return rows.join(classes, "fp").select("doc_id", "fp", F.col("rep").alias("component_id"), F.col("fp").alias("root"))
    near = candidates(classes.select("fp"), plan(n, both, DISTANCE, max(n, DESIGN)))
    roots = components(links(near))
    grouped = classes.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.col("root"))
    component = F.coalesce("component_id", F.when(F.col("root").isNull(), F.col("rep"))).alias("component_id")
    named = joined.join(least, "root", "left").select("fp", component, F.coalesce("root", "fp").alias("root"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text)."""
    return classes_of(docs, width).select("doc_id", "fp", "component_id")


def rows_with_fingerprint(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, r): the rows of ``docs``, whole, in the struct ``r``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    schema = StructType([StructField("doc_id", LongType()), StructField("fp", LongType()), rows.schema["r"]])

    def run(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(t, width) for t in texts(b)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([col(b, "doc_id"), pa.array(fp.view(np.int64)), col(b, "r")], names=["doc_id", "fp", "r"])

    return rows.mapInArrow(run, schema)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: the least doc_id of each component
    stays, of several rows with that id in the component the least by its columns. Where
    different texts share a doc_id, each is judged by its own fingerprint. Rows without
    a doc_id cannot be named by a link and stay."""
    found = stored(classes_of(docs.select("doc_id", "text")), "simhash-component")
    copies = found.where("doc_id != component_id").select("doc_id").distinct()
    repeats = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeats.isEmpty():
        return docs.join(copies, "doc_id", "left_anti").select(docs.columns)
    once = docs.join(repeats, "doc_id", "left_anti").join(copies, "doc_id", "left_anti").select(docs.columns)
    again = rows_with_fingerprint(docs.join(repeats, "doc_id", "left_semi").select(docs.columns))
    first = found.where("doc_id = component_id").select("doc_id", "fp", "root").distinct()
    one = again.join(first, ["doc_id", "fp"]).groupBy("doc_id", "root").agg(F.min("r").alias("r")).select("r.*")
    return once.unionByName(one.select(docs.columns))


def op4(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
