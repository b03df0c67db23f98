"""Window building blocks that stay distributed when one key is hot.

A plain ``lead(...) OVER (PARTITION BY key ORDER BY ts)`` sends every row
of a key to one task. If one key holds a third of the data, that task
holds a third of the data. The helpers here sort the rows once by
(key, ts, tie) with a range partitioning, so a hot key is cut by rank into
blocks of even size, however close in time its rows are. Windows run inside a
block; what crosses a block's edge is carried by a table of one row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def _blocks(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The rows in (key, ts, tie) order as ``_rb_id``, and their block ``_rb`` (a
    partition of the distributed sort). Written once, so that windows and edges see
    the same blocks; ``tie`` makes the order total."""
    from tillpoint.session import cut_lineage

    tagged = cut_lineage(df.orderBy(key, ts, tie).withColumn("_rb_id", F.monotonically_increasing_id()))
    return tagged.withColumn("_rb", F.shiftright("_rb_id", _LOCAL_BITS))


def _in_block(key: str):
    return Window.partitionBy("_rb", key).orderBy("_rb_id")


def _edge(blocks: DataFrame, key: str, ts: str, forward: bool) -> DataFrame:
    """One row a block (their number bounds the broadcast): key and time of the next
    block's first row, or of the last row of the block before."""
    pick, step = (F.min_by, F.lead) if forward else (F.max_by, F.lag)
    edge = blocks.groupBy("_rb").agg(pick(F.struct(F.col(key).alias("k"), F.col(ts).alias("t")), "_rb_id").alias("_e"))
    return F.broadcast(edge.select("_rb", step("_e").over(Window.orderBy("_rb")).alias("_e")))


def _neighbour(blocks: DataFrame, key: str, ts: str, out: str, forward: bool) -> DataFrame:
    step = F.lead if forward else F.lag
    near = step(F.struct(F.col(ts).alias("t"))).over(_in_block(key))
    across = F.when(F.col("_e.k").eqNullSafe(F.col(key)), F.col("_e.t"))
    return (blocks.withColumn("_near", near).join(_edge(blocks, key, ts, forward), "_rb")
            .withColumn(out, F.when(F.col("_near").isNotNull(), F.col("_near.t")).otherwise(across))
            .drop("_near", "_e"))


def _carry(blocks: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Keys are sorted, so a key that a block starts with came before only if the
    block before ends with it; its maximum so far is that of the blocks that do."""
    running = _in_block(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = blocks.withColumn("_near", F.max(value).over(running))
    of_key = near.groupBy("_rb", key).agg(F.max("_near").alias("m"), F.max("_rb_id").alias("_at"))
    last = of_key.groupBy("_rb").agg(F.max_by(F.struct(F.col(key).alias("k"), "m"), "_at").alias("_e"))
    # one row a block from here on
    so_far = F.max("_e.m").over(Window.partitionBy("_e.k").orderBy("_rb"))
    before = last.select("_rb", F.struct(F.col("_e.k").alias("k"), so_far.alias("m")).alias("_e"))
    before = before.select("_rb", F.lag("_e").over(Window.orderBy("_rb")).alias("_e"))
    across = F.when(F.col("_e.k").eqNullSafe(F.col(key)), F.col("_e.m"))
    return (near.join(F.broadcast(before), "_rb").withColumn(out, F.greatest("_near", across)).drop("_near", "_e"))


def next_within_key(df: DataFrame, key: str, ts: str, tie: str, out: str) -> DataFrame:
    """Add ``out`` = the ``ts`` of the next row of the same ``key`` in
    ``(ts, tie)`` order (NULL for the last row): ``lead(ts)`` by key."""
    return _neighbour(_blocks(df, key, ts, tie), key, ts, out, True).drop("_rb", "_rb_id")


def first_by_order(df: DataFrame, keys: list[str], order: list[Column], flag: str) -> DataFrame:
    """Add boolean ``flag``: this row is the first of its ``keys`` group by
    ``order`` (a full, unique ordering).

    Uses a grouped ``min`` of the ordering struct (partial aggregation on the
    map side, so a hot key is combined before the shuffle) joined back,
    instead of ``row_number`` over one partition per key.
    """
    ordered = df.withColumn("_fbo_ord", F.struct(*order))
    firsts = ordered.groupBy(*keys).agg(F.min("_fbo_ord").alias("_fbo_min"))
    return (ordered.join(firsts, keys, "left")
            .withColumn(flag, F.col("_fbo_ord") == F.col("_fbo_min"))
            .drop("_fbo_ord", "_fbo_min"))


def global_row_number(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``row_number() OVER (ORDER BY order)`` without a single-task window.

    The rows are range-partitioned and sorted by ``order`` (a distributed
    sort), tagged with ``monotonically_increasing_id`` (partition index in the
    high bits, position in the low bits) and checkpointed so both passes
    below see the same ids. Per-partition counts (one row per partition, a
    proven bound) give each partition its offset through a broadcast join.
    ``order`` must be a total order (unique tie-break) for a stable answer.
    """
    from tillpoint.session import cut_lineage

    tagged = cut_lineage(df.orderBy(*order).withColumn("_grn_id", F.monotonically_increasing_id()))
    pid = F.shiftright(F.col("_grn_id"), _LOCAL_BITS)
    local = F.col("_grn_id").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    counts = tagged.groupBy(pid.alias("_grn_pid")).agg(F.count(F.lit(1)).alias("_grn_n"))
    # one row per partition: a window without PARTITION BY is bounded here
    offsets = counts.select(
        "_grn_pid",
        F.coalesce(F.sum("_grn_n").over(Window.orderBy("_grn_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_grn_off"))
    return (tagged.withColumn("_grn_pid", pid)
            .join(F.broadcast(offsets), "_grn_pid", "inner")
            .withColumn(out, F.col("_grn_off") + local + 1)
            .drop("_grn_id", "_grn_pid", "_grn_off"))


def prev_within_key(df: DataFrame, key: str, ts: str, tie: str, out: str) -> DataFrame:
    """Add ``out`` = ``lag(ts)`` within ``key`` in ``(ts, tie)`` order."""
    return _neighbour(_blocks(df, key, ts, tie), key, ts, out, False).drop("_rb", "_rb_id")


def carry_forward_max(df: DataFrame, key: str, ts: str, tie: str, value: str, out: str) -> DataFrame:
    """Add ``out`` = running ``max(value)`` over the key's rows up to this one
    in ``(ts, tie)`` order."""
    return _carry(_blocks(df, key, ts, tie), key, value, out).drop("_rb", "_rb_id")


def gap_sessions(df: DataFrame, key: str, ts: str, tie: str, gap_seconds: float, out: str) -> DataFrame:
    """Gap-and-island sessions: a row opens a new session when it is the key's
    first row or comes ``gap_seconds`` or more after the previous row. Adds
    ``out`` = the start time of the row's session (a session key)."""
    with_prev = _neighbour(_blocks(df, key, ts, tie), key, ts, "_gs_prev", False)
    # NTZ - NTZ is a day-time interval: no time zone (or DST) is involved
    gap = F.expr(f"INTERVAL '{int(round(gap_seconds * 1_000_000))}' MICROSECOND")
    opens = F.col("_gs_prev").isNull() | ((F.col(ts) - F.col("_gs_prev")) >= gap)
    flagged = with_prev.withColumn("_gs_start", F.when(opens, F.col(ts)))
    return _carry(flagged, key, "_gs_start", out).drop("_gs_prev", "_gs_start", "_rb", "_rb_id")
