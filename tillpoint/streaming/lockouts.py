"""ST1: lockout detection over login / PIN attempts.

Per key, in time order:
* an attempt while the key is locked is refused and changes nothing;
* a lock whose end has passed is cleared before the attempt counts;
* a success clears the key;
* a failure within ``window`` of the first failure of the current window
  (inclusive) adds one, otherwise it starts a new window at 1;
* reaching ``max_failures`` locks the key for ``lock`` from that failure.

This is a sequential fold, which no window function expresses. It is
still split into independent pieces: an attempt more than
``max(window, lock)`` after the key's previous attempt always starts from
a clean state (any window has run out, any lock has ended). So each key's
history is cut at such gaps (a gap-and-island pass over even blocks, see
``operators.windows``), and the chunks are folded in parallel, each by a
sorted pass with bounded memory. A key under constant attack is still cut
at every quiet quarter hour; no key is gathered whole.

The streaming form holds rows until the watermark passes them, folds them in
order onto the same three values and drops a key's state after a quiet period
(``transformWithState`` with event-time timers).
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tillpoint import params as P
from tillpoint.operators.windows import gap_sessions


@dataclass(frozen=True)
class Preset:
    max_failures: int
    window_minutes: int
    lock_minutes: int

    @property
    def quiet_seconds(self) -> float:
        """Gap after which an attempt always starts clean, plus 1 µs so the
        boundary case (exactly ``window`` later, still inside) stays joined."""
        return max(self.window_minutes, self.lock_minutes) * 60 + 1e-6


ACCOUNT = Preset(*P.ACCOUNT_LOCKOUT)
ADDRESS = Preset(*P.ADDRESS_LOCKOUT)
PIN = Preset(*P.PIN_LOCKOUT)

LOCK_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("locked_at", T.TimestampNTZType()),
    T.StructField("locked_until", T.TimestampNTZType()),
    T.StructField("failures", T.IntegerType()),
])


def detect_lockouts(attempts: DataFrame, preset: Preset = ACCOUNT) -> DataFrame:
    """Batch ST1: every lock event ``(key, locked_at, locked_until, failures)``.

    ``attempts`` has ``key``, ``ts`` (TIMESTAMP_NTZ) and ``success``. Each key is cut
    into chunks at its quiet gaps (windows by key and minute, so a burst on one key
    is spread over its minutes); chunks are hash-partitioned and sorted, and each
    task folds its sorted rows batch by batch, carrying the three-value state. One
    way for chunks of every size: a task holds one Arrow batch, never a chunk.
    """
    from tillpoint.session import ship_package
    chunked = gap_sessions(attempts.select("key", "ts", "success"), "key", "ts", "success",
                           preset.quiet_seconds, "chunk")
    ship_package(attempts.sparkSession)

    def fold_partition(batches):
        current, state = None, (None, 0, None)
        for pdf in batches:
            out = []
            micros = (pd.to_datetime(pdf["ts"]).astype("datetime64[us]").astype("int64")).tolist()
            for key, chunk, ts, success in zip(pdf["key"], pdf["chunk"], micros, pdf["success"].tolist()):
                if (key, chunk) != current:
                    current, state = (key, chunk), (None, 0, None)
                state, events = fold_rows(state, [(ts, bool(success))], preset)
                out += [(key, *e) for e in events]
            if out:
                key, begin, end, n = zip(*out)
                yield pd.DataFrame({"key": key, "locked_at": pd.to_datetime(begin, unit="us"),
                                    "locked_until": pd.to_datetime(end, unit="us"), "failures": n})

    ordered = chunked.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "ts", "success")
    return ordered.mapInPandas(fold_partition, LOCK_SCHEMA)


# -- streaming form -----------------------------------------------------------
_OUT_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("locked_at", T.TimestampType()),
    T.StructField("locked_until", T.TimestampType()),
    T.StructField("failures", T.IntegerType()),
])


def fold_rows(state: tuple[int | None, int, int | None], rows: list[tuple[int, bool]], preset: Preset):
    """Plain-Python step over (ts_micros, success) rows, used by the stream.
    Returns ``(new_state, [(locked_at_us, locked_until_us, failures), ...])``."""
    first, n, until = state
    w = preset.window_minutes * 60_000_000
    lk = preset.lock_minutes * 60_000_000
    events = []
    for ts, success in rows:
        if until is not None and until > ts:
            continue
        if until is not None:
            first, n, until = None, 0, None
        if success:
            first, n, until = None, 0, None
            continue
        if first is not None and ts - first <= w:
            n += 1
        else:
            first, n = ts, 1
        if n >= preset.max_failures:
            until = ts + lk
            events.append((ts, until, n))
    return (first, n, until), events


class LockoutProcessor(StatefulProcessor):
    """One key's attempts. Rows wait in state until the watermark has passed them, so
    that they are folded in time order however they arrived; a timer at the earliest
    waiting row wakes the key. When nothing waits, a timer a quiet period after the
    last attempt drops the key's state (from there every attempt starts clean)."""

    def __init__(self, preset: Preset):
        self._preset = preset

    def init(self, handle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "ts long, success boolean")
        self._fold = handle.getValueState("fold", "first_us long, n int, until_us long, last_us long")

    def handleInputRows(self, key, rows, timerValues):
        earliest = None
        for pdf in rows:
            micros = pd.to_datetime(pdf["ts"]).astype("datetime64[us]").astype("int64").tolist()
            if micros and key[0] is not None:
                self._waiting.appendList([(t, bool(s)) for t, s in zip(micros, pdf["success"].tolist())])
                earliest = min(micros) if earliest is None else min(earliest, min(micros))
        if earliest is not None:
            self._handle.registerTimer(earliest // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(((t, s) for t, s in self._waiting.get()))
        due = [r for r in rows if r[0] <= passed]
        later = rows[len(due):]
        first, n, until, last = self._fold.get() if self._fold.exists() else (None, 0, None, None)
        events = []
        if due:
            (first, n, until), events = fold_rows((first, n, until), due, self._preset)
            last = due[-1][0]
            self._fold.update((first, n, until, last))
            if later:
                self._waiting.put(later)
            else:
                self._waiting.clear()
        quiet_ends = None if last is None else last // 1000 + int(self._preset.quiet_seconds * 1000) + 2
        if later:
            self._handle.registerTimer(later[0][0] // 1000 + 1)
        elif quiet_ends is not None and quiet_ends * 1000 <= passed:
            self._fold.clear()
        elif quiet_ends is not None:
            self._handle.registerTimer(quiet_ends)
        if events:
            yield pd.DataFrame({"key": [key[0]] * len(events), "locked_at": pd.to_datetime([e[0] for e in events], unit="us"),
                                "locked_until": pd.to_datetime([e[1] for e in events], unit="us"), "failures": [e[2] for e in events]})

    def close(self) -> None:
        pass


#: How far behind the latest attempt a row may arrive and still count.
LATENESS = "30 minutes"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def lockout_stream(attempts: DataFrame, preset: Preset = ACCOUNT, lateness: str = LATENESS) -> DataFrame:
    """Streaming ST1 over a stream of ``key, ts (TIMESTAMP), success``: the lock events
    of the batch form, for rows that arrive in any order within ``lateness`` (later ones
    are dropped). Rows without a key (heartbeats) only move the watermark. State: the
    rows of the last ``lateness``, and three values a key until it was quiet."""
    timed = attempts.withWatermark("ts", lateness)  # a filter on the key would be pushed below it
    # by value: the worker that sets up the state runs beside the driver, without the
    # files that were shipped to executors
    here = sys.modules[__name__]
    cloudpickle.register_pickle_by_value(here)
    try:
        return timed.groupBy("key").transformWithStateInPandas(
            statefulProcessor=LockoutProcessor(preset), outputStructType=_OUT_SCHEMA, outputMode="Append", timeMode="EventTime")
    finally:
        cloudpickle.unregister_pickle_by_value(here)


def start_lockouts(attempts: DataFrame, out: str, trigger: dict, preset: Preset = ACCOUNT, lateness: str = LATENESS):
    """Start ST1 into ``<out>/locks`` and return the query handle. The state store with
    timers is RocksDB's; the session's setting is put back once the query has it."""
    spark = attempts.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return (lockout_stream(attempts, preset, lateness).writeStream.outputMode("append").format("parquet")
                .option("checkpointLocation", f"{out}/_checkpoint").trigger(**trigger).start(f"{out}/locks"))
    finally:
        spark.conf.set(_PROVIDER, before)


def read_lockouts(spark, out: str) -> DataFrame:
    return spark.read.schema(_OUT_SCHEMA).parquet(f"{out}/locks")
