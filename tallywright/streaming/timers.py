"""Streams with native state and timers in event time: deadlines that messages move, and updates that are put together.

Keys are dealt by hash, state lies in the RocksDB store that a cluster keeps with the checkpoint, and a key's rows of a
batch are taken in their order of time. What a timer does is also done when a later message shows that its time has passed,
so results don't depend on how messages fall into batches. Where keys are as many as rows they share states by slices, as
a call of the store for each key would take most of the time.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Kinds of messages, in the order in which those of one instant count.
OPENED, SEEN, CLOSED = 0, 1, 2
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHUFFLE = "spark.sql.shuffle.partitions"
KEPT_MS = 24 * 3_600_000
#: No deadline, or no end, in a packed state; slices of the keys of a stream that doesn't say how many.
NONE, SLICES = -(1 << 63), 64


@contextmanager
def native_state(spark: SparkSession, partitions: int | None = None):
    """The session's state store is RocksDB inside; partitions: how many a stream needs, where the session has more.

    Partitions of a state aren't coalesced as those of other shuffles are, and each commits files with every batch.
    """
    new = {PROVIDER: ROCKSDB} | ({SHUFFLE: str(min(partitions, int(spark.conf.get(SHUFFLE))))} if partitions else {})
    held = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


class Deadlines:
    """Keys that lapse: silent for too long after their last message, or past their own deadline and its grace.

    A message after the lapse changes nothing; what is known of an ended key goes a day later. A state holds the keys of a
    slice, packed: key, time of the last message, deadline, and when an ended key goes. Its timer is the first that is due.
    """

    def __init__(self, silent_ms: int, grace_ms: int):
        self.silent, self.grace = silent_ms, grace_ms

    def due(self, last: np.ndarray, deadline: np.ndarray) -> np.ndarray:
        return np.where(deadline == NONE, last + self.silent, np.minimum(last + self.silent, deadline + self.grace))

    def lapsed(self, key: np.ndarray, last: np.ndarray, deadline: np.ndarray) -> pd.DataFrame:
        overran = (deadline != NONE) & (last + self.silent >= deadline + self.grace)
        return pd.DataFrame({"key": key, "lapsed_ms": self.due(last, deadline), "overran": overran})

    def __call__(self, key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.frombuffer(state.get[0], np.int64).reshape(4, -1) if state.exists else np.empty((4, 0), np.int64)
        rows = [np.stack([f[c].astype("int64") for c in ("key", "ms", "deadline", "kind")]) for f in frames]
        told, now = [], state.getCurrentWatermarkMs()
        if rows:
            held, one = self.moved(held, np.concatenate(rows, 1))
            told.append(one)
        held, one = self.expired(held, now)
        told = [x for x in (*told, one) if len(x)]
        if told:
            yield pd.concat(told)
        if held.shape[1]:
            state.update((held.tobytes(),))
            state.setTimeoutTimestamp(max(int(self.timers(held).min()) - 1, now + 1))  # goes off when the time is past it
        elif state.exists:
            state.remove()

    def timers(self, held: np.ndarray) -> np.ndarray:
        _, last, deadline, gone = held
        return np.where(gone == NONE, self.due(last, deadline), gone)

    def moved(self, held: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
        """State and lapses after the messages of a batch; of each key first what is held, then messages in their order."""
        known = held.shape[1]
        key, ms, deadline = np.concatenate([held[:3], rows[:3]], 1)
        kind, gone = np.concatenate([np.full(known, OPENED), rows[3]]), np.concatenate([held[3], np.full(rows.shape[1], NONE)])
        order = np.lexsort((kind, ms, np.arange(len(key)) >= known, key))
        key, ms, deadline, kind, gone = (x[order] for x in (key, ms, deadline, kind, gone))
        place, first = np.arange(len(key)), np.append(True, key[1:] != key[:-1])
        start = np.maximum.accumulate(np.where(first, place, 0))
        opener = np.maximum.accumulate(np.where(kind == OPENED, place, -1))
        opened, deadline = opener >= start, deadline[opener]
        late = np.append(False, opened[:-1] & (ms[1:] > self.due(ms, deadline)[:-1])) & ~first
        ends = np.flatnonzero(late | opened & (kind == CLOSED) | (gone != NONE))
        ends = ends[np.append(True, start[ends][1:] != start[ends][:-1])[: len(ends)]]  # the first of each key
        over = np.zeros(len(key), bool)
        over[start[ends]] = True
        open_ = np.flatnonzero(np.append(first[1:], True) & opened & ~over[start])
        lapse = ends[late[ends]] - 1
        gone = np.where(gone == NONE, ms + KEPT_MS, gone)[ends]
        held = np.concatenate([np.stack([key[open_], ms[open_], deadline[open_], np.full(len(open_), NONE)]), np.stack([key[ends], ms[ends], deadline[ends], gone])], 1)
        return held, self.lapsed(key[lapse], ms[lapse], deadline[lapse])

    def expired(self, held: np.ndarray, now: int) -> tuple[np.ndarray, pd.DataFrame]:
        """State and lapses when it is so late."""
        due, open_ = self.timers(held), held[3] == NONE
        lapse, kept = open_ & (due <= now), open_ | (due > now)
        told = self.lapsed(*held[:3, lapse])
        return np.stack([*held[:3], np.where(lapse, due + KEPT_MS, held[3])])[:, kept], told


class Coalesced(StatefulProcessor):
    """One update for each key and step of time in which something came: the total so far, at the step's end."""

    def __init__(self, step_ms: int):
        self.step = step_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("total", "total long, pending long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        total, pending = self.state.get() if self.state.exists() else (0, None)
        before = pending
        for ms in sorted(r.ms for r in rows):
            now = ms - ms % self.step
            if pending is not None and now > pending:
                yield Row(key=key[0], step_ms=pending, total=total)
            total, pending = total + 1, now
        if pending != before:
            if before is not None:
                self.handle.deleteTimer(before + self.step)
            self.handle.registerTimer(pending + self.step)
        self.state.update((total, pending))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        total, pending = self.state.get()
        yield Row(key=key[0], step_ms=pending, total=total)
        self.state.update((total, None))

    def close(self) -> None:
        pass


def watched(messages: DataFrame, delay: str) -> DataFrame:
    """Messages (key, kind, ms, deadline) with their time as the watermark's."""
    return messages.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", delay)


def lapses(messages: DataFrame, silent_ms: int, grace_ms: int = 0, delay: str = "0 seconds", slices: int = SLICES) -> DataFrame:
    """(key, lapsed_ms, overran) of keys that lapse; messages: key, kind, ms, deadline (null for none). slices: in how many states the keys lie."""
    rows = watched(messages.withColumn("deadline", F.coalesce("deadline", F.lit(NONE))), delay).filter("key is not null").withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices)))
    return rows.groupBy("slice").applyInPandasWithState(Deadlines(silent_ms, grace_ms), "key long, lapsed_ms long, overran boolean", "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def coalesced(messages: DataFrame, step_ms: int = 1000, delay: str = "0 seconds") -> DataFrame:
    """(key, step_ms, total): how many messages (key, ms) a key has had, at most once a step."""
    return watched(messages, delay).groupBy("key").transformWithState(Coalesced(step_ms), "key long, step_ms long, total long", "append", "EventTime")
