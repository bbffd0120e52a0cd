"""Stateful stream operators with timers: thresholds of running sums, silences. A key's state goes when it has been still for long enough.

State is kept in RocksDB on the executors (`prepared` sets it), a few numbers a key. What Spark asks of Python for one group (its call, its frame, its
timers, each question about its state) costs milliseconds, so keys are dealt into a fixed number of buckets by hash and a bucket is one group: a list state
with an element for each key, and one timer, for the key that is due first. A batch rewrites the lists of the buckets that it has rows for; `buckets` should keep them
at some thousands of keys, and stays what it was for as long as a checkpoint is used. Keys travel as strings, so that a null key is one like any other.

Rows of a batch are taken in order of time, then of a tie column; rows later than the watermark are dropped before they come here.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quern.session import prepare

#: Groups that keys are dealt into.
BUCKETS = 1024
BUCKET = "_bucket"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(spark: SparkSession) -> SparkSession:
    """Sets the state store that operators with timers need; before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return prepare(spark)


class Timed(StatefulProcessor):
    """The keys of a bucket: one list state, and one event-time timer for the first that is due."""

    SHAPE = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getListState("state", f"k string, {self.SHAPE}")

    def held(self) -> list[tuple]:
        return list(self.state.get()) if self.state.exists() else []

    def keep(self, rows: list[tuple]) -> None:
        self.state.put(rows) if rows else self.state.clear()

    def set_timer(self, at_ms: int | None) -> None:
        known = list(self.handle.listTimers())
        for t in known:
            if t != at_ms:
                self.handle.deleteTimer(t)
        if at_ms is not None and at_ms not in known:
            self.handle.registerTimer(at_ms)

    def close(self) -> None:
        pass


def dealt(events: DataFrame, key: str, time: str, others: Sequence[str], late: str, buckets: int):
    """Events with their key as a string, grouped by bucket."""
    prepared(events.sparkSession)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias(BUCKET)
    return events.select(bucket, F.col(key).cast("string").alias(key), time, *others).withWatermark(time, late).groupBy(BUCKET)


class Crossings(Timed):
    SHAPE = "total double, last long"

    def __init__(self, key: str, time: str, tie: str, value: str, marks: Sequence[float], idle: float | None) -> None:
        self.key, self.time, self.tie, self.value = key, time, tie, value
        self.marks, self.idle = sorted(marks), idle

    def due(self, last: int) -> int:
        return last + int(self.idle * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = {k: (total, last) for k, total, last in self.held()}
        batch = pd.concat(list(rows))
        code, names = pd.factorize(batch[self.key].to_numpy(object), use_na_sentinel=False)
        batch = batch.assign(**{BUCKET: code}).sort_values([BUCKET, self.time, self.tie])
        ends = np.cumsum(np.bincount(code))
        latest = batch.groupby(BUCKET)[self.time].max()
        events, values, out = batch[self.tie].to_numpy(), batch[self.value].fillna(0.0).to_numpy(), []
        for i, k in enumerate(names):
            k, low = (None if pd.isna(k) else k), ends[i - 1] if i else 0
            total, last = state.get(k, (0.0, 0))
            running = np.add.accumulate(np.concatenate(([total], values[low : ends[i]])))
            for m in self.marks:
                out += [(k, float(m), events[low + j], running[j + 1]) for j in np.flatnonzero((running[:-1] < m) & (m <= running[1:]))]
            state[k] = (float(running[-1]), max(last, latest[i].value // 1_000_000))
        self.keep([(k, *x) for k, x in state.items()])
        if self.idle is not None:
            self.set_timer(self.due(min(last for _, last in state.values())))
        yield pd.DataFrame(out, columns=[self.key, "mark", self.tie, "running"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [x for x in self.held() if self.due(x[2]) > timerValues.getCurrentWatermarkInMs()]
        self.keep(rows)
        self.set_timer(min((self.due(x[2]) for x in rows), default=None))
        yield pd.DataFrame([], columns=[self.key, "mark", self.tie, "running"])


def crossings(
    events: DataFrame, key: str, time: str, tie: str, value: str, marks: Sequence[float], idle: float | None = None, late: str = "1 hour", buckets: int = BUCKETS
) -> DataFrame:
    """key, mark, tie, running: each mark once, with the event at which a key's running sum first reaches it. After `idle` seconds
    without an event (by the watermark) a key has ended: its state goes, and a later event begins at 0."""
    kinds = dict(events.dtypes)
    found = dealt(events, key, time, [tie, value], late, buckets).transformWithStateInPandas(
        Crossings(key, time, tie, value, marks, idle), f"{key} string, mark double, {tie} {kinds[tie]}, running double", "append", "eventTime")
    return found.withColumn(key, F.col(key).cast(kinds[key]))


class Stalls(Timed):
    SHAPE = "last long, told boolean"

    def __init__(self, key: str, time: str, seconds: float, idle: float | None) -> None:
        self.key, self.time, self.seconds, self.idle = key, time, seconds, idle

    def frame(self, keys, at: np.ndarray, gap_s: np.ndarray | None) -> pd.DataFrame:
        return pd.DataFrame({self.key: pd.Series(keys, dtype=object), "at": at.astype("datetime64[us]").astype("datetime64[ns]"), "gap_s": np.nan if gap_s is None else gap_s}).astype({"gap_s": "float64"})

    def due(self, at: np.ndarray, told: np.ndarray) -> np.ndarray:
        """When a timer is to tell of a silence, or to end the state of one that was told; in milliseconds."""
        return at // 1000 + np.where(told, int((self.seconds + (self.idle or 0)) * 1000), int(self.seconds * 1000)) + 1

    def settle(self, keys: np.ndarray, at: np.ndarray, told: np.ndarray) -> None:
        self.keep([(k, int(t), bool(x)) for k, t, x in zip(keys, at, told, strict=True)])
        self.set_timer(int(self.due(at, told).min()) if len(at) else None)

    def known(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = self.held()
        return np.array([x[0] for x in rows], object), np.array([x[1] for x in rows], np.int64), np.array([x[2] for x in rows], bool)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        keys, at, told = self.known()
        batch = pd.concat(list(rows)).dropna(subset=[self.time])
        n = len(keys)
        keys = np.concatenate((keys, batch[self.key].to_numpy(object)))
        if not len(keys):
            return
        code, names = pd.factorize(keys, use_na_sentinel=False)
        names = np.where(pd.isna(names), None, names)
        at = np.concatenate((at, batch[self.time].to_numpy("datetime64[us]").astype(np.int64)))
        told = np.concatenate((told, np.zeros(len(batch), bool)))
        last = np.full(len(names), np.iinfo(np.int64).min)
        last[code[:n]] = at[:n]
        new = np.concatenate((np.ones(n, bool), at[n:] > last[code[n:]]))  # an event not later than the last one known says nothing
        code, at, told = code[new], at[new], told[new]
        order = np.lexsort((at, code))
        code, at, told = code[order], at[order], told[order]
        same = code[1:] == code[:-1]
        gap_s = np.diff(at) / 1e6
        hit = np.flatnonzero(same & (gap_s > self.seconds) & ~told[:-1])
        end = np.append(~same, True)
        self.settle(names[code[end]], at[end], told[end])
        yield self.frame(names[code[hit]], at[hit], gap_s[hit])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        keys, at, told = self.known()
        now = timerValues.getCurrentWatermarkInMs()
        over = (self.due(at, np.zeros(len(at), bool)) <= now) & ~told
        told = told | over
        stay = ~(told & (self.due(at, told) <= now))
        self.settle(keys[stay], at[stay], told[stay])
        yield self.frame(keys[over], at[over], None)


def stalls(events: DataFrame, key: str, time: str, seconds: float, late: str = "1 hour", idle: float | None = 0.0, buckets: int = BUCKETS) -> DataFrame:
    """key, at, gap_s: silences longer than `seconds` between a key's events, once each. The next event shows one with its length; without one,
    a timer shows it with a null length once the watermark has passed its time. The state goes `idle` seconds after that (0: at once, so that the next event opens a
    new one)."""
    kind = dict(events.dtypes)[key]
    found = dealt(events, key, time, [], late, buckets).transformWithStateInPandas(Stalls(key, time, seconds, idle or None), f"{key} string, at timestamp, gap_s double", "append", "eventTime")
    return found.withColumn(key, F.col(key).cast(kind))
