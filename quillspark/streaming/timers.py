"""Streams with keyed state and event-time timers.

Rows may come in any order within the watermark's delay. A key's rows wait in its state and are
taken in order once the watermark has passed them, so the same rows come out however the stream is
cut into micro-batches, and what comes out once is never taken back. A timer wakes a key whose rows
wait while nothing new arrives. State and timers live in the checkpoint, so a query that is started
again goes on where it stopped. A key's state is what waits within the delay, and a few values.

Rows later than the watermark are dropped, as everywhere in Spark. The processors need the RocksDB
state store; ``prepare`` selects it for queries started afterwards.
"""

from __future__ import annotations

import operator
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def _plain(x):
    return None if x is None or x != x else x.item() if hasattr(x, "item") else x


class _Waiting(StatefulProcessor):
    """Rows of a key that wait for the watermark; ``take`` says which may go, and what they give.

    What a micro-batch brings waits as one block, put behind those that wait; blocks are read only once the
    watermark lets the earliest row go, and what is left of them then waits as one block again."""

    def __init__(self, schema: StructType, time: str, ties: tuple[str, ...], after: int):
        self.schema, self.names, self.after = schema, schema.names, after
        self.order = [self.names.index(c) for c in (time, *ties)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([StructField("block", BinaryType())]))
        self.first = handle.getValueState("first", StructType([StructField("at", LongType())]))
        self.start(handle)

    def start(self, handle: StatefulProcessorHandle) -> None:
        """Further state."""

    def _at(self, row: tuple) -> int:
        return row[self.order[0]]

    def wakes(self, row: tuple) -> int:
        return self._at(row) + self.after

    def _run(self, new: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        held = self.first.get()
        earliest = held[0] if held else None
        if new:
            least = min(map(self._at, new))
            if min(least, least if earliest is None else earliest) + self.after > watermark:
                self.waiting.appendValue((pickle.dumps(new),))
                if earliest is None or least < earliest:
                    self._wait(least, watermark)
                return
        elif earliest is None or earliest + self.after > watermark:
            return
        rows = new if earliest is None else [r for (block,) in self.waiting.get() for r in pickle.loads(block)] + new
        rows.sort(key=operator.itemgetter(*self.order))
        out, rest = self.take(rows, watermark)
        if rest:
            self.waiting.put([(pickle.dumps(rest),)])
            self._wait(self._at(rest[0]), watermark)
        elif earliest is not None:
            self.waiting.clear()
            self.first.clear()
        if out:
            yield pd.DataFrame(out, columns=self.out_names)

    def _wait(self, at: int, watermark: int) -> None:
        self.first.update((at,))
        self.handle.registerTimer(max(at + self.after, watermark + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in zip(*([*map(_plain, pdf[c].tolist())] for c in self.names), strict=True)]
        yield from self._run(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._run([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class Debounce(_Waiting):
    """A batch opens at its first row and is given out once the watermark is ``wait_ms`` later: of each item the last row."""

    def __init__(self, schema: StructType, time: str, ties: tuple[str, ...], item: str, wait_ms: int):
        super().__init__(schema, time, ties, wait_ms)
        self.item, self.wait_ms = self.names.index(item), wait_ms
        self.out_names = [*self.names, "batch_start"]

    def take(self, rows: list[tuple], watermark: int):
        out, at = [], 0
        while at < len(rows) and self.wakes(rows[at]) <= watermark:
            opened = self._at(rows[at])
            n = next((i for i in range(at, len(rows)) if self._at(rows[i]) >= opened + self.wait_ms), len(rows))
            out += [(*r, opened) for r in {r[self.item]: r for r in rows[at:n]}.values()]
            at = n
        return out, rows[at:]


class Anchored(_Waiting):
    """Running cost since an anchor, which moves to the first row after its window has passed."""

    def __init__(self, schema: StructType, time: str, ties: tuple[str, ...], cost: str, window_ms: int):
        super().__init__(schema, time, ties, 1)
        self.cost, self.window_ms = self.names.index(cost), window_ms
        self.out_names = [*self.names, "anchor", "used"]

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("anchor", StructType([StructField("anchor", LongType()), StructField("used", LongType())]))

    def take(self, rows: list[tuple], watermark: int):
        anchor, used = self.held.get() if self.held.exists() else (None, 0)
        n = next((i for i, r in enumerate(rows) if self.wakes(r) > watermark), len(rows))
        out = []
        for r in rows[:n]:
            if anchor is None or anchor < self._at(r) - self.window_ms:
                anchor, used = self._at(r), 0
            used += r[self.cost] or 0
            out.append((*r, anchor, used))
        if out:
            self.held.update((anchor, used))
        return out, rows[n:]


class Sticky(StatefulProcessor):
    """The last value of a key by time; the value goes ``ttl_ms`` after it was written. Gives out every change."""

    def __init__(self, value: str, time: str, ttl_ms: int):
        self.value, self.time, self.ttl_ms = value, time, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", StructType([StructField("value", StringType()), StructField("at", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        value, at = self.held.get() if self.held.exists() else (None, None)
        was, mark = (value, at), timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            for v, t in zip(pdf[self.value].tolist(), pdf[self.time].tolist(), strict=True):
                if at is None or t > at or (t == at and v is not None and v > (value or "")):
                    value, at = v, int(t)
        if (value, at) != was and at + self.ttl_ms > mark:
            self.held.update((value, at))
            self.handle.registerTimer(at + self.ttl_ms)
            yield pd.DataFrame([(key[0], value, at, "set")], columns=["key", "value", "at", "change"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        value, at = self.held.get() if self.held.exists() else (None, None)
        if at is not None and at + self.ttl_ms <= timerValues.getCurrentWatermarkInMs():  # not written again since
            self.held.clear()
            yield pd.DataFrame([(key[0], value, at, "gone")], columns=["key", "value", "at", "change"])

    def close(self) -> None:
        pass


def _watched(stream: DataFrame, time_ms: str, delay: str) -> DataFrame:
    return stream.where(F.col(time_ms).isNotNull()).withColumn("_t", F.timestamp_millis(time_ms)).withWatermark("_t", delay)


def debounced_stream(items: DataFrame, group: str, key: str, time_ms: str, wait_ms: int = 1000, ties: tuple[str, ...] = (), delay: str = "1 minute") -> DataFrame:
    """The streaming form of ``eventlog.debounced``: closed batches, with batch_start."""
    out = StructType([*items.schema.fields, StructField("batch_start", LongType())])
    return _watched(items, time_ms, delay).groupBy(group).transformWithStateInPandas(Debounce(items.schema, time_ms, ties, key, wait_ms), out, "append", "EventTime")


def anchored_stream(rows: DataFrame, key: str, time_ms: str, cost: str, window_ms: int, ties: tuple[str, ...] = (), delay: str = "1 minute") -> DataFrame:
    """The streaming form of ``counters.anchored``: rows the watermark has passed, with anchor and used."""
    out = StructType([*rows.schema.fields, StructField("anchor", LongType()), StructField("used", LongType())])
    return _watched(rows, time_ms, delay).groupBy(key).transformWithStateInPandas(Anchored(rows.schema, time_ms, ties, cost, window_ms), out, "append", "EventTime")


def sticky_stream(rows: DataFrame, key: str, value: str, time_ms: str, hours: int = 24, delay: str = "1 minute") -> DataFrame:
    """The streaming form of ``counters.sticky``: key, value, at, change ('set', or 'gone' once the time to live
    has passed). The last change of a key says whether it holds a value."""
    out = StructType([StructField("key", rows.schema[key].dataType), StructField("value", StringType()), StructField("at", LongType()), StructField("change", StringType())])
    return _watched(rows, time_ms, delay).groupBy(key).transformWithStateInPandas(Sticky(value, time_ms, hours * 3_600_000), out, "append", "EventTime")
