"""Timeline state on live streams (inventory T1, T4, T5, T9, T12): processors for
``transformWithStateInPandas``.  Each has a batch twin in
``tideline.operators.timeline``; the same rows give the same result.

Input rows: stream_id string, seq bigint, ts bigint, is_key boolean, lag bigint.
``seq`` numbers a stream's rows as they arrived (a shuffle keeps no other order);
rows of a micro-batch are taken by it.  ``transformWithState`` needs the RocksDB
state store: ``STATE_STORE``.  With a time to live, state of streams that have
gone silent for so long is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
IN = "stream_id string, seq bigint, ts bigint, is_key boolean, lag bigint"


def _rows(frames: Iterator[pd.DataFrame]) -> list[tuple]:
    found = [f for f in frames if len(f)]
    if not found:
        return []
    all_rows = pd.concat(found).sort_values("seq")
    return list(all_rows[["seq", "ts", "is_key", "lag"]].itertuples(index=False, name=None))


class Lasting(StatefulProcessor):
    """A processor whose state can have a time to live, in ms."""

    ttl: int | None = None

    def close(self) -> None:
        pass


class Reorder(Lasting):
    """A bounded reorder buffer; late rows are clamped, never dropped.  The
    buffer is flushed by a row with a null ``ts``, the end of its stream."""

    OUT = "stream_id string, seq bigint, ts bigint, position bigint, ts_out bigint"

    def __init__(self, window: int, most: int = 128):
        self.window, self.most = window, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getListState("buffer", "ts bigint, n bigint, seq bigint", self.ttl)
        self.clock = handle.getValueState("clock", "n bigint, newest bigint, last bigint, position bigint", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = sorted((int(t), int(n), int(s)) for t, n, s in self.buffer.get()) if self.buffer.exists() else []
        n, newest, last, position = map(int, self.clock.get()) if self.clock.exists() else (0, -(1 << 62), -(1 << 62), 0)
        out: list[tuple] = []

        def leave() -> None:
            nonlocal last, position
            t, _, s = held.pop(0)
            last, position = max(last, t), position + 1
            out.append((key[0], s, t, position, last))

        import bisect

        for seq, ts, _, _ in _rows(rows):
            if ts is None or pd.isna(ts):
                while held:
                    leave()
                continue
            bisect.insort(held, (int(ts), n, int(seq)))
            n, newest = n + 1, max(newest, int(ts))
            while held and (held[0][0] <= newest - self.window or len(held) > self.most):
                leave()
        if held:
            self.buffer.put(held)
        else:
            self.buffer.clear()
        self.clock.update((n, newest, last, position))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "ts", "position", "ts_out"])


class Realign(Lasting):
    """T4: times that go back by more than ``limit`` get a new offset."""

    OUT = "stream_id string, seq bigint, ts_out bigint"

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "offset bigint, last bigint", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        offset, last = map(int, self.state.get()) if self.state.exists() else (0, None)
        out = []
        for seq, ts, _, _ in _rows(rows):
            t = int(ts) + offset
            if last is not None and t < last:
                if last - t > self.limit:
                    offset, t = last + 1 - int(ts), last + 1
                else:
                    t = last
            last = t
            out.append((key[0], int(seq), max(0, t)))
        if last is not None:
            self.state.update((offset, last))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "ts_out"])


class Shed(Lasting):
    """T5: from a lag of ``most`` on rows are dropped up to the next key."""

    OUT = "stream_id string, seq bigint, dropped boolean"

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("skipping", "skipping boolean", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        skipping = bool(self.state.get()[0]) if self.state.exists() else False
        out = []
        for seq, _, is_key, lag in _rows(rows):
            if lag >= self.most:
                skipping = True
            elif skipping and is_key:
                skipping = False
            out.append((key[0], int(seq), skipping))
        self.state.update((skipping,))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "dropped"])


class Segment(Lasting):
    """Live segment numbers, cut at keyframes."""

    OUT = "stream_id string, seq bigint, segment bigint"

    def __init__(self, target: int):
        self.target = target

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "start bigint, segment bigint", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, segment = map(int, self.state.get()) if self.state.exists() else (None, 1)
        out = []
        for seq, ts, is_key, _ in _rows(rows):
            start = int(ts) if start is None else start
            if is_key and ts - start >= self.target:
                start, segment = int(ts), segment + 1
            out.append((key[0], int(seq), segment))
        if start is not None:
            self.state.update((start, segment))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "segment"])


def processed(stream: DataFrame, processor: Lasting, ttl: int | None = None) -> DataFrame:
    """The processor over ``stream`` (columns of ``IN``), keyed by stream_id;
    ``ttl`` is in ms."""
    processor.ttl = ttl
    return stream.groupBy("stream_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.OUT, outputMode="Append", timeMode="None" if ttl is None else "ProcessingTime")
