"""Messages gathered into batches that leave when they are full or when their first message has waited long enough.

The state of a shard is the list of its waiting messages (fewer than `size`), their number, the number of batches so far and the deadline, for
which a timer is set. Shards are independent keys, so that a busy stream is gathered by many tasks; one shard gathers as a single consumer would.
State and timers are in the query's checkpoint: what waits when a query stops is sent by its next run, at the deadline it had.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FLUSHED = "shard long, flush long, reason string, payload string"


class Gather(StatefulProcessor):
    """Sends a shard's messages as batches of `size`, and fewer once the first of them has waited `wait_ms`, by the clock or by event time."""

    def __init__(self, size: int, wait_ms: int, by_event: bool) -> None:
        self.size, self.wait_ms, self.by_event = size, wait_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "payload string")
        self.progress = handle.getValueState("progress", "n long, flush long, deadline long")

    def _progress(self) -> tuple[int, int, int]:
        return tuple(self.progress.get()) if self.progress.exists() else (0, 0, 0)

    def _batch(self, key: tuple, flush: int, reason: str, payloads: list) -> pd.DataFrame:
        return pd.DataFrame({"shard": key[0], "flush": flush, "reason": reason, "payload": pd.Series(payloads, dtype=object)})

    def _held(self) -> list:
        held = [p for (p,) in self.waiting.get()]
        self.waiting.clear()
        return held

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n, flush, deadline = self._progress()
        now = None if self.by_event else timerValues.getCurrentProcessingTimeInMs()
        rest: list = []  # (payload, since) of this trigger; the n messages of earlier ones go before it
        for frame in rows:
            since = frame["at_ms"].tolist() if self.by_event else [now] * len(frame)
            rest += [(None if p is None or p != p else p, t) for p, t in zip(frame["payload"], since)]
            at = 0
            while n + len(rest) - at >= self.size:
                upto = at + self.size - n
                yield self._batch(key, flush, "size", (self._held() if n else []) + [p for p, _ in rest[at:upto]])
                n, at, flush = 0, upto, flush + 1
                if deadline:
                    self.handle.deleteTimer(deadline)
                    deadline = 0
            rest = rest[at:]
        if rest:
            self.waiting.appendList([(p,) for p, _ in rest])
            n += len(rest)
            if not deadline:
                deadline = int(rest[0][1]) + self.wait_ms
                self.handle.registerTimer(deadline)
        self.progress.update((n, flush, deadline))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, flush, deadline = self._progress()
        if n and deadline and expiredTimerInfo.getExpiryTimeInMs() >= deadline:
            yield self._batch(key, flush, "deadline", self._held())
            self.progress.update((0, flush + 1, 0))

    def close(self) -> None:
        pass


def gathered(messages: DataFrame, size: int, wait_ms: int, event_time: str | None = None) -> DataFrame:
    """shard, flush (0, 1, ... of a shard), reason (size, deadline), payload of a stream of shard (long), payload (string).

    Messages wait by the clock, or, where the column of their watermark is named, until the watermark has passed the first one's time by wait_ms;
    what comes later than the watermark is then dropped by Spark. Else each message is sent once, in order of arrival in its shard. A null
    payload is a message as any other; a null shard is a shard of its own. A stream by the clock goes on until it is stopped, since timers
    may be waiting; one by event time can run to the end of its input.
    """
    if size < 1 or wait_ms < 1:
        raise ValueError("size and wait_ms must be positive")
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    told = [F.col("shard").cast("long"), "payload"]
    if event_time:
        told += [event_time, F.unix_millis(F.col(event_time)).alias("at_ms")]
    keyed = messages.select(*told).groupBy("shard")
    return keyed.transformWithStateInPandas(Gather(size, wait_ms, bool(event_time)), FLUSHED, "append", "eventTime" if event_time else "processingTime")
