"""The sliding-window limit over a stream whose requests come out of order.

``limits.limited`` decides a request as it comes; here a request waits until no earlier one can come any more, so that
decisions are those of the whole log in order, however its rows are spread over batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.admission import walk
from .limits import AFTER

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: State with lists and timers is kept by this provider only; the session's setting is the caller's.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "key long, event_id long, admitted boolean, retry_after long"


class _Limit(StatefulProcessor):
    """For each key, requests that wait for the watermark, and the times of those admitted within the window before it.

    A batch only adds to the waiting ones and sets a timer for its earliest. When the watermark has passed it, all that are due
    are decided in order, and a timer is set for the earliest left; with none left it is set for when the last admission
    leaves the window, when the key's state is let go.
    """

    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros long, event_id long, at double")
        self.held = handle.getListState("held", "at double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[["micros", "event_id", "at"]]
        self.waiting.appendList([tuple(r) for r in new.itertuples(index=False)])
        self._wake(int(new["micros"].min()))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((micros, event, at) for micros, event, at in self.waiting.get())
        due = [r for r in waiting if r[0] <= mark * 1000]
        left = waiting[len(due) :]
        held = [at for (at,) in self.held.get()]
        # Earlier admissions come first and are admitted again, as they were.
        times = held + [at for _, _, at in due]
        done = walk(times, self.limit, self.window)
        admitted = [t for t, (fine, _) in zip(times, done, strict=True) if fine and (t + AFTER + self.window) * 1000 > mark]
        for state, rows in ((self.waiting, left), (self.held, [(t,) for t in admitted])):
            state.put(rows) if rows else state.clear()
        if left:
            self._wake(left[0][0])
        elif admitted:
            self._wake(int((admitted[-1] + AFTER + self.window) * 1_000_000))
        if due:
            decided = done[len(held) :]
            yield pd.DataFrame({"key": key[0], "event_id": [e for _, e, _ in due], "admitted": [fine for fine, _ in decided], "retry_after": [wait for _, wait in decided]})

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))


def limited_in_order(requests: DataFrame, limit: int, window: float = 60.0, late: float = 60.0) -> DataFrame:
    """(key, event_id, admitted, retry_after) for a stream of (key, event_id, at in seconds, from 0 on), the same as for the whole log.

    Requests may come up to ``late`` seconds behind the latest one. Later ones are dropped without a decision; Spark counts
    them as numRowsDroppedByWatermark. A request is decided in the first batch after which the watermark, ``late`` seconds
    behind the latest request of all keys, has reached it, so that the last ones wait for others. A key's state grows with its requests
    within ``late`` and its admissions within ``window``. Rows without a key are a key of their own; rows without a time are left out.
    """
    if requests.sparkSession.conf.get(PROVIDER) != ROCKSDB:
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}: lists and timers need it")
    timed = requests.where("at is not null").select("key", "event_id", F.col("at").cast("double").alias("at"), F.timestamp_seconds(F.col("at") + AFTER).alias("ts"))
    timed = timed.withColumn("micros", F.unix_micros("ts")).withWatermark("ts", f"{round(late * 1000)} milliseconds")
    return timed.groupBy("key").transformWithStateInPandas(_Limit(limit, window), OUTPUT, "append", "eventTime")
