"""The sliding-window limit over a stream of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.admission import walk


AFTER = 1.0  # seconds put on event times, since the first watermark is 0 and would take a request at 0 for late


def limited(requests: DataFrame, limit: int, window: float = 60.0) -> DataFrame:
    """(key, event_id, admitted) for a stream of (key, event_id, at in seconds).

    State holds the admitted times within the window of each key. It ends by the time of events, once the
    watermark, a window behind the latest event, has passed a window beyond the key's last request.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["at", "event_id"], ignore_index=True)
        times = pdf["at"].tolist()
        # Earlier admissions come first and are admitted again, as they were.
        done = walk(held + times, limit, window)
        admitted = [a for a, _ in done][len(held) :]
        recent = [t for t, (a, _) in zip(held + times, done, strict=True) if a and t > times[-1] - window]
        state.update((recent,))
        state.setTimeoutTimestamp(max(int((times[-1] + AFTER + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": pdf["key"], "event_id": pdf["event_id"], "admitted": admitted})

    timed = requests.withColumn("ts", F.timestamp_seconds(F.col("at") + AFTER)).withWatermark("ts", f"{int(window) + 1} seconds")
    return timed.groupBy("key").applyInPandasWithState(run, "key long, event_id long, admitted boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)
