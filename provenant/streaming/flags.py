"""Rate flags and cache hits on a stream: one open window per key as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_US = 1_000_000


class _OpenWindow(StatefulProcessor):
    """State per key: when its window opened and how many events fell into it."""

    def __init__(self, seconds: int, limit: int):
        self.width, self.limit = seconds * _US, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "anchor bigint, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A micro-batch of one key is ordered by time before it is counted.
        frames = [frame for frame in rows if len(frame)]
        if not frames:
            return
        batch = pd.concat(frames).sort_values(["us", "event"])
        anchor, n = self.window.get() if self.window.exists() else (None, 0)
        starts, numbers = [], []
        for us in batch["us"]:
            if anchor is None or us >= anchor + self.width:
                anchor, n = int(us), 0
            n += 1
            starts.append(anchor)
            numbers.append(n)
        self.window.update((anchor, n))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(anchor // 1000 + self.width // 1000)
        yield pd.DataFrame({"key": key[0], "event_id": batch["event"].to_numpy(),
                            "window_start": pd.to_datetime(pd.Series(starts), unit="us"),
                            "n_in_window": numbers, "flagged": [x > self.limit for x in numbers]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_flags(log: DataFrame, seconds: int, limit: int, key: str = "ip_hash", ts: str = "created_at",
                 event_id: str = "id", late: str = "1 minute") -> DataFrame:
    """(key, event_id, window_start, n_in_window, flagged) per event, as anchored_window in batch.

    Needs the RocksDB state store. State of a key is dropped once the watermark passes the end
    of its window. An event later than others of its key in an earlier micro-batch counts in the
    window open at that moment.
    """
    kinds = {c: log.schema[c].dataType.simpleString() for c in (key, event_id)}
    rows = log.withWatermark(ts, late).select(F.col(key).alias("key"), F.col(event_id).alias("event"),
                                              F.unix_micros(ts).alias("us"), F.col(ts).alias("at"))
    schema = (f"key {kinds[key]}, event_id {kinds[event_id]}, window_start timestamp, "
              "n_in_window bigint, flagged boolean")
    return rows.groupBy("key").transformWithStateInPandas(
        _OpenWindow(seconds, limit), schema, outputMode="Append", timeMode="EventTime")
