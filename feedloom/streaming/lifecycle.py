"""Life of clusters on a stream: a row of state and an event-time timer for each cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_US = 86_400_000_000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lifecycle(StatefulProcessor):
    """A cluster is active from its first record, monitoring when it was idle for over
    ``monitoring`` days, resolved when it was idle for over ``resolved`` days after that.

    A step's time is that at which the idle time was over, so it does not depend on how the stream
    is cut in batches: a record that ends a longer gap brings the steps of the gap, and a timer
    those of a cluster that gets no more records.  A batch of a cluster is folded to the first and
    last time of each of its days, however many records it has; a gap of over a day stands between
    these.  Late records count for nothing but a first.  A resolved cluster takes no records any
    more: its row only says so.
    """

    def __init__(self, monitoring: int = 7, resolved: int = 21):
        self.after = {"active": (monitoring * DAY_US, "monitoring"), "monitoring": (resolved * DAY_US, "resolved")}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "status string, last long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends: dict[int, list[int]] = {}
        for part in rows:
            # plain arrays, since a call of pandas costs more than a cluster's rows
            times = np.sort(part["ts"].to_numpy().astype("datetime64[us]").astype("int64"))
            firsts = np.flatnonzero(np.diff(times // DAY_US, prepend=np.iinfo(np.int64).min // 2))
            for low, high in zip(times[firsts].tolist(), times[np.append(firsts[1:] - 1, -1)].tolist()):
                known = ends.setdefault(low // DAY_US, [low, high])
                known[0], known[1] = min(low, known[0]), max(high, known[1])
        status, last, due = self.life.get() or (None, None, None)
        steps = []
        for at in sorted(t for both in ends.values() for t in both):
            if status is None:
                status, last = "active", at
                steps.append((key[0], status, at))
            status = self._idle(key, status, last, at, steps)
            last = max(last, at)
        yield from self._kept(status, last, due, steps)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, last, _ = self.life.get()
        steps = []
        status = self._idle(key, status, last, timerValues.getCurrentWatermarkInMs() * 1000, steps)
        yield from self._kept(status, last, None, steps)

    def _idle(self, key, status: str, last: int, now: int, steps: list) -> str:
        while status in self.after and now - last > self.after[status][0]:
            idle, status = self.after[status]
            steps.append((key[0], status, last + idle))
        return status

    def _kept(self, status: str, last: int, due: int | None, steps: list) -> Iterator[pd.DataFrame]:
        now_due = (last + self.after[status][0]) // 1000 + 1 if status in self.after else None
        if due != now_due:
            if due is not None:
                self.handle.deleteTimer(due)
            if now_due is not None:
                self.handle.registerTimer(now_due)
        self.life.update((status, last, now_due))
        if steps:
            ids, names, at = zip(*steps)
            yield pd.DataFrame({"cluster_id": ids, "status": names, "at": pd.DatetimeIndex(np.array(at, "datetime64[us]"), tz="UTC")})

    def close(self) -> None:
        pass


def stream_lifecycle(rows: DataFrame, monitoring_days: int = 7, resolved_days: int = 21, late: str = "1 hour") -> DataFrame:
    """``rows(cluster_id, ts)`` -> (cluster_id, status, at): each step of each cluster once, when
    the stream has come so far.  The state lies in RocksDB, which keeps it on disk."""
    rows.sparkSession.conf.set(STORE, ROCKSDB)
    kind = f"cluster_id {rows.schema['cluster_id'].dataType.simpleString()}, status string, at timestamp"
    return (
        rows.select("cluster_id", "ts")
        .withWatermark("ts", late)
        .groupBy("cluster_id")
        .transformWithStateInPandas(Lifecycle(monitoring_days, resolved_days), kind, "Append", "EventTime")
    )
