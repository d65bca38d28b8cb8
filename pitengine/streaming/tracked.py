"""Tracked keys as a stream with timers: register, compare snapshots, expire.

A key is registered by its first snapshot; each later one is compared with the one before (status and price); a key that is silent for ``TTL``
expires at that time and its state is dropped. State is one value and one timer per key (``transformWithState``), kept in RocksDB, so it
outgrows the executors' memory and shrinks as keys expire. Rows of a batch come in the order of their time; a silence that ends within a
batch is found when the next snapshot comes, one that lasts by the timer, so the result doesn't depend on how rows fall into batches.

Lateness: rows behind the watermark (``DELAY`` behind the latest time seen) are counted as LATE and change no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TTL_SECONDS, DELAY = 2 * 86400, "1 hour"
OUTPUT = "key long, at long, change string, old string, new string, moved double"
STORE = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Tracker(StatefulProcessor):
    """Output per key: REGISTERED, STATUS and PRICE changes, EXPIRED, LATE."""

    def __init__(self, ttl: int = TTL_SECONDS):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, status string, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "seq"])
        last = self.last.get() if self.last.exists() else None
        seen, out = last, []
        for at, status, price in zip(batch["at"].tolist(), batch["status"], batch["price"].tolist()):
            if last is not None and at < last[0]:
                out.append((key[0], at, "LATE", None, status, None))
                continue
            if last is not None and at > last[0] + self.ttl:
                out.append((key[0], last[0] + self.ttl, "EXPIRED", last[1], None, None))
                last = None
            if last is None:
                out.append((key[0], at, "REGISTERED", None, status, None))
            else:
                if status != last[1]:
                    out.append((key[0], at, "STATUS", last[1], status, None))
                if price != last[2]:
                    out.append((key[0], at, "PRICE", None, None, price - last[2]))
            last = (at, status, price)
        if last is not None and last != seen:
            if seen is not None:
                self.handle.deleteTimer((seen[0] + self.ttl) * 1000 + 1000)
            self.last.update(last)
            self.handle.registerTimer((last[0] + self.ttl) * 1000 + 1000)
        yield pd.DataFrame(out, columns=["key", "at", "change", "old", "new", "moved"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, status, _ = self.last.get()
        self.last.clear()
        yield pd.DataFrame([(key[0], at + self.ttl, "EXPIRED", status, None, None)], columns=["key", "at", "change", "old", "new", "moved"])

    def close(self) -> None:
        pass


def tracked_changes(events: DataFrame, ttl: int = TTL_SECONDS, delay: str = DELAY) -> DataFrame:
    """Changes of a stream of events (user_id, ts, event_id, event_type, value); the session's state store must be RocksDB (``PROVIDER``)."""
    rows = events.withWatermark("ts", delay).select(F.col("user_id").alias("key"), "ts", F.unix_seconds("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.round("value", 2).alias("price"))
    return rows.groupBy("key").transformWithStateInPandas(Tracker(ttl), OUTPUT, "Append", "EventTime")
