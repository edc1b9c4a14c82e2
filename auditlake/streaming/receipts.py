"""Receipts that a stream may use again while they are fresh: keyed state that expires by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from auditlake import constants as K

#: The state store that keeps typed state and timers.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUTPUT = "task_id string, at timestamp, ref string, outcome string, receipt_ref string"
STATE = "ref string, result string, at long"


class Fresh(StatefulProcessor):
    """Holds each task's newest receipt until its time to live is over, and answers lookups from it."""

    def __init__(self, ttl_seconds: float) -> None:
        self.ttl = int(ttl_seconds * 1_000_000)  # microseconds, as all times here

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("receipt", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        own = pd.concat(list(rows)).sort_values(["at", "seq"])
        held, out = self.held.get(), []
        for at, kind, ref, result in zip(own["at"], own["kind"], own["ref"], own["result"]):
            now = at.value // 1000
            if kind == "lookup":
                good = held is not None and held[1] in K.POSITIVE_RESULTS and 0 <= now - held[2] <= self.ttl
                out.append((key[0], at, ref, "reused" if good else "fetch", held[0] if good else None))
            elif held is not None and now < held[2]:
                out.append((key[0], at, ref, "late", held[0]))
            else:
                held = (ref, result, now)
        if held is not None:
            self.held.update(held)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((held[2] + self.ttl) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["task_id", "at", "ref", "outcome", "receipt_ref"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        """The receipt is too old for any lookup to come."""
        held = self.held.get()
        self.held.clear()
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame([(key[0], at, held[0] if held else None, "expired", None)], columns=["task_id", "at", "ref", "outcome", "receipt_ref"])

    def close(self) -> None:
        pass


def fresh_receipts(rows: DataFrame, ttl_seconds: float, delay: str = "1 hour") -> DataFrame:
    """Outcomes of a stream of receipts and lookups: task_id, kind, at, seq (order within a time), ref, result.

    A lookup is ``reused`` with the task's newest receipt before it, if that was a success and is at most ``ttl_seconds``
    old, else ``fetch``. A receipt older than the one held is ``late`` and changes nothing; rows that come later than
    ``delay`` behind the newest are dropped by the watermark. A receipt whose time is over leaves the state with a row
    ``expired``, so state holds one receipt for each task that was active within the time to live. A task's rows of one
    batch meet in one task: bound batches at the source.
    """
    rows.sparkSession.conf.set(*PROVIDER)
    keyed = rows.withWatermark("at", delay).groupBy("task_id")
    return keyed.transformWithStateInPandas(Fresh(ttl_seconds), OUTPUT, "append", "eventTime")
