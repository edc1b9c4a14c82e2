"""The change chain over a stream of captures, with late captures refused as the chosen store would."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "page_key string, snapshot_id string, captured_at timestamp, content_hash string, previous_snapshot_id string, change_status string"
STATE = "snapshot_id string, content_hash string, at double"


def refuses(policy: str, at: float, digest: str, last_at: float, last_digest: str) -> bool:
    """Whether a store of this kind refuses a capture after its latest."""
    if policy == "filesystem":
        return False
    if policy == "sqlite":
        return at < last_at
    return at < last_at or at == last_at and digest != last_digest


def change_stream(captures: DataFrame, policy: str = "sqlite", arrival: str | None = None) -> DataFrame:
    """Captures (page_key, snapshot_id, captured_at, content_hash) with link and status; refused ones say ``rejected``.

    State holds one record a page. Rows of one batch go in order of ``arrival``, a column of the stream; without one a
    batch counts as one arrival and goes in order of time, so that only captures from before the batch's start can be
    late. An exact repeat gives no row. A page's rows of one batch meet in one task: bound batches at the source.
    """
    order = [arrival] if arrival else ["captured_at", "snapshot_id"]

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for when, snapshot, digest in zip(rows["captured_at"], rows["snapshot_id"], rows["content_hash"]):
            at = when.timestamp()
            if last is None:
                out.append((key[0], snapshot, when, digest, None, "first_seen"))
            elif (snapshot, digest) == (last[0], last[1]):
                continue
            elif refuses(policy, at, digest, last[2], last[1]):
                out.append((key[0], snapshot, when, digest, last[0], "rejected"))
                continue
            else:
                out.append((key[0], snapshot, when, digest, last[0], "unchanged" if digest == last[1] else "changed"))
            last = (snapshot, digest, at)
        if last is not None:
            state.update(last)
        if out:
            yield pd.DataFrame(out, columns=["page_key", "snapshot_id", "captured_at", "content_hash", "previous_snapshot_id", "change_status"])

    return captures.groupBy("page_key").applyInPandasWithState(follow, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def alert_once(alerts: DataFrame, delay: str = "30 days") -> DataFrame:
    """Each signature once within the delay."""
    return alerts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["signature"])


def idempotent(receipts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Replayed receipts once."""
    return receipts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["task_id", "content_hash"])
