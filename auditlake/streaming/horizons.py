"""Captures within a fixed time before or after a receipt, where both are streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within(receipts: DataFrame, captures: DataFrame, back: str = "24 hours", ahead: str = "0 seconds", delay: str = "1 hour") -> DataFrame:
    """key, receipt, checked_at, capture, captured_at of captures from ``back`` before a receipt to ``ahead`` after it, both ends included.

    Receipts: key, receipt, checked_at; captures: key, capture, captured_at. Each side has its own watermark, ``delay``
    behind its newest row. As a row of one side can only meet rows of the other within the horizon, Spark drops it from
    state once the other side's watermark has passed that; so state is what lies within horizon and delay, however long
    the streams run. Rows behind their side's watermark are dropped.
    """
    a = receipts.select(F.col("key").alias("a_key"), "receipt", "checked_at").withWatermark("checked_at", delay)
    b = captures.select(F.col("key").alias("b_key"), "capture", "captured_at").withWatermark("captured_at", delay)
    early = F.col("captured_at") >= F.col("checked_at") - F.expr(f"interval {back}")
    late = F.col("captured_at") <= F.col("checked_at") + F.expr(f"interval {ahead}")
    met = a.join(b, (F.col("a_key") == F.col("b_key")) & early & late)
    return met.select(F.col("a_key").alias("key"), "receipt", "checked_at", "capture", "captured_at")
