"""A session with the settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build(master: str | None = None, app: str = "auditlake", **extra: str) -> SparkSession:
    """A session; ``extra`` settings are given with underscores for dots."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS)
    if master:
        builder = builder.master(master)
    for key, value in extra.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
