"""Which events are to be told: a cascade of reasons against, and a memory of signatures."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions import ids, score
from auditlake.plans import files


def signed(events: DataFrame) -> DataFrame:
    return events.withColumn("signature", ids.signature({c: F.col(c) for c in K.SIGNATURE_FIELDS}))


def judge(events: DataFrame, state: DataFrame, min_level: str = "high", require_match: bool = False) -> DataFrame:
    """Events with ``reason``: the first of not_verified, below_level, not_applicable, already_alerted; null: alert.

    Events: status, evidence, level, applicability, signature. A signature repeated in one batch is not suppressed.
    """
    if min_level not in K.LEVELS:
        raise ValueError(f"invalid alert level: {min_level}")
    seen = state.select("signature").distinct().withColumn("__seen", F.lit(True))
    reason = F.when((F.col("status") == "unconfirmed") | (F.coalesce("evidence", F.lit(0)) < 1), "not_verified")
    reason = reason.when(score.level_rank(F.col("level")) < K.LEVELS.index(min_level), "below_level")
    if require_match:
        reason = reason.when(~F.col("applicability").eqNullSafe("matched"), "not_applicable")
    reason = reason.when(F.col("__seen"), "already_alerted")
    return events.join(seen, "signature", "left").withColumn("reason", reason).drop("__seen")


def next_state(state: DataFrame, judged: DataFrame) -> DataFrame:
    """The memory after delivery: it must only be saved once the batch is delivered."""
    return state.select("signature").union(judged.filter("reason is null").select("signature")).distinct()


def deliver(judged: DataFrame, post, batch: int = 500) -> int:  # noqa: ANN001
    """Posts alerts in batches by ``post(list of rows)``, from the driver, in constant memory; returns how many."""
    sent, held = 0, []
    for row in judged.filter("reason is null").toLocalIterator():
        held.append(row.asDict(recursive=True))
        if len(held) == batch:
            post(held)
            sent, held = sent + len(held), []
    if held:
        post(held)
    return sent + len(held)


def load_state(spark: SparkSession, path: str | None) -> DataFrame:
    """The signatures in a file of the driver; none without a file."""
    known = json.loads(Path(path).read_text(encoding="utf-8"))["signatures"] if path and Path(path).exists() else []
    return spark.createDataFrame([(s,) for s in known], "signature string")


def save_state(state: DataFrame, path: str) -> None:
    """Writes the signatures whole, sorted."""
    files.write_whole(path, files.dump({"signatures": [r["signature"] for r in state.orderBy("signature").toLocalIterator()]}))


def webhook(url: str, timeout: float = 20, opener: Callable | None = None) -> Callable[[dict], None]:
    """A function that posts a batch as JSON; only to https, and only an answer of 2xx counts as delivered."""
    if urlsplit(url).scheme != "https" or not urlsplit(url).netloc:
        raise ValueError("a webhook must be an https URL")

    def post(batch: dict) -> None:
        ask = urllib.request.Request(url, json.dumps(batch, ensure_ascii=False).encode(), {"Content-Type": "application/json"}, method="POST")
        with (opener or urllib.request.urlopen)(ask, timeout=timeout) as reply:
            if not 200 <= reply.status < 300:
                raise ValueError(f"webhook answered {reply.status}")

    return post
