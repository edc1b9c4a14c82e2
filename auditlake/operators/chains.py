"""Whole audit of stored captures: the chains that their pointers form, their contents, diffs and page indexes.

Records: page_key, snapshot_id, previous_snapshot_id, captured_at, content, content_hash, change_status. Index: a row a
page, page_key and latest_snapshot_id. Diffs: page_key, snapshot_id, diff. Pointers are followed by jumping: each step
doubles the records that a pointer passes, so a chain of any length takes logarithmically many joins, and pages with
many records are many rows, not one task. Faults are rows: page_key, snapshot_id (null for a page's own), fault.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import ids, text, udfs
from auditlake.operators.common import written

KEY = ["page_key", "snapshot_id"]


def walked(records: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys of the records that the index's latest ones lead to, and of those on a cycle."""
    known = records.select(*KEY).distinct()
    to = known.withColumnRenamed("snapshot_id", "to")
    # a pointer to a record that isn't there ends its chain
    hop = written(records.select(*KEY, F.col("previous_snapshot_id").alias("to")).distinct().join(to, ["page_key", "to"], "left_semi").select(*KEY, "to"))
    reached = written(index.select("page_key", F.col("latest_snapshot_id").alias("snapshot_id")).distinct().join(known, KEY, "left_semi"))
    most, passed = known.groupBy("page_key").count().agg(F.max("count")).first()[0] or 0, 1
    while passed <= most and not hop.isEmpty():
        reached = written(reached.union(reached.join(hop, KEY).select("page_key", F.col("to").alias("snapshot_id"))).distinct())
        further = hop.select("page_key", F.col("snapshot_id").alias("to"), F.col("to").alias("further"))
        hop = written(hop.join(further, ["page_key", "to"]).select(*KEY, F.col("further").alias("to")))
        passed *= 2
    # a pointer that has passed more records than its page holds is on a cycle, and such pointers end on all of it
    return reached, hop.select("page_key", F.col("to").alias("snapshot_id")).distinct()


def _fault(rows: DataFrame, name: str, *, page: bool = False) -> DataFrame:
    return rows.select("page_key", (F.lit(None).cast("string") if page else F.col("snapshot_id")).alias("snapshot_id"), F.lit(name).alias("fault"))


def audited(records: DataFrame, index: DataFrame, diffs: DataFrame) -> DataFrame:
    """All faults of a store; an intact one has none.

    Of the chain: ``cycle``, ``missing_previous``, ``unreachable`` from the latest record. Of a record beside the one
    before it: ``not_chronological``, ``wrong_status``. Of its content: ``not_normalized``, ``wrong_hash``. Of diffs:
    ``missing_diff``, ``wrong_diff``, ``unexpected_diff`` of a record that did not change, ``unreferenced_diff``. Of a page:
    ``no_index``, ``latest_missing``, ``latest_stale`` where a later record follows the one the index names. Of ids:
    ``repeated_id``.
    """
    records = written(records.select(*KEY, "previous_snapshot_id", "captured_at", "content", "content_hash", "change_status"))
    known = records.select(*KEY)
    reached, cycle = walked(records, index)
    before = records.select("page_key", *[F.col(c).alias(n) for c, n in (("snapshot_id", "previous_snapshot_id"), ("captured_at", "earlier"), ("content", "before"), ("content_hash", "old_hash"))])
    met = records.join(before, ["page_key", "previous_snapshot_id"])
    gone = records.filter("previous_snapshot_id is not null").join(before, ["page_key", "previous_snapshot_id"], "left_anti")
    status = F.when(F.col("old_hash") == F.col("content_hash"), "unchanged").otherwise("changed")
    first = records.filter("previous_snapshot_id is null and change_status <> 'first_seen'")
    normal = text.content_lines(udfs.nfkc("content"))
    contents = records.withColumn("normal", normal)
    changed = met.filter(status == "changed")
    own = diffs.select(*KEY, "diff")
    shown = changed.join(own, KEY).withColumn("d", udfs.unified_diff("before", "content"))
    follower = known.join(records.select("page_key", F.col("previous_snapshot_id").alias("snapshot_id")), KEY, "left_semi")
    named = index.select("page_key", F.col("latest_snapshot_id").alias("snapshot_id"))
    parts = [
        _fault(cycle, "cycle"),
        _fault(gone, "missing_previous"),
        _fault(known.distinct().join(reached, KEY, "left_anti"), "unreachable"),
        _fault(known.groupBy(*KEY).count().filter("count > 1"), "repeated_id"),
        _fault(met.filter("captured_at <= earlier"), "not_chronological"),
        _fault(met.filter(F.col("change_status") != status).unionByName(first, allowMissingColumns=True), "wrong_status"),
        _fault(contents.filter("normal = '' or normal <> content"), "not_normalized"),
        _fault(contents.filter(ids.hashed(F.col("normal")) != F.col("content_hash")), "wrong_hash"),
        _fault(changed.join(own, KEY, "left_anti"), "missing_diff"),
        _fault(shown.filter("d.diff <> diff"), "wrong_diff"),
        _fault(own.join(known.join(changed, KEY, "left_anti"), KEY, "left_semi"), "unexpected_diff"),
        _fault(own.join(known, KEY, "left_anti"), "unreferenced_diff"),
        _fault(known.select("page_key").distinct().join(index, "page_key", "left_anti"), "no_index", page=True),
        _fault(named.join(known, KEY, "left_anti"), "latest_missing", page=True),
        _fault(named.join(follower, KEY, "left_semi"), "latest_stale", page=True),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def recovered(records: DataFrame) -> DataFrame:
    """page_key and latest_snapshot_id without an index: the last capture that none follows, or the last where each is followed."""
    followed = records.select("page_key", F.col("previous_snapshot_id").alias("snapshot_id")).filter("snapshot_id is not null").distinct().withColumn("followed", F.lit(True))
    rows = records.join(followed, KEY, "left")
    last: Column = F.struct(F.col("followed").isNull(), "captured_at", "snapshot_id")
    return rows.groupBy("page_key").agg(F.max(last).alias("last")).select("page_key", F.col("last.snapshot_id").alias("latest_snapshot_id"))


def repaired(index: DataFrame, records: DataFrame) -> DataFrame:
    """page_key, latest_snapshot_id and ``recovered``: the index where it names a record, else what the records imply."""
    good = index.select("page_key", F.col("latest_snapshot_id").alias("snapshot_id")).join(records.select(*KEY), KEY, "left_semi").groupBy("page_key").agg(F.max("snapshot_id").alias("named"))
    rows = recovered(records).join(good, "page_key", "left")
    return rows.select("page_key", F.coalesce("named", "latest_snapshot_id").alias("latest_snapshot_id"), F.col("named").isNull().alias("recovered"))
