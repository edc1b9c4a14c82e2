"""How pages changed: captures as a chain for each page.

Captures: platform, url, content, captured_at (timestamp). A page is a platform and a canonical URL; a capture that
repeats the one before (same id and hash) is the same record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions import ids, text, udfs
from auditlake.operators.common import written

FIRST = "first capture, nothing to compare with"
SAME = "same text as in the capture before"


def hashed(captures: DataFrame) -> DataFrame:
    """Captures with page_key, normalised content, its hash and the snapshot id; empty contents are refused."""
    out = captures.withColumn("url", text.canonical_url(F.col("url"), strip_slash=False)).withColumn("content", text.content_lines(udfs.nfkc("content")))
    out = out.filter("content <> ''").withColumn("content_hash", ids.hashed(F.col("content")))
    out = out.withColumn("page_key", ids.page_key(F.concat_ws("\n", "platform", "url")))
    return out.withColumn("snapshot_id", ids.snapshot_id(F.col("captured_at"), F.col("content_hash")))


def chain(rows: DataFrame, key: str = "page_key", time: str = "captured_at", id: str = "snapshot_id", digest: str = "content_hash", order: tuple[str, ...] = ()) -> DataFrame:
    """Rows with previous id and hash, and change_status, in one window pass; consecutive repeats are dropped.

    ``order``: columns that order a key's rows, if not time and id.
    """
    order = Window.partitionBy(key).orderBy(*(order or (time, id)))
    out = rows.withColumn("__i", F.lag(id).over(order)).withColumn("__h", F.lag(digest).over(order))
    out = out.filter(~(F.col("__i").eqNullSafe(F.col(id)) & F.col("__h").eqNullSafe(F.col(digest))))
    status = F.when(F.col("__i").isNull(), "first_seen").when(F.col("__h") == F.col(digest), "unchanged").otherwise("changed")
    return out.withColumn("previous_snapshot_id", F.col("__i")).withColumn("change_status", status).drop("__i", "__h")


def with_diffs(captures: DataFrame) -> DataFrame:
    """The chain with a summary and a line diff of every change."""
    rows = chain(hashed(captures))
    order = Window.partitionBy("page_key").orderBy("captured_at", "snapshot_id")
    rows = rows.withColumn("__before", F.lag("content").over(order))
    changed = rows.filter("change_status = 'changed'").withColumn("d", udfs.unified_diff("__before", "content")).withColumn("diff_summary", F.col("d.summary")).withColumn("diff", F.col("d.diff")).drop("d", "__before")
    rest = rows.filter("change_status <> 'changed'").withColumn("diff_summary", F.when(F.col("change_status") == "first_seen", FIRST).otherwise(SAME)).withColumn("diff", F.lit("")).drop("__before")
    return changed.unionByName(rest)


RECORD = ("page_key", "snapshot_id", "previous_snapshot_id", "platform", "url", "captured_at", "content", "content_hash", "change_status", "diff_summary")


def added(held: DataFrame | None, captures: DataFrame, policy: str = "sqlite") -> tuple[DataFrame, DataFrame]:
    """(records with their ``diff``, refused captures) that captures (with ``seq``, their arrival) add to a store's records.

    Only each page's latest record is looked at. A repeat of the latest adds nothing; late ones are refused as the kind of
    store says (see ``admit``), or, by a filesystem, follow the one that arrived before.
    """
    fresh = hashed(captures).withColumn("fresh", F.lit(True))
    if held is not None:
        last = Window.partitionBy("page_key").orderBy(F.desc("part"), F.desc("place")) if policy == "filesystem" else Window.partitionBy("page_key").orderBy(F.desc("captured_at"), F.desc("part"), F.desc("place"))
        newest = held.withColumn("__n", F.row_number().over(last)).filter("__n = 1")
        fresh = fresh.unionByName(newest.select("platform", "url", "content", "captured_at", F.lit(-1).cast("long").alias("seq"), "content_hash", "page_key", "snapshot_id", F.lit(False).alias("fresh")))
    judged = admit(fresh, policy)
    order = ("seq",) if policy == "filesystem" else ("captured_at", "seq")
    rows = chain(judged.filter("accepted"), order=order)
    before = F.lag("content").over(Window.partitionBy("page_key").orderBy(*order))
    rows = rows.withColumn("__before", before).filter("fresh")
    d = F.when(F.col("change_status") == "changed", udfs.unified_diff("__before", "content"))
    rows = rows.withColumn("__d", d).withColumn("diff", F.col("__d.diff"))
    said = F.when(F.col("change_status") == "first_seen", FIRST).when(F.col("change_status") == "unchanged", SAME).otherwise(F.col("__d.summary"))
    return rows.withColumn("diff_summary", said).select(*RECORD, "seq", "diff"), judged.filter("fresh and not accepted").select("platform", "url", "captured_at", "seq")


def stored(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(records, index, diffs) of a store; none of an empty one. The index is each page's last record that none follows."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/records")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    rows = spark.read.parquet(f"{store}/records")
    last = F.max_by("snapshot_id", F.struct("part", "place")).alias("latest_snapshot_id")
    return rows.drop("diff"), rows.groupBy("page_key").agg(last), rows.filter("diff is not null").select("page_key", "snapshot_id", "diff")


def capture(spark: SparkSession, store: str, captures: DataFrame, policy: str = "sqlite") -> DataFrame:
    """Appends captures to a store as one part, each record with its diff in one row, and returns those that were refused."""
    held = stored(spark, store)
    records, refused = added(None if held is None else held[0], captures, policy)
    part = 1 + (0 if held is None else held[0].agg(F.max("part")).first()[0] or 0)
    refused = written(refused)
    order = F.struct("seq") if policy == "filesystem" else F.struct("captured_at", "seq")
    place = F.row_number().over(Window.partitionBy("page_key").orderBy(order)).cast("long")
    records.withColumn("part", F.lit(part).cast("long")).withColumn("place", place).drop("seq").write.mode("append").parquet(f"{store}/records")
    return refused


def latest(rows: DataFrame, key: str = "page_key") -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct("captured_at", "snapshot_id")).alias("r")).select(key, "r.*")


def audit(stored: DataFrame, key: str = "page_key") -> DataFrame:
    """Stored records whose link or status is not what their order implies."""
    order = Window.partitionBy(key).orderBy("captured_at", "snapshot_id")
    want = stored.withColumn("expected_previous", F.lag("snapshot_id").over(order)).withColumn("__h", F.lag("content_hash").over(order))
    status = F.when(F.col("expected_previous").isNull(), "first_seen").when(F.col("__h") == F.col("content_hash"), "unchanged").otherwise("changed")
    want = want.withColumn("expected_status", status).drop("__h")
    return want.filter(~F.col("previous_snapshot_id").eqNullSafe(F.col("expected_previous")) | (F.col("change_status") != F.col("expected_status")))


def orphans(objects: DataFrame, records: DataFrame, ref: str = "snapshot_ref") -> DataFrame:
    """Stored objects that no record names."""
    return objects.join(records.select(ref).distinct(), ref, "left_anti")


def admit(rows: DataFrame, policy: str = "sqlite", key: str = "page_key") -> DataFrame:
    """Arrivals (arrival order ``seq``) with ``accepted``: what a store of this kind takes of late captures.

    filesystem takes all; sqlite refuses earlier ones than the latest; git also equal times with other contents; s3 equal
    times too, but for an exact repeat. Refused captures are no later than the latest one taken, so the latest time is that
    of all arrivals, and the first to arrive with it is the one that was taken.
    """
    before = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__top", F.max(F.struct("captured_at", -F.col("seq"), "content_hash")).over(before))
    now, top, same = F.col("captured_at"), F.col("__top.captured_at"), F.col("__top.content_hash") == F.col("content_hash")
    ok = {"filesystem": F.lit(True), "sqlite": now >= top, "git": (now > top) | ((now == top) & same), "s3": (now > top) | ((now == top) & same)}[policy]
    return rows.withColumn("accepted", top.isNull() | ok).drop("__top")
