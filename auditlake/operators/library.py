"""A library of reports: upserts, search, histories and statistics.

Sightings: report_key, event_id, report_date, cutoff, and the event's columns. Orders of sightings are by (cutoff,
report_date) as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions import ids, text
from auditlake.operators import library_index, validation
from auditlake.operators.common import best_of
from auditlake.sources import reports as sources

SEARCHED = ("title", "jurisdiction", "authority", "products", "summary", "impact", "action", "source_title")


def upsert(stored: DataFrame, incoming: DataFrame, version: str = "ingested_at") -> DataFrame:
    """Whole reports replace earlier ones of their key; of incoming ones the last by version."""
    last = incoming.groupBy("report_key").agg(F.max(version).alias("__v"))
    fresh = incoming.join(last, "report_key").filter(F.col(version) == F.col("__v")).drop("__v")
    return stored.join(last.select("report_key"), "report_key", "left_anti").unionByName(fresh)


def history(sightings: DataFrame) -> DataFrame:
    """event_id, first_seen, last_seen, sightings, latest report; one hash aggregation."""
    at = F.struct("cutoff", "report_date", "report_key")
    return sightings.groupBy("event_id").agg(F.min_by("report_date", at).alias("first_seen"), F.max_by("report_date", at).alias("last_seen"), F.count("*").alias("sighting_count"), F.max_by("report_key", at).alias("latest_report_key"))


def search(sightings: DataFrame, query: str, limit: int = 20, columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    """Histories of events that match: words by prefix first, then containment; cut to ``limit``, then newest first."""
    if not query.strip():
        raise ValueError("search query must not be blank")
    if not 1 <= limit <= 100:
        raise ValueError("limit must be an integer from 1 to 100")
    have = [F.col(c) for c in columns if c in sightings.columns]
    word = text.prefix_match(F.concat_ws(" ", *have), query.strip())
    part = text.like_any(have, query.strip())
    rank = F.min(F.when(word, 0).otherwise(1)).alias("rank")
    hits = sightings.filter(word | part).groupBy("event_id").agg(rank).orderBy("rank", "event_id").limit(limit)
    return history(sightings.join(F.broadcast(hits.select("event_id")), "event_id", "left_semi")).orderBy(F.desc("last_seen"), F.desc("event_id"))


def show(sightings: DataFrame, event_id: str) -> DataFrame:
    """An event's sightings in order."""
    return sightings.filter(F.col("event_id") == event_id).orderBy("cutoff", "report_date")


def stats(sightings: DataFrame) -> DataFrame:
    return sightings.agg(F.countDistinct("report_key").alias("reports"), F.count("*").alias("sightings"), F.countDistinct("event_id").alias("events"), F.min("report_date").alias("first_report"), F.max("report_date").alias("last_report"))


def drill_context(sightings: DataFrame, event_id: str) -> DataFrame:
    """The event's last sighting with its count, to plan a closer look from."""
    at = Window.partitionBy("event_id").orderBy(F.desc("cutoff"), F.desc("report_date"))
    rows = sightings.filter(F.col("event_id") == event_id).withColumn("n", F.count("*").over(Window.partitionBy("event_id")))
    return rows.withColumn("place", F.row_number().over(at)).filter("place = 1").drop("place")


def tables(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame] | None:
    """(reports, sightings) of a store; none of an empty store."""
    return library_index.live(spark, store)


def find(spark: SparkSession, store: str, query: str, limit: int = 20) -> DataFrame:
    """``search`` over a store, by its index."""
    hits = library_index.search(spark, store, query, SEARCHED, limit)
    held = tables(spark, store)
    if held is None:
        raise ValueError("the library is empty")
    return history(held[1].join(hits.select("event_id"), "event_id", "left_semi")).orderBy(F.desc("last_seen"), F.desc("event_id"))


def ingest(spark: SparkSession, store: str, path: str, ingested_at: str, aliases: DataFrame | None = None) -> dict:
    """Adds the valid reports of a file or folder to a store of tables; a broken single file is an error, others are skipped.

    The reports are appended as one part of the store, which counts once it is complete, so readers never see half an ingest.
    Of several files of one report the last by path holds; a report that is stored already is replaced.
    """
    found = sources.raw(spark, path)
    if found.isEmpty():
        raise ValueError(f"no JSON files in {path}")
    valid, skipped = sources.split_valid(found, aliases)
    skipped = [r.asDict() for r in skipped.orderBy("report").toLocalIterator()]
    if skipped and found.count() == 1:
        raise ValueError(f"report failed validation: {validation.preview(validation.violations(found, aliases))}")
    rows = sources.events(valid)
    key = ids.report_key(F.col("report_date"), F.col("cutoff"), F.col("scope")).alias("report_key")
    head = rows.select("report", key, "report_date", "cutoff").distinct()
    counts = rows.groupBy("report").agg(F.count("*").alias("events"))
    fresh = head.join(counts, "report").join(valid.select("report", ids.hashed(F.col("raw")).alias("content_hash")), "report")
    fresh = best_of(fresh, ["report_key"], F.desc("report")).select("report_key", F.lit(ingested_at).alias("ingested_at"), F.col("report").alias("path"), "report_date", "cutoff", "events", "content_hash")
    seen = rows.join(fresh.select(F.col("path").alias("report"), "report_key"), "report").withColumnsRenamed({"id": "event_id", "report": "path"}).withColumn("ingested_at", F.lit(ingested_at))
    number = library_index.append(spark, store, fresh, seen, SEARCHED)
    done, events = tables(spark, store)
    mine = done.filter(F.col("part") == number)
    return {"imported_count": mine.count(), "event_count": events.join(mine.select("report_key"), "report_key", "left_semi").count(), "skipped": skipped}
