"""Feeds, sitemaps, fetches and content stores."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions import ids, text, timing, udfs
from auditlake.operators.common import best_of


def entries(feeds: DataFrame, content: str = "content") -> DataFrame:
    """Feed rows with an entry each: title, url, published_at, summary. ``refused`` tells which texts give none, and why."""
    small = feeds.filter(F.octet_length(content) <= K.XML_LIMIT)
    return small.select(*[c for c in feeds.columns if c != content], F.inline(udfs.parse_feed(content)))


def refused(feeds: DataFrame, content: str = "content") -> DataFrame:
    """Texts that are no feeds, with ``reason``: missing, too_large or not_a_feed."""
    size = F.octet_length(content)
    others = [c for c in feeds.columns if c != content]
    # rows that no parser need see are told apart from it, as it keeps all that its rows hold
    unread = feeds.filter(size.isNull() | (size > K.XML_LIMIT)).select(*others, F.when(size.isNull(), "missing").otherwise("too_large").alias("reason"))
    read = feeds.filter(size <= K.XML_LIMIT).filter(udfs.parse_feed(content).isNull())
    return unread.unionByName(read.select(*others, F.lit("not_a_feed").alias("reason")))


def outcome(status: Column, failed: Column) -> Column:
    """The result that a fetch's status stands for."""
    return F.when(status == 401, "login_required").when(status == 404, "not_applicable").when(failed | status.isNull() | (status >= 400), "blocked").otherwise("candidate_found")


#: Statuses after which another attempt may help.
RETRIED = (429, 500, 502, 503, 504)


def charset(reply: object) -> str:
    """The charset that a reply's headers name, else UTF-8."""
    headers = getattr(reply, "headers", None)
    return (headers.get_content_charset() if hasattr(headers, "get_content_charset") else None) or "utf-8"


FETCHED = "task_id string, requested_url string, final_url string, http_status int, attempts int, error_type string, body string"


def fetch(tasks: DataFrame, opener: Callable | None = None, attempts: int = 3, timeout: float = 20, pause: float = 1.0, limit: int = 5 << 20) -> DataFrame:
    """Fetches each public task's URL: bounded size, retries with growing pauses on ``RETRIED`` statuses, paced by host.

    A host's tasks share a partition, so pacing needs no coordination. A reply over the limit is refused whole
    (``ResponseTooLarge``), never cut; a charset that the reply names is used, and one that is unknown refused.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        go = opener or urllib.request.urlopen
        for rows in batches:
            out = []
            for task, url in zip(rows["task_id"], rows["url"]):
                status = error = body = None
                final, host, tried = url, urlsplit(url).netloc, 0
                while tried < attempts:
                    wait = last.get(host, 0) + pause - time.monotonic()
                    if wait > 0:
                        time.sleep(wait)
                    last[host], tried = time.monotonic(), tried + 1
                    try:
                        with go(url, timeout=timeout) as reply:
                            status, final, error = reply.status, reply.geturl(), None
                            content = reply.read(limit + 1)
                            if len(content) > limit:
                                error = "ResponseTooLarge"
                            else:
                                body = content.decode(charset(reply), "replace")
                        break
                    except urllib.error.HTTPError as e:
                        status, error = e.code, type(e).__name__
                        if e.code not in RETRIED:
                            break
                    except LookupError:  # of the charset
                        error = "UnknownCharset"
                        break
                    except OSError as e:
                        error = type(e).__name__
                    time.sleep(pause * 2**tried if tried < attempts else 0)
                out.append((task, url, final, status, tried, error, body))
            yield pd.DataFrame(out, columns=["task_id", "requested_url", "final_url", "http_status", "attempts", "error_type", "body"])

    dealt = tasks.filter(~F.col("requires_auth")).select("task_id", "url").repartition(text.authority(F.col("url")))
    got = dealt.mapInPandas(run, FETCHED)
    return got.withColumn("result", outcome(F.col("http_status"), F.col("error_type").isNotNull())).withColumn("content_hash", ids.hashed(text.content_lines(udfs.nfkc("body"), inner=False)))


def receipts(rows: DataFrame, method: Column) -> DataFrame:
    """Receipts with the hash of the evidence; authenticated text is hashed and never kept."""
    kept = method != "browser_authenticated"
    out = rows.withColumn("retrieval_method", method).withColumn("content_hash", F.when(F.col("body").isNotNull(), ids.hashed(text.content_lines(udfs.nfkc("body"), inner=False))))
    ref = F.concat(F.substring("content_hash", 1, 2), F.lit("/"), "content_hash")
    return out.withColumn("content_ref", F.when(kept, ref)).withColumn("body", F.when(kept, F.col("body")))


def store_contents(rows: DataFrame, path: str, known: DataFrame | None = None) -> None:
    """Appends contents that the store lacks, by shards of their hash."""
    fresh = rows.filter("content_ref is not null").select("content_hash", "body").dropDuplicates(["content_hash"])
    if known is not None:
        fresh = fresh.join(known.select("content_hash"), "content_hash", "left_anti")
    fresh.withColumn("shard", F.substring("content_hash", 1, 2)).write.mode("append").partitionBy("shard").parquet(path)


def read_contents(spark: SparkSession, path: str, refs: DataFrame) -> DataFrame:
    """content_ref and body of stored contents; a ref must be the relative path of a hash, and each body is checked by it."""
    good = F.col("content_ref").rlike("^[0-9a-f]{2}/[0-9a-f]{64}$") & (F.substring("content_ref", 1, 2) == F.substring("content_ref", 4, 2))
    wanted = refs.select(F.when(good, F.col("content_ref")).otherwise(F.raise_error(F.concat(F.lit("not a content ref: "), F.col("content_ref")))).alias("content_ref")).distinct()
    held = spark.read.parquet(path).select(F.concat_ws("/", F.substring("content_hash", 1, 2), F.col("content_hash")).alias("content_ref"), "content_hash", "body")
    return wanted.join(held, "content_ref").select("content_ref", "body")


def save_receipts(rows: DataFrame, path: str) -> None:
    """Appends receipts to the history; a receipt that is already there, by the hash of its content, is not added again."""
    digest = ids.hashed(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}))
    fresh = rows.withColumn("receipt_hash", digest).dropDuplicates(["receipt_hash"])
    try:
        known = rows.sparkSession.read.parquet(path).select("receipt_hash")
        fresh = fresh.join(known, "receipt_hash", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    fresh.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(path)


def current_receipts(spark: SparkSession, path: str) -> DataFrame:
    """Of each task the receipt that was checked last, then saved last."""
    return best_of(spark.read.parquet(path), ["task_id"], F.desc(timing.instant(F.col("checked_at"))), F.desc("saved_at"), F.col("receipt_hash"))
