"""A store of reports that ingests append to, with an inverted index for its search.

Each ingest writes one part: its sightings, the words that occur in them, the postings (word, event) and, last, its
reports. A part counts once its reports are complete, so readers never see half an ingest, and nothing that is stored is
written again. A report that comes a second time replaces the first as its later part wins; ``compact`` writes what is live
as one part, from which readers go on.

Postings lie in folders by their words' first letter, and in files and row groups by ranges of words, so that a word's
prefix reads few of them. Containment is looked up among the distinct words first: letters and digits that stand together
in a query stand in one word of the text. Found rows are then verified by the whole rule.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import text
from auditlake.operators.common import tasks

ROW = ["part", "report_key", "event_id"]


def _parts(spark: SparkSession, store: str) -> tuple[list[str], int]:
    """Paths of the complete parts that count, and the number of the newest part, complete or not."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(store)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return [], 0
    names = [m for x in fs.listStatus(root) if (m := re.fullmatch(r"(part|base)=(\d+)", x.getPath().getName()))]
    whole = sorted((int(m[2]), m[1], m[0]) for m in names if fs.exists(hadoop.Path(f"{store}/{m[0]}/reports/_SUCCESS")))
    first = max((n for n, kind, _ in whole if kind == "base"), default=0)
    return [f"{store}/{name}" for n, _, name in whole if n >= first], max((int(m[2]) for m in names), default=0)


def _read(spark: SparkSession, paths: list[str], name: str) -> DataFrame:
    if name == "postings":  # folders by first letter, below each part
        out = None
        for p in paths:
            rows = spark.read.parquet(f"{p}/postings")
            out = rows if out is None else out.unionByName(rows)
        return out
    return spark.read.option("mergeSchema", "true").parquet(*[f"{p}/{name}" for p in paths])


def _head(word: Column) -> Column:
    return F.concat(F.lit("x"), F.hex(F.substring(word, 1, 1)))


def append(spark: SparkSession, store: str, reports: DataFrame, sightings: DataFrame, columns: tuple[str, ...], kind: str = "part") -> int:
    """Writes a part and returns its number; reports and sightings share ``report_key``, ``columns`` are searched."""
    number = _parts(spark, store)[1] + 1
    target = f"{store}/{kind}={number}"
    sightings.withColumn("part", F.lit(number).cast("long")).write.parquet(f"{target}/sightings")
    rows = spark.read.parquet(f"{target}/sightings")
    have = [F.col(c) for c in columns if c in rows.columns]
    words = rows.select(*ROW, F.explode(F.array_distinct(text.tokens(F.concat_ws(" ", *have)))).alias("word")).distinct()
    words = words.withColumn("head", _head(F.col("word")))
    words.repartitionByRange(tasks(spark), "head", "word", "event_id").sortWithinPartitions("head", "word").write.partitionBy("head").parquet(f"{target}/postings")
    spark.read.parquet(f"{target}/postings").groupBy("word").agg(F.count("*").alias("n")).write.parquet(f"{target}/words")
    reports.withColumn("part", F.lit(number).cast("long")).write.parquet(f"{target}/reports")
    return number


def live(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame] | None:
    """(reports, sightings) that count, with the part they are in; none of an empty store."""
    paths, _ = _parts(spark, store)
    if not paths:
        return None
    reports = _read(spark, paths, "reports")
    newest = reports.groupBy("report_key").agg(F.max("part").alias("part"))
    return reports.join(newest, ["report_key", "part"], "left_semi"), _read(spark, paths, "sightings").join(newest, ["report_key", "part"], "left_semi")


def compact(spark: SparkSession, store: str, columns: tuple[str, ...]) -> None:
    """Writes what is live as one part; earlier ones no longer count and may be removed."""
    held = live(spark, store)
    if held is not None:
        append(spark, store, held[0].drop("part"), held[1].drop("part"), columns, "base")


def of_prefixes(postings: DataFrame, words: list[str]) -> DataFrame:
    """Postings of the words that begin with one of these."""
    wanted = F.lit(False)
    for w in words:
        wanted = wanted | ((F.col("head") == "x" + w[0].encode().hex().upper()) & F.col("word").startswith(w))
    return postings.filter(wanted)


def search(spark: SparkSession, store: str, query: str, columns: tuple[str, ...], limit: int = 20) -> DataFrame:
    """event_id and rank of the first ``limit`` events that match: words by prefix (0), then containment (1)."""
    query = query.strip()
    if not query:
        raise ValueError("search query must not be blank")
    if not 1 <= limit <= 100:
        raise ValueError("limit must be an integer from 1 to 100")
    paths, _ = _parts(spark, store)
    if not paths:
        return spark.createDataFrame([], "event_id string, rank int")
    reports, sightings = live(spark, store)
    postings = _read(spark, paths, "postings")
    now = reports.select("report_key", "part").distinct()
    begin = of_prefixes(postings, sorted(set(re.findall(r"\w+", query.lower())))).join(now, ["report_key", "part"], "left_semi").select("event_id", F.lit(0).alias("rank"))
    runs = [r for piece in re.split("[%_]", query) for r in re.findall("[A-Za-z0-9]+", piece)]
    if runs:
        # the longest run stands in one word; other letters may change their number of characters with their case
        word = _read(spark, paths, "words").filter(F.contains("word", F.lit(max(runs, key=len).lower()))).select("word", _head(F.col("word")).alias("head")).distinct()
        sightings = sightings.join(postings.join(word, ["head", "word"]).select(*ROW).distinct(), ROW, "left_semi")
    part = sightings.filter(text.like_any([F.col(c) for c in columns if c in sightings.columns], query)).select("event_id", F.lit(1).alias("rank"))
    return begin.union(part).groupBy("event_id").agg(F.min("rank").alias("rank")).orderBy("rank", "event_id").limit(limit)
