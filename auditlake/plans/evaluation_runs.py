"""Evaluations from files, and a history of runs that grows by parts.

A run's state is what its own files say: one row of sums and one row for each error. States add up, so a history of runs
is the sum of their rows, and a new run reads its own files alone. Ids of errors stay rows, however many there are.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions import score, text
from auditlake.operators import evaluation

SUMS = ("tp", "fp", "fn", "source_ok", "dates_ok", "status_ok", "level_ok", "unsupported_sources", "dedup_cases", "dedup_correct", "candidates", "unreviewed")


def _items(files: DataFrame, path: str) -> DataFrame:
    """run, pos and item (variant) of an array in each file (run, raw)."""
    rows = files.select("run", F.try_parse_json("raw").alias("v"))
    return rows.select("run", F.posexplode(F.try_variant_get("v", f"$.{path}", "array<variant>")).alias("pos", "item"))


def _field(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("item", f"$.{name}", kind).alias(name.rsplit(".", 1)[-1])


def tables(reports: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Predicted events, labelled events, deduplication cases and matches of files (run, raw)."""
    common = [_field(n) for n in (*evaluation.DATES, "status", "level")]
    predicted = _items(reports, "events").select("run", _field("id").alias("event_id"), _field("source_url"), *common)
    accepted = F.transform(F.try_variant_get("item", "$.accepted_primary_source_urls", "array<string>"), lambda u: text.canonical_url(u)).alias("accepted")  # noqa: PLW0108  (a second parameter would be the place)
    gold = _items(labels, "records").select("run", _field("event_id"), _field("should_include", "boolean"), accepted, *common)
    cases = _items(labels, "deduplication_cases").select("run", "pos", _field("current_id"), _field("previous_id"), _field("expected_disposition"))
    matches = _items(reports, "deduplication.matches").select("run", F.col("pos").cast("long").alias("pos"), _field("current_id"), _field("previous_id"), _field("disposition"))
    return predicted, gold, cases, matches


def states(reports: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row of sums, rows of errors) of each run; a run whose labels nobody has reviewed is counted as ``unreviewed``."""
    predicted, gold, cases, matches = tables(reports, labels)
    rows = evaluation.matched(predicted, gold)
    judged = evaluation.case_outcomes(cases, matches)
    n = lambda c, name: F.sum(c.cast("long")).alias(name)
    dedup = judged.groupBy("run").agg(F.count("*").alias("dedup_cases"), n(F.col("correct"), "dedup_correct"))
    status = F.try_variant_get(F.try_parse_json("raw"), "$.review_status", "string")
    whole = labels.select("run", (~status.eqNullSafe(F.lit("independently_reviewed"))).cast("long").alias("unreviewed"))
    many = gold.groupBy("run").agg(F.count("*").alias("candidates"))
    out = whole.join(evaluation.sums(rows, by_run=True).filter("run is not null"), "run", "left").join(dedup, "run", "left").join(many, "run", "left")
    wrong = judged.filter("not correct").select("run", F.lit("deduplication").alias("kind"), F.col("current_id").alias("id"))
    return out.select("run", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in SUMS]), evaluation.errors(rows).unionByName(wrong)


def totalled(sums: DataFrame, limits: Mapping[str, float] = K.GATES, history: bool = False) -> DataFrame:
    """Metrics and gates of all runs together, from their rows of sums."""
    out = evaluation.metrics(sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS], F.count("*").alias("runs")))
    out = out.withColumn("deduplication_accuracy", score.ratio(F.col("dedup_correct"), F.col("dedup_cases")))
    return evaluation.gates(out, F.col("unreviewed") == 0, limits, history)


def record(store: str, reports: DataFrame, labels: DataFrame) -> None:
    """Adds the states of runs that the store lacks; of the files only these are read."""
    sums, errors = states(reports, labels)
    sums.write.mode("append").parquet(f"{store}/sums")
    errors.write.mode("append").parquet(f"{store}/errors")


def history(spark: SparkSession, store: str, limits: Mapping[str, float] = K.GATES) -> DataFrame:
    """Metrics and gates over all recorded runs."""
    return totalled(spark.read.parquet(f"{store}/sums"), limits, history=True)


def broken(reports: DataFrame, labels: DataFrame) -> DataFrame:
    """What keeps these files from being evaluated."""
    named = lambda files: files.select(F.col("run").alias("report"), "raw")
    return evaluation.label_rules(named(labels)).unionByName(evaluation.report_rules(named(reports)))


def drafts(candidates: DataFrame, final: DataFrame) -> DataFrame:
    """Label drafts from two reports (run, raw): candidates and the final one."""
    rows = lambda files: _items(files, "events").select(_field("id").alias("event_id"), *[_field(n) for n in ("title", "jurisdiction", "authority", "source_title", "source_url")])
    return evaluation.scaffold(rows(candidates), rows(final)).orderBy("event_id")


def files_of(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """run and raw of one file a run."""
    named = spark.createDataFrame([(p.split("://", 1)[-1], r) for r, p in paths.items()], "path string, run string")
    raw = spark.read.option("wholetext", True).text(list(paths.values())).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("path"), F.col("value").alias("raw"))
    return raw.join(named, "path").select("run", "raw")

