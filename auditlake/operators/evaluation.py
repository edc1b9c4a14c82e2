"""How well predicted events agree with reviewed labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions import ids, score, text, timing, udfs
from auditlake.operators import validation

DATES = ("published_date", "effective_date", "deadline")


def matched(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """Full outer join by run and event_id: per event its outcome and which fields agree.

    ``labels``: run, event_id, should_include, accepted (array of canonical URLs), dates, status, level.
    """
    gold = labels.filter("should_include")
    keys = ["run", "event_id"]
    p = predicted.select(*keys, F.lit(True).alias("p"), text.canonical_url(F.col("source_url")).alias("url"), *[F.col(c).alias(f"p_{c}") for c in (*DATES, "status", "level")])
    g = gold.select(*keys, F.lit(True).alias("g"), "accepted", *[F.col(c).alias(f"g_{c}") for c in (*DATES, "status", "level")])
    rows = p.join(g, keys, "full_outer")
    tp = F.col("p").isNotNull() & F.col("g").isNotNull()
    outcome = F.when(tp, "tp").when(F.col("p").isNotNull(), "fp").otherwise("fn")
    same = lambda c: F.when(tp, F.col(f"p_{c}").eqNullSafe(F.col(f"g_{c}")).cast("int"))
    dates = sum((F.coalesce(same(c), F.lit(0)) for c in DATES), F.lit(0))
    return rows.select(*keys, outcome.alias("outcome"), F.when(tp, F.array_contains("accepted", F.col("url")).cast("int")).alias("source_ok"), F.when(tp, dates).alias("dates_ok"), same("status").alias("status_ok"), same("level").alias("level_ok"))


def sums(rows: DataFrame, by_run: bool = False) -> DataFrame:
    """Sums of outcomes; ``by_run``: one row a run and one, with a null run, over all."""
    n = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).alias(name)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    outcome = F.col("outcome")
    return (rows.rollup("run") if by_run else rows.groupBy()).agg(
        n(outcome == "tp", "tp"), n(outcome == "fp", "fp"), n(outcome == "fn", "fn"),
        total("source_ok"), total("dates_ok"), total("status_ok"), total("level_ok"), n((outcome == "fp") | (F.col("source_ok") == 0), "unsupported_sources"),
    )


def errors(rows: DataFrame) -> DataFrame:
    """run, kind and id of each error: false positives and negatives, and sources that are not accepted."""
    outcome = F.col("outcome")
    kinds = F.array(F.when(outcome == "fp", "false_positive"), F.when(outcome == "fn", "false_negative"), F.when((outcome == "fp") | (F.col("source_ok") == 0), "unsupported_source"))
    return rows.select("run", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"), F.col("event_id").cast("string").alias("id"))


def counts(rows: DataFrame, by_run: bool = False) -> DataFrame:
    """``sums`` with the ids of errors as arrays, for one report's page; ``errors`` has them as rows."""
    ids_of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("id")))).alias(f"{kind}_ids")
    found = rows.select("run", F.col("event_id").alias("id"), F.explode(F.array(F.lit(None).cast("string"), F.when(F.col("outcome") == "fp", "false_positive"), F.when(F.col("outcome") == "fn", "false_negative"), F.when((F.col("outcome") == "fp") | (F.col("source_ok") == 0), "unsupported_source"))).alias("kind"))
    found = (found.rollup("run") if by_run else found.groupBy()).agg(ids_of("false_positive"), ids_of("false_negative"), ids_of("unsupported_source")).withColumnsRenamed({"run": "__r"} if by_run else {})
    out = sums(rows, by_run)
    if by_run:
        return out.join(found, F.col("run").eqNullSafe(F.col("__r"))).drop("__r")
    return out.withColumn("__k", F.lit(1)).join(found.withColumn("__k", F.lit(1)), "__k").drop("__k")


def metrics(totals: DataFrame) -> DataFrame:
    """Ratios from sums; a ratio without denominator is null."""
    out = totals.withColumn("precision", score.ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", score.ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    out = out.withColumn("f1", score.f1(F.col("precision"), F.col("recall")))
    for name, c, by in (("primary_source_rate", "source_ok", 1), ("date_accuracy", "dates_ok", len(DATES)), ("status_accuracy", "status_ok", 1), ("level_accuracy", "level_ok", 1)):
        out = out.withColumn(name, score.ratio(F.col(c), F.col("tp") * by))
    return out


def case_outcomes(cases: DataFrame, matches: DataFrame) -> DataFrame:
    """Each deduplication case with ``correct``; of several matches of a current_id the last (by pos) counts."""
    last = matches.groupBy("run", "current_id").agg(F.max_by(F.struct("previous_id", "disposition"), "pos").alias("m"))
    ok = (F.col("m.previous_id") == F.col("c.previous_id")) & (F.col("m.disposition") == F.col("c.expected_disposition"))
    return cases.alias("c").join(last.alias("l"), ["run", "current_id"], "left").select("run", "current_id", F.coalesce(ok, F.lit(False)).alias("correct"))


def gates(out: DataFrame, reviewed: Column, limits: Mapping[str, float] = K.GATES, history: bool = False) -> DataFrame:
    """Eight checks and whether all pass. A null metric fails; without cases deduplication passes only a limit of 0, and
    never in a history."""
    at_least = lambda name: F.coalesce(F.col(name) >= limits[name], F.lit(False))
    dedup = at_least("deduplication_accuracy")
    if not history and limits["deduplication_accuracy"] == 0:
        dedup = dedup | (F.col("dedup_cases") == 0)
    checks = {
        "independently_reviewed": reviewed,
        "minimum_positive_events": F.col("tp") + F.col("fn") >= limits["minimum_positive_events"],
        **{n: at_least(n) for n in ("precision", "recall", "primary_source_rate", "date_accuracy")},
        "deduplication_accuracy": dedup,
        "unsupported_sources": F.col("unsupported_sources") <= limits["unsupported_sources"],
    }
    passed = F.lit(True)
    for c in checks.values():
        passed = passed & c
    return out.withColumn("checks", F.struct(*[c.alias(n) for n, c in checks.items()])).withColumn("passed", passed)


def evaluate(predicted: DataFrame, labels: DataFrame, cases: DataFrame, matches: DataFrame, reviewed: bool, limits: Mapping[str, float] = K.GATES, by_run: bool = False) -> DataFrame:
    """Metrics and gates of one run, or of each and of their sum."""
    out = metrics(counts(matched(predicted, labels), by_run))
    dedup = case_outcomes(cases, matches)
    dedup = (dedup.rollup("run") if by_run else dedup.groupBy()).agg(F.count("*").alias("dedup_cases"), F.coalesce(F.sum(F.col("correct").cast("int")), F.lit(0)).alias("dedup_correct"))
    if by_run:
        dedup = dedup.withColumnRenamed("run", "__r")
        out = out.join(dedup, F.col("run").eqNullSafe(F.col("__r")), "left").drop("__r").fillna(0, ["dedup_cases", "dedup_correct"])
    else:
        out = out.withColumn("__k", F.lit(1)).join(dedup.withColumn("__k", F.lit(1)), "__k").drop("__k")
    out = out.withColumn("deduplication_accuracy", score.ratio(F.col("dedup_correct"), F.col("dedup_cases")))
    return gates(out, F.lit(reviewed), limits, history=by_run)


def scaffold(candidates: DataFrame, final: DataFrame) -> DataFrame:
    """Label drafts: each candidate with whether the final report has it, and final events without a candidate."""
    context = F.struct(*[F.col(c) for c in ("title", "jurisdiction", "authority", "source_title", "source_url")]).alias("review_context")
    have = final.select("event_id").distinct().withColumn("__f", F.lit(True))
    known = candidates.join(have, "event_id", "left").select("event_id", F.col("__f").isNotNull().alias("should_include"), F.lit("candidate").alias("origin"), context)
    rest = final.join(candidates.select("event_id"), "event_id", "left_anti").select("event_id", F.lit(True).alias("should_include"), F.lit("final_only").alias("origin"), context)
    return known.unionByName(rest)


REVIEW_STATUSES = ("draft", "independently_reviewed")


def label_rules(files: DataFrame) -> DataFrame:
    """What is wrong with label sets (report, raw): report, location, message."""
    rows = files.select("report", F.try_parse_json("raw").alias("v"))
    v, get = F.col("v"), validation.get
    blank = lambda c: ~F.coalesce(text.nonblank(c), F.lit(False))
    outside = lambda c, allowed: ~F.coalesce(c.isin(*allowed), F.lit(False))
    reviewed = get(v, "review_status").eqNullSafe(F.lit("independently_reviewed"))
    records = F.try_variant_get(v, "$.records", "array<variant>")
    cases = validation.kind_of(v, "deduplication_cases")
    root = [
        (F.lit("dataset_version"), "must be 1", ~get(v, "dataset_version", "int").eqNullSafe(F.lit(1))),
        (F.lit("dataset_name"), "must be nonblank", blank(get(v, "dataset_name"))),
        (F.lit("review_status"), "is not a known status", outside(get(v, "review_status"), REVIEW_STATUSES)),
        (F.lit("reviewed_by"), "is required after a review", reviewed & blank(get(v, "reviewed_by"))),
        (F.lit("reviewed_at"), "must be an ISO datetime with an offset", reviewed & ~timing.valid_instant(get(v, "reviewed_at"))),
        (F.lit("records"), "must be a non-empty array", ~F.coalesce(F.size(records) > 0, F.lit(False))),
        (F.lit("deduplication_cases"), "must be an array", cases.isNotNull() & ~cases.startswith("ARRAY<")),
    ]
    again = lambda rows, name: rows.withColumn("again", F.row_number().over(Window.partitionBy("report", get(F.col("item"), name)).orderBy("i")) > 1)
    r, dot = F.col("item"), F.col("dot")
    at = lambda n: F.concat(dot, F.lit(n))
    wanted = F.coalesce(get(r, "should_include", "boolean"), F.lit(False))
    urls = F.try_variant_get(r, "$.accepted_primary_source_urls", "array<string>")
    each = [
        (at("event_id"), "must be nonblank", blank(get(r, "event_id"))),
        (at("event_id"), "is a duplicate", F.col("again") & get(r, "event_id").isNotNull()),
        (at("should_include"), "must be boolean", ~validation.kind_of(r, "should_include").eqNullSafe(F.lit("BOOLEAN"))),
        (at("accepted_primary_source_urls"), "must be http(s) URLs", wanted & ~F.coalesce((F.size(urls) > 0) & F.forall(urls, text.is_url), F.lit(False))),
        (at("status"), "is not a known status", wanted & outside(get(r, "status"), K.STATUSES)),
        (at("level"), "is not a known level", wanted & outside(get(r, "level"), K.LEVELS)),
        *[(at(n), "must be an ISO date or null", wanted & get(r, n).isNotNull() & ~timing.valid_date(get(r, n))) for n in DATES],
    ]
    names = ("current_id", "previous_id", "expected_disposition")
    of_case = [*[(at(n), "must be nonblank", blank(get(r, n))) for n in names], (at("current_id"), "is a duplicate", F.col("again") & get(r, "current_id").isNotNull())]
    records, cases = (again(validation.elements(rows, v, path, F.lit("")), name) for path, name in (("records", "event_id"), ("deduplication_cases", "current_id")))
    return validation.found(rows, root).unionByName(validation.found(records, each)).unionByName(validation.found(cases, of_case))


def report_rules(files: DataFrame) -> DataFrame:
    """What keeps reports from being evaluated: ids of their events and of their deduplication's matches."""
    rows = files.select("report", F.try_parse_json("raw").alias("v"))
    kinds = [F.schema_of_variant(F.try_variant_get("v", f"$.{p}", "variant")) for p in ("events", "deduplication.matches")]
    root = [
        (F.lit("events"), "must be an array", ~F.coalesce(kinds[0].startswith("ARRAY<"), F.lit(False))),
        (F.lit("deduplication.matches"), "must be an array", kinds[1].isNotNull() & ~kinds[1].startswith("ARRAY<")),
    ]
    r, dot = F.col("item"), F.col("dot")
    blank = lambda n: ~F.coalesce(text.nonblank(validation.get(r, n)), F.lit(False))
    events = validation.elements(rows, F.col("v"), "events", F.lit(""))
    events = events.withColumn("again", F.row_number().over(Window.partitionBy("report", validation.get(r, "id")).orderBy("i")) > 1)
    of_event = [(F.concat(dot, F.lit("id")), "must be nonblank", blank("id")), (F.concat(dot, F.lit("id")), "is a duplicate", F.col("again") & validation.get(r, "id").isNotNull())]
    matches = validation.elements(rows, F.col("v"), "deduplication.matches", F.lit(""))
    of_match = [(F.concat(dot, F.lit("current_id")), "must be nonblank", blank("current_id"))]
    return validation.found(rows, root).unionByName(validation.found(events, of_event)).unionByName(validation.found(matches, of_match))


def content_hash(raw: Column) -> Column:
    """The hash of a JSON text in canonical form: what names a set of labels or a report."""
    return ids.hashed(udfs.canonical_json(raw))


def history_hash(runs: DataFrame) -> DataFrame:
    """One hash of several runs' (run_pos, hash), in their order."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_pos", "hash"))), lambda r: r["hash"]), "")
    return runs.agg(ids.hashed(ordered).alias("history_hash"))


def case_errors(outcomes: DataFrame, cases: DataFrame) -> DataFrame:
    """Per run the current_ids of wrong deduplication cases, in the order of the cases (``pos``)."""
    wrong = outcomes.filter("not correct").join(cases.select("run", "current_id", "pos"), ["run", "current_id"])
    return wrong.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "current_id"))), lambda x: x["current_id"]).alias("error_ids"))
