"""Queries that plant faults in JSON records and look for them with the contract's rules.

Every record of a table gets one variant of a sound document, by its number; the SQL lists what each variant breaks. A
rule that finds too little, too much or elsewhere changes the counts.
"""

from __future__ import annotations

import copy
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.operators import validation
from auditlake.operators.common import spread
from auditlake.workloads import query, table

GONE = object()
HEX = "ab" * 32
AT = "2026-07-20T00:00:00+00:00"
Fault = tuple[dict, list[tuple[str, str]]]  # changed paths, what is found: location and message

EVENT = {
    "id": "e1", "title": "T", "status": "new", "level": "medium", "score": 5, "score_breakdown": dict.fromkeys(K.BREAKDOWN, 1), "jurisdiction": "US", "authority": "A",
    "published_date": "2026-07-01", "effective_date": None, "deadline": None, "products_or_channels": ["p"], "summary": "s", "impact": "i", "action": "a", "rationale": "r",
    "source_title": "S", "source_url": "https://x.org/1", "retrieved_date": "2026-07-20", "hs_codes": ["8471.30"],
    "platform_policy": {
        "platform": "Acme Market", "seller_market": "US", "program": "P", "policy_area": "other", "change_type": "new_rule", "seller_scope": "all", "previous_state": None,
        "new_state": "n", "enforcement_consequence": "e", "backend_verification_required": True,
    },
    "action_items": [{"owner": "o", "action": "a", "deadline": "d", "completion_evidence": "c"}],
    "applicability": {"organization": "O", "status": "matched", "reason": "r", "matched_items": [{"basis": ["hs_prefix"]}]},
}
CHECKS = [
    {
        "source_type": "official_updates", "url": "https://acme.example/u", "result": "no_relevant_update", "checked_at": AT, "notes": "n",
        "snapshot": {"content_hash": HEX, "captured_at": AT, "change_status": "first_seen"},
        "acquisition_receipt": {"task_id": "ab" * 12, "retrieval_method": "http", "attempts": 1, "http_status": 200, "content_hash": HEX, "content_ref": "ab/" + HEX, "error_type": None, "route_verified": True},
    },
    {
        "source_type": "current_policy", "url": "https://acme.example/p", "result": "verified_event", "checked_at": AT, "notes": "n",
        "snapshot": {"content_hash": HEX, "captured_at": AT, "change_status": "changed", "previous_snapshot_id": "x", "storage_backend": "git", "snapshot_ref": "a/b", "index_recovered": False, "git_commit": "c", "git_tree": "t"},
    },
]
REPORT = {
    "report_date": "2026-07-21", "timezone": "UTC", "cutoff": "2026-07-21T00:00:00+00:00", "language": "en", "scope": ["Acme Market"], "coverage_gaps": [], "events": [EVENT],
    "coverage_ledger": [{
        "platform": "Acme Market", "seller_market": "US", "program": "P", "lookback_start": "2026-07-01T00:00:00+00:00", "public_update_checked": True, "current_policy_checked": True,
        "dashboard_checked": False, "access_result": "public_checked", "checked_at": AT, "sources_checked": CHECKS, "verified_event_ids": ["e1"], "gaps": [],
    }],
}


def changed(document: dict, changes: dict) -> str:
    """The document as JSON with values put at dotted paths, or taken out."""
    out = copy.deepcopy(document)
    for path, value in changes.items():
        *way, last = [int(k) if k.isdigit() else k for k in path.split(".")]
        node = out
        for key in way:
            node = node[key]
        if value is GONE:
            del node[last]
        else:
            node[last] = value
    return json.dumps(out)


def planted(spark: SparkSession, d: str, document: dict, faults: list[Fault], dealt: bool = False) -> DataFrame:
    """report, raw and fault: a document with one fault for each customer; ``dealt`` over all tasks."""
    texts = spark.createDataFrame([(n, changed(document, c)) for n, (c, _) in enumerate(faults)], "fault long, raw string")
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("report"), (F.col("c_custkey") % len(faults)).alias("fault"))
    # a few bytes of customers become many of texts
    return (spread(c, "report") if dealt else c).join(F.broadcast(texts), "fault")


def told(rows: DataFrame, found: DataFrame) -> DataFrame:
    """How often each fault leads to each finding."""
    met = rows.select("report", "fault").join(found, "report")
    return met.groupBy("fault", "location", "message").agg(F.count("*").alias("n"))


def counted(faults: list[Fault]) -> str:
    """The same as SQL, from the list."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({n}, {quote(at)}, {quote(message)})" for n, (_, found) in enumerate(faults) for at, message in found)
    return f"SELECT fault::BIGINT AS fault, location, message, count(*) AS n FROM customer JOIN (VALUES {rows}) f(fault, location, message) ON c_custkey % {len(faults)} = fault GROUP BY ALL"


def family(name: str, doc: str, prefix: str, faults: dict[str, list]) -> None:
    """Registers a query over one family's faults; the first document is sound."""
    listed: list[Fault] = [({}, [])]
    for entry in faults.items():
        (changes, found) = entry[1]
        listed.append(({prefix + k: v for k, v in changes.items()}, found))

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = planted(spark, d, REPORT, listed)
        aliases = spark.createDataFrame([("acme", "Acme Market"), ("acme market", "Acme Market"), ("other shop", "Other Shop")], "alias string, platform string")
        return told(rows, validation.violations(rows.select("report", "raw"), aliases))

    run.__name__, run.__doc__ = name, doc
    query(counted(listed))(run)


DATE, INSTANT, KNOWN = "must be an ISO date", "must be an ISO datetime with an offset", "is not a known "
REF = "must be a portable path"
E, P, L = "events[0].", "events[0].platform_policy.", "coverage_ledger[0]."
S, R = L + "sources_checked[0].", L + "sources_checked[0].acquisition_receipt."

family("faults_root", "Root fields and times.", "", {
    "date": ({"report_date": "2026-02-30"}, [("report_date", DATE)]),
    "cutoff": ({"cutoff": "2026-07-21T00:00:00"}, [("cutoff", INSTANT)]),
    "window": ({"window_start": "yesterday"}, [("window_start", INSTANT)]),
    "null window": ({"window_start": None}, []),
    "missing": ({"timezone": GONE}, [("timezone", "is required")]),
    "kind": ({"language": 5}, [("language", "must be string")]),
    "gaps": ({"coverage_gaps": "none"}, [("coverage_gaps", "must be array")]),
})
family("faults_event", "Ids, scores, levels, dates, sources and codes of events.", "events.0.", {
    "blank id": ({"id": " "}, [(E + "id", "must not be blank"), (L + "verified_event_ids[0]", "names no event")]),
    "status": ({"status": "odd"}, [(E + "status", KNOWN + "status")]),
    "level": ({"level": "severe"}, [(E + "level", KNOWN + "level")]),
    "range": ({"score": 11}, [(E + "score", "must be from 0 to 10"), (E + "score", "must equal the breakdown's sum")]),
    "text score": ({"score": "5"}, [(E + "score", "must be int")]),
    "sum": ({"score": 6}, [(E + "score", "must equal the breakdown's sum")]),
    "extra dimension": ({"score_breakdown.luck": 0}, [(E + "score_breakdown", "must have exactly the five dimensions")]),
    "missing dimension": ({"score_breakdown.urgency": GONE}, [(E + "score_breakdown", "must have exactly the five dimensions"), (E + "score_breakdown", "must hold integers from 0 to 2")]),
    "dimension of 3": ({"score_breakdown.urgency": 3}, [(E + "score_breakdown", "must hold integers from 0 to 2")]),
    "unruled level": ({"level": "high"}, [(E + "level", "must follow the score or a documented override")]),
    "override": ({"level": "high", "level_override": {"level": "high", "reason": "why"}}, []),
    "override without reason": ({"level": "high", "level_override": {"level": "high", "reason": " "}}, [(E + "level", "must follow the score or a documented override")]),
    "redundant override": ({"level_override": {"level": "medium", "reason": "why"}}, [(E + "level_override", "is redundant")]),
    "override's fields": ({"level": "high", "level_override": {"level": "high"}}, [(E + "level", "must follow the score or a documented override"), (E + "level_override.reason", "is required")]),
    "no evidence": ({"score_breakdown.evidence": 0, "score_breakdown.urgency": 2}, [(E + "level", "must be watch without evidence")]),
    "unconfirmed": ({"status": "unconfirmed"}, [(E + "level", "must be watch while unconfirmed")]),
    "date": ({"published_date": "2026-13-01", "retrieved_date": "01.07.2026"}, [(E + "published_date", DATE), (E + "retrieved_date", DATE)]),
    "instant": ({"effective_at": "2026-07-01T10:00:00", "deadline_at": "2026-07-01T10:00:00Z"}, [(E + "effective_at", INSTANT)]),
    "null date": ({"published_date": None}, []),
    "codes": ({"hs_codes": ["847", "abc"]}, [(E + "hs_codes", "must be codes of 4 to 10 digits")]),
    "url": ({"source_url": "ftp://x.org"}, [(E + "source_url", "must be an http(s) URL")]),
    "source": ({"source_title": ""}, [(E + "source_title", "must not be blank")]),
    "missing": ({"impact": GONE}, [(E + "impact", "is required")]),
})
family("faults_duplicate_ids", "The second and later events of an id.", "", {
    "twice": ({"events": [EVENT, EVENT]}, [("events[1].id", "is a duplicate")]),
    "three": ({"events": [EVENT, EVENT, EVENT]}, [("events[1].id", "is a duplicate"), ("events[2].id", "is a duplicate")]),
    "others": ({"events": [EVENT, {**EVENT, "id": "e2"}]}, []),
})
family("faults_policy", "Platform policies and action items.", "events.0.", {
    "area": ({"platform_policy.policy_area": "luck"}, [(P + "policy_area", KNOWN + "area")]),
    "change": ({"platform_policy.change_type": "luck"}, [(P + "change_type", KNOWN + "change")]),
    "blank": ({"platform_policy.new_state": " "}, [(P + "new_state", "must not be blank")]),
    "kind": ({"platform_policy.backend_verification_required": "yes"}, [(P + "backend_verification_required", "must be bool")]),
    "missing": ({"platform_policy.seller_scope": GONE}, [(P + "seller_scope", "is required")]),
    "no actions": ({"action_items": GONE}, [(E + "platform_policy", "and action_items must occur together")]),
    "no policy": ({"platform_policy": GONE}, [(E + "platform_policy", "and action_items must occur together"), (L + "verified_event_ids[0]", "names an event without a platform")]),
    "exposure": ({"score_breakdown.business_exposure": 2, "score_breakdown.urgency": 0, "products_or_channels": []}, [(E + "score_breakdown.business_exposure", "needs a market and an affected dimension")]),
    "action": ({"action_items": [{"owner": "", "action": "a", "deadline": 5}]}, [(E + "action_items[0].owner", "must not be blank"), (E + "action_items[0].deadline", "must be string"), (E + "action_items[0].completion_evidence", "is required")]),
})
family("faults_ledger", "Fields, times, flags and outcomes of ledger rows.", "coverage_ledger.0.", {
    "blank": ({"program": ""}, [(L + "program", "must not be blank")]),
    "access": ({"access_result": "seen"}, [(L + "access_result", KNOWN + "result")]),
    "login": ({"access_result": "login_required"}, [(L + "access_result", "needs a login_required attempt")]),
    "blocked": ({"access_result": "blocked"}, [(L + "access_result", "needs a blocked attempt")]),
    "instant": ({"checked_at": "now"}, [(L + "checked_at", INSTANT)]),
    "six days": ({"lookback_start": "2026-07-14T00:00:00+00:00"}, [(L + "lookback_start", "must be at least seven days before checked_at")]),
    "seven days": ({"lookback_start": "2026-07-13T00:00:00+00:00"}, []),
    "after": ({"lookback_start": "2026-07-21T00:00:00+00:00"}, [(L + "lookback_start", "must not be after checked_at")]),
    "no checks": ({"sources_checked": [], "public_update_checked": False, "current_policy_checked": False}, [(L + "sources_checked", "must not be empty")]),
    "dashboard": ({"dashboard_checked": True}, [(L + "dashboard_checked", "needs a dashboard source")]),
    "updates": ({"sources_checked": CHECKS[1:]}, [(L + "public_update_checked", "needs a official_updates source")]),
    "policy": ({"sources_checked": CHECKS[:1]}, [(L + "current_policy_checked", "needs a current_policy source")]),
    "gaps": ({"gaps": ["a", 5]}, [(L + "gaps", "must hold strings")]),
    "unknown id": ({"verified_event_ids": ["e1", "e9"]}, [(L + "verified_event_ids[1]", "names no event")]),
    "another's": ({"platform": "Acme"}, [(L + "verified_event_ids[0]", "names another platform's event")]),
    "missing": ({"gaps": GONE}, [(L + "gaps", "is required")]),
})
family("faults_source_checks", "Source checks, their snapshots and their receipts.", "coverage_ledger.0.sources_checked.0.", {
    "type": ({"source_type": "rumour"}, [(S + "source_type", KNOWN + "type"), (L + "public_update_checked", "needs a official_updates source")]),
    "result": ({"result": "fine"}, [(S + "result", KNOWN + "result")]),
    "time": ({"checked_at": "2026-07-20"}, [(S + "checked_at", INSTANT)]),
    "url": ({"url": "acme.example"}, [(S + "url", "must be an http(s) URL")]),
    "missing": ({"notes": GONE}, [(S + "notes", "is required")]),
    "no snapshot": ({"snapshot": GONE}, [(S + "snapshot", "is required for an opened public page")]),
    "blocked without": ({"snapshot": GONE, "result": "blocked"}, []),
    "hash": ({"snapshot.content_hash": "ABC"}, [(S + "snapshot.content_hash", "must be 64 hex digits")]),
    "captured": ({"snapshot.captured_at": "x"}, [(S + "snapshot.captured_at", INSTANT)]),
    "change": ({"snapshot.change_status": "new"}, [(S + "snapshot.change_status", KNOWN + "status"), (S + "snapshot.previous_snapshot_id", "must be absent exactly when first seen")]),
    "previous": ({"snapshot.previous_snapshot_id": "p"}, [(S + "snapshot.previous_snapshot_id", "must be absent exactly when first seen")]),
    "no previous": ({"snapshot.change_status": "unchanged"}, [(S + "snapshot.previous_snapshot_id", "must be absent exactly when first seen")]),
    "some portable": ({"snapshot.storage_backend": "sqlite"}, [(S + "snapshot", "must give all portable fields or none")]),
    "commit": ({"snapshot.git_commit": "c"}, [(S + "snapshot", "must give commit and tree together")]),
    "backend": ({"snapshot.storage_backend": "tape", "snapshot.snapshot_ref": "a", "snapshot.index_recovered": True}, [(S + "snapshot.storage_backend", KNOWN + "backend")]),
    "ref": ({"snapshot.storage_backend": "s3", "snapshot.snapshot_ref": "../a", "snapshot.index_recovered": True}, [(S + "snapshot.snapshot_ref", REF)]),
    "method": ({"acquisition_receipt.retrieval_method": "luck"}, [(R + "retrieval_method", KNOWN + "method")]),
    "attempts": ({"acquisition_receipt.attempts": 0}, [(R + "attempts", "must be at least 1")]),
    "task": ({"acquisition_receipt.task_id": "xyz"}, [(R + "task_id", "must be 24 hex digits")]),
    "status": ({"acquisition_receipt.http_status": 99}, [(R + "http_status", "must be from 100 to 599")]),
    "null status": ({"acquisition_receipt.http_status": None}, []),
    "receipt's hash": ({"acquisition_receipt.content_hash": "x"}, [(R + "content_hash", "must be 64 hex digits")]),
    "receipt's ref": ({"acquisition_receipt.content_ref": "/etc"}, [(R + "content_ref", REF)]),
    "kept": ({"acquisition_receipt.retrieval_method": "browser_authenticated"}, [(R + "content_ref", "must be absent for authenticated content")]),
    "receipt's fields": ({"acquisition_receipt.route_verified": GONE}, [(R + "route_verified", "is required")]),
})
A = E + "applicability."
family("faults_applicability", "The applicability block.", "events.0.applicability.", {
    "status": ({"status": "maybe"}, [(A + "status", KNOWN + "status")]),
    "empty": ({"matched_items": []}, [(A + "matched_items", "must not be empty when matched")]),
    "review": ({"status": "needs_review"}, [(A + "matched_items", "must be empty unless matched")]),
    "basis": ({"matched_items": [{"basis": ["luck"]}]}, [(A + "matched_items", "must name a basis")]),
    "no basis": ({"matched_items": [{"basis": []}]}, [(A + "matched_items", "must name a basis")]),
    "missing": ({"reason": GONE}, [(A + "reason", "is required")]),
})
family("faults_scope", "Platforms that the scope names and the ledger lacks.", "", {
    "other": ({"scope": ["Acme Market", "sellers of Other Shop"]}, [("coverage_ledger", "has no row for Other Shop")]),
    "part of a word": ({"scope": ["another shops"]}, []),
    "none": ({"scope": []}, []),
    "no ledger": ({"coverage_ledger": []}, [("coverage_ledger", "has no row for Acme Market")]),
})

# -- rows of other tables ----------------------------------------------------------------------------------------------


def numbered(faults: list[tuple], extra: str = "") -> str:
    """SQL that counts findings of customers' rows, by number."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({n}, {quote(m)})" for n, found in enumerate(faults) for m in found)
    return f"SELECT fault::BIGINT AS fault, message, count(*) AS n FROM customer JOIN (VALUES {rows}) f(fault, message) ON c_custkey % {len(faults)} = fault {extra} GROUP BY ALL"


def _counted_by(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.select("report", "fault").distinct().join(found, "report").groupBy("fault", "message").agg(F.count("*").alias("n"))


LEAD_FAULTS = [[], ["is not a known tier"], ["must be from 0 to 5"], ["must be an ISO datetime with an offset"], ["must not be before published_at"], ["must not be after the cutoff", "must not be before published_at"], ["must be an http(s) URL"], ["must not be blank"]]


@query(numbered(LEAD_FAULTS))
def faults_leads(spark: SparkSession, d: str) -> DataFrame:
    """Leads of customers, each with one fault."""
    at = lambda n, bad, good: F.when(F.col("fault") == n, bad).otherwise(good)
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("report"), (F.col("c_custkey") % len(LEAD_FAULTS)).alias("fault"))
    published = F.when(F.col("fault") == 3, "2026-07-01").when(F.col("fault") == 5, "2026-08-01T00:00:00+00:00").otherwise("2026-07-01T00:00:00+00:00")
    rows = rows.select(
        "report", "fault", F.lit(0).alias("pos"), F.lit("x").alias("lead_id"), at(1, "rumour", "social").alias("source_tier"), at(2, F.lit(6), F.lit(5)).alias("momentum_score"), published.alias("published_at"),
        at(4, "2026-06-30T00:00:00+00:00", "2026-07-02T00:00:00+00:00").alias("retrieved_at"), at(6, "x.org", "https://x.org/").alias("source_url"), at(7, "  ", "c").alias("claim"),
    )
    return _counted_by(rows, validation.lead_rules(rows, "2026-07-21T00:00:00+00:00"))


@query("SELECT o_custkey::VARCHAR AS report, count(*) - 1 AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def faults_lead_ids(spark: SparkSession, d: str) -> DataFrame:
    """Leads of a report that repeat an id."""
    o = table(spark, d, "orders")
    rows = o.select(
        F.col("o_custkey").cast("string").alias("report"), F.col("o_orderkey").alias("pos"), F.lit("same").alias("lead_id"), F.lit("social").alias("source_tier"), F.lit(1).alias("momentum_score"),
        F.lit("2026-07-01T00:00:00+00:00").alias("published_at"), F.lit("2026-07-02T00:00:00+00:00").alias("retrieved_at"), F.lit("https://x.org/").alias("source_url"), F.lit("c").alias("claim"),
    )
    return validation.lead_rules(rows, "2026-07-21T00:00:00+00:00").groupBy("report").agg(F.count("*").alias("n"))


REVIEW_FAULTS = [[], ["is not a known level"], ["must equal the breakdown's sum"], ["must be from 0 to 2", "must equal the breakdown's sum"], ["is a duplicate"]]


@query(numbered(REVIEW_FAULTS))
def faults_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Calibration reviews of customers, each with one fault."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("report"), (F.col("c_custkey") % len(REVIEW_FAULTS)).alias("fault"))
    parts = F.struct(*[(F.when(F.col("fault") == 3, F.lit(3)).otherwise(F.lit(1)) if n == 0 else F.lit(1)).alias(x) for n, x in enumerate(K.BREAKDOWN)])
    rows = rows.select("report", "fault", F.lit("e").alias("event_id"), F.explode(F.when(F.col("fault") == 4, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))).alias("reviewer"), parts.alias("score_breakdown"))
    wrong = (F.col("fault") > 0) & (F.col("reviewer") == "a") & (F.col("fault") < 4)
    rows = rows.filter((F.col("fault") != 3) | (F.col("reviewer") == "a"))
    rows = rows.withColumn("reviewed_level", F.when(wrong & (F.col("fault") == 1), "severe").otherwise("low")).withColumn("score", F.when(wrong & (F.col("fault") == 2), 6).otherwise(5))
    return _counted_by(rows, validation.review_rules(rows))


RECEIPT_FIELDS = ("platform", "seller_market", "program", "source_type", "url")
RECEIPT_FAULTS = [[], ["has no task"], *[["differs from its task"]] * len(RECEIPT_FIELDS)]


@query(numbered(RECEIPT_FAULTS))
def faults_receipts(spark: SparkSession, d: str) -> DataFrame:
    """Receipts beside their tasks: one field of each differs, or the task is missing."""
    base = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("report"), (F.col("c_custkey") % len(RECEIPT_FAULTS)).alias("fault"))
    base = base.withColumn("task_id", F.concat(F.lit("t"), "report"))
    tasks = base.filter("fault <> 1").select("task_id", *[F.concat(F.lit(c), "report").alias(c) for c in RECEIPT_FIELDS])
    own = lambda n, c: F.when(F.col("fault") == n + 2, "other").otherwise(F.concat(F.lit(c), "report")).alias("requested_url" if c == "url" else c)
    rows = base.select("report", "fault", "task_id", *[own(n, c) for n, c in enumerate(RECEIPT_FIELDS)])
    return _counted_by(rows, validation.receipt_rules(rows, tasks))


ROUTE = {"route_id": "r-1", "url": "https://x.org/", "access": "public", "market_specific": False, "markets": ["*"], "verification_status": "verified", "last_verified_on": "2026-07-01", "verify_before_use": False}
ROUTES = [{**ROUTE, "route_id": f"r-{n}", "source_type": k, "evidence_role": v} for n, (k, v) in enumerate(K.ROUTE_ROLES.items())]
PLATFORM = {"id": "acme", "display_name": "Acme", **{x: ["a"] for x in K.PLATFORM_LISTS}, "aliases": [], "official_routes": ROUTES, "source_profile": {"expected_source_types": list(K.ROUTE_ROLES), "known_gaps": {}}}
O = "official_routes[0]."  # noqa: E741
PLATFORM_FAULTS: list[Fault] = [
    ({}, []),
    ({"id": "Acme"}, [("id", "must be lowercase kebab-case")]),
    ({"display_name": ""}, [("display_name", "must be nonblank")]),
    ({"official_routes": ROUTES[1:]}, [("official_routes.official_updates", "needs a route or a declared gap")]),
    ({"official_routes": ROUTES[1:], "source_profile.known_gaps": {"official_updates": "none is published"}}, []),
    ({"source_profile.known_gaps": {"dashboard": "none"}}, [("official_routes.dashboard", "cannot be both routed and a gap")]),
    ({"source_profile.expected_source_types": ["dashboard"]}, [("source_profile.expected_source_types", "must name all source types")]),
    ({"programs": ["", "x"]}, [("programs", "must be an array of nonblank strings")]),
    ({"official_routes.0.url": "x"}, [(O + "url", "must be http(s)")]),
    ({"official_routes.0.route_id": "r-1"}, [("official_routes[1].route_id", "must be unique")]),
    ({"official_routes.0.access": "open"}, [(O + "access", "is not a known access")]),
    ({"official_routes.0.evidence_role": "x"}, [(O + "evidence_role", "must fit source_type")]),
    ({"official_routes.0.markets": []}, [(O + "markets", "must be nonblank strings")]),
    ({"official_routes.0.market_specific": "no"}, [(O + "market_specific", "must be boolean")]),
    ({"official_routes.0.last_verified_on": None}, [(O + "last_verified_on", "must be YYYY-MM-DD")]),
    ({"official_routes.0.verification_status": "conditional", "official_routes.0.verify_before_use": True}, [(O + "last_verified_on", "must be null unless verified")]),
    ({"official_routes.0.verification_status": "conditional", "official_routes.0.last_verified_on": None}, [(O + "verify_before_use", "must be true for conditional routes")]),
]


@query(counted(PLATFORM_FAULTS))
def faults_platforms(spark: SparkSession, d: str) -> DataFrame:
    """Platform files, each with one fault; names are the customer's, so that no alias is claimed twice."""
    rows = planted(spark, d, PLATFORM, PLATFORM_FAULTS, dealt=True)
    own = lambda c, old, new: F.replace(c, F.lit(f'"{old}"'), F.concat(F.lit(f'"{new}'), "report", F.lit('"')))
    raw = own(own(F.col("raw"), "acme", "acme"), "Acme", "Acme ")
    return told(rows, validation.platform_rules(rows.select("report", raw.alias("raw"))))


@query("""WITH n AS (SELECT n_nationkey::VARCHAR AS report, n_regionkey FROM nation), t AS (SELECT n_regionkey FROM n GROUP BY 1 HAVING count(*) > 1)
SELECT report, 'another platform also claims shop ' || n_regionkey AS message FROM n JOIN t USING (n_regionkey)""")
def faults_shared_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Platforms whose alias another claims too, among nations of a region."""
    text = F.lit(json.dumps({**PLATFORM, "id": "ID", "display_name": "ID", "aliases": ["ALIAS"]}))
    raw = F.replace(F.replace(text, F.lit("ID"), F.concat(F.lit("id"), F.col("n_nationkey").cast("string"))), F.lit("ALIAS"), F.concat(F.lit("Shop "), F.col("n_regionkey").cast("string")))
    found = validation.platform_rules(table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("report"), raw.alias("raw")))
    return found.filter("location = 'aliases'").select("report", "message")


SOURCE = {"id": "s1", "display_name": "S", "jurisdiction": "J", "authority": "A", "aliases": ["a"], "routes": [{"label": "l", "url": "https://x.org/", "source_type": "current_rule", "topics": ["t"]}]}
F0 = "sources[0]."
SOURCE_FAULTS: list[Fault] = [
    ({}, []),
    ({"sources.0.authority": ""}, [(F0 + "authority", "must be nonblank")]),
    ({"sources.0.extra": 1}, [("sources[0]", "fields do not match")]),
    ({"sources.0.aliases": [5]}, [(F0 + "aliases", "must be nonblank strings")]),
    ({"sources.0.routes": []}, [(F0 + "routes", "must not be empty")]),
    ({"sources.0.routes.0.url": "http://x.org/"}, [(F0 + "routes[0].url", "must be a direct https URL")]),
    ({"sources.0.routes.0.source_type": "rumour"}, [(F0 + "routes[0].source_type", "is not supported")]),
    ({"sources.0.routes.0.topics": [""]}, [(F0 + "routes[0].topics", "must be nonblank strings")]),
    ({"sources.0.routes.0.label": " "}, [(F0 + "routes[0].label", "must be nonblank")]),
    ({"sources": "none"}, [("sources", "must be an array")]),
]


@query(counted(SOURCE_FAULTS))
def faults_official_sources(spark: SparkSession, d: str) -> DataFrame:
    """Files of official sources, each with one fault and ids of its own."""
    rows = planted(spark, d, {"sources": [SOURCE]}, SOURCE_FAULTS)
    raw = F.replace(F.col("raw"), F.lit('"s1"'), F.concat(F.lit('"s'), "report", F.lit('"')))
    return told(rows, validation.official_rules(rows.select("report", raw.alias("raw"))))
