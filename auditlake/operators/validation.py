"""Which records break the data contract: violations as rows (report, location, message).

Input: report and raw (JSON text). Values stay variants until a rule reads them, so a wrong type is told and not made
null, and a missing field is told apart from a null. Each family of rules is an array of findings on a row; one pass over
the exploded rows finds all of a family.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions import score, text, timing
from auditlake.operators import containment
from auditlake.operators.common import written

# Fields and their JSON kinds; a mark of "?" admits null.
ROOT = {"report_date": "string", "timezone": "string", "cutoff": "string", "language": "string", "scope": "array", "coverage_gaps": "array", "events": "array"}
ROOT_OPTIONAL = {"window_start": "string?", "coverage_ledger": "array"}
EVENT = {
    "id": "string", "title": "string", "status": "string", "level": "string", "score": "int", "score_breakdown": "object", "jurisdiction": "string", "authority": "string",
    "published_date": "string?", "effective_date": "string?", "deadline": "string?", "products_or_channels": "array", "summary": "string", "impact": "string",
    "action": "string", "rationale": "string", "source_title": "string", "source_url": "string", "retrieved_date": "string",
}
EVENT_OPTIONAL = {"published_at": "string?", "effective_at": "string?", "deadline_at": "string?", "source_timezone": "string?", "level_override": "object?", "hs_codes": "array", "applicability": "object"}
OVERRIDE = {"level": "string", "reason": "string"}
POLICY = {
    "platform": "string", "seller_market": "string", "program": "string", "policy_area": "string", "change_type": "string", "seller_scope": "string",
    "previous_state": "string?", "new_state": "string", "enforcement_consequence": "string", "backend_verification_required": "bool",
}
ACTION = {"owner": "string", "action": "string", "deadline": "string", "completion_evidence": "string"}
LEDGER = {
    "platform": "string", "seller_market": "string", "program": "string", "lookback_start": "string", "public_update_checked": "bool", "current_policy_checked": "bool",
    "dashboard_checked": "bool", "access_result": "string", "checked_at": "string", "sources_checked": "array", "verified_event_ids": "array", "gaps": "array",
}
CHECK = {"source_type": "string", "url": "string", "result": "string", "checked_at": "string", "notes": "string"}
RECEIPT = {"task_id": "string", "retrieval_method": "string", "attempts": "int", "http_status": "int?", "content_hash": "string?", "content_ref": "string?", "error_type": "string?", "route_verified": "bool"}
METHODS = ("http", "rss", "atom", "sitemap", "manual", "browser_public", "browser_authenticated")
KINDS = {"string": "STRING", "int": "BIGINT", "bool": "BOOLEAN", "array": "ARRAY<", "object": "OBJECT<"}

Finding = tuple[Column, str, Column]  # location, message, whether it is broken


def get(v: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def kind_of(v: Column, name: str) -> Column:
    """The JSON kind of a field; null if it is missing."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))


def shape(v: Column, at: Column, required: dict[str, str], optional: dict[str, str] | None = None) -> list[Finding]:
    """Missing and mistyped fields."""
    out: list[Finding] = []
    for name, kind in {**required, **(optional or {})}.items():
        here = F.concat(at, F.lit(name))
        found = kind_of(v, name)
        if name in required:
            out.append((here, "is required", found.isNull()))
        fits = found.startswith(KINDS[kind.rstrip("?")])
        if kind.endswith("?"):
            fits = fits | (found == "VOID")
        out.append((here, f"must be {kind}", found.isNotNull() & ~fits))
    return out


def found(rows: DataFrame, findings: Iterable[Finding]) -> DataFrame:
    """report, location, message of the findings that hold."""
    each = [F.when(F.coalesce(broken, F.lit(False)), F.struct(at.alias("location"), F.lit(message).alias("message"))) for at, message, broken in findings]
    return rows.select("report", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("f")).select("report", "f.location", "f.message")


def _blank(v: Column, name: str) -> Column:
    return (kind_of(v, name) == "STRING") & ~text.nonblank(get(v, name))


def _outside(v: Column, name: str, allowed: Iterable[str]) -> Column:
    return (kind_of(v, name) == "STRING") & ~get(v, name).isin(*allowed)


def _bad(v: Column, name: str, test) -> Column:  # noqa: ANN001
    return (kind_of(v, name) == "STRING") & ~test(get(v, name))


def elements(rows: DataFrame, v: Column, path: str, label: Column) -> DataFrame:
    """Elements of an array field as variants, with their location and place."""
    array = F.try_variant_get(v, f"$.{path}", "array<variant>")
    return rows.select("*", F.posexplode(array).alias("i", "item")).withColumn("at", F.concat(label, F.lit(path), F.lit("["), F.col("i").cast("string"), F.lit("]"))).withColumn("dot", F.concat("at", F.lit(".")))


def opened(reports: DataFrame) -> DataFrame:
    """report and v, its JSON as a variant; rows that have it already as they are."""
    return reports.select("report", "v" if "v" in reports.columns else F.try_parse_json("raw").alias("v"))


def events_of(reports: DataFrame) -> DataFrame:
    """report, i, item (variant), at and dot of each event."""
    rows = opened(reports)
    return elements(rows, F.col("v"), "events", F.lit(""))


def root_rules(reports: DataFrame) -> DataFrame:
    rows, v, none = opened(reports), F.col("v"), F.lit("")
    out = [(F.lit("root"), "must be a JSON object", v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT<"))]
    out += [(a, m, v.isNotNull() & b) for a, m, b in shape(v, none, ROOT, ROOT_OPTIONAL)]
    out.append((F.lit("report_date"), "must be an ISO date", _bad(v, "report_date", timing.valid_date)))
    out += [(F.lit(n), "must be an ISO datetime with an offset", _bad(v, n, timing.valid_instant)) for n in ("cutoff", "window_start")]
    return found(rows, out)


def event_rules(reports: DataFrame) -> DataFrame:
    rows = events_of(reports)
    order = Window.partitionBy("report", get(F.col("item"), "id")).orderBy("i")
    rows = rows.withColumn("again", F.row_number().over(order) > 1)
    e, dot = F.col("item"), F.col("dot")
    at = lambda n: F.concat(dot, F.lit(n))
    points = F.when(kind_of(e, "score") == "BIGINT", get(e, "score", "long"))
    parts = [get(e, f"score_breakdown.{d}", "long") for d in K.BREAKDOWN]
    kinds = [kind_of(e, f"score_breakdown.{d}") for d in K.BREAKDOWN]
    whole = F.lit(True)
    for p, k in zip(parts, kinds):
        whole = whole & F.coalesce((k == "BIGINT") & p.between(0, 2), F.lit(False))
    keys = F.json_object_keys(get(e, "score_breakdown", "string"))
    level, ruled = get(e, "level"), score.level_for_score(points)
    override = kind_of(e, "level_override").startswith("OBJECT<")
    good_override = override & (get(e, "level_override.level") == level) & text.nonblank(get(e, "level_override.reason"))
    evidence = parts[K.BREAKDOWN.index("evidence")]
    has_policy, has_actions = kind_of(e, "platform_policy").startswith("OBJECT<"), kind_of(e, "action_items").isNotNull()
    out = shape(e, dot, EVENT, EVENT_OPTIONAL)
    out += [
        (at("id"), "must not be blank", _blank(e, "id")),
        (at("id"), "is a duplicate", F.col("again") & get(e, "id").isNotNull()),
        (at("status"), "is not a known status", _outside(e, "status", K.STATUSES)),
        (at("level"), "is not a known level", _outside(e, "level", K.LEVELS)),
        (at("score"), "must be from 0 to 10", (kind_of(e, "score") == "BIGINT") & ~points.between(0, 10)),
        (at("score_breakdown"), "must have exactly the five dimensions", kind_of(e, "score_breakdown").startswith("OBJECT<") & (F.array_sort(keys) != F.array(*[F.lit(d) for d in sorted(K.BREAKDOWN)]))),
        (at("score_breakdown"), "must hold integers from 0 to 2", kind_of(e, "score_breakdown").startswith("OBJECT<") & ~whole),
        (at("score"), "must equal the breakdown's sum", whole & (points != sum(parts, F.lit(0)))),
        (at("level"), "must follow the score or a documented override", points.between(0, 10) & level.isin(*K.LEVELS) & (level != ruled) & ~F.coalesce(good_override, F.lit(False))),
        (at("level_override"), "is redundant", override & (level == ruled)),
        (at("level"), "must be watch without evidence", (evidence == 0) & (level != "watch")),
        (at("level"), "must be watch while unconfirmed", (get(e, "status") == "unconfirmed") & (level != "watch")),
        (at("source_url"), "must be an http(s) URL", (kind_of(e, "source_url") == "STRING") & ~text.is_url(get(e, "source_url"))),
        (at("source_title"), "must not be blank", _blank(e, "source_title")),
        (at("platform_policy"), "and action_items must occur together", F.coalesce(has_policy, F.lit(False)) != F.coalesce(has_actions, F.lit(False))),
    ]
    out += [(a, m, override & b) for a, m, b in shape(F.try_variant_get(e, "$.level_override", "variant"), at("level_override."), OVERRIDE)]
    out += [(at(n), "must be an ISO date", _bad(e, n, timing.valid_date)) for n in ("published_date", "effective_date", "deadline", "retrieved_date")]
    out += [(at(n), "must be an ISO datetime with an offset", _bad(e, n, timing.valid_instant)) for n in ("published_at", "effective_at", "deadline_at")]
    codes = F.try_variant_get(e, "$.hs_codes", "array<string>")
    out.append((at("hs_codes"), "must be codes of 4 to 10 digits", F.exists(codes, lambda c: ~F.coalesce(text.valid_hs(text.hs_code(c)), F.lit(False)))))
    return found(rows, out)


def policy_rules(reports: DataFrame, platforms: DataFrame | None = None) -> DataFrame:
    """Platform policies and action items; ``platforms``: registered names, in normal form, as column ``name``."""
    rows = events_of(reports).withColumn("p", F.try_variant_get("item", "$.platform_policy", "variant"))
    rows = rows.filter(F.schema_of_variant("p").startswith("OBJECT<")).withColumn("pd", F.concat("dot", F.lit("platform_policy.")))
    p, e = F.col("p"), F.col("item")
    at = lambda n: F.concat("pd", F.lit(n))
    market = text.nonblank(get(p, "seller_market")) & (F.size(F.coalesce(F.try_variant_get(e, "$.products_or_channels", "array<string>"), F.array().cast("array<string>"))) > 0)
    out = shape(p, F.col("pd"), POLICY)
    out += [
        (at("policy_area"), "is not a known area", _outside(p, "policy_area", K.POLICY_AREAS)),
        (at("change_type"), "is not a known change", _outside(p, "change_type", K.CHANGE_TYPES)),
        (F.concat("dot", F.lit("score_breakdown.business_exposure")), "needs a market and an affected dimension", (get(e, "score_breakdown.business_exposure", "long") == 2) & ~market),
    ]
    out += [(at(n), "must not be blank", _blank(p, n)) for n, k in POLICY.items() if k == "string"]
    all_found = found(rows, out)
    if platforms is not None:
        named = rows.withColumn("name", text.normalized(get(p, "platform"))).join(F.broadcast(platforms.select("name").distinct()), "name", "left_anti")
        all_found = all_found.unionByName(named.select("report", at("platform").alias("location"), F.lit("is not registered").alias("message")))
    actions = elements(events_of(reports).drop("i").withColumnsRenamed({"item": "e", "at": "eat", "dot": "edot"}), F.col("e"), "action_items", F.col("edot"))
    a = F.col("item")
    return all_found.unionByName(found(actions, [*shape(a, F.col("dot"), ACTION), *[(F.concat("dot", F.lit(n)), "must not be blank", _blank(a, n)) for n in ACTION]]))


def ledger_rules(reports: DataFrame) -> DataFrame:
    """Ledger rows, their source checks with receipts and snapshots, and the events they name."""
    rows = elements(opened(reports), F.col("v"), "coverage_ledger", F.lit(""))
    g, dot = F.col("item"), F.col("dot")
    at = lambda n: F.concat(dot, F.lit(n))
    start, done = timing.instant(get(g, "lookback_start")), timing.instant(get(g, "checked_at"))
    checks = F.try_variant_get(g, "$.sources_checked", "array<variant>")
    of = lambda kind: F.exists(checks, lambda c: get(c, "source_type") == kind)
    ended = lambda result: F.exists(checks, lambda c: get(c, "result") == result)
    out = shape(g, dot, LEDGER)
    out += [(at(n), "must not be blank", _blank(g, n)) for n in ("platform", "seller_market", "program")]
    out += [(at(n), "must be an ISO datetime with an offset", _bad(g, n, timing.valid_instant)) for n in ("lookback_start", "checked_at")]
    out += [
        (at("access_result"), "is not a known result", _outside(g, "access_result", K.ACCESS_RESULTS)),
        (at("lookback_start"), "must not be after checked_at", start > done),
        (at("lookback_start"), "must be at least seven days before checked_at", (start <= done) & ~timing.lookback_ok(start, done)),
        (at("sources_checked"), "must not be empty", F.size(checks) == 0),
        (at("access_result"), "needs a login_required attempt", (get(g, "access_result") == "login_required") & ~ended("login_required")),
        (at("access_result"), "needs a blocked attempt", (get(g, "access_result") == "blocked") & ~ended("blocked")),
    ]
    for flag, kind in (("public_update_checked", "official_updates"), ("current_policy_checked", "current_policy"), ("dashboard_checked", "dashboard")):
        out.append((at(flag), f"needs a {kind} source", get(g, flag, "boolean") & ~of(kind)))
    for n in ("verified_event_ids", "gaps"):
        out.append((at(n), "must hold strings", F.exists(F.try_variant_get(g, f"$.{n}", "array<variant>"), lambda x: F.schema_of_variant(x) != "STRING")))
    base = rows.drop("i").withColumnsRenamed({"item": "g", "at": "gat", "dot": "gdot"})
    return found(rows, out).unionByName(_check_rules(base)).unionByName(_named_events(reports, base))


def _check_rules(ledger: DataFrame) -> DataFrame:
    rows = elements(ledger, F.col("g"), "sources_checked", F.col("gdot"))
    c, dot = F.col("item"), F.col("dot")
    at = lambda n: F.concat(dot, F.lit(n))
    opened = get(c, "source_type").isin("official_updates", "current_policy") & get(c, "result").isin(*K.POSITIVE_RESULTS)
    snap, receipt = kind_of(c, "snapshot").startswith("OBJECT<"), kind_of(c, "acquisition_receipt").startswith("OBJECT<")
    s = lambda n, k="string": get(c, f"snapshot.{n}", k)
    r = lambda n, k="string": get(c, f"acquisition_receipt.{n}", k)
    first, git = s("change_status") == "first_seen", ("git_commit", "git_tree")
    portable = ("storage_backend", "snapshot_ref", "index_recovered")
    given = lambda names: [kind_of(c, f"snapshot.{n}").isNotNull().cast("int") for n in names]
    some = lambda names: sum(given(names), F.lit(0)).between(1, len(names) - 1)
    bad_ref = lambda x: x.isNotNull() & (x.startswith("/") | x.contains("..") | x.contains("\\") | x.rlike("^[A-Za-z]:"))
    out = shape(c, dot, CHECK)
    out += [
        (at("source_type"), "is not a known type", _outside(c, "source_type", K.SOURCE_TYPES)),
        (at("result"), "is not a known result", _outside(c, "result", K.SOURCE_RESULTS)),
        (at("checked_at"), "must be an ISO datetime with an offset", _bad(c, "checked_at", timing.valid_instant)),
        (at("url"), "must be an http(s) URL", _bad(c, "url", text.is_url)),
        (at("snapshot"), "is required for an opened public page", opened & ~F.coalesce(snap, F.lit(False))),
        (at("snapshot.content_hash"), "must be 64 hex digits", snap & ~F.coalesce(s("content_hash").rlike("^[0-9a-f]{64}$"), F.lit(False))),
        (at("snapshot.captured_at"), "must be an ISO datetime with an offset", snap & ~timing.valid_instant(s("captured_at"))),
        (at("snapshot.change_status"), "is not a known status", snap & ~F.coalesce(s("change_status").isin("first_seen", "unchanged", "changed"), F.lit(False))),
        (at("snapshot.previous_snapshot_id"), "must be absent exactly when first seen", snap & (first != s("previous_snapshot_id").isNull())),
        (at("snapshot"), "must give all portable fields or none", snap & some(portable)),
        (at("snapshot"), "must give commit and tree together", snap & some(git)),
        (at("snapshot.storage_backend"), "is not a known backend", s("storage_backend").isNotNull() & ~s("storage_backend").isin("filesystem", "sqlite", "git", "s3")),
        (at("snapshot.snapshot_ref"), "must be a portable path", snap & bad_ref(s("snapshot_ref"))),
        (at("acquisition_receipt.retrieval_method"), "is not a known method", receipt & ~F.coalesce(r("retrieval_method").isin(*METHODS), F.lit(False))),
        (at("acquisition_receipt.attempts"), "must be at least 1", receipt & ~F.coalesce(r("attempts", "long") >= 1, F.lit(False))),
        (at("acquisition_receipt.task_id"), "must be 24 hex digits", receipt & ~F.coalesce(r("task_id").rlike("^[0-9a-f]{24}$"), F.lit(False))),
        (at("acquisition_receipt.http_status"), "must be from 100 to 599", r("http_status", "long").isNotNull() & ~r("http_status", "long").between(100, 599)),
        (at("acquisition_receipt.content_hash"), "must be 64 hex digits", r("content_hash").isNotNull() & ~r("content_hash").rlike("^[0-9a-f]{64}$")),
        (at("acquisition_receipt.content_ref"), "must be a portable path", receipt & bad_ref(r("content_ref"))),
        (at("acquisition_receipt.content_ref"), "must be absent for authenticated content", (r("retrieval_method") == "browser_authenticated") & r("content_ref").isNotNull()),
    ]
    inner = shape(F.try_variant_get(c, "$.acquisition_receipt", "variant"), at("acquisition_receipt."), RECEIPT)
    return found(rows, [*out, *[(a, m, receipt & b) for a, m, b in inner]])


def _named_events(reports: DataFrame, ledger: DataFrame) -> DataFrame:
    """Verified ids that no event has, or that belong to another platform or to none."""
    named = ledger.select("report", "gdot", text.normalized(get(F.col("g"), "platform")).alias("own"), F.posexplode(F.try_variant_get("g", "$.verified_event_ids", "array<string>")).alias("k", "id"))
    events = events_of(reports).select("report", get(F.col("item"), "id").alias("id"), text.normalized(get(F.col("item"), "platform_policy.platform")).alias("platform"), F.lit(True).alias("known")).dropDuplicates(["report", "id"])
    rows = named.join(events, ["report", "id"], "left").withColumn("at", F.concat("gdot", F.lit("verified_event_ids["), F.col("k").cast("string"), F.lit("]")))
    at = F.col("at")
    return found(rows, [(at, "names no event", F.col("known").isNull()), (at, "names an event without a platform", F.col("known") & (F.col("platform") == "")), (at, "names another platform's event", F.col("known") & (F.col("platform") != "") & (F.col("platform") != F.col("own")))])


def applicability_rules(reports: DataFrame) -> DataFrame:
    rows = events_of(reports).withColumn("a", F.try_variant_get("item", "$.applicability", "variant")).filter(F.schema_of_variant("a").startswith("OBJECT<"))
    a, at = F.col("a"), lambda n: F.concat("dot", F.lit("applicability."), F.lit(n))
    items = F.try_variant_get(a, "$.matched_items", "array<variant>")
    status, n = get(a, "status"), F.size(items)
    basis = lambda x: F.try_variant_get(x, "$.basis", "array<string>")
    out = shape(a, F.concat("dot", F.lit("applicability.")), {"organization": "string", "status": "string", "reason": "string", "matched_items": "array"})
    out += [
        (at("status"), "is not a known status", status.isNotNull() & ~status.isin("matched", "needs_review", "no_match")),
        (at("matched_items"), "must not be empty when matched", (status == "matched") & (n == 0)),
        (at("matched_items"), "must be empty unless matched", status.isin("needs_review", "no_match") & (n > 0)),
        (at("matched_items"), "must name a basis", F.exists(items, lambda x: ~F.coalesce((F.size(basis(x)) > 0) & F.forall(basis(x), lambda b: b.isin("hs_prefix", "product_keyword")), F.lit(False)))),
    ]
    return found(rows, out)


def scope_rules(reports: DataFrame, aliases: DataFrame) -> DataFrame:
    """Platforms that a report's scope names and its ledger lacks."""
    rows = opened(reports)
    scopes = rows.select("report", F.explode(F.try_variant_get("v", "$.scope", "array<string>")).alias("scope"))
    named = containment.named(scopes.select("scope"), aliases, "scope")  # each text once, however many reports have it
    wanted = scopes.join(named, "scope").select("report", "platform").distinct()
    entered = elements(rows, F.col("v"), "coverage_ledger", F.lit("")).select("report", text.normalized(get(F.col("item"), "platform")).alias("__a"))
    have = entered.join(aliases.select(text.normalized(F.col("alias")).alias("__a"), "platform"), "__a").select("report", "platform")
    lacking = wanted.join(have, ["report", "platform"], "left_anti")
    return lacking.select("report", F.lit("coverage_ledger").alias("location"), F.concat(F.lit("has no row for "), "platform").alias("message"))


def violations(reports: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """All violations of all reports; ``aliases``: alias and platform of the registry.

    Rules look at a report's own text alone, so reports of equal texts are judged once. Rows that share a report's name are
    judged together.
    """
    if "v" in reports.columns:
        return _judged(reports, aliases)
    many = reports.groupBy(F.col("report").alias("__report")).agg(F.count("*").alias("__n"))
    rows = reports.select("report", "raw").join(many, F.col("report").eqNullSafe(F.col("__report")))
    own = F.when(F.col("__n") == 1, F.sha2(F.to_json(F.struct("raw")), 256)).otherwise(F.concat(F.lit("report "), F.to_json(F.struct("report"))))
    rows = written(rows.select("report", "raw", "__n", own.alias("__text")))
    texts = rows.filter("__n = 1").groupBy("__text").agg(F.first("raw").alias("raw")).union(rows.filter("__n > 1").select("__text", "raw"))
    found = written(_judged(texts.select(F.col("__text").alias("report"), "raw"), aliases))
    return rows.select("report", "__text").distinct().join(found.withColumnRenamed("report", "__text"), "__text").select("report", "location", "message")


def _judged(reports: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Violations of reports, which are read and parsed once, into a table that every family of rules reads."""
    reports = written(opened(reports))
    out = root_rules(reports)
    for family in (event_rules, policy_rules, ledger_rules, applicability_rules):
        out = out.unionByName(family(reports))
    return out if aliases is None else out.unionByName(scope_rules(reports, aliases))


def preview(found: DataFrame, limit: int = 5) -> str:
    """The first violations as one text, with how many more there are."""
    rows = found.orderBy("report", "location", "message").limit(limit).collect()
    more = found.count() - len(rows)
    return "; ".join(f"{r['location']}: {r['message']}" for r in rows) + (f"; plus {more} more" if more > 0 else "")


def lead_rules(leads: DataFrame, cutoff: str) -> DataFrame:
    """Lead rows (report, pos, ...) that break their contract."""
    at = timing.instant(F.lit(cutoff))
    published, retrieved = timing.instant(F.col("published_at")), timing.instant(F.col("retrieved_at"))
    rows = leads.withColumn("again", F.row_number().over(Window.partitionBy("report", "lead_id").orderBy("pos")) > 1)
    here = lambda n: F.concat(F.lit("leads["), F.col("pos").cast("string"), F.lit(f"].{n}"))
    out = [
        (here("source_tier"), "is not a known tier", ~F.col("source_tier").isin(*K.SOURCE_TIERS)),
        (here("momentum_score"), "must be from 0 to 5", ~F.col("momentum_score").between(0, 5)),
        (here("published_at"), "must be an ISO datetime with an offset", published.isNull()),
        (here("retrieved_at"), "must not be before published_at", retrieved < published),
        (here("published_at"), "must not be after the cutoff", published > at),
        (here("source_url"), "must be an http(s) URL", ~text.is_url(F.col("source_url"))),
        (here("claim"), "must not be blank", ~text.nonblank(F.col("claim"))),
        (here("lead_id"), "is a duplicate", F.col("again")),
    ]
    return found(rows, out)


def review_rules(reviews: DataFrame) -> DataFrame:
    """Calibration reviews (report, event_id, reviewer, reviewed_level, score, score_breakdown struct)."""
    rows = reviews.withColumn("again", F.row_number().over(Window.partitionBy("report", "event_id", "reviewer").orderBy("reviewed_level")) > 1)
    parts = [F.col(f"score_breakdown.{d}") for d in K.BREAKDOWN]
    here = lambda n: F.concat("event_id", F.lit(":"), "reviewer", F.lit(f".{n}"))
    out = [
        (here("reviewer"), "is a duplicate", F.col("again")),
        (here("reviewed_level"), "is not a known level", ~F.col("reviewed_level").isin(*K.LEVELS)),
        (here("score"), "must equal the breakdown's sum", F.col("score").isNotNull() & (F.col("score") != sum(parts, F.lit(0)))),
    ]
    out += [(here(d), "must be from 0 to 2", ~F.coalesce(p.between(0, 2), F.lit(False))) for d, p in zip(K.BREAKDOWN, parts)]
    return found(rows, out)


def receipt_rules(receipts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Receipts (report, task_id, ...) without a task, or whose fields differ from the task's."""
    same = ("platform", "seller_market", "program", "source_type", "url")
    t = tasks.select("task_id", *[F.col(c).alias(f"t_{c}") for c in same], F.lit(True).alias("known"))
    rows = receipts.join(t, "task_id", "left")
    mine = {"url": "requested_url"}
    out = [(F.concat("task_id", F.lit("")), "has no task", F.col("known").isNull())]
    out += [(F.concat("task_id", F.lit(f".{c}")), "differs from its task", F.col("known") & ~F.col(mine.get(c, c)).eqNullSafe(F.col(f"t_{c}"))) for c in same]
    return found(rows, out)


KEBAB = r"^[a-z0-9]+(-[a-z0-9]+)*$"


def _strings(v: Column, name: str, some: bool = False) -> Column:
    """Whether a field isn't an array of nonblank strings, and with ``some`` not an empty one."""
    items = F.try_variant_get(v, f"$.{name}", "array<variant>")
    good = F.forall(items, lambda x: (F.schema_of_variant(x) == "STRING") & text.nonblank(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit(""))))
    return ~F.coalesce(good & (F.size(items) > 0 if some else F.lit(True)), F.lit(False))


def platform_rules(files: DataFrame) -> DataFrame:
    """What is wrong with platform files: their fields, routes, declared gaps, and aliases that two platforms claim."""
    kinds = tuple(K.ROUTE_ROLES)
    parsed, v = files.select("report", F.try_parse_json("raw").alias("v")), F.col("v")
    # each field is read once, into a table that all rules read
    route = {n: "string" for n in ("source_type", "url", "route_id", "access", "evidence_role", "verification_status", "last_verified_on")}
    of_route = lambda r: F.struct(*[get(r, n).alias(n) for n in route], get(r, "verify_before_use", "boolean").alias("verify_before_use"), (kind_of(r, "market_specific") == "BOOLEAN").alias("market_specific"), _strings(r, "markets", some=True).alias("bad_markets"))
    rows = written(
        parsed.select(
            "report", get(v, "id").alias("id"), get(v, "display_name").alias("display_name"), F.try_variant_get(v, "$.source_profile.expected_source_types", "array<string>").alias("expected"),
            F.try_variant_get(v, "$.aliases", "array<string>").alias("aliases"), F.transform(F.try_variant_get(v, "$.official_routes", "array<variant>"), of_route).alias("routes"),
            *[_strings(v, name).alias(f"bad_{name}") for name in K.PLATFORM_LISTS], *[F.try_variant_get(v, f"$.source_profile.known_gaps.{k}", "string").alias(f"gap_{k}") for k in kinds],
        )
    )
    gap = lambda k: F.col(f"gap_{k}")
    routes = F.coalesce(F.col("routes.source_type"), F.array().cast("array<string>"))
    has = lambda k: F.exists(routes, lambda r: r.eqNullSafe(F.lit(k)))
    at = lambda name: F.lit(name)
    every = F.array_sort(F.array(*[F.lit(k) for k in kinds]))
    root = [
        (at("id"), "must be lowercase kebab-case", ~F.coalesce(F.col("id").rlike(KEBAB), F.lit(False))),
        (at("display_name"), "must be nonblank", ~F.coalesce(text.nonblank(F.col("display_name")), F.lit(False))),
        (at("official_routes"), "must not be empty", F.size(routes) == 0),
        (at("source_profile.expected_source_types"), "must name all source types", ~F.coalesce(F.array_sort(F.array_distinct("expected")) == every, F.lit(False))),
        *[(at(name), "must be an array of nonblank strings", F.col(f"bad_{name}")) for name in K.PLATFORM_LISTS],
        *[(at(f"official_routes.{k}"), "needs a route or a declared gap", ~has(k) & ~F.coalesce(text.nonblank(gap(k)), F.lit(False))) for k in kinds],
        *[(at(f"official_routes.{k}"), "cannot be both routed and a gap", has(k) & gap(k).isNotNull()) for k in kinds],
    ]
    items = rows.select("report", F.posexplode("routes").alias("i", "item")).withColumn("dot", F.concat(F.lit("official_routes["), F.col("i").cast("string"), F.lit("].")))
    items = items.withColumn("again", F.row_number().over(Window.partitionBy("report", F.col("item.route_id")).orderBy("i")) > 1)
    of, dot = (lambda n: F.col(f"item.{n}")), F.col("dot")
    role = F.element_at(F.create_map(*[F.lit(x) for pair in K.ROUTE_ROLES.items() for x in pair]), F.coalesce(of("source_type"), F.lit("")))
    status, verified_on = of("verification_status"), of("last_verified_on")
    outside = lambda c, allowed: ~F.coalesce(c.isin(*allowed), F.lit(False))
    each = [
        (F.concat(dot, F.lit("source_type")), "is not a known kind", outside(of("source_type"), kinds)),
        (F.concat(dot, F.lit("url")), "must be http(s)", ~F.coalesce(of("url").rlike("^https?://"), F.lit(False))),
        (F.concat(dot, F.lit("route_id")), "must be lowercase kebab-case", ~F.coalesce(of("route_id").rlike(KEBAB), F.lit(False))),
        (F.concat(dot, F.lit("route_id")), "must be unique", F.col("again") & of("route_id").isNotNull()),
        (F.concat(dot, F.lit("access")), "is not a known access", outside(of("access"), K.ROUTE_ACCESS)),
        (F.concat(dot, F.lit("evidence_role")), "must fit source_type", role.isNotNull() & ~of("evidence_role").eqNullSafe(role)),
        (F.concat(dot, F.lit("market_specific")), "must be boolean", ~F.coalesce(of("market_specific"), F.lit(False))),
        (F.concat(dot, F.lit("markets")), "must be nonblank strings", of("bad_markets")),
        (F.concat(dot, F.lit("verification_status")), "must be verified or conditional", outside(status, ("verified", "conditional"))),
        (F.concat(dot, F.lit("last_verified_on")), "must be YYYY-MM-DD", (status == "verified") & ~F.coalesce(timing.valid_date(verified_on), F.lit(False))),
        (F.concat(dot, F.lit("last_verified_on")), "must be null unless verified", (status != "verified") & verified_on.isNotNull()),
        (F.concat(dot, F.lit("verify_before_use")), "must be true for conditional routes", (status == "conditional") & ~F.coalesce(of("verify_before_use"), F.lit(False))),
    ]
    names = F.array_distinct(F.transform(F.concat(F.array("id", "display_name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: text.normalized(x)))
    claimed = rows.select("report", F.explode(names).alias("alias")).filter("alias <> ''")
    shared = claimed.groupBy("alias").agg((F.min("report") != F.max("report")).alias("shared")).filter("shared")
    twice = claimed.join(shared, "alias", "left_semi").select("report", F.lit("aliases").alias("location"), F.concat(F.lit("another platform also claims "), "alias").alias("message"))
    return found(rows, root).unionByName(found(items, each)).unionByName(twice)


def official_rules(files: DataFrame) -> DataFrame:
    """What is wrong with files of official sources; an id may occur once."""
    rows = files.select("report", F.try_parse_json("raw").alias("v"))
    broken = found(rows, [(F.lit("sources"), "must be an array", ~F.coalesce(kind_of(F.col("v"), "sources").startswith("ARRAY"), F.lit(False)))])
    sources = elements(rows, F.col("v"), "sources", F.lit(""))
    s, dot = F.col("item"), F.col("dot")
    sources = sources.withColumn("again", F.row_number().over(Window.partitionBy(get(s, "id")).orderBy("report", "i")) > 1)
    blank = lambda v, at, names: [(F.concat(at, F.lit(n)), "must be nonblank", ~F.coalesce(text.nonblank(get(v, n)), F.lit(False))) for n in names]
    exact = lambda v, names: ~F.coalesce(F.array_sort(F.json_object_keys(v.cast("string"))) == F.array(*[F.lit(n) for n in sorted(names)]), F.lit(False))
    fields = ("id", "display_name", "jurisdiction", "authority", "aliases", "routes")
    each = [
        *blank(s, dot, fields[:4]),
        (F.col("at"), "fields do not match", exact(s, fields)),
        (F.concat(dot, F.lit("id")), "must be unique", F.col("again") & get(s, "id").isNotNull()),
        (F.concat(dot, F.lit("aliases")), "must be nonblank strings", _strings(s, "aliases")),
        (F.concat(dot, F.lit("routes")), "must not be empty", F.coalesce(F.size(F.try_variant_get(s, "$.routes", "array<variant>")), F.lit(0)) < 1),
    ]
    routes = elements(sources.select("report", "item", F.col("dot").alias("over")).withColumnRenamed("item", "source"), F.col("source"), "routes", F.col("over"))
    r, dot = F.col("item"), F.col("dot")
    of_route = [
        *blank(r, dot, ("label",)),
        (F.col("at"), "fields do not match", exact(r, ("label", "url", "source_type", "topics"))),
        (F.concat(dot, F.lit("url")), "must be a direct https URL", ~F.coalesce(get(r, "url").rlike("^https://[^/]+"), F.lit(False))),
        (F.concat(dot, F.lit("source_type")), "is not supported", ~F.coalesce(get(r, "source_type").isin("official_publication", "current_rule"), F.lit(False))),
        (F.concat(dot, F.lit("topics")), "must be nonblank strings", _strings(r, "topics")),
    ]
    return broken.unionByName(found(sources, each)).unionByName(found(routes, of_route))
