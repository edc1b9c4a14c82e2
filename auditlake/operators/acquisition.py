"""Tasks, receipts, coverage, source health and the dashboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions import ids, score, text, timing
from auditlake.operators import containment
from auditlake.operators.common import best_of, zero_filled


def tasks(routes: DataFrame, seller_market: str, program: str, window_start: str) -> DataFrame:
    """A task for each route (platform, route_id, source_type, url, markets, verification_status, verify_before_use)."""
    markets = F.transform("markets", F.lower)
    fits = F.array_contains(markets, "*") | F.array_contains(markets, seller_market.lower())
    args = [F.col("platform"), F.lit(seller_market), F.lit(program), F.col("source_type"), F.col("url"), F.lit(window_start)]
    return routes.select(
        ids.task_id(*args).alias("task_id"), "platform", F.lit(seller_market).alias("seller_market"), F.lit(program).alias("program"), "source_type", "url",
        F.lit(window_start).alias("window_start"), (F.col("source_type") == "dashboard").alias("requires_auth"),
        (F.coalesce("verify_before_use", F.lit(False)) | ~F.col("verification_status").eqNullSafe("verified") | ~fits).alias("route_verification_required"),
    ).orderBy(F.lower("platform"), "source_type", "url")


def latest_receipts(receipts: DataFrame) -> DataFrame:
    """The receipt of the latest instant of each task; of equal instants the first by pos."""
    return best_of(receipts, ["task_id"], F.desc(timing.instant(F.col("checked_at"))), F.col("pos"))


def access_result(rows: Column | None = None) -> Column:
    """An aggregate over a group's receipts: the first that any of them shows."""
    positive = F.col("result").isin(*K.POSITIVE_RESULTS)
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return (
        F.when(any_of((F.col("retrieval_method") == "browser_authenticated") & positive), "checked_authenticated")
        .when(any_of(F.col("result") == "login_required"), "login_required")
        .when(any_of(F.col("result") == "blocked"), "blocked")
        .when(any_of(positive | (F.col("result") == "not_applicable")), "public_checked")
        .otherwise("not_checked")
    )


def coverage(tasks: DataFrame, receipts: DataFrame, cutoff: str, gaps: DataFrame | None = None) -> DataFrame:
    """The ledger: a row for each platform, market and program with what was checked and what is missing."""
    keys = ["platform", "seller_market", "program"]
    seen = latest_receipts(receipts).select("task_id", "result", "retrieval_method", "checked_at", "route_verified", F.col("snapshot").isNotNull().alias("has_snapshot"), "final_url", F.lit(True).alias("seen"))
    rows = tasks.join(seen, "task_id", "left")
    public = F.col("source_type").isin("official_updates", "current_policy")
    gap = (
        F.when(F.col("seen").isNull(), F.concat(F.lit("nothing received from "), "source_type", F.lit(" "), "url")),
        F.when(F.col("seen") & F.col("route_verification_required") & ~F.col("route_verified"), F.concat(F.lit("route of this market is not verified: "), "url")),
        F.when(F.col("seen") & public & F.col("result").isin(*K.POSITIVE_RESULTS) & ~F.col("has_snapshot"), F.concat(F.lit("opened without a snapshot: "), "final_url")),
    )
    rows = rows.withColumn("gaps", F.filter(F.array(*gap), lambda g: g.isNotNull()))
    checked = lambda kind: F.coalesce(F.bool_or(F.col("seen") & (F.col("source_type") == kind)), F.lit(False))
    out = rows.groupBy(*keys).agg(
        F.min("window_start").alias("lookback_start"), checked("official_updates").alias("public_update_checked"), checked("current_policy").alias("current_policy_checked"),
        checked("dashboard").alias("dashboard_checked"), access_result().alias("access_result"),
        F.coalesce(F.max_by("checked_at", timing.instant(F.col("checked_at"))), F.lit(cutoff)).alias("checked_at"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("source_type", "url", "gaps"))), lambda x: x["gaps"])).alias("gaps"),
    )
    if gaps is not None:
        said = gaps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.concat(F.lit("declared gap of "), "source_type", F.lit(": "), "reason"))).alias("declared"))
        out = out.join(said, keys, "full_outer").withColumn("gaps", F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("declared", "gaps")])).drop("declared")
        out = out.fillna(False, ["public_update_checked", "current_policy_checked", "dashboard_checked"]).fillna({"access_result": "not_checked", "checked_at": cutoff})
    return out.orderBy(*keys)


def audit_state(error: Column, http_status: Column, result: Column, needs_route: Column, route_verified: Column, source_type: Column, has_snapshot: Column) -> Column:
    """The first of eleven rules that a receipt meets."""
    e = F.lower(text.text_of(error))
    rate = (F.coalesce(http_status, F.lit(0)) == 429) | e.contains("rate") | e.contains("429")
    return (
        F.when(e.rlike("schema|parse|decode"), "schema_drift")
        .when(rate, "rate_limited")
        .when(e.rlike("timeout|timedout"), "timeout")
        .when(result == "blocked", "blocked")
        .when(result == "login_required", "login_required")
        .when(result.isin("not_applicable", "candidate_found"), "partial")
        .when(needs_route & ~route_verified, "partial")
        .when(source_type.isin("official_updates", "current_policy") & ~has_snapshot, "partial")
        .when(result == "no_relevant_update", "no_relevant_update")
        .otherwise("ok")
    )


def health(tasks: DataFrame, receipts: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """Every task with its audit_state and fix_hint; declared gaps are not_configured."""
    rows = tasks.join(latest_receipts(receipts).select("task_id", "result", "error_type", "http_status", "route_verified", "snapshot", "checked_at"), "task_id", "left")
    state = F.when(F.col("result").isNull(), "not_checked").otherwise(
        audit_state(F.col("error_type"), F.col("http_status"), F.col("result"), F.col("route_verification_required"), F.col("route_verified"), F.col("source_type"), F.col("snapshot").isNotNull())
    )
    rows = rows.select("platform", "seller_market", "program", "source_type", "url", "requires_auth", "checked_at", state.alias("audit_state"))
    if gaps is not None:
        rows = rows.unionByName(gaps.select("platform", "seller_market", "program", "source_type", F.lit("not_configured").alias("audit_state")), allowMissingColumns=True)
    hint = reduce(lambda w, p: w.when(F.col("audit_state") == p[0], p[1]), list(K.FIX_HINTS.items())[1:], F.when(F.col("audit_state") == "ok", K.FIX_HINTS["ok"]))
    hint = F.when(F.col("requires_auth") & (F.col("audit_state") == "not_checked"), K.DASHBOARD_HINT).otherwise(hint)
    rows = rows.withColumn("fix_hint", hint).withColumn("source_id", ids.source_id(*[F.col(c) for c in ("platform", "seller_market", "program", "source_type", "url")]))
    return rows.orderBy(*[F.lower(F.coalesce(c, F.lit(""))) for c in ("platform", "seller_market", "program", "source_type", "url")])


def health_summary(rows: DataFrame) -> DataFrame:
    """overall and the counts of all ten states."""
    n = zero_filled(rows.groupBy("audit_state").agg(F.count("*").alias("n")), "audit_state", K.HEALTH_STATES)
    some = lambda states: F.sum(F.when(F.col("audit_state").isin(*states), F.col("n")).otherwise(0)) > 0
    overall = F.when(some(K.SEVERE_STATES), "degraded").when(some(K.INCOMPLETE_STATES), "incomplete").otherwise("healthy")
    return n.agg(overall.alias("overall"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("audit_state", "n")))).alias("counts"))


def reusable_receipts(receipts: DataFrame, now: Column, ttl: int) -> DataFrame:
    """Successful receipts whose age is within the time to live."""
    age = timing.seconds_between(timing.instant(F.col("checked_at")), now)
    return receipts.filter(F.col("result").isin(*K.POSITIVE_RESULTS) & timing.reusable(age, ttl))


def depths(routes: DataFrame) -> DataFrame:
    """platform, depth, missing types, conditional and verified public routes."""
    verified = F.col("verification_status") == "verified"
    public = F.col("access").isin("public", "mixed")
    kinds = ("official_updates", "current_policy", "dashboard")
    out = routes.groupBy("platform").agg(
        F.collect_set("source_type").alias("types"), F.bool_and(verified).alias("all_verified"), F.sum((verified & public).cast("int")).alias("verified_public"),
        F.sum((~verified).cast("int")).alias("conditional"), F.count("*").alias("routes"), F.max("last_verified_on").alias("last_verified_on"),
    )
    missing = F.array_except(F.array(*[F.lit(k) for k in kinds]), "types")
    return out.withColumn("missing", missing).withColumn("depth", score.source_depth(F.size("types"), F.col("all_verified"), F.col("verified_public")))


def dashboard(routes: DataFrame, health_rows: DataFrame) -> DataFrame:
    """Platforms by what needs work most."""
    bad = health_rows.groupBy(F.lower("platform").alias("__p")).agg(F.countDistinct(F.when(F.col("audit_state").isin("blocked", "timeout", "rate_limited", "schema_drift"), F.col("audit_state"))).alias("bad"), F.max("checked_at").alias("last_checked_at"), F.array_sort(F.collect_set("audit_state")).alias("health_states"))
    rows = depths(routes).join(bad, F.lower("platform") == F.col("__p"), "left").drop("__p")
    priority = score.dashboard_priority(F.col("depth"), F.size("missing"), F.col("conditional"), F.col("verified_public") == 0, F.coalesce("bad", F.lit(0)))
    actions = F.filter(
        F.array(
            F.when(F.size("missing") > 0, F.concat(F.lit("verified routes are missing: "), F.array_join("missing", ", "))),
            F.when(F.col("conditional") > 0, F.concat(F.lit("conditional routes to check again: "), F.col("conditional").cast("string"))),
            F.when(F.col("verified_public") == 0, "no public route is verified"),
            F.when(F.col("bad") > 0, "a source failed when last read"),
        ),
        lambda a: a.isNotNull(),
    )
    actions = F.when(F.size(actions) > 0, actions).otherwise(F.array(F.lit("nothing but the usual reading")))
    return rows.withColumn("priority", priority).withColumn("actions", actions).orderBy(F.desc("priority"), F.lower("platform"))


def resolve(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names with the platform that has the alias; aliases: alias, platform."""
    known = aliases.select(text.normalized(F.col("alias")).alias("__a"), "platform").distinct()
    return names.withColumn("__a", text.normalized(F.col("name"))).join(known, "__a", "left").drop("__a")


def ambiguous_aliases(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy(text.normalized(F.col("alias")).alias("alias")).agg(F.countDistinct("platform").alias("n")).filter("n > 1")


def named_platforms(scopes: DataFrame, aliases: DataFrame) -> DataFrame:
    """scope, platform: platforms that a scope text names."""
    return containment.named(scopes.select("scope"), aliases, "scope")


def dashboard_summary(rows: DataFrame) -> DataFrame:
    """One row about a dashboard: platforms, how many of each depth, and how many need work."""
    depth = lambda d: F.count_if(F.col("depth") == d).alias(d)
    return rows.agg(F.count("*").alias("platforms"), depth("full"), depth("hybrid"), depth("constrained"), F.count_if(F.col("priority") > 0).alias("needing_work"))


def source_entries(receipts: DataFrame) -> DataFrame:
    """Receipts as the source checks of a ledger, with the receipt inside."""
    inner = ("task_id", "retrieval_method", "attempts", "http_status", "content_hash", "content_ref", "error_type", "route_verified")
    receipt = F.struct(*[F.col(c) for c in inner]).alias("acquisition_receipt")
    url = F.coalesce("final_url", "requested_url").alias("url")
    return receipts.select("platform", "seller_market", "program", F.struct("source_type", url, "result", "checked_at", F.coalesce("notes", F.lit("")).alias("notes"), "snapshot", receipt).alias("source"))
