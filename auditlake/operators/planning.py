"""Research and drill plans: deterministic rows with content-derived ids.

The scope of a plan is configuration, so its tracks are made from a table of kinds; registered routes join them in Spark.
Drills plan a closer look at every event of a table at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions import ids, text, udfs


class Kind(NamedTuple):
    """What all tracks of a kind share: ``identity`` names what their id is made from, ``each`` what queries go over."""

    label: str
    weight: float
    freshness: str
    evidence: str
    sources: tuple[str, ...]
    identity: tuple[str, ...]
    each: str
    queries: tuple[str, ...]


# The kinds of tracks, in a plan's order.
KINDS = {
    "official_updates": Kind(
        "Official publications inside the reporting window", 1.0, "reporting_window", "primary", ("official_publication",), ("regions", "subject", "window"),
        "authorities", ("{each} {subject} announcement rule consultation published",),
    ),
    "effective_deadlines": Kind(
        "Rules taking effect, expiring, or reaching a deadline", 1.0, "upcoming_30_days", "primary", ("current_rule", "official_publication"), ("regions", "subject", "deadline_end"),
        "authorities", ("{each} {subject} effective deadline expires consultation {deadline_day}",),
    ),
    "logistics_chokepoints": Kind(
        "Maritime chokepoints and material shipping incidents", 1.0, "logistics_lookback", "primary", ("maritime_security_notice", "carrier_notice", "official_publication"),
        ("window", "cutoff", "routes"), "", K.MARITIME_QUERIES,
    ),
    "product_scope": Kind(
        "Product and HS-code applicability", 0.9, "reporting_window", "primary", ("official_publication", "current_rule"), ("products", "hs_codes", "regions"),
        "regions", ("{each} {subject} customs classification product requirement",),
    ),
    "marketplace_policy": Kind(
        "{platform} policy monitoring", 1.0, "platform_lookback", "platform_owned", (), ("platform", "seller_market", "program"),
        "", ("{platform} {seller_market} {program} seller policy update",),
    ),
    "discovery_leads": Kind(
        "Secondary-source leads requiring primary confirmation", 0.4, "lead_lookback", "lead_only", ("discovery_lead",), ("regions", "subject", "platforms"),
        "regions", ("{each} {subject} trade compliance logistics seller update", "{each} import ban equipment authorization covered list national security new models"),
    ),
}
TRACK = (
    "pos int, track_id string, kind string, label string, weight double, freshness_mode string, evidence_requirement string, regions array<string>, authorities array<string>,"
    " products array<string>, hs_codes array<string>, platforms array<string>, seller_markets array<string>, programs array<string>, source_types array<string>,"
    " source_urls array<string>, queries array<string>, window_start string, window_end string"
)


def distinct(values: Iterable[str]) -> list[str]:
    """Stripped values without blanks, the first spelling of each by folded case."""
    kept: dict[str, str] = {}
    for v in map(str.strip, values):
        if v:
            kept.setdefault(v.casefold(), v)
    return list(kept.values())


def hs_list(spark: SparkSession, codes: Sequence[str]) -> list[str]:
    """Codes without separators, first occurrences in order; others than 4 to 10 digits are refused."""
    code = text.hs_code(F.col("given"))
    rows = spark.createDataFrame([(n, c) for n, c in enumerate(codes)], "pos int, given string").select("pos", "given", code.alias("code"), text.valid_hs(code).alias("good")).orderBy("pos").collect()
    if wrong := [r["given"] for r in rows if not r["good"]]:
        raise ValueError(f"HS code {wrong[0]!r} must have 4 to 10 digits")
    return list(dict.fromkeys(r["code"] for r in rows))


def authorities(regions: Iterable[str]) -> list[str]:
    """The regions' known authorities, each once; other regions have a generic one."""
    named = (K.AUTHORITIES.get(K.AUTHORITY_REGIONS.get(r.casefold(), r.casefold()), (f"{r} responsible trade and product authorities",)) for r in regions)
    return list(dict.fromkeys(a for group in named for a in group))


def _instant(value: str, name: str) -> datetime:
    at = datetime.fromisoformat(value)
    if at.utcoffset() is None:
        raise ValueError(f"{name} needs a UTC offset")
    return at


def track_id(kind: Column, identity: Column) -> Column:
    """The kind and a hash of the identity, given as JSON, in canonical form."""
    return F.concat_ws("-", F.translate(kind, "_", "-"), ids.hashed(udfs.canonical_json(identity), 12))


def content_id(rows: DataFrame, *columns: str, order: str = "pos", head: Column | None = None) -> DataFrame:
    """One row with ``id``: a hash over a small table's rows in their order, behind ``head``."""
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order]))), lambda r: F.struct(*[r[c] for c in columns])), {"ignoreNullFields": "false"})
    return rows.agg(ids.hashed(F.concat_ws("\n", head if head is not None else F.lit(""), body), 24).alias("id"))


def plan_id(tracks: DataFrame, cutoff: str) -> DataFrame:
    """The id of a plan: of its cutoff and its tracks in order."""
    return content_id(tracks, "track_id", "window_start", "window_end", head=F.lit(cutoff))


def manifest_ids(tasks: DataFrame, created_at: str, window_start: str, cutoff: str) -> DataFrame:
    """The id of each platform's manifest: of its times and its tasks, sorted."""
    ordered = F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "task_id", "source_type", "url"))), "\n")
    return tasks.groupBy("platform").agg(ids.hashed(F.concat_ws("\n", F.lit(created_at), F.lit(window_start), F.lit(cutoff), ordered), 24).alias("manifest_id"), F.count("*").alias("tasks"))


def plan(
    spark: SparkSession, cutoff: str, regions: Sequence[str] = (), platforms: Sequence[str | tuple[str, str, str]] = (), products: Sequence[str] = (), hs_codes: Sequence[str] = (),
    keywords: Sequence[str] = (), themes: Sequence[str] = (), window_start: str | None = None, deadline_end: str | None = None, routes: DataFrame | None = None, official: DataFrame | None = None,
) -> DataFrame:
    """A row a track: one for each platform, one of each other kind; product tracks only with products or codes.

    ``platforms`` are names or (name, market, program). ``routes`` (platform, source_type, url and maybe policy_areas) and
    ``official`` (jurisdiction, aliases, url) are the registries' tables.
    """
    at = _instant(cutoff, "cutoff")
    text_of = lambda x: x.isoformat(timespec="seconds")
    start, end = window_start or text_of(at - timedelta(hours=24)), deadline_end or text_of(at + timedelta(days=30))
    if _instant(start, "window_start") > at or _instant(end, "deadline_end") <= at:
        raise ValueError("a plan's window begins by its cutoff and its deadlines end after it")
    regions, products, keywords = distinct(regions) or list(K.DEFAULT_REGIONS), distinct(products), distinct(keywords)
    codes = hs_list(spark, distinct(hs_codes)) if hs_codes else []
    first: dict[str, tuple[str, str, str]] = {}
    for x in platforms:
        scope = (x, "unknown", "unknown") if isinstance(x, str) else x
        first.setdefault(scope[0].casefold(), scope)
    scopes = list(first.values())
    subject = " ".join([*products, *(f"HS {c}" for c in codes), *keywords, *distinct(themes)]) or K.DEFAULT_SUBJECT
    known = {
        "regions": regions, "subject": subject, "window": start, "deadline_end": end, "deadline_day": end[:10], "cutoff": cutoff, "routes": list(K.MARITIME_URLS),
        "products": products, "hs_codes": codes, "platforms": [s[0] for s in scopes], "authorities": authorities(regions),
    }
    platform_start = text_of(min(_instant(start, "window_start"), at - timedelta(days=7)))

    rows: list[tuple] = []
    for kind, of in KINDS.items():
        if kind == "product_scope" and not (products or codes):
            continue
        for scope in scopes if kind == "marketplace_policy" else [None]:
            here = known | (dict(zip(("platform", "seller_market", "program"), scope)) if scope else {})
            every = known[of.each] if of.each else [""]
            queries = [q.format(each=e, **here) for e in every for q in of.queries]
            general = kind in ("official_updates", "effective_deadlines", "product_scope")
            places = ["International logistics"] if kind == "logistics_chokepoints" else [] if scope else regions
            who = list(K.MARITIME_AUTHORITIES) if kind == "logistics_chokepoints" else known["authorities"] if general else []
            about = [list(x) for x in zip(*([scope] if scope else scopes if kind == "discovery_leads" else []))] or [[], [], []]
            urls = list(K.MARITIME_URLS) if kind == "logistics_chokepoints" else []
            until = end if kind == "effective_deadlines" else cutoff
            rows.append((
                len(rows), json.dumps({name: here[name] for name in of.identity}), kind, of.label.format(**here), of.weight, of.freshness, of.evidence, places, who,
                products, codes, *about, list(of.sources), urls, queries, platform_start if scope else start, until,
            ))
    out = spark.createDataFrame(rows, TRACK).withColumn("track_id", track_id(F.col("kind"), F.col("track_id")))
    none = F.array().cast("array<string>")
    if official is not None:
        urls = for_regions(official, regions).agg(F.array_distinct(F.collect_list("url")).alias("__urls")).withColumn("kind", F.lit("official_updates"))
        out = out.join(F.broadcast(urls), "kind", "left").withColumn("source_urls", F.coalesce("__urls", "source_urls")).drop("__urls")
    if routes is not None:
        areas = F.max("policy_areas") if "policy_areas" in routes.columns else F.max(none)
        of = routes.groupBy(text.normalized(F.col("platform")).alias("__p")).agg(F.array_sort(F.collect_set("source_type")).alias("__types"), F.array_sort(F.collect_set("url")).alias("__urls"), areas.alias("__areas"))
        mine = (F.col("kind") == "marketplace_policy") & (text.normalized(F.get("platforms", F.lit(0))) == F.col("__p"))
        about = F.concat_ws(" ", F.get("platforms", F.lit(0)), F.get("seller_markets", F.lit(0)), F.array_join("__areas", " "))
        out = out.join(of, mine, "left").withColumns({
            "source_types": F.coalesce("__types", "source_types"), "source_urls": F.coalesce("__urls", "source_urls"),
            "queries": F.when(F.size("__areas") > 0, F.concat("queries", F.array(about))).otherwise(F.col("queries")),
        }).drop("__p", "__types", "__urls", "__areas")
    return out.select(*[c.split()[0] for c in TRACK.split(", ") for c in c.split(",")]).orderBy("pos")


def manifest_requests(tracks: DataFrame) -> DataFrame:
    """What is to be acquired: platform, market, program and a window of seven days or more."""
    rows = tracks.filter("kind = 'marketplace_policy'")
    return rows.select(F.get("platforms", F.lit(0)).alias("platform"), F.get("seller_markets", F.lit(0)).alias("seller_market"), F.get("programs", F.lit(0)).alias("program"), "window_start", F.col("window_end").alias("cutoff"))


def invariants(tracks: DataFrame, platforms: Sequence[str]) -> DataFrame:
    """Broken invariants of a plan: a row each."""
    n = lambda k: F.sum((F.col("kind") == k).cast("int"))
    policy = F.col("kind") == "marketplace_policy"
    covered = F.array_sort(F.collect_set(F.when(policy, F.get("platforms", F.lit(0)))))
    unlike = ~F.col("evidence_requirement").eqNullSafe(F.element_at(F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v.evidence)]), F.col("kind")))
    scoped = (F.size("products") > 0) | (F.size("hs_codes") > 0)
    sums = tracks.agg(
        n("official_updates").alias("o"), n("effective_deadlines").alias("e"), n("logistics_chokepoints").alias("l"), n("discovery_leads").alias("d"), n("product_scope").alias("s"), covered.alias("p"),
        (F.count("track_id") - F.countDistinct("track_id")).alias("again"), F.bool_or(unlike).alias("unlike"), F.bool_or(scoped).alias("scoped"),
    )
    wanted = F.array_sort(F.array(*[F.lit(p) for p in dict.fromkeys(platforms)]).cast("array<string>"))
    broken = [
        (F.col("o") < 1, "official_updates is required"), (F.col("e") < 1, "effective_deadlines is required"), (F.col("d") < 1, "discovery_leads is required"),
        (F.col("l") != 1, "exactly one logistics track"), (F.col("p") != wanted, "platforms must be covered exactly"), (F.col("again") > 0, "track ids must differ"),
        (F.col("unlike"), "evidence must fit the kind"), (F.col("scoped") & (F.col("s") < 1), "products need a product_scope track"),
    ]
    return sums.select(F.explode(F.filter(F.array(*[F.when(c, m) for c, m in broken]), lambda x: x.isNotNull())).alias("message"))


def for_regions(sources: DataFrame, regions: Sequence[str]) -> DataFrame:
    """Official sources whose jurisdiction or alias is one of the regions, by folded case."""
    wanted = F.array(*[F.lit(r.strip().lower()) for r in regions]).cast("array<string>")
    names = F.transform(F.concat(F.array("jurisdiction"), F.coalesce("aliases", F.array().cast("array<string>"))), F.lower)
    return sources.filter(F.coalesce(F.arrays_overlap(names, wanted), F.lit(False)))


def drill(events: DataFrame, routes: DataFrame | None = None, history: DataFrame | None = None, refresh: bool = False) -> DataFrame:
    """How to verify each event again: mode, queries, questions, targets and, from a library's sightings, its history.

    Events: event_id, title, jurisdiction, authority, source_title, source_url; optional summary, products, status,
    evidence, platform, seller_market, program, policy_area. An event names a platform or has no policy.
    """
    at = lambda name, kind="string": F.col(name) if name in events.columns else F.lit(None).cast(kind)
    part = lambda c: F.coalesce(c, F.lit(""))
    policy = text.nonblank(part(at("platform")))
    given: list[Column] = [F.when(text.nonblank(part(c)), c) for c in (F.col("jurisdiction"), F.col("authority"), F.col("title"), F.array_join(at("products", "array<string>"), " "))]
    base = F.concat_ws(" ", *given)
    fixed = F.array(*[F.concat_ws(" ", base, F.lit(q)) for q in K.DRILL_QUERIES])
    named = F.transform(text.identifiers(F.concat_ws(" ", "title", at("summary"), "source_title")), lambda i: F.concat(F.lit('"'), i, F.lit('" amendment implementation official')))
    seller = F.when(policy, F.array(F.concat_ws(" ", *[part(at(c)) for c in ("platform", "seller_market", "program", "policy_area")], F.lit("seller policy"))))
    none = F.array().cast("array<string>")
    queries = F.array_distinct(F.filter(F.transform(F.concat(fixed, F.coalesce(named, none), F.coalesce(seller, none)), F.trim), text.nonblank))
    questions = F.concat(F.array(*[F.lit(q) for q in K.DRILL_QUESTIONS]), F.when(policy, F.array(F.lit(K.DRILL_POLICY_QUESTION))).otherwise(none))
    mode = F.when((part(at("status")) == "unconfirmed") | (F.coalesce(at("evidence", "int"), F.lit(-1)) == 0), "confirmation").otherwise("revalidation")
    out = events.withColumns({"mode": mode, "cache_policy": F.lit("force_refresh" if refresh else "normal_ttl_with_explicit_refresh_for_changed_sources"), "queries": queries, "questions": questions})
    target = lambda kind, url: F.struct(kind.alias("source_type"), url.alias("url"))
    own = F.array(target(F.lit("event_primary_source"), F.col("source_url")))
    if routes is None:
        out = out.withColumn("targets", own)
    else:
        near = routes.groupBy(text.normalized(F.col("platform")).alias("__a")).agg(F.array_sort(F.collect_set(target(F.col("source_type"), F.col("url")))).alias("__r"))
        out = out.withColumn("__n", text.normalized(part(at("platform")))).join(near, F.col("__n") == F.col("__a"), "left")
        fresh = F.filter(F.coalesce("__r", F.array().cast("array<struct<source_type:string,url:string>>")), lambda t: ~t["url"].eqNullSafe(F.col("source_url")))
        out = out.withColumn("targets", F.concat(own, fresh)).drop("__a", "__n", "__r")
    if history is not None:
        seen = history.groupBy(F.col("event_id").alias("__e")).agg(F.min("report_date").alias("first_seen"), F.max("report_date").alias("last_seen"), F.count("*").alias("sighting_count"))
        out = out.join(seen, F.col("event_id") == F.col("__e"), "left").drop("__e")
    return out.withColumn("drill_id", ids.hashed(ids.object_json({c: F.col(c) for c in ("event_id", "mode", "cache_policy", "queries", "questions", "targets")}), 24))
