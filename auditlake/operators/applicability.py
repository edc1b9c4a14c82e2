"""Which catalog items an event touches.

Events: event_id, title, summary, impact, rationale, products, jurisdiction, platform, hs_codes. Catalog: sku, name,
markets, platforms, hs_codes, keywords; an empty scope means any.

Events and items never meet all by all. An item's scopes are a few (market, platform) keys, and of an event's keys just
one fits an item, so the number of items in scope is a sum of the keys' counts. Codes meet by equal prefixes; names and
keywords meet bodies by three of their letters, each distinct one once, and then the items that have them by scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text
from auditlake.operators.common import written

ANY = "*"
GRAM = 3


def _reach(scope: str) -> Column:
    """The scopes an item reaches, or the sign for any."""
    return F.when(F.size(scope) == 0, F.array(F.lit(ANY))).otherwise(F.array_distinct(F.transform(scope, text.catalog_scope)))


def _keys(catalog: DataFrame) -> DataFrame:
    """sku with each market and platform it reaches."""
    return catalog.select("sku", F.explode(_reach("markets")).alias("__m"), "platforms").select("sku", "__m", F.explode(_reach("platforms")).alias("__p")).distinct()


def _wanted(events: DataFrame) -> DataFrame:
    """event_id with each market and platform of items in its scope."""
    own = lambda c: F.array_distinct(F.array(F.lit(ANY), text.catalog_scope(F.col(c))))
    return events.select("event_id", F.explode(own("jurisdiction")).alias("__m"), "platform").select("event_id", "__m", F.explode(own("platform")).alias("__p"))


def scope_counts(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """event_id and in_scope, the number of items whose market and platform agree with the event's."""
    counts = _keys(catalog).groupBy("__m", "__p").agg(F.count("*").alias("n"))
    found = _wanted(events).join(counts, ["__m", "__p"]).groupBy("event_id").agg(F.sum("n").alias("in_scope"))
    return events.select("event_id").join(found, "event_id", "left").select("event_id", F.coalesce("in_scope", F.lit(0)).alias("in_scope"))


def _said(events: DataFrame) -> Column:
    parts = [text.text_of(F.col(c)) for c in ("title", "summary", "impact", "rationale")]
    return F.concat_ws(" ", *parts, F.array_join(F.coalesce("products", F.array().cast("array<string>")), " "))


def _heads(code: str) -> Column:
    """A code and all that it begins with."""
    return F.transform(F.sequence(F.lit(1), F.length(code)), lambda n: F.substring(F.col(code), F.lit(1), n))


def _grams(c: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - GRAM + 1, F.lit(1))), lambda n: F.substring(c, n, F.lit(GRAM))))


def match(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """event_id, sku, hs (matched codes), terms (matched names and keywords) of in-scope pairs that have one of them."""
    wanted, keys = _wanted(events), _keys(catalog)

    codes = events.select("event_id", F.explode(text.hs_codes(F.col("hs_codes"), _said(events))).alias("code")).distinct()
    own = catalog.select("sku", F.explode("hs_codes").alias("own")).filter("own <> ''").distinct()
    named = codes.select("code").distinct(), own.select("own").distinct()
    longer = named[0].select("code", F.explode(_heads("code")).alias("own")).join(named[1], "own")
    shorter = named[1].select("own", F.explode(_heads("own")).alias("code")).join(named[0], "code")
    overlap = longer.unionByName(shorter).distinct()
    by_code = codes.join(overlap, "code").select("event_id", "own").distinct().join(wanted, "event_id")
    by_code = by_code.join(own.join(keys, "sku"), ["own", "__m", "__p"]).select("event_id", "sku", F.col("own").alias("hs"), F.lit(None).cast("string").alias("term"))

    words = catalog.select("sku", F.explode(F.array_distinct(F.concat(F.array("name"), "keywords"))).alias("word")).withColumn("low", text.spaced(F.col("word")))
    words = words.filter(F.length("low") >= GRAM)
    asked = words.select("low").distinct().withColumn("gram", F.substring("low", 1, GRAM))
    bodies = events.select("event_id", text.spaced(_said(events)).alias("body"))
    heard = bodies.select("event_id", "body", F.explode(_grams(F.col("body"))).alias("gram")).join(asked, "gram").filter(F.contains("body", "low"))
    by_term = heard.select("event_id", "low").join(wanted, "event_id").join(words.join(keys, "sku"), ["low", "__m", "__p"])
    by_term = by_term.select("event_id", "sku", F.lit(None).cast("string").alias("hs"), F.col("word").alias("term"))

    found = by_code.unionByName(by_term).groupBy("event_id", "sku")
    return found.agg(F.array_sort(F.collect_set("hs")).alias("hs"), F.array_sort(F.collect_set("term")).alias("terms"))


def counts(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """event_id, in_scope, by_hs, by_term and matched: how many items are in scope, and match by code, by term, by either.

    No pair of an event and an item is formed. Items that reach the same scopes and have the same of the codes and terms
    that any event names are one class, and so are events of one scope that name the same of what items have; classes meet
    as ``match`` has events and items meet, and an item class counts as often as it has items.
    """
    said = events.select("event_id", text.catalog_scope(F.col("jurisdiction")).alias("jurisdiction"), text.catalog_scope(F.col("platform")).alias("platform"), text.hs_codes(F.col("hs_codes"), _said(events)).alias("codes"), text.spaced(_said(events)).alias("body"))
    said = written(said.withColumn("speech", F.sha2(F.to_json(F.struct("codes", "body")), 256)))
    speeches = written(said.groupBy("speech").agg(F.first("codes").alias("codes"), F.first("body").alias("body")))
    has = lambda kind, c: F.concat(F.lit(kind), c).alias("has")
    own = catalog.select("sku", F.explode("hs_codes").alias("own")).filter("own <> ''").distinct()
    words = catalog.select("sku", F.explode(F.concat(F.array("name"), "keywords")).alias("word")).select("sku", text.spaced(F.col("word")).alias("low")).filter(F.length("low") >= GRAM).distinct()

    codes = speeches.select("speech", F.explode("codes").alias("code"))
    named = codes.select("code").distinct(), own.select("own").distinct()
    longer = named[0].select("code", F.explode(_heads("code")).alias("own")).join(named[1], "own").select("code", "own")
    shorter = named[1].select("own", F.explode(_heads("own")).alias("code")).join(named[0], "code").select("code", "own")
    by_code = codes.join(longer.unionByName(shorter).distinct(), "code").select("speech", has("h", F.col("own")))
    asked = words.select("low").distinct().withColumn("gram", F.substring("low", 1, GRAM))
    by_term = speeches.select("speech", "body", F.explode(_grams(F.col("body"))).alias("gram")).join(asked, "gram").filter(F.contains("body", "low")).select("speech", has("t", F.col("low")))
    heard = written(by_code.unionByName(by_term).distinct())
    told = heard.groupBy("speech").agg(F.array_sort(F.collect_set("has")).alias("named"))

    # classes of items, and what they have that is named at all
    used = written(own.select("sku", has("h", F.col("own"))).unionByName(words.select("sku", has("t", F.col("low")))).join(heard.select("has").distinct(), "has", "left_semi").distinct())
    scopes = _keys(catalog).groupBy("sku").agg(F.array_sort(F.collect_set(F.struct("__m", "__p"))).alias("scopes"))
    items = used.groupBy("sku").agg(F.array_sort(F.collect_set("has")).alias("have")).join(scopes, "sku")
    items = written(items.groupBy("scopes", "have").agg(F.count("*").alias("n")).withColumn("item", F.sha2(F.to_json(F.struct("scopes", "have")), 256)))
    offered = items.select("item", "n", F.explode("scopes").alias("s"), "have").select("item", "n", "s.*", F.explode("have").alias("has"))

    rows = said.join(told, "speech", "left").select("event_id", "jurisdiction", "platform", F.col("named"))
    name = F.sha2(F.to_json(F.struct("jurisdiction", "platform", "named"), {"ignoreNullFields": "false"}), 256)
    rows = written(rows.withColumn("event", name))
    kinds = written(rows.groupBy("event").agg(F.first("jurisdiction").alias("jurisdiction"), F.first("platform").alias("platform"), F.first("named").alias("named")))
    keys = _wanted(kinds.select(F.col("event").alias("event_id"), "jurisdiction", "platform")).withColumnRenamed("event_id", "event")
    wants = kinds.select("event", F.explode("named").alias("has")).join(keys, "event")
    flag = lambda kind: F.max((F.substring("has", 1, 1) == kind).cast("int"))
    met = wants.join(offered, ["has", "__m", "__p"]).groupBy("event", "item", "n").agg(flag("h").alias("hs"), flag("t").alias("term"))
    met = met.groupBy("event").agg(F.sum(F.col("n") * F.col("hs")).alias("by_hs"), F.sum(F.col("n") * F.col("term")).alias("by_term"), F.sum("n").alias("matched"))
    in_scope = scope_counts(kinds.select(F.col("event").alias("event_id"), "jurisdiction", "platform"), catalog).withColumnRenamed("event_id", "event")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    found = written(in_scope.join(met, "event", "left").select("event", "in_scope", none("by_hs"), none("by_term"), none("matched")))
    return rows.select("event_id", "event").join(found, "event").drop("event")


def status_of(matched: Column, in_scope: Column) -> Column:
    return F.when(matched > 0, "matched").when(in_scope > 0, "needs_review").otherwise("no_match")


def statuses(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """event_id, status (matched, needs_review, no_match) and the matched items."""
    basis = F.filter(F.array(F.when(F.size("hs") > 0, "hs_prefix"), F.when(F.size("terms") > 0, "product_keyword")), lambda b: b.isNotNull())
    item = F.struct("sku", basis.alias("basis"), F.col("hs").alias("matched_hs_codes"), F.col("terms").alias("matched_terms"))
    found = match(events, catalog).groupBy("event_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    rows = scope_counts(events, catalog).join(found, "event_id", "left")
    status = status_of(F.size("items"), F.col("in_scope"))
    none = F.expr("array()").cast("array<struct<sku:string,basis:array<string>,matched_hs_codes:array<string>,matched_terms:array<string>>>")
    return rows.select("event_id", status.alias("status"), F.coalesce("items", none).alias("items"))
