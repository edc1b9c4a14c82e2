"""Early leads: similarity, clusters and the order in which to verify them.

Leads: pos, lead_id, source_title, source_url, source_tier, published_at, jurisdiction, platform, products, hs_codes,
claim, momentum_score. Nothing here promotes a lead: clusters stay unconfirmed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions import ids, score, text, timing, udfs
from auditlake.operators.common import apart, listed, meet, placed, spread, unrolled, written, written_small
from auditlake.operators.graph import components, constrained


def _prepared(leads: DataFrame) -> DataFrame:
    return leads.select(
        "pos",
        text.known_scope(F.col("jurisdiction")).alias("jurisdiction"),
        text.known_scope(F.col("platform")).alias("platform"),
        text.canonical_url(F.col("source_url")).alias("url"),
        text.identifiers(F.concat_ws(" ", "source_title", "claim")).alias("identifiers"),
        text.normalized(F.col("claim")).alias("claim"),
        text.normalized(F.col("source_title")).alias("title"),
        F.array_distinct(F.transform(F.concat("products", "hs_codes"), F.lower)).alias("goods"),
    )


def lead_links(leads: DataFrame, threshold: float = K.CLUSTER_THRESHOLD) -> DataFrame:
    """a < b and their similarity, from the threshold up.

    Equal URLs and shared identifiers meet by key; the rest by jurisdiction and platform, leads without one of these with all
    that have any, large groups in chunks, and only where bounds by lengths, by letters and by common subsequence reach the
    threshold. Leads whose texts and goods cannot reach it with any other meet none.
    """
    rows = _prepared(leads)
    clash = lambda n: F.coalesce(F.col(f"a.{n}") != F.col(f"b.{n}"), F.lit(False))
    ordered = (F.col("a.pos") < F.col("b.pos")) & ~(clash("jurisdiction") | clash("platform"))
    a, b = rows.alias("a"), rows.alias("b")
    pick = lambda df, s: df.select(F.col("a.pos").alias("a"), F.col("b.pos").alias("b"), s.alias("similarity"))
    by_url = pick(a.join(b, (F.col("a.url") == F.col("b.url")) & ordered), F.lit(1.0))
    named = rows.withColumn("identifier", F.explode("identifiers"))
    by_id = pick(named.alias("a").join(named.alias("b"), (F.col("a.identifier") == F.col("b.identifier")) & ordered), F.lit(0.95))

    def bound(name: str) -> Column:
        p, q = F.col(f"a.{name}_length"), F.col(f"b.{name}_length")
        return F.when((p > 0) & (q > 0), 2 * F.least(p, q) / (p + q)).otherwise(0.0)

    filled = (F.size("a.goods") > 0) & (F.size("b.goods") > 0)
    goods = F.when(filled & (F.col("a.goods") == F.col("b.goods")), 1.0).when(filled, score.jaccard(F.col("a.goods"), F.col("b.goods"))).otherwise(0.0)
    x, y, z = K.LEAD_WEIGHTS
    rows = rows.withColumn("any", F.pmod("pos", F.lit(1)))  # one key for all; a literal would make the join a product
    has = lambda c, weight: F.when(c, weight).otherwise(0.0)
    rows = rows.filter(has(F.length("claim") > 0, x) + has(F.length("title") > 0, y) + has(F.size("goods") > 0, z) >= threshold - 1e-9)
    rows = rows.withColumn("scope", F.when(F.col("jurisdiction").isNotNull() & F.col("platform").isNotNull(), F.to_json(F.struct("jurisdiction", "platform"))))
    rows = rows.drop("url", "identifiers").withColumns({"claim_length": F.length("claim"), "title_length": F.length("title")})
    whole, known, loose = rows.filter("scope is not null"), rows.filter("jurisdiction is not null"), rows.filter("jurisdiction is null")
    pairs = meet(whole, whole, "scope").filter("a.pos < b.pos")
    first = F.col("a.pos") < F.col("b.pos")
    # of two rows that both lack it, one order is enough
    for some, other, key, lacks in ((known.filter("platform is null"), known, "jurisdiction", "platform"), (loose, rows, "any", "jurisdiction")):
        met = meet(some, other, key).filter((F.col(f"b.{lacks}").isNotNull() & (F.col("a.pos") != F.col("b.pos"))) | first)
        pairs = pairs.union(met.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b")))
    # all pairs pass this filter, so it has no array functions
    pairs = pairs.filter(ordered & (x * bound("claim") + y * bound("title") + F.when(filled, z).otherwise(0.0) >= threshold - 1e-9)).withColumn("g", goods)
    # where the claims are the titles, what bounds the one bounds the other; else the title's bound follows the claim's
    same = (F.col("a.claim") == F.col("a.title")) & (F.col("b.claim") == F.col("b.title"))
    texts = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("a", "b") for c in ("pos", "claim")]
    titles = [F.when(~same, F.col(f"{s}.title")).alias(f"{s}_title") for s in ("a", "b")]
    near = pairs.select(*texts, *titles, "g", same.alias("same"), bound("title").alias("titles"))
    g, same, zero = F.col("g"), F.col("same"), F.lit(0.0)
    reach = lambda claim: x * F.coalesce(claim, zero) + y * F.coalesce(F.when(same, claim).otherwise(F.col("titles")), zero) + z * g >= threshold - 1e-9
    near = near.withColumn("claims", udfs.seq_bound("a_claim", "b_claim", F.when(same, (threshold - z * g) / (x + y)).otherwise((threshold - y * F.col("titles") - z * g) / x)))
    near = near.filter(reach(F.col("claims"))).withColumn("titles", udfs.seq_bound("a_title", "b_title", (threshold - x * F.coalesce("claims", zero) - z * g) / y))
    near = written_small(near.filter(reach(F.col("claims"))).drop("claims"))
    near = spread(near, "a_pos", "b_pos").withColumn("c", udfs.seq_ratio("a_claim", "b_claim"))
    near = near.filter(reach(F.col("c"))).withColumn("t", udfs.seq_ratio("a_title", "b_title"))
    c, t = F.coalesce("c", zero), F.coalesce(F.when(same, F.col("c")).otherwise(F.col("t")), zero)
    by_text = near.select(F.col("a_pos").alias("a"), F.col("b_pos").alias("b"), (x * c + y * t + z * g).alias("similarity"))
    return by_url.union(by_id).union(by_text).filter(F.col("similarity") >= threshold).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def cluster(leads: DataFrame, threshold: float = K.CLUSTER_THRESHOLD) -> DataFrame:
    """pos and cluster (its smallest pos)."""
    if not 0 < threshold <= 1:
        raise ValueError("cluster threshold must be greater than 0 and at most 1")
    nodes = leads.select(F.col("pos").alias("node"), text.known_scope(F.col("jurisdiction")).alias("jurisdiction"), text.known_scope(F.col("platform")).alias("platform"))
    return constrained(nodes, lead_links(leads, threshold)).select(F.col("node").alias("pos"), "cluster")


def prioritize(leads: DataFrame, cutoff: str, regions: Sequence[str] = (), platforms: Sequence[str] = (), products: Sequence[str] = (), minimum: int = K.MINIMUM_PRIORITY, threshold: float = K.CLUSTER_THRESHOLD) -> DataFrame:
    """A row a cluster in order of priority; ``qualified`` marks those from ``minimum`` up, ``weak_signal`` the first if none is."""
    array = lambda xs, f: F.array(*[f(F.lit(x)) for x in xs]).cast("array<string>")
    leads = written(leads)  # scores, nodes and each kind of links read them
    at = timing.instant(F.lit(cutoff))
    asked, goods = array(products, F.lower), F.transform(F.concat("products", "hs_codes"), F.lower)
    region = F.lit(not regions) | F.array_contains(array(regions, text.canonical_scope), text.canonical_scope(F.col("jurisdiction")))
    platform = text.nonblank(F.col("platform")) & (F.lit(not platforms) | F.array_contains(array(platforms, text.canonical_scope), text.canonical_scope(F.col("platform"))))
    rows = leads.join(cluster(leads, threshold), "pos").select(
        "*",
        score.recency(timing.instant(F.col("published_at")), at).alias("recency"),
        score.relevance(region, platform, F.arrays_overlap(goods, asked), F.lit(not products)).alias("relevance"),
        score.tier_weight(F.col("source_tier")).alias("tier"),
    )
    # of equal leads the first by lead_id stands for the cluster
    best = Window.partitionBy("cluster").orderBy(F.desc("tier"), F.desc("recency"), F.desc("momentum_score"), "lead_id")
    rows = rows.withColumn("place", F.row_number().over(best))
    only = lambda c: F.max(F.when(F.col("place") == 1, F.col(c))).alias(c)
    ordered = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("lead_id", c))), lambda x: x[c]))).alias(c)
    out = rows.groupBy("cluster").agg(
        only("source_title"), only("claim"), only("jurisdiction"), only("platform"), ordered("products"), ordered("hs_codes"),
        F.max("recency").alias("recency"), F.max("relevance").alias("business_relevance"), F.max("tier").alias("source_quality"), F.max("momentum_score").alias("momentum"),
        F.countDistinct(text.authority(F.col("source_url"))).alias("domains"), F.array_sort(F.collect_list("lead_id")).alias("lead_ids"),
    )
    out = out.withColumn("corroboration", score.corroboration(F.col("domains"))).withColumn("cluster_id", ids.cluster_id(F.col("lead_ids")))
    out = out.withColumn("priority_score", F.col("recency") + F.col("corroboration") + F.col("business_relevance") + F.col("source_quality") + F.col("momentum"))
    out = placed(out.withColumn("qualified", F.col("priority_score") >= minimum), F.desc("priority_score"), F.desc("domains"), F.col("cluster_id"), name="rank")
    # the first by priority is unqualified only if none is qualified
    none = ~F.col("qualified")
    queries = F.array_distinct(F.filter(F.array(F.concat_ws(" ", "source_title", "jurisdiction"), F.concat_ws(" ", "claim", F.lit("official source")), F.concat_ws(" ", "platform", "source_title")), text.nonblank))
    return out.withColumn("weak_signal", none & (F.col("rank") == 1)).withColumn("verification_queries", queries).withColumn("event_status", F.lit("unconfirmed")).withColumn("risk_level", F.lit("watch")).orderBy("rank")


def _ladder(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rungs of pairs of classes (x, y, decision, confidence), x before y, and class and pos of each event.

    Events that are alike in all that is compared are one class; a class meets itself, and two classes meet both ways, as
    similarity depends on the order.
    """
    rows = events.select(
        "pos",
        F.when(text.nonblank(F.col("source_url")), text.canonical_url(F.col("source_url"))).alias("url"),
        text.normalized(F.col("authority")).alias("authority"),
        text.normalized(F.col("published_date")).alias("published"),
        text.normalized(F.col("effective_date")).alias("effective"),
        text.compact(F.col("title")).alias("title"),
        text.identifiers(F.concat_ws(" ", "title", "summary", "source_title")).alias("identifiers"),
        text.number_anchors(F.concat_ws(" ", "title", "source_title")).alias("anchors"),
    )
    same = [c for c in rows.columns if c != "pos"]
    rows = written(rows.withColumn("class", F.sha2(F.to_json(F.struct(*same), {"ignoreNullFields": "false"}), 256)))
    own, rows = rows.select("class", "pos"), written(rows.groupBy("class").agg(*[F.first(c).alias(c) for c in same]))
    keys = F.array_union(
        F.array_union(F.transform("identifiers", lambda x: F.concat(F.lit("i:"), x)), F.when(F.col("url").isNotNull(), F.array(F.concat(F.lit("u:"), "url"))).otherwise(F.array().cast("array<string>"))),
        F.when(F.col("published") != "", F.transform("anchors", lambda x: F.concat(F.lit("d:"), F.col("published"), F.lit(":"), x))).otherwise(F.array().cast("array<string>")),
    )
    keyed = rows.withColumn("key", F.explode(keys))
    pairs = keyed.alias("a").join(keyed.alias("b"), F.col("a.key") == F.col("b.key")).select(F.col("a.class").alias("x"), F.col("b.class").alias("y")).distinct()
    pairs = pairs.join(rows.alias("a"), F.col("x") == F.col("a.class")).join(rows.alias("b"), F.col("y") == F.col("b.class"))
    filled = lambda n: (F.col(f"a.{n}") != "") & (F.col(f"a.{n}") == F.col(f"b.{n}"))
    pairs = spread(pairs, "x", "y").withColumn("t", F.coalesce(udfs.seq_ratio("a.title", "b.title"), F.lit(0.0))).withColumn("s", udfs.seq_ratio("a.authority", "b.authority"))
    authority = F.coalesce(filled("authority") | (F.col("s") >= 0.9), F.lit(False))
    url = F.coalesce(F.col("a.url") == F.col("b.url"), F.lit(False))
    shared, anchor = F.arrays_overlap("a.identifiers", "b.identifiers"), F.arrays_overlap("a.anchors", "b.anchors")
    dated = authority & filled("published") & anchor
    t = F.col("t")
    sure, ask = F.lit("automatic_duplicate"), F.lit("review_required")
    rung = lambda d, c: F.struct(d.alias("decision"), F.round(c, 3).alias("confidence"))
    ladder = (
        F.when(authority & shared, rung(sure, F.lit(0.98)))
        .when(url & authority & filled("published"), rung(sure, F.lit(0.97)))
        .when(url & authority & filled("effective") & anchor & (t >= K.AUTO_URL_TITLE), rung(sure, F.lit(0.94)))
        .when(dated & (t >= K.AUTO_TITLE), rung(sure, F.least(F.lit(0.96), 0.70 + t / 2)))
        .when(url, rung(ask, F.lit(0.75)))
        .when(dated & (t >= K.REVIEW_TITLE), rung(ask, F.least(F.lit(0.89), 0.55 + t / 2)))
    )
    return written(pairs.withColumn("r", ladder).filter("r is not null").select("x", "y", "r.decision", "r.confidence")), own


def semantic_links(events: DataFrame) -> DataFrame:
    """a < b, decision and confidence of labelled events that mean one event, by a ladder of six rules.

    Events: pos, title, source_title, summary, authority, source_url, published_date, effective_date. Every rule needs an
    equal URL or a common identifier or an equal publication date with a common number, so pairs meet by those keys. Rules
    are judged once for events that are alike in all of these. Classes then meet in lists of their events, and the pairs of
    two lists are formed as they are read, so that no pair is shuffled.
    """
    rungs, own = _ladder(events)
    lists = listed(own, "class", F.struct(F.col("x.pos").alias("pos"), F.array_min("x.pos").alias("least"), F.array_max("x.pos").alias("most")))
    side = lambda c, name: lists.select(F.col("class").alias(c), F.col("part").alias(f"{name}n"), F.col("lists").alias(name))
    met = unrolled(rungs.join(side("x", "p"), "x").join(side("y", "q"), "y"), "p", "q", "x", "pn", "y", "qn").filter("p.least < q.most")
    near = apart(met.select(F.explode("p.pos").alias("a"), F.col("q.pos").alias("bs"), "decision", "confidence"))
    return near.select("a", F.explode("bs").alias("b"), "decision", "confidence").filter("a < b")


def semantic_edges(events: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what automatic duplicates connect, a few an event and a pair of classes.

    The events of a class that is a duplicate of itself, or of another class both ways, are all connected, so each has an
    edge to the class's first, and classes have one between these. Of two classes that are duplicates one way alone, only
    events before the other's last and after the other's first are, and these two are among them.
    """
    rungs, own = _ladder(events)
    sure = rungs.filter("decision = 'automatic_duplicate'").select("x", "y")
    back = sure.select(F.col("y").alias("x"), F.col("x").alias("y"))
    both, oneway = written(sure.join(back, ["x", "y"], "left_semi")), written(sure.join(back, ["x", "y"], "left_anti"))
    ends = written(own.groupBy("class").agg(F.min("pos").alias("least"), F.max("pos").alias("most")))
    of = lambda side: ends.select(F.col("class").alias(side), F.col("least").alias(f"first_{side}"), F.col("most").alias(f"last_{side}"))
    inside = own.join(both.select(F.col("x").alias("class")).distinct(), "class").join(ends, "class").filter("pos <> least").select(F.col("least").alias("a"), F.col("pos").alias("b"))
    between = both.filter("x < y").join(of("x"), "x").join(of("y"), "y").select(F.least("first_x", "first_y").alias("a"), F.greatest("first_x", "first_y").alias("b"))
    apart = oneway.join(of("x"), "x").join(of("y"), "y").filter("first_x < last_y").select("x", "y", "first_x", "last_y")
    before = apart.join(own.withColumnRenamed("class", "x"), "x").filter("pos < last_y").select(F.col("pos").alias("a"), F.col("last_y").alias("b"))
    after = apart.join(own.withColumnRenamed("class", "y"), "y").filter("pos > first_x").select(F.col("first_x").alias("a"), F.col("pos").alias("b"))
    return inside.union(between).union(before).union(after).distinct()


def semantic_clusters(events: DataFrame) -> DataFrame:
    """pos and canonical (the smallest pos that automatic duplicates lead to)."""
    return components(events.select(F.col("pos").alias("node")), semantic_edges(events)).select(F.col("node").alias("pos"), F.col("component").alias("canonical"))
