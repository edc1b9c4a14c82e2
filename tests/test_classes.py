"""Work on classes of equal rows against the same work row by row."""

import difflib
import json
import random

from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.operators import applicability, common, discovery, validation
from auditlake.sources import feeds


def test_items_are_counted_by_classes(spark, monkeypatch):
    """Counts of items equal those of the formed pairs, which are not formed for them."""
    rng = random.Random(3)
    some = lambda *xs: rng.sample(xs, rng.randrange(len(xs)))
    events = [(n, rng.choice(["US", "united states", "China", ""]), rng.choice(["acme", ""]), rng.choice(["HS code 8471.30", "HS 9503", "steel beams", ""]), rng.choice(["toys for kids", "Steel"]), some("8471", "95031", "73")) for n in range(80)]
    events += [(80 + n, j, "", "", "none", []) for n, j in enumerate(("US", "China", "Mars"))]
    items = [(f"s{n}", rng.choice(["Steel", "kids", "ab", "lamp"]), rng.choice([["usa"], ["China", "EU"], ["United States", "us"]]), some("Acme", "Other"), some("84", "847130", "9503", "73"), some("toys", "steel", "BEAMS")) for n in range(60)]
    e = spark.createDataFrame(events, "event_id long, jurisdiction string, platform string, title string, summary string, hs_codes array<string>")
    e = e.selectExpr("*", "'' as impact", "cast(null as string) as rationale", "cast(array() as array<string>) as products")
    i = spark.createDataFrame(items, "sku string, name string, markets array<string>, platforms array<string>, hs_codes array<string>, keywords array<string>")
    has = lambda c: F.size(F.filter("items", lambda x: F.size(x[c]) > 0))
    expected = applicability.statuses(e, i).join(applicability.scope_counts(e, i), "event_id").select("event_id", "in_scope", has("matched_hs_codes"), has("matched_terms"), F.size("items"), "status")
    expected = sorted(map(tuple, expected.collect()))
    monkeypatch.delattr(applicability, "match")
    got = applicability.counts(e, i).select("event_id", "in_scope", "by_hs", "by_term", "matched", applicability.status_of(F.col("matched"), F.col("in_scope")))
    assert sorted(map(tuple, got.collect())) == expected and len({r[5] for r in expected}) == 3


def test_ladder_by_classes(spark, monkeypatch):
    """Canonical events need no pair of copies, and are what the links of all pairs lead to; similarity is judged one time a pair of classes."""
    rng = random.Random(4)
    kinds = "pos long, title string, source_title string, summary string, authority string, source_url string, published_date string, effective_date string"
    # the first two titles are alike enough in one order alone
    titles = ("abcdefgh xyz", "xyz abcdefgh", "qqqq", "qqqq rr")
    rows = [(n, rng.choice(titles), f"No {rng.randrange(50, 54)}", "", rng.choice(("aaaa", "bbbb")), f"https://x.org/{rng.randrange(6)}", f"2026-07-0{rng.randrange(1, 4)}", "2026-08-01") for n in range(120)]
    events = spark.createDataFrame(rows, kinds)
    links = discovery.semantic_links(events).collect()
    low = {n: n for n in range(120)}
    for _ in range(120):
        for r in links:
            if r.decision == "automatic_duplicate":
                low[r.a] = low[r.b] = min(low[r.a], low[r.b])
    monkeypatch.delattr(discovery, "semantic_links")
    assert {r.pos: r.canonical for r in discovery.semantic_clusters(events).collect()} == low and len(set(low.values())) > 1
    copies = spark.range(3000).selectExpr("id as pos", "'t' as title", "'No 50' as source_title", "'' as summary", "'a' as authority", "'https://x.org/' as source_url", "'2026-07-01' as published_date", "'' as effective_date")
    assert discovery.semantic_edges(copies).count() == 2999


def test_ladder_one_way(spark, monkeypatch):
    """Classes that are duplicates in one order alone: an event is linked to those of the other class after it."""
    own = spark.createDataFrame([("x", 5), ("x", 1), ("x", 9), ("y", 4), ("y", 0), ("y", 7)], "class string, pos long")
    rungs = spark.createDataFrame([("x", "y", "automatic_duplicate", 0.9)], "x string, y string, decision string, confidence double")
    monkeypatch.setattr(discovery, "_ladder", lambda events: (rungs, own))
    nodes = own.select("pos")
    assert {r.pos: r.canonical for r in discovery.semantic_clusters(nodes).collect()} == {0: 0, 1: 1, 4: 1, 5: 1, 7: 1, 9: 9}


def test_equal_reports_are_judged_once(spark, monkeypatch):
    """Copies of a report are found to break what each would; rows that share a name are still judged together."""
    broken = json.dumps({"report_date": "2026-02-30", "events": [{"id": "a"}, {"id": "a"}]})
    rows = [(f"r{n}", broken if n % 2 else "nothing") for n in range(40)] + [("twice", broken), ("twice", broken), ("empty", None)]
    reports = spark.createDataFrame(rows, "report string, raw string")
    judged, seen = validation._judged, []
    listed = lambda found: sorted(map(tuple, found.collect()))
    expected = listed(judged(reports, None))
    monkeypatch.setattr(validation, "_judged", lambda some, aliases: seen.append(some.count()) or judged(some, aliases))
    assert listed(validation.violations(reports)) == expected and seen == [5]


def test_refused_contents_stay_out_of_the_parser(spark, monkeypatch):
    """What is too large is told from its size; the parser's rows, which are kept beside it, are the small ones alone."""
    monkeypatch.setattr(K, "XML_LIMIT", 60)
    texts = [(0, "<broken"), (1, "x" * 61), (2, None), (3, "<urlset><url><loc>u</loc></url></urlset>")]
    rows = spark.createDataFrame(texts, "id int, content string")
    told = feeds.refused(rows)
    assert {(r.id, r.reason) for r in told.collect()} == {(0, "not_a_feed"), (1, "too_large"), (2, "missing")}
    plan = told._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [plan[n + 1] for n, line in enumerate(plan) if "ArrowEvalPython" in line]
    assert len(below) == 1 and "Filter" in below[0] and "octet_length" in below[0]


def test_leads_meet_by_both_scopes(spark, monkeypatch):
    """Links of leads with and without scopes as pair by pair; leads without texts or goods meet none."""
    rng = random.Random(6)
    scope = lambda *xs: rng.choice(xs)
    rows = [(n, scope("steel duty", "steel duties", "toy ban", ""), f"https://x.org/{n}", scope("us", "china", None), scope("acme", "other", None), scope([], ["p"], ["q"]), scope("duty on steel is up", "duty on steel", "toys are out", "")) for n in range(50)]
    rows += [(50 + n, "", f"https://x.org/{50 + n}", "us", "acme", [], "") for n in range(50)]
    leads = spark.createDataFrame(rows, "pos long, source_title string, source_url string, jurisdiction string, platform string, products array<string>, claim string").withColumn("hs_codes", F.array().cast("array<string>"))
    x, y, z = K.LEAD_WEIGHTS
    alike = lambda p, q: difflib.SequenceMatcher(None, p, q).ratio() if p and q else 0.0
    expected = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and not any(a[n] and b[n] and a[n] != b[n] for n in (3, 4)):
                if x * alike(a[6], b[6]) + y * alike(a[1], b[1]) + z * (bool(a[5]) and a[5] == b[5]) >= K.CLUSTER_THRESHOLD:
                    expected.add((a[0], b[0]))
    met, meet = [], discovery.meet
    monkeypatch.setattr(discovery, "meet", lambda a, b, key: met.append((key, b.filter("pos >= 50").count())) or meet(a, b, key))
    assert {(r.a, r.b) for r in discovery.lead_links(leads).collect()} == expected and expected
    assert met == [("scope", 0), ("jurisdiction", 0), ("any", 0)]


def test_pairs_of_classes_pass_no_join_event_by_event(spark, monkeypatch):
    """Links of copies come from lists: what is shuffled last are rows of lists, and pairs are those of a plain loop."""
    shape = "pos long, title string, source_title string, summary string, authority string, source_url string, published_date string, effective_date string"
    rows = [(n, "t" * 9, "", "", "Council", f"https://a.eu/{n % 2}", "2026-07-01", "") for n in range(9000)]
    links = discovery.semantic_links(spark.createDataFrame(rows, shape))
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join") and plan.index("RepartitionByExpression") < plan.index("Join")
    assert links.count() == 2 * 4500 * 4499 // 2
    few = rows[:300] + [(n, "t" * 9, "", "", "Court", "https://a.eu/1", "", "") for n in range(300, 310)]
    monkeypatch.setattr(common, "LIST", 7)
    got = sorted(tuple(r) for r in discovery.semantic_links(spark.createDataFrame(few, shape)).select("a", "b", "decision").collect())
    sure = lambda x, y: x[4] == y[4] == "Council"
    assert got == sorted((x[0], y[0], "automatic_duplicate" if sure(x, y) else "review_required") for x in few for y in few if x[0] < y[0] and x[5] == y[5])
