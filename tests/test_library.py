"""The library's own operators: parity cases, brute force, files, streams, and every query against its SQL."""

import difflib
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from auditlake import more_workloads, constants as K  # noqa: F401
from auditlake import workloads
from auditlake.functions import score, text, timing, udfs
from auditlake.operators import acquisition, applicability, calibration, discovery, graph, language, library, linkage, planning, snapshots, validation, worksheet
from auditlake.plans import files, report
from auditlake.sources import feeds, reports

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "column, want",
    [
        (lambda: text.normalized(F.lit("  Über-Maß_9, x! ")), "über maß_9 x"),
        (lambda: text.canonical_scope(F.lit("U.S.")), "united states"),
        (lambda: text.known_scope(F.lit("N/A")), "n a"),
        (lambda: text.known_scope(F.lit("Global")), None),
        (lambda: text.canonical_url(F.lit("HTTPS://A.org/x/?b=2&a=1&utm_x=1&ref=q#f")), "https://a.org/x?a=1&b=2"),
        (lambda: text.canonical_url(F.lit("http://A.org")), "http://a.org/"),
        (lambda: text.canonical_url(F.lit("not a URL")), "not a url"),
        (lambda: text.canonical_url(F.lit("https://a.org/x/"), strip_slash=False), "https://a.org/x/"),
        (lambda: text.identifiers(F.lit("Regulation No. 2026/100 and Notice 12a; 公告第2026年5号")), ["notice 12a", "regulation no 2026 100", "公告第2026年5号"]),
        (lambda: text.facts(F.lit("By 2026-07-01 pay 10 % or 12.5%")), ["10%", "12.5%", "2026-07-01"]),
        (lambda: text.obligations(F.lit("Sellers MUST not; prohibited")), ["must", "prohibit", "prohibited"]),
        (lambda: text.number_anchors(F.lit("The 24th package of 2026, 007 and 24")), ["24", "7"]),
        (lambda: text.hs_codes(F.array(F.lit("8517.62"), F.lit("x")), F.lit("see HS code 8517 62 00")), ["851762", "85176200"]),
        (lambda: text.content_lines(F.lit(" a  b \n\n\tc\r\nd")), "a b\nc\nd"),
        (lambda: score.level_for_score(F.lit(5)), "medium"),
        (lambda: score.f1(F.lit(0.0), F.lit(0.0)), 0.0),
        (lambda: score.ratio(F.lit(1), F.lit(0)), None),
        (lambda: timing.valid_instant(F.lit("2026-07-01T00:00:00")), False),
        (lambda: timing.valid_instant(F.lit("2026-07-01T00:00:00+08:00")), True),
        (lambda: timing.valid_date(F.lit("2026-02-30")), False),
    ],
)
def test_functions(spark, column, want):
    assert one(spark, column()) == want


def test_python_functions(spark):
    rows = spark.createDataFrame([("Straße ẞ", "tide", "diet"), (None, "", "x")], "a string, b string, c string")
    got = rows.select(udfs.casefold("a").alias("a"), udfs.seq_ratio("b", "c").alias("r"), udfs.seq_ratio("c", "b").alias("s")).collect()
    assert got[0].a == "strasse ss" and (got[0].r, got[0].s) == (0.25, 0.5) and got[1].r is None
    assert udfs.clean_url("https://A.org/ä?b=%41&a=") == "https://a.org/ä?a=&b=A"
    assert one(spark, udfs.canonical_json(F.lit('{"b":[1,{"d":1,"c":2}],"a":null}'))) == '{"a":null,"b":[1,{"c":2,"d":1}]}'
    assert udfs.line_diff("a\nb", "a\nc\nd")[0] == "lines added: 2, removed: 1: + c | + d | - b"
    assert udfs.feed_entries("<rss><channel><item><link>u</link></item><item><title>t</title></item></channel></rss>") == [{"title": "u", "url": "u", "published_at": None, "summary": None}]
    assert udfs.feed_entries("<urlset><url><loc>u</loc><lastmod>d</lastmod></url></urlset>")[0]["published_at"] == "d"
    assert udfs.feed_entries("<broken") is None and udfs.feed_entries("<other/>") is None


EVENT = "pos long, id string, title string, summary string, source_title string, authority string, jurisdiction string, products array<string>, source_url string, status string, published_date string, effective_date string, deadline string"


def event(pos, id="", title="New import duty on widgets", summary="Duty of 10% applies", authority="Customs", jurisdiction="EU", products=("widgets",), url="https://c.eu/a", status="new", effective=None):
    return (pos, id, title, summary, "", authority, jurisdiction, list(products), url, status, None, effective, None)


def weight(a, b):
    """The weighted mean by hand, for events without identifiers and policies."""
    if a[6] != b[6]:
        return 0.0
    norm = lambda x: " ".join(x.lower().split())
    ratio = lambda x, y: difflib.SequenceMatcher(None, norm(x), norm(y)).ratio() if x and y else None
    p, q = set(a[7]), set(b[7])
    parts = [(0.30, ratio(a[2], b[2])), (0.12, ratio(a[5], b[5])), (0.10, 1.0), (0.12, len(p & q) / len(p | q) if p | q else None), (0.14, float(a[8] == b[8]))]
    return sum(w * v for w, v in parts if v is not None) / sum(w for w, v in parts if v is not None)


def test_pairs_and_matching(spark):
    rng = random.Random(3)
    words = "duty import widget label safety fee notice product market rule".split()
    make = lambda n: event(n, title=" ".join(rng.choices(words, k=4)), products=rng.sample(words, 2), url=f"https://c.eu/{rng.randrange(3)}", jurisdiction=rng.choice(["EU", "China"]))
    current, previous = [make(n) for n in range(25)], [make(n) for n in range(25)]
    pairs = linkage.score_pairs(spark.createDataFrame(current, EVENT), spark.createDataFrame(previous, EVENT)).cache()
    want = {(a[0], b[0]): weight(a, b) for a in current for b in previous if weight(a, b) >= 0.65}
    got = {(r.ci, r.pi): r.score for r in pairs.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    used, greedy = (set(), set()), set()
    for (c, p), s in sorted(got.items(), key=lambda x: (-x[1], x[0])):
        if c not in used[0] and p not in used[1]:
            greedy.add((c, p))
            used[0].add(c)
            used[1].add(p)
    assert {(r.ci, r.pi) for r in linkage.match_one_to_one(pairs).collect()} == greedy


def test_deduplicate(spark):
    old = [event(0, "a"), event(1, "b", title="Label rule for toys", url="https://c.eu/b"), event(2, "c", title="Port fees rise", url="https://c.eu/c", effective="2026-07-02"), event(3, "e", title="Quota", jurisdiction="US")]
    new = [event(0, "a"), event(1, "b", title="Label rule for toys", url="https://c.eu/b", summary="Duty of 12.5% applies"), event(2, "c", title="Port fees rise", url="https://c.eu/c", effective="2026-07-02"), event(3, "z", title="Something else entirely", url="https://q.eu/", authority="Ministry", products=("x",))]
    kept, matches = linkage.deduplicate(spark.createDataFrame(new, EVENT), spark.createDataFrame(old, EVENT), "2026-07-02", "2026-07-01")
    assert {r.current_id: (r.disposition, r.change_reasons) for r in matches.collect()} == {"a": ("duplicate_removed", []), "b": ("material_update", ["summary_facts_or_obligation"]), "c": ("operational_refresh", ["effective_date_reached"])}
    assert [r.id for r in kept.collect()] == ["b", "c", "z"]
    with pytest.raises(ValueError):
        linkage.deduplicate(None, None, None, None, threshold=0.5, review=0.6)


def test_constrained_clusters(spark):
    nodes = spark.createDataFrame([(0, "eu", None), (1, None, None), (2, "us", None), (3, None, None)], "node long, jurisdiction string, platform string")
    forward = graph.constrained(nodes, spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")).collect()
    assert {r.node: r.cluster for r in forward} == {0: 0, 1: 0, 2: 2, 3: 3}
    chain = graph.components(spark.range(40).select(F.col("id").alias("node")), spark.range(39).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert {r.component for r in chain.collect()} == {0}


def test_discovery(spark):
    shape = "pos long, lead_id string, source_title string, source_url string, source_tier string, published_at string, jurisdiction string, platform string, products array<string>, hs_codes array<string>, claim string, momentum_score int"
    at = "2026-07-20T12:00:00+00:00"
    rows = [
        (0, "l0", "Port strike", "https://a.org/1", "trade_media", at, "EU", None, ["steel"], [], "A strike closes the port of X", 2),
        (1, "l1", "Port strike", "https://b.org/2", "official_lead", at, "EU", None, ["steel"], [], "A strike closes the port of X", 1),
        (2, "l2", "Port strike", "https://c.org/3", "other", at, "US", None, ["steel"], [], "A strike closes the port of X", 0),
    ]
    got = discovery.prioritize(spark.createDataFrame(rows, shape), "2026-07-21T00:00:00+00:00", regions=["EU"], products=["steel"]).collect()
    assert [(r.lead_ids, r.priority_score, r.qualified) for r in got] == [(["l0", "l1"], 25 + 15 + 14 + 20 + 2, True), (["l2"], 25 + 0 + 6 + 3 + 0, False)]


def test_semantic_ladder(spark):
    shape = "pos long, title string, source_title string, summary string, authority string, source_url string, published_date string, effective_date string"
    rows = [(0, "24th package of sanctions", "", "", "Council", "https://a.eu/1", "2026-07-01", ""), (1, "The 24th package of sanctions", "", "", "Council", "https://a.eu/2", "2026-07-01", ""), (2, "Other", "", "", "Court", "https://a.eu/2", "", ""), (3, "Alone", "", "", "Council", "", "2026-07-01", "")]
    links = {(r.a, r.b): r.decision for r in discovery.semantic_links(spark.createDataFrame(rows, shape)).collect()}
    assert links == {(0, 1): "automatic_duplicate", (1, 2): "review_required"}
    assert {r.pos: r.canonical for r in discovery.semantic_clusters(spark.createDataFrame(rows, shape)).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_calibration(spark):
    scores, levels = [0, 1, 0, 1, 1, 2, 3, 4, 2, 4, 5, 6, 7, 5, 7, 8, 9, 10, 8, 10], ["watch"] * 5 + ["low"] * 5 + ["medium"] * 5 + ["high"] * 5
    rows = [(f"e{n}", "r1", level, s) for n, (s, level) in enumerate(zip(scores, levels))] + [("e0", "r2", "watch", 0), ("t", "r1", "low", 3), ("t", "r2", "high", 3)]
    events = calibration.consensus(spark.createDataFrame(rows, "event_id string, reviewer string, level string, score int"))
    assert events.filter("level is null").count() == 1
    best = calibration.grid_search(calibration.histogram(events))
    assert best.count() == 120 and best.filter("rank = 1").first()[:3] == K.THRESHOLDS
    gate = calibration.sample_gate(events).first()
    assert gate.sufficient and calibration.status(best, True) == "current_rules_supported" and calibration.status(best, False) == "insufficient_data"


def report_json(**changes):
    e = {
        "id": "a", "title": "t", "status": "new", "level": "low", "score": 3, "score_breakdown": dict(zip(K.BREAKDOWN, (1, 1, 0, 0, 1))), "jurisdiction": "EU", "authority": "x", "published_date": None,
        "effective_date": None, "deadline": None, "products_or_channels": ["w"], "summary": "s", "impact": "i", "action": "a", "rationale": "r", "source_title": "st", "source_url": "https://x.org/", "retrieved_date": "2026-07-01",
    }
    root = {"report_date": "2026-07-01", "timezone": "UTC", "cutoff": "2026-07-01T00:00:00+00:00", "language": "en", "scope": ["EU"], "coverage_gaps": [], "events": [e | changes.pop("event", {})]}
    out = root | changes
    for k in [k for k, v in out.items() if v == "DROP"]:
        del out[k]
    for ev in out["events"] if isinstance(out["events"], list) else []:
        for k in [k for k, v in ev.items() if v == "DROP"]:
            del ev[k]
    return json.dumps(out)


@pytest.mark.parametrize("n", [0])
def test_validation(spark, n):
    ledger = {"platform": "P", "seller_market": "m", "program": "p", "lookback_start": "2026-06-28T00:00:00+00:00", "public_update_checked": True, "current_policy_checked": False, "dashboard_checked": False, "access_result": "blocked", "checked_at": "2026-07-01T00:00:00+00:00", "sources_checked": [], "verified_event_ids": ["q"], "gaps": []}
    cases = {
        "good": (report_json(), set()),
        "text": ("nonsense", {"root"}),
        "root": (report_json(report_date="20260701x", cutoff="DROP", scope="EU"), {"report_date", "cutoff", "scope"}),
        "types": (report_json(event={"score": True, "title": 1, "summary": "DROP"}), {"events[0].score", "events[0].title", "events[0].summary"}),
        "sum": (report_json(event={"score": 4}), {"events[0].score"}),
        "level": (report_json(event={"level": "high"}), {"events[0].level"}),
        "override": (report_json(event={"level": "high", "level_override": {"level": "high", "reason": "because"}}), set()),
        "redundant": (report_json(event={"level_override": {"level": "low", "reason": "because"}}), {"events[0].level_override"}),
        "unconfirmed": (report_json(event={"status": "unconfirmed"}), {"events[0].level"}),
        "policy": (report_json(event={"platform_policy": {}}), {"events[0].platform_policy", *(f"events[0].platform_policy.{k}" for k in validation.POLICY)}),
        "ledger": (report_json(coverage_ledger=[ledger]), {"coverage_ledger[0].lookback_start", "coverage_ledger[0].sources_checked", "coverage_ledger[0].access_result", "coverage_ledger[0].public_update_checked", "coverage_ledger[0].verified_event_ids[0]"}),
    }
    found = validation.violations(spark.createDataFrame([(k, v) for k, (v, _) in cases.items()], "report string, raw string")).collect()
    got = {k: {r.location for r in found if r.report == k} for k in cases}
    assert got == {k: want for k, (_, want) in cases.items()}


def test_snapshots(spark):
    rows = [("P", "https://a.org/x/", c, t) for c, t in (("Hello  world\n", "2026-07-01 00:00:00"), ("Hello world", "2026-07-02 00:00:00"), ("Hello there", "2026-07-03 00:00:00"), ("Hello there", "2026-07-03 00:00:00"), (" ", "2026-07-04 00:00:00"))]
    captures = spark.createDataFrame(rows, "platform string, url string, content string, t string").withColumn("captured_at", F.to_timestamp("t"))
    got = sorted((r.captured_at, r.change_status, r.diff_summary) for r in snapshots.with_diffs(captures).collect())
    assert [g[1] for g in got] == ["first_seen", "unchanged", "changed"] and "added: 1, removed: 1" in got[2][2]
    assert snapshots.audit(snapshots.chain(snapshots.hashed(captures))).count() == 0


def test_acquisition(spark):
    shape = "platform string, route_id string, source_type string, url string, markets array<string>, access string, verification_status string, last_verified_on string, verify_before_use boolean"
    routes = spark.createDataFrame([("P", "1", "official_updates", "https://p/1", ["*"], "public", "verified", "2026-07-01", None), ("P", "2", "dashboard", "https://p/2", ["de"], "login", "conditional", None, None)], shape)
    tasks = acquisition.tasks(routes, "US", "all", "2026-06-01T00:00:00+00:00").cache()
    assert [(r.source_type, r.requires_auth, r.route_verification_required) for r in tasks.collect()] == [("dashboard", True, True), ("official_updates", False, False)]
    first = tasks.filter("source_type = 'official_updates'").first().task_id
    shape = "task_id string, pos int, result string, retrieval_method string, checked_at string, route_verified boolean, snapshot string, final_url string, error_type string, http_status int"
    receipts = spark.createDataFrame([(first, 0, "blocked", "http", "2026-07-01T00:00:00+00:00", True, None, "u", None, None), (first, 1, "no_relevant_update", "http", "2026-07-01T02:00:00+02:00", True, "s", "u", None, 200), (first, 2, "no_relevant_update", "http", "2026-07-01T01:00:00+00:00", True, None, "u", None, 200)], shape)
    row = acquisition.coverage(tasks, receipts, "2026-07-02T00:00:00+00:00").first()
    assert (row.access_result, row.public_update_checked, row.dashboard_checked, len(row.gaps)) == ("public_checked", True, False, 2)
    rows = acquisition.health(tasks, receipts)
    assert {r.source_type: r.audit_state for r in rows.collect()} == {"dashboard": "not_checked", "official_updates": "partial"}
    assert acquisition.health_summary(rows).first().overall == "incomplete"
    board = acquisition.dashboard(routes, rows).first()
    assert (board.depth, board.priority) == ("hybrid", 40 + 20 + 10)
    assert "<td>P</td>" in report.dashboard_html(acquisition.dashboard(routes, rows)) and "| P | hybrid |" in report.dashboard_markdown(acquisition.dashboard(routes, rows))


def test_planning_and_search(spark):
    tracks = planning.plan(spark, "2026-07-21T00:00:00+00:00", platforms=["A", "B", "A"], hs_codes=["8517"])
    assert [r.kind for r in tracks.collect()] == ["official_updates", "effective_deadlines", "logistics_chokepoints", "product_scope", "marketplace_policy", "marketplace_policy", "discovery_leads"]
    assert planning.invariants(tracks, ["A", "B"]).collect() == [] and len(planning.invariants(tracks, ["A"]).collect()) == 1
    seen = spark.createDataFrame([("r1", "a", "2026-07-01", "c1", "Steel duty"), ("r2", "a", "2026-07-02", "c2", "Steel duty"), ("r2", "b", "2026-07-02", "c2", "Old steelworks")], "report_key string, event_id string, report_date string, cutoff string, title string")
    got = library.search(seen, "steel").collect()
    assert [(r.event_id, r.sighting_count, r.first_seen) for r in got] == [("b", 1, "2026-07-02"), ("a", 2, "2026-07-01")]
    with pytest.raises(ValueError):
        library.search(seen, "x", 0)


def test_applicability_and_language(spark):
    events = spark.createDataFrame([(1, "t", "s", "", "", "US", "", [], ["8517.62"]), (2, "smart plug", "", "", "", "EU", "", [], []), (3, "x", "", "", "", "JP", "", [], [])], "event_id long, title string, summary string, impact string, rationale string, jurisdiction string, platform string, products array<string>, hs_codes array<string>")
    catalog = spark.createDataFrame([("A", "Phone", ["USA"], [], ["8517"], []), ("B", "Plug", ["欧盟"], [], [], ["smart  PLUG"])], "sku string, name string, markets array<string>, platforms array<string>, hs_codes array<string>, keywords array<string>")
    assert {r.event_id: (r.status, [i.sku for i in r["items"]]) for r in applicability.statuses(events, catalog).collect()} == {1: ("matched", ["A"]), 2: ("matched", ["B"]), 3: ("no_match", [])}
    rows = spark.createDataFrame([("这是一个中文句子关于贸易政策的变化情况和影响", "en-US"), ("plain English words only here", "zh-CN"), ("short", "zh")], "text string, language string")
    assert [r.mismatch for r in language.assess(rows).collect()] == [True, True, False]


def test_worksheet(spark):
    s = "struct<" + ",".join(f"{d}:int" for d in K.BREAKDOWN) + ">"
    shape = f"pos long, event_id string, semantic_aliases array<string>, reviewed_level string, score_breakdown {s}, score int, review_fingerprint string"
    full, none = (1, 1, 1, 1, 1), (None,) * 5
    fresh = spark.createDataFrame([(0, "a", [], "low", none, None, "f"), (1, "b", ["old"], "low", none, None, "f"), (2, "c", [], "low", none, None, "g"), (3, "d", [], "low", none, None, "f")], shape)
    old = spark.createDataFrame([(0, "a", [], "low", full, 5, "f"), (1, "old", [], "low", full, 5, "f"), (2, "c", [], "low", full, 5, "f"), (3, "gone", [], "low", full, 5, "f")], shape)
    got = {r.event_id: r.merge_status for r in worksheet.merge(fresh, old).collect()}
    assert got == {"a": "preserved_complete", "b": "preserved_via_semantic_alias", "c": "evidence_changed_requires_review", "d": "new_unscored", "gone": "retained_existing_only"}
    assert not worksheet.ready(worksheet.merge(fresh, old)).first().ready


def test_worksheet_in_groups(spark):
    """A record is one group of what its identifiers meet, and a diff needs no list of ids."""
    s = "struct<" + ",".join(f"{d}:int" for d in K.BREAKDOWN) + ">"
    shape = f"pos long, event_id string, semantic_aliases array<string>, reviewed_level string, score_breakdown {s}, score int, review_fingerprint string"
    full, none = (1, 1, 1, 1, 1), (None,) * 5
    # one is met by an alias and by its id, one by two rows of unlike scores, one by two of like scores, one has no id
    fresh = spark.createDataFrame([(0, "a", ["x", "a"], "low", none, None, "f"), (1, "b", ["y"], "low", none, None, "f"), (2, "c", ["z"], "low", none, None, "f"), (3, None, None, "low", none, None, "f")], shape)
    old = spark.createDataFrame([
        (0, "x", [], "low", full, 5, "f"), (1, "a", ["x"], "low", full, 5, "f"), (2, "b", [], "low", full, 5, "f"), (3, "y", [], "low", full, 4, "f"), (4, "c", [], "low", full, 5, "f"), (5, "q", ["z"], "low", full, 5, "f"), (6, None, None, "low", full, 5, "f"),
    ], shape)
    merged = worksheet.merge(fresh, old)
    got = sorted((str(r.event_id), r.merge_status, r.score) for r in merged.collect())
    assert got == [("None", "new_unscored", None), ("None", "retained_existing_only", 5), ("a", "preserved_complete", 5), ("b", "existing_score_conflict_requires_review", None), ("c", "preserved_complete", 5)]
    found = {r.category: (r.n, r["first"], r.blockers, r.ready) for r in worksheet.diff_summary(merged).collect()}
    assert found == {"new_unscored": (1, None, 2, False), "score_conflicts": (1, "b", 2, False), "preserved_complete": (2, "a", 2, False), "retained_existing_only": (1, None, 2, False)}
    assert "collect_list" not in worksheet.diff_summary(merged)._jdf.queryExecution().toString()


def test_files(tmp_path, spark):
    base, new = tmp_path / "base.json", tmp_path / "new.json"
    files.write_whole(base, "old")
    files.write_whole(new, "new")
    with pytest.raises(ValueError):
        files.promote(new, base, "0" * 64, "adopt_candidate", "r", "t")
    files.promote(new, base, files.digest(new), "defer", "r", "t")
    assert base.read_text() == "old"
    files.promote(new, base, files.digest(new), "adopt_candidate", "r", "t")
    assert base.read_text() == "new"
    files.rollback(base)
    assert base.read_text() == "old"
    with pytest.raises(ValueError):
        files.rollback(base)
    assert len(files.starters(tmp_path)) == 2 and files.load_profile(tmp_path / "profile.json").name == "default"
    (tmp_path / "reports").mkdir()
    (tmp_path / "reports" / "a.json").write_text(report_json())
    (tmp_path / "reports" / "b.json").write_text(report_json(event={"score": 9}))
    good, bad = reports.split_valid(reports.raw(spark, f"file://{tmp_path}/reports"))
    assert good.count() == 1 and bad.count() == 1 and reports.events(good).first().title == "t"


def test_run(tmp_path, spark):
    from auditlake.plans.run import run

    (tmp_path / "new.json").write_text(report_json())
    (tmp_path / "old.json").write_text(report_json(report_date="2026-06-30"))
    (tmp_path / "p.json").write_text(json.dumps({"schema_version": "1.0", "name": "n", "candidate_report": "new.json", "previous_report": "old.json", "alerts": {"min_level": "low", "require_applicability_match": False}}))
    status = run(spark, files.load_profile(tmp_path / "p.json"), str(tmp_path / "out"))
    assert (status["status"], status["event_count"], status["alert_count"]) == ("complete", 0, 0)
    assert "duplicate_removed: 1" in (tmp_path / "out" / "report.md").read_text()


def test_fetch(spark):
    class Reply:
        status = 200

        def __init__(self, url):
            self.url = url

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def geturl(self):
            return self.url

        def read(self, n):
            return b" text \n"

    tasks = spark.createDataFrame([("t", "https://a.org/", False), ("u", "https://a.org/x", True)], "task_id string, url string, requires_auth boolean")
    got = feeds.fetch(tasks, opener=lambda url, timeout: Reply(url), pause=0).collect()
    assert [(r.task_id, r.result, r.attempts) for r in got] == [("t", "candidate_found", 1)]


@pytest.mark.parametrize("name", sorted(workloads.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(workloads.SQL[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = workloads.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
