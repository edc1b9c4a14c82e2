"""Platform and official-source files, calibrations and their updates, drills."""

import json

import pytest

from auditlake.operators import calibration, planning, validation
from auditlake.sources import reports


def route(kind="dashboard", role="account_specific", **other):
    out = {"route_id": kind.replace("_", "-"), "source_type": kind, "url": "https://p/" + kind, "access": "public", "evidence_role": role, "market_specific": False, "markets": ["*"]}
    return out | {"verification_status": "verified", "last_verified_on": "2026-07-01"} | other


def platform(name="p", routes=None, **other):
    lists = {k: ["x " + name] for k in ("aliases", "seller_markets", "programs", "dashboard_checks", "applicability_dimensions", "policy_areas", "notes")}
    kinds = ["official_updates", "current_policy", "dashboard"]
    routes = routes if routes is not None else [route(), route("official_updates", "discovery"), route("current_policy", "current_rule")]
    return {"id": name, "display_name": name.upper(), "official_routes": routes, "source_profile": {"expected_source_types": kinds, "known_gaps": {}}} | lists | other


def found(spark, rule, *files):
    rows = spark.createDataFrame([(f"f{n}", json.dumps(f)) for n, f in enumerate(files)], "report string, raw string")
    return {(r.report, r.location) for r in rule(rows).collect()}


def test_platform_files(spark):
    assert found(spark, validation.platform_rules, platform(), platform("q")) == set()
    bad = route(url="ftp://x", route_id="A B", access="x", evidence_role="discovery", market_specific=None, markets=[], verification_status="conditional")
    got = found(spark, validation.platform_rules, platform(routes=[bad, route("official_updates", "discovery"), route("official_updates", "discovery")], aliases=["ok", " "], id="Bad"))
    at = "official_routes[0]."
    assert got == {("f0", x) for x in ("id", "aliases", "official_routes.current_policy", at + "url", at + "route_id", at + "access", at + "evidence_role", at + "market_specific", at + "markets", at + "last_verified_on", at + "verify_before_use", "official_routes[2].route_id")}
    assert found(spark, validation.platform_rules, platform(), platform("q", aliases=["P"])) == {("f0", "aliases"), ("f1", "aliases")}
    gap = {"expected_source_types": ["dashboard", "current_policy", "official_updates"], "known_gaps": {"dashboard": "none exists"}}
    assert found(spark, validation.platform_rules, platform(source_profile=gap)) == {("f0", "official_routes.dashboard")}


def test_official_sources(spark, tmp_path):
    source = {"id": "us", "display_name": "U", "jurisdiction": "United States", "authority": "A", "aliases": ["US", "美国"], "routes": [{"label": "l", "url": "https://u/x", "source_type": "current_rule", "topics": ["t"]}]}
    assert found(spark, validation.official_rules, {"sources": [source]}) == set()
    worse = source | {"aliases": "x", "routes": [{"label": "l", "url": "http://u", "source_type": "y", "topics": [""], "more": 1}]}
    assert found(spark, validation.official_rules, {"sources": [source, worse]}, {"sources": 1}) == {("f1", "sources")} | {("f0", "sources[1]." + x) for x in ("id", "aliases", "routes[0]", "routes[0].url", "routes[0].source_type", "routes[0].topics")}
    (tmp_path / "a.json").write_text(json.dumps({"sources": [source, source | {"id": "cn", "jurisdiction": "China", "aliases": []}]}))
    table = reports.official_sources(spark, str(tmp_path))
    assert [r.id for r in planning.for_regions(table, [" us", "EU"]).collect()] == ["us"]
    assert planning.for_regions(table, []).count() == 0


def test_plan_joins_registries(spark):
    routes = spark.createDataFrame([("A", "dashboard", "http://a/d", ["fees"])], "platform string, source_type string, url string, policy_areas array<string>")
    official = spark.createDataFrame([("United States", ["US"], "https://u"), ("China", None, "https://c")], "jurisdiction string, aliases array<string>, url string")
    rows = planning.plan(spark, "2026-07-21T08:00:00+08:00", ["us", "Mars", "US"], [("A", "US", "fba"), "B", "a"], ["toys"], ["85.17"], routes=routes, official=official)
    by = {(r.kind, *r.platforms): r for r in rows.collect()}
    assert by[("official_updates",)].source_urls == ["https://u"] and by[("official_updates",)].authorities[-1] == "Mars responsible trade and product authorities"
    assert by[("official_updates",)].queries[0] == "Federal Register toys HS 8517 announcement rule consultation published"
    a = by[("marketplace_policy", "A")]
    assert (a.queries, a.source_urls, a.window_start) == (["A US fba seller policy update", "A US fees"], ["http://a/d"], "2026-07-14T08:00:00+08:00")
    assert by[("discovery_leads", "A", "B")].seller_markets == ["US", "unknown"] and planning.invariants(rows, ["A", "B"]).isEmpty()
    assert by[("effective_deadlines",)].window_end == "2026-08-20T08:00:00+08:00" and planning.manifest_requests(rows).count() == 2
    for wrong in ({"cutoff": "2026-07-21T00:00:00"}, {"cutoff": "2026-07-21T00:00:00Z", "hs_codes": ["12"]}, {"cutoff": "2026-07-21T00:00:00Z", "window_start": "2026-07-22T00:00:00Z"}):
        with pytest.raises(ValueError):
            planning.plan(spark, **wrong)


def test_drill(spark):
    events = spark.createDataFrame([("e1", "Regulation 2026/100", "EU", "EC", "", "http://a/d", "A", "unconfirmed"), ("e2", "T", None, None, None, None, None, None)], "event_id string, title string, jurisdiction string, authority string, source_title string, source_url string, platform string, status string")
    routes = spark.createDataFrame([("a", "dashboard", "http://a/d"), ("A", "current_policy", "http://a/p")], "platform string, source_type string, url string")
    seen = spark.createDataFrame([("e1", "2026-01-02"), ("e1", "2026-01-01")], "event_id string, report_date string")
    first, second = planning.drill(events, routes, seen).orderBy("event_id").collect()
    assert (first.mode, first.first_seen, first.sighting_count, len(first.questions)) == ("confirmation", "2026-01-01", 2, 7)
    assert [t.url for t in first.targets] == ["http://a/d", "http://a/p"] and '"regulation 2026 100" amendment implementation official' in first.queries
    assert (second.mode, len(second.queries), len(second.questions), second.sighting_count) == ("revalidation", 3, 6, None)


def test_calibration_and_update(spark):
    rows = [(f"{lv}{i}", who, lv, s) for lv, s in (("watch", 1), ("low", 3), ("medium", 6), ("high", 9)) for i in range(5) for who in ("a", "b")]
    shape = "event_id string, reviewer string, level string, score int"
    reviews = spark.createDataFrame([*rows, ("tie", "a", "low", 3), ("tie", "b", "high", 3)], shape)
    report = calibration.calibrate(reviews)
    row = report.first()
    assert (row.consensus_event_count, row.excluded_conflict_count, row.review_record_count, row.pairs) == (20, 1, 42, 21)
    assert (row.sufficient, row.current_accuracy, row.current_disagreement_count, row.recommendation_status) == (True, 1.0, 0, "current_rules_supported")
    few = calibration.calibrate(reviews, total=21)
    assert few.first().recommendation_status == "insufficient_data" and few.first().candidate_accuracy is None
    assert calibration.changed(report, report).first().decision_relevant_change is False
    assert "candidate_accuracy" in calibration.changed(report, few).first().fields
    ready = lambda ok: spark.createDataFrame([(ok, 0 if ok else 2)], "ready boolean, blockers long")
    assert calibration.update(ready(False), None)["exit_code"] == 3
    assert calibration.update(ready(True), few)["status"] == "insufficient_calibration_sample"
    assert calibration.update(ready(True), report, report, True)["threshold_status"] == "current_rules_supported"
    moved = calibration.calibrate(spark.createDataFrame([(e, w, lv, 4 if lv == "medium" else s) for e, w, lv, s in rows], shape))
    assert [calibration.update(ready(True), moved, p, d)["threshold_status"] for p, d in ((None, True), (moved, True), (report, True))] == ["fresh_human_decision_required", "previous_human_decision_retained", "fresh_human_decision_required"]
    with pytest.raises(ValueError):
        calibration.require_ready(ready(False))
    assert calibration.calibrate(spark.createDataFrame([], shape)).first().recommendation_status == "insufficient_data"


def test_placed(spark):
    from pyspark.sql import functions as F

    from auditlake.operators.common import placed

    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"), F.lit("a").alias("y")).repartition(7)
    assert [r.place for r in placed(rows, F.desc("x")).orderBy(F.desc("x")).collect()] == list(range(1, 1001))
    assert placed(rows.limit(0), F.col("x")).collect() == []


def test_platforms_are_read_once(spark):
    """Rules of platform files read a table of fields, not the files' texts; many files of one alias are no one list."""
    from pyspark.sql import functions as F

    rows = spark.range(300).select(F.col("id").cast("string").alias("report"), F.format_string('{"id": "p%d", "display_name": "P %d", "aliases": ["Shop"], "official_routes": [{"route_id": "r"}, null, {"route_id": "r"}]}', "id", "id").alias("raw"))
    out = validation.platform_rules(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan.lower() and "collect_set" not in plan
    got = out.groupBy("location", "message").count().collect()
    assert {r["count"] for r in got if r.location in ("aliases", "official_routes[2].route_id")} == {300}
    assert {r.message for r in got if r.location == "aliases"} == {"another platform also claims shop"}
