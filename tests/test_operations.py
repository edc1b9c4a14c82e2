"""Whole runs, stores, the command line, links against all pairs, late captures, fetches that are too large."""

import difflib
import itertools
import json
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from auditlake import cli
from auditlake import fault_workloads as faults
from auditlake.functions import udfs
from auditlake.operators import alerting, applicability, common, discovery, graph, library, linkage, snapshots
from auditlake.plans import files
from auditlake.plans.run import run
from auditlake.sources import feeds

HIGH = {"score": 10, "score_breakdown": dict.fromkeys(faults.EVENT["score_breakdown"], 2), "level": "high"}


def report_of(*events, **other):
    """A sound report with events that differ from the planted one."""
    made = [{**faults.EVENT, "platform_policy": faults.GONE, "action_items": faults.GONE, **e} for e in events]
    made = [{k: v for k, v in e.items() if v is not faults.GONE} for e in made]
    return {**faults.REPORT, "scope": [], "coverage_ledger": [], "events": made, **other}


@pytest.fixture
def profile(tmp_path):
    first = {"id": "a", "title": "Tariff on steel", "authority": "Customs", "jurisdiction": "US", "source_url": "https://x.org/a", **HIGH}
    second = {"id": "b", "title": "New label duties for toys", "authority": "Safety office", "jurisdiction": "France", "source_url": "https://x.org/b", "hs_codes": ["950300"], **HIGH}
    (tmp_path / "new.json").write_text(json.dumps(report_of(first, second, {"id": "c", "title": "Quota", "jurisdiction": "Peru", "source_url": "https://x.org/c"})))
    (tmp_path / "old.json").write_text(json.dumps(report_of(first, report_date="2026-07-20")))
    (tmp_path / "catalog.json").write_text(json.dumps({"schema_version": "1.0", "organization": "o", "items": [{"sku": "s", "name": "toy car", "hs_codes": ["9503.00"], "markets": ["France"]}]}))
    settings = {
        "schema_version": "1.0", "name": "n", "candidate_report": "new.json", "previous_report": "old.json", "catalog": "catalog.json", "output": {"formats": ["markdown", "docx"], "basename": "day"},
        "alerts": {"min_level": "high", "require_applicability_match": True, "state_file": "state.json"}, "scope": {"cutoff": "2026-07-21T00:00:00+00:00", "regions": ["US"]},
    }
    (tmp_path / "p.json").write_text(json.dumps(settings))
    return tmp_path


def test_run_tells_once(profile, spark):
    """The repeated event goes, the matched one is told, and a second run is silent."""
    sent, settings = [], files.load_profile(profile / "p.json")
    first = run(spark, settings, str(profile / "out"), send=sent.append)
    assert (first["status"], first["event_count"], first["alert_count"], first["alerts_delivered"]) == ("complete", 2, 1, True)
    assert [a["id"] for a in sent[0]["alerts"]] == ["b"] and sent[0]["suppressed"] == {"below_level": 1}
    final = json.loads((profile / "out" / "events-final.json").read_text())
    assert [e["id"] for e in final["events"]] == ["b", "c"] and [m["disposition"] for m in final["deduplication"]["matches"]] == ["duplicate_removed"]
    assert final["events"][0]["applicability"]["matched_items"][0]["sku"] == "s"
    assert {"research-plan.json", "manifests.json", "events-enriched.json", "alerts.json", "day.md", "day.docx"} <= set(first["artifacts"])
    second = run(spark, settings, str(profile / "again"), send=sent.append)
    assert (second["alert_count"], second["alerts_delivered"], len(sent)) == (0, False, 1)
    assert json.loads((profile / "again" / "alerts.json").read_text())["suppressed"] == {"already_alerted": 1, "below_level": 1}


def test_run_undelivered_alerts_are_told_again(profile, spark):
    settings = files.load_profile(profile / "p.json")

    def fail(batch):
        raise ValueError("webhook answered 500")

    with pytest.raises(ValueError):
        run(spark, settings, str(profile / "out"), send=fail)
    assert run(spark, settings, str(profile / "out"))["alert_count"] == 1 and not (profile / "state.json").exists()


def test_run_stops(profile, spark):
    settings = files.load_profile(profile / "p.json")
    bad = json.loads((profile / "new.json").read_text()) | {"report_date": "today"}
    (profile / "bad.json").write_text(json.dumps(bad))
    status = run(spark, settings, str(profile / "out"), events=str(profile / "bad.json"))
    assert (status["status"], status["error_count"]) == ("validation_failed", 1)
    nothing = files.Profile("n")
    assert run(spark, nothing, str(profile / "none"))["status"] == "research_required"


def test_webhook():
    class Reply:
        def __init__(self, status):
            self.status = status

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

    asked = []
    post = alerting.webhook("https://x.org/hook", opener=lambda ask, timeout: asked.append(ask.data) or Reply(204))
    post({"a": 1})
    assert asked == [b'{"a": 1}']
    with pytest.raises(ValueError):
        alerting.webhook("https://x.org/hook", opener=lambda ask, timeout: Reply(302))({})
    with pytest.raises(ValueError):
        alerting.webhook("http://x.org/hook")


def test_library_store(tmp_path, spark):
    """Reports come in, come again in a later version, and broken ones are skipped."""
    store, folder = f"file://{tmp_path}/store", tmp_path / "in"
    folder.mkdir()
    for name, event in (("a", "one"), ("b", "two")):
        (folder / f"{name}.json").write_text(json.dumps(report_of({"id": "e1", "summary": event}, report_date="2026-07-21" if name == "a" else "2026-07-22")))
    (folder / "c.json").write_text(json.dumps(report_of({"id": "e2", "score": 99})))
    assert library.tables(spark, store) is None
    got = library.ingest(spark, store, f"file://{folder}", "t1")
    assert (got["imported_count"], got["event_count"], len(got["skipped"])) == (2, 2, 1)
    (folder / "a.json").write_text(json.dumps(report_of({"id": "e1", "summary": "changed"}, {"id": "e3"})))
    (folder / "b.json").unlink()
    assert library.ingest(spark, store, f"file://{folder}", "t2")["event_count"] == 2
    held, sightings = library.tables(spark, store)
    assert (held.count(), sightings.count()) == (2, 3)
    assert [r.event_id for r in library.search(sightings, "changed").collect()] == ["e1"]
    with pytest.raises(ValueError):
        library.ingest(spark, store, f"file://{folder}/c.json", "t3")
    with pytest.raises(AnalysisException):
        library.ingest(spark, store, f"file://{tmp_path}/none", "t3")


def test_commands(profile, spark, capsys):
    ask = lambda *a: cli.main([str(x) for x in a], spark)
    assert ask("validate", profile / "new.json") == 0
    (profile / "bad.json").write_text(json.dumps({"events": []}))
    assert ask("validate", profile / "bad.json") == 1 and "timezone: is required" in capsys.readouterr().out
    assert ask("deduplicate", profile / "new.json", "--previous", profile / "old.json", "--output", profile / "d.json") == 0
    assert len(json.loads((profile / "d.json").read_text())["events"]) == 2
    assert ask("deduplicate", profile / "new.json", "--previous", profile / "old.json", "--threshold", "0.1") == 2
    assert ask("match", profile / "new.json", "--catalog", profile / "catalog.json", "--output", profile / "m.json") == 0
    assert ask("alert", profile / "m.json", "--require-match") == 0 and '"alert_count": 1' in capsys.readouterr().out
    assert ask("markdown", profile / "new.json") == 0 and "New label duties" in capsys.readouterr().out
    assert ask("run", profile / "p.json", "--output-dir", profile / "o") == 0 and ask("run", profile / "p.json", "--output-dir", profile / "o", "--send-alerts") == 2
    assert ask("plan", profile / "p.json") == 0 and ask("validate", profile / "missing.json") == 2


# -- links -------------------------------------------------------------------------------------------------------------


def test_bound_holds():
    """No similarity is over its bound, also with junk and long texts."""
    rng = random.Random(2)
    pairs = [("".join(rng.choice("abc é") for _ in range(rng.randrange(0, 300))), "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 300)))) for _ in range(300)]
    pairs += [(a, a[3:] + "x" + a[:2]) for a, _ in pairs]
    for a, b in pairs:
        assert udfs.common_length(a, b) == lcs(a, b) if len(a) * len(b) < 4000 else True
        if a and b:
            assert difflib.SequenceMatcher(None, a, b).ratio() <= 2 * udfs.common_length(a, b) / (len(a) + len(b)) + 1e-12


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


LEAD = "pos long, lead_id string, source_title string, source_url string, jurisdiction string, platform string, products array<string>, hs_codes array<string>, claim string"


def test_lead_links_against_all_pairs(spark):
    rng = random.Random(3)
    words = ["steel", "tariff", "toy", "label", "duty", "port", "ban", "fee"]
    rows = []
    for i in range(70):
        claim = " ".join(rng.choice(words) for _ in range(6))
        rows.append((i, str(i), " ".join(rng.choice(words) for _ in range(3)), f"https://x{i}.org/", rng.choice(["us", "fr", "unknown", None]), rng.choice(["p", None]), rng.sample(["a", "b"], 1), [], claim))
    leads = spark.createDataFrame(rows, LEAD)
    got = {(r.a, r.b): round(r.similarity, 9) for r in discovery.lead_links(leads).collect()}
    known = lambda s: None if s in (None, "unknown") else {"us": "united states"}.get(s, s)
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = {}
    for x, y in itertools.combinations(rows, 2):
        if any(known(x[n]) and known(y[n]) and known(x[n]) != known(y[n]) for n in (4, 5)):
            continue
        alike = 0.55 * ratio(x[8], y[8]) + 0.30 * ratio(x[2], y[2]) + 0.15 * (x[6] == y[6])
        if alike >= 0.62:
            want[x[0], y[0]] = round(alike, 9)
    assert got == want and len(want) > 20
    plan = discovery.lead_links(leads)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


EVENT = "pos long, id string, title string, summary string, source_title string, authority string, jurisdiction string, products array<string>, source_url string"


def test_event_links_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["steel", "tariff", "toy", "label", "duty", "port", "ban", "fee"]
    made = lambda n: [(i, rng.choice(["", "x", f"id{i}"]), " ".join(rng.choice(words) for _ in range(5)), "", "", rng.choice(["Customs", "Customs office"]), rng.choice(["us", "fr", None]), [], "") for i in range(n)]
    current, previous = made(40), made(40)
    got = {(r.ci, r.pi): round(r.score, 9) for r in linkage.score_pairs(spark.createDataFrame(current, EVENT), spark.createDataFrame(previous, EVENT)).collect()}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = {}
    for x, y in itertools.product(current, previous):
        if x[6] and y[6] and x[6] != y[6]:
            continue
        both = 0.10 if x[6] and y[6] else 0.0
        score = 1.0 if x[1] and x[1] == y[1] else (0.30 * ratio(x[2], y[2]) + 0.12 * ratio(x[5].lower(), y[5].lower()) + both) / (0.42 + both)
        if score >= 0.65:
            want[x[0], y[0]] = round(score, 9)
    assert got == want and len(want) > 50


def test_meet(spark):
    a = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"))
    b = spark.range(50).select((F.col("id") + 1000).alias("id"), (F.col("id") % 3).alias("k"))
    got = sorted((r.a.id, r.b.id) for r in common.meet(a, b, "k", least=4).collect())
    assert got == sorted((i, j + 1000) for i in range(300) for j in range(50) if i % 3 and i % 3 == j % 3)


def test_previous_in(spark):
    rows = [(k, n) for k in "ab" for n in random.Random(1).sample(range(1000), 60)]
    got = {(r.k, r.n): r.previous for r in common.previous_in(spark.createDataFrame(rows, "k string, n long"), "k", "n", 50).collect()}
    order = {k: sorted(n for x, n in rows if x == k) for k in "ab"}
    assert got == {(k, n): (order[k][i - 1] if i else None) for k in "ab" for i, n in enumerate(order[k])}


def test_only_mixed_components_are_replayed(spark):
    nodes = spark.createDataFrame([(1, "us", None), (2, None, None), (3, "us", "p"), (4, "us", None), (5, None, None), (6, "fr", None)], "node long, jurisdiction string, platform string")
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 6)], "a long, b long")
    assert {r.node: r.cluster for r in graph.constrained(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_applicability_against_all_pairs(spark):
    rng = random.Random(8)
    pick = lambda *x: rng.choice(x)
    events = [(i, pick("toy car rules", "steel", "Zoology HS code 9503.00"), pick("", "about labels"), "", "", pick("us", "fr", ""), pick("acme", "", "shop"), pick(["toys"], []), pick([], ["8471"], ["847130"])) for i in range(60)]
    items = [(f"s{i}", pick("toy", "zoo", "Label", "xy"), pick([], ["US"], ["fr", "us"]), pick([], ["acme"]), pick([], ["8471"], ["84713000", "95"]), pick([], ["steel"], ["oo"])) for i in range(40)]
    e = spark.createDataFrame(events, "event_id long, title string, summary string, impact string, rationale string, jurisdiction string, platform string, products array<string>, hs_codes array<string>")
    c = spark.createDataFrame(items, "sku string, name string, markets array<string>, platforms array<string>, hs_codes array<string>, keywords array<string>")
    got = {r.event_id: (r.status, [(i.sku, i.matched_hs_codes, i.matched_terms) for i in r["items"]]) for r in applicability.statuses(e, c).collect()}
    place = lambda s: {"us": "united states"}.get(s.lower(), s.lower())
    for own, title, summary, _, _, j, p, goods, codes in events:
        body = " ".join([title, summary, "", "", " ".join(goods)]).lower()
        body, codes = " ".join(body.split()), set(codes) | ({"950300"} if "9503" in title else set())
        scope = [x for x in items if (not x[2] or place(j) in map(place, x[2])) and (not x[3] or p in x[3])]
        found = []
        for x in scope:
            hs = sorted(o for o in x[4] if any(o.startswith(y) or y.startswith(o) for y in codes))
            terms = sorted(w for w in {x[1], *x[5]} if len(w) >= 3 and w.lower() in body)
            if hs or terms:
                found.append((x[0], hs, terms))
        assert got[own] == ("matched" if found else "needs_review" if scope else "no_match", sorted(found)), own


# -- captures and fetches ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("policy, taken", [("git", [True, False, True, False, True]), ("s3", [True, False, True, False, True]), ("sqlite", [True, True, True, False, True]), ("filesystem", [True] * 5)])
def test_late_captures(spark, policy, taken):
    """What is refused doesn't change what the store holds."""
    rows = spark.createDataFrame([(1, "p", 10, "b"), (2, "p", 10, "c"), (3, "p", 10, "b"), (4, "p", 9, "b"), (5, "p", 11, "c")], "seq long, page_key string, captured_at long, content_hash string")
    assert [r.accepted for r in snapshots.admit(rows, policy).orderBy("seq").collect()] == taken


def test_fetch_refuses_what_it_cannot_keep_whole(spark):
    class Reply:
        status = 200

        def __init__(self, url):
            from email.message import Message

            self.url, self.headers = url, Message()
            self.headers["Content-Type"] = f"text/plain; charset={'latin-1' if 'latin' in url else 'nonsense' if 'odd' in url else 'utf-8'}"

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def geturl(self):
            return self.url

        def read(self, n):
            return (b"x" * 11 if "long" in self.url else "é".encode("latin-1") if "latin" in self.url else b"ok")[:n]

    tasks = spark.createDataFrame([(k, f"https://{k}.org/", False) for k in ("long", "latin", "odd", "plain")], "task_id string, url string, requires_auth boolean")
    got = {r.task_id: (r.result, r.error_type, r.body) for r in feeds.fetch(tasks, opener=lambda url, timeout: Reply(url), pause=0, limit=10).collect()}
    assert got == {"long": ("blocked", "ResponseTooLarge", None), "latin": ("candidate_found", None, "é"), "odd": ("blocked", "UnknownCharset", None), "plain": ("candidate_found", None, "ok")}
