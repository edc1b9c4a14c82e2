"""Evaluations from files by the command line, and a history that grows by parts."""

import json

from auditlake import cli
from auditlake.plans import evaluation_runs

DATES = {"published_date": "2026-07-01", "effective_date": None, "deadline": "2026-08-01"}


def event(n, **more):
    return {"id": f"e{n}", "title": f"T {n}", "jurisdiction": "EU", "authority": "EC", "source_title": "S", "source_url": f"https://x.org/{n}?utm_a=1", "status": "new", "level": "high", **DATES} | more


def label(n, include=True, **more):
    return {"event_id": f"e{n}", "should_include": include, "accepted_primary_source_urls": [f"https://x.org/{n}"], "status": "new", "level": "high", **DATES} | more


def files(folder, run, events, records, cases=(), matches=(), **more):
    (folder / run).mkdir(parents=True)
    labels = {"dataset_version": 1, "dataset_name": run, "review_status": "independently_reviewed", "reviewed_by": "x", "reviewed_at": "2026-07-01T00:00:00+00:00", "records": records, "deduplication_cases": list(cases)} | more
    (folder / f"{run}.labels.json").write_text(json.dumps(labels))
    (folder / run / "deduplicated.json").write_text(json.dumps({"events": events, "deduplication": {"matches": list(matches)}}))
    return str(folder / run / "deduplicated.json"), str(folder / f"{run}.labels.json")


def told(spark, tmp_path, *args):
    out = tmp_path / "out.json"
    code = cli.main([*map(str, args), "--output", str(out)], spark)
    return code, json.loads(out.read_text()) if out.exists() else None


def test_commands(spark, tmp_path, capsys):
    case = {"current_id": "e1", "previous_id": "p1", "expected_disposition": "duplicate_removed"}
    match = {"current_id": "e1", "previous_id": "p1", "disposition": "duplicate_removed"}
    one = files(tmp_path, "r1", [event(1), event(2)], [label(1), label(2), label(3, False)], [case], [match])
    two = files(tmp_path, "r2", [event(1, source_url="https://y.org/"), event(5, level="low")], [label(1), label(4)], [case], [match | {"previous_id": "p2"}])
    easy = ["--minimum-positive-events", "1"]
    code, got = told(spark, tmp_path, "evaluate", *one, *easy)
    assert (code, got["precision"], got["recall"], got["deduplication_accuracy"], got["passed"], got["errors"]) == (0, 1.0, 1.0, 1.0, True, [])
    code, got = told(spark, tmp_path, "evaluate", *two, *easy)
    assert (code, got["tp"], got["fp"], got["fn"], got["unsupported_sources"], got["primary_source_rate"]) == (3, 1, 1, 1, 2, 0.0)
    assert {(e["kind"], e["id"]) for e in got["errors"]} == {("false_positive", "e5"), ("false_negative", "e4"), ("unsupported_source", "e1"), ("unsupported_source", "e5"), ("deduplication", "e1")}
    (tmp_path / "m.json").write_text(json.dumps({"files": ["r1.labels.json", "r2.labels.json"]}))
    code, whole = told(spark, tmp_path, "evaluate-history", tmp_path / "m.json", tmp_path)
    assert (code, whole["runs"], whole["tp"], whole["fp"], whole["fn"], whole["precision"], whole["deduplication_accuracy"]) == (3, 2, 3, 1, 1, 0.75, 0.5)
    assert {e["run"] for e in whole["errors"]} == {"r2"}
    # a history by parts is the same
    store = f"file://{tmp_path}/store"
    for run, paths in (("r1", one), ("r2", two)):
        evaluation_runs.record(store, *(evaluation_runs.files_of(spark, {run: p}) for p in paths))
    held = evaluation_runs.history(spark, store).first().asDict(recursive=True)
    assert {k: v for k, v in held.items()} == {k: whole[k] for k in held}
    bad = files(tmp_path, "r3", [event(1), event(1)], [label(1)], review_status="draft")
    assert cli.main(["evaluate", *bad], spark) == 1 and "is a duplicate" in capsys.readouterr().err
    (tmp_path / "m.json").write_text(json.dumps({"files": ["r1.json"]}))
    assert cli.main(["evaluate-history", str(tmp_path / "m.json"), str(tmp_path)], spark) == 2
    draft = files(tmp_path, "r4", [event(1)], [label(1)], [case], [match], review_status="draft")
    assert told(spark, tmp_path, "evaluate", *draft, *easy)[0] == 3 and told(spark, tmp_path, "evaluate", *draft, *easy, "--allow-draft")[0] == 0
    code, scaffold = told(spark, tmp_path, "evaluation-scaffold", one[0], two[0], "--dataset-name", "d")
    assert code == 0 and [(r["event_id"], r["should_include"], r["origin"]) for r in scaffold["records"]] == [("e1", True, "candidate"), ("e2", False, "candidate"), ("e5", True, "final_only")]
