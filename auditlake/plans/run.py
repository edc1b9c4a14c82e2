"""One run: plan, match the catalog, validate, check the language, deduplicate, print, alert.

A run reads one report, which is a file of the driver, and writes files; its events are a table in between. What a step
finds joins the report by the events' places, so fields that no table knows stay as they are.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.operators import alerting, applicability, language, linkage, planning, validation
from auditlake.plans import files, report
from auditlake.sources import reports


def of_report(spark: SparkSession, data: dict) -> DataFrame:
    """A report's object as the one row (report, raw) that rules and sources read."""
    return spark.createDataFrame([("report", json.dumps(data, ensure_ascii=False))], "report string, raw string")


def events_of(spark: SparkSession, data: dict) -> DataFrame:
    """A report's events with what matching and alerting read of them."""
    rows = reports.events(of_report(spark, data))
    return rows.withColumns({"event_id": F.col("pos").cast("string"), "platform": F.coalesce("policy.platform", F.lit("")), "evidence": F.col("score_breakdown.evidence")})


def errors_of(spark: SparkSession, data: dict) -> list[str]:
    found = validation.violations(of_report(spark, data)).orderBy("location", "message")
    return [f"{r['location']}: {r['message']}" for r in found.toLocalIterator()]


#: Why an event has the status that matching gives it.
REASONS = {
    "matched": "an item in scope has a code or a term of the event",
    "needs_review": "items are in scope, but none has a code or a term of the event",
    "no_match": "no item is in scope",
}


def enriched(spark: SparkSession, data: dict, catalog: DataFrame) -> dict:
    """The report with the applicability of each event."""
    organization = (catalog.select("organization").first() or [""])[0]
    found = {r["event_id"]: r for r in applicability.statuses(events_of(spark, data), catalog).toLocalIterator()}
    events = []
    for n, event in enumerate(data["events"]):
        r = found[str(n)]
        items = [i.asDict(recursive=True) for i in r["items"]]
        events.append(event | {"applicability": {"organization": organization, "status": r["status"], "reason": REASONS[r["status"]], "matched_items": items}})
    return data | {"events": events}


def deduplicated(spark: SparkSession, data: dict, previous: dict, threshold: float, review: float, name: str = "") -> tuple[dict, DataFrame]:
    """(the report without repeated events, the others annotated, and its matches; the matches as a table)."""
    now, old = events_of(spark, data), events_of(spark, previous)
    kept, matches = linkage.deduplicate(now, old, data.get("report_date"), previous.get("report_date"), threshold, review)
    notes = kept.select("pos", "deduplication_review", "matched_previous_id", "deduplication_reasons")
    events = []
    for r in notes.orderBy("pos").toLocalIterator():
        event = dict(data["events"][r["pos"]])
        if r["deduplication_review"]:
            event["deduplication"] = {"disposition": r["deduplication_review"], "previous_id": r["matched_previous_id"], "reasons": r["deduplication_reasons"]}
        events.append(event)
    block = {"previous_report": name, "threshold": threshold, "review_threshold": review, "matching_strategy": K.MATCHING, "matches": [r.asDict(recursive=True) for r in matches.toLocalIterator()]}
    return data | {"events": events, "deduplication": block}, matches


def batch(spark: SparkSession, data: dict, state: DataFrame, min_level: str, require_match: bool) -> tuple[dict, DataFrame]:
    """(the alerts that are due and how many events each reason keeps back; the judged events)."""
    rows = events_of(spark, data)
    status = spark.createDataFrame([(str(n), e.get("applicability", {}).get("status")) for n, e in enumerate(data["events"])], "event_id string, applicability string")
    judged = alerting.judge(alerting.signed(rows.join(status, "event_id")), state, min_level, require_match).cache()
    alerts = [r.asDict() for r in judged.filter("reason is null").orderBy("pos").select("id", "signature", "level", "title", "source_url").toLocalIterator()]
    kept = {r["reason"]: r["n"] for r in judged.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).collect()}
    return {"alert_count": len(alerts), "alerts": alerts, "suppressed": kept}, judged


def run(spark: SparkSession, profile: files.Profile, folder: str, events: str | None = None, previous: str | None = None, send: Callable[[dict], None] | None = None) -> dict:
    """Writes a run's files to ``folder``; returns its status, which is also written.

    ``send`` delivers a batch of alerts. The memory of signatures grows only by what was delivered.
    """
    out, artifacts = Path(folder), {}

    def keep(name: str, value: object) -> None:
        files.write_whole(out / name, value if isinstance(value, str) else files.dump(value))
        artifacts[name] = str(out / name)

    def done(status: str, **more: object) -> dict:
        result = {"profile": profile.name, "status": status, "artifacts": dict(artifacts), **more}
        files.write_whole(out / "status.json", files.dump(result))
        return result

    if profile.scope.get("cutoff"):
        tracks = planning.plan(spark, **profile.scope).cache()
        plan = {"plan_id": planning.plan_id(tracks, profile.scope["cutoff"]).first()["id"], "tracks": [r.asDict() for r in tracks.toLocalIterator()]}
        keep("research-plan.json", plan)
        keep("manifests.json", [r.asDict() for r in planning.manifest_requests(tracks).toLocalIterator()])
    source = events or profile.candidate_report
    if source is None:
        return done("research_required")
    data = json.loads(Path(source).read_text(encoding="utf-8"))
    if profile.catalog:
        data = enriched(spark, data, reports.catalog(spark, profile.catalog))
    keep("events-enriched.json", data)
    if errors := errors_of(spark, data):
        keep("validation-errors.json", {"errors": errors})
        return done("validation_failed", error_count=len(errors))
    if profile.quality["language_mode"] != "off":
        rows = events_of(spark, data)
        issues = language.assess(rows.withColumn("__t", language.event_text(rows.columns)), "__t").filter("mismatch").select("id").toLocalIterator()
        issues = [r["id"] for r in issues]
        keep("language-quality.json", {"issue_count": len(issues), "issues": issues})
        if issues and profile.quality["language_mode"] == "strict":
            return done("language_review_required", language_issue_count=len(issues))
    matches, old = None, previous or profile.previous_report
    if old:
        limits = profile.deduplication
        data, matches = deduplicated(spark, data, json.loads(Path(old).read_text(encoding="utf-8")), limits["threshold"], limits["review_threshold"], old)
    keep("events-final.json", data)
    if errors := errors_of(spark, data):
        raise ValueError("post-deduplication validation failed: " + "; ".join(errors[:5]))
    formats, name = profile.output.get("formats", ["markdown"]), profile.output.get("basename", "report")
    shown = report.markdown(events_of(spark, data), matches, gaps=tuple(map(str, data.get("coverage_gaps", []))), language=data["language"], date=data["report_date"])
    if "markdown" in formats:
        keep(f"{name}.md", shown)
    if "docx" in formats:
        report.docx(shown, str(out / f"{name}.docx"))
        artifacts[f"{name}.docx"] = str(out / f"{name}.docx")

    memory = profile.alerts.get("state_file")
    state = alerting.load_state(spark, memory)
    alerts, judged = batch(spark, data, state, profile.alerts["min_level"], profile.alerts["require_applicability_match"])
    keep("alerts.json", alerts)
    delivered = False
    if send and alerts["alert_count"]:
        send(alerts)
        delivered = True
        if memory:
            alerting.save_state(alerting.next_state(state, judged), memory)
            artifacts["alert_state"] = memory
    judged.unpersist()
    return done("complete", event_count=len(data["events"]), alert_count=alerts["alert_count"], alerts_delivered=delivered)


def validate(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    return [tuple(r) for r in validation.violations(reports.raw(spark, path)).orderBy("report", "location", "message").toLocalIterator()]
