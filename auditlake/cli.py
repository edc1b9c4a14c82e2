"""The command line: ``python -m auditlake.cli <command> --help``.

Commands read and write files; what they do is in the operators and plans. Exit codes: 0 done, 1 found something that
must not be, 2 bad input, 3 a gate is not passed.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.operators import acquisition, alerting, calibration, chains, common, discovery, evaluation, language, library, planning, snapshots
from auditlake.plans import evaluation_runs, files, report, run
from auditlake.session import build
from auditlake.sources import reports

Command = Callable[[SparkSession, argparse.Namespace], int]
COMMANDS: dict[str, tuple[Command, tuple]] = {}


def command(name: str, *options: tuple) -> Callable[[Command], Command]:
    """Registers a command with its options: (name, or names and settings of ``add_argument``)."""

    def add(f: Command) -> Command:
        COMMANDS[name] = f, options
        return f

    return add


def load(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def rows_of(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.toLocalIterator()]


def give(args: argparse.Namespace, value: object) -> int:
    """Writes a result to ``--output``, or prints it."""
    text = value if isinstance(value, str) else files.dump(value)
    if args.output:
        files.write_whole(args.output, text)
    else:
        sys.stdout.write(text)
    return 0


OUTPUT = ("--output", {"default": None})
REPORT = ("report", {})


@command("validate", REPORT)
def validate(spark: SparkSession, args: argparse.Namespace) -> int:
    found = run.validate(spark, args.report)
    for _, location, message in found:
        print(f"{location}: {message}")
    return 1 if found else 0


@command("run", ("profile", {}), ("--output-dir", {"required": True}), ("--events", {"default": None}), ("--previous", {"default": None}), ("--send-alerts", {"action": "store_true"}))
def whole_run(spark: SparkSession, args: argparse.Namespace) -> int:
    profile = files.load_profile(args.profile)
    if args.send_alerts and not profile.alerts.get("webhook"):
        raise ValueError("--send-alerts needs a webhook in the profile")
    status = run.run(spark, profile, args.output_dir, args.events, args.previous, alerting.webhook(profile.alerts["webhook"]) if args.send_alerts else None)
    print(status["status"])
    return 1 if status["status"] in ("validation_failed", "language_review_required") else 0


@command("deduplicate", REPORT, ("--previous", {"required": True}), ("--threshold", {"type": float, "default": K.MATCH_THRESHOLD}), ("--review-threshold", {"type": float, "default": K.REVIEW_THRESHOLD}), OUTPUT)
def deduplicate(spark: SparkSession, args: argparse.Namespace) -> int:
    return give(args, run.deduplicated(spark, load(args.report), load(args.previous), args.threshold, args.review_threshold, args.previous)[0])


@command("match", REPORT, ("--catalog", {"required": True}), OUTPUT)
def match(spark: SparkSession, args: argparse.Namespace) -> int:
    return give(args, run.enriched(spark, load(args.report), reports.catalog(spark, args.catalog)))


@command("alert", REPORT, ("--min-level", {"default": "high"}), ("--require-match", {"action": "store_true"}), ("--state", {"default": None}), OUTPUT)
def alert(spark: SparkSession, args: argparse.Namespace) -> int:
    return give(args, run.batch(spark, load(args.report), alerting.load_state(spark, args.state), args.min_level, args.require_match)[0])


@command("language-check", REPORT, OUTPUT)
def language_check(spark: SparkSession, args: argparse.Namespace) -> int:
    events = run.events_of(spark, load(args.report))
    found = language.assess(events.withColumn("__t", language.event_text(events.columns)), "__t").filter("mismatch").select("id", "family", "han", "latin")
    issues = rows_of(found)
    give(args, {"issue_count": len(issues), "issues": issues})
    return 1 if issues else 0


@command("markdown", REPORT, OUTPUT)
def markdown(spark: SparkSession, args: argparse.Namespace) -> int:
    data = load(args.report)
    return give(args, report.markdown(run.events_of(spark, data), gaps=tuple(map(str, data.get("coverage_gaps", []))), language=data["language"], date=data["report_date"]))


@command("docx", REPORT, ("--output", {"required": True}))
def docx(spark: SparkSession, args: argparse.Namespace) -> int:
    data = load(args.report)
    report.docx(report.markdown(run.events_of(spark, data), language=data["language"], date=data["report_date"]), args.output)
    return 0


@command("plan", ("profile", {}), OUTPUT)
def plan(spark: SparkSession, args: argparse.Namespace) -> int:
    scope = files.load_profile(args.profile).scope
    tracks = planning.plan(spark, **scope)
    return give(args, {"plan_id": planning.plan_id(tracks, scope["cutoff"]).first()["id"], "tracks": rows_of(tracks)})


LEAD = (
    "lead_id string, source_title string, source_url string, source_tier string, published_at string, jurisdiction string, platform string, products array<string>,"
    " hs_codes array<string>, claim string, momentum_score int"
)


@command("discover", ("leads", {}), ("--cutoff", {"required": True}), ("--region", {"action": "append", "default": []}), ("--platform", {"action": "append", "default": []}), ("--product", {"action": "append", "default": []}), OUTPUT)
def discover(spark: SparkSession, args: argparse.Namespace) -> int:
    leads = [(n, *[x.get(f.split()[0]) for f in LEAD.split(", ") for f in f.split(",")]) for n, x in enumerate(load(args.leads)["leads"])]
    return give(args, rows_of(discovery.prioritize(spark.createDataFrame(leads, "pos long, " + LEAD), args.cutoff, args.region, args.platform, args.product)))


@command("library", ("action", {"choices": ("ingest", "search", "show", "stats")}), ("--store", {"required": True}), ("--input", {"default": None}), ("--at", {"default": ""}), ("--query", {"default": ""}), ("--event", {"default": ""}), ("--limit", {"type": int, "default": 20}), OUTPUT)
def library_of(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.action == "ingest":
        return give(args, library.ingest(spark, args.store, args.input, args.at))
    held = library.tables(spark, args.store)
    if held is None:
        raise ValueError("the store is empty")
    if args.action == "search":
        return give(args, rows_of(library.find(spark, args.store, args.query, args.limit)))
    return give(args, rows_of(library.show(held[1], args.event) if args.action == "show" else library.stats(held[1])))


@command("drill", REPORT, ("--event", {"required": True}), OUTPUT)
def drill(spark: SparkSession, args: argparse.Namespace) -> int:
    events = run.events_of(spark, load(args.report)).withColumnRenamed("event_id", "place").withColumnRenamed("id", "event_id")
    return give(args, rows_of(planning.drill(events.filter(events.event_id == args.event).drop("policy"))))


@command("calibrate", ("reviews", {}), OUTPUT)
def calibrate(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = [(r["event_id"], r["reviewer"], r["reviewed_level"], r["score"]) for r in load(args.reviews)["records"]]
    return give(args, rows_of(calibration.calibrate(spark.createDataFrame(rows, "event_id string, reviewer string, level string, score int"))))


@command("evaluation-check", ("files", {}))
def evaluation_check(spark: SparkSession, args: argparse.Namespace) -> int:
    """What is wrong with label sets."""
    found = rows_of(evaluation.label_rules(reports.raw(spark, args.files)))
    for x in found:
        print(f"{x['report']}: {x['location']}: {x['message']}")
    return 1 if found else 0


GATES = tuple((f"--{name.replace('_', '-')}", {"type": float, "default": limit}) for name, limit in K.GATES.items())


def limits(args: argparse.Namespace) -> dict[str, float]:
    return {name: getattr(args, name) for name in K.GATES}


def judged(args: argparse.Namespace, out: DataFrame, errors: DataFrame) -> int:
    """Gives metrics, gates and errors; 3 if a gate is not passed."""
    result = rows_of(out)[0]
    give(args, result | {"errors": rows_of(errors.orderBy("run", "kind", "id"))})
    return 0 if result["passed"] else 3


@command("evaluate", REPORT, ("labels", {}), *GATES, ("--allow-draft", {"action": "store_true"}), OUTPUT)
def evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    """A report against its labels: 1 if a file is broken, 3 if a gate is not passed."""
    report, labels = (evaluation_runs.files_of(spark, {"run": str(Path(p).resolve())}) for p in (args.report, args.labels))
    return _evaluated(args, report, labels, args.allow_draft, history=False)


@command("evaluate-history", ("manifest", {}), ("reports_directory", {}), *GATES, OUTPUT)
def evaluate_history(spark: SparkSession, args: argparse.Namespace) -> int:
    """All runs that a manifest names: labels beside the manifest, each run's report in a folder of its name."""
    names, home = load(args.manifest).get("files"), Path(args.manifest).resolve().parent
    if not isinstance(names, list) or not names or len(set(names)) < len(names) or any(not isinstance(n, str) or not n.endswith(".labels.json") for n in names):
        raise ValueError("manifest.files must be different names that end with .labels.json")
    runs = {n.removesuffix(".labels.json"): n for n in names}
    labels = evaluation_runs.files_of(spark, {run: str(home / n) for run, n in runs.items()})
    report = evaluation_runs.files_of(spark, {run: str(Path(args.reports_directory).resolve() / run / "deduplicated.json") for run in runs})
    return _evaluated(args, report, labels, False, history=True)


def _evaluated(args: argparse.Namespace, report: DataFrame, labels: DataFrame, drafts: bool, history: bool) -> int:
    if found := rows_of(evaluation_runs.broken(report, labels)):
        print(*[f"{x['report']}: {x['location']}: {x['message']}" for x in found], sep="\n", file=sys.stderr)
        return 1
    sums, errors = evaluation_runs.states(report, labels)
    if drafts:
        sums = sums.withColumn("unreviewed", F.lit(0).cast("long"))
    return judged(args, evaluation_runs.totalled(sums, limits(args), history), errors)


@command("evaluation-scaffold", ("candidates", {}), ("final", {}), ("--dataset-name", {"required": True}), OUTPUT)
def evaluation_scaffold(spark: SparkSession, args: argparse.Namespace) -> int:
    """A draft of labels for a person to review."""
    one = lambda p: evaluation_runs.files_of(spark, {"run": str(Path(p).resolve())})
    records = rows_of(evaluation_runs.drafts(one(args.candidates), one(args.final)))
    return give(args, {"dataset_version": 1, "dataset_name": args.dataset_name, "review_status": "draft", "records": records, "deduplication_cases": []})


@command("coverage-dashboard", ("registry", {}), ("--health", {"default": None}), ("--format", {"choices": ("markdown", "html", "json"), "default": "markdown"}), OUTPUT)
def dashboard(spark: SparkSession, args: argparse.Namespace) -> int:
    states = [(x["platform"], x["audit_state"], x.get("checked_at")) for x in (load(args.health)["records"] if args.health else [])]
    rows = acquisition.dashboard(reports.registry(spark, args.registry)[0], spark.createDataFrame(states, "platform string, audit_state string, checked_at string"))
    return give(args, {"markdown": report.dashboard_markdown, "html": report.dashboard_html, "json": report.dashboard_json}[args.format](rows))


@command("snapshot", ("store", {}), ("captures", {}), ("--policy", {"choices": ("filesystem", "sqlite", "git", "s3"), "default": "sqlite"}))
def snapshot(spark: SparkSession, args: argparse.Namespace) -> int:
    """Adds captures (JSON lines: platform, url, content, captured_at) to a store; 1 if late ones were refused."""
    lines = spark.read.schema("platform string, url string, content string, captured_at timestamp").json(args.captures)
    refused = rows_of(snapshots.capture(spark, args.store, common.numbered(lines, "seq"), args.policy))
    for x in refused:
        print(f"{x['platform']} {x['url']}: refused, captured at {x['captured_at']}", file=sys.stderr)
    return 1 if refused else 0


@command("snapshot-audit", ("table", {}))
def snapshot_audit(spark: SparkSession, args: argparse.Namespace) -> int:
    """All faults of a store, or stored records in a table whose link or status is not what their order implies."""
    held = snapshots.stored(spark, args.table)
    if held:
        found = [f"{x['page_key']} {x['snapshot_id'] or ''}: {x['fault']}" for x in rows_of(chains.audited(*held))]
    else:
        found = [f"{x['page_key']} {x['snapshot_id']}: expected {x['expected_status']}" for x in rows_of(snapshots.audit(spark.read.parquet(args.table)))]
    if found:
        print(*found, sep="\n")
    return 1 if found else 0


@command("platforms", ("action", {"choices": ("list", "scaffold")}), ("--registry", {"default": None}), ("--id", {"default": ""}), ("--name", {"default": ""}), OUTPUT)
def platforms(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.action == "scaffold":
        return give(args, files.platform_template(args.id, args.name))
    return give(args, rows_of(reports.registry(spark, args.registry)[1].select("platform").distinct().orderBy("platform")))


@command("init", ("folder", {}), ("--name", {"default": "default"}))
def init(spark: SparkSession, args: argparse.Namespace) -> int:
    for path in files.starters(args.folder, args.name):
        print(path)
    return 0


@command("calibration-promote", ("candidate", {}), ("baseline", {}), ("--expected", {"required": True}), ("--decision", {"required": True}), ("--reviewer", {"required": True}), ("--at", {"required": True}))
def promote(spark: SparkSession, args: argparse.Namespace) -> int:
    return 0 if files.promote(args.candidate, args.baseline, args.expected, args.decision, args.reviewer, args.at)["ready"] else 3


@command("calibration-rollback", ("baseline", {}))
def rollback(spark: SparkSession, args: argparse.Namespace) -> int:
    files.rollback(args.baseline)
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="auditlake")
    each = out.add_subparsers(dest="command", required=True)
    for name, (f, options) in COMMANDS.items():
        sub = each.add_parser(name, help=f.__doc__)
        for option, settings in options:
            sub.add_argument(option, **settings)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return COMMANDS[args.command][0](spark or build(), args)
    except (OSError, ValueError, KeyError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
