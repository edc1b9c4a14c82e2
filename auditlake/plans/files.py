"""Files of the driver: written whole, promoted and rolled back only if their hashes agree; profiles and starters."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from dataclasses import dataclass, field
from pathlib import Path


def write_whole(path: str | Path, content: str | bytes) -> None:
    """Readers see the old file or the new one, never a part."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(handle, "wb") as f:
        f.write(content.encode() if isinstance(content, str) else content)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)


def digest(path: str | Path) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def dump(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2) + "\n"


DECISIONS = ("retain_current", "adopt_candidate", "defer")


def promote(candidate: str | Path, baseline: str | Path, expected: str, decision: str, reviewer: str, at: str) -> dict:
    """Makes a reviewed calibration the baseline, keeping the old one under its hash; a deferred one changes nothing."""
    if decision not in DECISIONS or not reviewer.strip():
        raise ValueError("a decision and a reviewer are required")
    if digest(candidate) != expected:
        raise ValueError("candidate changed after its review")
    record = {"decision": decision, "reviewer": reviewer, "at": at, "candidate": expected, "previous": digest(baseline) if Path(baseline).exists() else None, "ready": decision != "defer"}
    if decision != "defer":
        if record["previous"]:
            write_whole(f"{baseline}.{record['previous'][:12]}.bak", Path(baseline).read_bytes())
        write_whole(baseline, Path(candidate).read_bytes())
    write_whole(f"{baseline}.readiness.json", dump(record))
    return record


def rollback(baseline: str | Path) -> dict:
    """Puts back what the last promotion replaced, if neither file has changed since."""
    record = json.loads(Path(f"{baseline}.readiness.json").read_text())
    if not record["previous"] or not record["ready"]:
        raise ValueError("nothing to roll back")
    backup = Path(f"{baseline}.{record['previous'][:12]}.bak")
    if digest(baseline) != record["candidate"] or digest(backup) != record["previous"]:
        raise ValueError("baseline or backup changed since the promotion")
    write_whole(baseline, backup.read_bytes())
    record = record | {"rolled_back": True, "ready": False}
    write_whole(f"{baseline}.readiness.json", dump(record))
    return record


@dataclass(frozen=True)
class Profile:
    """Settings of a run; paths are relative to the profile."""

    name: str
    candidate_report: str | None = None
    previous_report: str | None = None
    catalog: str | None = None
    output: dict = field(default_factory=dict)
    deduplication: dict = field(default_factory=lambda: {"threshold": 0.82, "review_threshold": 0.65})
    quality: dict = field(default_factory=lambda: {"language_mode": "warn"})
    alerts: dict = field(default_factory=lambda: {"min_level": "high", "require_applicability_match": None})
    scope: dict = field(default_factory=dict)


def load_profile(path: str | Path) -> Profile:
    path = Path(path)
    data = json.loads(path.read_text(encoding="utf-8"))
    known = set(Profile.__dataclass_fields__)
    if extra := set(data) - known - {"schema_version"}:
        raise ValueError(f"unknown profile fields: {', '.join(sorted(extra))}")
    if data.pop("schema_version", None) != "1.0":
        raise ValueError("profile schema_version must be 1.0")
    for key in ("candidate_report", "previous_report", "catalog"):
        if data.get(key):
            data[key] = str((path.parent / data[key]).resolve())
    for key in ("quality", "deduplication", "alerts"):
        default = Profile.__dataclass_fields__[key].default_factory()
        if unknown := set(data.get(key, {})) - set(default) - {"state_file", "webhook"}:
            raise ValueError(f"unknown {key} settings: {', '.join(sorted(unknown))}")
        data[key] = default | data.get(key, {})
    if data["alerts"]["require_applicability_match"] is None:  # alerts are about the catalog, where there is one
        data["alerts"]["require_applicability_match"] = data.get("catalog") is not None
    if data["alerts"].get("state_file"):
        data["alerts"]["state_file"] = str((path.parent / data["alerts"]["state_file"]).resolve())
    out = Profile(**data)
    low, high = out.deduplication["review_threshold"], out.deduplication["threshold"]
    if not 0 <= low <= high <= 1:
        raise ValueError("require 0 <= review_threshold <= threshold <= 1")
    if out.quality["language_mode"] not in ("off", "warn", "strict"):
        raise ValueError("language_mode must be off, warn or strict")
    _check_rest(out)
    return out


def _check_rest(profile: Profile) -> None:
    """Names, formats and addresses that a run would otherwise only meet at its end."""
    stem, formats, hook = (profile.output.get(k, d) for k, d in (("basename", "report"), ("formats", ["markdown"]), ("webhook", None)))
    hook = profile.alerts.get("webhook", hook)
    rules = {
        "name must be a nonblank text": isinstance(profile.name, str) and bool(profile.name.strip()),
        "output.basename must be a file name without folders": isinstance(stem, str) and bool(stem.strip()) and not set("\\/:") & set(stem),
        "output.formats must hold markdown or docx": isinstance(formats, list) and bool(formats) and all(f in ("markdown", "docx") for f in formats),
        "alerts.min_level must be a level": profile.alerts["min_level"] in ("watch", "low", "medium", "high"),
        "alerts.require_applicability_match must be true or false": isinstance(profile.alerts["require_applicability_match"], bool),
        "alerts.webhook must be an https URL": hook is None or isinstance(hook, str) and hook.startswith("https://"),
    }
    if broken := [rule for rule, holds in rules.items() if not holds]:
        raise ValueError("; ".join(broken))


def starters(folder: str | Path, name: str = "default") -> list[str]:
    """A profile and an empty catalog to begin with; existing files stay."""
    made = []
    for file, content in (("profile.json", {"schema_version": "1.0", "name": name, "catalog": "catalog.json"}), ("catalog.json", {"schema_version": "1.0", "organization": name, "items": []})):
        path = Path(folder) / file
        if not path.exists():
            write_whole(path, dump(content))
            made.append(str(path))
    return made


def platform_template(platform_id: str, display_name: str) -> dict:
    return {"id": platform_id, "display_name": display_name, "aliases": [], "seller_markets": [], "programs": [], "official_routes": [], "source_profile": {"expected_source_types": ["official_updates", "current_policy", "dashboard"], "known_gaps": {}}}
