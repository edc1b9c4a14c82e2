"""A store of captures that is added to, and audited."""

import json

import pytest

from auditlake import cli
from auditlake.operators import chains, snapshots


def lines(path, *rows):
    path.write_text("\n".join(json.dumps({"platform": "p", "url": u, "content": c, "captured_at": f"2026-07-{d:02}T00:00:00Z"}) for u, c, d in rows))
    return str(path)


@pytest.mark.parametrize("policy", ["sqlite", "git", "s3", "filesystem"])
def test_captures_are_added(spark, tmp_path, policy, capsys):
    store, file = str(tmp_path / "store"), tmp_path / "c.json"
    add = lambda *rows: cli.main(["snapshot", store, lines(file, *rows), "--policy", policy], spark)
    assert add(("https://a.org/1", "one\ntwo", 2), ("https://a.org/1", "one\n2", 3), ("https://a.org/2", " x ", 2)) == 0
    assert add(("https://a.org/1", "one\n2", 3), ("https://a.org/1", "one\n2", 5), ("https://a.org/3", "new", 1)) == 0  # a repeat, and the same text later
    late = add(("https://a.org/1", "old", 4), ("https://a.org/2", "y", 6))
    records, index, diffs = snapshots.stored(spark, store)
    got = [(r.url[-1], r.captured_at.day, r.change_status) for r in records.orderBy("url", "part", "place").collect()]
    want = [("1", 2, "first_seen"), ("1", 3, "changed"), ("1", 5, "unchanged"), ("2", 2, "first_seen"), ("2", 6, "changed"), ("3", 1, "first_seen")]
    if policy == "filesystem":
        assert late == 0 and got == [*want[:3], ("1", 4, "changed"), *want[3:]]
        assert {r.fault for r in chains.audited(records, index, diffs).collect()} == {"not_chronological"}
    else:
        assert late == 1 and "refused" in capsys.readouterr().err and got == want
        assert chains.audited(records, index, diffs).collect() == [] and cli.main(["snapshot-audit", store], spark) == 0
    by = {r.snapshot_id: r for r in records.collect()}
    assert all(r.previous_snapshot_id is None or r.previous_snapshot_id in by for r in by.values()) and diffs.count() == sum(r.change_status == "changed" for r in by.values())
