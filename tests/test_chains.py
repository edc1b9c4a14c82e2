"""The audit of stored captures by pointers, on planted faults and random graphs."""

import hashlib
import random

import pytest

from auditlake.functions import udfs
from auditlake.operators import chains

RECORD = "page_key string, snapshot_id string, previous_snapshot_id string, captured_at long, content string, content_hash string, change_status string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def page(key, texts):
    rows = []
    for n, x in enumerate(texts):
        status = "first_seen" if not n else "unchanged" if x == texts[n - 1] else "changed"
        rows.append([key, f"s{n}", f"s{n - 1}" if n else None, n, x, sha(x), status])
    diffs = [[key, f"s{n}", udfs.line_diff(texts[n - 1], x)[1]] for n, x in enumerate(texts) if n and x != texts[n - 1]]
    return rows, diffs, [key, f"s{len(texts) - 1}"]


def tables(spark, pages):
    rows, diffs, index = zip(*pages)
    return spark.createDataFrame(sum(rows, []), RECORD), spark.createDataFrame([i for i in index if i], "page_key string, latest_snapshot_id string"), spark.createDataFrame(sum(diffs, []), "page_key string, snapshot_id string, diff string")


def faults(spark, pages):
    return {(r.page_key, r.snapshot_id, r.fault) for r in chains.audited(*tables(spark, pages)).collect()}


def test_planted_faults(spark):
    make = lambda key, n=5: page(key, [f"line {i // 2}" for i in range(n)])
    pages, want = [make("good", 9), page("one", ["x"])], set()
    broken = make("broken")
    broken[0][3][2] = "gone"
    want |= {("broken", "s3", "missing_previous"), *(("broken", s, "unreachable") for s in ("s0", "s1", "s2"))}
    broken[1][:] = [d for d in broken[1] if d[1] != "s3"]
    ring = make("ring")
    ring[0][0][2], ring[0][0][6] = "s2", "changed"
    ring[1].append(["ring", "s0", udfs.line_diff("line 1", "line 0")[1]])
    want |= {("ring", s, "cycle") for s in ("s0", "s1", "s2")} | {("ring", "s0", "not_chronological")}
    worse = make("worse")
    worse[0][1][4], worse[0][2][5], worse[0][4][6] = " line 0", "0", "first_seen"
    worse[1][:] = [["worse", "s2", worse[1][0][2] + "x"], ["worse", "s9", ""], ["worse", "s0", ""]]
    want |= {("worse", "s1", "not_normalized"), ("worse", "s2", "wrong_hash"), ("worse", "s3", "wrong_status"), ("worse", "s4", "wrong_status"), ("worse", "s2", "wrong_diff"), ("worse", "s3", "missing_diff"), ("worse", "s4", "missing_diff"), ("worse", "s9", "unreferenced_diff"), ("worse", "s0", "unexpected_diff")}
    stale, lost, bare, twin = make("stale"), make("lost"), make("bare"), make("twin")
    stale[2][1], lost[2][1] = "s2", "s7"
    bare, twin = (bare[0], bare[1], None), ([*twin[0], twin[0][4]], twin[1], twin[2])
    want |= {("stale", None, "latest_stale"), ("stale", "s3", "unreachable"), ("stale", "s4", "unreachable"), ("lost", None, "latest_missing"), ("bare", None, "no_index"), ("twin", "s4", "repeated_id")}
    want |= {(k, f"s{n}", "unreachable") for k in ("lost", "bare") for n in range(5)}
    pages += [broken, ring, worse, stale, lost, bare, twin]
    assert faults(spark, pages) == want
    records, index, _ = tables(spark, pages)
    fixed = {r.page_key: (r.latest_snapshot_id, r.recovered) for r in chains.repaired(index, records).collect()}
    assert fixed == {k: ("s8" if k == "good" else "s0" if k == "one" else "s2" if k == "stale" else "s4", k in ("lost", "bare")) for k in ("good", "one", "broken", "ring", "worse", "stale", "lost", "bare", "twin")}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_pointers(spark, seed):
    """Any pointers at all: what the latest leads to, and cycles, against a plain walk."""
    rng = random.Random(seed)
    pages = {k: {n: rng.choice([None, 99, *range(12)]) if rng.random() < 0.5 else n - 1 if n else None for n in range(12)} for k in range(25)}
    rows = [(str(k), str(n), None if p is None else str(p), n, "", "", "") for k, to in pages.items() for n, p in to.items()]
    heads = {k: rng.randrange(13) for k in pages}
    index = spark.createDataFrame([(str(k), str(h)) for k, h in heads.items()], "page_key string, latest_snapshot_id string")
    reached, cycle = chains.walked(spark.createDataFrame(rows, RECORD), index)

    def path(to, n):
        seen = []
        while n in to and n not in seen:
            seen.append(n)
            n = to[n]
        return seen, n

    want = {(str(k), str(n)) for k, to in pages.items() for n in path(to, heads[k])[0]}
    rings = {(str(k), str(n)) for k, to in pages.items() for n in to if path(to, n)[1] == n}
    assert {tuple(r) for r in reached.collect()} == want and {tuple(r) for r in cycle.collect()} == rings


def test_empty_store(spark):
    records, index, diffs = (t.limit(0) for t in tables(spark, [page("a", ["x"])]))
    assert chains.audited(records, index, diffs).collect() == [] and chains.repaired(index, records).collect() == []
