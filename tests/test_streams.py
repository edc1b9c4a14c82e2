"""Streams that are stopped and started again: receipts that expire, alerts that are delivered once."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException

from auditlake.streaming import outbox
from auditlake.streaming.horizons import within
from auditlake.streaming.receipts import fresh_receipts

ROWS = "task_id string, kind string, at timestamp, seq long, ref string, result string"
START = datetime(2026, 7, 1)


def test_receipts_expire(spark, tmp_path):
    folder = f"file://{tmp_path}"

    def run(*rows):
        """Adds rows and goes on with the stream from where it stopped."""
        made = [(task, kind, START + timedelta(minutes=m), seq, ref, result) for seq, (task, kind, m, ref, result) in enumerate(rows)]
        spark.createDataFrame(made, ROWS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = fresh_receipts(spark.readStream.schema(ROWS).parquet(f"{folder}/in"), 3600, "10 minutes")
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        return {(r.ref, r.outcome, r.receipt_ref) for r in spark.read.schema(out.schema).parquet(f"{folder}/out").collect()}

    good, none = "candidate_found", None
    want = {("l1", "reused", "r1"), ("l2", "fetch", none), ("l0", "fetch", none)}
    assert run(("a", "receipt", 10, "r1", good), ("a", "lookup", 30, "l1", none), ("a", "lookup", 5, "l0", none), ("b", "lookup", 31, "l2", none)) == want
    want |= {("l3", "reused", "r1"), ("old", "late", "r1"), ("l5", "fetch", none), ("l6", "fetch", none)}
    assert run(("a", "lookup", 70, "l3", none), ("a", "receipt", 61, "r2", "timeout"), ("b", "receipt", 62, "r3", good))  - want == {("l3", "fetch", none)}
    got = run(("b", "lookup", 121, "l5", none), ("b", "receipt", 61.5, "old", good), ("c", "lookup", 300, "l6", none))
    assert {("old", "late", "r3"), ("l5", "reused", "r3"), ("l6", "fetch", none)} <= got
    # once the watermark has passed their time, receipts leave the state
    assert {(ref, "expired", none) for ref in ("r2", "r3")} <= run(("c", "lookup", 400, "l7", none)) and ("r1", "expired", none) not in got


def receiver(folder):
    """A function that keeps each post as a file, and refuses while a file says so; and one that reads the posts."""
    folder = str(folder)

    def post(bodies, key):
        import os

        if os.path.exists(f"{folder}/refuse-{key}"):
            raise ValueError("refused")
        with open(f"{folder}/post-{key}-{os.urandom(4).hex()}", "w") as file:
            file.write("\n".join(bodies))

    def posts():
        return sorted((name.split("-", 1)[1].rsplit("-", 1)[0], open(f"{folder}/{name}").read().split("\n")) for name in os.listdir(folder) if name.startswith("post-"))

    return post, posts


def test_alerts_are_delivered_once(spark, tmp_path):
    folder, inbox = f"file://{tmp_path}/s", tmp_path / "inbox"
    inbox.mkdir()
    post, posts = receiver(inbox)

    def run(*signatures):
        rows = spark.createDataFrame([(s, f"body {s}") for s in signatures], "signature string, body string")
        if signatures:
            rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        outbox.start(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/box", post, 2).awaitTermination()

    run("a", "b", "c", "a")
    assert posts() == [("0-0", ["body a", "body b"]), ("0-1", ["body c"])]
    (inbox / "refuse-1-0").touch()
    with pytest.raises(StreamingQueryException):  # one chunk of the batch fails, the other is entered
        run("b", "d", "e", "f")
    assert [k for k, _ in posts()] == ["0-0", "0-1", "1-1"] and outbox.pending(spark, f"{folder}/box").count() == 2
    (inbox / "refuse-1-0").unlink()
    run()
    assert posts()[2:] == [("1-0", ["body d", "body e"]), ("1-1", ["body f"])] and outbox.pending(spark, f"{folder}/box").isEmpty()
    run("c", "g")
    assert posts()[4:] == [("2-0", ["body g"])] and outbox.delivered(spark, f"{folder}/box").count() == 7


def test_killed_between_write_and_commit(spark, tmp_path):
    """A batch that wrote its outbox, and one that posted without entering it, run again with the same chunks and keys."""
    folder, inbox = f"file://{tmp_path}/box", tmp_path / "inbox"
    inbox.mkdir()
    post, posts = receiver(inbox)
    rows = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "signature string, body string")
    outbox.enqueue(rows, 0, folder, 2)  # killed before the post
    outbox.enqueue(rows, 0, folder, 2)
    post(["1", "2"], "0-0")  # killed before the ledger
    outbox.deliver(spark, folder, post)
    outbox.enqueue(rows, 1, folder, 2)
    outbox.deliver(spark, folder, post)
    kept = dict(posts())  # the receiver tells repeats by their key
    assert kept == {"0-0": ["1", "2"], "0-1": ["3"]} and len(posts()) == 3


def test_horizons_keep_little_state(spark, tmp_path):
    """Two streams over many days: the pairs of each day, and state of the last hours alone."""
    folder, shape = f"file://{tmp_path}", "kind string, key string, n long, ts timestamp"
    want, held = set(), []
    for day in range(4):
        at = START + timedelta(days=day)
        rows = [("r", "a", day, at + timedelta(hours=12))] + [("c", "a", day * 10 + k, at + timedelta(hours=h)) for k, h in enumerate((5, 6, 12, 13, 14))] + [("c", "b", 99, at + timedelta(hours=12))]
        want |= {(day, day * 10 + k) for k in (1, 2, 3)}
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        s = spark.readStream.schema(shape).parquet(f"{folder}/in")
        out = within(s.filter("kind = 'r'").selectExpr("key", "n receipt", "ts checked_at"), s.filter("kind = 'c'").selectExpr("key", "n capture", "ts captured_at"), "6 hours", "1 hour", "2 hours")
        run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        held.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert {(r.receipt, r.capture) for r in spark.read.schema(out.schema).parquet(f"{folder}/out").collect()} == want
    assert max(held) <= 7 and held[3] <= held[0]
