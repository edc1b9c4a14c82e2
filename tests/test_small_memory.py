"""Python functions that return what a query needs alone, in small batches."""

from pyspark.sql import functions as F

from auditlake import workloads
from auditlake.functions import udfs
from auditlake.operators import common


def test_diff_summary(spark):
    """The summary and counts of the diff, without its text, from batches of bounded bytes."""
    rows = spark.createDataFrame([("a\nb", "a\nc\nd"), ("x", "x"), (None, "y"), ("z", None)], "old string, new string")
    got = rows.select(udfs.diff_summary("old", "new").alias("s"), udfs.unified_diff("old", "new").alias("d")).select("s.*", F.col("d.summary").alias("ds"), F.col("d.added").alias("da"), F.col("d.removed").alias("dr")).collect()
    assert all((r.summary, r.added, r.removed) == (r.ds, r.da, r.dr) for r in got) and [r.added for r in got] == [2, 0, 1, 0]
    assert "diff" not in rows.select(udfs.diff_summary("old", "new").alias("s")).select("s.*").columns
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key)
    try:
        common.small_batches(spark)
        assert int(spark.conf.get(key).removesuffix("b")) <= 4 << 20
        spark.conf.set(key, "1000")
        common.small_batches(spark)
        assert spark.conf.get(key).removesuffix("b") == "1000"
    finally:
        spark.conf.set(key, own)
    assert "unified_diff_summary" in workloads.QUERIES


def test_both_lines(spark):
    """Page and evidence lines from one reading are what the column functions give, on all kinds of white space and line ends."""
    from auditlake.functions import text

    breaks = ["\r\n", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    spaces = [" ", "\t", "\xa0", "\u1680", "\u2003", "\u202f", "\u205f", "\u3000", "\x1f"]
    made = [f"{s}a{s}{s}b{s}{n}{n}{s}{n}c{s}d{n}" for n in breaks for s in spaces]
    rows = spark.createDataFrame([(x,) for x in [*made, None, "", " ", "\n", "e\u0301\u200b x", "\ufeff y"]], "t string")
    got = rows.select(udfs.both_lines("t").alias("x"), text.content_lines(F.col("t")).alias("page"), text.content_lines(F.col("t"), inner=False).alias("evidence")).collect()
    assert [(r.x.page, r.x.evidence) for r in got] == [(r.page, r.evidence) for r in got]
