"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python stay this small, so that workers hold few long texts at a time.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
_LIBC = ctypes.CDLL(None)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds what one Arrow batch brings into a Python worker; a session's own lower bounds hold.

    The bounds count when a plan runs, which may be after the caller has it, so they stay in the session.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        own = spark.conf.get(key, None)
        number = own.removesuffix("b") if own else ""
        if not number.lstrip("-").isdigit() or not 0 < int(number) <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Gives what earlier batches have freed back to the system; a worker would else keep the most it ever held."""
    pyarrow.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a temporary one if driver and executors are one process; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="auditlake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def stored(df: DataFrame, name: str) -> DataFrame:
    """Rows written once to the shared folder as Parquet, which holds them in less space than a checkpoint."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def carried(df: DataFrame, *but: str) -> Column:
    """All columns of a table but these as one struct, so that no helper column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in but]).alias("row")


def join_unique(rows: DataFrame, unique: DataFrame, on: list[str], by: str, counts: DataFrame, parts: int = 10_000) -> DataFrame:
    """``rows`` joined to a table with one row for each value of ``on``; a value of ``by`` with many rows goes to several tasks.

    ``by`` is a column of both sides, ``counts`` (by, n) tells how many rows its values have. Values with over a
    ``parts``-th of all rows are ``parts`` at most, so their list is broadcast.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    each = max(1000, total // parts)
    hot = counts.filter(F.col("n") > each).select(F.col(by).alias("__by"), F.ceil(F.col("n") / each).cast("int").alias("__many"))
    both = list(dict.fromkeys([*on, by]))

    def dealt(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(hot), df[by] == hot["__by"], "left").withColumn("__many", F.coalesce("__many", F.lit(1))).drop("__by")

    # by the row's own content, so that a task that runs again deals alike
    content = [F.col(c) for c, kind in rows.dtypes if not kind.startswith("map") and "map<" not in kind]
    left = dealt(rows).withColumn("__deal", F.pmod(F.xxhash64(*content), F.col("__many")).cast("int")).drop("__many")
    right = dealt(unique).withColumn("__deal", F.explode(F.sequence(F.lit(0), F.col("__many") - 1))).drop("__many")
    return left.join(right, [*both, "__deal"]).drop("__deal")


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder once and goes on from there, also after executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
