"""Helpers of several operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a temporary one if driver and executors are one process; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="auditlake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Rows as a table in the shared folder, for loops: unlike a checkpoint, it brings no constraints of earlier plans along.

    Those would multiply from round to round, until planning takes longer than the work.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_small(df: DataFrame) -> DataFrame:
    """``written`` for plans that do much with each of very many rows.

    The JVM compiles no method of over 8,000 bytes, so Spark's code of a whole stage would be interpreted, many times slower
    than its code operator by operator, which Spark falls back to beyond this limit.
    """
    key, spark = "spark.sql.codegen.hugeMethodLimit", df.sparkSession
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(8000, int(before))))
    try:
        return written(df)
    finally:
        spark.conf.set(key, before)


def tasks(spark: SparkSession) -> int:
    """As many parts as keep all cores busy with work that its bytes don't show."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bounds the bytes that one Arrow batch brings into a Python worker; a session's own lower bound holds.

    The bound counts when a plan runs, which may be after the caller has it, so it stays in the session.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = (spark.conf.get(key, None) or "").removesuffix("b")
    if not own.isdigit() or not 0 < int(own) <= most:
        spark.conf.set(key, str(most))


def spread(pairs: DataFrame, *keys: str) -> DataFrame:
    """Pairs over all tasks, before a costly function: a few bytes of pairs can be minutes of work."""
    return pairs.repartition(tasks(pairs.sparkSession), *keys)


def meet(a: DataFrame, b: DataFrame, key: str, least: int = 128, most: int = 4096) -> DataFrame:
    """Structs ``a`` and ``b`` of all pairs of rows of equal ``key``.

    The rows of ``b`` are dealt to chunks, those of ``a`` copied to each chunk of their key, so that a key with many rows
    is many tasks; a chunk has ``least`` to ``most`` rows. Nulls meet nothing.
    """
    n = tasks(a.sparkSession)
    many = F.greatest(F.ceil(F.col("__n") / most), F.least(F.ceil(F.col("__n") / least), F.lit(16))).cast("int")
    sizes = b.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).select(F.col(key).alias("__k"), many.alias("__many"))
    row = lambda df, name: F.struct(*[F.col(c) for c in df.columns]).alias(name)
    left = a.join(sizes, a[key] == sizes["__k"]).select("__k", F.explode(F.sequence(F.lit(0), F.col("__many") - 1)).alias("__c"), row(a, "a"))
    chunk = F.pmod(F.xxhash64(*[F.col(c) for c in b.columns]), F.col("__many")).cast("int")
    right = b.join(sizes, b[key] == sizes["__k"]).select("__k", chunk.alias("__c"), row(b, "b"))
    return left.repartition(n, "__k", "__c").join(right.repartition(n, "__k", "__c"), ["__k", "__c"]).select("a", "b")


#: Rows of a key in one list, whose pairs with another list are formed at once; lists that travel together; parts of a key at most.
LIST, TOGETHER, PARTS = 2048, 16, 16


def listed(rows: DataFrame, key: str, of: Column, size: int | None = None) -> DataFrame:
    """``key``, ``part`` and ``lists``: of each list ``x`` of a key's rows what ``of`` makes of it, in parts that travel.

    Lists are short, as pairs of two are held at once. Parts are few, as each is copied for every part that it meets: what
    is shuffled to meet another key is at most ``PARTS`` times the rows, however many pairs they form.
    """
    n = rows.groupBy(key).agg(F.ceil(F.count("*") / (size or LIST)).cast("int").alias("__n"))
    own = F.struct(*[c for c in rows.columns if c != key])
    rows = rows.join(n, key).withColumn("__list", F.pmod(F.xxhash64("pos"), F.col("__n")).cast("int"))
    rows = rows.groupBy(key, "__n", "__list").agg(F.collect_list(own).alias("x"))
    part = F.pmod(F.col("__list"), F.least(F.lit(PARTS), F.ceil(F.col("__n") / TOGETHER).cast("int")))
    return rows.groupBy(key, part.alias("part")).agg(F.collect_list(of).alias("lists"))


def unrolled(met: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Pairs of a list of column ``a`` and one of ``b``, one a row; the rows that hold them are dealt to all tasks by ``keys``.

    ``apart`` ends it: Spark's code of a stage would else keep all pairs of the lists of a row before it gives the first.
    """
    return apart(spread(met, *keys).drop(*keys).withColumn(a, F.explode(a)).withColumn(b, F.explode(b)))


def apart(df: DataFrame) -> DataFrame:
    """The same rows, but what follows is not compiled into one loop with what is before, so rows pass one by one."""
    return df.coalesce(1 << 20)


def previous_in(rows: DataFrame, key: str, number: str, span: int = 100_000) -> DataFrame:
    """``key``, ``number`` and ``previous``, the next smaller number of the key; a key's numbers are ordered span by span."""
    rows = rows.select(key, number, F.floor(F.col(number) / span).alias("__s"))
    here = rows.withColumn("__p", F.lag(number).over(Window.partitionBy(key, "__s").orderBy(number)))
    along = Window.partitionBy(key).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(key, "__s").agg(F.max(number).alias("__e")).withColumn("__before", F.max("__e").over(along)).drop("__e")
    return here.join(ends, [key, "__s"]).select(key, number, F.coalesce("__p", "__before").alias("previous"))


def best_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).filter("__place = 1").drop("__place")


def placed(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """Rows with their place (from 1) in an order of the whole table, sorted by range over all tasks.

    A place is a row's number in its sorted part behind the sizes of the parts before; only those sizes meet in one task.
    """
    return numbered(df.orderBy(*order), name)


def numbered(ordered: DataFrame, name: str = "place") -> DataFrame:
    """Rows with their place (from 1) in the order that they have."""
    rows = cut(ordered.withColumn("__i", F.monotonically_increasing_id()))
    part = F.shiftright("__i", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))  # a row for each part
    found = rows.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return found.withColumn(name, (F.col("__before") + F.col("__i").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int" if name == "rank" else "long")).drop("__i", "__part", "__before")


def latest(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The row of the latest time of each key; the first by ``tie`` of equal times. One hash aggregation, no sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(F.col(time), -F.col(tie))).alias("__r")).select(*keys, "__r.*")


def zero_filled(counts: DataFrame, key: str, values: tuple[str, ...], n: str = "n") -> DataFrame:
    """Counts with a row for each listed value."""
    grid = counts.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return grid.join(F.broadcast(counts), key, "left").select(key, F.coalesce(n, F.lit(0)).cast("long").alias(n))
