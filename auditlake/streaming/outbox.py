"""Alerts of a stream, delivered once each, also where a post fails or the stream is killed at any point.

Each batch first writes its new signatures to an outbox, in numbered chunks; a batch that runs again finds its chunks
there. Then all chunks that the ledger lacks are posted, those of earlier batches included, and what was posted is added
to the ledger. A failed post leaves its chunk without a ledger entry and stops the stream, so nothing is forgotten and
what was delivered beside it is not sent again. A chunk keeps its rows and its key for ever: if the stream is killed
between a post and the ledger, the same chunk is posted with the same key, by which the receiver tells the repeat.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditlake.operators.common import placed, written

#: Alerts in a chunk.
CHUNK = 500
BOX = "signature string, body string, chunk long, batch long"
LEDGER = "batch long, chunk long"


def _held(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _complete(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def enqueue(rows: DataFrame, batch: int, folder: str, size: int = CHUNK) -> None:
    """Writes the signatures (with the smallest body) that no other batch has brought, in chunks; once for each batch."""
    spark, target = rows.sparkSession, f"{folder}/box/batch={batch}"
    if _complete(spark, target):
        return
    known = _held(spark, f"{folder}/box", BOX).filter(F.col("batch") != batch).select("signature")
    fresh = rows.groupBy("signature").agg(F.min("body").alias("body")).join(known, "signature", "left_anti")
    chunked = placed(fresh, F.col("signature")).select("signature", "body", F.floor((F.col("place") - 1) / size).cast("long").alias("chunk"))
    chunked.write.mode("overwrite").parquet(target)


def pending(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the chunks that the ledger lacks."""
    return _held(spark, f"{folder}/box", BOX).join(_held(spark, f"{folder}/ledger", LEDGER).distinct(), ["batch", "chunk"], "left_anti")


def delivered(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the chunks that the ledger has."""
    return _held(spark, f"{folder}/box", BOX).join(_held(spark, f"{folder}/ledger", LEDGER).distinct(), ["batch", "chunk"], "left_semi")


def deliver(spark: SparkSession, folder: str, post: Callable[[list[str], str], None]) -> None:
    """Posts what is pending, a chunk at a time in any task, and enters what was taken; an error names what was not."""

    def send(rows: pd.DataFrame) -> pd.DataFrame:
        batch, chunk = int(rows["batch"].iloc[0]), int(rows["chunk"].iloc[0])
        try:
            post(rows.sort_values("signature")["body"].tolist(), f"{batch}-{chunk}")
            error = None
        except Exception as why:  # the other chunks' entries must not be lost with this one's failure
            error = str(why) or type(why).__name__
        return pd.DataFrame({"batch": [batch], "chunk": [chunk], "error": pd.Series([error], dtype=object)})

    told = written(pending(spark, folder).groupBy("batch", "chunk").applyInPandas(send, "batch long, chunk long, error string"))
    told.filter("error is null").select("batch", "chunk").write.mode("append").parquet(f"{folder}/ledger")
    failed = told.filter("error is not null").orderBy("batch", "chunk").limit(5).collect()
    if failed:
        raise RuntimeError("alerts were not delivered: " + "; ".join(f"chunk {r['batch']}-{r['chunk']}: {r['error']}" for r in failed))


def start(alerts: DataFrame, folder: str, post: Callable[[list[str], str], None], size: int = CHUNK) -> StreamingQuery:
    """Runs a stream of signature and body through the outbox in ``folder`` to the end of what there is."""

    def batch(rows: DataFrame, number: int) -> None:
        enqueue(rows, number, folder, size)
        deliver(rows.sparkSession, folder, post)

    return alerts.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
