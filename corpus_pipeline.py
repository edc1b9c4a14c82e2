"""From raw documents to a training mixture: five stages, each written as Parquet and read again.

The first four return the columns of documents: those that the quality classifier keeps, one document of each group of
near duplicates, those without a copied benchmark item, and these with secrets replaced. The last returns a row for
each time that a document is read in the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm import common, decontam, jaccard, quality, queries, secrets


#: Bytes that an Arrow batch brings into a Python worker: the stages share workers, which keep the most they ever held.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Smaller batches than the operators ask for by themselves; a session's own lower bound holds."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = (spark.conf.get(key, None) or "").removesuffix("b")
    if not own.isdigit() or not 0 < int(own) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return quality.keep_good(docs, queries.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return decontam.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return secrets.redact(docs, words=secrets.dictionary(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.mixture(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
]

#: SQL expresses neither the trained classifier nor the alignment; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    folder = common.scratch(spark, "corpus")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
