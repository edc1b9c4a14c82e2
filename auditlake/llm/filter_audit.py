"""Filter interaction audit: what each of five filters removes, in every order of the five.

Each document's failures form a mask of five bits; documents are counted by part and mask, and the 120 orders are
worked out on these counts alone (at most 32 rows a part), against a fixed table of what each mask does in each step.

Copies (filter E) are found by refining a partition: documents are split by length in code points, then by the hashes
of successive blocks of text; after each split, classes in which all rows share one id are dropped, so later splits see
fewer rows, and none sees a text. Of the classes left the full texts are compared: equal texts are aggregated, by tasks
before any exchange, to the smallest id, and every row with a larger one is a copy. Where a class holds different texts
all the same (equal hashes by chance), its rows are matched by their texts. Classes are counted with partial sums in each
task; rows meet a table with one row a class, in joins whose large partitions Spark divides.

Defined results: a null text is empty, a null lang is the part ''. A row without doc_id fails E never and makes no other
fail it, as null is neither smaller nor larger. Rows that repeat an id count each; equal ids are no copies of each other.
A document has a label where any row of labels says so. An empty table gives no rows; each part gives all 600.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import stored

FILTERS = "ABCDE"
#: Code points of the first and second block that are hashed; the rest is the third.
BLOCKS = (64, 4096)
WORD = r"[^\x20\x09-\x0D]+"
KEY = ("length", "block1", "block2", "block3")


def block_hashes(text: Column, hashed=F.xxhash64) -> list[Column]:  # noqa: ANN001
    first, second = BLOCKS
    rest = F.substring(text, first + second + 1, 2**31 - 1)
    return [F.char_length(text).alias("length"), *[hashed(c).alias(f"block{n}") for n, c in enumerate((F.substring(text, 1, first), F.substring(text, first + 1, second), rest), 1)]]


def measured(docs: DataFrame, hashed=F.xxhash64) -> DataFrame:  # noqa: ANN001
    """doc_id, part, the mask of the first four filters, the keys of the partition, and the text."""
    text = F.col("text")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", words.alias("words"), F.regexp_count(text, F.lit("[A-Z]")).alias("capitals"), *block_hashes(text, hashed))
    rows = rows.select("*", F.size("words").cast("long").alias("n"), F.size(F.array_distinct("words")).cast("long").alias("distinct"))
    fails = (F.col("n") < 100, 100 * F.col("distinct") < 80 * F.col("n"), 100 * F.col("capitals").cast("long") > 10 * F.col("length").cast("long"), text.rlike("[#$%&*|]"))
    mask = sum((F.when(f, 1 << bit).otherwise(0) for bit, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", mask.alias("mask"), *KEY, "text")


def refined(rows: DataFrame) -> DataFrame:
    """The keys of the classes that hold rows of different ids after every split."""
    left = rows.filter("doc_id is not null").select("doc_id", *KEY)
    for depth in range(1, len(KEY) + 1):
        key = list(KEY[:depth])
        classes = left.groupBy(*key).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select(*key)
        if depth == len(KEY):
            return classes
        left = left.join(classes, key, "left_semi")
    raise AssertionError


def copies_marked(spark: SparkSession, docs: DataFrame, hashed=F.xxhash64) -> DataFrame:  # noqa: ANN001
    """doc_id, part and the whole mask of each document."""
    rows = stored(measured(docs, hashed).drop("text"), "measured")
    classes = stored(refined(rows), "classes")
    texts = docs.filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = texts.select("*", *block_hashes(F.col("text"), hashed)).join(classes, list(KEY), "left_semi")
    by_text = whole.groupBy(*KEY, "text").agg(F.min("doc_id").alias("low"))
    found = stored(by_text.groupBy(*KEY).agg(F.count("*").alias("texts"), F.min("low").alias("low")), "compared")
    copy = F.when(F.col("doc_id") > F.col("low"), 1 << 4).otherwise(0)
    mixed = found.filter("texts > 1").select(*KEY)
    plain = rows.join(found.filter("texts = 1").select(*KEY, "low"), list(KEY), "left")
    if not mixed.isEmpty():  # classes whose hashes agree by chance: their rows are matched by their texts
        again = measured(docs, hashed).join(mixed, list(KEY), "left_semi")
        low = again.filter("doc_id is not null").groupBy("text").agg(F.min("doc_id").alias("low"))
        plain = plain.join(mixed, list(KEY), "left_anti").select("doc_id", "part", "mask", "low").unionByName(again.join(low, "text", "left").select("doc_id", "part", "mask", "low"))
    return plain.select("doc_id", "part", (F.col("mask") + copy).alias("mask"))


def steps(spark: SparkSession) -> DataFrame:
    """For each order, step and mask: which of the counts a document with that mask adds to. A fixed table of 19,200 rows."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            for mask in range(1 << len(FILTERS)):
                fails, gone = mask >> f & 1, mask & before != 0
                share = 120 // mask.bit_count() if fails else 0  # in so many of the orders f is the first that fails
                rows.append((mask, name, step, int(not gone and not fails), int(not gone and fails), int(gone and fails), int(mask == 1 << f), share))
            before |= 1 << f
    return spark.createDataFrame(rows, "mask int, filter_order string, step int, kept int, removed int, redundant int, unique_fails int, shapley int")


def audit(docs: DataFrame, labels: DataFrame, hashed=F.xxhash64) -> DataFrame:  # noqa: ANN001
    """A row for each part, order of the filters and step, with the counts of that step."""
    spark = docs.sparkSession
    marked = copies_marked(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), hashed)
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic"))
    counts = marked.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    effects = counts.join(F.broadcast(steps(spark)), "mask")
    add = lambda effect, n="n": F.coalesce(F.sum(F.col(effect) * F.coalesce(n, F.lit(0))), F.lit(0)).cast("long")
    return effects.groupBy("part", "filter_order", "step").agg(
        add("kept").alias("kept"), add("removed").alias("removed"), add("redundant").alias("redundant"), add("unique_fails").alias("unique_fails"),
        add("removed", "good").alias("good_lost"), add("removed", "toxic").alias("toxic_lost"), add("shapley").alias("shapley"),
    )
