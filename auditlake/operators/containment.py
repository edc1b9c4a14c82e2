"""Which aliases texts contain, without comparing every text with every alias.

An alias meets the texts that hold its first letters anywhere: texts are cut into the runs of one to ``GRAM`` letters that
aliases begin with, and joined to the aliases by them. Candidates are then verified by the whole rule, so the keys only
decide what is looked at. Neither side is broadcast unless Spark finds it small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text

GRAM = 4


def _runs(low: Column, size: int) -> Column:
    """All runs of ``size`` letters of a text, once each."""
    last = F.length(low) - (size - 1)
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(low, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def named(texts: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """``texts`` with ``platform``, a row for each platform that the text names by an alias; blank aliases name nothing.

    ASCII aliases count as whole words, others anywhere, in lower case. Aliases: alias, platform.
    """
    low = F.lower("alias")
    keyed = aliases.filter(F.length("alias") > 0).select(F.col("alias").alias("__alias"), "platform", F.substring(low, 1, GRAM).alias("__key")).distinct()
    sizes = sorted(r[0] for r in keyed.select(F.length("__key")).distinct().collect())  # GRAM values at most
    rows = texts.filter(F.col(column).isNotNull()).distinct()
    own = F.lower(F.col(column))
    keys = F.flatten(F.array(*[_runs(own, n) for n in sizes])) if sizes else F.array().cast("array<string>")
    met = rows.withColumn("__key", F.explode(keys)).join(keyed, "__key")
    return met.filter(text.named_in(F.col(column), F.col("__alias"))).select(*texts.columns, "platform").distinct()
