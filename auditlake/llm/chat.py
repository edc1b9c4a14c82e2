"""Chat formatting that keeps only maximal conversations; DataFrame functions alone.

Chat logs often hold each growing state of a conversation as a conversation of its own. The turns of a conversation, in
the order of turn, role and the text's MD5, get a rolling hash: the sum of 128 bits of hash of each turn with its place,
up to that turn. A conversation whose last hash is the hash of another's earlier turn, at the same place, is a prefix of
it; an anti-join against those drops it. Of equal conversations the one with the smallest conv_id stays. What stays is
rendered by a template.

Texts are hashed before the first exchange, so only ids, places, roles and hashes are shuffled to find what stays; the
texts move once, to be rendered. Frequent first turns don't gather: hashes are made distinct before the anti-join, with
partial aggregation. A conversation's own turns meet in one task, as they end in one rendered text.

Defined results: null roles and texts are empty; null turns come first. A row without conv_id is a conversation of one
turn, equal ones are counted together before they meet, and of equal conversations one without conv_id stays before
others; repeated turns count as often as they occur; no rows give no rows. Marks of the template inside a text are kept
as they are: a reader who has to tell them apart gives a template of his own. Further columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a turn is rendered as, around its role and its text.
BEGIN, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    return rows.withColumn("hash", F.md5(F.col("text").cast("binary")))


def _numbers() -> list[Column]:
    """Twice 64 bits of the hash of a turn at its place, as numbers that can be summed exactly."""
    return [F.xxhash64(F.lit(half), "n", "role", "hash").cast("decimal(20,0)").alias(name) for half, name in enumerate("xy")]


def prefixes(conversations: DataFrame) -> DataFrame:
    """n (place of a turn, from 1), a and b (hash of the turns up to it), last (whether it ends), conv_id, copies, role and hash."""
    turns = _turns(conversations).drop("text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "hash")
    named = turns.filter("conv_id is not null").withColumn("n", F.row_number().over(order)).withColumn("last", F.lead("n").over(order).isNull())
    so_far = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    named = named.select("conv_id", "n", "last", F.lit(1).cast("long").alias("copies"), "role", "hash", *_numbers())
    named = named.withColumn("a", F.sum("x").over(so_far)).withColumn("b", F.sum("y").over(so_far))
    alone = turns.filter("conv_id is null").groupBy("conv_id", "role", "hash").agg(F.count("*").alias("copies"))
    alone = alone.select("conv_id", F.lit(1).alias("n"), F.lit(True).alias("last"), "copies", "role", "hash")
    alone = alone.select("*", *_numbers()).select("*", *[F.col(c).cast("decimal(30,0)").alias(s) for c, s in (("x", "a"), ("y", "b"))])
    return named.unionByName(alone).drop("x", "y")


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies (equal conversations, itself included) and ``only`` of every conversation that none continues.

    ``only`` is the role and hash of the one turn of a conversation without conv_id.
    """
    rows = prefixes(conversations)
    first = F.struct(F.col("conv_id").isNotNull().alias("named"), "conv_id", F.when(F.col("conv_id").isNull(), F.struct("role", "hash")).alias("only"))
    whole = rows.filter("last").groupBy("n", "a", "b").agg(F.min(first).alias("first"), F.sum("copies").alias("copies"))
    inner = rows.filter("not last").select("n", "a", "b").distinct()
    return whole.join(inner, ["n", "a", "b"], "left_anti").select("first.conv_id", F.col("n").cast("long").alias("n_turns"), "copies", "first.only")


def format_chats(conversations: DataFrame, begin: str = BEGIN, middle: str = MIDDLE, end: str = END) -> DataFrame:
    """conv_id, n_turns, copies and ``chat``, the rendered turns, of every maximal conversation."""
    turns, kept = _turns(conversations), maximal(conversations)
    shown = lambda t: F.concat(F.lit(begin), t["role"], F.lit(middle), t["text"], F.lit(end))
    named = turns.filter("conv_id is not null").join(kept.filter("conv_id is not null").drop("only"), "conv_id")
    named = named.groupBy("conv_id", "n_turns", "copies").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "hash", "text"))).alias("turns"))
    named = named.select("conv_id", "n_turns", "copies", F.concat_ws("", F.transform("turns", shown)).alias("chat"))
    alone = turns.filter("conv_id is null").groupBy("role", "hash").agg(F.max("text").alias("text"))
    alone = kept.filter("conv_id is null").select("conv_id", "n_turns", "copies", "only.*").join(alone, ["role", "hash"])
    return named.unionByName(alone.select("conv_id", "n_turns", "copies", shown({c: F.col(c) for c in ("role", "text")}).alias("chat")))
