"""Mixing sources to target weights by hierarchical budgets.

The corpus is a tree, by default domain, language, source. The total budget of tokens goes down it: a node's budget is
divided among its children by their weights, but no child gets more than its whole subtree can give
(tokens times ``max_epochs``); what it falls short goes to its siblings, in proportion to their weights, and only what
none of them can take shows in the ancestor's own limit, so that the ancestor's siblings take it. Each leaf then reads
its documents in a seeded order, a new one each epoch, as often as the budget lasts: whole epochs first, then the
longest prefix of the next epoch's order whose tokens fit.

The leaves' totals are one aggregation. Up to ``MAX_LEAVES`` of them, the budgets are computed on the driver and sent to
all tasks; beyond, by windows over the same tree. No order is computed over a whole leaf: hashes of doc_id and text deal
its documents to 4,096 slices in order; slice totals, summed before they are shuffled, tell which slice the prefix ends
in, and only that slice's rows are sorted. So a source with most of the rows costs one slice. All arithmetic is on whole
numbers; shares round down.

Defined results: tokens are runs of characters other than ASCII white space, null text has none; null levels are the
value ``(none)``; a value without a weight has weight 1, one of weight 0 gets nothing, nor does what is below it count
as able to give; documents without tokens come with the prefix they stand in; an empty corpus gives no rows. Rows that
repeat a doc_id are documents of their own; rows equal in doc_id and text stand side by side in the order.
Further columns are carried whatever their names, those named domain, n_tokens or epoch are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import carried, cut, words

#: Leaves that a plan on the driver may have; beyond, it is made and joined by shuffling.
MAX_LEAVES = 100_000
LEVELS = ("domain", "lang", "source")
Weights = Mapping[str, Mapping[str, int]]


def _decimal(column: Column) -> Column:
    return column.cast("decimal(19,0)")


def _weight(level: str, weights: Weights) -> Column:
    given = weights.get(level) or {}
    out = F.lit(1)
    for value, weight in sorted(given.items()):
        out = F.when(F.col(level) == value, F.lit(int(weight))).otherwise(out)
    return out.cast("long")


def _shares(total: int, families: Mapping[str, tuple[int, int]]) -> dict[str, int]:
    """Divides a budget among children of (capacity, weight): the full ones first, by capacity per weight."""
    given, left, weight = dict.fromkeys(families, 0), total, sum(w for _, w in families.values())
    order = sorted((v for v, (_, w) in families.items() if w > 0), key=lambda v: (families[v][0] / families[v][1], v))
    for n, value in enumerate(order):
        cap, own = families[value]
        if cap * weight > own * left:
            return given | {v: min(families[v][0], families[v][1] * left // weight) for v in order[n:]}
        given[value], left, weight = cap, left - cap, weight - own
    return given


def budgets(supply: Mapping[tuple, int], levels: Sequence[str], weights: Weights, total: int, max_epochs: int) -> dict[tuple, int]:
    """The tokens that each leaf is to give, for leaves named by their values of ``levels``."""
    weight = lambda depth, value: int((weights.get(levels[depth]) or {}).get(value, 1))
    able = {k: n * max_epochs if all(weight(d, v) > 0 for d, v in enumerate(k)) else 0 for k, n in supply.items()}
    cap: dict[tuple, int] = defaultdict(int)
    below: dict[tuple, set] = defaultdict(set)
    for key, most in able.items():
        for depth in range(len(levels) + 1):
            cap[key[:depth]] += most
            if depth < len(levels):
                below[key[:depth]].add(key[depth])
    out = {(): min(total, cap[()])}
    for depth in range(len(levels)):
        for node in [k for k in below if len(k) == depth]:
            shares = _shares(out[node], {v: (cap[*node, v], weight(depth, v)) for v in below[node]})
            out |= {(*node, v): n for v, n in shares.items()}
    return {k: out[k] for k in supply}


def leaf_budgets(leaves: DataFrame, levels: tuple[str, ...], weights: Weights, total: Column, max_epochs: int) -> DataFrame:
    """``budgets`` by windows: ``leaves`` (levels, supply) with ``budget``."""
    able = F.lit(True)
    for level in levels:
        able &= _weight(level, weights) > 0
    plan = leaves.withColumn("cap0", F.when(able, F.col("supply") * max_epochs).otherwise(F.lit(0)))
    everything = Window.partitionBy(F.lit(0))
    plan = plan.withColumn("budget", F.least(total, F.sum("cap0").over(everything)))
    for depth, level in enumerate(levels):
        upper, node = list(levels[:depth]), list(levels[: depth + 1])
        nodes = plan.groupBy(*node).agg(F.sum("cap0").alias("cap"), F.max("budget").alias("from")).withColumn("w", _weight(level, weights))
        family = Window.partitionBy(*upper) if upper else everything
        order = family.orderBy((F.col("w") == 0), F.col("cap").cast("double") / F.greatest(F.col("w"), F.lit(1)), level)
        before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        nodes = nodes.withColumn("left", F.col("from") - before).withColumn("rest_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        full = (F.col("w") > 0) & (_decimal(F.col("cap")) * _decimal(F.col("rest_w")) <= _decimal(F.col("w")) * _decimal(F.col("left")))
        nodes = nodes.withColumn("full", full)
        spent = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(family)
        open_w = F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("w"))).over(family)
        nodes = nodes.withColumn("open", F.col("from") - spent).withColumn("open_w", F.greatest(open_w, F.lit(1)))
        share = F.expr("cast(w as decimal(19,0)) * cast(open as decimal(19,0)) div cast(open_w as decimal(19,0))").cast("long")
        nodes = nodes.withColumn("given", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", share))).select(*node, "given")
        plan = plan.join(nodes, node).withColumn("budget", F.col("given")).drop("given")
    return plan.select(*levels, "supply", "budget")


def mix(
    docs: DataFrame,
    weights: Weights,
    domain: Column,
    share: tuple[int, int] = (1, 2),
    max_epochs: int = 2,
    seed: str = "mix",
    levels: tuple[str, ...] = LEVELS,
) -> DataFrame:
    """One row for each time a document is read: its columns, domain, n_tokens and epoch (from 1).

    ``share``: the total budget as a part of the corpus's tokens, numerator and denominator.
    """
    spark = docs.sparkSession
    keys = [f"__{x}" for x in levels]
    named = docs.withColumn("domain", domain)
    row = carried(docs, "domain", "n_tokens", "epoch")
    level = [F.coalesce(F.col(x).cast("string"), F.lit("(none)")).alias(k) for x, k in zip(levels, keys)]
    content = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = named.select(row, "domain", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), content).alias("__own"), words(F.col("text")).alias("n_tokens"), *level)
    slim = cut(rows.select("__own", "n_tokens", *keys))
    leaves = cut(slim.groupBy(*[F.col(k).alias(x) for x, k in zip(levels, keys)]).agg(F.sum("n_tokens").alias("supply")))
    few = leaves.count() <= MAX_LEAVES
    if few:
        supply = {tuple(r[:-1]): r["supply"] for r in leaves.collect()}
        given = budgets(supply, levels, weights, sum(supply.values()) * int(share[0]) // int(share[1]), max_epochs)
        plan = spark.createDataFrame([(*k, n, given[k]) for k, n in supply.items()], leaves.schema.add("budget", "long"))
    else:
        total = F.expr(f"cast(cast(sum(supply) over (partition by 0) as decimal(19,0)) * {int(share[0])} div {int(share[1])} as long)")
        plan = leaf_budgets(leaves.withColumn("__total", total), levels, weights, F.col("__total"), max_epochs)
    whole = F.when(F.col("supply") > 0, F.least(F.expr("budget div supply"), F.lit(max_epochs))).otherwise(F.lit(0)).cast("int")
    plan = plan.withColumn("__whole", whole).withColumn("__rest", F.col("budget") - F.col("__whole") * F.col("supply"))
    plan = plan.select(*[F.col(x).alias(k) for x, k in zip(levels, keys)], "__whole", "__rest")
    side = F.broadcast if few else (lambda df: df)

    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("__whole") + 1, "__own").cast("binary"))
    slices = slim.join(side(plan), keys).groupBy(*keys, F.substring(digest, 1, 3).alias("slice"), "__rest").agg(F.sum("n_tokens").alias("n"))
    along = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
    edges = slices.filter(F.col("before") + F.col("n") > F.col("__rest")).groupBy(*keys).agg(F.min(F.struct("slice", "before")).alias("edge"))
    plan = cut(plan.join(edges, keys, "left").select(*keys, "__whole", "__rest", F.coalesce("edge.slice", F.lit("g")).alias("__edge"), F.coalesce("edge.before", F.lit(0)).alias("__before")))

    rows = rows.join(side(plan), keys).withColumn("__h", digest)
    slice_of = F.substring("__h", 1, 3)
    clear = rows.filter(slice_of != F.col("__edge")).withColumn("__more", (slice_of < F.col("__edge")).cast("int"))
    order = Window.partitionBy(*keys).orderBy("__h", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    at_edge = rows.filter(slice_of == F.col("__edge")).withColumn("__more", (F.sum("n_tokens").over(order) + F.col("__before") <= F.col("__rest")).cast("int"))
    read = clear.unionByName(at_edge).withColumn("__n", F.col("__whole") + F.col("__more")).filter("__n > 0")
    return read.select("row.*", "domain", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("epoch"))
