"""Clusters of linked rows: plain components, and unions that scopes can refuse."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators.common import written

#: So many links that are left are replayed by one task.
ALONE = 100_000


def _joined(edges: DataFrame) -> DataFrame:
    """``node`` and ``low``, the smallest node that a bounded number of edges leads to, in one task."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(n: int) -> int:
            while parent.setdefault(n, n) != n:
                parent[n] = n = parent[parent[n]]
            return n

        for rows in batches:
            for a, b in rows.itertuples(index=False):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        yield pd.DataFrame([(n, root(n)) for n in parent], columns=["node", "low"])

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).coalesce(1).mapInPandas(go, "node long, low long")


def components(nodes: DataFrame, edges: DataFrame, alone: int = ALONE) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for each node; edges are pairs (a, b) of nodes.

    Labels shrink to the smallest neighbour's label and then jump to their label's label, so that chains halve. At most
    ``alone`` edges are joined by one task.
    """
    edges = written(edges.select("a", "b"))  # links may be costly to find: once
    if edges.count() <= alone:
        return nodes.select("node").join(_joined(edges), "node", "left").select("node", F.coalesce("low", "node").alias("component"))
    both = written(edges.union(edges.select("b", "a")).distinct())
    labels = written(nodes.select("node", F.col("node").alias("component")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        low = labels.join(near, labels.node == near.a, "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = low.select(F.col("node").alias("n"), F.col("low").alias("further"))
        nxt = written(low.join(jump, low.low == jump.n, "left").select("node", F.least("low", F.coalesce("further", "low")).alias("nxt"), "component"))
        if nxt.filter("nxt <> component").isEmpty():
            return nxt.select("node", F.col("nxt").alias("component"))
        labels = nxt.select("node", F.col("nxt").alias("component"))


def _replayed(links: DataFrame) -> DataFrame:
    """``q`` and ``head`` after the unions of a bounded number of links, in their order, in one task."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches, ignore_index=True).sort_values(["a", "b"])
        parent: dict[int, int] = {}
        scope: dict[int, tuple[set, set]] = {}

        def root(n: int) -> int:
            while parent[n] != n:
                parent[n] = n = parent[parent[n]]
            return n

        for x, y, jx, px, jy, py in rows[["x", "y", "jx", "px", "jy", "py"]].itertuples(index=False):
            for q, j, p in ((x, jx, px), (y, jy, py)):
                if q not in parent:
                    parent[q], scope[q] = q, ({j} - {None}, {p} - {None})
            x, y = root(x), root(y)
            merged = (scope[x][0] | scope[y][0], scope[x][1] | scope[y][1])
            if x != y and max(map(len, merged)) <= 1:
                parent[y], scope[x] = x, merged
        yield pd.DataFrame([(q, root(q)) for q in parent], columns=["q", "head"])

    return links.select("x", "y", "a", "b", "jx", "px", "jy", "py").coalesce(1).mapInPandas(go, "q long, head long")


def constrained(nodes: DataFrame, edges: DataFrame, alone: int = ALONE, rounds: list | None = None) -> DataFrame:
    """``node`` and ``cluster`` (its smallest node): unions in order of (a, b), each refused if it would mix two known scopes.

    ``nodes``: node, jurisdiction, platform (null if unknown). A component with one known jurisdiction and one platform at
    most refuses nothing, so it is a cluster; of the two scopes only one that a component has several values of can refuse.
    In mixed components, the unions that are sure whatever the others do are carried out together, round by round:

    * between groups with known and equal scopes, as each stays what it is; between known and different ones none is;
    * of a group with no known scope along its earliest link, as it is still alone then and cannot be refused;
    * of a partly known group along its earliest link, if the other is fully known or has the same earliest link.

    Groups without a scope halve with each round. Of links between the same two groups only the earliest counts, since a
    refused union stays refused. Links that are left are replayed by one task once they are at most ``alone``. ``rounds``,
    where given, receives the number of links before each round.
    """
    edges = written(edges.select("a", "b"))
    whole = components(nodes.select("node"), edges, alone)
    several = lambda c: F.coalesce(F.min(c) < F.max(c), F.lit(False))
    mixed = written(nodes.join(whole, "node").groupBy("component").agg(several("jurisdiction").alias("by_j"), several("platform").alias("by_p")).filter("by_j or by_p"))
    plain = whole.join(mixed, "component", "left_anti").select("node", F.col("component").alias("cluster"))
    # a scope that cannot refuse counts as known and equal
    matters = lambda by, c: F.when(F.col(by), F.col(c)).otherwise("")
    members = nodes.join(whole, "node").join(mixed, "component").select("node", matters("by_j", "jurisdiction").alias("j"), matters("by_p", "platform").alias("p"))
    labels = written(members.select("node", F.col("node").alias("q"), "j", "p"))
    links = edges.join(labels.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("a").alias("x"), F.col("b").alias("y"), "a", "b")
    while True:
        scopes = labels.groupBy("q").agg(F.max("j").alias("j"), F.max("p").alias("p"))
        of = lambda side: scopes.select(F.col("q").alias(side), F.col("j").alias(f"j{side}"), F.col("p").alias(f"p{side}"))
        links = links.filter("x <> y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min(F.struct("a", "b")).alias("o")).select("x", "y", "o.a", "o.b")
        links = written(links.join(of("x"), "x").join(of("y"), "y").filter("coalesce(jx = jy, true) and coalesce(px = py, true)"))
        many = links.count()
        if not many:
            break
        if rounds is not None:
            rounds.append(many)
        if many <= alone:
            heads = _replayed(links)
        else:
            ends = links.select(F.col("x").alias("q"), "a", "b").union(links.select(F.col("y").alias("q"), "a", "b"))
            first = written(ends.groupBy("q").agg(F.min(F.struct("a", "b")).alias("o")).select("q", "o.a", "o.b"))
            is_first = lambda side: first.select(F.col("q").alias(side), "a", "b", F.lit(True).alias(f"first_{side}"))
            near = links.join(is_first("x"), ["x", "a", "b"], "left").join(is_first("y"), ["y", "a", "b"], "left").fillna(False, ["first_x", "first_y"])
            known = lambda s: f"(j{s} is not null and p{s} is not null)"
            # what counts as known and equal says nothing of a group
            none = lambda s: f"(coalesce(j{s}, '') = '' and coalesce(p{s}, '') = '')"
            sure = near.filter(f"{known('x')} and {known('y')} or first_x and ({none('x')} or {known('y')}) or first_y and ({none('y')} or {known('x')}) or first_x and first_y")
            sure = written(sure.select(F.col("x").alias("a"), F.col("y").alias("b")))
            heads = components(sure.select(F.col("a").alias("node")).union(sure.select(F.col("b").alias("node"))).distinct(), sure, alone).select(F.col("node").alias("q"), F.col("component").alias("head"))
        heads = written(heads)
        moved = F.coalesce("head", "q").alias("q")
        labels = written(labels.join(heads, "q", "left").select("node", moved, "j", "p"))
        if many <= alone:
            break
        to = lambda side: heads.select(F.col("q").alias(side), F.col("head").alias(f"to_{side}"))
        links = links.join(to("x"), "x", "left").join(to("y"), "y", "left").select(F.coalesce("to_x", "x").alias("x"), F.coalesce("to_y", "y").alias("y"), "a", "b")
    smallest = labels.groupBy("q").agg(F.min("node").alias("cluster"))
    return plain.unionByName(labels.join(smallest, "q").select("node", "cluster"))
