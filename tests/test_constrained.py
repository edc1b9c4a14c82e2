"""Unions that scopes can refuse, against the plain replay on random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from auditlake.operators import graph

NODES, EDGES = "node long, jurisdiction string, platform string", "a long, b long"


def replay(nodes, edges):
    parent = {n: n for n, *_ in nodes}
    scope = {n: ({j} - {None}, {p} - {None}) for n, j, p in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in sorted(set(edges)):
        a, b = root(a), root(b)
        merged = (scope[a][0] | scope[b][0], scope[a][1] | scope[b][1])
        if a != b and max(map(len, merged)) <= 1:
            parent[b], scope[a] = a, merged
    low = {}
    for n in sorted(parent):
        low.setdefault(root(n), n)
    return {n: low[root(n)] for n in parent}


def clusters(spark, nodes, edges, **options):
    found = graph.constrained(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), **options).collect()
    assert len(found) == len(nodes)
    return {r.node: r.cluster for r in found}


@pytest.mark.parametrize("seed, jurisdictions, platforms", [(1, ["eu", "us", None, None], [None]), (2, ["eu", "us", None], ["p", "q", None]), (3, ["eu", None, None, None], ["p", "q", None, None, None]), (4, [None, None, "eu", "us", "cn"], ["p", None])])
def test_random_graphs(spark, seed, jurisdictions, platforms):
    rng = random.Random(seed)
    nodes = [(n, rng.choice(jurisdictions), rng.choice(platforms)) for n in range(70)]
    edges = [tuple(sorted(rng.sample(range(70), 2))) for _ in range(90)]
    edges += edges[:5]
    want = replay(nodes, edges)
    # no link, some, and all of them in one task
    assert clusters(spark, nodes, edges, alone=12 * (seed % 2)) == want == clusters(spark, nodes, edges)


def test_one_scope_needs_no_replay(spark):
    """A large component with two scopes and many rows without one: rounds are few, and none is replayed."""
    rng = random.Random(8)
    nodes = [(n, ["eu", "us", None, None][n % 4], None) for n in range(1200)]
    edges = [(n, n + 1) for n in range(1199)] + [tuple(sorted(rng.sample(range(1200), 2))) for _ in range(600)]
    edges = [e for e in edges if e[0] % 7 or e[1] % 7]
    rounds = []
    assert clusters(spark, nodes, edges, alone=50, rounds=rounds) == replay(nodes, edges) and len(rounds) <= 4


def test_without_links(spark):
    assert clusters(spark, [(3, "eu", None), (4, None, "p")], [], alone=0) == {3: 3, 4: 4}
    assert graph.constrained(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)).collect() == []


@pytest.mark.parametrize("alone", [0, 1000])
def test_components(spark, alone):
    rng = random.Random(4)
    edges = [(n, n + 1) for n in range(100, 120)] + [tuple(rng.sample(range(60), 2)) for _ in range(40)] + [(7, 7)]
    nodes = spark.range(130).select(F.col("id").alias("node"))
    found = {r.node: r.component for r in graph.components(nodes, spark.createDataFrame(edges, EDGES), alone).collect()}
    assert found == replay([(n, None, None) for n in range(130)], edges)
