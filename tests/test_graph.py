import math
import os
import random

import pytest
from pyspark.sql import functions as F

from codestrata.operators import graph


def _components(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def _strong(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                changed = True
    groups = {frozenset(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    return {g for g in groups if len(g) > 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(80)] + [(i, i + 1) for i in range(200, 230)] + [(500, n) for n in range(501, 540)]
    want = _components([e for e in edges if e[0] != e[1]])
    got = graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == want


@pytest.fixture
def wide(spark):
    """Sixteen shuffle tasks that adaptive execution leaves as they are, and no broadcast."""
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_hub_is_spread_over_tasks(wide):
    edges = wide.range(40_000).selectExpr("20000 as u", "id as v")
    placed = graph.with_least(edges, ["u"], "v", "m")
    sizes = sorted(r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect())
    assert sum(sizes) == 40_000 and len(sizes) >= 12 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    assert [tuple(r) for r in placed.select("m").distinct().collect()] == [(0,)]
    got = graph.connected_components(edges)
    assert got.count() == 40_000 and [r.component for r in got.select("component").distinct().collect()] == [0]


def test_least_keeps_repeated_rows_and_further_columns(spark):
    rows = [("a", 1, 5, "x"), ("a", 1, 5, "x"), ("a", 1, 3, "y"), ("a", 2, 9, None)]
    got = graph.with_least(spark.createDataFrame(rows, "k string, l int, v int, t string"), ["k", "l"], "v", "m").collect()
    assert sorted((r.l, r.v, r.t or "", r.m) for r in got) == [(1, 3, "y", 3), (1, 5, "x", 3), (1, 5, "x", 3), (2, 9, "", 9)]


def test_strong_components(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(30):02}", f"n{rng.randrange(30):02}") for _ in range(45)] + [("a", "b"), ("b", "c"), ("c", "a"), ("c", "x"), ("x", "y")]
    got = {}
    for r in graph.strong_components(spark.createDataFrame(edges, "source string, target string")).collect():
        got.setdefault(r.component, set()).add(r.node)
    assert {frozenset(g) for g in got.values() if len(g) > 1} == _strong([e for e in edges if e[0] != e[1]])


def test_no_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    assert graph.strong_components(edges).count() == 0


@pytest.mark.parametrize("count", [64, pytest.param(1000, marks=pytest.mark.skipif("CHECK_ALL" not in os.environ, reason="long; CHECK_ALL=1 runs it"))])
def test_rounds_grow_with_the_logarithm_of_a_chain_of_cycles(spark, count):
    edges = [e for k in range(count) for e in ((2 * k, 2 * k + 1), (2 * k + 1, 2 * k), (2 * k + 1, 2 * k + 2))]
    rounds = []
    got = {}
    for r in graph.strong_components(spark.createDataFrame(edges, "source long, target long"), rounds).collect():
        got.setdefault(r.component, set()).add(r.node)
    assert got == {2 * k + 1: {2 * k, 2 * k + 1} for k in range(count)}
    assert len(rounds) <= 1.6 * math.log2(count) and max(rounds) <= 4 * math.log2(count)


def test_one_long_ring_is_one_round(spark):
    edges = [(k, (k + 1) % 300) for k in range(300)] + [(k, 1000 + k) for k in range(50)] + [(7, 7)]
    rounds = []
    got = graph.strong_components(spark.createDataFrame(edges, "source long, target long"), rounds).collect()
    assert {(r.node, r.component) for r in got} == {(k, 299) for k in range(300)} and len(rounds) == 1


def test_rings_of_rings_are_contracted_without_colours(spark, monkeypatch):
    """Eighty rings of orders, some orders rings of their own, in at most three rounds, and paths between rings belong to none."""
    monkeypatch.setattr(graph, "_coloured", None)
    rng, edges = random.Random(3), []
    for ring in range(80):
        orders = [[f"r{ring}.{k}.{line}" for line in range(rng.randrange(1, 6))] for k in range(rng.randrange(2, 8))]
        edges += [pair for o in orders for pair in zip(o, o[1:])] + [(a[-1], b[0]) for a, b in zip(orders, orders[1:])]
        edges += [(o[-1], o[0]) for o in orders if rng.random() < 0.5]
        if ring % 2:
            edges.append((orders[-1][-1], orders[0][0]))
    rounds, got = [], {}
    for r in graph.strong_components(spark.createDataFrame(edges, "source string, target string"), rounds).collect():
        got.setdefault(r.component, set()).add(r.node)
    assert {max(g): g for g in got.values()} == got
    assert {frozenset(g) for g in got.values()} == _strong([e for e in edges if e[0] != e[1]])
    assert len(rounds) <= 3


@pytest.mark.parametrize("seed", range(3))
def test_strong_components_of_sparse_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(75)] + [(100 + k, 100 + (k + 1) % 9) for k in range(9)] + [(108, 200), (200, 201), (201, 300), (300, 301), (301, 300)]
    got = {}
    for r in graph.strong_components(spark.createDataFrame(edges, "source long, target long")).collect():
        got.setdefault(r.component, set()).add(r.node)
    assert {max(g): g for g in got.values()} == got
    assert {frozenset(g) for g in got.values()} == _strong([e for e in edges if e[0] != e[1]])
