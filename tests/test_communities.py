"""Modularity communities against planted partitions and, on small graphs, all partitions."""

import itertools

import numpy as np
import pytest

from lodestar.operators.communities import modular_communities, modularity


def quality(edges, label):
    m = 2 * sum(w for _, _, w in edges)
    inner = sum(2 * w for a, b, w in edges if label[a] == label[b])
    k = {}
    for a, b, w in edges:
        k[label[a]] = k.get(label[a], 0) + w
        k[label[b]] = k.get(label[b], 0) + w
    return inner / m - sum(x * x for x in k.values()) / m**2


def found(spark, edges):
    d = spark.createDataFrame(edges, "src long, dst long, weight double")
    return {r.node: r.community for r in modular_communities(d).collect()}


def connected(edges, label):
    for c in set(label.values()):
        mine = {n for n in label if label[n] == c}
        seen, work = set(), [min(mine)]
        while work:
            x = work.pop()
            if x not in seen:
                seen.add(x)
                work += [b if a == x else a for a, b, _ in edges if x in (a, b) and {a, b} <= mine]
        if seen != mine or c != min(mine):
            return False
    return True


@pytest.mark.parametrize("groups, size, seed", [(4, 8, 1), (6, 5, 2)])
def test_planted_groups_are_found(spark, groups, size, seed):
    rng = np.random.default_rng(seed)
    n = groups * size
    edges = [(a, b, 1.0) for a, b in itertools.combinations(range(n), 2) if rng.random() < (0.8 if a // size == b // size else 0.04)]
    label = found(spark, edges)
    assert quality(edges, label) >= quality(edges, {k: k // size for k in range(n)}) - 1e-9
    assert connected(edges, label)
    d = spark.createDataFrame(edges, "src long, dst long, weight double")
    labels = spark.createDataFrame(list(label.items()), "node long, community long")
    assert modularity(d, labels).head()[0] == pytest.approx(quality(edges, label), abs=1e-6)
    assert found(spark, edges[::-1]) == label  # deterministic, whatever the order


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for k in range(len(rest)):
            yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]


def test_small_graphs_come_near_the_best_partition(spark):
    rng = np.random.default_rng(4)
    edges = [(a, b, float(rng.integers(1, 4))) for a, b in itertools.combinations(range(8), 2) if rng.random() < 0.4]
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    best = max(quality(edges, {x: k for k, p in enumerate(ps) for x in p}) for ps in partitions(nodes))
    assert quality(edges, found(spark, edges)) >= best - 0.02


def test_odd_edges(spark):
    d = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (3, 3, 5.0), (4, 5, -1.0), (None, 1, 1.0), (6, 7, None)], "src long, dst long, weight double")
    assert {(r.node, r.community) for r in modular_communities(d).collect()} == {(1, 1), (2, 1)}
    assert modular_communities(d.limit(0)).collect() == []
