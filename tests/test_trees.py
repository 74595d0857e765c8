"""Trees of any depth."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import graph


def test_leaves_of_a_long_chain(spark):
    n = 10_000
    tree = spark.range(n).select("id", F.array(F.col("id") + 1).alias("children"))
    roots = spark.createDataFrame([(0,), (n - 3,)], "id long")
    assert {tuple(r) for r in graph.tree_leaves(roots, tree).collect()} == {(0, n), (n - 3, n)}


def test_leaves_of_shared_cyclic_and_lone_nodes(spark):
    tree = spark.createDataFrame([(1, [2, 3]), (2, [4]), (3, [4, 5]), (5, []), (6, [7]), (7, [6, 8]), (9, None)], "id long, children array<long>")
    roots = spark.createDataFrame([(1,), (1,), (6,), (9,), (77,)], "id long")
    want = {(1, 4), (1, 5), (6, 8), (9, 9), (77, 77)}
    got = graph.tree_leaves(roots, tree).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert graph.tree_leaves(roots.limit(0), tree).collect() == []


def test_paths_of_any_depth_and_moved_subtrees(spark):
    n = 1000
    nodes = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("label"))
    more = spark.createDataFrame([(5000, 5001, "a"), (5001, 5000, "b"), (5002, 5001, "c"), (5003, 9999, "d"), (5004, None, "e")], nodes.schema)
    nodes = nodes.unionByName(more)
    paths = graph.taxonomy_paths(nodes)
    got = {r.id: (r.path, r.level) for r in paths.collect()}
    assert set(got) == {*range(n), 5004}
    assert got[n - 1] == (".".join(f"n{k}" for k in range(n)), n - 1) and got[5004] == ("e", 0)
    moved = {r.id: (r.path, r.level) for r in graph.reparented(nodes, paths, 990, 5004).collect()}
    assert moved[990] == ("e.n990", 1) and moved[999] == ("e." + ".".join(f"n{k}" for k in range(990, 1000)), 10)
    assert {k: v for k, v in moved.items() if k < 990 or k > 999} == {k: v for k, v in got.items() if k < 990 or k > 999}
    top = {r.id: (r.path, r.level) for r in graph.reparented(nodes, paths, 998, None).collect()}
    assert top[999] == ("n998.n999", 1)
    with pytest.raises(ValueError, match="CYCLE"):
        graph.reparented(nodes, paths, 5, 7)
