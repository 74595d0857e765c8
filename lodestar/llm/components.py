"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import dropped, written


#: Neighbours from which a node's smallest one is sent to all tasks instead of joined; at most MANY such nodes.
HOT, MANY = 100_000, 50_000


def _crowded(pairs: DataFrame, count: int) -> DataFrame | None:
    """Nodes u of so many pairs that their rows would be one task's load; none in small tables."""
    if count <= HOT:
        return None
    most = max(HOT, count // MANY)  # at most MANY nodes have more
    return written(pairs.groupBy("u").count().where(F.col("count") > most).select("u"), "crowded")


def _with_low(rows: DataFrame, low: DataFrame, crowded: DataFrame | None) -> DataFrame:
    """rows(u, ...) with u's low; crowded nodes' rows stay where they are."""
    if crowded is None:
        return rows.join(low, "u")
    few = F.broadcast(crowded)
    return rows.join(F.broadcast(low.join(few, "u", "left_semi")), "u").unionByName(rows.join(few, "u", "left_anti").join(low, "u"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node reachable.

    Large-star links every larger neighbour of a node to the node's smallest neighbour; small-star does so
    for the smaller ones. Both keep components and end in stars, after about log(diameter) rounds. Each
    round is written to the shared folder. Nodes are longs; self-loops keep a node alone; nulls are dropped.
    """
    e = written(edges.select("a", "b").where("a is not null and b is not null").distinct(), "edges")
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    links = e.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    count, held = e.count(), None
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        crowded = _crowded(both, 2 * count)
        low = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
        large = _with_low(both.where("v > u"), low, crowded).select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = _with_low(large, low, crowded).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        after = written(small, "star")
        dropped(held, crowded)
        # ended: each node has one parent and no parent has a parent
        loose = after.select(F.col("u").alias("p")).join(after.select(F.col("v").alias("p")), "p", "left_semi").limit(1)
        many = after.groupBy("u").count().where("count > 1").limit(1)
        links, held = after, after
        if loose.isEmpty() and many.isEmpty():
            break
        count = after.count()
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
