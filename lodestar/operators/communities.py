"""Communities by modularity: distributed local moving, refinement and contraction, level by level.

A level's nodes move to the neighbouring community of greatest gain, half of them (by hash) at a time, so that two nodes
don't swap for ever. Each community is then refined from single nodes, merging inside it only, the refined parts become the
nodes of the next level, and their communities its start. Everything is joins and aggregations over edge and node tables;
every round is written, and the driver sees counts and sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar import storage
from lodestar.operators.graph import undirected

#: Gains and modularities nearer than this are equal.
EPSILON = 1e-9
#: Rounds without movers or gain after which a level is done: either half of the nodes had its turn.
PATIENCE = 2


def _scored(edges: DataFrame, nodes: DataFrame, total: float, resolution: float, within: bool) -> DataFrame:
    """nodes(node, k, self, c, home) with w_own, the weight into their own community, and the best community `to` with its
    `gain` over staying. within: only communities of the same home are entered."""
    placed = nodes.select(F.col("node").alias("b"), F.col("c").alias("into"), F.col("home").alias("__h"))
    e = edges.join(placed, "b")
    if within:
        e = e.join(nodes.select(F.col("node").alias("a"), F.col("home").alias("__g")), "a").where("__g = __h")
    votes = e.groupBy(F.col("a").alias("node"), "into").agg(F.sum("w").alias("w"))
    votes = votes.unionByName(nodes.select("node", F.col("c").alias("into"), F.lit(0.0).alias("w"))).groupBy("node", "into").agg(F.sum("w").alias("w"))
    sizes = nodes.groupBy(F.col("c").alias("into")).agg(F.sum("k").alias("held"))
    v = votes.join(sizes, "into").join(nodes, "node")
    stays = F.col("into") == F.col("c")
    value = F.col("w") - F.lit(resolution / total) * F.col("k") * (F.col("held") - F.when(stays, F.col("k")).otherwise(0.0))
    v = v.withColumn("value", F.round(value, 9))
    best = F.max(F.struct("value", stays.alias("stays"), F.negative("into").alias("neg")))
    out = v.groupBy("node", "k", "self", "c", "home").agg(best.alias("x"), F.max(F.when(stays, F.col("w"))).alias("w_own"), F.max(F.when(stays, F.col("value"))).alias("stay"))
    return out.select("node", "k", "self", "c", "home", "w_own", F.negative("x.neg").alias("to"), (F.col("x.value") - F.col("stay")).alias("gain"))


def _quality(scored: DataFrame, total: float, resolution: float) -> float:
    inside = scored.agg(F.sum(F.col("w_own") + F.col("self"))).head()[0] or 0.0
    squares = scored.groupBy("c").agg(F.sum("k").alias("K")).agg(F.sum(F.col("K") * F.col("K"))).head()[0] or 0.0
    return inside / total - resolution * squares / total**2


def _moved(edges: DataFrame, nodes: DataFrame, total: float, resolution: float, rounds: int, within: bool) -> DataFrame:
    """nodes with c after up to so many rounds; the best assignment seen."""
    best, best_q, idle = nodes, None, 0
    for k in range(rounds + 1):
        scored = storage.kept(_scored(edges, nodes, total, resolution, within), "scored")
        q = _quality(scored, total, resolution)
        if best_q is None or q > best_q + EPSILON:
            best, best_q, idle = nodes, q, 0
        else:
            idle += 1
        wants = (F.col("gain") > EPSILON) & (F.pmod(F.xxhash64("node", F.lit(k // 2)), F.lit(2)) == k % 2)
        if k == rounds or idle >= PATIENCE or scored.where(F.col("gain") > EPSILON).isEmpty():
            break
        nodes = scored.select("node", "k", "self", F.when(wants, F.col("to")).otherwise(F.col("c")).alias("c"), "home")
    return best


def _contracted(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of the communities c of nodes; their homes become their communities."""
    name = nodes.select("node", "c")
    e = edges.join(name.withColumnsRenamed({"node": "a", "c": "ca"}), "a").join(name.withColumnsRenamed({"node": "b", "c": "cb"}), "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w"))
    e = storage.kept(e, "edges")
    inner = e.where("a = b").select(F.col("a").alias("c"), F.col("w").alias("inner"))
    n = nodes.groupBy("c").agg(F.sum("k").alias("k"), F.sum("self").alias("self"), F.min("home").alias("home"))
    n = n.join(inner, "c", "left").select(F.col("c").alias("node"), "k", (F.col("self") + F.coalesce("inner", F.lit(0.0))).alias("self"), "home")
    # a community is called after its least node
    low = n.groupBy("home").agg(F.min("node").alias("c"))
    return e.where("a <> b"), storage.kept(n.join(low, "home").select("node", "k", "self", "c", F.col("c").alias("home")), "nodes")


def _whole(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes with communities split into their connected parts, each named by its least node: labels spread along edges
    and by pointers to labels' labels, so rounds grow with the logarithm of a part's width."""
    inner = edges.join(nodes.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(nodes.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb").select("a", "b")
    inner = storage.kept(inner, "inner")
    label = nodes.select("node", F.col("node").alias("l"))
    while True:
        near = inner.join(label.select(F.col("node").alias("b"), "l"), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("m"))
        step = label.join(near, "node", "left").select("node", F.least("l", "m").alias("l"), F.col("l").alias("was"))
        jump = step.select(F.col("node").alias("l"), F.col("l").alias("far"))
        after = storage.kept(step.join(jump, "l", "left").select("node", F.least("l", "far").alias("l"), "was"), "labels")
        label = after.select("node", "l")
        if after.where("l <> was").isEmpty():
            return nodes.drop("c").join(label.withColumnRenamed("l", "c"), "node")


def modular_communities(edges: DataFrame, resolution: float = 1.0, levels: int = 10, rounds: int = 12) -> DataFrame:
    """(node, community) of edges(src, dst, weight): a partition of high modularity whose communities are connected.

    Directions and repeated edges add up, self-loops don't count, weights that aren't positive and null ends are left out;
    a community is named by its least node. Deterministic. No edges give no nodes. levels and rounds bound the work of a
    run, not the size of what it finds: the best partition seen is returned.
    """
    sound = edges.where("weight > 0 AND src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst", F.col("weight").cast("double").alias("weight"))
    both = sound.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w")).unionByName(sound.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("weight").alias("w")))
    first = storage.kept(both.groupBy("a", "b").agg(F.round(F.sum("w"), 9).alias("w")), "edges")
    total = first.agg(F.sum("w")).head()[0]
    if not total:
        return first.select(F.col("a").alias("node"), F.col("a").alias("community"))
    e, nodes = first, storage.kept(first.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).select("node", "k", F.lit(0.0).alias("self"), F.col("node").alias("c"), F.col("node").alias("home")), "nodes")
    start = nodes
    members = nodes.select("node", F.col("node").alias("at"))
    for _ in range(levels):
        moved = _moved(e, nodes, total, resolution, rounds, False)
        found = storage.kept(_whole(e, moved), "found")
        labels = members.join(found.select(F.col("node").alias("at"), F.col("c").alias("community")), "at")
        if found.where("node <> c").isEmpty():
            break
        single = found.select("node", "k", "self", F.col("node").alias("c"), F.col("c").alias("home"))
        refined = storage.kept(_whole(e, _moved(e, single, total, resolution, max(1, rounds // 2), True)), "refined")
        if refined.where("node <> c").isEmpty():  # nothing to merge inside: contract the communities themselves
            refined = found.select("node", "k", "self", "c", F.col("c").alias("home"))
        members = storage.kept(members.join(refined.select(F.col("node").alias("at"), "c"), "at").select("node", F.col("c").alias("at")), "members")
        e, nodes = _contracted(e, refined)
    low = labels.groupBy("community").agg(F.min("node").alias("low"))
    named = storage.kept(labels.join(low, "community").select("node", F.col("low").alias("community")), "communities")
    # contraction keeps parts together that share no edge any more: communities of the graph itself are connected
    parts = _whole(first, start.drop("c").join(named.withColumnRenamed("community", "c"), "node"))
    return storage.kept(parts.select("node", F.col("c").alias("community")), "communities")


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity, communities) of labels(node, community) over edges(src, dst, weight), counted as above."""
    sound = edges.where("weight > 0 AND src <> dst").select("src", "dst", F.col("weight").cast("double").alias("weight"))
    both = undirected(sound.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight")))
    x = both.join(labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    per = x.groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inner"))
    m = F.sum("k")
    return per.agg(F.round(F.sum("inner") / m - resolution * F.sum(F.col("k") * F.col("k")) / (m * m), 6).alias("modularity"), F.count("*").alias("communities"))
