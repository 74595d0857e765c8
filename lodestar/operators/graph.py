"""Graph and tree operators over edge tables: hops with one row kept for each node, trees of any depth by doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar import storage


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions, so that touching either end is an equi-join."""
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), *[c for c in edges.columns if c not in ("src", "dst")])
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), *[c for c in edges.columns if c not in ("src", "dst")])
    return e.unionByName(back).where("a <> b").distinct()


def multi_hop(anchors: DataFrame, edges: DataFrame, hops: int = 2, decay: float = 0.82, n: int = 36) -> DataFrame:
    """(node, hop, score): anchors(node, score) spread along undirected edges, times decay for each hop.

    Only a node's best score matters and decay never raises one, so each hop keeps the best row of a node:
    rows never exceed nodes, whatever the number of paths.
    """
    decay = min(1.0, max(0.0, decay))
    # repeated edges don't change a node's best score, so they needn't be shuffled away
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).where("a <> b")
    best = anchors.groupBy("node").agg(F.max("score").alias("score")).withColumn("hop", F.lit(0))
    reached, front = best, best
    for h in range(1, max(0, hops) + 1):
        step = front.join(e, front["node"] == e["a"]).groupBy(F.col("b").alias("node")).agg(F.round(F.max("score") * decay, 9).alias("score"))
        front = step.withColumn("hop", F.lit(h))
        reached = reached.unionByName(front)
    w = Window.partitionBy("node").orderBy(F.desc("score"), "hop")
    one = reached.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return one.select("node", "hop", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "hop", "node").limit(n)


def weighted_paths(start, edges: DataFrame, depth: int = 5, relations: tuple[str, ...] = ()) -> DataFrame:
    """(node, depth, weight, path): directed simple paths from start; weights multiply."""
    e = edges.where(F.col("relation").isin(list(relations))) if relations else edges
    e = e.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), F.col("weight").alias("__w"))
    front = e.where(F.col("__s") == F.lit(start)).select(F.col("__d").alias("node"), F.lit(1).alias("depth"), F.col("__w").cast("double").alias("weight"), F.array("__s", "__d").alias("path"))
    front = front.where(F.col("node") != F.lit(start))
    out = front
    for d in range(2, depth + 1):
        front = front.join(e, front["node"] == e["__s"]).where(~F.array_contains("path", F.col("__d"))).select(F.col("__d").alias("node"), F.lit(d).alias("depth"), (F.col("weight") * F.col("__w")).alias("weight"), F.array_append("path", F.col("__d")).alias("path"))
        out = out.unionByName(front)
    return out


def overrides(nodes: DataFrame, edges: DataFrame, relation: str) -> DataFrame:
    """nodes with the ids that override them and whether any does."""
    o = edges.where(F.col("relation") == relation).groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("override_ids"))
    j = nodes.join(o, "id", "left")
    return j.withColumn("override_ids", F.coalesce("override_ids", F.array().cast("array<bigint>"))).withColumn("has_overrides", F.size("override_ids") > 0)


def guided_search(chunk_scores: DataFrame, edges: DataFrame, boosts: dict[str, float], n: int) -> DataFrame:
    """(id, score): anchors (id, score) lend their score times edge weight and relation boost to neighbours."""
    boost = F.create_map(*(F.lit(x) for kv in boosts.items() for x in kv))[F.col("relation")]
    near = chunk_scores.join(edges.where(F.col("relation").isin(list(boosts))), F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("score") * F.col("weight") * boost).alias("score"))
    best = chunk_scores.select("id", "score").unionByName(near).groupBy("id").agg(F.round(F.max("score"), 6).alias("score"))
    return best.orderBy(F.desc("score"), "id").limit(n)


def reached_from(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(root, node) for every node at or below a root along links(parent, child), whatever the depth, cycles included.

    Distances double: links of length k joined with themselves have length 2k, and roots known within k become known
    within 2k. A round that finds nothing new ends it, since the way to a farther root would pass a nearer one's distance;
    so a chain of n nodes takes log n rounds, each written.
    """
    jump = storage.kept(links.where("parent IS NOT NULL AND child IS NOT NULL").select("parent", "child").distinct(), "links")
    known = storage.kept(roots.select("root", F.col("root").alias("node")).distinct(), "known")
    n = known.count()
    while True:
        below = jump.join(known.select("root", F.col("node").alias("parent")), "parent").select("root", F.col("child").alias("node"))
        known = storage.kept(known.unionByName(below).distinct(), "known")
        before, n = n, known.count()
        if n == before:
            return known
        further = jump.select("parent", F.col("child").alias("__mid")).join(jump.select(F.col("parent").alias("__mid"), "child"), "__mid").select("parent", "child")
        jump = storage.kept(further.distinct(), "links")


def tree_leaves(roots: DataFrame, tree: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, leaf): nodes without children below each root. tree: (id, children array); roots: (id).

    Without a depth, however deep the tree is (see reached_from). With one, a single plan of so many joins, for trees that
    are known to be flat: leaves below the depth are not found.
    """
    t = tree.select(F.col("id").alias("__id"), "children")
    if depth is None:
        links = t.select(F.col("__id").alias("parent"), F.explode("children").alias("child"))
        inner = t.where(F.size("children") > 0).select(F.col("__id").alias("node"))
        return reached_from(roots.select(F.col("id").alias("root")), links).join(inner, "node", "left_anti").select("root", F.col("node").alias("leaf"))
    front = roots.select(F.col("id").alias("root"), F.col("id").alias("node"))
    leaves = None
    for _ in range(depth + 1):
        j = front.join(t, front["node"] == t["__id"], "left")
        end = j.where(F.coalesce(F.size("children"), F.lit(0)) < 1).select("root", F.col("node").alias("leaf"))
        leaves = end if leaves is None else leaves.unionByName(end)
        front = j.where(F.size("children") > 0).select("root", F.explode("children").alias("node"))
    return leaves.distinct()


def merge_entities(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(name_key, name, description, weight): entities merged without regard to case. A description is appended
    unless contained; a known entity's weight grows by 1 for each arrival; a new one's is clamped to 1..10."""
    key = F.lower(F.trim("name"))
    inc = incoming.where(F.trim(F.coalesce("name", F.lit(""))) != "").withColumn("name_key", key)
    inc = inc.groupBy("name_key").agg(F.min_by("name", "seq").alias("new_name"), F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("seq", "description"))), lambda x: x["description"])), " ").alias("new_description"), F.count("*").alias("arrivals"), F.max("weight").alias("new_weight"))
    old = existing.withColumn("name_key", key)
    j = old.join(inc, "name_key", "full")
    text = F.when(F.col("description").isNull(), F.col("new_description")).when(F.col("new_description").isNull() | F.contains(F.lower("description"), F.lower("new_description")), F.col("description")).otherwise(F.concat_ws(" ", "description", "new_description"))
    weight = F.when(F.col("name").isNull(), F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.col("new_weight")))).otherwise(F.col("weight") + F.coalesce("arrivals", F.lit(0)))
    return j.select("name_key", F.coalesce("name", "new_name").alias("name"), text.alias("description"), weight.cast("double").alias("weight"))


def valid_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations between known, different entities, types in UPPER_SNAKE, each triple once at its largest weight."""
    kind = F.upper(F.regexp_replace(F.trim("relation"), r"[^A-Za-z0-9]+", "_"))
    r = relations.select(F.lower(F.trim("source")).alias("source"), F.lower(F.trim("target")).alias("target"), kind.alias("relation"), "weight").where("source <> target")
    names = entities.select(F.lower(F.trim("name")).alias("n")).distinct()
    r = r.join(names.select(F.col("n").alias("source")), "source", "left_semi").join(names.select(F.col("n").alias("target")), "target", "left_semi")
    return r.groupBy("source", "target", "relation").agg(F.max(F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.col("weight").cast("double")))).alias("weight"))


def taxonomy_paths(nodes: DataFrame) -> DataFrame:
    """(id, path, level) from (id, parent_id, label): labels joined by dots from the root down, whatever the depth.

    Every node's path doubles in length each round, by the path of the ancestor that it ends at. Nodes without a way up to
    a root (in or below a cycle, or under an unknown parent) have no path.
    """
    most = nodes.count().bit_length() + 1
    at = storage.kept(nodes.select("id", F.coalesce("label", F.lit("")).alias("path"), F.lit(0).alias("level"), F.col("parent_id").alias("up")), "paths")
    for _ in range(most):
        if at.where("up IS NOT NULL").isEmpty():
            break
        above = at.select(F.col("id").alias("__up"), F.col("path").alias("__path"), F.col("level").alias("__level"), F.col("up").alias("__next"))
        open_ = at.where("up IS NOT NULL").join(above, F.col("up") == F.col("__up")).select("id", F.concat_ws(".", "__path", "path").alias("path"), (F.col("level") + F.col("__level") + 1).alias("level"), F.col("__next").alias("up"))
        at = storage.kept(at.where("up IS NULL").unionByName(open_), "paths")
    return at.where("up IS NULL").select("id", "path", "level")


def reparented(nodes: DataFrame, paths: DataFrame, node, parent) -> DataFrame:
    """(id, path, level) of all nodes(id, parent_id, ...) once `node` hangs under `parent` (None: as a root): the paths of
    its whole subtree are rewritten, others stay. A parent in the subtree itself is an error."""
    below = reached_from(nodes.where(F.col("id") == F.lit(node)).select(F.col("id").alias("root")), nodes.select(F.col("parent_id").alias("parent"), F.col("id").alias("child")))
    if parent is not None and not below.where(F.col("node") == F.lit(parent)).isEmpty():
        raise ValueError(f"CYCLE: {parent} is below {node}")
    ends = {r.id: (r.path, r.level) for r in paths.where(F.col("id").isin([x for x in (node, parent) if x is not None])).collect()}
    (old, level), (new, to) = ends[node], ends[parent] if parent is not None else ("", -1)
    label = nodes.where(F.col("id") == F.lit(node)).select(F.coalesce("label", F.lit(""))).head()[0]
    head = f"{new}.{label}" if parent is not None else label
    moved = paths.join(below.select(F.col("node").alias("id")), "id", "left_semi").select("id", F.concat(F.lit(head), F.substring("path", len(old) + 1, 1 << 30)).alias("path"), (F.col("level") - level + to + 1).alias("level"))
    return paths.join(below.select(F.col("node").alias("id")), "id", "left_anti").select("id", "path", "level").unionByName(moved)


def under(path: Column, prefix: str) -> Column:
    """Whether a dotted path is a prefix or below it."""
    return (path == prefix) | path.startswith(prefix + ".")


def label_communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community) by synchronous label propagation on weighted undirected edges; ties go to the smaller
    label, self-loops don't count. Deterministic; each round is one aggregation by (node, label)."""
    e = undirected(edges.select("src", "dst", "weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    labels = e.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = e.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("a").agg(F.max(F.struct("w", F.negative("community").alias("neg"))).alias("x"))
        labels = best.select(F.col("a").alias("node"), F.negative("x.neg").alias("community"))
    return labels


def document_sections(toc: DataFrame) -> DataFrame:
    """TOC rows (doc, ord, level, title, page) with the page where each ends and its parent: the last earlier row
    of a smaller level. Levels are few, so the parent is the latest of one running maximum for each level."""
    w = Window.partitionBy("doc").orderBy("ord")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    t = toc.withColumn("end_page", F.lead("page").over(w))
    seen = [F.max(F.when(F.col("level") == k, F.col("ord"))).over(past) for k in range(1, 7)]
    t = t.withColumns({f"__l{k}": c for k, c in enumerate(seen, 1)})
    parent = F.greatest(*(F.when(F.col("level") > k, F.col(f"__l{k}")) for k in range(1, 7)))
    return t.withColumn("parent_ord", parent).drop(*(f"__l{k}" for k in range(1, 7)))


def hop_payload(rows: DataFrame, n: int = 40) -> DataFrame:
    """Rows of (node, hop, score) as a payload: nearer hops first, better scores within a hop."""
    return rows.orderBy("hop", F.desc("score"), "node").limit(n)


def navigate(anchors: DataFrame, edges: DataFrame, hops: int = 2, decay: float = 0.75, n: int = 36) -> DataFrame:
    """(node, hop, score, path): anchors(node, score) spread along directed edges. path holds the relations and
    nodes of a node's best way, joined by `>`; of equal scores the nearer hop, then the smaller path stays."""
    e = edges.select("src", "dst", "relation").where("src <> dst")
    best = anchors.groupBy("node").agg(F.max("score").alias("score")).withColumn("path", F.col("node").cast("string"))
    reached, front = best.withColumn("hop", F.lit(0)), best
    for h in range(1, max(0, hops) + 1):
        step = front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.round(F.col("score") * decay, 9).alias("score"), F.concat_ws(">", "path", "relation", F.col("dst").cast("string")).alias("path"))
        front = step.groupBy("node").agg(F.max("score").alias("score"), F.min_by("path", F.struct(F.negative("score"), "path")).alias("path"))
        reached = reached.unionByName(front.withColumn("hop", F.lit(h)))
    one = reached.groupBy("node").agg(F.min_by(F.struct("hop", "score", "path"), F.struct(F.negative("score"), "hop", "path")).alias("x"))
    return one.select("node", "x.hop", F.round("x.score", 6).alias("score"), "x.path").orderBy(F.desc("score"), "hop", "node").limit(n)


def rule_guided_search(anchors: DataFrame, edges: DataFrame, boosts: dict[str, float], n: int, most: int = 15) -> DataFrame:
    """(id, method, depth, score) of anchors (id, score), the best `most`, and nodes within two rule edges of them.

    A node on a rule path scores the greatest anchor score times the path's weights times the last relation's
    boost; anchors aren't reached again by a second edge. Each node keeps its best row.
    """
    a = anchors.orderBy(F.desc("score"), "id").limit(most)
    boost = F.create_map(*(F.lit(x) for kv in boosts.items() for x in kv))[F.col("relation")]
    rules = edges.where(F.col("relation").isin(list(boosts))).select("src", "dst", "relation", "weight")
    one = a.select(F.col("id").alias("src")).join(rules, "src").select("dst", "relation", "weight").withColumn("depth", F.lit(1))
    # only a node's heaviest way to it can lead to a best row behind it
    reach = one.groupBy(F.col("dst").alias("src")).agg(F.max("weight").alias("w"))
    two = reach.join(rules, "src").join(a.select(F.col("id").alias("dst")), "dst", "left_anti").select("dst", "relation", (F.col("w") * F.col("weight")).alias("weight")).withColumn("depth", F.lit(2))
    top = a.agg(F.max("score").alias("top"))
    ways = one.unionByName(two).join(F.broadcast(top), F.lit(True)).select(F.col("dst").alias("id"), F.lower(F.concat(F.lit("graph_"), "relation")).alias("method"), "depth", F.round(F.col("top") * F.col("weight") * boost, 6).alias("score"))
    rows = a.select("id", F.lit("vector").alias("method"), F.lit(0).alias("depth"), F.round("score", 6).alias("score")).unionByName(ways)
    best = rows.groupBy("id").agg(F.min_by(F.struct("method", "depth", "score"), F.struct(F.negative("score"), "depth", "method")).alias("x"))
    return best.select("id", "x.*").orderBy(F.desc("score"), "id").limit(n)


def match_entities(incoming: DataFrame, existing: DataFrame, least: float = 0.95) -> DataFrame:
    """(seq, entity, how): the entity that each incoming row (seq, name, embedding) is: one of the same name
    without case, else the nearest vector of at least `least`, else none (null). existing: (id, name, embedding)."""
    from lodestar.operators.search import batch_vector_topk

    key = lambda c: F.lower(F.trim(c))
    names = existing.groupBy(key("name").alias("k")).agg(F.min("id").alias("named"))
    j = incoming.withColumn("k", key("name")).join(names, "k", "left")
    rest = j.where("named is null").select(F.col("seq").alias("query_id"), F.col("embedding").alias("query"))
    near = batch_vector_topk(existing.select("id", "embedding"), rest, 1, least - 1e-6).where(F.col("similarity") >= least).select(F.col("query_id").alias("seq"), F.col("id").alias("near"))
    how = F.when(F.col("named").isNotNull(), "name").when(F.col("near").isNotNull(), "vector")
    return j.join(near, "seq", "left").select("seq", F.coalesce("named", "near").alias("entity"), how.alias("how"))


def structure_graph(toc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of TOC rows (doc, ord, level, title, page): nodes (id, doc, section_ref, name, end_page) with
    name-based ids, and CONTAINS edges (id, source, target, relation) from each section to its subsections."""
    from lodestar.functions.identity import section_ref, uuid5

    url = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"  # the public namespace of URLs
    s = document_sections(toc.where(F.trim(F.coalesce("title", F.lit(""))) != "")).withColumn("ref", section_ref(F.col("level"), F.col("page"), F.trim("title")))
    doc = F.col("doc").cast("string")
    node_id = lambda ref: uuid5(url, F.concat(F.lit("doc-structure:"), doc, F.lit(":"), ref))
    nodes = s.select(node_id(F.col("ref")).alias("id"), "doc", F.col("ref").alias("section_ref"), F.concat(F.trim("title"), F.lit(" ("), "ref", F.lit(")")).alias("name"), "end_page")
    up = s.select("doc", F.col("ord").alias("parent_ord"), F.col("ref").alias("parent_ref"))
    e = s.join(up, ["doc", "parent_ord"]).where("ref <> parent_ref")
    edge_id = uuid5(url, F.concat(F.lit("doc-structure-edge:"), doc, F.lit(":"), "parent_ref", F.lit(":"), "ref", F.lit(":CONTAINS")))
    return nodes.dropDuplicates(["id"]), e.select(edge_id.alias("id"), node_id(F.col("parent_ref")).alias("source"), node_id(F.col("ref")).alias("target"), F.lit("CONTAINS").alias("relation")).dropDuplicates(["id"])


def section_links(chunks: DataFrame) -> DataFrame:
    """(tenant_id, entity_id, chunk_id): which section each chunk stands in, each link once."""
    return chunks.where("section_node_id is not null and id is not null").select("tenant_id", F.col("section_node_id").alias("entity_id"), F.col("id").alias("chunk_id")).distinct()


def one_hop_context(edges: DataFrame, names: DataFrame, most: int = 40) -> DataFrame:
    """(node, relations, context): each node's heaviest relations to named neighbours, at most so many, as text. A
    node's edges are cut before they are gathered. names: (node, name)."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "relation", "dst")
    e = edges.join(names.select(F.col("node").alias("dst"), "name"), "dst").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    line = F.struct("n", F.concat_ws(" ", "relation", "name").alias("line"))
    return e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("relations"), F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "; ").alias("context"))
