"""Queries over graphs and trees."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.catalog import query
from lodestar.operators import communities as C
from lodestar.operators import graph as G
from lodestar.operators.mixtures import mixture_clusters
from lodestar.plans import binding as B


@query(
    "graph_hops",
    f"""WITH {B.EDGES}, u AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM g UNION ALL SELECT dst, src FROM g) WHERE a <> b),
    h0 AS (SELECT * FROM (VALUES (1, 0.9), (2, 0.8), (3, 0.35)) t(node, score)),
    h1 AS (SELECT u.b AS node, round(max(score) * 0.82, 9) AS score FROM h0 JOIN u ON u.a = h0.node GROUP BY u.b),
    h2 AS (SELECT u.b AS node, round(max(score) * 0.82, 9) AS score FROM h1 JOIN u ON u.a = h1.node GROUP BY u.b),
    a AS (SELECT node, score, 0 AS hop FROM h0 UNION ALL SELECT node, score, 1 FROM h1 UNION ALL SELECT node, score, 2 FROM h2),
    r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, hop) AS n FROM a)
    SELECT node::BIGINT AS node, hop, round(score, 6)::DOUBLE AS score FROM r WHERE n = 1 ORDER BY score DESC, hop, node LIMIT 36""",
)
def graph_hops(spark, sf):
    anchors = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.35)], "node long, score double")
    return G.multi_hop(anchors, B.edges(spark, sf))


@query(
    "path_weights",
    f"""WITH RECURSIVE {B.EDGES}, e AS (SELECT * FROM g WHERE relation IN ('1', '2')),
    p(node, depth, weight, path) AS (SELECT dst, 1, weight::DOUBLE, [src, dst] FROM e WHERE src = 8
      UNION ALL SELECT e.dst, p.depth + 1, p.weight * e.weight, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.node WHERE p.depth < 3 AND NOT list_contains(p.path, e.dst))
    SELECT node, depth, round(weight, 6) AS weight, array_to_string(path, '>') AS path FROM p""",
)
def path_weights(spark, sf):
    p = G.weighted_paths(8, B.edges(spark, sf), 3, ("1", "2"))
    return p.select("node", "depth", F.round("weight", 6).alias("weight"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("overrides", f"WITH {B.EDGES}, o AS (SELECT dst AS id, list_sort(list_distinct(list(src))) AS l FROM g WHERE relation = '1' GROUP BY dst) SELECT c_custkey AS id, coalesce(array_to_string(l, ','), '') AS override_ids, coalesce(len(l), 0) > 0 AS has_overrides FROM customer LEFT JOIN o ON o.id = c_custkey")
def overrides(spark, sf):
    o = G.overrides(B.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), B.edges(spark, sf), "1")
    return o.select("id", F.array_join(F.transform("override_ids", lambda x: x.cast("string")), ",").alias("override_ids"), "has_overrides")


@query("graph_guided_search", f"WITH {B.EDGES}, a AS (SELECT vec_id AS id, round((vec_id * 37 % 100) / 100.0, 6) AS score FROM embeddings), n AS (SELECT id, score FROM a UNION ALL SELECT g.dst, a.score * g.weight * CASE g.relation WHEN '1' THEN 1.5 ELSE 1.2 END FROM a JOIN g ON g.src = a.id WHERE g.relation IN ('1', '2')) SELECT id, round(max(score), 6)::DOUBLE AS score FROM n GROUP BY id ORDER BY score DESC, id LIMIT 25")
def graph_guided_search(spark, sf):
    a = B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.round((F.col("vec_id") * 37 % 100) / 100.0, 6).alias("score"))
    return G.guided_search(a, B.edges(spark, sf), {"1": 1.5, "2": 1.2}, 25)


_TREE = "region -> nation -> customer"


@query("tree_leaves", "SELECT 'r' || n_regionkey AS root, 'c' || c_custkey AS leaf FROM nation JOIN customer ON c_nationkey = n_nationkey UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)")
def tree_leaves(spark, sf):
    n, c = B.table(spark, sf, "nation"), B.table(spark, sf, "customer")
    name = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    t = n.groupBy(name("r", "n_regionkey").alias("id")).agg(F.collect_set(name("n", "n_nationkey")).alias("children"))
    t = t.unionByName(c.groupBy(name("n", "c_nationkey").alias("id")).agg(F.collect_set(name("c", "c_custkey")).alias("children")))
    return G.tree_leaves(B.table(spark, sf, "region").select(name("r", "r_regionkey").alias("id")), t, depth=5)


@query("taxonomy_paths", "SELECT 'r' || r_regionkey AS id, r_name AS path, 0 AS level FROM region UNION ALL SELECT 'n' || n_nationkey, r_name || '.' || n_name, 1 FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'c' || c_custkey, r_name || '.' || n_name || '.' || c_name, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def taxonomy_paths(spark, sf):
    name = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    r = B.table(spark, sf, "region").select(name("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("label"))
    n = B.table(spark, sf, "nation").select(name("n", "n_nationkey").alias("id"), name("r", "n_regionkey").alias("parent_id"), F.col("n_name").alias("label"))
    c = B.table(spark, sf, "customer").select(name("c", "c_custkey").alias("id"), name("n", "c_nationkey").alias("parent_id"), F.col("c_name").alias("label"))
    return G.taxonomy_paths(r.unionByName(n).unionByName(c))


# Each customer's orders in turn: an order hangs under the one before, the first one under the customer.
_CHAINS = "x AS (SELECT o_orderkey AS id, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1 - o_custkey) AS parent FROM orders)"


def _chains(spark, sf):
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.coalesce(before, -1 - F.col("o_custkey")).alias("parent"))


@query("deep_tree_leaves", f"WITH RECURSIVE {_CHAINS}, r(root, node) AS (SELECT DISTINCT -1 - o_custkey, -1 - o_custkey FROM orders UNION ALL SELECT r.root, x.id FROM r JOIN x ON x.parent = r.node) SELECT root, node AS leaf FROM r WHERE node NOT IN (SELECT parent FROM x)")
def deep_tree_leaves(spark, sf):
    tree = _chains(spark, sf).groupBy(F.col("parent").alias("id")).agg(F.collect_list("id").alias("children"))
    return G.tree_leaves(tree.where("id < 0").select("id"), tree)


@query("deep_taxonomy_paths", f"WITH RECURSIVE {_CHAINS}, r(id, path, level) AS (SELECT DISTINCT -1 - o_custkey, 'c' || o_custkey, 0 FROM orders UNION ALL SELECT x.id, r.path || '.' || x.id, r.level + 1 FROM r JOIN x ON x.parent = r.id) SELECT id, path, level::INT AS level FROM r")
def deep_taxonomy_paths(spark, sf):
    x = _chains(spark, sf)
    roots = x.where("parent < 0").select(F.col("parent").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.concat(F.lit("c"), (-1 - F.col("parent")).cast("string")).alias("label")).distinct()
    return G.taxonomy_paths(roots.unionByName(x.select("id", F.col("parent").alias("parent_id"), F.col("id").cast("string").alias("label"))))


@query(
    "merge_upsert",
    """WITH o AS (SELECT lower(trim(p_type)) AS k, min(p_type) AS name, min(p_brand) AS description, 5.0 AS weight FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
    i AS (SELECT p_partkey AS seq, upper(p_type) AS name, p_brand AS description, p_size AS weight FROM part WHERE p_partkey % 3 = 0),
    f AS (SELECT lower(trim(name)) AS k, description, min(seq) AS seq FROM i GROUP BY 1, 2), ds AS (SELECT k, string_agg(description, ' ' ORDER BY seq) AS nd FROM f GROUP BY k),
    u AS (SELECT lower(trim(name)) AS k, arg_min(name, seq) AS nn, any_value(nd) AS nd, count(*) AS arrivals, max(weight) AS nw FROM i JOIN ds ON ds.k = lower(trim(i.name)) GROUP BY 1)
    SELECT coalesce(o.k, u.k) AS name_key, coalesce(o.name, nn) AS name, CASE WHEN o.description IS NULL THEN nd WHEN nd IS NULL OR contains(lower(o.description), lower(nd)) THEN o.description ELSE o.description || ' ' || nd END AS description, CASE WHEN o.k IS NULL THEN greatest(1.0, least(10.0, nw)) ELSE o.weight + coalesce(arrivals, 0) END::DOUBLE AS weight FROM o FULL JOIN u ON o.k = u.k""",
)
def merge_upsert(spark, sf):
    p = B.table(spark, sf, "part")
    old = p.where("p_partkey % 2 = 0").groupBy(F.lower(F.trim("p_type")).alias("k")).agg(F.min("p_type").alias("name"), F.min("p_brand").alias("description")).select("name", "description", F.lit(5.0).alias("weight"))
    new = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("seq"), F.upper("p_type").alias("name"), F.col("p_brand").alias("description"), F.col("p_size").cast("double").alias("weight"))
    return G.merge_entities(old, new)


@query("context_map", "SELECT 'mandate' AS kind, n_regionkey AS owner, n_nationkey::BIGINT AS item FROM nation UNION ALL SELECT DISTINCT 'mounted', n_regionkey, s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0")
def context_map(spark, sf):
    n, s = B.table(spark, sf, "nation"), B.table(spark, sf, "supplier")
    m = n.select(F.lit("mandate").alias("kind"), F.col("n_regionkey").alias("owner"), F.col("n_nationkey").cast("long").alias("item"))
    x = s.where("s_acctbal > 0").join(F.broadcast(n), F.col("n_nationkey") == F.col("s_nationkey")).select(F.lit("mounted").alias("kind"), F.col("n_regionkey").alias("owner"), F.col("s_suppkey").cast("long").alias("item")).distinct()
    return m.unionByName(x)


@query("one_hop_context", f"WITH {B.EDGES}, r AS (SELECT src AS node, relation, dst, weight, c_name AS name, row_number() OVER (PARTITION BY src ORDER BY weight DESC, relation, dst) AS n FROM g JOIN customer ON c_custkey = dst) SELECT node, count(*) AS relations, string_agg(relation || ' ' || name, '; ' ORDER BY n) AS context FROM r WHERE n <= 40 GROUP BY node")
def one_hop_context(spark, sf):
    names = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.col("c_name").alias("name"))
    return G.one_hop_context(B.edges(spark, sf), names)


@query("relation_validation", "WITH r AS (SELECT lower(trim(o_orderpriority)) AS source, lower(trim(o_orderstatus)) AS target, upper(regexp_replace(trim(o_orderpriority), '[^A-Za-z0-9]+', '_', 'g')) AS relation, o_orderkey % 20 AS weight FROM orders) SELECT source, target, relation, max(greatest(1, least(10, weight)))::DOUBLE AS weight FROM r WHERE source <> target AND source LIKE '1%' AND target IN ('f', 'o') GROUP BY ALL")
def relation_validation(spark, sf):
    o = B.table(spark, sf, "orders")
    r = o.select(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("target"), F.col("o_orderpriority").alias("relation"), (F.col("o_orderkey") % 20).alias("weight"))
    names = spark.createDataFrame([("F",), ("o",), ("1-URGENT",)], "name string").unionByName(o.where("o_orderpriority like '1%'").select(F.col("o_orderpriority").alias("name")).distinct())
    return G.valid_relations(r, names)


@query("communities")
def communities(spark, sf):
    return G.label_communities(B.edges(spark, sf), 4)


@query("modular_communities")
def modular_communities(spark, sf):
    return C.modular_communities(B.edges(spark, sf), rounds=6)


@query("gmm_clusters")
def gmm_clusters(spark, sf):
    return mixture_clusters(B.vectors(spark, sf).select("id", "label", "embedding"), "label", most=4)
