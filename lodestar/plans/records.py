"""Queries of record keeping, grounding, summaries and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.catalog import query
from lodestar.functions import text as X
from lodestar.operators import knowledge as K
from lodestar.operators import policy as P
from lodestar.operators import records as R
from lodestar.operators import search as S
from lodestar.plans import binding as B


@query("collection_delete", "SELECT count_if(s_nationkey = 3) AS deleted_chunks, count(DISTINCT CASE WHEN s_nationkey = 3 THEN s_suppkey END) AS deleted_documents FROM supplier")
def collection_delete(spark, sf):
    s = B.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("collection_id"), F.col("s_suppkey").alias("source_id"))
    return R.delete_collection(s, 3)[1]


@query("batch_add_files", "WITH h AS (SELECT DISTINCT o_custkey % 10 AS batch_id, o_clerk AS filename FROM (SELECT o_custkey, 'f' || (o_orderkey % 40) AS o_clerk FROM orders WHERE o_orderkey % 9 = 0)), n AS (SELECT DISTINCT o_custkey % 10 AS batch_id, 'f' || (o_orderkey % 60) AS filename FROM orders), x AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.batch_id = n.batch_id AND h.filename = n.filename)), r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY filename) AS t FROM x) SELECT batch_id, filename FROM r LEFT JOIN (SELECT batch_id, count(*) AS held FROM h GROUP BY 1) USING (batch_id) WHERE t + coalesce(held, 0) <= 45")
def batch_add_files(spark, sf):
    o = B.table(spark, sf, "orders")
    f = lambda m: F.concat(F.lit("f"), (F.col("o_orderkey") % m).cast("string")).alias("filename")
    held = o.where("o_orderkey % 9 = 0").select((F.col("o_custkey") % 10).alias("batch_id"), f(40)).distinct()
    return R.add_files(held, o.select((F.col("o_custkey") % 10).alias("batch_id"), f(60)), 45)


@query("tenant_list", "SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL ORDER BY 1 LIMIT 3")
def tenant_list(spark, sf):
    return R.tenants(B.table(spark, sf, "customer"), "c_mktsegment", 3)


def _traces(spark, sf):
    l = B.table(spark, sf, "lineitem")
    c = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.struct(F.col("l_suppkey").alias("node_id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("excerpt")).alias("c")))), lambda x: x["c"])
    return l.groupBy(F.col("l_orderkey").alias("trace_id")).agg(c.alias("citations"))


@query("traces_citing", "SELECT l_orderkey AS trace_id, string_agg('part ' || l_partkey, ' | ' ORDER BY l_linenumber, 'part ' || l_partkey) AS excerpts FROM lineitem WHERE l_suppkey = 5 GROUP BY 1")
def traces_citing(spark, sf):
    return R.traces_citing(_traces(spark, sf), 5)


@query("golden_traces", "SELECT o_orderkey AS trace_id FROM orders WHERE o_orderkey % 6 >= 4 AND o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 90 DAY ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def golden_traces(spark, sf):
    t = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("trace_id"), (F.col("o_orderkey") % 6).alias("feedback"), F.col("o_orderdate").alias("created_at"))
    return R.golden_traces(t, F.lit("1998-01-01").cast("timestamp_ntz"), 90, 25).select("trace_id")


@query("retrieval_trace", f"WITH {B.HITS}, t AS (SELECT * FROM h ORDER BY score DESC, id LIMIT 10) SELECT string_agg(id::VARCHAR, ',' ORDER BY score DESC, id) AS ids FROM t")
def retrieval_trace(spark, sf):
    h = S.top(B.hits(spark, sf), 10, F.desc("score"), F.col("id")).withColumn("content", F.col("scope"))
    return R.retrieval_trace(h, "q").select(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("cache_lookup", "WITH c AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_partkey % 5 = 0) SELECT p_partkey, EXISTS (SELECT 1 FROM c WHERE c.p_brand = part.p_brand AND c.p_size = part.p_size) AS hit FROM part")
def cache_lookup(spark, sf):
    p = B.table(spark, sf, "part")
    return R.cached(p.select("p_partkey", "p_brand", "p_size"), p.where("p_partkey % 5 = 0").select("p_brand", "p_size"), ["p_brand", "p_size"]).select("p_partkey", "hit")


@query("daily_budget", "SELECT user_id AS tenant_id, count(*) AS used, count(*) < 3 AS allowed FROM events WHERE ts::DATE = DATE '2024-01-02' GROUP BY user_id")
def daily_budget(spark, sf):
    e = B.table(spark, sf, "events").withColumnRenamed("user_id", "tenant_id")
    return R.budget_left(e, F.lit("2024-01-02").cast("date"), 3)


@query("visual_tasks", "SELECT p_brand AS image_hash, p_type AS kind, min(p_partkey) AS page FROM part WHERE p_size >= 10 GROUP BY 1, 2")
def visual_tasks(spark, sf):
    p = B.table(spark, sf, "part").select(F.col("p_brand").alias("image_hash"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"), F.col("p_partkey").alias("page"))
    return R.visual_tasks(p, 10)


@query("immutability_guard", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 17 = 0")
def immutability_guard(spark, sf):
    o = B.table(spark, sf, "orders").withColumn("status", F.col("o_orderstatus"))
    after = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 17 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return R.illegal_transitions(o, after, "o_orderkey", ("o_totalprice", "o_custkey"))


@query("entity_grounding", "WITH e AS (SELECT p_partkey AS entity, round(p_size / 50.0, 4) AS score FROM part), p AS (SELECT l_partkey AS entity, l_orderkey AS chunk FROM lineitem) SELECT chunk::VARCHAR AS id, max(score) AS similarity FROM e JOIN p USING (entity) GROUP BY 1 UNION ALL SELECT 'graph:' || entity, score FROM e WHERE entity NOT IN (SELECT entity FROM p)")
def entity_grounding(spark, sf):
    e = B.table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.round(F.col("p_size") / 50.0, 4).alias("score"))
    p = B.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("chunk"))
    return K.ground_entities(e, p).select("id", "similarity")


@query("exact_entities", "SELECT p_partkey AS id, p_name AS name FROM part WHERE lower(p_name) = lower((SELECT p_name FROM part WHERE p_partkey = 7)) ORDER BY 1 LIMIT 6")
def exact_entities(spark, sf):
    p = B.table(spark, sf, "part")
    name = p.where("p_partkey = 7").head().p_name
    return S.top(p.where(F.lower("p_name") == name.lower()).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), 6, F.col("id"))


@query("query_entities", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Maria Lopez' ELSE substr('no names in ' || lower(c_name), 1, 80) END AS first, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM customer")
def query_entities(spark, sf):
    text = F.when(F.col("c_custkey") % 2 == 0, "who is Maria Lopez of Acme").otherwise(F.concat(F.lit("no names in "), F.lower("c_name")))
    c = B.table(spark, sf, "customer").select("c_custkey", R.query_entities(text).alias("found"))
    return c.select("c_custkey", F.element_at("found", 1).alias("first"), F.size("found").alias("n"))


@query("extractive_titles", "SELECT doc_id, array_to_string(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:10], ' ') AS title FROM documents WHERE text IS NOT NULL")
def extractive_titles(spark, sf):
    return B.table(spark, sf, "documents").where("text is not null").select("doc_id", K.extractive_summary(F.col("text"))["title"].alias("title"))


@query("transient_errors", "SELECT event_type, event_id % 3 < 2 AS transient, count(*) AS n FROM events GROUP BY 1, 2")
def transient_errors(spark, sf):
    kind = F.element_at(F.array(F.lit(" HTTP 503"), F.lit(" Connection reset by peer"), F.lit(" not found 404")), (F.col("event_id") % 3 + 1).cast("int"))
    return B.table(spark, sf, "events").groupBy("event_type", X.transient_error(F.concat("event_type", kind)).alias("transient")).agg(F.count("*").alias("n"))


@query("context_recall", "WITH r AS (SELECT l_orderkey AS q, list(DISTINCT l_partkey) AS got FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), e AS (SELECT l_orderkey AS q, list(DISTINCT l_partkey) AS want FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1) SELECT q, round(len(list_intersect(got, want)) / len(want), 6) AS recall FROM r JOIN e USING (q)")
def context_recall(spark, sf):
    l = B.table(spark, sf, "lineitem")
    g = l.groupBy(F.col("l_orderkey").alias("q")).agg(F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("l_partkey"))).alias("got"), F.collect_set(F.when(F.col("l_linenumber") >= 2, F.col("l_partkey"))).alias("want"))
    return g.where((F.size("got") > 0) & (F.size("want") > 0)).select("q", F.round(R.context_recall(F.col("got"), F.col("want")), 6).alias("recall"))


@query("faithfulness", "WITH p AS (SELECT i.item_id, list_distinct(list_filter(regexp_extract_all(lower(i.text), '[0-9a-zà-öø-ÿ]+'), lambda x: length(x) > 3)) AS a, list_distinct(list_filter(regexp_extract_all(lower(coalesce(d.text, '')), '[0-9a-zà-öø-ÿ]+'), lambda x: length(x) > 3)) AS c FROM benchmark i JOIN documents d ON d.doc_id = i.item_id) SELECT item_id, CASE WHEN len(a) = 0 THEN 0.0 ELSE round(len(list_intersect(a, c)) / len(a), 6) END AS score FROM p")
def faithfulness(spark, sf):
    b = B.table(spark, sf, "benchmark").withColumnRenamed("text", "answer")
    d = B.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("context"))
    return b.join(d, "item_id").select("item_id", F.round(R.faithfulness(F.col("answer"), F.col("context")), 6).alias("score"))


@query("hydrated_chunks", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (1, 5, 9, 100000000)")
def hydrated_chunks(spark, sf):
    from lodestar.sources.readers import by_ids

    return by_ids(B.table(spark, sf, "documents"), [1, 5, 5, 9, 100000000], "doc_id").select("doc_id", "n_chars")


@query("filtered_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 ORDER BY o_orderkey LIMIT 20")
def filtered_scan(spark, sf):
    from lodestar.sources.readers import parquet_rows

    return parquet_rows(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice"], "o_orderstatus = 'F' and o_totalprice > 1000", ["o_orderkey"], 20)


@query("metadata_time_filter", "SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-05'")
def metadata_time_filter(spark, sf):
    e = P.metadata_filter(B.table(spark, sf, "events"), {"event_type": ["view", "click"]})
    return P.time_range(e, "ts", "2024-01-02 00:00:00", "2024-01-05 00:00:00").select("event_id")


@query("tenant_stamp", f"WITH {B.VECTORS} SELECT id, coalesce(CASE WHEN label % 3 = 0 THEN NULL ELSE tenant_id END, 1) AS tenant_id FROM v")
def tenant_stamp(spark, sf):
    v = B.vectors(spark, sf).withColumn("tenant_id", F.when(F.col("label") % 3 != 0, F.col("tenant_id")))
    return P.stamp_tenant(v, 1).select("id", "tenant_id")


@query("first_wins_dedup", "SELECT l_partkey::VARCHAR AS key, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY 1")
def first_wins_dedup(spark, sf):
    l = B.table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return P.first_by(l, P.identity_key(F.col("key"), F.col("key")), F.col("seq"))


@query("structural_filter", "SELECT doc_id FROM documents WHERE trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) <> '' AND doc_id % 7 <> 0")
def structural_filter(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return P.drop_structure(d, eligible=F.col("doc_id") % 7 != 0).select("doc_id")


@query("community_summaries")
def community_summaries(spark, sf):
    from lodestar.operators.communities import modular_communities

    labels = modular_communities(B.edges(spark, sf), rounds=6)
    names = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.col("c_name").alias("name"))
    return K.community_summaries(labels, names).drop("members")


@query("summary_tree")
def summary_tree(spark, sf):
    c = B.chunks(spark, sf).select(F.col("label").alias("doc"), "id", "content", "embedding", "scope")
    return K.summary_tree(c, F.col("scope"), 2, 3).select("doc", "id", "level", F.size("children").alias("children"), "title")


@query("summary_links")
def summary_links(spark, sf):
    c = B.chunks(spark, sf).select(F.col("label").alias("doc"), F.col("id").cast("string").alias("id"), "content", "embedding", "scope")
    return K.summary_links(K.summary_level(c, F.col("scope"), 1))
