"""Queries of navigation, document structure, row mapping, attempts and slots."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar import api
from lodestar.catalog import query
from lodestar.functions import identity as D
from lodestar.functions import text as X
from lodestar.operators import graph as G
from lodestar.operators import intervals as IV
from lodestar.operators import ingest as I
from lodestar.operators import operations as O
from lodestar.operators import policy as P
from lodestar.operators import records as R
from lodestar.plans import binding as B

_ANCHORS = "a AS (SELECT vec_id AS id, round((vec_id * 37 % 100) / 100.0, 6)::DOUBLE AS score FROM embeddings)"


def _anchors(spark, sf):
    return B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.round((F.col("vec_id") * 37 % 100) / 100.0, 6).alias("score"))


@query(
    "graph_navigation",
    f"""WITH {B.EDGES}, e AS (SELECT src, dst, relation FROM g WHERE src <> dst), h0 AS (SELECT * FROM (VALUES (1::BIGINT, 0.9::DOUBLE, '1'), (2, 0.8, '2')) t(node, score, path)),
    s1 AS (SELECT dst AS node, round(score * 0.75, 9) AS score, path || '>' || relation || '>' || dst AS path FROM h0 JOIN e ON src = node), h1 AS (SELECT node, max(score) AS score, arg_min(path, (-score, path)) AS path FROM s1 GROUP BY node),
    s2 AS (SELECT dst AS node, round(score * 0.75, 9) AS score, path || '>' || relation || '>' || dst AS path FROM h1 JOIN e ON src = node), h2 AS (SELECT node, max(score) AS score, arg_min(path, (-score, path)) AS path FROM s2 GROUP BY node),
    r AS (SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2), o AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, hop, path) AS n FROM r)
    SELECT node, hop, round(score, 6) AS score, path FROM o WHERE n = 1 ORDER BY score DESC, hop, node LIMIT 36""",
)
def graph_navigation(spark, sf):
    return G.navigate(spark.createDataFrame([(1, 0.9), (2, 0.8)], "node long, score double"), B.edges(spark, sf))


@query("hop_payload", "SELECT c_custkey AS node, c_nationkey % 4 AS hop, c_acctbal AS score FROM customer ORDER BY hop, score DESC, node LIMIT 40")
def hop_payload(spark, sf):
    return G.hop_payload(B.table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_nationkey") % 4).alias("hop"), F.col("c_acctbal").alias("score")))


@query(
    "rule_guided_search",
    f"""WITH {B.EDGES}, {_ANCHORS}, t AS (SELECT * FROM a ORDER BY score DESC, id LIMIT 15), e AS (SELECT *, CASE relation WHEN '1' THEN 1.5 ELSE 1.2 END AS boost FROM g WHERE relation IN ('1', '2')),
    x1 AS (SELECT e.dst AS id, e.relation, e.boost, e.weight, 1 AS depth FROM t JOIN e ON e.src = t.id),
    x2 AS (SELECT e.dst AS id, e.relation, e.boost, x1.weight * e.weight AS weight, 2 AS depth FROM x1 JOIN e ON e.src = x1.id WHERE e.dst NOT IN (SELECT id FROM t)),
    r AS (SELECT id, 'vector' AS method, 0 AS depth, round(score, 6) AS score FROM t UNION ALL SELECT id, 'graph_' || relation, depth, round((SELECT max(score) FROM t) * weight * boost, 6)::DOUBLE FROM (SELECT * FROM x1 UNION ALL SELECT * FROM x2)),
    o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, depth, method) AS n FROM r) SELECT id, method, depth, score FROM o WHERE n = 1 ORDER BY score DESC, id LIMIT 30""",
)
def rule_guided_search(spark, sf):
    return G.rule_guided_search(_anchors(spark, sf), B.edges(spark, sf), {"1": 1.5, "2": 1.2}, 30)


@query("entity_matches", f"WITH {B.VECTORS}, i AS (SELECT id AS seq, CASE WHEN id % 2 = 0 THEN 'N' || (id - 1) ELSE 'new' END AS name, embedding FROM v), x AS (SELECT id, 'n' || id AS name, embedding FROM v WHERE id % 3 <> 0), s AS (SELECT seq, arg_max(x.id, (round(list_cosine_similarity(i.embedding, x.embedding), 6), -x.id)) AS near, max(round(list_cosine_similarity(i.embedding, x.embedding), 6)) AS sim FROM i, x GROUP BY seq) SELECT i.seq, coalesce(x.id, CASE WHEN sim >= 0.3 THEN near END) AS entity, CASE WHEN x.id IS NOT NULL THEN 'name' WHEN sim >= 0.3 THEN 'vector' END AS how FROM i LEFT JOIN x ON lower(x.name) = lower(i.name) LEFT JOIN s ON s.seq = i.seq")
def entity_matches(spark, sf):
    v = B.vectors(spark, sf)
    name = F.when(F.col("id") % 2 == 0, F.concat(F.lit("N"), (F.col("id") - 1).cast("string"))).otherwise("new")
    new = v.select(F.col("id").alias("seq"), name.alias("name"), "embedding")
    return G.match_entities(new, v.where("id % 3 <> 0").select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), "embedding"), 0.3)


def _toc(spark, sf):
    l = B.table(spark, sf, "lineitem")
    return l.groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord")).agg(F.min(1 + F.col("l_partkey") % 3).alias("level"), F.min("l_suppkey").alias("page"), F.concat(F.lit("T"), F.min("l_partkey").cast("string")).alias("title"))


_TOC = "t AS (SELECT l_orderkey AS doc, l_linenumber AS ord, min(1 + l_partkey % 3) AS level, min(l_suppkey) AS page, 'T' || min(l_partkey) AS title FROM lineitem GROUP BY 1, 2)"


@query("structure_nodes", f"WITH {_TOC} SELECT DISTINCT doc, 'L' || level || ':' || page || ':' || title AS section_ref, title || ' (' || 'L' || level || ':' || page || ':' || title || ')' AS name FROM t")
def structure_nodes(spark, sf):
    return G.structure_graph(_toc(spark, sf))[0].select("doc", "section_ref", "name")


@query("structure_edges", f"WITH {_TOC}, p AS (SELECT t.*, (SELECT max(p.ord) FROM t p WHERE p.doc = t.doc AND p.ord < t.ord AND p.level < t.level) AS up FROM t), e AS (SELECT DISTINCT p.doc, 'L' || u.level || ':' || u.page || ':' || u.title AS a, 'L' || p.level || ':' || p.page || ':' || p.title AS b FROM p JOIN t u ON u.doc = p.doc AND u.ord = p.up) SELECT count(*) AS edges, 'CONTAINS' AS relation FROM e WHERE a <> b")
def structure_edges(spark, sf):
    return G.structure_graph(_toc(spark, sf))[1].groupBy("relation").agg(F.countDistinct("id").alias("edges"))


@query("section_links", "SELECT DISTINCT l_suppkey AS tenant_id, l_partkey AS entity_id, l_orderkey AS chunk_id FROM lineitem WHERE l_returnflag <> 'N'")
def section_links(spark, sf):
    l = B.table(spark, sf, "lineitem")
    return G.section_links(l.select(F.col("l_suppkey").alias("tenant_id"), F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") != "N", F.col("l_partkey")).alias("section_node_id")))


@query("strict_scope", f"WITH {B.HITS} SELECT id, scope FROM h WHERE scope IN ('s1', 's2')")
def strict_scope(spark, sf):
    return P.strict_scope(B.hits(spark, sf), ["s1", "s2"]).select("id", "scope")


@query("isolation_check", f"WITH {B.VECTORS} SELECT id FROM v WHERE tenant_id = 2 OR is_global")
def isolation_check(spark, sf):
    from lodestar.operators.search import scoped

    return P.verify_isolation(scoped(B.vectors(spark, sf), 2), 2).select("id")


@query("normalized_rows", "SELECT p_partkey::VARCHAR AS id, coalesce(CASE WHEN p_size % 5 > 0 THEN p_name END, '') AS content, coalesce(CASE WHEN p_size % 3 > 0 THEN p_size / 50.0 END, 0.0)::DOUBLE AS similarity, 0.0::DOUBLE AS score, 'hybrid' AS source_layer, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'content_chunk' END AS source_type, p_brand AS source_id FROM part")
def normalized_rows(spark, sf):
    p = B.table(spark, sf, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 > 0, F.col("p_name")).alias("content"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") / 50.0).alias("similarity"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("").alias("source_type"), F.create_map(F.lit("source_id"), F.col("p_brand")).alias("metadata"))
    return P.normalized_rows(rows).drop("metadata")


@query("retrieval_items", "SELECT CASE WHEN p_size % 4 = 0 THEN p_brand ELSE p_partkey::VARCHAR END AS source, trim(p_name) AS content, CASE WHEN p_size % 3 = 0 THEN p_size / 100.0 ELSE p_size / 50.0 END::DOUBLE AS score, 'graph' AS layer, p_type AS kind FROM part WHERE p_size % 5 > 0")
def retrieval_items(spark, sf):
    p = B.table(spark, sf, "part")
    rows = p.select(F.when(F.col("p_size") % 4 != 0, F.col("p_partkey").cast("string")).otherwise("").alias("id"), F.col("p_brand").alias("source"), F.when(F.col("p_size") % 5 > 0, F.concat(F.lit(" "), "p_name")).otherwise(" ").alias("content"), F.when(F.col("p_size") % 3 == 0, 0.0).otherwise(F.col("p_size") / 50.0).alias("score"), (F.col("p_size") / 100.0).alias("similarity"), F.lit("graph").alias("source_layer"), F.create_map(F.lit("source_layer"), F.lit("old"), F.lit("kind"), F.col("p_type")).alias("metadata"))
    return P.retrieval_items(rows).select("source", "content", "score", F.col("metadata")["source_layer"].alias("layer"), F.col("metadata")["kind"].alias("kind"))


@query("persistence_rows", "SELECT p_partkey::VARCHAR AS id, p_brand AS source_id, p_size AS chunk_index, 1 AS file_page_number, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS institution_id, false AS is_global, p_type AS clause_id, p_name AS note FROM part")
def persistence_rows(spark, sf):
    p = B.table(spark, sf, "part")
    c = p.select(F.col("p_partkey").alias("chunkId"), F.col("p_brand").alias("sourceId"), F.col("p_size").alias("chunk_index"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("").alias("institutionId"), F.create_map(F.lit("institution_id"), F.col("p_type"), F.lit("clause_id"), F.col("p_type"), F.lit("note"), F.col("p_name")).alias("metadata"))
    return P.persistence_rows(c).select("id", "source_id", "chunk_index", "file_page_number", "institution_id", "is_global", F.col("metadata.filters")["clause_id"].alias("clause_id"), F.col("metadata.row.metadata")["note"].alias("note"))


@query("missing_clauses", "SELECT string_agg(x, ',' ORDER BY x) AS missing FROM (VALUES ('4.1.2'), ('9.9'), ('9.8')) t(x) WHERE NOT EXISTS (SELECT 1 FROM documents WHERE '4.' || (doc_id % 9) || '.2' = x)")
def missing_clauses(spark, sf):
    d = B.table(spark, sf, "documents").select(F.array(F.concat(F.lit("4."), (F.col("doc_id") % 9).cast("string"), F.lit(".2"))).alias("clauses"))
    return P.missing_clauses(d, "clauses", ["4.1.2", "9.9", "9.8"], 2).select(F.array_join(F.sort_array("missing"), ",").alias("missing"))


@query("reranked_first", f"WITH {B.HITS}, c AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS pos FROM h ORDER BY score DESC, id LIMIT 60), r AS (SELECT id, pos, CASE WHEN pos <= 40 AND id % 3 <> 0 THEN round(CASE WHEN id % 7 = 0 THEN greatest(id % 100 / 100.0, 0.3) * 3.0 ELSE id % 100 / 100.0 END, 6) END AS rel FROM c) SELECT id, row_number() OVER (ORDER BY rel IS NULL, rel DESC, pos)::INT AS place FROM r ORDER BY 2 LIMIT 20")
def reranked_first(spark, sf):
    h = B.hits(spark, sf)
    relevance = F.when(F.col("id") % 3 != 0, F.col("id") % 100 / 100.0)
    return P.reranked_first(h, relevance, F.when(F.col("id") % 7 == 0, 3.0).otherwise(1.0), 20, 40).select("id", "place")


@query("heading_boosts", "SELECT doc_id, CASE WHEN contains(text, 'Copyright') AND FALSE THEN 5.0 WHEN contains(lower(left(text, 400)), 'license') THEN 3.0 WHEN contains(lower(left(text, 400)), 'the') THEN 3.0 ELSE 1.0 END::DOUBLE AS boost FROM documents WHERE text IS NOT NULL AND NOT contains(text, 'SECTION_PATH:')")
def heading_boosts(spark, sf):
    d = B.table(spark, sf, "documents").where("text is not null and not contains(text, 'SECTION_PATH:')")
    return d.select("doc_id", P.heading_boost(F.col("text"), ["License", "the"]).cast("double").alias("boost"))


@query("identity_keys", "SELECT coalesce(nullif(CASE WHEN doc_id % 3 > 0 THEN doc_id::VARCHAR ELSE '' END, ''), left(text, 120)) AS key, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def identity_keys(spark, sf):
    d = B.table(spark, sf, "documents").where("text is not null")
    return d.groupBy(P.identity_key(F.when(F.col("doc_id") % 3 > 0, F.col("doc_id").cast("string")).otherwise(""), F.col("text")).alias("key")).agg(F.count("*").alias("n"))


@query("fresh_cache", "WITH y AS (SELECT user_id, max(ts) AS used_at, arg_max(event_type, ts) AS event_type FROM events WHERE epoch(TIMESTAMP '2024-01-20') - epoch(ts) <= 864000 GROUP BY user_id) SELECT user_id, used_at FROM y ORDER BY used_at DESC, user_id LIMIT 50")
def fresh_cache(spark, sf):
    e = B.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("used_at"), "event_type")
    return R.fresh_cache(e, ["user_id"], F.lit("2024-01-20 00:00:00").cast("timestamp"), 864000, 50).select("user_id", F.col("used_at").cast("timestamp_ntz").alias("used_at"))


@query("retried_documents", "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey IN (1, 2, 7) THEN 'queued' ELSE 'failed' END AS status, o_custkey % 3 + (o_orderkey IN (1, 2, 7))::INT AS retry_count FROM orders")
def retried_documents(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("failed").alias("status"), (F.col("o_custkey") % 3).alias("retry_count"))
    return R.retried(o, [1, 2, 7])


_ATT = "x AS (SELECT o_orderkey AS attempt_id, o_custkey % 40 AS exam_id, o_custkey AS learner_id, CASE WHEN o_orderkey % 5 = 0 THEN 'IN_PROGRESS' ELSE 'DONE' END AS status FROM orders), g AS (SELECT c_custkey % 40 AS exam_id, c_custkey AS student_id FROM customer WHERE c_custkey % 3 > 0)"


def _attempts(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("attempt_id"), (F.col("o_custkey") % 40).alias("exam_id"), F.col("o_custkey").alias("learner_id"), F.when(F.col("o_orderkey") % 5 == 0, "IN_PROGRESS").otherwise("DONE").alias("status"))
    return o, B.table(spark, sf, "customer").where("c_custkey % 3 > 0").select((F.col("c_custkey") % 40).alias("exam_id"), F.col("c_custkey").alias("student_id"))


@query("active_attempt", f"WITH {_ATT} SELECT attempt_id FROM x JOIN g ON g.exam_id = x.exam_id AND g.student_id = x.learner_id WHERE x.exam_id = 7 AND learner_id = 47 AND status = 'IN_PROGRESS' ORDER BY 1 LIMIT 1")
def active_attempt(spark, sf):
    a, g = _attempts(spark, sf)
    return R.active_attempt(a, g, 7, 47).select("attempt_id")


@query("new_attempts", f"WITH {_ATT} SELECT exam_id, student_id AS learner_id, -student_id AS attempt_id FROM g WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.exam_id = g.exam_id AND x.learner_id = g.student_id AND status = 'IN_PROGRESS')")
def new_attempts(spark, sf):
    a, g = _attempts(spark, sf)
    r = B.table(spark, sf, "customer").select((-F.col("c_custkey")).alias("attempt_id"), (F.col("c_custkey") % 40).alias("exam_id"), F.col("c_custkey").alias("learner_id"))
    return R.with_attempts(a, r.unionByName(r.withColumn("attempt_id", F.col("attempt_id") + 1)), g).where("attempt_id < 0").select("exam_id", "learner_id", "attempt_id")


@query("sealed_batches", "SELECT c_nationkey AS batch_id, count(*) + (c_nationkey % 3) - 1 AS total_files, c_nationkey % 2 = 0 AS auto_seal, c_nationkey % 2 = 0 AND count(*) >= count(*) + (c_nationkey % 3) - 1 AS sealed FROM customer GROUP BY c_nationkey")
def sealed_batches(spark, sf):
    c = B.table(spark, sf, "customer")
    b = c.groupBy(F.col("c_nationkey").alias("batch_id")).agg(F.count("*").alias("n")).select("batch_id", (F.col("n") + F.col("batch_id") % 3 - 1).alias("total_files"), (F.col("batch_id") % 2 == 0).alias("auto_seal"), F.lit(None).cast("boolean").alias("sealed"))
    return R.sealed_batches(b, c.select(F.col("c_nationkey").alias("batch_id"), F.col("c_name").alias("filename")))


@query("dominant_stage", "WITH c AS (SELECT event_type AS stage, count(*) AS n FROM events GROUP BY 1) SELECT arg_min(stage, (-n, stage)) AS stage, sum(n)::BIGINT AS events FROM c")
def dominant_stage(spark, sf):
    return O.dominant_stage(B.table(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("events")))


@query("event_page", "SELECT event_id, (SELECT count(*) FROM events) > 30 AS has_more FROM events ORDER BY ts, event_id LIMIT 30")
def event_page(spark, sf):
    return O.event_page(B.table(spark, sf, "events"), 30).select("event_id", "has_more")


_JOB = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'processing' END"


def _jobs(spark, sf):
    o = B.table(spark, sf, "orders")
    s = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing")
    at = F.col("o_orderdate").cast("timestamp")
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("job_type"), F.col("o_custkey").alias("doc_id"), (F.col("o_custkey") % 20).alias("tenant_id"), s.alias("status"), at.alias("created_at"), at.alias("updated_at"))


@query("claimed_jobs", f"WITH j AS (SELECT o_orderkey AS job_id, o_orderpriority AS job_type, {_JOB} AS status, o_orderdate AS c FROM orders), t AS (SELECT job_id FROM (SELECT *, row_number() OVER (PARTITION BY job_type ORDER BY c, job_id) AS r FROM j WHERE status = 'pending') WHERE r <= 2) SELECT job_id, CASE WHEN t.job_id IS NOT NULL THEN 'processing' ELSE status END AS status, CASE WHEN t.job_id IS NOT NULL THEN 'w1' END AS worker FROM j LEFT JOIN t USING (job_id)")
def claimed_jobs(spark, sf):
    return O.claimed(_jobs(spark, sf), "w1", F.lit("2000-01-01 00:00:00").cast("timestamp"), 2).select("job_id", "status", "worker")


@query("startable_jobs", f"WITH j AS (SELECT o_orderkey AS job_id, o_orderkey // 8 AS doc_id, o_custkey % 20 AS tenant_id, {_JOB} AS status, o_orderdate AS c FROM orders), b AS (SELECT * FROM j WHERE status = 'processing'), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c, job_id) AS d FROM j WHERE status = 'pending' AND doc_id NOT IN (SELECT doc_id FROM b)), f AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY c, job_id) AS turn FROM o WHERE d = 1), u AS (SELECT tenant_id, count(*) AS used FROM b GROUP BY tenant_id), m AS (SELECT max(used) + 3 AS slots FROM u) SELECT job_id FROM f LEFT JOIN u USING (tenant_id), m WHERE turn + coalesce(used, 0) <= slots")
def startable_jobs(spark, sf):
    jobs = _jobs(spark, sf).withColumn("doc_id", F.floor(F.col("job_id") / 8))
    most = jobs.where("status = 'processing'").groupBy("tenant_id").count().agg(F.max("count")).head()[0]
    return O.startable(jobs, most + 3).select("job_id")


@query("due_tenants", f"WITH j AS (SELECT o_custkey AS tenant_id, {_JOB} AS status, o_orderdate AS c FROM orders WHERE o_orderpriority = '1-URGENT'), t AS (SELECT c_custkey AS tenant_id FROM customer) SELECT tenant_id FROM t WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.tenant_id = t.tenant_id AND (status <> 'completed' OR c > TIMESTAMP '1997-01-01' - INTERVAL 1 DAY))")
def due_tenants(spark, sf):
    t = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("tenant_id"))
    return O.due_tenants(t, _jobs(spark, sf).withColumn("tenant_id", F.col("doc_id")), "1-URGENT", F.lit("1997-01-01 00:00:00").cast("timestamp"), 86400)


@query("stalled_batches", "WITH b AS (SELECT DISTINCT user_id % 50 AS batch_id FROM events), l AS (SELECT user_id % 50 AS batch_id, max(ts) AS last_event FROM events GROUP BY 1) SELECT batch_id, last_event, floor(epoch(TIMESTAMP '2024-01-31')) - floor(epoch(last_event)) > 180 AS stalled FROM b JOIN l USING (batch_id)")
def stalled_batches(spark, sf):
    e = B.table(spark, sf, "events").select((F.col("user_id") % 50).alias("batch_id"), "ts")
    b = e.select("batch_id", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at")).distinct()
    return O.stalled(b, e, F.lit("2024-01-31 00:00:00"))


@query("blank_line_spans", "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '\\n\\s*\\n'), lambda x: x <> '') AS p FROM d) SELECT doc_id, len(p)::INT AS spans, coalesce(list_sum(list_transform(p, lambda x: length(x))), 0)::BIGINT AS chars FROM p")
def blank_line_spans(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", I.blank_line_spans(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").alias("spans"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("chars"))


@query("section_of_page", "WITH t AS (SELECT l_orderkey AS doc, l_linenumber AS ord, l_suppkey AS page, 'T' || l_partkey AS title FROM lineitem), p AS (SELECT DISTINCT o_orderkey AS doc, (o_orderkey * 7 % 100)::BIGINT AS pos FROM orders) SELECT p.doc, p.pos, (SELECT arg_max(title, (page, ord, title)) FROM t WHERE t.doc = p.doc AND t.page <= p.pos) AS title FROM p")
def section_of_page(spark, sf):
    t = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord"), F.col("l_suppkey").alias("page"), F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("title"))
    return I.section_of_page(t, B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_orderkey") * 7 % 100).cast("long").alias("pos")))


@query("truncated_texts", "WITH d AS (SELECT doc_id, text, left(text, 300) AS h FROM documents WHERE text IS NOT NULL), c AS (SELECT *, CASE WHEN contains(h, chr(10) || chr(10)) THEN length(h) - length(string_split(h, chr(10) || chr(10))[-1]) - 2 WHEN contains(h, chr(10)) THEN length(h) - length(string_split(h, chr(10))[-1]) - 1 WHEN contains(h, '. ') THEN length(h) - length(string_split(h, '. ')[-1]) - 1 END AS a, CASE WHEN contains(h, ' ') THEN length(h) - length(string_split(h, ' ')[-1]) - 1 END AS b FROM d) SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE rtrim(left(h, CASE WHEN a > 0 THEN a WHEN b > 0 THEN b ELSE 300 END), ' ') || chr(10) || '[...]' END AS cut FROM c")
def truncated_texts(spark, sf):
    return B.table(spark, sf, "documents").where("text is not null").select("doc_id", api.truncated(F.col("text"), 300).alias("cut"))


@query("stripped_markup", "SELECT page_id, length(left(trim(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), ' '), 2000)) AS n FROM pages WHERE html IS NOT NULL")
def stripped_markup(spark, sf):
    return B.table(spark, sf, "pages").where("html is not null").select("page_id", F.length(X.strip_markup(F.col("html"))).cast("long").alias("n"))


@query("scope_keys", "SELECT p_partkey, regexp_replace(upper(trim(p_type || ' / ' || p_size)), '[^A-Z0-9]+', '-', 'g') AS key FROM part")
def scope_keys(spark, sf):
    return B.table(spark, sf, "part").select("p_partkey", X.scope_key(F.concat("p_type", F.lit(" / "), F.col("p_size").cast("string"))).alias("key"))


@query("boilerplate_free", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?im)^all rights reserved[^\\n]*$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '\\n+$', ''), ' ') AS text FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '(?im)iso|norma|internac|^\\s*(?:[ivxlcdm]+|\\d+)\\s*$|referencia|traducci') AND NOT contains(text, chr(13))")
def boilerplate_free(spark, sf):
    d = B.table(spark, sf, "documents").where(r"text is not null and not contains(text, '\r')").where(~F.col("text").rlike(r"(?im)iso|norma|internac|^\s*(?:[ivxlcdm]+|\d+)\s*$|referencia|traducci"))
    noise = F.lit("\n# NORMA\nNORMA INTERNACIONAL Traduccion oficial Official translation\nISO 9001:2015 (traducción oficial)\n© ISO 2015 - Todos los derechos reservados\nxii\n17\nxiii\n18\n")
    return d.select("doc_id", X.strip_boilerplate(F.concat(F.col("text"), noise)).alias("text")).withColumn("text", F.rtrim(F.regexp_replace("text", r"\n+$", "")))


@query("inserted_elements", "SELECT c_custkey, list_concat(list_concat([1, 2, 3][1:(c_custkey % 4)::INT], [c_custkey]), [1, 2, 3][(c_custkey % 4 + 1)::INT:])::VARCHAR AS l FROM customer")
def inserted_elements(spark, sf):
    c = B.table(spark, sf, "customer")
    a = R.insert_at(F.array(*(F.lit(k).cast("long") for k in (1, 2, 3))), (F.col("c_custkey") % 4).cast("int"), F.col("c_custkey"))
    return c.select("c_custkey", F.concat(F.lit("["), F.array_join(a.cast("array<string>"), ", "), F.lit("]")).alias("l"))


@query("inline_fallbacks", "SELECT p_partkey, p_name || chr(10) || chr(10) || '[VISUAL ' || upper(p_type) || ']' || chr(10) || coalesce(CASE WHEN p_size > 10 THEN p_brand END, '') AS block FROM part")
def inline_fallbacks(spark, sf):
    return B.table(spark, sf, "part").select("p_partkey", D.inline_fallback(F.col("p_name"), F.col("p_type"), F.when(F.col("p_size") > 10, F.col("p_brand"))).alias("block"))


@query("prompt_context", f"WITH {B.HITS} SELECT 'summary' || chr(10) || chr(10) || arg_max(scope || id, (similarity, -id)) AS context FROM h")
def prompt_context(spark, sf):
    return R.prompt_context(B.hits(spark, sf).withColumn("content", F.concat("scope", F.col("id").cast("string"))), F.lit("summary"))


_BLOCKS = "b AS (SELECT l_orderkey AS doc, l_linenumber % 2 AS page, l_partkey * 10 + l_linenumber AS ord, l_quantity AS top, l_quantity + 3 AS bottom, 50.0 AS height, CASE WHEN l_suppkey % 7 > 0 THEN l_shipdate::DATE::VARCHAR ELSE ' ' END AS text FROM lineitem), p AS (SELECT doc, page, coalesce(string_agg(trim(text), chr(10) ORDER BY ord, text) FILTER (bottom > 4.0 AND top < 46.0 AND trim(text) <> ''), '') AS text FROM b GROUP BY doc, page)"


def _pages(spark, sf):
    l = B.table(spark, sf, "lineitem")
    text = F.when(F.col("l_suppkey") % 7 > 0, F.col("l_shipdate").cast("date").cast("string")).otherwise(" ")
    b = l.select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 2).alias("page"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_quantity").alias("top"), (F.col("l_quantity") + 3).alias("bottom"), F.lit(50.0).alias("height"), text.alias("text"))
    return I.cropped_pages(b)


@query("cropped_pages", f"WITH {_BLOCKS} SELECT * FROM p")
def cropped_pages(spark, sf):
    return _pages(spark, sf)


@query("page_map", f"WITH {_BLOCKS} SELECT doc, page, coalesce(sum(length(text) + 2) OVER w, 0)::BIGINT AS start, (coalesce(sum(length(text) + 2) OVER w, 0) + length(text))::BIGINT AS \"end\" FROM p WINDOW w AS (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def page_map(spark, sf):
    return I.page_map(_pages(spark, sf))


@query("page_breadcrumbs", "WITH c AS (SELECT o_orderkey AS doc, (o_orderkey * 7 % 40)::BIGINT AS pos FROM orders), s AS (SELECT l_orderkey AS doc, l_linenumber AS page, (l_linenumber - 1) * 10 AS start FROM lineitem GROUP BY ALL), t AS (SELECT l_orderkey AS doc, l_linenumber AS ord, l_linenumber AS page, 'T' || l_partkey AS title FROM lineitem WHERE l_linenumber % 2 = 0), p AS (SELECT c.*, (SELECT max(page) FROM s WHERE s.doc = c.doc AND s.start <= c.pos) AS page FROM c) SELECT p.*, (SELECT arg_max(title, (t.page, ord, title)) FROM t WHERE t.doc = p.doc AND t.page <= p.page) AS breadcrumb FROM p")
def page_breadcrumbs(spark, sf):
    l = B.table(spark, sf, "lineitem")
    c = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_orderkey") * 7 % 40).cast("long").alias("pos"))
    s = l.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("page"), ((F.col("l_linenumber") - 1) * 10).cast("long").alias("start")).distinct()
    t = l.where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord"), F.col("l_linenumber").alias("page"), F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("title"))
    return I.page_breadcrumbs(c, s, t)


@query("enclosing_intervals", "WITH p AS (SELECT o_orderkey, o_custkey % 50 AS k, o_orderkey % 5000 AS pos FROM orders), i AS (SELECT c_custkey, c_custkey % 50 AS k, c_custkey * 3 AS a, c_custkey * 3 + round(abs(c_acctbal))::BIGINT AS b FROM customer) SELECT p.k, o_orderkey, c_custkey FROM p JOIN i ON p.k = i.k AND pos >= a AND pos < b")
def enclosing_intervals(spark, sf):
    p = B.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("k"), (F.col("o_orderkey") % 5000).alias("at"))
    c = B.table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 50).alias("k"), (F.col("c_custkey") * 3).alias("start"), (F.col("c_custkey") * 3 + F.round(F.abs("c_acctbal")).cast("long")).alias("end"))
    return IV.enclosing(p, c, ["k"]).select("k", "o_orderkey", "c_custkey")


@query("refined_percentiles", "SELECT l_returnflag, count(l_extendedprice) AS n, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY l_returnflag")
def refined_percentiles(spark, sf):
    return O.refined_percentiles(B.table(spark, sf, "lineitem"), "l_extendedprice", by=("l_returnflag",))


@query("checked_upsert", "WITH n AS (SELECT o_custkey AS id, o_orderkey AS seq, o_totalprice AS v FROM orders WHERE o_totalprice >= 50000), l AS (SELECT id, arg_max(v, seq) AS v FROM n GROUP BY id) SELECT c_custkey AS id, coalesce(l.v, c_acctbal) AS v, (SELECT count(*) FROM orders WHERE o_totalprice < 50000) AS rejected FROM customer LEFT JOIN l ON l.id = c_custkey UNION ALL SELECT l.id, l.v, (SELECT count(*) FROM orders WHERE o_totalprice < 50000) FROM l WHERE l.id NOT IN (SELECT c_custkey FROM customer)")
def checked_upsert(spark, sf):
    old = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    new = B.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("v"))
    merged, bad = I.checked_upsert(old, new, ["id"], F.col("seq"), {"TOO_SMALL": F.col("v") >= 50000})
    return merged.select("id", "v", F.lit(bad.count()).alias("rejected"))
