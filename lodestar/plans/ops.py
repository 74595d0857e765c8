"""Queries of operational analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.catalog import query
from lodestar.functions import text as X
from lodestar.operators import operations as O
from lodestar.plans import binding as B

_STAGE = "CASE WHEN regexp_matches(m, 'raptor') THEN 'RAPTOR' WHEN regexp_matches(m, 'grafo|graph') THEN 'GRAPH' WHEN regexp_matches(m, 'visual') THEN 'VISUAL' WHEN regexp_matches(m, 'persist') THEN 'PERSIST' WHEN regexp_matches(m, 'dispatch|ingestion|procesamiento') THEN 'INGEST' WHEN regexp_matches(m, 'error') THEN 'ERROR' WHEN regexp_matches(m, 'exitoso|success') THEN 'DONE' ELSE 'OTHER' END"
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'processing' END"


def _docs(spark, sf):
    o = B.table(spark, sf, "orders")
    s = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 11 == 0, "failed").otherwise("pending")).otherwise("processing")
    return o.select((F.col("o_custkey") % 50).alias("batch_id"), F.col("o_orderkey").alias("doc_id"), s.alias("status"), F.element_at(F.array(*map(F.lit, ("INGEST", "PERSIST", "VISUAL", "GRAPH"))), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("stage"))


_DOCS = "d AS (SELECT o_custkey % 50 AS batch_id, o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'pending' END ELSE 'processing' END AS status, [0.15, 0.35, 0.55, 0.88][(o_orderkey % 4 + 1)::INT] AS stage_weight FROM orders)"


@query("batch_progress", f"WITH {_DOCS}, g AS (SELECT batch_id, count(*) AS n, count_if(status = 'completed') AS done, count_if(status = 'failed') AS failed, sum(CASE WHEN status IN ('completed', 'failed') THEN 1.0 WHEN status = 'pending' THEN 0.05 ELSE stage_weight END)::DOUBLE AS work FROM d GROUP BY batch_id) SELECT batch_id, n + 3 AS total, done, failed, round((work + 3 * 0.05) / (n + 3) * 100, 1) AS progress, 'processing' AS status FROM g")
def batch_progress(spark, sf):
    d = _docs(spark, sf)
    b = d.groupBy("batch_id").agg((F.count("*") + 3).alias("total_files"))
    return O.batch_progress(b, d)


@query("latest_event_stage", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_event_stage(spark, sf):
    e = B.table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    return O.latest_event(e, "user_id").select("user_id", "event_type", "ts")


@query("stage_counts", f"SELECT {_STAGE} AS stage, count(*) AS events FROM (SELECT lower(event_type) || CASE WHEN event_id % 5 = 0 THEN ' visual anchor' WHEN event_id % 5 = 1 THEN ' persist' ELSE '' END AS m FROM events) GROUP BY 1")
def stage_counts(spark, sf):
    e = B.table(spark, sf, "events")
    m = F.concat("event_type", F.when(F.col("event_id") % 5 == 0, " visual anchor").when(F.col("event_id") % 5 == 1, " persist").otherwise(""))
    return O.stage_counts(e.select(m.alias("message")))


@query("percentiles", "SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def percentiles(spark, sf):
    return O.percentiles(B.table(spark, sf, "events"), "value", by=("event_type",))


def _jobs(spark, sf):
    o = B.table(spark, sf, "orders")
    s = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing")
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("job_type"), F.col("o_custkey").alias("doc_id"), s.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))


@query("queue_wait", f"WITH j AS (SELECT o_orderpriority AS job_type, {_STATUS} AS status, o_orderdate AS created_at FROM orders) SELECT job_type, count_if(status = 'pending') AS pending, coalesce(greatest(epoch(TIMESTAMP '2000-01-01')::BIGINT - epoch(min(CASE WHEN status = 'pending' THEN created_at END))::BIGINT, 0), 0) AS oldest_wait, ceil(count_if(status = 'pending') / 40 * 60)::BIGINT AS eta_seconds, count_if(status = 'pending') < 500 AS accepts FROM j GROUP BY job_type")
def queue_wait(spark, sf):
    return O.queue_depth(_jobs(spark, sf), F.lit("2000-01-01 00:00:00").cast("timestamp"))


@query("dequeue_oldest", f"WITH j AS (SELECT o_orderkey AS job_id, o_orderpriority AS job_type, {_STATUS} AS status, o_orderdate AS created_at FROM orders) SELECT job_type, job_id FROM (SELECT *, row_number() OVER (PARTITION BY job_type ORDER BY created_at, job_id) AS r FROM j WHERE status = 'pending') WHERE r <= 3")
def dequeue_oldest(spark, sf):
    return O.dequeue(_jobs(spark, sf), 3).select("job_type", "job_id")


@query("enqueue_idempotent", f"WITH j AS (SELECT o_orderpriority AS job_type, o_custkey AS doc_id, {_STATUS} AS status FROM orders), c AS (SELECT DISTINCT o_orderpriority AS job_type, c_custkey AS doc_id FROM customer, (SELECT DISTINCT o_orderpriority FROM orders)) SELECT job_type, doc_id FROM c WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.job_type = c.job_type AND j.doc_id = c.doc_id AND status IN ('pending', 'processing'))")
def enqueue_idempotent(spark, sf):
    j = _jobs(spark, sf)
    types = F.broadcast(j.select("job_type").distinct())
    c = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id")).join(types, F.lit(True))
    return O.enqueue(c.select("job_type", "doc_id"), j)


@query("requeue_stale", f"SELECT CASE WHEN s = 'processing' AND d < TIMESTAMP '1996-01-01' - INTERVAL 900 SECOND THEN 'pending' ELSE s END AS status, count(*) AS jobs FROM (SELECT {_STATUS} AS s, o_orderdate AS d FROM orders) GROUP BY 1")
def requeue_stale(spark, sf):
    r = O.requeue_stale(_jobs(spark, sf), F.lit("1996-01-01 00:00:00").cast("timestamp"))
    return r.groupBy("status").agg(F.count("*").alias("jobs"))


@query("retry_policy", "SELECT CASE WHEN l_linenumber >= 3 THEN 'dead_letter' ELSE 'retry' END AS action, count(*) AS n FROM lineitem GROUP BY 1")
def retry_policy(spark, sf):
    return B.table(spark, sf, "lineitem").groupBy(O.retry_action(F.col("l_linenumber")).alias("action")).agg(F.count("*").alias("n"))


@query("event_tail", "SELECT event_id, ts, event_type FROM events WHERE (ts, event_id) > (SELECT (ts, event_id) FROM events WHERE event_id = 100) ORDER BY ts, event_id LIMIT 50")
def event_tail(spark, sf):
    e = B.table(spark, sf, "events")
    c = e.where("event_id = 100").select(F.col("ts").cast("string"), "event_id").head()
    return O.event_tail(e, 50, (c[0], c[1])).select("event_id", "ts", "event_type")


@query("conversation_window", "WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE trim(coalesce(text, '')) <> '') SELECT conv_id, string_agg(upper(role) || ': ' || trim(text, ' '), chr(10) ORDER BY turn) AS context FROM t WHERE r <= 6 GROUP BY conv_id")
def conversation_window(spark, sf):
    return O.conversation_window(B.table(spark, sf, "conversations"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    e = B.table(spark, sf, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), "event_type", "events")


@query("user_sessions", "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, k")
def user_sessions(spark, sf):
    e = B.table(spark, sf, "events").select("user_id", "ts")
    s = e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("events"))
    return s.select("user_id", F.col("w.start").alias("start"), "events")


@query("visual_accounting", "SELECT o_custkey % 20 AS batch_id, sum(o_orderkey % 3)::BIGINT AS images, count_if(o_orderkey % 3 > 0) AS docs_with_images, array_to_string(list_sort(list(o_orderkey) FILTER (o_orderkey % 3 > 0))[1:20], ',') AS refs FROM orders GROUP BY 1")
def visual_accounting(spark, sf):
    o = B.table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("batch_id"), F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 3).alias("images"))
    return O.visual_accounting(o).withColumn("refs", F.array_join(F.transform("refs", lambda x: x.cast("string")), ","))


@query("backend_hit_ratio", "SELECT round(count_if(event_type = 'view')::DOUBLE / count(*), 4) AS ratio FROM events")
def backend_hit_ratio(spark, sf):
    return O.hit_ratio(B.table(spark, sf, "events"), F.col("event_type") == "view")


@query("time_to_searchable", "SELECT user_id, count(*) AS n, min(ts) AS first_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS lag_seconds FROM events GROUP BY user_id")
def time_to_searchable(spark, sf):
    e = B.table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.expr("timestampdiff(SECOND, min(ts), max(ts))").alias("lag_seconds"))


@query("json_props", "SELECT event_type, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type")
def json_props(spark, sf):
    v = F.try_variant_get(F.parse_json("props"), "$.k", "long")
    return B.table(spark, sf, "events").groupBy("event_type").agg(F.sum(v).alias("k"))


@query("json_kinds", "SELECT event_type, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' ELSE 'other' END AS kind, count_if(json_extract(props, '$.k')::BIGINT = 3) AS threes, count(*) AS n FROM events GROUP BY 1, 2")
def json_kinds(spark, sf):
    e = B.table(spark, sf, "events")
    return e.groupBy("event_type", X.json_kind(F.col("props"), "$.k").alias("kind")).agg(F.count_if(X.json_holds(F.col("props"), "$.k", 3)).alias("threes"), F.count("*").alias("n"))
